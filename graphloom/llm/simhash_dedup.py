"""SimHash near-dedup by anchor-point covering.

Anchors are the words of a covering code: two blocks of 23 of the 64 fingerprint
bits, each covered by the perfect binary Golay code with radius 3. A fingerprint
is held at its nearest anchor and replicated to every anchor that a fingerprint
within the threshold may be held at (the anchors within covering radius plus
threshold that matter); fingerprints are then compared per anchor, on all 64 bits.
Two fingerprints within the threshold always meet: a change of at most d bits
moves the nearest anchor to one that the enumeration over d bits has visited.

Equal fingerprints are collapsed before the replication, and each anchor hands on
a spanning forest of its links, never all pairs.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; rows without an id are linked too, and a component without any id has a
null component_id; repeated rows share a component; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, components, id_text, own_batches, settle, small_batches

_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_BITS = 23
_CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned SimHash: a bit is set if it is in more than half of the shingles' XXH64 (seed 42)."""
    from xxhash import xxh64_intdigest as xxh

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words))
    spans = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), _CHUNK):
        h = np.array([xxh(joined[a:z], 42) for a, z in spans[at : at + _CHUNK]], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(spans)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _syndrome(word: np.ndarray) -> np.ndarray:
    word = word.copy()
    for i in range(_BITS - 1, 10, -1):
        word ^= np.where(word >> i & 1, _GENERATOR << (i - 11), 0)
    return word


@cache
def golay_tables(threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: what to xor to reach each anchor that up to threshold flips lead to, and the flips needed (99: none)."""
    patterns = [(w, sum(1 << i for i in c)) for w in range(4) for c in combinations(range(_BITS), w)]
    leaders = np.zeros(1 << 11, np.int64)
    words = np.array([p for _, p in patterns], np.int64)
    leaders[_syndrome(words)] = words
    flips = [(w, sum(1 << i for i in c)) for w in range(threshold + 1) for c in combinations(range(_BITS), w)]
    e = np.array([p for _, p in flips], np.int64)
    cost = np.array([w for w, _ in flips], np.int64)
    es = _syndrome(e)
    rows = []
    for s in range(1 << 11):
        delta = e ^ leaders[s ^ es]
        found, first = np.unique(delta, return_index=True)  # flips stand in order of cost
        order = np.argsort(cost[first], kind="stable")
        rows.append((found[order], cost[first][order]))
    most = max(len(d) for d, _ in rows)
    deltas, costs = np.zeros((1 << 11, most), np.int64), np.full((1 << 11, most), 99, np.int64)
    for s, (d, c) in enumerate(rows):
        deltas[s, : len(d)], costs[s, : len(d)] = d, c
    return deltas, costs


def anchors(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into prints, anchor, own): each print's anchors; own marks the nearest one."""
    deltas, costs = golay_tables(threshold)
    mask = (1 << _BITS) - 1
    low = (prints & np.uint64(mask)).astype(np.int64)
    high = (prints >> np.uint64(_BITS) & np.uint64(mask)).astype(np.int64)
    sl, sh = _syndrome(low), _syndrome(high)
    total = costs[sl][:, :, None] + costs[sh][:, None, :]
    i, a, b = np.nonzero(total <= threshold)
    anchor = (low[i] ^ deltas[sl[i], a]) << _BITS | (high[i] ^ deltas[sh[i], b])
    return i, anchor, total[i, a, b] == 0


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, root) of the components of links a-b."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _links(prints: np.ndarray, own: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one anchor's members; compared in blocks."""
    held, out = prints[own], []
    step = max(1, (1 << 22) // max(1, len(prints)))
    for at in range(0, len(held), step):
        block = held[at : at + step]
        i, j = np.nonzero(np.bitwise_count(block[:, None] ^ prints[None, :]) <= threshold)
        a, b = block[i], prints[j]
        if (differ := a != b).any():
            out.append(_forest(a[differ], b[differ]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _forest(np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out]))


def _compare(threshold: int):
    def pairs(anchor, prints, own):
        """Links of many small anchors at once: each held print against its anchor's members."""
        start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        size = np.diff(np.r_[start, len(anchor)])
        group = np.repeat(np.arange(len(start)), size)
        n_own = np.add.reduceat(own.astype(np.int64), start)
        small = (n_own > 0) & (size > 1) & (n_own * size <= 1 << 16)
        a, b = [], []
        rows = np.flatnonzero(own & small[group])
        reach = size[group[rows]]
        cut = np.searchsorted(np.cumsum(reach), np.arange(0, reach.sum() + 1, 1 << 22)) if len(rows) else [0]
        for x, z in zip(cut, [*cut[1:], len(rows)], strict=True):
            part, n = rows[x:z], reach[x:z]
            if not len(part):
                continue
            left = np.repeat(part, n)
            right = np.repeat(start[group[part]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            near = (np.bitwise_count(prints[left] ^ prints[right]) <= threshold) & (prints[left] != prints[right])
            a.append(prints[left[near]])
            b.append(prints[right[near]])
        for g in np.flatnonzero((n_own > 0) & (size > 1) & ~small):
            s = slice(start[g], start[g] + size[g])
            u, v = _links(prints[s], own[s], threshold)
            a.append(u)
            b.append(v)
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64),) * 2

    def run(batches):
        rest = None
        for b in _chain(batches):
            if b is not None:
                cols = [
                    b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64),
                    b.column(2).to_numpy(zero_copy_only=False),
                ]
                rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
                if rest[0][0] == rest[0][-1]:
                    continue  # one anchor still
                end = np.searchsorted(rest[0], rest[0][-1])
                now, rest = [x[:end] for x in rest], [x[end:] for x in rest]
            elif rest is None:
                return
            else:
                now = rest
            u, v = pairs(*now)
            if len(u):
                u, v = _forest(u, v)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["a", "b"])

    return run


def _chain(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def _prints(rows: DataFrame, shingle: int, *more: str) -> DataFrame:
    """rows (doc_id, text, more) with the fingerprint (print) in place of the text."""
    small_batches(rows.sparkSession)
    names = ["doc_id", *more, "print"]

    def scan(batches):
        for b in batches:
            prints = np.array([fingerprint(t, shingle) for t in b.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(prints.view(np.int64))], names)

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names[:-1]) + ", print long"
    return rows.select("text", *names[:-1]).mapInArrow(scan, schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    return _prints(id_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary")), shingle)


def _labelled(prints: DataFrame, threshold: int, best) -> DataFrame:
    """(print, root, best): each distinct print with its component and the best of its documents."""
    batch_rows(prints.sparkSession, 20_000)
    roots = components(links(prints, threshold)).withColumnRenamed("node", "print")
    labels = prints.groupBy("print").agg(best).join(roots, "print", "left")
    return labels.withColumn("root", F.coalesce("root", "print"))


def _tail(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Majorities of the six triples of the last 18 bits, and what it takes to turn each: 2 flips if all its bits agree, else 1."""
    bits = (prints[:, None] >> np.arange(2 * _BITS, 64, dtype=np.uint64)) & np.uint64(1)
    ones = bits.reshape(len(prints), 6, 3).sum(2).astype(np.int64)
    return (ones >= 2) @ (1 << np.arange(6)), np.where((ones == 0) | (ones == 3), 2, 1)


def _split(threshold: int):
    """Deal a heavy anchor's prints once more, by a third code: triples of the remaining bits, covered with radius 1."""
    subsets = np.array([sum(1 << i for i in c) for w in range(threshold + 1) for c in combinations(range(6), w)])
    inside = (subsets[:, None] >> np.arange(6)) & 1

    def run(batches):
        for b in batches:
            anchor, prints, own = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(
                zero_copy_only=False
            )
            heavy = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            code, price = _tail(prints)
            take = (price @ inside.T <= threshold) & heavy[:, None]
            take[:, 0] = True
            i, k = np.nonzero(take)
            sub = np.where(heavy[i], code[i] ^ subsets[k], 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[i] | sub), pa.array(prints[i].view(np.int64)), pa.array(own[i] & (k == 0))],
                ["anchor", "print", "own"],
            )

    return run


def links(prints: DataFrame, threshold: int = 2, heavy: int = 1 << 14) -> DataFrame:
    """Edges (a, b) that connect all distinct prints which differ in at most threshold bits.

    An anchor that holds more than `heavy` prints is dealt again by the remaining bits.
    """

    def replicate(batches):
        for b in batches:
            every = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), 4096):
                cut = every[at : at + 4096]
                i, anchor, own = anchors(cut, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor << 6), pa.array(cut[i].view(np.int64)), pa.array(own)], ["anchor", "print", "own"],
                )

    def held(batches):
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            mask = np.uint64((1 << _BITS) - 1)
            low, high = (x & mask).astype(np.int64), (x >> np.uint64(_BITS) & mask).astype(np.int64)
            deltas, _ = golay_tables(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(((low ^ deltas[_syndrome(low), 0]) << _BITS | (high ^ deltas[_syndrome(high), 0])) << 6)],
                ["anchor"],
            )

    distinct = settle(prints.select("print").distinct(), "distinct")
    rows = distinct.repartition(max(1, distinct.count() // 20_000), "print").mapInArrow(
        replicate, "anchor long, print long, own boolean",
    )
    full = settle(
        distinct.mapInArrow(held, "anchor long").groupBy("anchor").agg(
            F.count(F.lit(1)).alias("n")
        ).where(F.col("n") > heavy).select("anchor"),
        "heavy",
    )
    if not full.isEmpty():
        marked = rows.join(full.withColumn("heavy", F.lit(True)), "anchor", "left").select(
            "anchor", "print", "own", F.coalesce("heavy", F.lit(False)),
        )
        rows = marked.mapInArrow(_split(threshold), "anchor long, print long, own boolean")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(threshold), "a long, b long")


def survivors(
    docs: DataFrame, key: str, threshold: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(key): of each component the key of the document with the smallest id, null last, then the smallest key."""
    rows = docs.select(
        F.col(key).alias("key"), F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("best")
    with own_batches(docs.sparkSession):
        prints = settle(_prints(rows, shingle, "key"), "prints")
        labels = _labelled(prints, threshold, best)
    return labels.groupBy("root").agg(F.min("best").alias("best")).select("best.key")


def simhash_dedup(
    docs: DataFrame, threshold: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    with own_batches(docs.sparkSession):
        prints = settle(fingerprints(docs, id_col, text_col, shingle), "prints")
        labels = _labelled(prints, threshold, F.min("doc_id").alias("doc_id"))
    least = labels.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = labels.join(least, "root").select("print", "component_id")
    shown = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return prints.join(named, "print").select("doc_id", shown.alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
