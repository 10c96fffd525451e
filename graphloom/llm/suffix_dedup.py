"""Removal of repeated byte strings by suffix arrays built with two-stage sorting.

A string of `length` bytes that starts at two places is found in four steps.

1. Every window of `length` bytes is dealt to the 16-byte gram in it with the least
   hash (leftmost of equals). Equal windows share that gram and their offset to it,
   so a repeat never leaves its gram's bucket. Neighbouring windows with the same
   gram form a run; only runs of grams that occur more than once go on.
2. Equal runs are collapsed and counted before the shuffle. A run that occurs twice
   is repeated as a whole; the others of a bucket have to be sorted.
3. Each task sorts the suffixes that start in its buckets' runs in two stages: those
   smaller than their successors directly, the rest by one scan over the buckets of
   first bytes in order. Adjacent common prefixes of `length` bytes or more are repeats.
4. The repeats are sent back to their documents and merged into maximal spans.

A bucket with more than `wide` different runs is dealt again before it is sorted: each of
its windows goes to its least gram by another hash as well, and the runs of both grams
form buckets of their own. What still shares all grams after `levels` such rounds, runs
that differ in little, is counted window by window, by 128-bit hashes.

Defined results: texts shorter than `length`, null and empty texts lose nothing;
repeated rows are repeats of each other; a row is told by two 64-bit hashes of its id
and text, so null and repeated ids do no harm; rows that share both id and text share
their result; equal runs are told by 128 bits of hashes and their length; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, release, settle, small_batches

_GRAM = 16
_SEGMENT = 1 << 20
_SORTED_AT_ONCE = 1 << 18
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _words(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one little-endian number."""
    x = b.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    return x[:-4] | x[4:] << np.uint64(32)


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    x = _words(b)
    h = (x[:-8] * _M1) ^ ((x[8:] ^ (x[8:] >> np.uint64(29))) * _M2)
    h = (h ^ (h >> np.uint64(32))) * _M3
    return h ^ (h >> np.uint64(29))


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring keys."""
    n = len(key) - width + 1
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(text: bytes, length: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, number of windows) of the runs of a text; each level orders the grams by another hash."""
    out = []
    for at in range(0, len(text) - length + 1, _SEGMENT):
        b = np.frombuffer(text, np.uint8)[at : at + _SEGMENT + length - 1]
        h = _gram_hashes(b)
        if level:
            h = (h ^ (h >> np.uint64(31)) ^ np.uint64(level)) * _M1
            h = (h ^ (h >> np.uint64(32))) * _M2
        key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        least = (_least(key, length - _GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        out.append((h[least[first]], first + at, np.diff(np.r_[first, len(least)])))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated_suffixes(texts: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each text, which of its first counts[i] suffixes begin with `length` bytes that another suffix begins with.

    Two-stage suffix sorting of the suffixes wanted, each at least to `length` bytes.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    wanted = np.array(counts, np.int64)
    whole = b"".join(texts)
    b = np.frombuffer(whole + b"\0" * 16, np.uint8)
    start = np.r_[0, np.cumsum(sizes)[:-1]]
    n = len(whole)
    # Type of a suffix: smaller than its successor, by the next byte that differs; at the end of a text it is larger.
    last = np.zeros(n, bool)
    last[start + sizes - 1] = True
    decides = last | np.r_[b[1:n] != b[: n - 1], True]
    smaller = ~last & np.r_[b[: n - 1] < b[1:n], False]
    at = np.flatnonzero(decides)
    smaller = smaller[at[np.searchsorted(at, np.arange(n))]]
    # What is sorted: the wanted suffixes, and after the last one on to the first that is sorted directly.
    direct = np.flatnonzero(smaller)
    end = start + wanted
    beyond = np.searchsorted(direct, end - 1)
    stop = np.minimum(
        np.where(
            beyond < len(direct), direct[np.minimum(beyond, max(0, len(direct) - 1))] + 1 if len(direct) else n, n,
        ),
        start + sizes,
    )
    stop = np.maximum(stop, end)
    used = np.zeros(n + 1, np.int64)
    np.add.at(used, start, 1)
    np.add.at(used, stop, -1)
    used = np.cumsum(used)[:n] > 0
    head = np.zeros(n, bool)
    head[start] = True
    # Stage one.
    chosen = np.flatnonzero(smaller & used)
    limit = np.repeat(start + sizes, sizes)[chosen]
    cut = [whole[i:z] for i, z in zip(chosen.tolist(), np.minimum(chosen + length, limit).tolist(), strict=True)]
    order = sorted(range(len(cut)), key=cut.__getitem__)
    direct = chosen[np.array(order, np.int64)] if order else chosen
    del cut, order
    tops = np.searchsorted(b[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    # Suffixes at the end of a text have no successor: they are the least of their bucket.
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    ends = np.flatnonzero(last & used)
    for c in np.unique(b[ends]).tolist():
        queues[c].append(ends[b[ends] == c])
    larger = used & ~smaller
    # Stage two.
    array = []
    for c in range(256):
        got = queues[c]
        cur = np.concatenate(got) if got else np.zeros(0, np.int64)
        parts = [cur]
        while len(cur):
            before = cur[~head[cur]] - 1
            cur = before[larger[before] & (b[before] == c)]
            parts.append(cur)
        bucket = np.concatenate([*parts, direct[tops[c] : tops[c + 1]]])
        if not len(bucket):
            continue
        array.append(bucket)
        before = bucket[~head[bucket]] - 1
        before = before[larger[before] & (b[before] > c)]
        if len(before):
            first = b[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            edge = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
            for x, z in zip(edge.tolist(), [*edge[1:].tolist(), len(first)], strict=True):
                queues[first[x]].append(before[x:z])
        queues[c] = []
    suffixes = np.concatenate(array) if array else np.zeros(0, np.int64)
    wants = np.zeros(n, bool)
    wants[np.repeat(start - np.r_[0, np.cumsum(wanted)[:-1]], wanted) + np.arange(wanted.sum())] = True
    suffixes = suffixes[wants[suffixes]]
    # Adjacent common prefixes.
    common = adjacent_prefixes(b, suffixes, length)
    twice = np.zeros(n, bool)
    twice[suffixes[:-1][common >= length]] = True
    twice[suffixes[1:][common >= length]] = True
    return [twice[s : s + k] for s, k in zip(start.tolist(), wanted.tolist(), strict=True)]


def adjacent_prefixes(b: np.ndarray, suffixes: np.ndarray, length: int) -> np.ndarray:
    """Common prefix lengths of neighbours in the suffix array, counted up to `length`."""
    x, y = suffixes[:-1], suffixes[1:]
    out = np.full(len(x), length, np.int64)
    words = _words(np.r_[b, np.zeros(16, np.uint8)])
    top = len(words) - 1
    left = np.arange(len(x))
    for at in range(0, length, 8):
        differ = words[np.minimum(x[left] + at, top)] ^ words[np.minimum(y[left] + at, top)]
        ends = differ != 0
        low = differ[ends] & (~differ[ends] + np.uint64(1))
        out[left[ends]] = np.minimum(length, at + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        left = left[~ends]
    return out


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _scan(length: int):
    from xxhash import xxh64_intdigest

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cols: list[list] = [[], [], [], [], [], []]
                for k1, k2, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if len(text) < length:
                        continue
                    h, first, n = runs(text, length)
                    cut = zip(first.tolist(), (first + n + length - 1).tolist(), strict=True)
                    body = np.array([xxh64_intdigest(text[a:z]) for a, z in cut], np.uint64)
                    for col, x in zip(
                        cols,
                        (h.view(np.int64), body.view(np.int64), np.full(len(h), k1), np.full(len(h), k2), first, n),
                        strict=True,
                    ):
                        col.append(x)
                if cols[0]:
                    h, body, k1, k2, first, n = (np.concatenate(c) for c in cols)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (h, body, k1, k2, first.astype(np.int32), n.astype(np.int32))],
                        ["gram", "body", "k1", "k2", "first", "n"],
                    )

    return run


def _cut_out(length: int):
    def run(batches):
        for b in batches:
            for text, reps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cols = [pa.array([r[k] for r in reps], pa.int64()) for k in ("gram", "body", "n", "kinds")]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array([text[r["first"] : r["first"] + r["n"] + length - 1] for r in reps], pa.binary())],
                    ["gram", "body", "n", "kinds", "bytes"],
                )

    return run


def _deal_again(length: int, level: int):
    """Runs of one more gram inside runs (gram, body, bytes), with their place there."""
    from xxhash import xxh64_intdigest

    def run(batches):
        for b in batches:
            for gram, body, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                h, first, n = runs(data, length, level)
                both = (h ^ np.uint64(gram & 0xFFFFFFFFFFFFFFFF)) * _M3
                cut = [data[a:z] for a, z in zip(first.tolist(), (first + n + length - 1).tolist(), strict=True)]
                bodies = np.array([xxh64_intdigest(x) for x in cut], np.uint64)
                up = [pa.array(np.full(len(h), x)) for x in (gram, body)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((both ^ (both >> np.uint64(29))).view(np.int64)), pa.array(bodies.view(np.int64)),
                        pa.array(n), *up, pa.array(first), pa.array(cut, pa.binary()),
                    ],
                    ["gram", "body", "n", "up_gram", "up_body", "off", "bytes"],
                )

    return run


def _sort(length: int):
    def solve(rows: list[tuple]):
        flags = repeated_suffixes([r[3] for r in rows], [r[2] for r in rows], length)
        cols: list[list] = [[], [], [], []]
        for (gram, body, _, _), f in zip(rows, flags, strict=True):
            a, z = _spans(f)
            for c, x in zip(cols, ([gram] * len(a), [body] * len(a), a.tolist(), z.tolist()), strict=True):
                c += x
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["gram", "body", "a", "z"])

    def run(batches):
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if held >= _SORTED_AT_ONCE and r[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(r)
                held += r[2]
        if rows:
            yield solve(rows)

    return run


def _window_hashes(length: int):
    def run(batches):
        for b in batches:
            for gram, body, n, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                hashes = [hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([gram] * n, pa.int64()), pa.array([body] * n, pa.int64()),
                        pa.array(range(n), pa.int64()), pa.array(hashes, pa.binary()),
                    ],
                    ["gram", "body", "a", "hash"],
                )

    return run


def _finish(batches):
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for name, text, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            merged: list[list[int]] = []
            for a, z in sorted((s >> 32, s & 0xFFFFFFFF) for s in spans or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z])
            sha, at = hashlib.sha256(), 0
            for a, z in merged:
                sha.update(text[at:a])
                at = z
            sha.update(text[at:])
            for c, x in zip(cols, (name, len(text), merged, [a for a, _ in merged], sha.hexdigest()), strict=True):
                c.append(x)
        starts, stops = cols[3], [[z for _, z in m] for m in cols[2]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(starts, pa.list_(pa.int64())),
                pa.array(stops, pa.list_(pa.int64())), pa.array(cols[4], pa.string()),
            ],
            ["doc_id", "n_bytes", "starts", "stops", "kept_sha256"],
        )


_SPANS = "gram long, body long, a long, z long"


def _maximal(spans: DataFrame) -> DataFrame:
    """(gram, body, a, z) with the spans of a run that meet or overlap as one, so that a run's places are not multiplied by its windows."""
    by = Window.partitionBy("gram", "body").orderBy("a", "z")
    reach = F.max("z").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.withColumn("opens", F.when(F.col("a") <= reach, 0).otherwise(1))
    numbered = opens.withColumn("i", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("gram", "body", "i").agg(F.min("a").alias("a"), F.max("z").alias("z")).drop("i")


def _repeats(cut: DataFrame, length: int, wide: int, levels: int, level: int = 0) -> DataFrame:
    """(gram, body, a, z): repeated windows of different runs (gram, body, n, kinds, bytes) that share a gram; kinds: how many of them."""
    part = ["gram", "body", "n"]
    # Rows that share id and text give the same run more than once.
    once = lambda which: cut.where(which).select(*part, "bytes").dropDuplicates(part)
    light = (
        once(F.col("kinds").between(2, wide))
        .repartition("gram")
        .sortWithinPartitions("gram", "body")
        .mapInArrow(_sort(length), _SPANS)
    )
    heavy = settle(once((F.col("kinds") > wide) & (F.col("kinds") > 1)), "heavy")
    if heavy.isEmpty():
        return light
    if level == levels:
        hashes = heavy.mapInArrow(_window_hashes(length), "gram long, body long, a long, hash binary")
        twice = hashes.groupBy("gram", "hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        return light.union(
            hashes.join(twice, ["gram", "hash"], "left_semi").select("gram", "body", "a", (F.col("a") + 1).alias("z"))
        )
    schema = "gram long, body long, n long, up_gram long, up_body long, off long, bytes binary"
    dealt = settle(
        heavy.repartition("body").select("gram", "body", "bytes").mapInArrow(_deal_again(length, level + 1), schema),
        "dealt",
    )
    groups = settle(
        dealt.groupBy("gram", "body", "n").agg(F.count(F.lit(1)).alias("times"), F.first("bytes").alias("bytes")),
        "groups",
    )
    kinds = groups.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    inner = _repeats(groups.join(kinds, "gram"), length, wide, levels, level + 1)
    whole = groups.where("times > 1").select("gram", "body", F.lit(0).cast("long").alias("a"), F.col("n").alias("z"))
    found = settle(_maximal(inner.union(whole)), "inner")
    back = dealt.select("gram", "body", "n", "up_gram", "up_body", "off").join(found, ["gram", "body"]).where("z <= n")
    return light.union(
        back.select(
            F.col("up_gram").alias("gram"), F.col("up_body").alias("body"), (F.col("off") + F.col("a")).alias("a"),
            (F.col("off") + F.col("z")).alias("z"),
        )
    )


def suffix_dedup(
    docs: DataFrame, length: int = 200, wide: int = 1 << 11, levels: int = 4, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, starts and stops of the removed spans, kept_sha256."""
    if length < 2 * _GRAM:
        raise ValueError(f"length must be {2 * _GRAM} or more")
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # A row is told by its id and its text; the first column is the seed of the next one's hash.
    same = ["k1", "k2"]
    keys = tuple(F.xxhash64(F.lit(i), F.col("doc_id").isNull(), "doc_id", "text").alias(k) for i, k in enumerate(same))
    every = settle(
        rows.select(*keys, "text").mapInArrow(
            _scan(length), "gram long, body long, k1 long, k2 long, first int, n int",
        ),
        "runs",
    )
    again = every.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram")
    again = settle(again, "again")
    release(spark)
    kept = settle(every.join(again, "gram", "left_semi"), "runs")
    discard(every)
    one = F.min(F.struct(*same, "first")).alias("one")
    bodies = settle(kept.groupBy("gram", "body", "n").agg(F.count(F.lit(1)).alias("times"), one), "bodies")
    kinds = bodies.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    differ = bodies.join(kinds, "gram").select("gram", "body", "n", "kinds", "one.*")
    asked = differ.groupBy(*same).agg(F.collect_list(F.struct("gram", "body", "n", "kinds", "first")).alias("reps"))
    found = (
        rows.select(*keys, "text")
        .join(asked, same)
        .select("text", "reps")
        .mapInArrow(_cut_out(length), "gram long, body long, n long, kinds long, bytes binary")
    )
    cut = settle(found, "cut")
    release(spark)
    several = bodies.where("times > 1").select(
        "gram", "body", F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("z"),
    )
    repeats = settle(_maximal(_repeats(cut, length, wide, levels).union(several)), "repeats")
    release(spark)
    hits = kept.join(repeats, ["gram", "body"]).where("z <= n")
    span = F.shiftleft((F.col("first") + F.col("a")).cast("long"), 32).bitwiseOR(
        F.col("first") + F.col("z") + F.lit(length - 1)
    )
    spans = settle(
        hits.select(*same, span.alias("span")).groupBy(*same).agg(F.collect_set("span").alias("spans")), "spans",
    )
    release(spark)
    joined = rows.select("doc_id", *keys, "text").join(spans, same, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(
        _finish, "doc_id long, n_bytes long, starts array<long>, stops array<long>, kept_sha256 string",
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate(F.zip_with("starts", "stops", lambda a, z: z - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256",
    )
