"""Exact dedup with counting quotient filters.

Each partition builds a counting quotient filter over 64-bit fingerprints of its
normalised texts and cuts it into blocks by the leading quotient bits. Blocks of
all partitions merge losslessly, since their remainders are sorted; fingerprints
with a count above one are routed to the byte check, all others are unique.

Defined results: null text counts as empty; empty texts are equal to each other;
a null doc_id loses ties against any other; repeated rows are members of one
group, of which one row stays; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_batches, settle, small_batches

_SPACE = b" \t\n\x0b\x0c\r"
_BLOCK_FINGERPRINTS = 1 << 16


class CountingQuotientFilter:
    """A multiset of 64-bit fingerprints: runs of sorted remainders by quotient, and counts.

    The quotient is implied by the run a remainder stands in, so a serialised
    filter holds run lengths, the remainders in whole bytes, and the counts.
    """

    def __init__(self, prints: np.ndarray, counts: np.ndarray):
        self.prints, self.counts = prints, counts

    @classmethod
    def build(cls, prints: np.ndarray) -> CountingQuotientFilter:
        found, counts = np.unique(prints.astype(np.uint64), return_counts=True)
        return cls(found, counts.astype(np.uint64))

    @classmethod
    def merge(cls, parts: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """The filter of the union; sorted remainders are merged and equal ones' counts summed."""
        prints = np.concatenate([p.prints for p in parts]) if parts else np.zeros(0, np.uint64)
        counts = np.concatenate([p.counts for p in parts]) if parts else np.zeros(0, np.uint64)
        order = np.argsort(prints, kind="stable")  # runs are sorted: a merge of runs
        prints, counts = prints[order], counts[order]
        if not len(prints):
            return cls(prints, counts)
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
        return cls(prints[first], np.add.reduceat(counts, first))

    def to_bytes(self, skip_bits: int) -> bytes:
        """skip_bits: leading bits that all fingerprints share (the block's number)."""
        n = len(self.prints)
        q = min(max(0, n.bit_length()), 64 - skip_bits)
        r = 64 - skip_bits - q
        low = self.prints & np.uint64((1 << (64 - skip_bits)) - 1 if skip_bits else 0xFFFFFFFFFFFFFFFF)
        quotient = (low >> np.uint64(r)).astype(np.int64) if r < 64 else np.zeros(n, np.int64)
        runs = np.bincount(quotient, minlength=1 << q).astype("<u4")
        width = -(-r // 8)
        remainders = low & np.uint64((1 << r) - 1) if r < 64 else low
        packed = remainders.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].tobytes()
        head = np.array([n, q, skip_bits], "<u4").tobytes()
        return head + runs.tobytes() + packed + self.counts.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, block: int) -> CountingQuotientFilter:
        n, q, skip = (int(x) for x in np.frombuffer(data, "<u4", 3))
        r = 64 - skip - q
        width = -(-r // 8)
        at = 12
        runs = np.frombuffer(data, "<u4", 1 << q, at)
        at += 4 << q
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        counts = np.frombuffer(data, "<u8", n, at).astype(np.uint64)
        quotient = np.repeat(np.arange(1 << q, dtype=np.uint64), runs)
        prints = wide.reshape(-1).view("<u8").astype(np.uint64)
        if r < 64:
            prints = prints | (quotient << np.uint64(r))
        if skip:
            prints = prints | np.uint64(block << (64 - skip))
        return cls(prints, counts)


def normalised(text: bytes) -> bytes:
    """text without the white space characters U+0020 and U+0009 to U+000D."""
    return text.translate(None, _SPACE)


def _scan(batches):
    for b in batches:
        texts = b.column(1).to_pylist()
        shas = [hashlib.sha256(normalised(t)).digest() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array(shas, pa.binary()), b.column(3)], ["doc_id", "n_cp", "sha", "row"],
        )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_cp, sha, row): code points of the text, SHA-256 of all bytes of the normalised text, a number of the row.

    The numbers hold once the rows are settled.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"),
        F.length(text).cast("long").alias("n_cp"), F.monotonically_increasing_id().alias("row"),
    )
    return cut.mapInArrow(_scan, "doc_id long, n_cp long, sha binary, row long")


def repeated_fingerprints(rows: DataFrame, n_rows: int) -> DataFrame:
    """Fingerprints (leading 8 bytes of sha) that occur more than once in rows."""
    bits = max(0, math.ceil(math.log2(max(1, n_rows) / _BLOCK_FINGERPRINTS)))

    def build(batches):
        parts = [np.frombuffer(b"".join(x[:8] for x in b.column(0).to_pylist()), ">u8") for b in batches]
        whole = CountingQuotientFilter.build(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
        if not len(whole.prints):
            return
        block = (
            whole.prints >> np.uint64(64 - bits)
        ).astype(np.int64) if bits else np.zeros(len(whole.prints), np.int64)
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        ends = np.r_[cut[1:], len(block)]
        out = [
            CountingQuotientFilter(whole.prints[a:b], whole.counts[a:b]).to_bytes(bits)
            for a, b in zip(cut, ends, strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[cut], pa.int64()), pa.array(out, pa.binary())], ["block", "filter"],
        )

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x, int(key[0])) for x in pdf["filter"]])
        return pd.DataFrame({"print": whole.prints[whole.counts > 1].view(np.int64)})

    return (
        rows.select("sha")
        .mapInArrow(build, "block long, filter binary")
        .groupBy("block")
        .applyInPandas(merge, "print long")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays,
    then the one with the smallest doc_id, then any one of equal rows. The byte check compares SHA-256 digests
    over all normalised bytes of the routed texts.
    """
    with own_batches(docs.sparkSession):
        rows = settle(digests(docs, id_col, text_col), "digests")
    routed = settle(repeated_fingerprints(rows, rows.count()), "routed")
    fingerprint = F.conv(F.hex(F.substring("sha", 1, 8)), 16, -10).cast("long")
    candidates = rows.withColumn("print", fingerprint).join(routed, "print", "left_semi")
    best = F.max(F.struct("n_cp", (-F.col("doc_id")).alias("neg"), (-F.col("row")).alias("neg_row"))).alias("best")
    # Settled, so that both sides of the join come straight from a shuffle, whose large partitions Spark can split.
    groups = settle(
        candidates.groupBy("sha").agg(best, F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups",
    )
    joined = rows.join(groups, "sha", "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(-F.col("best.neg"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | (F.col("row") == -F.col("best.neg_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id)
"""
