"""Helpers that the training-data operators share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import drop_path, fresh_path, release
from ..plans.storage import settle as _settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, what: str = "settled") -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    Later stages then survive lost executors without recomputing what came before.
    """
    return _settle(df, what, compression="zstd")


def discard(df: DataFrame) -> None:
    """Delete what settle() wrote, once nothing will read it again."""
    drop_path(df.sparkSession, df.settled_at)
    release(df.sparkSession)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def batch_rows(spark: SparkSession, rows: int) -> None:
    """How many rows the next steps hand to Python at once."""
    spark.conf.set(_BATCH, str(rows))


@contextmanager
def own_batches(spark: SparkSession):
    """What an operator sets inside holds inside: for operators whose results hand no more texts to Python."""
    before = spark.conf.get(_BATCH, None)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most `rows` rows at once: a batch stands in memory several times, and texts are long."""
    if not 0 < int(spark.conf.get(_BATCH, "10000")) <= rows:
        batch_rows(spark, rows)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under fixed names; other columns can't clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_mod(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def held_out(id_col: str, n: int, rest: int):
    """Whether crc_mod is `rest`; false for a null id."""
    return F.coalesce(crc_mod(id_col, n) == rest, F.lit(False)).alias("held_out")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, root), root the smallest node of the component.

    Alternating large-star and small-star steps; each round only sends a node's
    neighbours past their minimum, and the edges are settled in the shared folder.
    A node that many edges meet is pre-aggregated by min() before each shuffle. Rounds
    go on until one changes nothing; their number grows with the logarithm of the nodes.
    """
    spark = edges.sparkSession
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    cur = settle(cur, "edges")
    before = None
    while True:
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of u links to u's minimum.
        large = (
            both.where("v > u")
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # Small star: u and its smaller neighbours link to the smallest of them.
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .union(low2.select("u", F.col("m").alias("v")))
            .distinct()
        )
        cur = settle(small, "edges")
        now = cur.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
