"""The corpus pipeline: documents to packed token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one
reads it; all but the last return the columns of documents. Rows are told apart by id
and text together, so null and repeated ids do no harm; rows equal in both count as
one document in near-dedup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, mixing, simhash_dedup, token_output, toxicity
from graphloom.llm.common import settle, table

#: Columns that the stages add and take away again.
_KEY, _MEMBER, _TIMES = "_graphloom_key", "_graphloom_member", "_graphloom_times"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays."""
    rows = docs.withColumn(_KEY, decontaminate.row_key(F.col("doc_id"), F.col("text")))
    stay = simhash_dedup.survivors(rows, _KEY).withColumnRenamed("key", _KEY)
    return rows.join(stay, _KEY, "left_semi").dropDuplicates([_KEY]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window stay."""
    found = decontaminate.contaminated_keys(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found, decontaminate.row_key(docs["doc_id"], docs["text"]) == found["key"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the copy that the budget cuts off is taken if most of it is served."""
    schedule, sized = mixing.mix(docs)
    served = (
        schedule.groupBy("key", "member")
        .agg(F.sum("taken").alias("taken"))
        .join(sized.select("key", "size", "c"), "key")
    )
    times = served.select(
        F.col("key").alias(_KEY), F.col("member").alias(_MEMBER), "c",
        F.round(F.col("taken") / F.col("size")).cast("int").alias(_TIMES),
    ).where(F.col(_TIMES) > 0)
    rows = docs.withColumn(_KEY, mixing.group_key(F.col("doc_id"), F.col("source"), F.col("text")))
    alone = rows.join(times.where("c = 1").select(_KEY, _TIMES), _KEY)
    # Equal rows are numbered, as the mix serves them one behind the other.
    many = times.where("c > 1").select(_KEY, _MEMBER, _TIMES)
    order = Window.partitionBy(_KEY).orderBy(*[c for c in docs.columns if c != "text"])
    several = (
        rows.join(many.select(_KEY).distinct(), _KEY, "left_semi")
        .withColumn(_MEMBER, F.row_number().over(order) - 1)
        .join(many, [_KEY, _MEMBER])
    )
    taken = alone.select(*docs.columns, _TIMES).union(several.select(*docs.columns, _TIMES))
    return taken.withColumn(_TIMES, F.explode(F.sequence(F.lit(1), _TIMES))).select(docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the written files."""
    return token_output.token_output(docs, token_output.default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mix sources", mix_sources),
    ("token output", pack_tokens),
]

#: SQL can't express the learned lexicon, SimHash or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
