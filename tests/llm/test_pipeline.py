import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from graphloom.llm import registry

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = first = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        if name != "token output":
            assert docs.columns == first.columns
            docs = corpus_pipeline.settle(docs, "stage")
        counts.append(docs.count())
    assert counts[1] <= counts[0] and counts[2] < counts[1] and counts[3] < counts[2] and counts[4] == counts[5]
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_decisions_take_effect(spark):
    """The stages drop just what their operators mark."""
    from graphloom.llm import decontaminate, simhash_dedup

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    marked = decontaminate.decontaminate(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, SMALL).collect()}
    assert kept == {r["id"] for r in marked.where("not contaminated").collect()}
    groups = simhash_dedup.simhash_dedup(docs).collect()
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()}
    assert kept == {r["component_id"] for r in groups}


def test_rows_without_or_with_repeated_ids_stay(spark):
    """And columns that operators use inside, and empty tables."""
    from tests.llm.conftest import words

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = [(None, words(1, 80)), (None, words(2, 80)), (0, words(3, 80)), (0, words(3, 80)), (None, words(1, 80))]
    new = spark.createDataFrame(
        [(i, t, "en", "src0", len(t)) for i, t in more],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])
    extra = ["key", "row", "times", "member", "print", "label", "taken", "turn", "c", "size"]
    every = docs.union(new).withColumns({c: F.lit(c) for c in extra})
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, every, SMALL)
        assert got.columns == every.columns
        kept = {r["text"] for r in got.select("text").collect()}
        assert {t for _, t in more} <= kept, name
    got = corpus_pipeline.drop_near_duplicates(spark, every, SMALL).where(F.col("text") == more[2][1]).count()
    assert got == 1
    mixed = corpus_pipeline.mix_sources(spark, every, SMALL)
    assert mixed.columns == every.columns and mixed.groupBy(
        "doc_id", "text",
    ).count().agg(F.max("count")).first()[0] <= 4
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, every.limit(0), SMALL).collect() == []


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.sql(registry.SQL[name]).df()
    got = registry.QUERIES[name](spark, SMALL).toPandas()[list(want.columns)]
    order = ["doc_id"]
    assert got.sort_values(order).reset_index(drop=True).astype(str).equals(
        want.sort_values(order).reset_index(drop=True).astype(str)
    )


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_give_one_row_each(spark, name):
    rows = registry.QUERIES[name](spark, SMALL)
    table = "pages" if name.startswith("op4_") else "documents"
    assert rows.count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()
