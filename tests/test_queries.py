import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import queries
from graphloom.sources.facts import TABLES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def rows(df):
    return sorted(
        repr(tuple(str(x) for x in r))
        for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False)
    )


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, con, name):
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), con.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in want.columns:
        if str(want[c].dtype).startswith(("float", "Int", "int")) or str(got[c].dtype).startswith(("float", "int")):
            got[c], want[c] = got[c].astype("Float64").astype(object), want[c].astype("Float64").astype(object)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_others_run(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["src", "dst", "call_line", "filtered"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())


def test_expand_refs_opens_customers_without_orders(spark, con, tmp_path):
    """Their bodies are empty, not missing."""
    for t in TABLES:
        keep = "WHERE o_custkey NOT IN (SELECT min(c_custkey) FROM customer)" if t == "orders" else ""
        con.execute(f"copy (select * from {t} {keep}) to '{tmp_path}/{t}.parquet' (format parquet)")
    apart = duckdb.connect()
    for t in TABLES:
        apart.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got, want = queries.QUERIES["expand_refs"](spark, str(tmp_path)).toPandas(), apart.sql(queries.SQL["expand_refs"]).df()
    assert rows(got) == rows(want)
    leaf = want["sig"].str.startswith("c") & ~want["is_ref"].astype(bool)
    assert leaf.any()
