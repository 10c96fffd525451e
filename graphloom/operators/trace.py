"""Trace trees as rows with materialised paths.

node (trace, path array<int>, sig, class, line_start, line_end, leaf_kind, call_line): the root has an
empty path, a child its parent's path and its own position. leaf_kind is null for
expanded methods, else ref, cycle or filtered.
"""

from __future__ import annotations

from itertools import chain, count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.signatures import covers
from ..plans.storage import settle

KERNEL_ROWS = 200_000


def matches(cls: str, line: int = 0) -> Column:
    """line 0: any."""
    return (F.col("class") == cls) & covers(F.col("line_start"), F.col("line_end"), F.lit(line))


def find_subtree(nodes: DataFrame, hit: Column) -> DataFrame:
    """The subtree of each trace's first matching node in pre-order; paths are those of the whole tree."""
    top = nodes.where(hit).groupBy("trace").agg(F.min("path").alias("top"))
    return (
        nodes.join(top, "trace")
        .where(F.slice("path", 1, F.greatest(F.size("top"), F.lit(1))).eqNullSafe(F.col("top")) | (F.size("top") == 0))
        .drop("top")
    )


def prefixes(path: str = "path", whole: bool = True) -> Column:
    """All leading parts of a path, the empty one first; the path itself only if whole."""
    n = F.size(path) - (0 if whole else 1)
    return F.when(
        n >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(n, F.lit(0))),
            lambda i: F.when(i == 0, F.array().cast("array<int>")).otherwise(F.slice(path, 1, F.greatest(i, F.lit(1)))),
        ),
    )


def shallowest(nodes: DataFrame, hit: Column) -> DataFrame:
    """(trace, path) of matches without a match above them."""
    found = settle(nodes.where(hit).select("trace", "path"))
    above = found.select("trace", "path", F.explode(prefixes(whole=False)).alias("up"))
    under = (
        above.join(found.select("trace", F.col("path").alias("up")), ["trace", "up"], "left_semi")
        .select("trace", "path")
        .distinct()
    )
    return found.join(under, ["trace", "path"], "left_anti")


def prune_to_target(nodes: DataFrame, hit: Column) -> DataFrame:
    """Only the branches that lead to a match; a match loses what is below it."""
    ends = shallowest(nodes, hit)
    keep = ends.select("trace", F.explode(prefixes()).alias("path")).distinct()
    return nodes.join(keep, ["trace", "path"], "left_semi")


def inter_slice(nodes: DataFrame, start: Column | None = None, target: Column | None = None) -> DataFrame:
    """From the first match of start, to the matches of target, or both."""
    if start is None and target is None:
        raise ValueError("give start, target or both")
    out = nodes if start is None else find_subtree(nodes, start)
    return out if target is None else prune_to_target(out, target)


def referenced(nodes: DataFrame, bodies: DataFrame) -> DataFrame:
    """Bodies (sig, ...) that a ref leaf of nodes needs."""
    return bodies.join(nodes.where("leaf_kind = 'ref'").select("sig"), "sig", "left_semi")


def _body_index(body_children: DataFrame, bodies: DataFrame, limit: int) -> dict[str, list[tuple]] | None:
    """A body's children (rel, inner, child, leaf_kind, call_line) by signature; None if there are more than limit rows."""
    if not limit:
        return None
    known = bodies.select("sig").distinct().limit(limit + 1).toArrow()["sig"].to_pylist()
    rows = body_children.select("sig", "rel", "inner", "child", "leaf_kind", "call_line").limit(limit + 1).toArrow()
    if max(len(known), rows.num_rows) > limit:
        return None
    index: dict[str, list[tuple]] = {sig: [] for sig in known}
    for sig, *child in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        if sig in index:
            index[sig].append(tuple(child))
    return index


def _open_refs(sent, max_depth: int | None, schema: pa.Schema):
    """Rows (trace, path, sig, leaf_kind, call_line) below refs with the signatures above them, depth first."""

    def opened(trace, path, sig, kind, line, above):
        index, todo = sent.value, [(path, sig, kind, line, above, 0)]
        while todo:
            path, sig, kind, line, above, level = todo.pop()
            if kind != "ref" or sig not in index or sig in above or level == max_depth:
                yield trace, path, sig, kind, line
                continue
            yield trace, path, sig, None, line
            todo += [(path + rel, child, k, n, above + inner, level + 1) for rel, inner, child, k, n in index[sig]]

    def run(batches):
        for b in batches:
            rows = chain.from_iterable(opened(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
            while part := list(islice(rows, 10_000)):
                cols = zip(zip(*part, strict=True), schema, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in cols], schema=schema)

    return run


def expand_refs(
    nodes: DataFrame, body_children: DataFrame, bodies: DataFrame, max_depth: int | None = None,
    kernel_rows: int = KERNEL_ROWS,
) -> DataFrame:
    """nodes with each ref replaced by its method's body, unless that is missing or its signature stands above it already.

    As no signature is opened below itself, this ends; with a max_depth, what is closed after so many levels stays a ref.

    body_children (sig, pos, child, leaf_kind, call_line): the children of each method's body; bodies (sig). Where a
    body holds a whole subtree, rel (array<int>) and inner (signatures above, its own first) place its rows instead of pos.
    At most kernel_rows rows of bodies go to every task, where refs are opened to the end; more are joined level by level.
    """
    spark_cols = ["trace", "path", "sig", "leaf_kind", "call_line"]
    rows = nodes.select(*spark_cols)
    if "rel" not in body_children.columns:
        body_children = body_children.withColumn(
            "rel", F.array(F.col("pos").cast("int")),
        ).withColumn("inner", F.array("sig"))
    kept = rows.where("leaf_kind is null or leaf_kind <> 'ref'")
    # The signatures above a leaf; its own is not one of them.
    todo = (
        rows.where("leaf_kind = 'ref'")
        .join(_above(rows), ["trace", "path"], "left")
        .withColumn("above", F.coalesce("above", F.array().cast("array<string>")))
    )
    if (index := _body_index(body_children, bodies, kernel_rows)) is not None:
        sent = nodes.sparkSession.sparkContext.broadcast(index)
        types = {c: rows.schema[c].dataType.simpleString() for c in spark_cols}
        schema = T.DataType.fromDDL(", ".join(f"{c} {t}" for c, t in types.items()))
        opened = todo.select(*spark_cols, "above").mapInArrow(
            _open_refs(sent, max_depth, to_arrow_schema(schema)), schema,
        )
        return kept.union(opened)
    known = bodies.select("sig", F.lit(True).alias("known")).distinct()
    for level in count():
        todo = settle(todo)
        if todo.isEmpty():
            return kept
        if level == max_depth:
            return kept.union(todo.select(*spark_cols))
        todo = todo.join(known, "sig", "left")
        opens = F.coalesce("known", F.lit(False)) & ~F.array_contains("above", F.col("sig"))
        kept = kept.union(todo.where(~opens).select(*spark_cols)).union(
            todo.where(opens).select("trace", "path", "sig", F.lit(None).cast("string").alias("leaf_kind"), "call_line")
        )
        grown = todo.where(opens).join(
            body_children.select(
                "sig", "rel", "inner", "child", F.col("leaf_kind").alias("kind"), F.col("call_line").alias("line"),
            ),
            "sig",
        )
        place, above = F.concat("path", "rel").alias("path"), F.concat("above", "inner").alias("above")
        grown = settle(
            grown.select(
                "trace", place, F.col("child").alias("sig"), F.col("kind").alias("leaf_kind"),
                F.col("line").alias("call_line"), above,
            )
        )
        kept = kept.union(grown.where("leaf_kind is null or leaf_kind <> 'ref'").select(*spark_cols))
        todo = grown.where("leaf_kind = 'ref'")


def _above(rows: DataFrame) -> DataFrame:
    up = rows.select("trace", F.col("path").alias("up"), F.col("sig").alias("up_sig"))
    return (
        rows.select("trace", "path", F.explode(prefixes(whole=False)).alias("up"))
        .join(up, ["trace", "up"])
        .groupBy("trace", "path")
        .agg(F.collect_set("up_sig").alias("above"))
    )
