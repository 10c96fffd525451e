"""Structural checks of semantic graphs: a table of violations (kind, node_id, method, message).

sem_node (trace, method, id, kind), sem_edge (trace, method, src, dst, branch, kind), cluster_node (trace, method, id),
entry (trace, method, id), exc_edge (trace, method, dst), leaf_field (trace, method, field).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _violation(df: DataFrame, kind: str, node, message) -> DataFrame:
    return df.select("trace", F.lit(kind).alias("kind"), node.alias("node_id"), "method", message.alias("message"))


def _text(pattern: str, *cols):
    return F.format_string(pattern, *cols)


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    got = nodes.groupBy("trace", "method", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _violation(
        got, "duplicate_node_id", F.col("id"), _text("node id %s stands %d times", F.col("id"), F.col("n")),
    )


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends that are no node anywhere in the trace."""
    ends = edges.select(
        "trace", "method",
        F.explode(
            F.array(
                F.struct(F.col("src").alias("id"), F.lit("from").alias("side")),
                F.struct(F.col("dst").alias("id"), F.lit("to").alias("side")),
            )
        ).alias("e"),
    )
    got = ends.select("trace", "method", "e.id", "e.side").join(
        nodes.select("trace", "id").distinct(), ["trace", "id"], "left_anti",
    )
    return _violation(
        got, "dangling_edge_ref", F.col("id"), _text("edge names the missing node %s (%s)", F.col("id"), F.col("side")),
    )


def dangling_clusters(nodes: DataFrame, cluster_nodes: DataFrame) -> DataFrame:
    got = cluster_nodes.join(nodes.select("trace", "method", "id").distinct(), ["trace", "method", "id"], "left_anti")
    return _violation(got, "dangling_cluster_ref", F.col("id"), _text("cluster names the missing node %s", F.col("id")))


def invalid_entries(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    got = entries.where("id <> ''").join(
        nodes.select("trace", "method", "id").distinct(), ["trace", "method", "id"], "left_anti",
    )
    return _violation(got, "invalid_entry_node", F.col("id"), _text("entry %s is no node", F.col("id")))


def _outgoing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    flow = edges.where("kind is null or kind <> 'drilldown'").groupBy("trace", "method", F.col("src").alias("id"))
    out = flow.agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.coalesce("branch", F.lit("")))).alias("labels"),
    )
    return (
        nodes.join(out, ["trace", "method", "id"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    )


def branch_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Branch nodes without exactly one T and one F edge."""
    got = _outgoing(nodes, edges).where(
        (F.col("kind") == "branch") & (F.col("labels") != F.array(F.lit("F"), F.lit("T")))
    )
    return _violation(
        got, "branch_edge_violation", F.col("id"),
        _text("branch has edges [%s], not one T and one F", F.array_join("labels", ", ")),
    )


def plain_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Other nodes with more than one edge, or with a label."""
    out = _outgoing(nodes, edges).where("kind <> 'branch'")
    many = _violation(
        out.where("n > 1"), "non_branch_edge_violation", F.col("id"),
        _text("%d edges leave a node that doesn't branch", F.col("n")),
    )
    named = _violation(
        out.where(F.size(F.array_remove("labels", "")) > 0), "non_branch_edge_violation", F.col("id"),
        _text("an edge labelled %s leaves a node that doesn't branch", F.array_max("labels")),
    )
    return many.union(named)


def unreachable(nodes: DataFrame, edges: DataFrame, exceptions: DataFrame, entries: DataFrame) -> DataFrame:
    into = (
        edges.select("trace", "method", F.col("dst").alias("id"))
        .union(exceptions.select("trace", "method", F.col("dst").alias("id")))
        .union(entries.select("trace", "method", "id"))
    )
    got = nodes.join(into, ["trace", "method", "id"], "left_anti")
    return _violation(got, "no_incoming_edge", F.col("id"), _text("no edge leads to node %s", F.col("id")))


def leaf_fields(leaf_field: DataFrame) -> DataFrame:
    return _violation(leaf_field, "leaf_has_graph_fields", F.lit(""), _text("leaf has the field %s", F.col("field")))


def validate(
    nodes: DataFrame, edges: DataFrame, cluster_nodes: DataFrame, entries: DataFrame, exceptions: DataFrame,
    leaf_field: DataFrame | None = None,
) -> DataFrame:
    """All violations; an empty result is a valid graph."""
    parts = [
        duplicate_ids(nodes), dangling_edges(nodes, edges), dangling_clusters(nodes, cluster_nodes),
        invalid_entries(nodes, entries), branch_edges(nodes, edges), plain_edges(nodes, edges),
        unreachable(nodes, edges, exceptions, entries),
    ]
    return reduce(DataFrame.unionByName, parts + ([leaf_fields(leaf_field)] if leaf_field is not None else []))
