"""Inter-procedural control flow: callee bodies put in at call statements, up to a depth.

cfg_node (sig, node, ord), cfg_edge (sig, src, dst), invoke (sig, node, ord, callee). An
instance of a method is (sig, depth): one method met twice at a depth is one instance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signatures import source_symbol
from ..plans.storage import settle


def instances(
    invokes: DataFrame, bodies: DataFrame, root: str, depth: int = 3, stop: Column | None = None,
) -> DataFrame:
    """(sig, depth) of the methods that calls reach; stop, a condition on `callee`, keeps calls closed."""
    spark = invokes.sparkSession
    open_ = invokes.join(bodies.select(F.col("sig").alias("callee")).distinct(), "callee", "left_semi")
    open_ = open_.where(~stop) if stop is not None else open_
    open_ = settle(open_.select("sig", "callee").distinct())
    level = out = spark.createDataFrame([(root, 0)], "sig string, depth long")
    for d in range(1, depth + 1):
        level = (
            level.join(open_, "sig")
            .select(F.col("callee").alias("sig"), F.lit(d).cast("long").alias("depth"))
            .distinct()
        )
        out = out.union(level)
    return settle(out)


def icfg(
    nodes: DataFrame, edges: DataFrame, invokes: DataFrame, root: str, depth: int = 3, stop: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes (sig, depth, node), edges (src_sig, src_depth, src, dst_sig, dst_depth, dst, kind INTRA, CALL or RETURN)).

    A statement whose call is expanded loses its INTRA successors; they are reached by RETURN
    edges from the callee's exits. Every expanded call of a statement gets them.
    """
    bodies = nodes.select("sig").distinct()
    inst = instances(invokes, bodies, root, depth, stop)
    calls = invokes.join(inst, "sig").join(
        inst.select(F.col("sig").alias("callee"), (F.col("depth") - 1).alias("depth")), ["callee", "depth"],
        "left_semi",
    )
    calls = calls.where(~stop) if stop is not None else calls
    calls = calls.where(F.col("depth") < depth).select("sig", "depth", "node", "callee").distinct()
    entry = nodes.groupBy("sig").agg(F.min_by("node", "ord").alias("entry"))
    exits = nodes.select("sig", "node").join(
        edges.select("sig", F.col("src").alias("node")), ["sig", "node"], "left_anti",
    )
    flow = inst.join(edges, "sig")
    opened = calls.select("sig", "depth", F.col("node").alias("src")).distinct()
    intra = flow.join(opened, ["sig", "depth", "src"], "left_anti").select(
        F.col("sig").alias("src_sig"), F.col("depth").alias("src_depth"), "src", F.col("sig").alias("dst_sig"),
        F.col("depth").alias("dst_depth"), "dst", F.lit("INTRA").alias("kind"),
    )
    call = calls.join(entry.withColumnRenamed("sig", "callee"), "callee").select(
        F.col("sig").alias("src_sig"), F.col("depth").alias("src_depth"), F.col("node").alias("src"),
        F.col("callee").alias("dst_sig"), (F.col("depth") + 1).alias("dst_depth"), F.col("entry").alias("dst"),
        F.lit("CALL").alias("kind"),
    )
    back = calls.join(
        exits.select(F.col("sig").alias("callee"), F.col("node").alias("exit")), "callee",
    ).join(edges.select("sig", F.col("src").alias("node"), "dst"), ["sig", "node"])
    back = back.select(
        F.col("callee").alias("src_sig"), (F.col("depth") + 1).alias("src_depth"), F.col("exit").alias("src"),
        F.col("sig").alias("dst_sig"), F.col("depth").alias("dst_depth"), "dst", F.lit("RETURN").alias("kind"),
    )
    return inst.join(nodes, "sig").select("sig", "depth", "node"), intra.union(call).union(back).distinct()


def node_id(sig: str = "sig", depth: str = "depth", node: str = "node") -> Column:
    return F.concat_ws("_", F.col(depth).cast("string"), F.lower(F.hex(F.xxhash64(sig))), F.col(node).cast("string"))


def defined_calls(invokes: DataFrame, definitions: DataFrame) -> DataFrame:
    """invokes whose callee the index defines, by package/Class#method as an equi-join key, with file and lines."""
    keyed = invokes.withColumn("key", source_symbol(F.col("callee")))
    first = (
        definitions.where("key <> ''")
        .groupBy("key")
        .agg(F.min_by(F.struct("file", "line_start", "line_end"), "symbol").alias("d"))
    )
    return keyed.join(first, "key").select(*invokes.columns, "d.file", "d.line_start", "d.line_end")
