"""Reachability, components and path enumeration over edge tables.

`closure` is semi-naive: each level joins the new nodes with the edges and drops what
is known. Many roots run together. Two physical forms give the same rows:

* `loop`: one join a level, each level settled in the shared folder; for any size.
* `kernel`: the edges, if they are few (their number is checked), go to every task as
  adjacency arrays and each root is searched there; roots are dealt over the tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.storage import discard, release, settle

KERNEL_EDGES = 2_000_000


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


@dataclass
class Adjacency:
    """Adjacency arrays: the successors of node i are dst[start[i] : start[i + 1]]."""

    names: pa.Array
    start: np.ndarray
    dst: np.ndarray = field(repr=False)

    @cached_property
    def number(self) -> dict:
        return {name: i for i, name in enumerate(self.names.to_pylist())}

    def depths(self, starts: list[int], max_depth: int | None) -> np.ndarray:
        """The level at which each node is reached from starts; -1: never."""
        level = np.full(len(self.names), -1, np.int64)
        front, d = np.unique(np.array(starts, np.int64)), 0
        level[front] = 0
        while len(front) and (max_depth is None or d < max_depth):
            d += 1
            n = self.start[front + 1] - self.start[front]
            at = np.repeat(self.start[front] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            new = self.dst[at]
            front = np.unique(new[level[new] < 0])
            level[front] = d
        return level


def adjacency(links: DataFrame, limit: int) -> Adjacency | None:
    """Of distinct edges (src, dst); None if there are more than limit."""
    got = links.select("src", "dst").limit(limit + 1).toArrow()
    if got.num_rows > limit:
        return None
    ends = (
        pa.chunked_array([*got["src"].chunks, *got["dst"].chunks], got.schema.field("src").type)
        .combine_chunks()
        .dictionary_encode()
    )
    ids = ends.indices.to_numpy().astype(np.int64)
    src, dst = ids[: got.num_rows], ids[got.num_rows :]
    order = np.lexsort((dst, src))
    return Adjacency(ends.dictionary, np.searchsorted(src[order], np.arange(len(ends.dictionary) + 1)), dst[order])


def closure(
    edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, expand: Column | None = None,
    kernel_edges: int = KERNEL_EDGES,
) -> DataFrame:
    """(root, node, depth) of all nodes that seeds (root, node) reach over edges (src, dst), the seeds at depth 0.

    expand: a condition on `node`; nodes that fail it are kept but not expanded.
    """
    links = edges.select("src", "dst").where("src is not null and dst is not null")
    if expand is not None:
        links = links.withColumn("node", F.col("src")).where(expand).drop("node")
    links = links.distinct()
    near = adjacency(links, kernel_edges) if kernel_edges else None
    seeds = seeds.select("root", "node").distinct()
    if near is None:
        return _loop(links, seeds, max_depth)
    sent = seeds.sparkSession.sparkContext.broadcast(near)
    schema = T.StructType([seeds.schema["root"], seeds.schema["node"], T.StructField("depth", T.LongType())])
    arrow = to_arrow_schema(schema)

    def search(key, table):
        near, nodes = sent.value, table.column("node").to_pylist()
        starts = [near.number[n] for n in nodes if n in near.number]
        level = near.depths(starts, max_depth)
        found = np.flatnonzero(level >= 0)
        apart = [n for n in nodes if n not in near.number]  # without an edge
        names = pa.concat_arrays(
            [near.names.take(pa.array(found)).cast(arrow.field("node").type), pa.array(apart, arrow.field("node").type)]
        )
        root = pa.repeat(key[0], len(names)).cast(arrow.field("root").type)
        return pa.Table.from_arrays(
            [root, names, pa.array(np.r_[level[found], np.zeros(len(apart), np.int64)])], schema=arrow,
        )

    return seeds.groupBy("root").applyInArrow(search, schema)


def _loop(links: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    spark = links.sparkSession
    links = settle(links, compression="zstd")
    release(spark)
    seen = level = settle(seeds.withColumn("depth", F.lit(0).cast("long")))
    d = 0
    while max_depth is None or d < max_depth:
        d += 1
        new = level.join(links, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        new = settle(new.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(d).cast("long")))
        if new.isEmpty():
            break
        seen, level = seen.union(new), new
        release(spark)
    discard(links)
    release(spark)
    return seen


def solve_groups(rows: DataFrame, key: str, schema: T.StructType | str, fn: Callable[..., list[tuple]]) -> DataFrame:
    """fn(key, columns) for each key's rows, columns without the key as lists; it gives tuples without the key.

    A key's rows are solved in one task, so groups should be bounded, such as one method's body.
    Rows stream through sorted, whole batches at once.
    """
    schema = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    rest = [c for c in rows.columns if c != key]

    def emit(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def run(batches):
        held: list[list] | None = None
        name = None
        for b in batches:
            if not b.num_rows:
                continue
            keys, cols, out, at = b.column(0).to_pylist(), [
                b.column(i + 1).to_pylist()
                for i in range(len(rest))
            ], [], 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                part = [c[at:end] for c in cols]
                if held is not None and name == keys[at]:
                    held = [x + y for x, y in zip(held, part, strict=True)]
                else:
                    if held is not None:
                        out += [(name, *r) for r in fn(name, *held)]
                    name, held = keys[at], part
                at = end
            if out:
                yield emit(out)
        if held is not None:
            yield emit([(name, *r) for r in fn(name, *held)])

    return rows.select(key, *rest).repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def reached(near: dict, starts, shut=frozenset()) -> set:
    """What starts lead to over near, they included; nodes of shut are never entered, but may be starts."""
    known, todo = set(starts), list(starts)
    while todo:
        for v in near.get(todo.pop(), ()):
            if v not in known and v not in shut:
                known.add(v)
                todo.append(v)
    return known


def grouped_closure(edges: DataFrame, seeds: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(group, seed, node): reachability inside many small graphs, such as one for each method.

    edges (group, src, dst), seeds (group, seed, node), blocked (group, node): never entered; seeds themselves may be.
    """
    types = {
        "group": edges.schema["group"].dataType, "seed": seeds.schema["seed"].dataType,
        "node": edges.schema["src"].dataType,
    }
    null = lambda k: F.lit(None).cast(types[k])
    rows = edges.select("group", F.lit(0).alias("kind"), "src", "dst", null("seed").alias("seed"))
    rows = rows.union(seeds.select("group", F.lit(1), F.col("node"), null("node"), "seed"))
    if blocked is not None:
        rows = rows.union(blocked.select("group", F.lit(2), F.col("node"), null("node"), null("seed")))

    def search(_, kinds, a, b, seed):
        near, shut, starts = defaultdict(list), set(), defaultdict(list)
        for k, x, y, s in zip(kinds, a, b, seed, strict=True):
            if k == 0:
                near[x].append(y)
            elif k == 1:
                starts[s].append(x)
            else:
                shut.add(x)
        return [(s, n) for s, nodes in starts.items() for n in reached(near, nodes, shut)]

    return solve_groups(rows, "group", T.StructType([T.StructField(k, t) for k, t in types.items()]), search)


def paths(
    edges: DataFrame, starts: DataFrame, ends: Column, max_length: int | None = 50, least: int = 2,
    left: DataFrame | None = None,
) -> DataFrame:
    """(path, ord_path) of all simple paths from starts (node) to nodes where `ends` holds; a path ends at its first such node and has `least` nodes or more.

    edges (src, dst, ord). ends is a condition on `node`. Order by path[0] and ord_path for depth-first order.
    left (node, depth): how far a node is from an end, at least; paths that would get too long are given up at
    once. The edges should hold only what lies between starts and ends: see `between`. max_length None: any.
    """
    spark = edges.sparkSession
    steps = edges.select("src", "dst", F.col("ord").cast("long").alias("ord"))
    if left is not None:
        steps = steps.join(left.select(F.col("node").alias("dst"), F.col("depth").alias("left")), "dst")
    else:
        steps = steps.withColumn("left", F.lit(0).cast("long"))
    steps = settle(steps.select("src", "dst", "ord", "left"))
    live = (
        starts.select("node")
        .distinct()
        .select("node", F.array("node").alias("path"), F.array().cast("array<long>").alias("ord_path"))
    )
    done, n = None, 0
    while True:
        n += 1
        live = settle(live)
        if n >= least:
            hit = live.where(ends).select("path", "ord_path")
            done = hit if done is None else done.union(hit)
            live = live.where(~ends)
        if n == max_length or live.isEmpty():
            break
        live = live.join(steps, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        if max_length is not None:
            live = live.where(F.lit(n + 1) + F.col("left") <= max_length)
        live = live.select(
            F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"),
            F.concat("ord_path", F.array("ord")).alias("ord_path"),
        )
    return done if done is not None else spark.createDataFrame([], "path array<string>, ord_path array<long>")


def between(edges: DataFrame, forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Edges whose ends both lie in forward and backward (node)."""
    both = forward.select("node").intersect(backward.select("node"))
    kept = edges.join(both.withColumnRenamed("node", "src"), "src", "left_semi")
    return kept.join(both.withColumnRenamed("node", "dst"), "dst", "left_semi")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge leads to."""
    return nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def ordered_walk(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, src, dst, ord, cycle): every edge of every expanded node; cycle: dst is on the walk's current path.

    seeds (root, node), one node a root. The walk is depth first in order of ord and expands a node once, so the flag
    depends on that order, and no way is known to find it in parallel: a root is walked in one task over the numbered
    nodes of its closure, 8 bytes an edge. Only edges of that closure are sent.
    """
    nodes = closure(edges, seeds).select("root", F.col("node").alias("src"))
    node, root = seeds.schema["node"], seeds.schema["root"]
    steps = nodes.join(edges.select("src", "dst", "ord"), "src")
    first = seeds.select(
        "root", F.col("node").alias("src"), F.lit(None).cast(node.dataType).alias("dst"),
        F.lit(None).cast("long").alias("ord"),
    )
    rows = (
        first.union(steps.select("root", "src", "dst", F.col("ord").cast("long")))
        .repartition("root")
        .sortWithinPartitions("root", F.col("dst").isNotNull(), "src", "ord", "dst")
    )
    schema = T.StructType(
        [
            root, T.StructField("src", node.dataType), T.StructField("dst", node.dataType),
            T.StructField("ord", T.LongType()), T.StructField("cycle", T.BooleanType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def one(name, start, number: dict, src: list[np.ndarray], dst: list[np.ndarray]):
        if not src:
            return
        s, d = np.concatenate(src), np.concatenate(dst)
        by = np.argsort(s, kind="stable")  # a node's edges stay in order
        s, d = s[by], d[by]
        begin = np.searchsorted(s, np.arange(len(number) + 1))
        flag = np.zeros(len(d), bool)
        seen, on_path = np.zeros(len(number), bool), np.zeros(len(number), bool)
        seen[start] = on_path[start] = True
        stack = [[start, int(begin[start]), int(begin[start + 1])]]
        while stack:
            top = stack[-1]
            u, i, end = top
            if i == end:
                on_path[u] = False
                stack.pop()
                continue
            top[1] = i + 1
            v = int(d[i])
            flag[i] = on_path[v]
            if not seen[v]:
                seen[v] = on_path[v] = True
                stack.append([v, int(begin[v]), int(begin[v + 1])])
        names = pa.array(list(number), arrow.field("src").type)
        for at in range(0, len(d), 100_000):
            z = min(at + 100_000, len(d))
            place = np.arange(at, z) - begin[s[at:z]] + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (z - at), arrow.field("root").type), names.take(pa.array(s[at:z])),
                    names.take(pa.array(d[at:z])), pa.array(place.astype(np.int64)), pa.array(flag[at:z]),
                ],
                schema=arrow,
            )

    def run(batches):
        name, start, number, src, dst, any_ = None, 0, {}, [], [], False
        for b in batches:
            keys = b.column(0).to_pylist()
            froms, tos = b.column(1).to_pylist(), b.column(2).to_pylist()
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if not any_ or keys[at] != name:
                    if any_:
                        yield from one(name, start, number, src, dst)
                    name, number, src, dst, any_ = keys[at], {}, [], [], True
                    start = number.setdefault(froms[at], 0)
                real = [(x, y) for x, y in zip(froms[at:end], tos[at:end], strict=True) if y is not None]
                if real:
                    src.append(np.array([number.setdefault(x, len(number)) for x, _ in real], np.int32))
                    dst.append(np.array([number.setdefault(y, len(number)) for _, y in real], np.int32))
                at = end
        if any_:
            yield from one(name, start, number, src, dst)

    return rows.mapInArrow(run, schema)


def strong_components(near: Adjacency) -> np.ndarray:
    """The number of each node's strongly connected component; two visits of a depth-first stack, without recursion."""
    n = len(near.names)
    order, low, comp = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    start, dst = near.start.tolist(), near.dst.tolist()
    order, low, comp = order.tolist(), low.tolist(), comp.tolist()
    count, parts, open_ = 0, 0, []
    for s in range(n):
        if order[s]:
            continue
        todo = [(s, start[s])]
        while todo:
            u, i = todo.pop()
            if not order[u]:
                count += 1
                order[u] = low[u] = count
                open_.append(u)
            while i < start[u + 1]:
                v = dst[i]
                i += 1
                if not order[v]:
                    todo += [(u, i), (v, start[v])]
                    break
                if comp[v] < 0:
                    low[u] = min(low[u], low[v])
            else:
                if low[u] == order[u]:
                    while True:
                        v = open_.pop()
                        comp[v] = parts
                        if v == u:
                            break
                    parts += 1
                if todo:
                    p = todo[-1][0]
                    low[p] = min(low[p], low[u])
    return np.array(comp, np.int64)


def components_by_colour(links: DataFrame) -> DataFrame:
    """(node, component) of nodes on cycles, at any size.

    Nodes without a way in or out are trimmed; the others take the largest node that reaches them as colour; a node
    of its own colour and what leads to it inside the colour are a component. Repeated on the rest.
    """
    live, found = settle(links.where("src <> dst").select("src", "dst").distinct()), None
    while True:
        n = live.count()
        while n:
            ends = live.select(F.col("src").alias("node")).intersect(live.select("dst"))
            kept = settle(
                live.join(
                    ends.withColumnRenamed("node", "src"), "src", "left_semi",
                ).join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
            )
            discard(live)
            live, m = kept, kept.count()
            if m == n:
                break
            n = m
        if not n:
            return found if found is not None else links.select(
                F.col("src").alias("node"), F.col("src").alias("component"),
            ).limit(0)
        colour = settle(live.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            sent = (
                live.join(colour.withColumnRenamed("node", "src"), "src")
                .groupBy(F.col("dst").alias("node"))
                .agg(F.max("colour").alias("c"))
            )
            new = settle(
                colour.join(sent, "node", "left").select(
                    "node", F.greatest("colour", "c").alias("colour"), (F.col("c") > F.col("colour")).alias("changed"),
                )
            )
            discard(colour)
            colour = new.select("node", "colour")
            colour.settled_at = new.settled_at
            if new.where("changed").isEmpty():
                break
        same = (
            live.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src")
            .join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
            .where("a = b")
        )
        own = colour.where("node = colour").select(F.col("node").alias("root"), "node")
        part = settle(
            _loop(
                same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), own, None,
            ).select("node", F.col("root").alias("component"))
        )
        found = part if found is None else found.union(part)
        rest = live.join(
            part.select(F.col("node").alias("src")), "src", "left_anti",
        ).join(part.select(F.col("node").alias("dst")), "dst", "left_anti")
        live = settle(rest.select("src", "dst"))


def in_component(edges: DataFrame, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(src, dst, in_scc): whether dst leads back to src."""
    links = edges.select("src", "dst").distinct()
    near = adjacency(links, kernel_edges) if kernel_edges else None
    if near is None:
        comp = components_by_colour(links)
    else:
        table = pa.Table.from_arrays([near.names, pa.array(strong_components(near))], ["node", "component"])
        comp = edges.sparkSession.createDataFrame(table)
    a, b = (comp.select(F.col("node").alias(k), F.col("component").alias(c)) for k, c in (("src", "a"), ("dst", "b")))
    hit = links.join(a, "src", "left").join(b, "dst", "left")
    return hit.select(
        "src", "dst",
        (F.coalesce(F.col("a") == F.col("b"), F.lit(False)) | (F.col("src") == F.col("dst"))).alias("in_scc"),
    )
