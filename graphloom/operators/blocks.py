"""Control-flow blocks: reachability, exception regions and slices inside methods.

block_edge (sig, src, dst, label), block (sig, block, ord), trap (sig, trap_idx, handler,
type), cover (sig, trap_idx, block, ord), handler_block (sig, trap_idx, block), line (sig, block, line).
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import settle
from . import reach


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("sig").alias("group"), "src", "dst")


def normal_flow(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(sig, block): what the entry blocks (sig, block) reach, they included."""
    seeds = entries.select(F.col("sig").alias("group"), F.lit(0).alias("seed"), F.col("block").alias("node"))
    return reach.grouped_closure(_edges(edges), seeds).select(F.col("group").alias("sig"), F.col("node").alias("block"))


def handler_regions(edges: DataFrame, traps: DataFrame, normal: DataFrame) -> DataFrame:
    """(sig, trap_idx, block): what a handler reaches without entering the normal flow; the handler itself in any case."""
    seeds = traps.select(F.col("sig").alias("group"), F.col("trap_idx").alias("seed"), F.col("handler").alias("node"))
    blocked = normal.select(F.col("sig").alias("group"), F.col("block").alias("node"))
    return reach.grouped_closure(_edges(edges), seeds, blocked).select(
        F.col("group").alias("sig"), F.col("seed").alias("trap_idx"), F.col("node").alias("block"),
    )


def fill_gaps(edges: DataFrame, cover: DataFrame, traps: DataFrame) -> DataFrame:
    """(sig, trap_idx, block): the covered blocks, those between them off the handlers, and entry blocks that flow into these.

    One pass over each method's edges, covered blocks and handlers.
    """
    sig, node, trap = edges.schema["sig"].dataType, edges.schema["src"].dataType, cover.schema["trap_idx"].dataType
    rows = edges.select("sig", F.lit(0).alias("kind"), "src", "dst", F.lit(None).cast(trap).alias("trap"))
    rows = rows.union(cover.select("sig", F.lit(1), "block", F.lit(None).cast(node), "trap_idx")).union(
        traps.select("sig", F.lit(2), "handler", F.lit(None).cast(node), F.lit(None).cast(trap))
    )

    def fill(_, kinds, a, b, of):
        ahead, back, entered, shut, seeds = defaultdict(list), defaultdict(list), set(), set(), defaultdict(set)
        for k, x, y, t in zip(kinds, a, b, of, strict=True):
            if k == 0:
                ahead[x].append(y)
                back[y].append(x)
                entered.add(y)
            elif k == 1:
                seeds[t].add(x)
            else:
                shut.add(x)
        first = [x for x in ahead if x not in entered and x not in shut]
        out = []
        for t, covered in seeds.items():
            full = covered | (reach.reached(ahead, covered, shut) & reach.reached(back, covered, shut)) - shut
            full |= {x for x in first if not full.isdisjoint(ahead[x])}
            out += [(t, x) for x in full]
        return out

    return reach.solve_groups(
        rows, "sig",
        T.StructType([T.StructField(n, t) for n, t in (("sig", sig), ("trap_idx", trap), ("block", node))]), fill,
    )


def inlined_handlers(traps: DataFrame, lines: DataFrame, assigned: DataFrame) -> DataFrame:
    """(sig, block, trap_idx): unassigned blocks whose lines, at least one, are all lines of a handler's first block; the first trap wins."""
    own = lines.where("line > 0").groupBy("sig", "block").agg(F.collect_set("line").alias("lines"))
    free = own.join(assigned.select("sig", "block").distinct(), ["sig", "block"], "left_anti")
    heads = traps.join(
        own.select("sig", F.col("block").alias("handler"), F.col("lines").alias("head")), ["sig", "handler"],
    )
    hit = free.join(heads, "sig").where("size(array_except(lines, head)) = 0")
    return hit.groupBy("sig", "block").agg(F.min("trap_idx").alias("trap_idx"))


def trap_table(throws: DataFrame) -> DataFrame:
    """(sig, handler, type, covered) from (sig, block, ord, handler, type): the covered blocks in block order."""
    got = throws.groupBy("sig", "handler", "type").agg(F.array_sort(F.collect_set(F.struct("ord", "block"))).alias("c"))
    return got.select("sig", "handler", "type", F.transform("c", lambda x: x["block"]).alias("covered"))


def assign_clusters(cover: DataFrame, handler_blocks: DataFrame) -> DataFrame:
    """(sig, block, role, trap_idx): a block that any trap handles is a handler block, else it is tried; the first trap wins."""
    tried = (
        cover.select("sig", "block", "trap_idx")
        .join(handler_blocks.select("sig", "block"), ["sig", "block"], "left_anti")
        .withColumn("role", F.lit("try"))
    )
    handled = handler_blocks.select("sig", "block", "trap_idx").withColumn("role", F.lit("handler"))
    return tried.union(handled).groupBy("sig", "block", "role").agg(F.min("trap_idx").alias("trap_idx"))


def between_lines(edges: DataFrame, lines: DataFrame, from_line: int, to_line: int) -> DataFrame:
    """(sig, block): blocks on a way from a block with from_line to one with to_line, in methods that have both."""
    seeds = lambda n: lines.where(F.col("line") == n).select(
        F.col("sig").alias("group"), F.lit(0).alias("seed"), F.col("block").alias("node"),
    )
    ahead = reach.grouped_closure(_edges(edges), seeds(from_line))
    back = reach.grouped_closure(
        _edges(edges).select("group", F.col("dst").alias("src"), F.col("src").alias("dst")), seeds(to_line),
    )
    return ahead.intersect(back).select(F.col("group").alias("sig"), F.col("node").alias("block"))


def slice_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose ends are both kept."""
    a = kept.select("sig", F.col("block").alias("src"))
    b = kept.select("sig", F.col("block").alias("dst"))
    return edges.join(a, ["sig", "src"], "left_semi").join(b, ["sig", "dst"], "left_semi")


def slice_traps(cover: DataFrame, handler_blocks: DataFrame, kept: DataFrame) -> DataFrame:
    """(sig, trap_idx): traps of which a covered or a handler block is kept."""
    both = cover.select("sig", "trap_idx", "block").union(handler_blocks.select("sig", "trap_idx", "block"))
    return both.join(kept, ["sig", "block"], "left_semi").select("sig", "trap_idx").distinct()


def kept_lines(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """(sig, line): the lines of kept blocks (sig, block), by which entries and callsites of a slice stay."""
    return lines.join(kept, ["sig", "block"], "left_semi").select("sig", "line").distinct()


def line_trace(edges: DataFrame, lines: DataFrame, from_line: int, to_line: int) -> DataFrame:
    """(sig, line, n): lines, with their statements' number, on the shortest ways from statements at from_line to those at to_line.

    Nodes are statements: edges (sig, src, dst), lines (sig, block, line). In each method the ways follow the
    parents of a breadth-first search from to_line against the edges.
    """
    kind = edges.schema["src"].dataType
    rows = edges.select("sig", F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
    rows = rows.union(lines.select("sig", F.lit(1), F.col("block"), F.col("line").cast(kind)))

    def trace(_, kinds, a, b):
        line = {x: y for k, x, y in zip(kinds, a, b, strict=True) if k == 1}
        back = defaultdict(list)
        for x, y in sorted((x, y) for k, x, y in zip(kinds, a, b, strict=True) if k == 0):
            back[y].append(x)
        goal = sorted(s for s, n in line.items() if n == to_line)
        parent, todo = dict.fromkeys(goal), list(goal)
        for s in todo:
            for p in back.get(s, ()):
                if p not in parent:
                    parent[p] = s
                    todo.append(p)
        kept = set()
        for s in (s for s, n in line.items() if n == from_line and s in parent):
            while s is not None and s not in kept:
                kept.add(s)
                s = parent[s]
        return list(Counter(line[s] for s in kept if s in line).items())

    return reach.solve_groups(
        rows, "sig", f"sig {edges.schema['sig'].dataType.simpleString()}, line long, n long", trace,
    )


# From statements of an intermediate form to blocks: ir (sig, block, ord, line, text, lhs, rhs, call_target,
# returns_boolean, arg_count, condition, is_switch); call_target is `package.Class.method`.


def statement_details(ir: DataFrame) -> DataFrame:
    """(sig, block, ord, line, text, call_target, arg_count, branch)"""
    branch = F.coalesce("condition", F.when(F.col("is_switch"), "switch"))
    return ir.select(
        "sig", "block", "ord", F.coalesce("line", F.lit(-1)).alias("line"), "text", "call_target", "arg_count",
        branch.alias("branch"),
    )


def project_statements(ir: DataFrame) -> DataFrame:
    """(sig, block, ord, line, call, branch, assign): a call wins over an assignment; assignments of temporaries and fields go."""
    plain = ~F.col("rhs").contains("$stack") & ~F.col("rhs").contains(".<") & ~F.col("lhs").startswith("$stack")
    assign = F.when(
        F.col("call_target").isNull() & F.col("lhs").isNotNull() & plain, F.concat("lhs", F.lit(" = "), "rhs"),
    )
    return (
        statement_details(ir)
        .join(ir.select("sig", "block", "ord", assign.alias("assign")), ["sig", "block", "ord"])
        .select("sig", "block", "ord", "line", F.col("call_target").alias("call"), "branch", "assign")
    )


def branch_conditions(ir: DataFrame) -> DataFrame:
    """(sig, block, condition) of blocks that end in a branch, temporaries replaced by what the block puts into them.

    A temporary becomes Class.method() or its right side; comparisons of a boolean call with 0 become true or false.
    """
    short = F.concat(F.substring_index("call_target", ".", -2), F.lit("()"))
    step = F.struct(
        "ord", "lhs", F.when(F.col("call_target").isNotNull(), short).otherwise(F.col("rhs")).alias("value"),
        (F.col("call_target").isNotNull() & F.coalesce("returns_boolean", F.lit(False))).alias("boolean"),
    )
    temps = F.array_sort(F.collect_list(F.when(F.col("lhs").startswith("$stack"), step)))
    tail = F.max_by(F.struct("condition", "is_switch"), "ord")
    got = ir.groupBy("sig", "block").agg(temps.alias("temps"), tail.alias("tail"))

    def put(text, x):
        out = F.replace(text, x["lhs"], x["value"])
        truth = F.replace(
            F.replace(out, F.concat(x["value"], F.lit(" == 0")), F.concat(x["value"], F.lit(" == false"))),
            F.concat(x["value"], F.lit(" != 0")), F.concat(x["value"], F.lit(" == true")),
        )
        return F.when(~text.contains(x["lhs"]), text).when(x["boolean"], truth).otherwise(out)

    condition = F.when(
        F.col("tail.condition").isNotNull(), F.aggregate("temps", F.col("tail.condition"), put),
    ).when(F.col("tail.is_switch"), "switch")
    return got.select("sig", "block", condition.alias("condition")).where("condition is not null")


def labelled_edges(successors: DataFrame, ir: DataFrame) -> DataFrame:
    """(sig, src, dst, label) of successors (sig, block, pos, succ): T and F where a block ends in an if with two successors."""
    ends = ir.groupBy("sig", "block").agg(F.max_by("condition", "ord").isNotNull().alias("is_if"))
    n = F.count(F.lit(1)).over(Window.partitionBy("sig", "block"))
    rows = successors.withColumn("n", n).join(ends, ["sig", "block"], "left")
    label = F.when(F.col("is_if") & (F.col("n") == 2), F.when(F.col("pos") == 0, "T").otherwise("F"))
    return rows.select("sig", F.col("block").alias("src"), F.col("succ").alias("dst"), label.alias("label"))


def number_blocks(ir: DataFrame) -> DataFrame:
    """(sig, block, id, block_ord): blocks as B0, B1, ... in order of their first statement."""
    first = ir.groupBy("sig", "block").agg(F.min("ord").alias("first"))
    n = F.row_number().over(Window.partitionBy("sig").orderBy("first", "block")) - 1
    return first.select(
        "sig", "block", F.concat(F.lit("B"), n.cast("string")).alias("id"), n.cast("long").alias("block_ord"),
    )


def block_trace(ir: DataFrame, successors: DataFrame, throws: DataFrame) -> dict[str, DataFrame]:
    """block, stmt, block_edge, trap, cover and handler_block of methods, blocks by their numbers.

    ir as above; successors (sig, block, pos, succ): normal flow; throws (sig, block, handler, type): what a block may
    throw to. Traps stand in the order in which their first covered block comes.
    """
    names = settle(number_blocks(ir))
    as_id = lambda df, c: df.join(
        names.select("sig", F.col("block").alias(c), F.col("id").alias(f"{c}_id")), ["sig", c],
    ).drop(c).withColumnRenamed(f"{c}_id", c)
    rows = settle(
        as_id(ir, "block").join(names.select("sig", F.col("id").alias("block"), "block_ord"), ["sig", "block"])
    )
    edges = settle(labelled_edges(as_id(as_id(successors, "block"), "succ"), rows))
    order = names.select("sig", F.col("id").alias("block"), "block_ord")
    thrown = settle(
        as_id(as_id(throws, "block"), "handler").join(order, ["sig", "block"]).select(
            "sig", "block", F.col("block_ord").alias("ord"), "handler", "type",
        )
    )
    first = thrown.groupBy("sig", "handler", "type").agg(F.min("ord").alias("first"))
    number = F.row_number().over(Window.partitionBy("sig").orderBy("first", "handler", "type")) - 1
    traps = settle(first.select("sig", number.cast("long").alias("trap_idx"), "handler", "type"))
    listed = trap_table(thrown).join(traps, ["sig", "handler", "type"])
    normal = normal_flow(edges, order.where("block_ord = 0").select("sig", "block"))
    regions = handler_regions(edges, traps, normal)
    covered = fill_gaps(edges, listed.select("sig", "trap_idx", F.explode("covered").alias("block")), traps)
    covered = settle(
        covered.join(order, ["sig", "block"]).select("sig", "trap_idx", "block", F.col("block_ord").alias("ord"))
    )
    stmts = project_statements(rows).join(order, ["sig", "block"])
    inlined = inlined_handlers(
        traps, stmts.select("sig", "block", "line"),
        covered.select("sig", "block").union(regions.select("sig", "block")),
    )
    conditions = branch_conditions(rows)
    return {
        "block": order.join(conditions, ["sig", "block"], "left"),
        "stmt": stmts,
        "block_edge": edges,
        "trap": traps,
        "cover": covered,
        "handler_block": regions.unionByName(inlined.select("sig", "trap_idx", "block")),
    }
