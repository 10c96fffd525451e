"""Call graphs from methods, invocations and class relations.

Tables: method (sig, class, name, arity, ord, line_start, line_end), invoke (caller,
decl_class, name, arity, line, ord, special), class_rel (sub, super, rel, sub_is_interface).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dispatch_map(class_rel: DataFrame) -> DataFrame:
    """(decl_class, impl): each class or interface and its direct, non-interface subtypes. Object has none."""
    rows = class_rel.where("super <> 'java.lang.Object'")
    if "sub_is_interface" in rows.columns:
        rows = rows.where("not coalesce(sub_is_interface, false)")
    return rows.select(F.col("super").alias("decl_class"), F.col("sub").alias("impl")).distinct()


def implementors(class_rel: DataFrame) -> DataFrame:
    """(super, subs): the sorted list of direct subtypes."""
    found = dispatch_map(class_rel)
    return found.groupBy(F.col("decl_class").alias("super")).agg(F.array_sort(F.collect_set("impl")).alias("subs"))


def call_edges(methods: DataFrame, invokes: DataFrame, class_rel: DataFrame) -> DataFrame:
    """(caller, callee, call_line, ord): virtual dispatch by class, name and arity.

    Special invocations make no edges. The line is the first positive one of a
    (caller, callee) pair; ord numbers a caller's callees by name.
    """
    sites = invokes.where("not special").select(
        "caller", "decl_class", "name", "arity", "line", F.col("ord").alias("site"),
    )
    own = sites.select(F.col("decl_class"), F.col("decl_class").alias("impl")).distinct()
    targets = own.union(dispatch_map(class_rel)).distinct()
    found = sites.join(targets, "decl_class").join(
        methods.select(F.col("class").alias("impl"), "name", "arity", F.col("sig").alias("callee")),
        ["impl", "name", "arity"],
    )
    line = F.min_by("line", F.when(F.col("line") > 0, F.col("site")))
    edges = found.groupBy("caller", "callee").agg(line.alias("call_line"))
    return numbered(edges)


def numbered(edges: DataFrame) -> DataFrame:
    by = Window.partitionBy("caller").orderBy("callee")
    return edges.withColumn("ord", F.row_number().over(by).cast("long"))


def collapse_bridges(edges: DataFrame, bridges: DataFrame) -> DataFrame:
    """(caller, callee) with each bridge replaced by what it calls, itself excepted; one level.

    edges (caller, callee); bridges (sig). Callers that are bridges go.
    """
    real = (
        edges.join(bridges, edges["caller"] == bridges["sig"], "left_semi")
        .where("caller <> callee")
        .select(F.col("caller").alias("bridge"), F.col("callee").alias("real"))
    )
    kept = edges.join(bridges, edges["caller"] == bridges["sig"], "left_anti").select("caller", "callee")
    marked = kept.join(bridges.select(F.col("sig").alias("callee"), F.lit(True).alias("is_bridge")), "callee", "left")
    plain = marked.where("is_bridge is null").select("caller", "callee")
    moved = (
        marked.where("is_bridge")
        .join(real, F.col("callee") == F.col("bridge"))
        .select("caller", F.col("real").alias("callee"))
    )
    return plain.union(moved).distinct()


def collapse_callsites(sites: DataFrame, bridges: DataFrame) -> DataFrame:
    """(caller, callee, call_line): callsites moved to the bridges' callees; of several the first, by ord, stays.

    sites (caller, callee, call_line, ord).
    """
    real = (
        sites.join(bridges, sites["caller"] == bridges["sig"], "left_semi")
        .where("caller <> callee")
        .select(F.col("caller").alias("bridge"), F.col("callee").alias("real"))
    )
    kept = sites.join(bridges, sites["caller"] == bridges["sig"], "left_anti")
    marked = kept.join(bridges.select(F.col("sig").alias("callee"), F.lit(True).alias("is_bridge")), "callee", "left")
    plain = marked.where("is_bridge is null").select("caller", "callee", "call_line", "ord")
    moved = (
        marked.where("is_bridge")
        .join(real, F.col("callee") == F.col("bridge"))
        .select("caller", F.col("real").alias("callee"), "call_line", "ord")
    )
    return plain.union(moved).groupBy("caller", "callee").agg(F.min_by("call_line", "ord").alias("call_line"))


def line_ranges(stmts: DataFrame) -> DataFrame:
    """(sig, line_start, line_end): least positive and greatest line of methods that have both."""
    out = stmts.groupBy("sig").agg(
        F.min(F.when(F.col("line") > 0, F.col("line"))).alias("line_start"), F.max("line").alias("line_end"),
    )
    return out.where("line_start > 0 and line_end > 0")


def line_histogram(stmts: DataFrame) -> DataFrame:
    """(sig, line, n)"""
    return stmts.groupBy("sig", "line").agg(F.count(F.lit(1)).alias("n"))


def line_map(methods: DataFrame, stmts: DataFrame) -> DataFrame:
    """One row per method with a body: line range, statement count, and the map of lines to counts."""
    lines = (
        line_histogram(stmts)
        .groupBy("sig")
        .agg(
            F.sum("n").alias("stmt_count"), F.count(F.lit(1)).alias("source_lines"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("line", "n")))).alias("line_map"),
        )
    )
    return methods.select("sig", "class", "name").join(line_ranges(stmts), "sig").join(lines, "sig")


def method_at_line(methods: DataFrame, asked: DataFrame) -> DataFrame:
    """(class, line, sig): for each asked (class, line), the first method of the class, by ord, whose range holds the line."""
    hit = asked.join(methods, "class").where("line_start <= line and line <= line_end")
    return hit.groupBy("class", "line").agg(F.min_by("sig", "ord").alias("sig"))


def methods_with_line(stmts: DataFrame, asked: DataFrame) -> DataFrame:
    """(sig, line): methods that have a statement exactly at an asked (line)."""
    return stmts.select("sig", "line").join(asked.select("line"), "line", "left_semi").distinct().select("sig", "line")


def latest_start(methods: DataFrame, asked: DataFrame) -> DataFrame:
    """(class, line, sig): the method that starts last at or before the line.

    One pass over each class's starts and asked lines in order, never a pair of them.
    """
    kind = asked.schema["line"].dataType
    starts = methods.select("class", F.col("line_start").alias("line"), F.struct("sig").alias("at"))
    rows = starts.unionByName(asked.select("class", "line").distinct(), allowMissingColumns=True)
    # Starts come before the lines that equal them.
    by = Window.partitionBy("class").orderBy("line", F.col("at").isNull(), "at")
    found = rows.where("class is not null and line is not null").select(
        "class", F.col("line").cast(kind).alias("line"), F.col("at").isNull().alias("asked"),
        F.last("at", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("last"),
    )
    return found.where("asked and last is not null").select("class", "line", "last.sig")


def with_lines(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """Edges with the callee's class, method and line range."""
    info = methods.select(F.col("sig").alias("callee"), "class", "name", "line_start", "line_end")
    return edges.join(info, "callee", "left")


def callsite_line(calls: DataFrame, trace: DataFrame) -> DataFrame:
    """calls (caller, callee, class, name) with call_line: the least line whose call is `class.name`, else one that ends in `.name`.

    trace (caller, line, call).
    """
    named = calls.withColumn("exact", F.concat("class", F.lit("."), "name"))
    exact = (
        named.join(trace.withColumnRenamed("call", "exact"), ["caller", "exact"])
        .groupBy("caller", "callee")
        .agg(F.min("line").alias("l1"))
    )
    tail = trace.withColumn("name", F.substring_index("call", ".", -1))
    loose = named.join(tail, ["caller", "name"]).groupBy("caller", "callee").agg(F.min("line").alias("l2"))
    out = calls.join(exact, ["caller", "callee"], "left").join(loose, ["caller", "callee"], "left")
    return out.select(*calls.columns, F.coalesce("l1", "l2").alias("call_line"))


def resolve_by_name(methods: DataFrame, cls: str, name: str) -> DataFrame:
    """(sig, overloads): all methods of that name; it is unique if overloads is 1."""
    found = methods.where((F.col("class") == cls) & (F.col("name") == name))
    return found.select("sig", F.count(F.lit(1)).over(Window.partitionBy("class", "name")).alias("overloads"))


def resolve_callees(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """calls (class, sub_sig, name, arity) with sig: by sub-signature, else the first by name and arity."""
    exact = methods.groupBy("class", "sub_sig").agg(F.min_by("sig", "ord").alias("s1"))
    loose = methods.groupBy("class", "name", "arity").agg(F.min_by("sig", "ord").alias("s2"))
    return (
        calls.join(exact, ["class", "sub_sig"], "left")
        .join(loose, ["class", "name", "arity"], "left")
        .select(*calls.columns, F.coalesce("s1", "s2").alias("sig"))
    )


def entries_of(edges: DataFrame, cls: str, method: str) -> DataFrame:
    """(sig): the callers of that class and method, by name. A method that calls nothing is no entry."""
    hit = edges.where(
        F.col("caller").startswith(f"<{cls}: ") & F.col("caller").contains(f" {method}(")
    ).select(F.col("caller").alias("sig"))
    return hit.distinct().orderBy("sig")


def first_of(rows: DataFrame, keys: list[str], order: list[Column | str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key."""
    by = Window.partitionBy(*keys).orderBy(*[F.desc(c) if last else F.asc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
