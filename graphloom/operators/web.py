"""Pages mapped to code: expression actions, includes, beans and the calls below them."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.el import page_actions
from ..functions.signatures import class_of, el_bean, el_key, el_member, in_scope, jsp_key
from . import calltree, reach

#: What includes a page, by the JSP syntax: how the tag opens, and the attribute that names the page.
INCLUDES = {"jsp:include": "page", "c:import": "url", "ui:include": "src", "%@ include": "file"}


def include_pattern(tag: str, attribute: str) -> str:
    """The attribute's value, in either kind of quotes, in an opening tag; case doesn't matter."""
    opening = r"\s*".join(re.escape(part) for part in tag.split(" "))
    return rf"""(?i)<{opening}\b(?:[^>]*\s)?{attribute}\s*=\s*(?:"([^">]+)"|'([^'>]+)')"""


def el_actions(pages: DataFrame) -> DataFrame:
    """(jsp, ord, tag, attribute, el, bean_name, member) of pages (jsp, html); actions without a bean go."""

    def scan(batches):
        for b in batches:
            rows = [
                (p, i, *a)
                for p, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                for i, a in enumerate(page_actions(h or ""))
            ]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in zip(*rows, strict=True)], ["jsp", "ord", "tag", "attribute", "el"],
                )

    rows = pages.select("jsp", "html").mapInArrow(scan, "jsp string, ord long, tag string, attribute string, el string")
    return (
        rows.withColumn("bean_name", el_bean(F.col("el")))
        .withColumn("member", el_member(F.col("el")))
        .where("bean_name <> ''")
    )


def include_paths(pages: DataFrame, includes: dict[str, str] = INCLUDES) -> DataFrame:
    """(jsp, path) as written; paths with expressions go."""
    found = lambda p: F.concat(
        *(F.filter(F.regexp_extract_all("html", F.lit(p), F.lit(g)), lambda x: x != "") for g in (1, 2))
    )
    every = F.concat(*(found(include_pattern(tag, attribute)) for tag, attribute in includes.items()))
    return pages.select("jsp", F.explode(every).alias("path")).where(
        ~F.col("path").contains("${") & ~F.col("path").contains("#{")
    )


def resolve_includes(includes: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, dst): includes of pages that exist; absolute paths from the root, others from the page's folder, none outside or elsewhere."""
    here = F.split("jsp", "/")
    folder = F.when(
        F.col("path").startswith("/"), F.array().cast("array<string>"),
    ).otherwise(F.slice(here, 1, F.size(here) - 1))
    start = F.struct(folder.alias("parts"), F.lit(True).alias("inside"))

    def step(at, x):
        up = F.struct(
            F.slice(at["parts"], 1, F.greatest(F.size(at["parts"]) - 1, F.lit(0))).alias("parts"),
            (at["inside"] & (F.size(at["parts"]) > 0)).alias("inside"),
        )
        down = F.struct(F.concat(at["parts"], F.array(x)).alias("parts"), at["inside"].alias("inside"))
        return F.when(x == "..", up).when(x.isin("", "."), at).otherwise(down)

    placed = includes.where(~F.col("path").rlike("^https?://")).select(
        F.col("jsp").alias("src"), F.aggregate(F.split("path", "/"), start, step).alias("at"),
    )
    out = placed.where("at.inside").select("src", F.array_join("at.parts", "/").alias("dst")).distinct()
    return out.join(pages.select(F.col("jsp").alias("dst")), "dst", "left_semi").select("src", "dst")


def include_closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(jsp): start (jsp) and all that it includes."""
    got = reach.closure(edges, start.select(F.lit(0).alias("root"), F.col("jsp").alias("node")))
    return got.select(F.col("node").alias("jsp")).distinct()


#: Ways to find beans by name: each takes (spark, path) and returns (bean_name, fqcn, scope).
RESOLVERS: dict[str, Callable[..., DataFrame]] = {}


def resolver(name: str) -> Callable[..., DataFrame]:
    if name not in RESOLVERS:
        raise ValueError(f"unknown resolver {name!r}; known: {sorted(RESOLVERS)}")
    return RESOLVERS[name]


def bean_methods(actions: DataFrame, beans: DataFrame, callers: DataFrame) -> DataFrame:
    """actions with sig: the methods (sig) of the bean's class, all overloads, that the member names."""
    named = actions.where("member <> ''").join(beans, "bean_name")
    keys = callers.select("sig", class_of(F.col("sig")).alias("fqcn"))
    return named.join(keys, "fqcn").where(F.col("sig").contains(F.concat(F.lit(" "), F.col("member"), F.lit("("))))


def page_map(actions: DataFrame, beans: DataFrame, edges: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, node_type), calls (src, dst, edge_type, call_line, filtered)) from pages through expressions into code.

    A page node stands even if its bean is unknown; equal expressions of a page repeat their calls.
    """
    page = jsp_key(F.col("jsp"))
    el = el_key(F.col("jsp"), F.col("el"))
    known = actions.where("member <> ''").join(beans, "bean_name")
    entries = bean_methods(actions, beans, edges.select(F.col("src").alias("sig")).distinct())
    seeds = (
        entries.select("sig")
        .distinct()
        .where(in_scope(class_of(F.col("sig")), pattern))
        .select(F.lit("jsp").alias("root"), F.col("sig").alias("node"))
    )
    tree = calltree.forward_nodes(edges, seeds, pattern)
    calls = calltree.forward_calls(edges, tree, pattern)
    none = F.lit(None).cast("long")
    nodes = (
        actions.select(page.alias("node"), F.lit("jsp").alias("node_type"))
        .union(known.select(el, F.lit("el_expression")))
        .union(tree.select("node", F.lit("java_method")))
        .distinct()
    )
    links = known.select(
        page.alias("src"), el.alias("dst"), F.lit("el_call").alias("edge_type"), none.alias("call_line"),
        F.lit(False).alias("filtered"),
    )
    links = links.union(entries.select(el, "sig", F.lit("method_call"), none, F.lit(False)))
    return nodes, links.union(calls.select("src", "dst", F.lit("call"), F.col("call_line").cast("long"), "filtered"))
