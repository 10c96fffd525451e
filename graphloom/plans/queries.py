"""Queries over the derived facts: one or more for each family of operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import signatures as S
from ..operators import blocks, callgraph, calltree, dataflow, icfg, reach, semantic, trace, validate, web
from ..sources.facts import Facts, with_facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SCOPE = "^com\\.(economy|small|medium|large|standard|promo)\\."
NARROW = "^com\\.(economy|small|standard)\\."


def query(sql: str | None = None):
    def add(fn: Callable[[Facts], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Facts(spark, sf_dir))
        if sql:
            SQL[fn.__name__] = with_facts(sql)
        return fn

    return add


def _big(*cols: str):
    return [F.col(c).cast("long").alias(c) for c in cols]


def _root(f: Facts) -> DataFrame:
    return f.root.select(F.lit(0).cast("long").alias("root"), F.col("sig").alias("node"))


# Projections and predicates


@query("""
    SELECT sig, regexp_extract(sig, '^<([^:]+):', 1) AS class, regexp_extract(sig, '^<[^:]+:[^)]+\\b(\\w+)\\(',
        1) AS method, regexp_extract(sig, '([^ ]+\\(.*\\))', 1) AS sub_sig
        FROM method
""")
def sig_parse(f):
    sig = F.col("sig")
    return f.method.select(
        "sig", S.class_of(sig).alias("class"), S.method_of(sig).alias("method"), S.sub_signature(sig).alias("sub_sig"),
    )


@query("""
    SELECT sig, regexp_extract(class, '([^.]+)$', 1) AS short, regexp_extract(class, '([^.]+)$',
        1) || '.' || name AS short_method, greatest(0, line_end - line_start + 1) AS n_lines
        FROM method
""")
def short_names(f):
    return f.method.select(
        "sig", S.short_class(F.col("class")).alias("short"), S.short_method(F.col("sig")).alias("short_method"),
        S.line_count(F.col("line_start"), F.col("line_end")).cast("long").alias("n_lines"),
    )


@query("""
    SELECT class, line, min_by(sig, ord) AS sig FROM (SELECT m.class, a.line, m.sig, m.ord FROM method m
        JOIN (SELECT DISTINCT class, line_start + 3 AS line FROM method) a ON a.class = m.class
        AND a.line BETWEEN m.line_start AND m.line_end) GROUP BY class, line
""")
def line_to_method(f):
    asked = f.method.select("class", (F.col("line_start") + 3).alias("line")).distinct()
    return callgraph.method_at_line(f.method, asked)


@query("""
    SELECT class, line, max_by(sig, line_start) AS sig FROM (SELECT m.class, a.line, m.sig, m.line_start FROM method m
        JOIN (SELECT DISTINCT class, line_end + 7 AS line FROM method) a ON a.class = m.class
        AND m.line_start <= a.line) GROUP BY class, line
""")
def latest_method(f):
    return callgraph.latest_start(f.method, f.method.select("class", (F.col("line_end") + 7).alias("line")).distinct())


@query("""SELECT DISTINCT sig, o AS line FROM stmt WHERE o IN (SELECT p_size FROM part)""")
def line_membership(f):
    return callgraph.methods_with_line(
        f.stmt.select("sig", F.col("o").alias("line")), f.part.select(F.col("p_size").cast("long").alias("line")),
    )


@query(f"""SELECT sig, class <> '' AND regexp_matches(class, '{NARROW}') AS inside FROM method""")
def scope_filter(f):
    return f.method.select("sig", S.in_scope(F.col("class"), NARROW).alias("inside"))


@query("""
    SELECT sig, starts_with(class, 'com.') AND NOT starts_with(class, 'com.economy.')
        AND NOT starts_with(class, 'com.small.Brand1') AS entered FROM method
""")
def allow_stop_filter(f):
    return f.method.select(
        "sig", S.may_recurse(F.col("class"), ["com."], ["com.economy.", "com.small.Brand1"]).alias("entered"),
    )


_ARGS = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'null' WHEN 1 THEN '-12.5F' WHEN 2 THEN '\"s\"' WHEN 3 THEN ''
        WHEN 4 THEN 'true' ELSE event_type END AS arg FROM events"""


@query(f"""
    SELECT event_id, arg = '' OR arg IN ('null', 'true', 'false') OR starts_with(arg, '"')
        OR regexp_matches(arg, '^-?\\d+(\\.\\d+)?[LlFfDd]?$') AS constant FROM ({_ARGS})
""")
def constant_args(f):
    return f.sql(_ARGS).select("event_id", S.is_constant(F.col("arg")).alias("constant"))


@query("""
    SELECT id, trim(split_part(regexp_extract(text, '\\(([^(]*)\\)[^)]*$', 1), ',', 1)) AS arg0,
        trim(split_part(regexp_extract(text, '\\(([^(]*)\\)[^)]*$', 1), ',', 2)) AS arg1
        FROM ddg_node WHERE kind = 'ASSIGN_INVOKE'
""")
def arg_at_index(f):
    return f.ddg_node.where("kind = 'ASSIGN_INVOKE'").select(
        "id", S.argument(F.col("text"), F.lit(0)).alias("arg0"), S.argument(F.col("text"), F.lit(1)).alias("arg1"),
    )


@query("""
    SELECT id, CASE WHEN contains(text, ' := ') THEN 'IDENTITY' WHEN starts_with(text, 'return ') THEN 'RETURN'
        WHEN call_target IS NOT NULL AND contains(text, ' = ') THEN 'ASSIGN_INVOKE'
        WHEN call_target IS NOT NULL THEN 'INVOKE' ELSE 'ASSIGN' END AS kind,
    nullif(regexp_extract(text, '^(.*?) :?= ', 1), '') AS defined, CASE
        WHEN starts_with(text, 'return ') THEN substr(text, 8) END AS returned FROM ddg_node""")
def stmt_kind(f):
    t = F.col("text")
    return f.ddg_node.select(
        "id", S.statement_kind(t, F.col("call_target")).alias("kind"), S.defined_local(t).alias("defined"),
        S.returned_local(t).alias("returned"),
    )


# Call graphs


@query("""
    SELECT DISTINCT i.caller, m.sig AS callee FROM invoke i JOIN (SELECT super AS decl, sub AS impl FROM class_rel UNION
        SELECT DISTINCT decl_class, decl_class FROM invoke) t ON t.decl = i.decl_class
        JOIN impl_method m ON m.class = t.impl AND m.name = i.name AND m.arity = i.arity WHERE NOT i.special
""")
def dispatch_edges(f):
    return callgraph.call_edges(f.impl_method, f.invoke, f.class_rel).select("caller", "callee")


@query("""
    SELECT caller, callee, CAST(min_by(line, CASE WHEN line > 0 THEN ord END) AS BIGINT) AS call_line
        FROM (SELECT i.caller, m.sig AS callee, i.line, i.ord FROM invoke i JOIN class_rel t ON t.super = i.decl_class
        JOIN impl_method m ON m.class = t.sub WHERE NOT i.special) GROUP BY caller, callee
""")
def first_callsite(f):
    return callgraph.call_edges(f.impl_method, f.invoke, f.class_rel).select("caller", "callee", *_big("call_line"))


@query("""SELECT super, string_agg(sub, ',' ORDER BY sub) AS subs FROM class_rel GROUP BY super""")
def dispatch_map(f):
    return callgraph.implementors(f.class_rel).select("super", F.array_join("subs", ",").alias("subs"))


@query("""SELECT sig, min(CASE WHEN o > 0 THEN o END) AS line_start, max(o) AS line_end FROM stmt GROUP BY sig""")
def method_line_ranges(f):
    return callgraph.line_ranges(f.stmt.select("sig", F.col("o").alias("line")))


@query("""SELECT sig, CAST(o // 7 AS BIGINT) AS line, count(*) AS n FROM stmt GROUP BY ALL""")
def line_histogram(f):
    return callgraph.line_histogram(f.stmt.select("sig", F.floor(F.col("o") / 7).alias("line")))


_BRIDGED = """SELECT DISTINCT c.src AS caller, CASE WHEN b.sig IS NULL THEN c.dst ELSE r.dst END AS callee
    FROM call_edge c LEFT JOIN bridge b ON b.sig = c.dst LEFT JOIN call_edge r ON r.src = b.sig AND r.dst <> r.src
    WHERE c.src NOT IN (SELECT sig FROM bridge) AND (b.sig IS NULL OR r.dst IS NOT NULL)"""


@query(_BRIDGED)
def bridge_collapse(f):
    return callgraph.collapse_bridges(
        f.call_edge.select(F.col("src").alias("caller"), F.col("dst").alias("callee")), f.bridge,
    )


@query("""
    SELECT caller, callee, min_by(call_line, ord) AS call_line FROM (SELECT c.src AS caller, CASE
        WHEN b.sig IS NULL THEN c.dst ELSE r.dst END AS callee, c.call_line, c.ord
    FROM call_edge c LEFT JOIN bridge b ON b.sig = c.dst LEFT JOIN call_edge r ON r.src = b.sig AND r.dst <> r.src
    WHERE c.src NOT IN (SELECT sig FROM bridge) AND (b.sig IS NULL OR r.dst IS NOT NULL)) GROUP BY caller, callee""")
def bridge_callsites(f):
    return callgraph.collapse_callsites(
        f.call_edge.select(F.col("src").alias("caller"), F.col("dst").alias("callee"), "call_line", "ord"), f.bridge,
    )


@query("""SELECT dst AS src, src AS dst FROM call_edge""")
def reverse_edges(f):
    return reach.reversed_edges(f.call_edge)


@query("""
    SELECT m.sig AS node FROM method m WHERE m.sig IN (SELECT caller FROM flat_call) AND m.sig NOT IN (SELECT callee
        FROM flat_call)
""")
def roots(f):
    return reach.roots(
        f.flat_call.select(F.col("caller").alias("node")).distinct(), f.flat_call.select(F.col("callee").alias("dst")),
    )


# Call trees and chains

_TREE = f"""WITH RECURSIVE walk(node, depth) AS (SELECT sig, 0 FROM root UNION SELECT e.dst, w.depth + 1 FROM walk w
        JOIN call_edge e ON e.src = w.node WHERE w.depth < 6
        AND regexp_matches(regexp_extract(e.dst, '^<([^:]+):', 1), '{NARROW}'))"""


@query(f"{_TREE} SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY node")
def fw_calltree_nodes(f):
    return calltree.forward_nodes(f.call_edge, _root(f), NARROW, 6).select("node", "depth")


@query(f"""
    {_TREE}, n AS (SELECT DISTINCT node FROM walk)
        SELECT e.src, e.dst, e.call_line, NOT regexp_matches(regexp_extract(e.dst, '^<([^:]+):', 1), '{NARROW}') AS filtered
        FROM n JOIN call_edge e ON e.src = n.node
""")
def fw_calltree_calls(f):
    nodes = calltree.forward_nodes(f.call_edge, _root(f), NARROW, 6)
    return calltree.forward_calls(f.call_edge, nodes, NARROW).select("src", "dst", "call_line", "filtered")


@query("""
    WITH RECURSIVE walk(node) AS (SELECT sig FROM root UNION SELECT e.dst FROM walk w
        JOIN call_edge e ON e.src = w.node) SELECT node FROM walk
""")
def full_closure(f):
    return reach.closure(f.call_edge, _root(f)).select("node")


@query("""WITH RECURSIVE walk(root, node, depth) AS (SELECT sig, sig, 0 FROM method
    UNION SELECT w.root, c.callee, w.depth + 1 FROM walk w JOIN flat_call c ON c.caller = w.node WHERE w.depth < 2)
    SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY root, node""")
def many_roots(f):
    seeds = f.method.select(F.col("sig").alias("root"), F.col("sig").alias("node"))
    return reach.closure(f.flat_call.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), seeds, 2)


@query()
def fw_calltree_flags(f):
    """Cycle flags depend on the order of a depth-first walk, which SQL can't express."""
    nodes, calls = calltree.forward_tree(f.call_edge, _root(f), NARROW, f.method)
    return calls.select("src", "dst", "call_line", "filtered", "cycle")


@query("""WITH RECURSIVE p AS (SELECT pid, sig FROM method), s AS (SELECT src, dst FROM part_call),
    w(a, b) AS (SELECT src, dst FROM s UNION SELECT w.a, s.dst FROM w JOIN s ON s.src = w.b)
    SELECT x.sig AS src, y.sig AS dst, EXISTS (SELECT 1 FROM w WHERE w.a = s.dst AND w.b = s.src) AS in_scc FROM s
        JOIN p x ON x.pid = s.src JOIN p y ON y.pid = s.dst""")
def scc_edges(f):
    return reach.in_component(f.call_edge)


@query("""
    WITH RECURSIVE walk(node) AS (SELECT sig FROM root UNION SELECT e.dst FROM walk w JOIN call_edge e ON e.src = w.node
        WHERE NOT starts_with(e.dst, '<com.economy.') AND e.dst NOT IN (SELECT sig FROM bridge))
    SELECT e.src, e.dst, (starts_with(e.dst, '<com.economy.') OR e.dst IN (SELECT sig FROM bridge))
        AND e.dst NOT IN (SELECT sig FROM root) AS filtered FROM walk w JOIN call_edge e ON e.src = w.node""")
def xtrace_classify(f):
    known = f.method.where("not is_bridge").select("sig")
    _, calls = calltree.discover(
        f.call_edge, _root(f), known, S.may_recurse(S.class_of(F.col("dst")), [], ["com.economy."]),
    )
    return calls.select("src", "dst", (F.col("kind") == "FILTERED").alias("filtered"))


@query("""
    WITH RECURSIVE walk(node, depth) AS (SELECT sig, 0 FROM root UNION SELECT e.src, w.depth + 1 FROM walk w
        JOIN call_edge e ON e.dst = w.node WHERE w.depth < 5) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM walk
        GROUP BY node HAVING min(depth) > 0
""")
def rev_reach_depth(f):
    return calltree.backward_nodes(f.call_edge, _root(f), 5).select("node", "depth")


_CHAINS = """WITH RECURSIVE t AS (SELECT max(callee) AS sig FROM flat_call),
    up(node, d) AS (SELECT sig, 0 FROM t UNION SELECT c.caller, up.d + 1 FROM up JOIN flat_call c ON c.callee = up.node
        WHERE up.d < 3),
    near AS (SELECT DISTINCT node FROM up),
    tops AS (SELECT node FROM near WHERE node NOT IN (SELECT c.callee FROM flat_call c
        JOIN near ON near.node = c.caller)),
    p(node, path, n) AS (SELECT node, [node], 1 FROM tops UNION ALL
        SELECT c.callee, list_append(p.path, c.callee), p.n + 1 FROM p JOIN flat_call c ON c.caller = p.node
        JOIN near ON near.node = c.callee WHERE p.n < 4)"""


def _chains(f):
    """All chains of up to three calls into the method that comes last by name."""
    by = Window.partitionBy("caller").orderBy("callee")
    edges = f.flat_call.select(
        F.col("caller").alias("src"), F.col("callee").alias("dst"), F.row_number().over(by).alias("ord"),
    )
    target = edges.agg(F.max("dst").alias("t")).first()["t"]
    seeds = edges.sparkSession.createDataFrame([(target, target)], "root string, node string")
    return calltree.chains(edges, target, calltree.backward_nodes(edges, seeds, 3), None, 4)


@query(f"""
    {_CHAINS} SELECT array_to_string(path, ' ') AS path, row_number() OVER (ORDER BY path) AS chain FROM p
        JOIN t ON p.node = t.sig WHERE n > 1
""")
def rev_chains(f):
    return _chains(f).select("chain", F.array_join("path", " ").alias("path"))


@query(f"""
    {_CHAINS}, c AS (SELECT path FROM p JOIN t ON p.node = t.sig WHERE n > 1)
        SELECT DISTINCT path[i] AS src, path[i + 1] AS dst FROM (SELECT path, unnest(range(1, len(path))) AS i FROM c)
""")
def chain_nodes_edges(f):
    return calltree.chain_edges(_chains(f))


@query("""
    WITH RECURSIVE p(node, path, n) AS (SELECT sig, [sig], 1 FROM root UNION ALL
        SELECT e.dst, list_append(p.path, e.dst), p.n + 1 FROM p JOIN call_edge e ON e.src = p.node
        WHERE p.n < 4 AND NOT list_contains(p.path, e.dst) AND NOT starts_with(p.node, '<com.economy.'))
    SELECT array_to_string(path, ' ') AS path FROM p WHERE starts_with(node, '<com.economy.')""")
def layer_chains(f):
    found = calltree.layer_chains(f.call_edge, f.root.select(F.col("sig").alias("node")), "^com\\.economy\\.", 4)
    return found.select(F.array_join("path", " ").alias("path"))


# Control flow


def _lines(f):
    return f.stmt.select("sig", F.col("o").alias("block"), F.col("o").alias("line"))


_FROM_TO = """
    WITH RECURSIVE fwd(sig, node) AS (SELECT sig, o FROM stmt WHERE o = 5 UNION SELECT w.sig, e.dst FROM fwd w
        JOIN flow_edge e ON e.sig = w.sig AND e.src = w.node),
    bwd(sig, node) AS (SELECT sig, o FROM stmt WHERE o = 30 UNION SELECT w.sig, e.src FROM bwd w
        JOIN flow_edge e ON e.sig = w.sig AND e.dst = w.node),
    kept AS (SELECT sig, node FROM fwd INTERSECT SELECT sig, node FROM bwd)"""


@query(f"{_FROM_TO} SELECT sig, node AS block FROM kept")
def block_reach_intersection(f):
    return blocks.between_lines(f.flow_edge, _lines(f), 5, 30)


@query(f"""
    {_FROM_TO} SELECT e.sig, e.src, e.dst FROM flow_edge e JOIN kept a ON a.sig = e.sig AND a.node = e.src
        JOIN kept b ON b.sig = e.sig AND b.node = e.dst
""")
def slice_edges(f):
    return blocks.slice_edges(
        f.flow_edge, blocks.between_lines(f.flow_edge, _lines(f), 5, 30),
    ).select("sig", "src", "dst")


@query("""
    WITH RECURSIVE n(sig, node) AS (SELECT DISTINCT sig, CAST(1 AS BIGINT) FROM stmt UNION SELECT w.sig, e.dst FROM n w
        JOIN flow_edge e ON e.sig = w.sig AND e.src = w.node) SELECT sig, node AS block FROM n
""")
def normal_flow(f):
    return blocks.normal_flow(f.flow_edge, f.stmt.where("o = 1").select("sig", F.col("o").alias("block")))


@query("""
    WITH RECURSIVE n(sig, node) AS (SELECT DISTINCT sig, CAST(1 AS BIGINT) FROM stmt UNION SELECT w.sig, e.dst FROM n w
        JOIN flow_edge e ON e.sig = w.sig AND e.src = w.node),
    h(sig, trap_idx, node) AS (SELECT sig, trap_idx, handler FROM trap UNION SELECT h.sig, h.trap_idx, e.dst FROM h
        JOIN flow_edge e ON e.sig = h.sig AND e.src = h.node WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.sig = h.sig
        AND n.node = e.dst))
    SELECT sig, trap_idx, node AS block FROM h""")
def handler_region(f):
    normal = blocks.normal_flow(f.flow_edge, f.stmt.where("o = 1").select("sig", F.col("o").alias("block")))
    return blocks.handler_regions(f.flow_edge, f.trap, normal)


_SEEDS = "(SELECT sig, trap_idx, block FROM cover WHERE block <> trap_idx - 2)"


@query(f"""WITH RECURSIVE h AS (SELECT DISTINCT sig, handler FROM trap), c AS {_SEEDS},
    fwd(sig, t, node) AS (SELECT sig, trap_idx, block FROM c UNION SELECT w.sig, w.t, e.dst FROM fwd w
        JOIN flow_edge e ON e.sig = w.sig AND e.src = w.node WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.sig = w.sig
        AND h.handler = e.dst)),
    bwd(sig, t, node) AS (SELECT sig, trap_idx, block FROM c UNION SELECT w.sig, w.t, e.src FROM bwd w
        JOIN flow_edge e ON e.sig = w.sig AND e.dst = w.node WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.sig = w.sig
        AND h.handler = e.src)),
    filled AS (SELECT sig, t, node FROM (SELECT sig, t, node FROM fwd INTERSECT SELECT sig, t, node FROM bwd) x
        WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.sig = x.sig AND h.handler = x.node) UNION SELECT sig, trap_idx, block
        FROM c)
    SELECT sig, t AS trap_idx, node AS block FROM filled UNION
    SELECT e.sig, x.t, e.src FROM flow_edge e JOIN filled x ON x.sig = e.sig AND x.node = e.dst
        WHERE NOT EXISTS (SELECT 1 FROM flow_edge q WHERE q.sig = e.sig AND q.dst = e.src) AND NOT EXISTS (SELECT 1
        FROM h WHERE h.sig = e.sig AND h.handler = e.src)""")
def gap_fill(f):
    return blocks.fill_gaps(
        f.flow_edge, f.cover.where("block <> trap_idx - 2").select("sig", "trap_idx", "block"), f.trap,
    )


@query("""
    WITH l AS (SELECT sig, o AS block, CAST(o % 6 AS BIGINT) AS line FROM stmt UNION
        SELECT sig, o, CAST(o % 4 AS BIGINT) FROM stmt WHERE local = 'signup'),
    a AS (SELECT sig, block FROM cover UNION SELECT sig, handler FROM trap)
    SELECT x.sig, x.block, min(t.trap_idx) AS trap_idx FROM (SELECT sig, block FROM l WHERE line > 0 GROUP BY ALL) x
        JOIN trap t ON t.sig = x.sig
    WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.sig = x.sig AND a.block = x.block) AND EXISTS (SELECT 1 FROM l
        WHERE l.sig = t.sig AND l.block = t.handler AND line > 0)
    AND NOT EXISTS (SELECT 1 FROM l b WHERE b.sig = x.sig AND b.block = x.block AND b.line > 0 AND NOT EXISTS (SELECT 1
        FROM l h WHERE h.sig = t.sig AND h.block = t.handler AND h.line = b.line)) GROUP BY x.sig, x.block""")
def inlined_handler(f):
    lines = f.sql(
        "SELECT sig, o AS block, CAST(o % 6 AS BIGINT) AS line FROM stmt UNION SELECT sig, o, CAST(o % 4 AS BIGINT) FROM stmt WHERE local = 'signup'"
    )
    assigned = f.cover.select("sig", "block").union(f.trap.select("sig", "handler"))
    return blocks.inlined_handlers(f.trap, lines, assigned)


@query("""
    SELECT sig, handler, type, string_agg(CAST(block AS VARCHAR), ',' ORDER BY ord) AS covered
        FROM (SELECT t.sig, CAST(t.handler // 10 AS BIGINT) AS handler, t.type, c.block, c.ord FROM trap t
        JOIN cover c ON c.sig = t.sig AND c.trap_idx = t.trap_idx GROUP BY ALL) GROUP BY sig, handler, type
""")
def trap_table(f):
    throws = f.trap.join(f.cover, ["sig", "trap_idx"]).select(
        "sig", F.floor(F.col("handler") / 10).alias("handler"), "type", "block", "ord",
    )
    return blocks.trap_table(throws).select("sig", "handler", "type", F.array_join("covered", ",").alias("covered"))


_ROLES = """SELECT sig, block, role, min(trap_idx) AS trap_idx FROM (
    SELECT sig, block, 'try' AS role, trap_idx FROM cover c WHERE NOT EXISTS (SELECT 1 FROM trap t WHERE t.sig = c.sig
        AND t.handler = c.block)
    UNION ALL SELECT sig, handler, 'handler', trap_idx FROM trap) GROUP BY sig, block, role"""


def _handlers(f):
    return f.trap.select("sig", "trap_idx", F.col("handler").alias("block"))


@query(_ROLES)
def trap_cluster_assign(f):
    return blocks.assign_clusters(f.cover, _handlers(f))


# Trace trees


def _tree(f):
    path = F.filter(F.array(*[F.col(c).cast("int") for c in ("n", "c", "o")]), lambda x: x >= 0)
    return f.tree_node.select(
        F.col("r").alias("trace"), path.alias("path"), "sig", F.col("sig").alias("class"), F.lit(1).alias("line_start"),
        F.lit(9).alias("line_end"), F.col("leaf").alias("leaf_kind"), F.lit(None).cast("long").alias("call_line"),
        "priority",
    )


def _path():
    return F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path")


_PATH = "concat_ws('.', CASE WHEN n >= 0 THEN n END, CASE WHEN c >= 0 THEN c END, CASE WHEN o >= 0 THEN o END)"


@query(f"""
    WITH t AS (SELECT r, min(n) AS n FROM tree_node WHERE n >= 0 AND c = -1 AND sig > 'G' AND sig < 'S' GROUP BY r)
        SELECT CAST(x.r AS BIGINT) AS trace, {_PATH.replace("n END", "x.n END").replace("WHEN n", "WHEN x.n")} AS path,
            sig
        FROM tree_node x JOIN t ON t.r = x.r AND t.n = x.n
""")
def find_subtree(f):
    hit = (F.size("path") == 1) & (F.col("sig") > "G") & (F.col("sig") < "S")
    return trace.find_subtree(_tree(f), hit).select(*_big("trace"), _path(), "sig")


@query(f"""
    WITH k AS (SELECT r, n, c, o FROM tree_node WHERE priority = '1-URGENT'), p AS (SELECT r, n, c, o FROM k UNION
        SELECT r, n, c, -1 FROM k UNION SELECT r, n, -1, -1 FROM k UNION SELECT r, -1, -1, -1 FROM k)
    SELECT CAST(r AS BIGINT) AS trace, {_PATH} AS path FROM p""")
def prune_to_target(f):
    return trace.prune_to_target(_tree(f), F.col("priority") == "1-URGENT").select(*_big("trace"), _path())


@query("""
    SELECT m.sig, m.class FROM method m WHERE m.name IN (SELECT 'm' || CAST(o AS STRING) FROM tree_node
        WHERE leaf = 'ref')
""")
def ref_semi(f):
    leaves = f.tree_node.select(
        (F.concat(F.lit("m"), F.col("o").cast("string"))).alias("sig"), F.col("leaf").alias("leaf_kind"),
    )
    return trace.referenced(
        leaves, f.method.select(F.col("name").alias("sig"), F.col("sig").alias("s"), "class"),
    ).select(F.col("s").alias("sig"), "class")


@query("""
    WITH RECURSIVE k AS (SELECT caller, callee, CAST(row_number() OVER (PARTITION BY caller
        ORDER BY ord) - 1 AS BIGINT) AS pos FROM body_call),
    w(trace, path, sig, above, open) AS (SELECT caller, '', caller, [caller], true FROM k WHERE starts_with(caller, 'r')
        UNION SELECT w.trace, w.path || '.' || CAST(k.pos AS VARCHAR), k.callee, list_append(w.above, k.callee),
            NOT list_contains(w.above, k.callee)
            FROM w JOIN k ON k.caller = w.sig WHERE w.open)
    SELECT trace, path, sig, NOT open AS is_ref FROM w""")
def expand_refs(f):
    """Regions down to orders, each a ref; an order's call back to its customer stays one."""
    by = Window.partitionBy("caller").orderBy("ord")
    kids = f.body_call.select(
        F.col("caller").alias("sig"), (F.row_number().over(by) - 1).alias("pos"), F.col("callee").alias("child"),
        F.lit("ref").alias("leaf_kind"), F.col("ord").alias("call_line"),
    )
    tops = (
        f.body_call.where("caller like 'r%'")
        .select(
            F.col("caller").alias("trace"), F.array().cast("array<int>").alias("path"), F.col("caller").alias("sig"),
            F.lit("ref").alias("leaf_kind"), F.lit(None).cast("long").alias("call_line"),
        )
        .distinct()
    )
    # A customer without orders has an empty body, not a missing one.
    out = trace.expand_refs(tops, kids, kids.select("sig").union(kids.select("child")))
    path = F.aggregate("path", F.lit(""), lambda a, x: F.concat(a, F.lit("."), x.cast("string")))
    return out.select(
        "trace", path.alias("path"), "sig", F.coalesce(F.col("leaf_kind") == "ref", F.lit(False)).alias("is_ref"),
    )


# Data dependence


@query("""
    WITH RECURSIVE w(sig, d, v, s) AS (SELECT e.sig, e.src, t.local, e.dst FROM flow_edge e JOIN stmt t ON t.sig = e.sig
        AND t.o = e.src
        UNION SELECT w.sig, w.d, w.v, e.dst FROM w JOIN stmt t ON t.sig = w.sig AND t.o = w.s
            JOIN flow_edge e ON e.sig = w.sig AND e.src = w.s WHERE t.local <> w.v)
    SELECT w.sig, w.d AS def, w.s AS use FROM w JOIN stmt_use u ON u.sig = w.sig AND u.stmt = w.s AND u.local = w.v""")
def reaching_defs(f):
    return dataflow.reaching_definitions(
        f.flow_edge, f.stmt.select("sig", F.col("o").alias("stmt"), "local"), f.stmt_use,
    )


_SITES = """n0 AS (SELECT id, sig, text, call_target, kind FROM ddg_node),
    sites AS (SELECT c.caller, c.callee, n.id AS site, trim(split_part(regexp_extract(n.text, '\\(([^(]*)\\)[^)]*$', 1),
        ',', 1)) AS arg
        FROM (SELECT caller, callee, regexp_extract(callee, '([^ ]+\\(.*\\))', 1) AS sub FROM flat_call) c
        JOIN (SELECT id, sig, text, regexp_extract(call_target, '([^ ]+\\(.*\\))', 1) AS sub FROM n0
            WHERE call_target IS NOT NULL) n ON n.sig = c.caller AND n.sub = c.sub),
    params AS (SELECT l.src, p.id AS dst FROM sites s JOIN (SELECT id, sig FROM n0
        WHERE text = 'p := @parameter0: int') p ON p.sig = s.callee
        JOIN local_edge l ON l.dst = s.site JOIN (SELECT id, regexp_extract(text, '^(.*?) :?= ', 1) AS made
            FROM n0) d ON d.id = l.src AND d.made = s.arg),
    returns AS (SELECT r.id AS src, s.site AS dst FROM sites s JOIN (SELECT id, sig FROM n0
        WHERE kind = 'RETURN') r ON r.sig = s.callee)"""


@query(f"WITH {_SITES} SELECT src, dst FROM params")
def param_edges(f):
    return dataflow.param_edges(f.ddg_node, f.local_edge, f.flat_call).select("src", "dst")


@query(f"WITH {_SITES} SELECT src, dst FROM returns")
def return_edges(f):
    return dataflow.return_edges(f.ddg_node, f.flat_call).select("src", "dst")


@query("""
    SELECT w.id AS src, r.id AS dst, regexp_extract(r.text, '(<[^>]+>)', 1) AS field FROM ddg_node r
        JOIN ddg_node w ON starts_with(w.text, 'b.<')
        AND regexp_extract(r.text, '(<[^>]+>)', 1) = regexp_extract(w.text, '(<[^>]+>)', 1)
    WHERE contains(r.text, ' = b.<') AND r.sig NOT IN (SELECT sig FROM bridge) AND w.sig NOT IN (SELECT sig
        FROM bridge)""")
def heap_edges(f):
    return dataflow.heap_edges(f.ddg_node, f.method.where("not is_bridge")).select("src", "dst", "field")


_SLICE = f"""WITH RECURSIVE {_SITES},
    e AS (SELECT src, dst, 'LOCAL' AS kind FROM local_edge UNION ALL SELECT src, dst, 'RETURN' FROM returns UNION ALL
        SELECT src, dst, 'PARAM' FROM params),
    w(id) AS (SELECT id FROM ddg_node WHERE starts_with(text, 'x1 = ') UNION SELECT e.src FROM w
        JOIN e ON e.dst = w.id)"""


def _slice(f):
    edges = dataflow.dependence_graph(f.ddg_node, f.local_edge, f.flat_call)
    seeds = f.ddg_node.where(S.defines(F.col("text"), F.lit("x1"))).select("id")
    return dataflow.backward_slice(edges, seeds)


@query(f"{_SLICE} SELECT id FROM w")
def bwd_slice(f):
    return _slice(f)[0].select("id")


@query(f"{_SLICE} SELECT e.src, e.dst, e.kind FROM e JOIN w ON w.id = e.dst")
def bwd_slice_edges(f):
    return _slice(f)[1].select("src", "dst", "kind")


# Semantic graphs


def _stmts(f):
    t = F.col("local")
    pick = lambda *k: F.when(t.isin(*k), F.concat(F.lit("a.b."), F.upper(t), F.lit("."), t))
    return f.stmt.select(
        "sig", F.floor(F.col("o") / 8).alias("block"), F.floor(F.col("o") / 8).alias("block_ord"),
        F.col("o").alias("ord"), F.floor(F.col("o") / 3).alias("line"), pick("click", "view").alias("call"),
        F.when(t == "error", t).alias("branch"), F.when(t == "signup", t).alias("assign"),
    )


_STMTS = """SELECT sig, CAST(o // 8 AS BIGINT) AS block, CAST(o // 3 AS BIGINT) AS line, o AS ord, CASE
        WHEN local IN ('click', 'view') THEN 'a.b.' || upper(local) || '.' || local END AS call, CASE
        WHEN local = 'error' THEN local END AS branch, CASE WHEN local = 'signup' THEN local END AS assign FROM stmt"""
_MERGED = f"""
    SELECT sig, block, line, coalesce(string_agg(call, ',' ORDER BY ord), '') AS calls, coalesce(string_agg(branch, ','
        ORDER BY ord), '') AS branches, coalesce(string_agg(assign, ',' ORDER BY ord), '') AS assigns FROM ({_STMTS})
        GROUP BY sig, block, line"""


@query(_MERGED)
def merge_stmts(f):
    return semantic.merge_statements(_stmts(f)).select(
        "sig", "block", "line", *[F.array_join(c, ",").alias(c) for c in ("calls", "branches", "assigns")],
    )


@query("""
    SELECT sig, CAST(run AS BIGINT) AS run, local, min(o) AS first_ord, count(*) AS n
        FROM (SELECT *, sum(s) OVER (PARTITION BY sig ORDER BY o) AS run FROM (SELECT sig, o, local, CASE
        WHEN local = lag(local) OVER (PARTITION BY sig ORDER BY o) THEN 0 ELSE 1 END AS s FROM stmt))
        GROUP BY sig, run, local
""")
def merge_runs(f):
    return semantic.merge_runs(f.stmt.select("sig", F.col("o").alias("ord"), "local"), "local")


@query("""
    SELECT sig, CAST(line AS BIGINT) AS line, string_agg(call, ',' ORDER BY o, pos) AS calls
        FROM (SELECT *, min(o) OVER (PARTITION BY sig, line, call) AS first
        FROM (SELECT sig, o // 4 AS line, o, unnest([0, 1]) AS pos, unnest([local, local || '2']) AS call FROM stmt))
        WHERE o = first GROUP BY sig, line
""")
def merge_source_trace(f):
    rows = f.stmt.select(
        "sig", F.col("o").alias("ord"), F.floor(F.col("o") / 4).alias("line"),
        F.array("local", F.concat("local", F.lit("2"))).alias("calls"), F.lit(None).cast("string").alias("branch"),
    )
    return semantic.merge_trace(rows).select("sig", "line", F.array_join("calls", ",").alias("calls"))


_BODY = f"""
    m AS ({_MERGED}), b AS (SELECT DISTINCT sig, block, CASE
        WHEN block % 3 = 0 THEN 'c' || CAST(block AS VARCHAR) END AS cond FROM (SELECT sig, block FROM m UNION ALL
        SELECT sig, max(block) + 1 FROM m GROUP BY sig)),
    x AS (SELECT b.sig, b.block, b.cond, m.line, m.calls, m.assigns, row_number() OVER (PARTITION BY b.sig, b.block
        ORDER BY m.line) - 1 AS pos, lead(1) OVER (PARTITION BY b.sig, b.block ORDER BY m.line) IS NULL AS last FROM b
        LEFT JOIN m ON m.sig = b.sig AND m.block = b.block),
    body AS (SELECT sig, row_number() OVER (PARTITION BY sig ORDER BY block, pos) - 1 AS seq, block, line,
        CASE WHEN last AND cond IS NOT NULL THEN 'branch' WHEN line IS NULL THEN 'plain' WHEN calls <> '' THEN 'call'
            WHEN assigns <> '' THEN 'assign' ELSE 'plain' END AS kind FROM x)"""


def _body(f):
    merged = semantic.merge_statements(_stmts(f))
    extra = merged.groupBy("sig").agg((F.max("block") + 1).alias("block"))
    found = merged.select("sig", "block").union(extra).distinct()
    cond = F.when(F.col("block") % 3 == 0, F.concat(F.lit("c"), F.col("block").cast("string")))
    bl = found.select(
        "sig", F.col("block").alias("block_ord"), cond.alias("condition"), F.col("block").cast("string").alias("block"),
    )
    return semantic.body_nodes(
        merged.withColumn("block", F.col("block").cast("string")), bl.select("sig", "block", "block_ord", "condition"),
    )


@query(f"WITH {_BODY} SELECT sig, seq, CAST(block AS VARCHAR) AS block, line, kind FROM body")
def semantic_nodes(f):
    return _body(f).select("sig", "seq", "block", "line", "kind")


@query("""
    SELECT sig, line, 'L' || CAST(line AS VARCHAR) || coalesce('|' || string_agg(CASE
        WHEN call IS NOT NULL THEN regexp_extract(call, '([^.]+\\.[^.]+)$', 1) END, '|' ORDER BY call), CASE
        WHEN count(call) = 0 THEN '|' || string_agg(assign, '|' ORDER BY ord) END, '') AS label
        FROM (""" + _STMTS + """) GROUP BY sig, block, line
""")
def node_label(f):
    rows = semantic.merge_statements(_stmts(f))
    return rows.select(
        "sig", "line", F.array_join(S.node_label(F.col("line"), F.col("calls"), F.col("assigns")), "|").alias("label"),
    )


@query(f"""
    SELECT sig, block, line, CASE WHEN branches <> '' THEN 'branch' WHEN calls <> '' THEN 'call'
        WHEN assigns <> '' THEN 'assign' ELSE 'plain' END AS kind FROM ({_MERGED})
""")
def node_kind(f):
    return semantic.merge_statements(_stmts(f)).select(
        "sig", "block", "line", S.node_kind(F.col("calls"), F.col("branches"), F.col("assigns")).alias("kind"),
    )


@query(f"""
    WITH {_BODY}, i AS (SELECT DISTINCT CAST(sig % 7 AS BIGINT) AS trace, sig FROM body),
        z AS (SELECT i.trace, i.sig, count(*) AS n FROM i JOIN body USING (sig) GROUP BY ALL),
        s AS (SELECT trace, sig, coalesce(sum(n) OVER (PARTITION BY trace ORDER BY sig ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) AS base FROM z)
        SELECT s.trace, body.sig, seq, 'n' || CAST(CAST(base + seq AS BIGINT) AS VARCHAR) AS id FROM s
        JOIN body USING (sig)
""")
def semantic_ids(f):
    body = _body(f)
    inst = (
        body.select((F.col("sig") % 7).cast("long").alias("trace"), "sig")
        .distinct()
        .withColumn("path", F.array(F.col("sig").cast("int")))
    )
    return semantic.number_nodes(inst, body).select("trace", "sig", "seq", "id")


@query(f"""
    WITH {_BODY} SELECT sig, CAST(block AS VARCHAR) AS block, min(seq) AS first, max(seq) AS last FROM body GROUP BY ALL
""")
def block_first_last(f):
    return semantic.first_last(_body(f))


@query(f"""
    WITH {_BODY} SELECT * FROM (SELECT sig, seq AS src, lead(seq) OVER (PARTITION BY sig, block ORDER BY seq) AS dst
        FROM body) WHERE dst IS NOT NULL
""")
def intra_block_edges(f):
    return semantic.intra_edges(_body(f))


_BE = "SELECT DISTINCT sig, CAST(src // 8 AS BIGINT) AS a, CAST(dst // 8 AS BIGINT) AS b, label FROM flow_edge"


@query(f"""
    WITH {_BODY}, e AS (SELECT sig, block, min(seq) AS first, max(seq) AS last FROM body GROUP BY ALL), g AS ({_BE})
        SELECT DISTINCT g.sig, x.last AS src, y.first AS dst, coalesce(g.label, '') AS label FROM g
        JOIN e x ON x.sig = g.sig AND x.block = g.a JOIN e y ON y.sig = g.sig AND y.block = g.b WHERE x.last <> y.first
""")
def inter_block_edges(f):
    text = lambda c: F.floor(F.col(c) / 8).cast("string").alias(c)
    edges = f.flow_edge.select("sig", text("src"), text("dst"), "label").distinct()
    return semantic.inter_edges(edges, _body(f)).select(
        "sig", "src", "dst", F.coalesce("label", F.lit("")).alias("label"),
    )


@query(f"""
    WITH r AS ({_ROLES}) SELECT t.sig, t.trap_idx, x.role, regexp_extract(t.type, '([^.]+)$', 1) AS trap_type, coalesce((SELECT string_agg(CAST(r.block AS VARCHAR), ','
        ORDER BY r.block) FROM r WHERE r.sig = t.sig AND r.trap_idx = t.trap_idx AND r.role = x.role), '') AS nodes
        FROM trap t, (SELECT 'try' AS role UNION ALL SELECT 'handler') x
""")
def trap_clusters(f):
    nodes = f.stmt.select("sig", F.col("o").alias("block"), F.col("o").alias("seq"))
    out = semantic.clusters(blocks.assign_clusters(f.cover, _handlers(f)), f.trap, nodes)
    return out.select(
        "sig", "trap_idx", "role", "trap_type",
        F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"),
    )


@query(f"""
    WITH r AS ({_ROLES}) SELECT t.sig, t.trap_idx, coalesce((SELECT min(block) FROM r WHERE r.sig = t.sig
        AND r.trap_idx = t.trap_idx AND role = 'try'), (SELECT min(block) FROM cover c WHERE c.sig = t.sig
        AND c.trap_idx = t.trap_idx)) AS src, t.handler AS dst FROM trap t
""")
def exception_edges(f):
    nodes = f.stmt.select("sig", F.col("o").alias("block"), F.col("o").alias("block_ord"), F.col("o").alias("seq"))
    return semantic.exception_edges(
        blocks.assign_clusters(f.cover, _handlers(f)), f.cover, f.trap, nodes,
    ).select("sig", "trap_idx", "src", "dst")


@query("""
    SELECT CAST(0 AS BIGINT) AS trace, coalesce(x.id, 'm' || CAST(c.p AS VARCHAR) || '.1') AS src,
        'e' || CAST(c.k AS VARCHAR) AS dst
        FROM (SELECT o_custkey AS p, o_orderkey AS k, o_orderkey % 40 AS line FROM orders WHERE o_custkey IN (SELECT sig
        FROM stmt)) c
    LEFT JOIN (SELECT sig, o // 2 AS line, 'm' || CAST(sig AS VARCHAR) || '.' || CAST(max(o) AS VARCHAR) AS id FROM stmt
        GROUP BY sig, o // 2) x ON x.sig = c.p AND x.line = c.line""")
def drilldown_edges(f):
    name = F.concat(F.lit("m"), F.col("sig").cast("string"), F.lit("."), F.col("o").cast("string"))
    zero = F.lit(0).cast("long").alias("trace")
    parents = f.stmt.select(
        zero, F.array("sig").alias("path"), name.alias("id"), F.col("o").alias("seq"),
        F.floor(F.col("o") / 2).alias("line"),
    )
    kids = f.orders.select(
        zero, F.array("o_orderkey").alias("path"), F.array("o_custkey").alias("parent_path"),
        (F.col("o_orderkey") % 40).alias("call_line"),
        F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("entry"),
    )
    return semantic.drilldown(parents, kids).select("trace", "src", "dst")


# Validation


def _sem(f):
    nodes = f.stmt.select(
        F.lit(0).alias("trace"), F.col("sig").alias("method"),
        F.when(F.col("o") == 9, 8).otherwise(F.col("o")).cast("string").alias("id"),
        F.when(F.col("local") == "error", "branch").otherwise("call").alias("kind"),
    )
    edges = f.flow_edge.select(
        F.lit(0).alias("trace"), F.col("sig").alias("method"), F.col("src").cast("string").alias("src"),
        F.col("dst").cast("string").alias("dst"), F.col("label").alias("branch"),
        F.lit(None).cast("string").alias("kind"),
    )
    return nodes, edges


_SN = """(SELECT sig AS method, CAST(CASE WHEN o = 9 THEN 8 ELSE o END AS VARCHAR) AS id, CASE
        WHEN local = 'error' THEN 'branch' ELSE 'call' END AS kind FROM stmt)"""
_SE = "(SELECT sig AS method, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, label FROM flow_edge)"


@query(f"SELECT method, id AS node_id FROM {_SN} GROUP BY ALL HAVING count(*) > 1")
def validate_dup_ids(f):
    return validate.duplicate_ids(_sem(f)[0]).select("method", "node_id")


@query("""
    SELECT sig AS method, CAST(node AS VARCHAR) AS node_id FROM (SELECT sig, src AS node FROM flow_edge UNION ALL
        SELECT sig, dst FROM flow_edge) WHERE node NOT IN (SELECT o FROM stmt WHERE o <> 9)
""")
def validate_dangling(f):
    nodes, edges = _sem(f)
    return validate.dangling_edges(nodes, edges).select("method", "node_id")


@query(f"""
    SELECT method, n.id AS node_id FROM {_SN} n WHERE kind = 'branch'
        AND coalesce((SELECT string_agg(coalesce(label, ''), ',' ORDER BY coalesce(label, '')) FROM {_SE} e
        WHERE e.method = n.method AND e.src = n.id), '') <> 'F,T'
""")
def validate_branch(f):
    return validate.branch_edges(*_sem(f)).select("method", "node_id")


@query(f"""
    SELECT n.method, n.id AS node_id FROM {_SN} n WHERE n.id <> '1' AND NOT EXISTS (SELECT 1 FROM {_SE} e
        WHERE e.method = n.method AND e.dst = n.id)
""")
def validate_reachability(f):
    nodes, edges = _sem(f)
    entries = nodes.select("trace", "method").distinct().withColumn("id", F.lit("1"))
    return validate.unreachable(nodes, edges, edges.limit(0), entries).select("method", "node_id")


# Pages


@query("""
    SELECT jsp, el, regexp_extract(el, '^[#$]\\{\\s*([a-zA-Z_]\\w*)', 1) AS bean, regexp_extract(el,
        '^[#$]\\{\\s*([a-zA-Z_]\\w*)(?:\\.([a-zA-Z_]\\w*))?', 2) AS member
        FROM el
""")
def el_classify(f):
    return f.el.select("jsp", "el", S.el_bean(F.col("el")).alias("bean"), S.el_member(F.col("el")).alias("member"))


_ACT = """
    (SELECT jsp, el, regexp_extract(el, '^[#$]\\{\\s*([a-zA-Z_]\\w*)', 1) AS bean_name, regexp_extract(el,
        '^[#$]\\{\\s*([a-zA-Z_]\\w*)(?:\\.([a-zA-Z_]\\w*))?', 2) AS member
        FROM el)"""


def _actions(f):
    return (
        f.el.withColumn("bean_name", S.el_bean(F.col("el")))
        .withColumn("member", S.el_member(F.col("el")))
        .where("bean_name <> ''")
    )


@query(f"""
    SELECT a.jsp, a.el, m.sig FROM {_ACT} a JOIN bean b ON b.bean_name = a.bean_name JOIN method m ON m.class = b.fqcn
        AND contains(m.sig, ' ' || a.member || '(') WHERE a.member <> ''
""")
def bean_join(f):
    return web.bean_methods(_actions(f), f.bean, f.method.select("sig")).select("jsp", "el", "sig")


@query(f"""
    WITH RECURSIVE a AS {_ACT}, k AS (SELECT a.jsp, a.el, a.bean_name, a.member, b.fqcn FROM a
        JOIN bean b ON b.bean_name = a.bean_name WHERE member <> ''),
    s AS (SELECT DISTINCT k.jsp, k.el, e.src AS sig FROM k
        JOIN call_edge e ON regexp_extract(e.src, '^<([^:]+):', 1) = k.fqcn
        AND contains(e.src, ' ' || k.member || '(')),
    w(node) AS (SELECT sig FROM s WHERE regexp_matches(sig, '^<com\\.(economy|small|standard)\\.') UNION SELECT e.dst
        FROM w JOIN call_edge e ON e.src = w.node WHERE regexp_matches(e.dst, '^<com\\.(economy|small|standard)\\.'))
    SELECT 'jsp:/' || jsp AS node, 'jsp' AS node_type FROM a WHERE bean_name <> '' UNION
        SELECT 'el:/' || jsp || '#' || el, 'el_expression' FROM k UNION SELECT node, 'java_method' FROM w""")
def page_map_nodes(f):
    return web.page_map(_actions(f), f.bean, f.call_edge, NARROW)[0]


_INCLUDED = """
    SELECT jsp, regexp_extract(html,
        '<(?:jsp:include[^>]*[[:space:]]page|c:import[^>]*[[:space:]]url|ui:include[^>]*[[:space:]]src|%@ *include[^>]*[[:space:]]file)[[:space:]]*=[[:space:]]*"([^"]*)"', 1, 'i') AS path
        FROM web_page"""
_LINKED = f"""inc AS ({_INCLUDED}),
    link AS (SELECT jsp AS src, CASE WHEN starts_with(path, '/') THEN substr(path, 2)
        WHEN starts_with(path, '../') THEN substr(path, 4) ELSE split_part(jsp, '/', 1) || '/' || path END AS dst
        FROM inc WHERE path <> '' AND NOT starts_with(path, 'http')),
    edge AS (SELECT DISTINCT src, dst FROM link WHERE dst IN (SELECT jsp FROM web_page))"""


@query(f"SELECT jsp, path FROM ({_INCLUDED}) WHERE path <> ''")
def include_paths(f):
    return web.include_paths(f.web_page)


@query(f"WITH {_LINKED} SELECT src, dst FROM edge")
def include_links(f):
    return web.resolve_includes(web.include_paths(f.web_page), f.web_page)


@query(f"""
    WITH RECURSIVE {_LINKED}, w(root, jsp) AS (SELECT jsp, jsp FROM web_page UNION SELECT w.root, e.dst FROM w
        JOIN edge e ON e.src = w.jsp) SELECT jsp, count(*) AS n FROM w GROUP BY jsp
""")
def include_closure(f):
    """How many pages include a page, over any number of steps."""
    pages = f.web_page
    edges = web.resolve_includes(web.include_paths(pages), pages)
    got = reach.closure(edges, pages.select(F.col("jsp").alias("root"), F.col("jsp").alias("node")))
    return got.groupBy(F.col("node").alias("jsp")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH RECURSIVE {_LINKED}, w(jsp) AS (SELECT min(jsp) FROM web_page UNION SELECT e.dst FROM w
        JOIN edge e ON e.src = w.jsp) SELECT jsp FROM w
""")
def included_pages(f):
    pages = f.web_page
    start = pages.agg(F.min("jsp").alias("jsp"))
    return web.include_closure(web.resolve_includes(web.include_paths(pages), pages), start)


# Inter-procedural control flow


_CN = "(SELECT DISTINCT src AS sig, unnest([1, 2, 3]) AS node FROM call_edge)"


@query(f"""
    WITH RECURSIVE n AS {_CN}, i AS (SELECT src AS sig, 2 AS node, dst AS callee FROM call_edge WHERE dst IN (SELECT sig
        FROM n) AND NOT starts_with(dst, '<com.economy.')),
    inst(sig, depth) AS (SELECT sig, CAST(0 AS BIGINT) FROM root UNION SELECT i.callee, inst.depth + 1 FROM inst
        JOIN i ON i.sig = inst.sig WHERE inst.depth < 3),
    c AS (SELECT DISTINCT inst.sig, inst.depth, i.callee FROM inst JOIN i ON i.sig = inst.sig WHERE inst.depth < 3)
    SELECT sig AS src_sig, depth AS src_depth, CAST(e AS BIGINT) AS src, sig AS dst_sig, depth AS dst_depth,
        CAST(e + 1 AS BIGINT) AS dst, 'INTRA' AS kind
        FROM inst, (SELECT 1 AS e UNION ALL SELECT 2) WHERE NOT (e = 2 AND EXISTS (SELECT 1 FROM c
        WHERE c.sig = inst.sig AND c.depth = inst.depth))
    UNION ALL SELECT sig, depth, 2, callee, depth + 1, 1, 'CALL' FROM c UNION ALL
        SELECT callee, depth + 1, 3, sig, depth, 3, 'RETURN' FROM c""")
def icfg_edges(f):
    own = f.call_edge.select(F.col("src").alias("sig")).distinct()
    nodes = own.select(
        "sig", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("node"),
    ).withColumn("ord", F.col("node"))
    edges = nodes.where("node < 3").select("sig", F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    calls = f.call_edge.select(
        F.col("src").alias("sig"), F.lit(2).cast("long").alias("node"), "ord", F.col("dst").alias("callee"),
    )
    root = f.root.first()["sig"]
    return icfg.icfg(nodes, edges, calls, root, 3, S.Stop.prefix("<com.economy.")(F.col("callee")))[1]


@query("""
    SELECT CAST(caller_n AS BIGINT) AS n_callers, CAST(e AS BIGINT) AS n_edges
        FROM (SELECT count(DISTINCT src) AS caller_n, count(*) AS e FROM call_edge)
""")
def edge_totals(f):
    return f.call_edge.agg(F.countDistinct("src").alias("n_callers"), F.count(F.lit(1)).alias("n_edges"))


@query("""
    WITH RECURSIVE k AS (SELECT caller, callee, ord, row_number() OVER (PARTITION BY caller
        ORDER BY ord) AS pos, lead(ord) OVER (PARTITION BY caller ORDER BY ord) IS NULL AS last FROM body_call),
    w(top, place, sig, above, indent, text, open) AS (SELECT DISTINCT caller, '', caller, [caller], '', caller, true
        FROM k WHERE starts_with(caller, 'r')
        UNION ALL SELECT w.top, w.place || CASE WHEN w.place = '' THEN ''
            ELSE '.' END || CAST(k.pos AS VARCHAR), k.callee, list_append(w.above, k.callee), w.indent || CASE
            WHEN k.last THEN '    ' ELSE '│   ' END,
            w.indent || CASE WHEN k.last THEN '└── ' ELSE '├── ' END || k.callee || CASE
                WHEN k.ord > 0 THEN ':' || CAST(k.ord AS VARCHAR) ELSE '' END, NOT list_contains(w.above, k.callee)
                FROM w JOIN k ON k.caller = w.sig WHERE w.open)
    SELECT top, place, text FROM w""")
def ascii_call_tree(f):
    """Indented lines of the trees below regions."""
    from ..operators.render import ascii_tree

    edges = f.body_call.select(
        F.col("caller").alias("src"), F.col("callee").alias("dst"), "ord", F.col("ord").alias("call_line"),
        F.lit(False).alias("cycle"),
    )
    nodes = (
        edges.select(F.col("src").alias("node"))
        .union(edges.select("dst"))
        .distinct()
        .withColumn("label", F.col("node"))
    )
    return ascii_tree(nodes, edges).select(
        "top", F.array_join(F.transform("ord_path", lambda x: x.cast("string")), ".").alias("place"), "text",
    )


from . import detail  # noqa: E402, F401  registers its queries
