"""Queries of single operators that the larger queries use or leave out, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import signatures as S
from ..functions.el import el_expressions
from ..operators import blocks, callgraph, calltree, dataflow, icfg, reach, render, trace, validate, xtrace
from ..sources import classes, documents, scip
from .queries import _CHAINS, _FROM_TO, _SE, _SN, _TREE, NARROW, _big, _chains, _handlers, _lines, _root, _sem, query
from .storage import fresh_path

# Names


@query(r"""
    SELECT sig, replace(regexp_extract(sig, '^<([^:]+):', 1), '.', '/') || '#' || name AS symbol, regexp_replace(sig,
        '[^a-zA-Z0-9_]', '_', 'g') AS id,
           replace(replace(replace('"' || sig || '"' || chr(10), '\', '\\'), '"', '\"'), chr(10), '\n') AS shown
    FROM method""")
def symbols(f):
    sig = F.col("sig")
    shown = S.dot_escaped(F.concat(F.lit('"'), sig, F.lit('"\n')))
    return f.method.select(
        "sig", S.source_symbol(sig).alias("symbol"), S.sanitized(sig).alias("id"), shown.alias("shown"),
    )


@query("""
    SELECT sig, CASE WHEN regexp_matches(class, 'economy') THEN 'service'
        WHEN regexp_matches(class, 'Brand1') THEN 'dao' ELSE '' END AS layer FROM method
""")
def layers(f):
    return f.method.select("sig", S.layer(F.col("class"), {"service": "economy", "dao": "Brand1"}).alias("layer"))


@query("""
    SELECT sig, class = 'com.economy.Brand11' AND line_start <= 5000 AND 5000 <= line_end
        OR class = 'com.small.Brand12' AS hit FROM method
""")
def node_match(f):
    return f.method.select(
        "sig", (trace.matches("com.economy.Brand11", 5000) | trace.matches("com.small.Brand12")).alias("hit"),
    )


@query("SELECT event_id, event_id & 1 <> 0 AS defines FROM events")
def role_mask(f):
    return f.events.select("event_id", S.is_definition(F.col("event_id")).alias("defines"))


@query(r"""
    SELECT jsp, CAST(i - 1 AS BIGINT) AS pos, found[i] AS el
    FROM (SELECT jsp, found, unnest(range(1, len(found) + 1)) AS i
        FROM (SELECT jsp, regexp_extract_all('a ' || el || ' b #{x[''}''].y} #{open {',
            '[#$]\{(?:[^{}''"]|''[^'']*''|"[^"]*"|\{[^{}]*\})*\}') AS found
            FROM el))""")
def el_tokenize(f):
    """Braces and quotes nest at most once in these texts, so that a pattern finds them, too."""
    texts = f.el.select("jsp", F.concat(F.lit("a "), "el", F.lit(" b #{x['}'].y} #{open {")).alias("text"))
    return el_expressions(texts).select("jsp", F.col("pos").cast("long").alias("pos"), "el")


# Classes and lines


@query("SELECT class, count(*) AS n FROM method WHERE starts_with(class, 'com.s') GROUP BY class")
def class_methods(f):
    return classes.method_counts(classes.project_classes(f.method, "com.s"))


@query("""
    WITH l AS (SELECT sig, CAST(o // 7 AS BIGINT) AS line, count(*) AS n FROM stmt GROUP BY ALL)
    SELECT sig, min(CASE WHEN line > 0 THEN line END) AS line_start, max(line) AS line_end, count(*) AS source_lines,
        CAST(sum(n) AS BIGINT) AS stmt_count, string_agg(line || '=' || n, ','
        ORDER BY line) AS line_map
    FROM l GROUP BY sig HAVING max(line) > 0""")
def line_maps(f):
    stmts = f.stmt.select("sig", F.floor(F.col("o") / 7).alias("line"))
    methods = stmts.select("sig", F.lit("C").alias("class"), F.lit("m").alias("name")).distinct()
    pairs = F.transform(
        F.map_entries("line_map"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")),
    )
    rows = callgraph.line_map(methods, stmts)
    return rows.select(
        "sig", *_big("line_start", "line_end"), "source_lines", "stmt_count",
        F.array_join(pairs, ",").alias("line_map"),
    )


# Resolution


@query("SELECT sig, count(*) OVER () AS overloads FROM overload WHERE class = 'BUILDING' AND name = 'c5'")
def resolve_by_name(f):
    return callgraph.resolve_by_name(f.overload, "BUILDING", "c5")


@query("""
    SELECT s.id, coalesce(e.sig, l.sig) AS sig
    FROM site s LEFT JOIN (SELECT class, sub_sig, arg_min(sig, ord) AS sig FROM overload
        GROUP BY ALL) e ON e.class = s.class AND e.sub_sig = s.sub_sig
    LEFT JOIN (SELECT class, name, arity, arg_min(sig, ord) AS sig FROM overload GROUP BY ALL) l ON l.class = s.class
        AND l.name = s.name AND l.arity = s.arity""")
def resolve_callees(f):
    return callgraph.resolve_callees(f.site, f.overload).select("id", "sig")


@query("SELECT DISTINCT sig FROM overload WHERE starts_with(sig, '<MACHINERY: ') AND contains(sig, ' c7(')")
def entry_signatures(f):
    return callgraph.entries_of(f.overload.select(F.col("sig").alias("caller")), "MACHINERY", "c7")


@query("SELECT class, name, arg_min(sig, ord) AS sig FROM overload GROUP BY class, name")
def first_overload(f):
    return callgraph.first_of(f.overload, ["class", "name"], ["ord"]).select("class", "name", "sig")


@query("""
    SELECT sig, ord, sig || '#s' || CAST(row_number() OVER (PARTITION BY sig ORDER BY ord) - 1 AS VARCHAR) AS id
        FROM (SELECT CAST(sig AS VARCHAR) AS sig, o AS ord FROM stmt)
""")
def statement_ids(f):
    return dataflow.number_statements(
        f.stmt.select(F.col("sig").cast("string").alias("sig"), F.col("o").alias("ord"))
    ).select("sig", "ord", "id")


# Calls


@query("""
    SELECT c.src AS caller, c.dst AS callee, c.call_line, m.class, m.name, CAST(m.line_start AS BIGINT) AS line_start,
        CAST(m.line_end AS BIGINT) AS line_end
    FROM call_edge c LEFT JOIN method m ON m.sig = c.dst""")
def edges_with_lines(f):
    edges = f.call_edge.select(F.col("src").alias("caller"), F.col("dst").alias("callee"), "call_line")
    return callgraph.with_lines(edges, f.method).select(
        "caller", "callee", "call_line", "class", "name", *_big("line_start", "line_end"),
    )


_NAMED = "SELECT c.src AS caller, c.dst AS callee, m.class, m.name FROM call_edge c JOIN method m ON m.sig = c.dst"
_CALLED = """SELECT c.src AS caller, c.call_line AS line,
    CASE WHEN c.ord % 3 = 0 THEN 'other.X.' || m.name WHEN c.ord % 3 = 1 THEN m.class || '.' || m.name
        ELSE m.class || '.none' END AS call
    FROM call_edge c JOIN method m ON m.sig = c.dst"""


@query(f"""
    WITH t AS ({_CALLED}), c AS ({_NAMED}),
    e AS (SELECT c.caller, c.callee, min(t.line) AS l FROM c JOIN t ON t.caller = c.caller
        AND t.call = c.class || '.' || c.name GROUP BY ALL),
    o AS (SELECT c.caller, c.callee, min(t.line) AS l FROM c JOIN t ON t.caller = c.caller
        AND regexp_extract(t.call, '([^.]*)$', 1) = c.name GROUP BY ALL)
    SELECT c.caller, c.callee, coalesce(e.l, o.l) AS call_line
    FROM c LEFT JOIN e ON e.caller = c.caller AND e.callee = c.callee LEFT JOIN o ON o.caller = c.caller
        AND o.callee = c.callee""")
def callsite_lines(f):
    return callgraph.callsite_line(f.sql(_NAMED), f.sql(_CALLED)).select("caller", "callee", "call_line")


@query(f"""
    SELECT i.caller, i.name, d.file, CAST(d.line_start AS BIGINT) AS line_start
    FROM ({_NAMED}) i JOIN (SELECT sig, class || '.java' AS file, line_start FROM method
        WHERE NOT is_bridge) d ON d.sig = i.callee""")
def defined_calls(f):
    symbol = F.concat(F.lit("semanticdb maven . . "), S.source_symbol(F.col("sig")), F.lit("()."))
    index = f.method.where("not is_bridge").select(
        symbol.alias("symbol"), F.concat("class", F.lit(".java")).alias("file"), "line_start", "line_end",
    )
    found = icfg.defined_calls(f.sql(_NAMED), index.withColumn("key", scip.symbol_key(F.col("symbol"))))
    return found.select("caller", "name", "file", *_big("line_start"))


@query("SELECT src, dst, ord, call_line FROM call_edge")
def call_graph_round_trip(f):
    """Written as documents, a caller each, and read again."""
    path = fresh_path(f.spark, "call-graph")
    documents.write_call_graph(f.call_edge, f.method.select("sig", "line_start", "line_end"), path)
    return documents.call_graph(f.spark, path, rows=True)[0]


@query("SELECT sig, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end FROM method")
def line_round_trip(f):
    path = fresh_path(f.spark, "call-graph")
    documents.write_call_graph(f.call_edge, f.method.select("sig", "line_start", "line_end"), path)
    return documents.call_graph(f.spark, path, rows=True)[1].select("sig", *_big("line_start", "line_end"))


@query("""
    SELECT r.sub || '.' || i.name AS callee, count(*) AS n FROM (SELECT decl_class, name FROM invoke
        WHERE NOT special) i JOIN class_rel r ON r.super = i.decl_class GROUP BY ALL
""")
def call_graph_fan_out(f):
    """The call graph as a whole: dispatch, bridges, lines; here how many callsites lead to each method."""
    methods = f.impl_method.withColumns({"is_bridge": F.lit(False), "line_start": F.lit(1), "line_end": F.lit(9)})
    sites = f.invoke.withColumn("caller", F.concat("caller", F.col("ord").cast("string")))
    edges, _ = xtrace.call_graph(methods, sites, f.class_rel)
    name = F.concat(S.class_of(F.col("dst")), F.lit("."), S.method_of(F.col("dst")))
    return edges.groupBy(name.alias("callee")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH RECURSIVE walk(node) AS (SELECT sig FROM root
        UNION SELECT e.dst FROM walk w JOIN call_edge e ON e.src = w.node WHERE NOT starts_with(e.dst, '<com.economy.')
            AND e.dst NOT IN (SELECT sig FROM bridge))
    SELECT e.src, e.dst, nullif(greatest(e.call_line - 1, 0), 0) AS call_line, NOT (starts_with(e.dst, '<com.economy.')
        OR e.dst IN (SELECT sig FROM bridge)) OR e.dst IN (SELECT sig FROM root) AS inside
    FROM walk w JOIN call_edge e ON e.src = w.node""")
def leaf_markers(f):
    """Exactly one of ref, cycle and filtered; lines that aren't positive go."""
    known = f.method.where("not is_bridge").select("sig")
    edges = f.call_edge.withColumn("call_line", F.col("call_line") - 1)
    _, calls = calltree.discover(edges, _root(f), known, S.may_recurse(S.class_of(F.col("dst")), [], ["com.economy."]))
    one = F.col("ref").cast("int") + F.col("cycle").cast("int") + F.col("filtered").cast("int") == 1
    return (
        calltree.leaf_markers(calls)
        .where(one)
        .select("src", "dst", "call_line", (F.col("ref") | F.col("cycle")).alias("inside"))
    )


@query(f"""
    {_TREE} SELECT w.node, regexp_extract(w.node, '^<([^:]+):', 1) AS class, m.name AS method,
        CAST(m.line_start AS BIGINT) AS line_start, CAST(m.line_end - m.line_start + 1 AS BIGINT) AS source_lines
    FROM (SELECT DISTINCT node FROM walk) w JOIN method m ON m.sig = w.node""")
def described_nodes(f):
    nodes = calltree.forward_nodes(f.call_edge, _root(f), NARROW, 6)
    return calltree.describe(nodes, f.method).select("node", "class", "method", *_big("line_start", "source_lines"))


@query(f"""
    {_CHAINS}, c AS (SELECT path FROM p JOIN t ON p.node = t.sig WHERE n > 1),
        s AS (SELECT DISTINCT path[i] AS src, path[i + 1] AS dst FROM (SELECT path, unnest(range(1, len(path))) AS i
        FROM c))
    SELECT s.src, s.dst, f.call_line FROM s JOIN flat_call f ON f.caller = s.src AND f.callee = s.dst""")
def rev_calltree(f):
    """From a line to its method, to its callers up to three levels, to their chains."""
    by = Window.partitionBy("caller").orderBy("callee")
    edges = f.flat_call.select(
        F.col("caller").alias("src"), F.col("callee").alias("dst"), F.row_number().over(by).alias("ord"), "call_line",
    )
    target = f.method.join(edges.agg(F.max("dst").alias("sig")), "sig").first()
    own = f.method.where(F.col("sig") == target["sig"])
    _, calls, _ = calltree.reverse_trace(edges, own, target["class"], target["line_start"], 3, None)
    return calls.select("src", "dst", "call_line")


# Blocks


@query("""
    WITH RECURSIVE far(sig, node, d) AS (SELECT sig, o, 0 FROM stmt WHERE o = 30
        UNION SELECT f.sig, e.src, f.d + 1 FROM far f JOIN flow_edge e ON e.sig = f.sig AND e.dst = f.node
            WHERE f.d < 40),
    least AS (SELECT sig, node, min(d) AS d FROM far GROUP BY sig, node),
    way(sig, node, d, path) AS (SELECT sig, o, 0, [o] FROM stmt WHERE o = 30
        UNION SELECT w.sig, l.node, l.d, list_append(w.path, l.node) FROM way w JOIN flow_edge e ON e.sig = w.sig
            AND e.dst = w.node JOIN least l ON l.sig = e.sig AND l.node = e.src AND l.d = w.d + 1),
    first AS (SELECT sig, path FROM (SELECT sig, path, row_number() OVER (PARTITION BY sig ORDER BY path) AS k FROM way
        WHERE node = 5) WHERE k = 1)
    SELECT sig, line, count(*) AS n FROM (SELECT sig, unnest(path) AS line FROM first) GROUP BY ALL""")
def line_trace(f):
    """A breadth-first search's parents give the least of the shortest ways, read from its end."""
    return blocks.line_trace(f.flow_edge.select("sig", "src", "dst"), _lines(f), 5, 30)


@query(f"""
    {_FROM_TO}, handled AS (SELECT sig, handler AS block, trap_idx FROM trap)
    SELECT DISTINCT sig, trap_idx FROM (SELECT sig, trap_idx, block FROM cover UNION ALL SELECT sig, trap_idx, block
        FROM handled) x WHERE EXISTS (SELECT 1 FROM kept k WHERE k.sig = x.sig AND k.node = x.block)""")
def slice_traps(f):
    return blocks.slice_traps(
        f.cover, _handlers(f), blocks.between_lines(f.flow_edge, _lines(f), 5, 30).select("sig", "block"),
    )


@query("""
    SELECT sig, block, 'B' || CAST(n AS VARCHAR) AS id, n AS block_ord
        FROM (SELECT sig, block, row_number() OVER (PARTITION BY sig ORDER BY min(ord)) - 1 AS n FROM ir
        GROUP BY sig, block)
""")
def block_numbers(f):
    return blocks.number_blocks(f.ir)


_BRANCH = "CASE WHEN condition IS NOT NULL THEN condition WHEN is_switch THEN 'switch' END AS branch"


@query(f"SELECT sig, ord, coalesce(line, -1) AS line, call_target, arg_count, {_BRANCH} FROM ir")
def statement_details(f):
    return blocks.statement_details(f.ir).select("sig", "ord", "line", "call_target", "arg_count", "branch")


@query(f"""
    SELECT sig, ord, coalesce(line, -1) AS line, call_target AS call, {_BRANCH},
           CASE WHEN call_target IS NULL AND lhs IS NOT NULL AND NOT contains(rhs, '$stack') AND NOT contains(rhs, '.<')
               AND NOT starts_with(lhs, '$stack') THEN lhs || ' = ' || rhs END AS assign
    FROM ir""")
def projected_statements(f):
    return blocks.project_statements(f.ir).select("sig", "ord", "line", "call", "branch", "assign")


@query("""
    WITH tail AS (SELECT sig, block, arg_max(coalesce(condition, ''), ord) AS condition, arg_max(is_switch,
        ord) AS is_switch
        FROM ir GROUP BY sig, block),
    temp AS (SELECT sig, block, arg_min(returns_boolean, ord) AS truth FROM ir WHERE lhs = '$stack1'
        GROUP BY sig, block)
    SELECT t.sig, t.block, CASE WHEN t.condition = '' THEN 'switch' WHEN truth IS NULL THEN t.condition
        WHEN truth THEN 'Cls1.m() == false' ELSE 'Cls1.m() == 0' END AS condition
    FROM tail t LEFT JOIN temp ON temp.sig = t.sig AND temp.block = t.block WHERE t.condition <> '' OR t.is_switch""")
def branch_conditions(f):
    return blocks.branch_conditions(f.ir)


_SUCC = """SELECT sig, block, succ, row_number() OVER (PARTITION BY sig, block ORDER BY succ) - 1 AS pos
    FROM (SELECT DISTINCT sig, CAST(floor(src / 8) AS BIGINT) AS block, CAST(floor(dst / 8) AS BIGINT) AS succ
        FROM flow_edge)"""


@query(f"""
    WITH s AS ({_SUCC}), n AS (SELECT *, count(*) OVER (PARTITION BY sig, block) AS n FROM s),
        e AS (SELECT sig, block, arg_max(coalesce(condition, ''), ord) <> '' AS is_if FROM ir GROUP BY sig, block)
    SELECT n.sig, n.block AS src, n.succ AS dst, CASE WHEN e.is_if AND n = 2 THEN CASE pos WHEN 0 THEN 'T'
        ELSE 'F' END END AS label FROM n LEFT JOIN e ON e.sig = n.sig AND e.block = n.block""")
def labelled_edges(f):
    return blocks.labelled_edges(f.sql(_SUCC), f.ir)


# Dependence


@query("""
    SELECT w.id AS src, r.id AS dst FROM ddg_node r JOIN ddg_node w ON starts_with(w.text, 'b.<')
        AND regexp_extract(r.text, '(<[^>]+>)', 1) = regexp_extract(w.text, '(<[^>]+>)', 1)
    WHERE contains(r.text, ' = b.<') AND r.sig < w.sig""")
def heap_edges_alias(f):
    """With an alias test that rules pairs out."""
    apart = lambda write_sig, write, read_sig, read: (read_sig < write_sig) & (write == read)
    return dataflow.heap_edges(f.ddg_node, f.method, alias=apart).select("src", "dst")


# Components


@query("""
    WITH RECURSIVE s AS (SELECT caller AS src, callee AS dst FROM body_call), w(a, b) AS (SELECT src, dst FROM s UNION
        SELECT w.a, s.dst FROM w JOIN s ON s.src = w.b)
    SELECT src, dst, EXISTS (SELECT 1 FROM w WHERE w.a = s.dst AND w.b = s.src) AS in_scc FROM s""")
def scc_of_many(f):
    """Many small components, by the form that takes any size."""
    return reach.in_component(
        f.body_call.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), kernel_edges=0,
    )


# Validation


@query("""
    SELECT x.sig AS method, CAST(x.trap_idx AS VARCHAR) AS node_id FROM cover x WHERE NOT EXISTS (SELECT 1 FROM stmt s
        WHERE s.sig = x.sig AND s.o = x.trap_idx AND s.o <> 9)
""")
def validate_clusters(f):
    nodes, _ = _sem(f)
    inside = f.cover.select(
        F.lit(0).alias("trace"), F.col("sig").alias("method"), F.col("trap_idx").cast("string").alias("id"),
    )
    return validate.dangling_clusters(nodes, inside).select("method", "node_id")


@query("""
    SELECT sig AS method, CAST(max(o) + sig % 2 AS VARCHAR) AS node_id FROM stmt GROUP BY sig HAVING sig % 2 = 1
        OR max(o) = 9
""")
def validate_entries(f):
    nodes, _ = _sem(f)
    entries = (
        f.stmt.groupBy(F.col("sig").alias("method"))
        .agg((F.max("o") + F.col("method") % 2).cast("string").alias("id"))
        .withColumn("trace", F.lit(0))
    )
    return validate.invalid_entries(nodes, entries).select("method", "node_id")


@query(f"""
    WITH o AS (SELECT n.method, n.id, count(e.src) AS n, max(coalesce(e.label, '')) AS label FROM {_SN} n LEFT
        JOIN (SELECT method, src, CASE WHEN CAST(dst AS INT) % 7 = 0 THEN 'F' ELSE label END AS label FROM {_SE}) e
        ON e.method = n.method AND e.src = n.id WHERE n.kind <> 'branch' AND n.id <> '8' GROUP BY n.method, n.id)
    SELECT method, id AS node_id, what FROM o JOIN (SELECT 'many' AS what UNION ALL SELECT 'label') x ON (what = 'many'
        AND n > 1) OR (what = 'label' AND label <> '')""")
def validate_plain(f):
    nodes, edges = _sem(f)
    labelled = edges.withColumn("branch", F.when(F.col("dst").cast("int") % 7 == 0, "F").otherwise(F.col("branch")))
    found = validate.plain_edges(nodes.where("id <> '8'"), labelled)
    return found.select(
        "method", "node_id", F.when(F.col("message").contains("labelled"), "label").otherwise("many").alias("what"),
    )


@query("""
    SELECT sig AS method, field, '' AS node_id FROM (SELECT sig, CASE WHEN o % 2 = 0 THEN 'nodes'
        ELSE 'edges' END AS field FROM stmt WHERE local = 'signup')
""")
def validate_leaves(f):
    field = F.when(F.col("o") % 2 == 0, "nodes").otherwise("edges").alias("field")
    rows = f.stmt.where("local = 'signup'").select(F.lit(0).alias("trace"), F.col("sig").alias("method"), field)
    return validate.leaf_fields(rows).select(
        "method", F.regexp_extract("message", r"(\w+)$", 1).alias("field"), "node_id",
    )


# Texts


_ID = "regexp_replace({}, '[^a-zA-Z0-9_]', '_', 'g')"


@query(f"""
    WITH c AS (SELECT DISTINCT src, dst, call_line = 3 AS back FROM call_edge), n AS (SELECT src AS node FROM c UNION SELECT dst FROM c)
    SELECT '  ' || {_ID.format('n.node')} || ' [label="' || m.name || '" shape='
        || CASE WHEN n.node IN (SELECT dst FROM c WHERE NOT back) THEN 'box' ELSE 'ellipse' END || '];' AS line
    FROM n JOIN method m ON m.sig = n.node
    UNION ALL SELECT '  ' || {_ID.format('src')} || ' -> ' || {_ID.format('dst')}
        || CASE WHEN back THEN ' [style=dashed color=gray];' ELSE ';' END FROM c
""")
def call_tree_lines(f):
    calls = f.call_edge.select("src", "dst", (F.col("call_line") == 3).alias("cycle"))
    ends = calls.select(F.col("src").alias("node")).union(calls.select("dst")).distinct()
    nodes = ends.join(f.method.select(F.col("sig").alias("node"), F.col("name").alias("label")), "node")
    boxes, arrows = render.call_tree_lines(nodes, calls)
    return boxes.select("line").union(arrows.select("line"))


def _name(column: str) -> str:
    return _ID.format(f"regexp_replace({column}, '#([^#]*)$', '_' || chr(92) || '1')")


@query(f"""
    WITH s AS (
        SELECT id, sig, text, kind, ord,
               regexp_extract(sig, '([^.]+):', 1) || '.' || regexp_extract(sig, '([^ ]+)\\(', 1) AS short FROM ddg_node)
    SELECT '    ' || {_name("id")} || ' [label="' || short || '\\nL' || ord || ': ' || text || '" shape='
        || CASE kind WHEN 'IDENTITY' THEN 'invhouse' WHEN 'RETURN' THEN 'house'
            WHEN 'ASSIGN_INVOKE' THEN 'box3d' ELSE 'box' END || '];' AS line FROM s
    UNION ALL SELECT '  ' || {_name("src")} || ' -> ' || {_name("dst")}
        || ' [label="LOCAL" color=black fontcolor=black];' FROM local_edge
""")
def dependence_lines(f):
    nodes = f.ddg_node.withColumn("line", F.col("ord"))
    boxes, arrows = render.ddg_lines(nodes, f.local_edge.select("src", "dst", F.lit("LOCAL").alias("kind")))
    return boxes.select("line").union(arrows.select("line"))


@query(f"""
    WITH n AS (
        SELECT DISTINCT sig || '_' || o AS id, local AS label, 'u/' || sig || '#run' AS method, o % 3 AS depth
        FROM (SELECT CAST(sig AS VARCHAR) AS sig, o, local FROM stmt))
    SELECT '    n_' || id || ' [label="' || label || '  (depth ' || depth || ')"];' AS line, '"run (depth ' || depth || ')"' AS title FROM n
    UNION ALL SELECT '  n_' || sig || '_' || src || ' -> n_' || sig || '_' || dst || ' ['
        || CASE WHEN label = 'T' THEN 'style=dashed, color=blue, label="call"'
            WHEN label = 'F' THEN 'style=dashed, color=gray, label="return"' ELSE 'color=black' END || '];', NULL FROM flow_edge
""")
def icfg_lines(f):
    sig = F.col("sig").cast("string")
    at = lambda c: F.concat(sig, F.lit("_"), F.col(c).cast("string"))
    nodes = f.stmt.select(
        at("o").alias("id"), F.col("local").alias("label"), F.concat(F.lit("u/"), sig, F.lit("#run")).alias("method"),
        (F.col("o") % 3).alias("depth"),
    )
    kind = F.when(F.col("label") == "T", "CALL").when(F.col("label") == "F", "RETURN").otherwise("INTRA")
    boxes, arrows = render.icfg_lines(
        nodes, f.flow_edge.select(at("src").alias("from"), at("dst").alias("to"), kind.alias("kind")),
    )
    return boxes.select("line", "title").union(arrows.select("line", F.lit(None).cast("string")))


@query(f"""
    {_CHAINS}, c AS (SELECT row_number() OVER (ORDER BY path) AS chain, path FROM p JOIN t ON p.node = t.sig WHERE n > 1),
    h AS (
        SELECT chain, i, path[i] AS node, CASE WHEN i > 1 THEN path[i - 1] END AS before
        FROM (SELECT chain, path, unnest(range(1, len(path) + 1)) AS i FROM c)),
    l AS (SELECT h.chain, h.i, CASE WHEN i > 2 THEN '  ' || repeat('   ', CAST(i AS INT) - 2) ELSE '' END || '  '
            || CASE WHEN i > 1 THEN '└─ ' ELSE '' END
            || CASE WHEN f.call_line > 0 THEN '@L' || f.call_line || '  ' ELSE '' END
            || m.class || '.' || m.name || '  L' || m.line_start || '-' || m.line_end || '  (' || (m.line_end - m.line_start + 1) || ' lines)' AS line
        FROM h JOIN method m ON m.sig = h.node LEFT JOIN flat_call f ON f.caller = h.before AND f.callee = h.node)
    SELECT chain, 'Chain ' || chain || ':' || chr(10) || string_agg(line, chr(10) ORDER BY i) || chr(10) AS text FROM l GROUP BY chain
""")
def chain_texts(f):
    nodes = f.method.select(
        F.col("sig").alias("node"), "class", F.col("name").alias("method"), F.col("line_start").alias("lineStart"),
        F.col("line_end").alias("lineEnd"), (F.col("line_end") - F.col("line_start") + 1).alias("sourceLineCount"),
    )
    calls = f.flat_call.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "call_line")
    return render.chain_text(_chains(f), nodes, calls).select("chain", "text")


# Small documents, written and read again


def _written(f, lines, name: str) -> str:
    path = fresh_path(f.spark, name)
    lines.coalesce(1).write.text(path)
    return path


@query("SELECT bean_name, fqcn, 'request' AS scope FROM bean")
def bean_documents(f):
    part = lambda tag, c: F.concat(F.lit(f"<m:{tag}>"), c, F.lit(f"</m:{tag}>"))
    bean = F.concat(
        part("managed-bean-name", F.col("bean_name")), part("managed-bean-class", F.col("fqcn")),
        part("managed-bean-scope", F.lit("request")),
    )
    rows = f.bean.agg(F.array_join(F.collect_list(part("managed-bean", bean)), "").alias("b"))
    text = F.concat(F.lit('<m:faces-config xmlns:m="urn:x">'), "b", F.lit("</m:faces-config>"))
    return documents.beans(f.spark, _written(f, rows.select(text), "beans"))


@query("SELECT 'src' AS key, n_name || '=' || n_nationkey AS value FROM nation")
def config_files(f):
    pair = F.concat(F.lit(" src = "), "n_name", F.lit("="), F.col("n_nationkey").cast("string"))
    lines = F.array(F.concat(F.lit("# "), "n_name"), pair, F.lit("other=1"), F.lit("nothing"))
    path = _written(f, f.nation.select(F.explode(lines)), "config")
    return documents.config(f.spark, path, ("src",)).select("key", "value")


@query("""
    SELECT sig, (starts_with(class, 'com.economy') OR starts_with(class, 'com.small')) AND NOT starts_with(class, 'com.small.Brand1') AS entered
    FROM method
""")
def filter_documents(f):
    doc = f.spark.createDataFrame(
        [('{"allow": ["com.economy", "com.small"], "stop": ["com.small.Brand1"]}',)], "value string",
    )
    allow, stop = documents.filter_lists(f.spark, _written(f, doc, "filter"))
    return f.method.select("sig", S.may_recurse(F.col("class"), allow, stop).alias("entered"))


_FILES = "SELECT p_size % 4 AS root_ord, p_brand || '/' || CAST(p_partkey AS STRING) || '.java' AS path, 'com.' || lower(p_type) || '.C' || CAST(p_partkey % 50 AS STRING) AS fqcn FROM part"


@query(
    f"SELECT fqcn, arg_min(root_ord, (root_ord, path)) AS root_ord, arg_min(path, (root_ord, path)) AS path FROM ({_FILES}) GROUP BY fqcn"
)
def first_sources(f):
    return documents.first_sources(f.sql(_FILES))


# Compositions


@query("""
    WITH RECURSIVE w(sig, d, v, s) AS (SELECT e.sig, e.src, t.local, e.dst FROM flow_edge e JOIN stmt t ON t.sig = e.sig AND t.o = e.src
        UNION SELECT w.sig, w.d, w.v, e.dst FROM w JOIN stmt t ON t.sig = w.sig AND t.o = w.s JOIN flow_edge e ON e.sig = w.sig AND e.src = w.s WHERE t.local <> w.v)
    SELECT 'u' || w.sig || '#s' || (w.d - 1) AS src, 'u' || w.sig || '#s' || (w.s - 1) AS dst, 'LOCAL' AS kind
    FROM w JOIN stmt_use u ON u.sig = w.sig AND u.stmt = w.s AND u.local = w.v
""")
def statement_dependence(f):
    """From statements to numbered nodes and LOCAL edges, as ddg-inter-cfg makes them."""
    sig = F.concat(F.lit("u"), F.col("sig").cast("string")).alias("sig")
    text = F.concat("local", F.lit(" = 1"))
    none = F.lit(None).cast("string")
    stmts = f.stmt.select(
        sig, F.col("o").alias("ord"), text.alias("text"), F.col("o").alias("line"), none.alias("call_target"),
    )
    calls = f.spark.createDataFrame([], "caller string, callee string")
    flow, uses = f.flow_edge.select(sig, "src", "dst"), f.stmt_use.select(sig, "stmt", "local")
    return dataflow.dependence_of_statements(stmts, flow, uses, calls)[1].select("src", "dst", "kind")


@query("""
    WITH RECURSIVE walk(node) AS (SELECT sig FROM root
        UNION SELECT e.dst FROM walk w JOIN call_edge e ON e.src = w.node WHERE NOT starts_with(e.dst, '<com.economy.') AND e.dst NOT IN (SELECT sig FROM bridge))
    SELECT e.src AS sig, e.dst AS child, m.class, m.name, e.call_line,
           (starts_with(e.dst, '<com.economy.') OR e.dst IN (SELECT sig FROM bridge)) AND e.dst NOT IN (SELECT sig FROM root) AS filtered
    FROM walk w JOIN call_edge e ON e.src = w.node JOIN method m ON m.sig = e.dst
""")
def forward_trace(f):
    """The callees of every method of a forward trace, with the lines that its statements call them on."""
    named = f.sql(_NAMED).select("caller", "callee", F.concat("class", F.lit("."), "name").alias("call"))
    stmts = f.call_edge.select(
        F.col("src").alias("caller"), F.col("dst").alias("callee"), "ord", F.col("call_line").alias("line"),
    ).join(named, ["caller", "callee"])
    bodies = {
        "stmt": stmts.select(
            F.col("caller").alias("sig"), "ord", "line", "call", F.lit(None).cast("string").alias("branch"),
        )
    }
    methods = f.method.where("not is_bridge")
    got = xtrace.forward_trace(f.call_edge, methods, bodies, f.root.first()["sig"], (), ("com.economy.",))
    return got["child"].select(
        "sig", "child", "class", "name", "call_line", (F.col("leaf_kind") == "filtered").alias("filtered"),
    )


@query(f"{_FROM_TO} SELECT DISTINCT s.sig, s.o // 3 AS line FROM stmt s JOIN kept k ON k.sig = s.sig AND k.node = s.o")
def slice_lines(f):
    lines = f.stmt.select("sig", F.col("o").alias("block"), F.floor(F.col("o") / 3).alias("line"))
    return blocks.kept_lines(lines, blocks.between_lines(f.flow_edge, _lines(f), 5, 30).select("sig", "block"))
