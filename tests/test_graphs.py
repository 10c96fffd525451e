import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import el
from graphloom.functions import signatures as S
from graphloom.operators import blocks, callgraph, dataflow, icfg, semantic, trace, validate, web


def col(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_signatures(spark):
    sigs = ["<com.a.B: int f(int,long)>", "<com.a.B: void <init>()>", "plain"]
    assert col(spark, sigs, S.class_of) == ["com.a.B", "com.a.B", ""]
    assert col(spark, sigs, S.method_of) == ["f", "", ""]
    assert col(spark, sigs, S.sub_signature) == ["f(int,long)", "<init>()", "plain"]
    assert col(spark, sigs, S.short_method) == ["B.f", "B.<init>", "plain"]
    assert col(spark, sigs[:1], S.source_symbol) == ["com/a/B#f"]
    assert col(
        spark, ["x = invoke g(a, \"b\", -1.5F)", "f()", "no"], lambda c: S.argument(c, F.lit(1)),
    ) == ['"b"', "", ""]
    assert col(
        spark, ["", "null", "true", '"s"', "-12L", "1.5", "x1", "12x"], S.is_constant,
    ) == [True] * 6 + [False] * 2
    assert col(
        spark, ["a = b = c", "p := @parameter3: int", "return r", "f()"], S.defined_local,
    ) == ["a", "p", None, None]
    assert col(spark, ["a = b = c", "f()"], S.written_value) == ["c", None]
    assert col(spark, ["return  r", "return", "x"], S.returned_local) == ["r", None, None]
    assert col(
        spark, ["p#1 := @parameter12: int", "$p := @parameter0: int", "x"], S.parameter_index,
    ) == [12, None, None]
    assert col(
        spark, ["v = 1", "v := @this", "vv = 1", "x = v"], lambda c: S.defines(c, F.lit("v")),
    ) == [True, True, False, False]
    assert col(spark, ["a.B-c"], S.sanitized) == ["a_B_c"] and col(spark, ['q"\\\n'], S.dot_escaped) == ['q\\"\\\\\\n']
    assert col(
        spark, ["a.ServiceX", "a.Dao", "z"], lambda c: S.layer(c, {"service": "Service", "dao": "Dao"}),
    ) == ["service", "dao", ""]
    assert col(spark, [0, 1, 2, 3], S.is_definition, "int") == [False, True, False, True]
    stop = S.Stop.exact("a") | S.Stop.prefix("b.") | S.Stop.never()
    assert col(spark, ["a", "b.c", "c"], stop) == [True, True, False]
    assert col(
        spark, ["com.a", "com.b", "org"], lambda c: S.may_recurse(c, ["com."], ["com.b"]),
    ) == [True, False, False]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a #{b.c} d ${e}", ["#{b.c}", "${e}"]), ("#{a['}'].b}", ["#{a['}'].b}"]), ("#{x{y}z}", ["#{x{y}z}"]),
        ("#{open", []), ("#{a} #{open ${b}", ["#{a}"]), ("", []), ("#", []), ("##{a}", ["#{a}"]),
    ],
)
def test_expressions(text, want):
    assert el.expressions(text) == want


def test_page_actions():
    page = '<H:Form action="#{a.go}" x="#{b} #{c.d}">t #{e.f}<br/><p>#{g}</p> #{h}</H:Form>'
    assert el.page_actions(page) == [
        ("h:form", "action", "#{a.go}"), ("h:form", "x", "#{b}"), ("h:form", "x", "#{c.d}"), ("h:form", "", "#{e.f}"),
        ("h:form", "", "#{h}"), ("p", "", "#{g}"),
    ]


def test_web(spark):
    pages = spark.createDataFrame(
        [
            (
                "a/x.jsp",
                '<jsp:include page="y.jsp"/><C:Import var="v" url="/z.jsp"/><ui:include src="../../out.jsp"/><%@ include file="${v}" %><i v="#{bean.go}">#{}</i>',
            ),
            ("a/y.jsp", '<jsp:include page="http://h/q.jsp"/>'), ("z.jsp", '<jsp:include page="a/x.jsp"/>'),
        ],
        "jsp string, html string",
    )
    links = web.resolve_includes(web.include_paths(pages), pages)
    assert {tuple(r) for r in links.collect()} == {("a/x.jsp", "a/y.jsp"), ("a/x.jsp", "z.jsp"), ("z.jsp", "a/x.jsp")}
    assert {
        r["jsp"]
        for r in web.include_closure(links, spark.createDataFrame([("z.jsp",)], "jsp string")).collect()
    } == {"z.jsp", "a/x.jsp", "a/y.jsp"}
    acts = web.el_actions(pages)
    assert [
        (r["jsp"], r["el"], r["bean_name"], r["member"])
        for r in acts.collect()
    ] == [("a/x.jsp", "#{bean.go}", "bean", "go")]
    beans = spark.createDataFrame([("bean", "com.B")], "bean_name string, fqcn string")
    e = spark.createDataFrame(
        [("<com.B: void go()>", "<com.C: void x()>", 1, 5), ("<com.C: void x()>", "<org.D: void y()>", 1, 6)],
        "src string, dst string, ord long, call_line long",
    )
    nodes, calls = web.page_map(acts, beans, e, "^com")
    assert {tuple(r) for r in nodes.collect()} == {
        ("jsp:/a/x.jsp", "jsp"), ("el:/a/x.jsp##{bean.go}", "el_expression"), ("<com.B: void go()>", "java_method"),
        ("<com.C: void x()>", "java_method"),
    }
    assert {(r["edge_type"], r["filtered"]) for r in calls.collect()} == {
        ("el_call", False), ("method_call", False), ("call", False), ("call", True),
    }
    with pytest.raises(ValueError):
        web.resolver("none")


def random_flow(seed, n=9):
    """Blocks 0 to n - 1, edges, traps (handler, covered) of one method."""
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(4, 14))})
    traps = [(rng.randrange(1, n), sorted(rng.sample(range(n), rng.randint(1, 4)))) for _ in range(rng.randint(0, 3))]
    return edges, traps


def reach_from(near, starts, shut=frozenset()):
    seen, todo = set(starts), list(starts)
    while todo:
        todo += (new := {d for d in near.get(todo.pop(), ()) if d not in shut} - seen)
        seen |= new
    return seen


def both_ways(edges):
    ahead, back = {}, {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)
    return ahead, back


def filled(edges, covered, handlers):
    """Covered, what lies between covered blocks off the handlers, and entries that flow into that."""
    ahead, back = both_ways(edges)
    full = set(covered) | (reach_from(ahead, covered, handlers) & reach_from(back, covered, handlers)) - handlers
    return full | {b for b in ahead if b not in back and b not in handlers and ahead[b] & full}


def region(edges, handler, normal):
    return reach_from(both_ways(edges)[0], [handler], normal)


METHODS = [random_flow(seed) for seed in range(40)]


@pytest.fixture(scope="module")
def flows(spark):
    e = [(m, a, b) for m, (edges, _) in enumerate(METHODS) for a, b in edges]
    traps = [(m, i, h) for m, (_, traps) in enumerate(METHODS) for i, (h, _) in enumerate(traps)]
    cover = [(m, i, b) for m, (_, traps) in enumerate(METHODS) for i, (_, c) in enumerate(traps) for b in c]
    return (
        spark.createDataFrame(e, "sig int, src int, dst int"),
        spark.createDataFrame(traps, "sig int, trap_idx int, handler int"),
        spark.createDataFrame(cover, "sig int, trap_idx int, block int"),
    )


def test_fill_gaps(flows):
    edges, traps, cover = flows
    want = {
        (m, i, b)
        for m, (e, traps_) in enumerate(METHODS)
        for i, (_, c) in enumerate(traps_)
        for b in filled(e, c, {h for h, _ in traps_})
    }
    got = blocks.fill_gaps(edges, cover, traps).collect()
    assert {(r["sig"], r["trap_idx"], r["block"]) for r in got} == want and len(got) == len(want)


def test_handler_regions(spark, flows):
    edges, traps, _ = flows
    entries = spark.createDataFrame([(m, 0) for m in range(len(METHODS))], "sig int, block int")
    normal = {m: reach_from(both_ways(e)[0], [0]) for m, (e, _) in enumerate(METHODS)}
    got = blocks.normal_flow(edges, entries)
    assert {(r["sig"], r["block"]) for r in got.collect()} == {(m, b) for m, bs in normal.items() for b in bs}
    want = {
        (m, i, b)
        for m, (e, traps_) in enumerate(METHODS)
        for i, (h, _) in enumerate(traps_)
        for b in region(e, h, normal[m])
    }
    assert {(r["sig"], r["trap_idx"], r["block"]) for r in blocks.handler_regions(edges, traps, got).collect()} == want


def test_assign_clusters(spark):
    """A block that any trap handles is a handler block, else it is tried; the first trap wins."""
    rng = random.Random(12)
    cover = sorted({(rng.randrange(30), rng.randrange(4), f"K{rng.randrange(7)}") for _ in range(200)})
    handle = sorted({(rng.randrange(30), rng.randrange(4), f"K{rng.randrange(7)}") for _ in range(60)})
    want = {}
    for role, rows in (("handler", handle), ("try", cover)):
        for m, i, b in rows:
            if role == "handler" or (m, b, "handler") not in want:
                want[(m, b, role)] = min(i, want.get((m, b, role), i))
    schema = "sig int, trap_idx int, block string"
    got = blocks.assign_clusters(spark.createDataFrame(cover, schema), spark.createDataFrame(handle, schema))
    assert {(r["sig"], r["block"], r["role"]): r["trap_idx"] for r in got.collect()} == want


def test_block_traces(spark):
    """Numbers, labels, traps, gaps, regions and inlined handlers of whole methods."""
    ir, succ, throws, want = [], [], [], {}
    for m, (edges, traps) in enumerate(METHODS):
        rng = random.Random(500 + m)
        place = rng.sample(range(100, 200), 9)  # the blocks' names say nothing about their order
        lines, tails = {}, {}
        for b in range(9):
            rows = [rng.choice([-1, 3 * b, 3 * b + 1, 70, 71]) for _ in range(rng.randint(1, 3))]
            lines[b] = {n for n in rows if n > 0}
            tails[b] = rng.random() < 0.5
            for k, n in enumerate(rows):
                last = k == len(rows) - 1
                ir.append(
                    (
                        f"m{m}", place[b], 10 * b + k, None if n < 0 else n, "t", None, None,
                        "p.K.f" if not last else None, False, 0, "u > 1" if last and tails[b] else None, False,
                    )
                )
        ahead, _ = both_ways(edges)
        for b, to in ahead.items():
            succ += [(f"m{m}", place[b], k, place[d]) for k, d in enumerate(sorted(to))]
        table = {}
        for h, covered in traps:
            for b in covered:
                table.setdefault((h, f"E{h % 2}"), set()).add(b)
        throws += [(f"m{m}", place[b], place[h], kind) for (h, kind), bs in table.items() for b in bs]
        order = sorted(table, key=lambda t: (min(table[t]), f"B{t[0]}", t[1]))
        normal, heads = reach_from(ahead, [0]), {h for h, _ in table}
        full = [filled(edges, table[t], heads) for t in order]
        regions = [set(region(edges, h, normal)) for h, _ in order]
        taken = set().union(*full, *regions)
        for i, (h, _) in enumerate(order):
            for b in range(9):
                if lines[h] and b not in taken and lines[b] and lines[b] <= lines[h]:
                    regions[i].add(b)
                    taken.add(b)
        labels = {
            (a, d): ("TF"[k] if tails[a] and len(to) == 2 else None)
            for a, to in ahead.items()
            for k, d in enumerate(sorted(to))
        }
        want[f"m{m}"] = (
            {(f"B{a}", f"B{d}"): x for (a, d), x in labels.items()},
            [(f"B{h}", k, {f"B{b}" for b in full[i]}, {f"B{b}" for b in regions[i]}) for i, (h, k) in enumerate(order)],
        )
    schema = "sig string, block int, ord long, line long, text string, lhs string, rhs string, call_target string, returns_boolean boolean, arg_count int, condition string, is_switch boolean"
    t = blocks.block_trace(
        spark.createDataFrame(ir, schema), spark.createDataFrame(succ, "sig string, block int, pos int, succ int"),
        spark.createDataFrame(throws, "sig string, block int, handler int, type string"),
    )
    rows = {k: df.collect() for k, df in t.items()}
    for m, (labels, traps) in want.items():
        own = {k: [r for r in v if r["sig"] == m] for k, v in rows.items()}
        assert sorted(r["block"] for r in own["block"]) == [f"B{b}" for b in range(9)]
        assert {(r["src"], r["dst"]): r["label"] for r in own["block_edge"]} == labels
        got = []
        for trap in sorted(own["trap"], key=lambda r: r["trap_idx"]):
            part = lambda k, i=trap["trap_idx"], own=own: {r["block"] for r in own[k] if r["trap_idx"] == i}
            got.append((trap["handler"], trap["type"], part("cover"), part("handler_block")))
        assert got == traps


def test_line_slices(spark):
    e = spark.createDataFrame(
        [(1, 1, 2, None), (1, 2, 3, "T"), (1, 2, 4, "F"), (1, 3, 5, None), (1, 4, 5, None)],
        "sig int, src long, dst long, label string",
    )
    lines = spark.createDataFrame([(1, b, b * 10) for b in range(1, 6)], "sig int, block long, line long")
    kept = blocks.between_lines(e, lines, 20, 30)
    assert {r["block"] for r in kept.collect()} == {2, 3}
    assert [(r["src"], r["dst"]) for r in blocks.slice_edges(e, kept).collect()] == [(2, 3)]
    assert {
        (r["line"], r["n"])
        for r in blocks.line_trace(e, lines, 10, 50).collect()
    } == {(10, 1), (20, 1), (30, 1), (50, 1)}
    cover = spark.createDataFrame([(1, 0, 3), (1, 1, 5)], "sig int, trap_idx int, block long")
    assert [r["trap_idx"] for r in blocks.slice_traps(cover, cover.limit(0), kept).collect()] == [0]


TREE = [([], "R"), ([0], "A"), ([0, 0], "T"), ([0, 0, 0], "X"), ([1], "B"), ([1, 0], "C"), ([2], "T"), ([2, 0], "T")]


@pytest.fixture
def tree(spark):
    rows = [("t", p, f"s{c}", c, 10, 20, None, 5) for p, c in TREE]
    return spark.createDataFrame(
        rows,
        "trace string, path array<int>, sig string, class string, line_start int, line_end int, leaf_kind string, call_line long",
    )


def paths(df):
    return sorted(tuple(r["path"]) for r in df.collect())


def test_tree_slices(tree):
    assert paths(trace.find_subtree(tree, trace.matches("A"))) == [(0,), (0, 0), (0, 0, 0)]
    assert paths(trace.find_subtree(tree, trace.matches("R"))) == sorted(tuple(p) for p, _ in TREE)
    assert paths(trace.find_subtree(tree, trace.matches("A", 30))) == []
    assert paths(trace.prune_to_target(tree, trace.matches("T"))) == [(), (0,), (0, 0), (2,)]
    assert paths(trace.inter_slice(tree, trace.matches("A"), trace.matches("X"))) == [(0,), (0, 0), (0, 0, 0)]
    with pytest.raises(ValueError):
        trace.inter_slice(tree)


@pytest.mark.parametrize("kernel", [0, 1000])
def test_expand_refs(spark, kernel):
    schema = "trace string, path array<int>, sig string, leaf_kind string, call_line long"
    nodes = spark.createDataFrame(
        [
            ("t", [], "root", None, None), ("t", [0], "a", "ref", 4), ("t", [1], "gone", "ref", 5),
            ("t", [2], "z", "cycle", 6),
        ],
        schema,
    )
    kids = spark.createDataFrame(
        [("a", 0, "b", "ref", 7), ("a", 1, "root", "ref", 8), ("b", 0, "a", "ref", 9), ("b", 1, "f", "filtered", 1)],
        "sig string, pos int, child string, leaf_kind string, call_line long",
    )
    bodies = spark.createDataFrame([("a",), ("b",), ("root",)], "sig string")
    got = {
        tuple(r["path"]): (r["sig"], r["leaf_kind"], r["call_line"])
        for r in trace.expand_refs(nodes, kids, bodies, kernel_rows=kernel).collect()
    }
    assert got == {
        (): ("root", None, None), (0,): ("a", None, 4), (1,): ("gone", "ref", 5), (2,): ("z", "cycle", 6),
        (0, 0): ("b", None, 7), (0, 1): ("root", "ref", 8), (0, 0, 0): ("a", "ref", 9), (0, 0, 1): ("f", "filtered", 1),
    }


def test_merges(spark):
    schema = "sig int, block string, block_ord long, ord long, line long, call string, branch string, assign string"
    rows = [
        (1, "B0", 0, 0, 9, "Foo.bar", None, None), (1, "B0", 0, 1, 9, "Baz.qux", None, None),
        (1, "B0", 0, 2, 9, None, None, "x"), (1, "B0", 0, 3, -1, "No.no", None, None),
        (1, "B0", 0, 4, 3, None, "c", None),
    ]
    got = {
        r["line"]: (r["calls"], r["branches"], r["assigns"])
        for r in semantic.merge_statements(spark.createDataFrame(rows, schema)).collect()
    }
    assert got == {9: (["Foo.bar", "Baz.qux"], [], ["x"]), 3: ([], ["c"], [])}
    entries = spark.createDataFrame(
        [(1, 0, 5, ["a", "a"], None), (1, 1, 5, ["a", "b"], "c"), (1, 2, 6, None, None)],
        "sig int, ord long, line long, calls array<string>, branch string",
    )
    got = {r["line"]: (r["calls"], r["branches"]) for r in semantic.merge_trace(entries).collect()}
    assert got[5] == (["a", "a", "b"], ["c"])
    runs = spark.createDataFrame([(1, i, x) for i, x in enumerate([4, 4, 5, 4])], "sig int, ord long, line long")
    assert sorted(
        (r["line"], r["first_ord"], r["n"])
        for r in semantic.merge_runs(runs).collect()
    ) == [(4, 0, 2), (4, 3, 1), (5, 2, 1)]


@pytest.fixture
def graph(spark):
    stmts = spark.createDataFrame(
        [
            ("s", "B0", 0, 0, 1, "a.b.C.f", None, None), ("s", "B0", 0, 1, 2, None, None, "x = 1"),
            ("s", "B2", 2, 0, 5, None, None, None),
        ],
        "sig string, block string, block_ord long, ord long, line long, call string, branch string, assign string",
    )
    bl = spark.createDataFrame(
        [("s", "B0", 0, "x > 0"), ("s", "B1", 1, None), ("s", "B2", 2, None)],
        "sig string, block string, block_ord long, condition string",
    )
    e = spark.createDataFrame(
        [("s", "B0", "B1", "T"), ("s", "B0", "B2", "F"), ("s", "B1", "B2", None), ("s", "B2", "B2", None)],
        "sig string, src string, dst string, label string",
    )
    cover = spark.createDataFrame([("s", 0, "B0", 0)], "sig string, trap_idx long, block string, ord long")
    handlers = spark.createDataFrame([("s", 0, "B2")], "sig string, trap_idx long, block string")
    traps = spark.createDataFrame(
        [("s", 0, "B2", "java.lang.Error")], "sig string, trap_idx long, handler string, type string",
    )
    inst = spark.createDataFrame(
        [("t", [], "s", None), ("t", [0], "s", 2)], "trace string, path array<int>, sig string, call_line long",
    )
    return semantic.transform(inst, stmts, bl, e, cover, handlers, traps)


def test_transform(graph):
    nodes = {(tuple(r["path"]), r["seq"]): (r["id"], r["kind"], r["label"]) for r in graph["nodes"].collect()}
    assert nodes[((), 0)] == ("n0", "call", ["L1", "C.f"])
    assert nodes[((), 1)] == ("n1", "branch", ["L2", "x = 1", "x > 0"])
    assert nodes[((), 2)] == ("n2", "plain", ["B1"]) and nodes[((0,), 3)][0] == "n7"
    got = {(r["from"], r["to"], r["label"]) for r in graph["edges"].collect()}
    assert {
        ("n0", "n1", None), ("n1", "n2", "T"), ("n1", "n3", "F"), ("n2", "n3", None), ("n5", "n6", "T"),
    } <= got and len(got) == 8
    assert [(r["src"], r["dst"]) for r in graph["drilldown"].collect()] == [("n1", "n4")]
    assert {
        (r["role"], tuple(r["nodes"]), r["entry"])
        for r in graph["clusters"].collect()
    } == {("try", (0, 1), None), ("handler", (3,), 3)}
    assert {
        (r["from"], r["to"], r["trap_type"])
        for r in graph["exception_edges"].collect()
    } == {("n0", "n3", "Error"), ("n4", "n7", "Error")}


def test_ascii_tree(spark):
    from graphloom.operators import render

    nodes = spark.createDataFrame([(x, x.upper()) for x in "abc"], "node string, label string")
    calls = spark.createDataFrame(
        [("a", "b", 1, 5, False), ("a", "c", 2, None, False), ("b", "a", 1, 7, True)],
        "src string, dst string, ord long, call_line long, cycle boolean",
    )
    top = calls.where("dst <> 'a' or cycle")
    got = [r["text"] for r in render.ascii_tree(nodes, top.where("not cycle")).orderBy("top", "ord_path").collect()]
    assert got == ["A", "├── B:5", "└── C"]
    nodes2 = nodes.union(spark.createDataFrame([("r", "R")], nodes.schema))
    calls2 = calls.union(spark.createDataFrame([("r", "a", 1, 1, False)], calls.schema))
    got = [r["text"] for r in render.ascii_tree(nodes2, calls2).orderBy("top", "ord_path").collect()]
    assert got == ["R", "└── A:1", "    ├── B:5", "    │   └── A:7 [↻]", "    └── C"]
    assert "a -> b;" in render.call_tree_dot(
        nodes, calls,
    ) and "b -> a [style=dashed color=gray];" in render.call_tree_dot(nodes, calls)
    sig = "<net.dock.Crane: int lift(long)>"
    stmts = spark.createDataFrame(
        [(f"{sig}#s1", sig, "x = 1", "ASSIGN", 4), (f"{sig}#s2", sig, "return x", "RETURN", 5)],
        "id string, sig string, text string, kind string, line long",
    )
    deps = spark.createDataFrame([(f"{sig}#s1", f"{sig}#s2", "LOCAL")], "src string, dst string, kind string")
    assert [
        r["text"]
        for r in render.ddg_tree(stmts, deps).orderBy("top", "ord_path").collect()
    ] == ["[Crane.lift L4] x = 1", "└── [LOCAL] [Crane.lift L5] return x"]
    dot = render.ddg_dot(stmts, deps)
    assert 'label="Crane.lift";' in dot and '[label="Crane.lift\\nL5: return x" shape=house];' in dot and '[label="LOCAL" color=black fontcolor=black];' in dot
    assert dot.count("{") == dot.count("}")


def test_validation(spark):
    n, e = "trace int, method string, id string, kind string", "trace int, method string, src string, dst string, branch string, kind string"
    nodes = spark.createDataFrame(
        [
            (0, "m", "n0", "branch"), (0, "m", "n1", "call"), (0, "m", "n1", "call"), (0, "m", "n2", "plain"),
            (0, "k", "n9", "plain"),
        ],
        n,
    )
    edges = spark.createDataFrame(
        [(0, "m", "n0", "n1", "T", None), (0, "m", "n1", "n9", "F", None), (0, "m", "n1", "n5", None, "drilldown")], e,
    )
    cl = spark.createDataFrame([(0, "m", "n9")], "trace int, method string, id string")
    entries = spark.createDataFrame([(0, "m", "n0"), (0, "k", "n8")], cl.schema)
    leaf = spark.createDataFrame([(0, "q", "nodes")], "trace int, method string, field string")
    got = {
        (r["kind"], r["node_id"], r["method"])
        for r in validate.validate(
            nodes, edges, cl, entries, edges.select("trace", "method", "dst").limit(0), leaf,
        ).collect()
    }
    assert got == {
        ("duplicate_node_id", "n1", "m"), ("dangling_edge_ref", "n5", "m"), ("dangling_cluster_ref", "n9", "m"), ("invalid_entry_node", "n8", "k"), (
            "branch_edge_violation", "n0", "m",
        ),
        (
            "non_branch_edge_violation", "n1", "m",
        ), ("no_incoming_edge", "n2", "m"), ("no_incoming_edge", "n9", "k"), ("leaf_has_graph_fields", "", "q"),
    }


def test_reaching_definitions(spark):
    flow = spark.createDataFrame([("m", 1, 2), ("m", 2, 3), ("m", 3, 4), ("m", 4, 2)], "sig string, src long, dst long")
    defs = spark.createDataFrame([("m", 1, "x"), ("m", 3, "x"), ("m", 2, "y")], "sig string, stmt long, local string")
    uses = spark.createDataFrame(
        [("m", 2, "x"), ("m", 3, "x"), ("m", 4, "y"), ("m", 4, "x")], "sig string, stmt long, local string",
    )
    got = {(r["def"], r["use"]) for r in dataflow.reaching_definitions(flow, defs, uses).collect()}
    assert got == {(1, 2), (1, 3), (3, 2), (3, 3), (3, 4), (2, 4)}


def test_dependence_between_methods(spark):
    caller, callee = "<A: void f()>", "<B: int g(int,int)>"
    nodes = spark.createDataFrame(
        [
            ("d", caller, "a = 5", "ASSIGN", None),
            ("c", caller, "r = invoke b.g(a, 7)", "ASSIGN_INVOKE", "<I: int g(int,int)>"),
            ("p", callee, "p := @parameter0: int", "IDENTITY", None),
            ("q", callee, "q := @parameter1: int", "IDENTITY", None),
            ("w", callee, "this.<B: int F> = p", "ASSIGN", None), ("x", callee, "return p", "RETURN", None),
            ("h", caller, "v = b.<B: int F>", "ASSIGN", None),
        ],
        "id string, sig string, text string, kind string, call_target string",
    )
    local = spark.createDataFrame([("d", "c", 1), ("p", "x", 2), ("p", "w", 3)], "src string, dst string, ord long")
    calls = spark.createDataFrame([(caller, callee)], "caller string, callee string")
    got = {
        (r["src"], r["dst"], r["kind"], r["field"])
        for r in dataflow.dependence_graph(nodes, local, calls, heap=True).collect()
    }
    assert got == {
        ("d", "c", "LOCAL", None), ("p", "x", "LOCAL", None), ("p", "w", "LOCAL", None), ("d", "p", "PARAM", None),
        ("x", "c", "RETURN", None), ("w", "h", "HEAP", "<B: int F>"),
    }
    none = dataflow.heap_edges(nodes, nodes.select("sig"), alias=lambda *a: F.lit(False))
    assert none.count() == 0 and dataflow.heap_edges(nodes, calls.select(F.col("caller").alias("sig"))).count() == 0
    graph = dataflow.dependence_graph(nodes, local, calls)
    seeds = dataflow.slice_seeds(nodes, caller, "r")
    got, used = dataflow.backward_slice(graph, seeds)
    assert {r["id"]: r["depth"] for r in got.collect()} == {"c": 0, "d": 1, "x": 1, "p": 2}
    assert used.count() == 4 and dataflow.slice_seeds(nodes, caller, "zz").count() == 0
    assert col(spark, ["x.<F> = v"], lambda t: dataflow.carried_local(F.lit("HEAP"), t)) == ["v"]
    named = dataflow.number_statements(spark.createDataFrame([("m", 7), ("m", 3)], "sig string, ord long"))
    assert {(r["ord"], r["id"]) for r in named.collect()} == {(3, "m#s0"), (7, "m#s1")}


def test_icfg(spark):
    nodes = spark.createDataFrame([(m, i, i) for m in "fg" for i in (1, 2, 3)], "sig string, node long, ord long")
    edges = nodes.where("node < 3").select("sig", F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    calls = spark.createDataFrame(
        [("f", 2, 1, "g"), ("g", 1, 1, "f")], "sig string, node long, ord long, callee string",
    )
    got_nodes, got = icfg.icfg(nodes, edges, calls, "f", 1)
    rows = {
        (r["src_sig"], r["src_depth"], r["src"], r["dst_sig"], r["dst_depth"], r["dst"], r["kind"])
        for r in got.collect()
    }
    assert rows == {
        ("f", 0, 1, "f", 0, 2, "INTRA"), ("f", 0, 2, "g", 1, 1, "CALL"), ("g", 1, 3, "f", 0, 3, "RETURN"),
        ("g", 1, 1, "g", 1, 2, "INTRA"), ("g", 1, 2, "g", 1, 3, "INTRA"),
    }
    from graphloom.operators.render import icfg_dot

    shown = got_nodes.select(
        icfg.node_id().alias("id"), F.col("node").cast("string").alias("label"), F.col("sig").alias("method"), "depth",
    )
    links = got.select(
        icfg.node_id("src_sig", "src_depth", "src").alias("from"),
        icfg.node_id("dst_sig", "dst_depth", "dst").alias("to"), "kind",
    )
    dot = icfg_dot(shown, links)
    assert 'style=dashed, color=blue, label="call"' in dot and dot.count(
        "subgraph"
    ) == 2 and dot.count("{") == dot.count("}")
    assert icfg.icfg(nodes, edges, calls, "f", 1, S.Stop.exact("g")(F.col("callee")))[1].count() == 2


@pytest.mark.parametrize("kernel", [0, 1000])
def test_expand_refs_keeps_what_is_left_at_the_depth(spark, kernel):
    kids = spark.createDataFrame(
        [(f"s{i}", 0, f"s{i + 1}", "ref", i) for i in range(6)],
        "sig string, pos int, child string, leaf_kind string, call_line long",
    )
    top = spark.createDataFrame(
        [("t", [], "s0", "ref", None)], "trace string, path array<int>, sig string, leaf_kind string, call_line long",
    )
    got = sorted(
        (r["sig"], r["leaf_kind"])
        for r in trace.expand_refs(top, kids, kids.select("sig"), 2, kernel).collect()
    )
    assert got == [("s0", None), ("s1", None), ("s2", "ref")]


@pytest.mark.parametrize(("kernel", "n"), [(0, 8), (1000, 300)])
def test_expand_refs_at_any_depth(spark, kernel, n):
    kids = spark.createDataFrame(
        [(f"s{i}", 0, f"s{i + 1}", "ref", i) for i in range(n)],
        "sig string, pos int, child string, leaf_kind string, call_line long",
    )
    top = spark.createDataFrame(
        [("t", [], "s0", "ref", None)], "trace string, path array<int>, sig string, leaf_kind string, call_line long",
    )
    got = trace.expand_refs(top, kids, kids.select("sig"), kernel_rows=kernel).collect()
    assert sorted((r["sig"], r["leaf_kind"], len(r["path"])) for r in got) == sorted(
        (f"s{i}", None if i < n else "ref", i)
        for i in range(n + 1)
    )


@pytest.mark.parametrize(("kernel", "n"), [(0, 6), (1000, 300)])
def test_ascii_trees_of_any_depth(spark, kernel, n):
    from graphloom.operators import render

    nodes = spark.createDataFrame(
        [(f"s{i}", f"K.s{i}") for i in range(n + 1)] + [("t", "T")], "node string, label string",
    )
    calls = spark.createDataFrame(
        [
            (f"s{i}", f"s{i + 1}", 1, 0, False)
            for i in range(n)
        ] + [("s0", "t", 2, 7, None), (f"s{n}", "s1", 1, 1, True)],
        "src string, dst string, ord long, call_line long, cycle boolean",
    )
    got = [r["text"] for r in render.ascii_tree(nodes, calls, kernel_rows=kernel).orderBy("top", "ord_path").collect()]
    assert got[0] == "K.s0" and got[1] == "├── K.s1" and got[2] == "│   └── K.s2" and got[-1] == "└── T:7" and len(
        got
    ) == n + 3
    assert got[-2] == "│   " + "    " * (n - 1) + "└── K.s1:1 [↻]"


def test_reaching_definitions_by_brute_force(spark):
    rng = random.Random(21)
    flow, defs, uses, want = [], [], [], set()
    for m in range(25):
        n = rng.randint(2, 9)
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)})
        made = sorted({(rng.randrange(n), rng.choice("abc")) for _ in range(n)})
        used = sorted({(rng.randrange(n), rng.choice("abc")) for _ in range(n)})
        ahead, _ = both_ways(edges)
        for d, v in made:
            stops = {x for x, w in made if w == v}
            reached, todo = set(), set(ahead.get(d, ()))
            while todo:
                x = todo.pop()
                reached.add(x)
                todo |= set() if x in stops else ahead.get(x, set()) - reached
            want |= {(f"m{m}", d, x) for x, w in used if w == v and x in reached}
        flow += [(f"m{m}", *e) for e in edges]
        defs += [(f"m{m}", *x) for x in made]
        uses += [(f"m{m}", *x) for x in used]
    got = dataflow.reaching_definitions(
        spark.createDataFrame(flow, "sig string, src long, dst long"),
        *(spark.createDataFrame(x, "sig string, stmt long, local string") for x in (defs, uses)),
    )
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_semantic_graphs_of_source_traces(spark):
    entries = spark.createDataFrame(
        [("", 0, 8, ["a.B.f"], None), ("", 1, 4, None, "c"), ("", 2, 8, ["a.B.f", "a.B.g"], None)],
        "sig string, ord long, line long, calls array<string>, branch string",
    )
    empty = lambda schema: spark.createDataFrame([], schema)
    inst = spark.createDataFrame([("", [], "", None)], "trace string, path array<int>, sig string, call_line long")
    parts = semantic.transform(
        inst, empty(
            "sig string, block string, block_ord long, ord long, line long, call string, branch string, assign string"
        ), empty("sig string, block string, block_ord long, condition string"), empty("sig string, src string, dst string, label string"),
        empty("sig string, trap_idx long, block string, ord long"), empty("sig string, trap_idx long, block string"), empty(
            "sig string, trap_idx long, handler string, type string"
        ), entries,
    )
    assert [
        (r["id"], r["line"], r["kind"], r["label"])
        for r in parts["nodes"].orderBy("seq").collect()
    ] == [("n0", 4, "branch", ["L4"]), ("n1", 8, "call", ["L8", "B.f", "B.g"])]
    assert [(r["from"], r["to"]) for r in parts["edges"].collect()] == [("n0", "n1")]
    runs = semantic.source_trace(
        spark.createDataFrame(
            [("s", 0, 5, "x", None), ("s", 1, 5, "y", "b"), ("s", 2, 6, None, None), ("s", 3, 5, "x", None)],
            "sig string, ord long, line long, call string, branch string",
        )
    )
    assert [
        tuple(r)
        for r in runs.orderBy("ord").select("line", "calls", "branch").collect()
    ] == [(5, ["x", "y"], "b"), (6, [], None), (5, ["x"], None)]


def test_latest_start_of_a_large_class(spark):
    """One class with many methods and lines: no pairs of them are made."""
    starts = [(None if i == 5 else "c", i * 10, f"m{i}") for i in range(300)] + [("d", None, "x"), ("d", 7, "y")]
    methods = spark.createDataFrame(starts, "class string, line_start long, sig string")
    lines = [("c", i * 3 - 5) for i in range(1200)] + [("c", 40), ("c", 40), ("d", 6), ("d", 7), (None, 9), ("c", None)]
    asked = spark.createDataFrame(lines, "class string, line int")
    out = callgraph.latest_start(methods, asked)
    want = {
        (c, line, max((s, m) for k, s, m in starts if k == c and s is not None and s <= line)[1])
        for c, line in lines
        if c and line is not None and any(k == c and s is not None and s <= line for k, s, _ in starts)
    }
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert out.schema["line"].dataType.simpleString() == "int"
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_dependence_edges_are_made_once(spark):
    """A slice reads them twice; their joins are not run again for that."""
    rows = [("f#c", "f", 1, "x1 = invoke <g: void m()>(a1, 7)", "ASSIGN_INVOKE", "<g: void m()>"), ("f#a", "f", 0, "a1 = 5", "ASSIGN", None)]
    rows += [("g#p", "<g: void m()>", 0, "p := @parameter0: int", "IDENTITY", None), ("g#r", "<g: void m()>", 1, "return p", "RETURN", None)]
    nodes = spark.createDataFrame(rows, "id string, sig string, ord long, text string, kind string, call_target string")
    local = spark.createDataFrame([("f#a", "f#c", 0), ("g#p", "g#r", 1)], "src string, dst string, ord long")
    calls = spark.createDataFrame([("f", "<g: void m()>")], "caller string, callee string")
    edges = dataflow.dependence_graph(nodes, local, calls)
    assert "Join" not in edges._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r)[:3] for r in edges.collect()} == {
        ("f#a", "f#c", "LOCAL"), ("g#p", "g#r", "LOCAL"), ("f#a", "g#p", "PARAM"), ("g#r", "f#c", "RETURN"),
    }
