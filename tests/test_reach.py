"""Graph operators against brute force over random graphs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.functions.signatures import class_of, may_recurse
from graphloom.operators import callgraph, calltree, reach

GUILDS = ["org.mill.Wheel", "org.mill.Gate", "org.forge.Anvil", "net.dock.Crane"]


def name(i):
    return f"<{GUILDS[i % 4]}: int turn{i}(long)>"


def random_edges(seed, nodes=12, edges=26):
    """(src, dst, ord, call_line): distinct, in random order for each source."""
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)})
    rng.shuffle(pairs)
    seen = Counter()
    out = []
    for a, b in pairs:
        seen[a] += 1
        out.append((name(a), name(b), seen[a], rng.choice([None, 0, rng.randrange(1, 900)])))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, ord long, call_line long")


def successors(rows):
    out = {}
    for s, d, *_ in sorted(rows, key=lambda r: r[2]):
        out.setdefault(s, []).append(d)
    return out


def levels(near, start, limit=None, expand=lambda n: True):
    depth, front = {start: 0}, [start]
    while front and (limit is None or depth[front[0]] < limit):
        front = [
            d
            for s in front if expand(s)
            for d in near.get(s, ()) if d not in depth and not depth.update({d: depth[s] + 1})
        ]
    return depth


def seeds_of(spark, *starts):
    return spark.createDataFrame([(i, s) for i, s in enumerate(starts)], "root long, node string")


@pytest.mark.parametrize("kernel", [0, 1000])
@pytest.mark.parametrize("depth", [None, 0, 1, 3])
def test_closure(spark, kernel, depth):
    rows = random_edges(1) + [(name(3), None, 99, None)]
    starts = [name(0), name(5), name(11), "<none.None: int none()>"]
    got = {
        tuple(r)
        for r in reach.closure(frame(spark, rows), seeds_of(spark, *starts), depth, kernel_edges=kernel).collect()
    }
    near = successors([r for r in rows if r[1]])
    assert got == {(i, n, d) for i, s in enumerate(starts) for n, d in levels(near, s, depth).items()}


@pytest.mark.parametrize("kernel", [0, 1000])
def test_closure_keeps_but_does_not_expand(spark, kernel):
    rows = random_edges(2)
    stop = name(4)
    got = {
        r["node"]: r["depth"]
        for r in reach.closure(
            frame(spark, rows), seeds_of(spark, name(1)), expand=F.col("node") != stop, kernel_edges=kernel,
        ).collect()
    }
    assert got == levels(successors(rows), name(1), expand=lambda n: n != stop)
    assert reach.closure(frame(spark, rows), seeds_of(spark, name(1)).limit(0), kernel_edges=kernel).collect() == []


def test_closure_of_numbers(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 7)], "src long, dst long")
    s = spark.createDataFrame([("x", 1), ("x", 7), ("y", 9)], "root string, node long")
    want = {("x", 1, 0), ("x", 2, 1), ("x", 3, 2), ("x", 7, 0), ("y", 9, 0)}
    assert all({tuple(r) for r in reach.closure(e, s, kernel_edges=k).collect()} == want for k in (0, 10))


def walk(near, start, classify):
    """Every call of every expanded node, by recursion in order of the calls."""
    seen, out = set(), {}

    def visit(n, above):
        seen.add(n)
        for d in near.get(n, ()):
            out[(n, d)] = kind = "CYCLE" if d in above | {n} else classify(d)  # on the path comes first
            if kind == "NORMAL" and d not in seen:
                visit(d, above | {n})

    visit(start, frozenset())
    return seen, out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("allow", "stop"), [([], []), ([], ["org.forge."]), (["org."], ["org.mill.Gate"])])
def test_discover(spark, seed, allow, stop):
    rows = random_edges(seed, edges=34)
    known = {name(i) for i in range(12) if i % 5 != 4}
    inside = lambda n: n in known and (
        not allow or any(n[1:].startswith(a) for a in allow)
    ) and not any(n[1:].startswith(s) for s in stop)
    seen, want = walk(successors(rows), name(0), lambda n: "NORMAL" if inside(n) else "FILTERED")
    enter = may_recurse(class_of(F.col("dst")), allow, stop)
    nodes, calls = calltree.discover(
        frame(spark, rows), seeds_of(spark, name(0)), spark.createDataFrame([(k,) for k in known], "sig string"), enter,
    )
    rows_ = calls.collect()
    assert {r["node"] for r in nodes.collect()} == seen
    assert {(r["src"], r["dst"]): r["kind"] for r in rows_} == want
    marks = calltree.leaf_markers(calls).collect()
    flag = {"NORMAL": "ref", "CYCLE": "cycle", "FILTERED": "filtered"}
    assert all(
        [
            k
            for k in ("ref", "cycle", "filtered") if r[k]
        ] == [flag[want[(r["src"], r["dst"])]]] and (r["call_line"] is None or r["call_line"] > 0)
        for r in marks
    )


@pytest.mark.parametrize("seed", range(4))
def test_forward_tree(spark, seed):
    rows = random_edges(seed, edges=30)
    inside = lambda n: n.startswith("<org.")
    seen, want = walk(successors(rows), name(0), lambda n: "NORMAL" if inside(n) else "FILTERED")
    lines = spark.createDataFrame(
        [(name(i), 7 * i, 7 * i + i % 3 - 1) for i in range(0, 12, 2)], "sig string, line_start long, line_end long",
    )
    nodes, calls = calltree.forward_tree(frame(spark, rows), seeds_of(spark, name(0)), "^org[.]", lines)
    got = {r["node"]: (r["class"], r["method"], r["source_lines"]) for r in nodes.collect()}
    assert got == {
        name(i): (GUILDS[i % 4], f"turn{i}", i % 3 if i % 2 == 0 else None)
        for i in range(12) if name(i) in seen
    }
    site = {(s, d): n for s, d, _, n in rows}
    flags = {(r["src"], r["dst"]): (r["filtered"], r["cycle"], r["call_line"]) for r in calls.collect()}
    assert flags == {k: (v == "FILTERED", v == "CYCLE", site[k]) for k, v in want.items()}
    empty = calltree.forward_tree(frame(spark, rows), seeds_of(spark, name(3)), "^org[.]", lines)
    assert [df.count() for df in empty] == [0, 0]  # a root out of scope


def test_walks_are_deep_and_wide(spark):
    """A chain of 3,000 calls that leads back to its start, and a node with 20,000 callees."""
    rows = [
        (f"<a.B: int c{i}()>", f"<a.B: int c{i + 1}()>", 1, 1)
        for i in range(3000)
    ] + [("<a.B: int c3000()>", "<a.B: int c0()>", 1, 1)]
    rows += [("<a.B: int c7()>", f"<a.B: int w{i}()>", i + 2, 1) for i in range(20_000)]
    got = reach.ordered_walk(frame(spark, rows), seeds_of(spark, "<a.B: int c0()>"))
    assert got.count() == len(rows)
    assert [(r["src"], r["dst"]) for r in got.where("cycle").collect()] == [("<a.B: int c3000()>", "<a.B: int c0()>")]


def test_walks_of_many_roots(spark):
    rows = random_edges(6, edges=30)
    starts = [name(i) for i in range(12)]
    got = {
        (r["root"], r["src"], r["dst"]): r["cycle"]
        for r in reach.ordered_walk(frame(spark, rows), seeds_of(spark, *starts)).collect()
    }
    want = {}
    for i, s in enumerate(starts):
        want |= {(i, *k): v == "CYCLE" for k, v in walk(successors(rows), s, lambda n: "NORMAL")[1].items()}
    assert got == want


@pytest.mark.parametrize("kernel", [0, 1000])
@pytest.mark.parametrize("seed", range(3))
def test_components(spark, kernel, seed):
    rows = random_edges(seed, nodes=16, edges=24)
    near = successors(rows)
    got = {(r["src"], r["dst"]): r["in_scc"] for r in reach.in_component(frame(spark, rows), kernel).collect()}
    assert got == {(s, d): s in levels(near, d) for s, d, *_ in rows}
    assert len(set(got.values())) == 2
    assert reach.in_component(frame(spark, rows).limit(0), kernel).collect() == []


def simple_paths(near, start, ends, limit, least=2):
    out = []

    def go(path):
        if path[-1] in ends and len(path) >= least:
            out.append(path)
            return
        if limit is None or len(path) < limit:
            for d in near.get(path[-1], ()):
                if d not in path:
                    go([*path, d])

    go([start])
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("depth", "cap"), [(20, 50), (3, None), (20, 2)])
def test_chains(spark, seed, depth, cap):
    rows = random_edges(seed, edges=22)
    target = name(7)
    back = successors([(d, s, i, n) for i, (s, d, _, n) in enumerate(rows)])
    above = {n: d for n, d in levels(back, target, depth).items() if d}
    got = calltree.backward_nodes(
        frame(spark, rows), spark.createDataFrame([(target, target)], "root string, node string"), depth,
    )
    assert {r["node"]: r["depth"] for r in got.collect()} == above
    kept = [r for r in rows if {r[0], r[1]} <= above.keys() | {target}]
    tops = sorted(above.keys() - {d for s, d, *_ in kept if s != d})
    want = [p for t in tops for p in simple_paths(successors(kept), t, {target}, depth + 1)][:cap]
    found = calltree.chains(frame(spark, rows), target, got, cap, depth + 1).orderBy("chain").collect()
    assert [(r["chain"], r["path"]) for r in found] == list(enumerate(want, 1))
    steps = {
        tuple(r)
        for r in calltree.chain_edges(calltree.chains(frame(spark, rows), target, got, cap, depth + 1)).collect()
    }
    assert steps == {s for p in want for s in zip(p, p[1:], strict=False)}


def test_backward_stops_at_a_method(spark):
    rows = random_edges(9, edges=30)
    back = successors([(d, s, i, n) for i, (s, d, _, n) in enumerate(rows)])
    stop = back[name(2)][0]
    got = calltree.backward_nodes(
        frame(spark, rows), spark.createDataFrame([(0, name(2))], "root long, node string"), 20, stop,
    )
    assert {r["node"] for r in got.collect()} == {
        n
        for n, d in levels(back, name(2), 20, lambda n: n != stop).items() if d
    }


def test_reverse_trace(spark):
    rows = [(name(1), name(2), 1, 14), (name(2), name(6), 1, 27), (name(5), name(6), 1, 33), (name(6), name(2), 2, 40)]
    spans = [(name(i), GUILDS[i % 4], 10 * i, 10 * i + 8, i) for i in range(8)]
    methods = spark.createDataFrame(spans, "sig string, class string, line_start long, line_end long, ord long")
    nodes, calls, chains = calltree.reverse_trace(frame(spark, rows), methods, GUILDS[2], 64)
    assert [r["path"] for r in chains.orderBy("chain").collect()] == [[name(1), name(2), name(6)], [name(5), name(6)]]
    assert {(r["src"], r["dst"], r["call_line"]) for r in calls.collect()} == {(s, d, n) for s, d, _, n in rows[:3]}
    assert {r["node"]: r["source_lines"] for r in nodes.collect()} == {name(i): 9 for i in (1, 2, 5, 6)}
    with pytest.raises(LookupError):
        calltree.reverse_trace(frame(spark, rows), methods, GUILDS[2], 69)


@pytest.mark.parametrize("seed", range(3))
def test_layer_chains(spark, seed):
    rows = random_edges(seed, edges=30)
    ends = {name(i) for i in range(12) if GUILDS[i % 4].startswith("net.")}
    entry = [name(0), name(3)]
    got = calltree.layer_chains(
        frame(spark, rows), spark.createDataFrame([(e,) for e in entry], "node string"), "^net[.]", 5,
    )
    want = [p for e in entry for p in simple_paths(successors(rows), e, ends, 5, least=1)]
    assert sorted(r["path"] for r in got.collect()) == sorted(want) and [name(3)] in want


@pytest.mark.parametrize("seed", range(4))
def test_bridges(spark, seed):
    rows = random_edges(seed, edges=30)
    bridges = {name(i) for i in (1, 4, 9)}
    real = {b: [d for d in successors(rows).get(b, ()) if d != b] for b in bridges}
    want, lines = set(), {}
    for k, (s, d, _, n) in enumerate(rows):
        if s not in bridges:
            for to in real.get(d, [d]):
                want.add((s, to))
                lines.setdefault((s, to), []).append((k, n))
    table = spark.createDataFrame([(b,) for b in bridges], "sig string")
    pairs = frame(spark, rows).select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    assert {tuple(r) for r in callgraph.collapse_bridges(pairs, table).collect()} == want
    assert callgraph.collapse_bridges(pairs, table.limit(0)).count() == len(rows)
    sites = spark.createDataFrame(
        [(s, d, n, k) for k, (s, d, _, n) in enumerate(rows)], "caller string, callee string, call_line long, ord long",
    )
    assert {
        (r["caller"], r["callee"]): r["call_line"]
        for r in callgraph.collapse_callsites(sites, table).collect()
    } == {k: min(v)[1] for k, v in lines.items()}


def test_dispatch(spark):
    """By class, name and number of parameters, over direct subtypes that are no interfaces."""
    rng = random.Random(3)
    types = [f"net.dock.T{i}" for i in range(8)]
    rel = [
        (types[rng.randrange(8)], rng.choice([*types, "java.lang.Object"]), "interface", rng.random() < 0.3)
        for _ in range(14)
    ]
    methods = sorted(
        {(f"<{t}: int {m}{n}()>", t, m, n) for t in types for m in "pq" for n in (0, 1) if rng.random() < 0.6}
    )
    calls = [
        (
            f"<net.dock.Main: int r{rng.randrange(4)}()>", rng.choice(types), rng.choice("pq"), rng.randrange(2),
            rng.choice([-1, 0, 5, 8, 13]), k, rng.random() < 0.2,
        )
        for k in range(60)
    ]
    want = {}
    for caller, decl, m, n, line, _, special in calls:
        targets = {decl} | {s for s, p, _, face in rel if p == decl and p != "java.lang.Object" and not face}
        for sig, t, m2, n2 in methods:
            if not special and t in targets and (m, n) == (m2, n2):
                lines = want.setdefault((caller, sig), [])
                lines += [line] if line > 0 else []
    frames = (
        spark.createDataFrame(methods, "sig string, class string, name string, arity int"),
        spark.createDataFrame(
            calls, "caller string, decl_class string, name string, arity int, line int, ord int, special boolean",
        ),
        spark.createDataFrame(rel, "sub string, super string, rel string, sub_is_interface boolean"),
    )
    got = {(r["caller"], r["callee"]): r["call_line"] for r in callgraph.call_edges(*frames).collect()}
    assert got == {k: v[0] if v else None for k, v in want.items()}


def test_methods_at_lines(spark):
    rng = random.Random(4)
    spans = [(f"s{i}", rng.choice(GUILDS), a := rng.randrange(50), a + rng.randrange(12), i) for i in range(30)]
    methods = spark.createDataFrame(spans, "sig string, class string, line_start long, line_end long, ord long")
    asked = [(c, n) for c in GUILDS for n in range(0, 70, 3)]
    table = spark.createDataFrame(asked, "class string, line long")
    want = {
        (c, n): next(s for s, k, a, z, _ in spans if k == c and a <= n <= z)
        for c, n in asked if any(k == c and a <= n <= z for _, k, a, z, _ in spans)
    }
    assert {(r["class"], r["line"]): r["sig"] for r in callgraph.method_at_line(methods, table).collect()} == want
    late = {(r["class"], r["line"]): r["sig"] for r in callgraph.latest_start(methods, table).collect()}
    start = {s: a for s, _, a, *_ in spans}
    assert all(start[late[(c, n)]] == max(a for _, k, a, *_ in spans if k == c and a <= n) for c, n in late)
    stmts = spark.createDataFrame([(s, n) for s, _, a, z, _ in spans for n in (a, z)], "sig string, line long")
    got = {
        tuple(r)
        for r in callgraph.methods_with_line(stmts, spark.createDataFrame([(7,), (20,)], "line long")).collect()
    }
    assert got == {(s, n) for s, _, a, z, _ in spans for n in (a, z) if n in (7, 20)}


def test_resolution(spark):
    rows = [
        ("s1", "Dock", "load", "load(int)", 1, 1), ("s2", "Dock", "load", "load(long)", 1, 2),
        ("s3", "Dock", "sail", "sail()", 0, 3),
    ]
    methods = spark.createDataFrame(rows, "sig string, class string, name string, sub_sig string, arity int, ord int")
    assert {tuple(r) for r in callgraph.resolve_by_name(methods, "Dock", "load").collect()} == {("s1", 2), ("s2", 2)}
    calls = spark.createDataFrame(
        [("Dock", "load(long)", "load", 1), ("Dock", "load(x)", "load", 1), ("Quay", "sail()", "sail", 0)],
        "class string, sub_sig string, name string, arity int",
    )
    assert {
        r["sub_sig"]: r["sig"]
        for r in callgraph.resolve_callees(calls, methods).collect()
    } == {"load(long)": "s2", "load(x)": "s1", "sail()": None}


def test_line_map(spark):
    methods = spark.createDataFrame([("s", "Dock", "load")], "sig string, class string, name string")
    stmts = spark.createDataFrame([("s", n) for n in (-1, 12, 12, 19, 12)], "sig string, line long")
    r = callgraph.line_map(methods, stmts).first()
    assert (
        r["line_start"], r["line_end"], r["stmt_count"], r["source_lines"], r["line_map"],
    ) == (12, 19, 5, 3, {-1: 1, 12: 3, 19: 1})
