import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import exact_dedup, passage_dedup, simhash_dedup, suffix_dedup
from graphloom.llm.common import components

from .conftest import words


def test_filter_merges_without_loss():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(2))
    b[:100] = a[:100]
    cqf = exact_dedup.CountingQuotientFilter
    for skip in (0, 3, 64):
        shared = np.uint64(5 << 61) if skip else np.uint64(0)
        p, q = ((x >> np.uint64(skip) if skip < 64 else x * np.uint64(0)) | shared if skip == 3 else x for x in (a, b))
        if skip == 64:
            continue
        parts = [cqf.from_bytes(cqf.build(x).to_bytes(skip), 5 if skip else 0) for x in (p, q)]
        whole = cqf.merge(parts)
        want = Counter(p.tolist()) + Counter(q.tolist())
        assert dict(zip(whole.prints.tolist(), whole.counts.tolist(), strict=True)) == dict(want)
    assert len(cqf.merge([]).prints) == 0


def test_exact_dedup(docs, corpus, empty):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for i, t in corpus:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    want, stays = Counter(), set()
    for i, t in corpus:
        g = groups[norm(t)]
        best = min(g, key=lambda x: (x[0], x[1], x[2] or 0))
        kept = (-len(t or ""), i) == (best[0], best[2]) and norm(t) not in stays  # one of equal rows
        stays |= {norm(t)} if kept else set()
        want[(i, best[2], len(g), kept, hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in exact_dedup.exact_dedup(docs).collect()) == want
    assert exact_dedup.exact_dedup(empty).collect() == []


def brute_suffix(corpus, length):
    texts = [(i, (t or "").encode()) for i, t in corpus]
    seen = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    out = Counter()
    for i, t in texts:
        hit = np.zeros(len(t) + 1, int)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                hit[s] += 1
                hit[s + length] -= 1
        hit = np.cumsum(hit)[: len(t)] > 0
        edge = np.diff(np.r_[0, hit.astype(int), 0])
        kept = bytes(c for c, h in zip(t, hit, strict=True) if not h)
        out[
            (
                i, len(t), tuple(np.flatnonzero(edge == 1).tolist()), tuple(np.flatnonzero(edge == -1).tolist()),
                hashlib.sha256(kept).hexdigest(),
            )
        ] += 1
    return out


@pytest.mark.parametrize(("length", "wide", "levels"), [(200, 1 << 11, 4), (40, 1 << 11, 4), (40, 1, 0), (40, 1, 2)])
def test_suffix_dedup(docs, corpus, length, wide, levels):
    got = suffix_dedup.suffix_dedup(docs, length, wide, levels).collect()
    assert Counter((r[0], r[1], tuple(r[2]), tuple(r[3]), r[4]) for r in got) == brute_suffix(corpus, length)


def test_suffix_dedup_over_a_segment(spark):
    """Repeats on both sides of the seam between the pieces in which long texts are cut into runs."""
    rng = random.Random(5)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(500)).decode()
    long = "".join(rng.choices("ijklmnop ", k=(1 << 20) + 4000))
    at = (1 << 20) - 250
    rows = [(1, long[:at] + passage + long[at:]), (1, passage + "x"), (None, "y" + passage)]
    got = {
        (r["doc_id"], r["n_bytes"]): list(zip(r["starts"], r["stops"], strict=True))
        for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    }
    assert got[(1, 501)] == [(0, 500)] and got[(None, 501)] == [(1, 501)]
    assert got[(1, len(long) + 500)] == [(at, at + 500)]


def test_suffix_dedup_empty(empty):
    assert suffix_dedup.suffix_dedup(empty).collect() == []


def test_two_stage_sort_finds_all_repeats():
    rng = random.Random(3)
    for alphabet, n in ((b"ab", 60), (b"abc\x00\xff", 80), (b"z", 50)):
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(12, n))) for _ in range(40)]
        counts = [len(t) - 11 for t in texts]
        seen = Counter(t[i : i + 12] for t, k in zip(texts, counts, strict=True) for i in range(k))
        got = suffix_dedup.repeated_suffixes(texts, counts, 12)
        assert [f.tolist() for f in got] == [
            [seen[t[i : i + 12]] > 1 for i in range(k)]
            for t, k in zip(texts, counts, strict=True)
        ]


def test_runs_cut_every_window_once():
    text = words(9, 400).encode()
    h, first, n = suffix_dedup.runs(text, 200)
    assert n.sum() == len(text) - 199 and (first[1:] == first[:-1] + n[:-1]).all() and len(h) == len(n)


def test_golay_anchors_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for flips in (0, 1, 2):
        y = x.copy()
        for _ in range(flips):
            y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
        i, a, own = simhash_dedup.anchors(x, 2)
        j, b, _ = simhash_dedup.anchors(y, 2)
        near = defaultdict(set)
        for k, anchor in zip(j, b, strict=True):
            near[k].add(anchor)
        assert own.sum() == len(x)
        assert all(anchor in near[k] for k, anchor in zip(i[own], a[own], strict=True))


def test_simhash_components(spark, docs, corpus, empty):
    rows = corpus
    prints = [simhash_dedup.fingerprint((t or "").encode()) for _, t in rows]
    p = np.array(prints, np.uint64)
    near = np.bitwise_count(p[:, None] ^ p[None, :]) <= 2
    none = 1 << 60
    label = np.array([none if i is None else i for i, _ in rows])
    while True:
        new = np.where(near, label[None, :], none).min(1)
        if (new == label).all():
            break
        label = new
    got = Counter(tuple(r) for r in simhash_dedup.simhash_dedup(docs).collect())
    assert got == Counter((i, f"{x:016x}", None if c == none else c) for (i, _), x, c in zip(rows, prints, label.tolist(), strict=True))
    assert None in {c for _, _, c in got}
    assert simhash_dedup.simhash_dedup(empty).collect() == []


@pytest.mark.parametrize("heavy", [1 << 14, 3])
def test_simhash_links_dense_prints(spark, heavy):
    """Many prints around few centres: every pair within two bits is connected, without all pairs being made."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 4, dtype=np.uint64)
    prints = np.unique(
        np.concatenate(
            [
                c ^ sum(
                    (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64) for _ in range(2)),
                    np.zeros(300, np.uint64),
                )
                for c in centres
            ]
        )
    )
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")
    root = {r["node"]: r["root"] for r in components(simhash_dedup.links(df, heavy=heavy)).collect()}
    signed = prints.view(np.int64).tolist()
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    for i, j in np.argwhere(near):
        assert root.get(signed[i], signed[i]) == root.get(signed[j], signed[j])
    label = {x: i for i, x in enumerate(signed)}
    names = np.arange(len(prints))
    while True:
        new = np.where(near, names[None, :], len(prints)).min(1)
        if (new == names).all():
            break
        names = new
    assert len({root.get(x, x) for x in signed}) == len({int(names[label[x]]) for x in signed})


def test_fingerprint_is_by_the_definition():
    import re

    import xxhash

    for text in ("", " ", "One", "One two", "A b  C\nd é", words(4, 50)):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash_dedup.fingerprint(text.encode()) == sum(
            1 << b
            for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)
        )


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(0)
    for high in (12, 2**24):
        h = rng.integers(0, high, 90).astype(np.uint64) << np.uint64(40)
        want = set()
        for a in range(len(h)):
            for z in range(a + 9, len(h)):
                k = a + int(h[a : z + 1].argmin())
                left, right = k, k
                while left > 0 and h[left - 1] > h[k]:
                    left -= 1
                while right + 1 < len(h) and h[right + 1] >= h[k]:
                    right += 1
                want.add((left, k, right))
        got = passage_dedup.compact_windows(h, 10)
        assert set(zip(*(x.tolist() for x in got), strict=True)) == want


def test_windows_of_texts_together_are_those_of_each(monkeypatch):
    """Texts go through the scan together: words are hashed a few times for hundreds of texts, not once for each."""
    rng = np.random.default_rng(1)
    sizes = np.array([10, 20, 11, 30, 19, 90, 10])
    for high in (3, 2**24):
        each = [rng.integers(0, high, sizes.sum()).astype(np.uint64) << np.uint64(40) for _ in range(2)]
        for h, (text, *got) in zip(each, passage_dedup.all_windows(each, sizes, 10), strict=True):
            for k, part in enumerate(np.split(h, np.cumsum(sizes)[:-1])):
                want = passage_dedup.compact_windows(part, 10)
                assert [x[text == k].tolist() for x in got] == [x.tolist() for x in want]
    texts = [words(k, int(n)).encode() for k, n in enumerate(rng.integers(0, 90, 300))]
    texts += [b"", b" \t", b"A " * 60, b"x" * 70 + b" b" * 60, "É ünï\n".encode() * 30, b"ab c " * 120_000]
    calls, hashed = [], passage_dedup._words
    monkeypatch.setattr(passage_dedup, "_words", lambda x: calls.append(len(x)) or hashed(x))
    scan = passage_dedup._scan(4, 5, 46)
    batch = lambda p, q: pa.RecordBatch.from_arrays([pa.array(range(p, q)), pa.array(texts[p:q])], ["mark", "text"])
    rows = lambda batches: sorted(r for b in scan(batches) for r in zip(*b.to_pydict().values(), strict=True))
    got = rows([batch(0, len(texts))])
    assert len(calls) < 10
    assert got == sorted(r for k in range(len(texts)) for r in rows([batch(k, k + 1)]))


def test_rows_of_one_key_meet_across_batches(monkeypatch):
    gathered = passage_dedup._gathered
    monkeypatch.setattr(passage_dedup, "_gathered", lambda batches, rows: gathered(batches, 3))
    rng = np.random.default_rng(2)
    for _ in range(40):
        rows = sorted({(int(k), int(m)) for k, m in rng.integers(0, [6, 9], (40, 2))} | {(k, 0) for k in range(6, 9)})
        texts = defaultdict(list)
        for k, m in rows:
            texts[k].append(m)
        each = [(k, m, m, m + 1) for k, m in rows]
        cut = lambda x: (
            pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*x[p : p + 2], strict=True)], names=list("abcd"))
            for p in range(0, len(x), 2)
        )
        got = [r for b in passage_dedup._of_one_key(cut(each)) for r in zip(*b.to_pydict().values(), strict=True)]
        assert got == [(*r, texts[r[0]][0], min(len(texts[r[0]]), 3)) for r in each if len(texts[r[0]]) > 1]
        copies = [r for r in each for _ in range(rng.integers(1, 8))]  # as of equal texts
        got = [r for b in passage_dedup._shared(cut(copies)) for r in zip(*b.to_pydict().values(), strict=True)]
        assert set(got) == {r for r in each if len(texts[r[0]]) > 1}


def test_pairs_of_an_earlier_group_are_passed_over():
    rng = np.random.default_rng(4)
    region = rng.integers(0, 2**60, 60).astype(np.uint64)
    for _ in range(60):
        n = int(rng.integers(2, 12))
        earlier = [np.unique(rng.integers(0, 9, rng.integers(0, 4)).astype(np.uint64)) for _ in range(n)]
        found = [(i, j) for i, j, _ in passage_dedup.missing_links(list(range(n)), [0] * n, earlier, [region] * n, 46, 0.8)]
        apart = {(i, j) for i in range(n) for j in range(n) if i != j and not np.intersect1d(earlier[i], earlier[j]).size}
        assert set(found) <= apart

        def classes(pairs):
            root = list(range(n))
            for i, j in pairs:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
            return root

        assert classes(found) == classes(apart)


def test_signatures_of_one_text_are_not_written(spark, docs, monkeypatch):
    written, settle = [], passage_dedup.settle

    def kept(df, what="settled"):
        out = settle(df, what)
        if what == "signatures":
            written.extend(out.select("key", "mark").collect())
        return out

    monkeypatch.setattr(passage_dedup, "settle", kept)
    passage_dedup.passage_dedup(docs)
    texts = Counter(r["key"] for r in written)
    assert texts and min(texts.values()) > 1 and len(set(written)) == len(written)


def test_passage_dedup(spark, docs, corpus, empty):
    every = passage_dedup.passage_dedup(docs).collect()
    assert Counter(r["doc_id"] for r in every) == Counter(i for i, _ in corpus)
    got = {r["doc_id"]: r for r in every if r["doc_id"] not in (None, 18)}
    rows = {i: (t or "").lower().split() for i, t in corpus if i not in (None, 18)}
    seen = defaultdict(set)
    for i, w in rows.items():
        for s in range(len(w) - 49):
            seen[tuple(w[s : s + 50])].add(tuple(w))
    for i, w in rows.items():
        hit = {p for s in range(len(w) - 49) if len(seen[tuple(w[s : s + 50])]) > 1 for p in range(s, s + 50)}
        found = {p for a, z in zip(got[i]["starts"], got[i]["stops"], strict=True) for p in range(a, z)}
        assert hit <= found
    base = [r["class_id"] for r in every if r["n_words"] == 300]
    assert set(base) == {18} and len(base) > 3  # copies, a repeated row and the near copy
    shared = min(i for i, t in corpus if i and t and corpus[11][1] in t)
    assert {r["class_id"] for r in every if r["doc_id"] is None and r["n_words"] == 80} == {shared}
    assert [
        (r["class_id"], r["starts"])
        for r in every if r["n_words"] in (70, 230)
    ] in ([(18, []), (None, [])], [(None, []), (18, [])])
    clean = [i for i, t in corpus if i not in (None, 18) and t and len(t.split()) == 60]
    assert all(got[i]["starts"] == [] and got[i]["class_id"] == i for i in clean)
    assert passage_dedup.passage_dedup(empty).collect() == []


def test_passages_of_rows_without_or_with_repeated_ids(spark):
    shared = [words(k, 80) for k in range(3)]
    pad = lambda k, s: f"{words(100 + k, 20)} {shared[s]} {words(200 + k, 20)}"
    rows = [
        (None, pad(1, 0)), (1, pad(2, 0)), (1, pad(3, 1)), (2, pad(4, 1)), (None, pad(5, 2)), (None, pad(6, 2)),
        (None, pad(6, 2)), (7, words(9, 90)),
    ]
    got = Counter(
        (r["doc_id"], r["class_id"], r["n_links"])
        for r in passage_dedup.passage_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    )
    assert got == Counter({(None, 1, 1): 1, (1, 1, 1): 2, (2, 1, 1): 1, (None, None, 1): 3, (7, 7, 0): 1})


def test_near_passages_are_found(spark):
    """Recall on passages with changed words, among over 256 texts that link to one first text."""
    rng, texts, want = random.Random(8), [], []
    for g in range(60):
        p = words(2000 + g, rng.randint(70, 120)).split()
        q = list(p)
        q[rng.randrange(len(p))] = f"changed{g}"
        for k, x in enumerate((p, q)):
            texts.append(" ".join([words(7000 + 2 * g + k, 25), *x, words(8000 + 2 * g + k, 25)]))
        a, b = ({" ".join(x[i : i + 5]) for i in range(len(x) - 4)} for x in (p, q))
        want += [(2 * g, 2 * g + 1)] if len(a & b) >= 0.8 * len(a | b) else []
    hot = words(4242, 70)
    first = len(texts)
    texts += [f"{words(20000 + k, 8)} {hot} {words(30000 + k, 8)}" for k in range(600)]
    got = {
        r["doc_id"]: r["class_id"]
        for r in passage_dedup.passage_dedup(
            spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        ).collect()
    }
    assert len(want) > 40 and sum(got[a] == got[b] for a, b in want) >= 0.9 * len(want)
    assert {got[i] for i in range(first, len(texts))} == {first}
    assert all(got[i] // 2 == i // 2 for i in range(first))


def test_equal_passages_meet_among_edited_variants(spark):
    """Brute force: variants with two words changed are first under many keys and fail there."""
    rng, texts = random.Random(11), []
    for g in range(10):
        passage = words(1000 + g, 60).split()
        for k in range(32):
            p = list(passage)
            for at in rng.sample(range(60), 2) if k > 1 else ():
                p[at] = f"changed{g}x{k}x{at}"
            texts.append(" ".join([words(5000 + 100 * g + k, 30), *p, words(9000 + 100 * g + k, 30)]))
    got = {
        r["doc_id"]: r
        for r in passage_dedup.passage_dedup(
            spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        ).collect()
    }
    seen = defaultdict(set)
    split = [t.split() for t in texts]
    for i, w in enumerate(split):
        for s in range(len(w) - 49):
            seen[tuple(w[s : s + 50])].add(i)
    for i, w in enumerate(split):
        found = {p for a, z in zip(got[i]["starts"], got[i]["stops"], strict=True) for p in range(a, z)}
        for s in range(len(w) - 49):
            same = seen[tuple(w[s : s + 50])]
            assert len(same) == 1 or set(range(s, s + 50)) <= found
            assert len({got[j]["class_id"] for j in same}) == 1


def test_similar_passages_meet_among_edited_variants(spark):
    """Brute force over pairs: what is similar, but not equal, meets behind a first text that is like neither."""
    rng, texts, want = random.Random(12), [], []
    for g in range(24):
        passage, sets = words(3000 + g, 60).split(), []
        for k in range(24):
            p = list(passage)
            for at in rng.sample(range(5, 55), 3 if k > 1 else k):
                p[at] = f"changed{g}x{k}x{at}"
            sets.append({" ".join(p[i : i + 5]) for i in range(56)})
            texts.append(" ".join([words(40000 + 100 * g + k, 30), *p, words(50000 + 100 * g + k, 30)]))
        want += [
            (24 * g + i, 24 * g + j) for i in range(24) for j in range(i)
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
        ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in passage_dedup.passage_dedup(frame).collect()}
    assert len(want) >= 24 and sum(got[a] == got[b] for a, b in want) >= 0.95 * len(want)
    assert all(got[i] // 24 == i // 24 for i in got)


def test_missing_links_agree_with_all_pairs():
    rng = np.random.default_rng(9)
    other = lambda n: rng.integers(0, 2**60, n).astype(np.uint64)
    for two in (False, True):
        regions = []
        for _ in range(6):
            p = other(60)
            for _ in range(12):
                q = p.copy()
                at = rng.choice(60, rng.integers(0, 10), replace=False)
                q[at] = other(len(at))
                again = q[: rng.integers(0, 2) * 20]
                regions.append(np.r_[other(rng.integers(0, 30)), q, again, other(rng.integers(0, 9))])
        regions += [np.full(60, 7, np.uint64), np.full(50, 7, np.uint64), other(10)]
        n = len(regions)
        sides = [k % 2 if two else 0 for k in range(n)]
        roots = [k - k % 3 for k in range(n)]
        top = {x: {x} for x in roots}

        def join(pairs):
            sets = {x: {x} for x in top}
            for i, j in pairs:
                both = sets[roots[i]] | sets[roots[j]]
                for x in both:
                    sets[x] = both
            return {x: min(y) for x, y in sets.items()}

        every = [
            (i, j) for i in range(n) for j in range(n)
            if i < j and (not two or sides[i] != sides[j])
            and passage_dedup.similar_passages(regions[i], regions[j], 46, 0.8)
        ]
        none = [np.zeros(0, np.uint64)] * n
        got = [(i, j) for i, j, _ in passage_dedup.missing_links(roots, sides, none, regions, 46, 0.8)]
        assert len(every) > 50 and join(got) == join(every)
        assert len(got) < len(set(roots))
        # A pair with an earlier key in common is compared there.
        same = [np.array([5], np.uint64)] * n
        assert list(passage_dedup.missing_links(roots, sides, same, regions, 46, 0.8)) == []


@pytest.mark.parametrize("block_tokens", [1 << 20, 300])
def test_keys_of_the_same_texts_are_compared_once(spark, monkeypatch, block_tokens):
    """Under 20 keys a text's tokens go out once for each block, not once for each key; in blocks no link is lost."""
    p, q = words(70, 60).split(), words(72, 60).split()
    p2, q2 = list(p), list(q)
    p2[30], q2[20] = "changed", "changed"
    start = words(73, 12)
    passages = [p, p2, q, q2, words(74, 60).split(), words(75, 60).split()]
    rows = [(k + 1, f"{start} {' '.join(x)}".encode()) for k, x in enumerate(passages)]
    texts = spark.createDataFrame(rows, "mark long, text binary")
    signed = spark.createDataFrame([(1000 + key, k, 0, 67) for key in range(20) for k, _ in rows], "key long, mark long, lo int, hi int")
    written = {}

    def settle(df, what="settled"):
        written[what] = out = df.localCheckpoint()
        return out

    monkeypatch.setattr(passage_dedup, "settle", settle)
    monkeypatch.setattr(passage_dedup, "discard", lambda df: None)
    monkeypatch.setattr(passage_dedup, "_BLOCK_TOKENS", block_tokens)
    linked = spark.createDataFrame([], passage_dedup._LINKS)
    found = passage_dedup.missing_pairs(signed, texts, linked, 46, 5, 0.8).collect()
    assert {frozenset((r["id"], r["first"])) for r in found} == {frozenset((1, 2)), frozenset((3, 4))}
    assert written["members"].count() == 6
    if block_tokens == 300:  # the two that are like none don't go to the blocks
        assert {r["mark"] for r in written["wide"].collect()} == {1, 2, 3, 4}


def test_similar_stretches_agree_with_brute_force():
    rng, hits = np.random.default_rng(3), 0
    other = lambda n: rng.integers(0, 2**60, n).astype(np.uint64)
    for _ in range(300):
        x = other(70)
        y = np.where(rng.random(70) > rng.choice([0.02, 0.1, 0.15, 0.2]), x, other(70))
        if rng.random() < 0.3:
            k = rng.integers(70)
            y = np.r_[y[:k], other(rng.integers(1, 14)), y[k:]]
        x, y = np.r_[other(5), x, other(8)], np.r_[other(9), y, other(3)]
        place = {v: i for i, v in enumerate(x.tolist())}
        at, to = np.array([(place[v], j) for j, v in enumerate(y.tolist()) if v in place]).reshape(-1, 2).T
        n_x, n_y = at[None, :] - at[:, None] + 1, to[None, :] - to[:, None] + 1
        both = np.arange(len(at))[None, :] - np.arange(len(at))[:, None] + 1
        want = ((n_x >= 46) & (n_y >= 46) & (both >= 0.8 * (n_x + n_y - both) - 1e-9)).any()
        got = passage_dedup.similar_passages(x, y, 46, 0.8)
        assert bool(got) == want
        hits += want
        for a, z, b, w in got:
            p, q = set(x[a : z + 1].tolist()), set(y[b : w + 1].tolist())
            assert len(p & q) >= 0.8 * len(p | q) - 1e-9
    assert 100 < hits < 250


def test_word_hashes_tell_words_apart():
    long = b"x" * 100 + b" " + b"X" * 100 + b" x" * 9
    for text in (b"", b" ", b"A bc  DE\tde\x0bh ", long, "É é Ünï".encode(), b"ab c " * 300_000):
        names = text.lower().split()
        got = passage_dedup.word_hashes(text).tolist()
        assert len(got) == len(names) and len(set(zip(got, names, strict=True))) == len(set(got)) == len(set(names))


def test_similar_passages_are_verified():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**60, 200).astype(np.uint64)
    b = np.r_[rng.integers(0, 2**60, 30).astype(np.uint64), a[50:150], rng.integers(0, 2**60, 30).astype(np.uint64)]
    assert passage_dedup.similar_passages(a, b, 46, 0.8) == [(50, 149, 30, 129)]
    b[60:110:2] = rng.integers(0, 2**60, 25).astype(np.uint64)
    assert passage_dedup.similar_passages(a, b, 46, 0.8) == []


def test_similar_passages_where_tokens_repeat():
    rng = np.random.default_rng(4)
    other = lambda n: rng.integers(0, 2**60, n).astype(np.uint64)
    covers = lambda got, side, a, z: any(g[side] <= a and g[side + 1] >= z for g in got)
    p = other(56)
    x = np.r_[other(20), p, other(20)]
    y = np.r_[other(9), p[:26], other(70), p, other(9)]  # its opening stands earlier, too
    assert covers(passage_dedup.similar_passages(x, y, 46, 0.8), 0, 20, 75)
    assert covers(passage_dedup.similar_passages(y, x, 46, 0.8), 0, 105, 160)
    long = other(120)
    near = long.copy()
    near[40:45] = other(5)  # one word changed behind the repeated opening
    got = passage_dedup.similar_passages(long, np.r_[near[:30], other(50), near], 46, 0.8)
    assert covers(got, 0, 0, 119) and covers(got, 2, 80, 199)
    got = passage_dedup.similar_passages(x, np.r_[p, other(30), p], 46, 0.8)  # a second copy
    assert covers(got, 2, 0, 55) and covers(got, 2, 86, 141)
    same = np.full(3000, 7, np.uint64)  # one word over and over
    got = passage_dedup.similar_passages(same[:2000], same, 46, 0.8)
    assert covers(got, 0, 0, 1999) and {k for g in got for k in range(g[2], g[3] + 1)} == set(range(3000))
    for _ in range(200):  # brute force over few tokens
        x, y = (rng.integers(0, 2, rng.integers(5, 30)).astype(np.uint64) for _ in range(2))
        got = passage_dedup.similar_passages(x, y, 5, 0.8)
        for i in range(len(x) - 4):
            for j in range(len(y) - 4):
                if (x[i : i + 5] == y[j : j + 5]).all():
                    assert covers(got, 0, i, i + 4) and covers(got, 2, j, j + 4)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {100 + k: 100 for k in range(1, 30)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_batch_sizes_hold_inside_operators(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "5000")
    try:
        for operator in (exact_dedup.exact_dedup, simhash_dedup.simhash_dedup, passage_dedup.passage_dedup):
            operator(docs)
            assert spark.conf.get(name) == "5000"
    finally:
        spark.conf.unset(name)


def test_words_are_counted_over_many_texts():
    rng = random.Random(6)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 5, 30]) for _ in range(rng.randrange(12))]
        texts = ["".join(rng.choice("ab \t\x0b\x1fé") for _ in range(n)).encode() for n in sizes]
        whole = pa.array(texts, pa.binary())
        for part in (whole, whole.slice(2), whole.slice(1, 3)):
            assert passage_dedup.word_counts(part).tolist() == [len(t.split()) for t in part.to_pylist()]


def test_spans_of_a_run_are_joined(spark):
    """Windows counted one by one, the whole run and parts of it come back as maximal spans."""
    from graphloom.llm.suffix_dedup import _maximal

    spans = [(1, 1, i, i + 1) for i in range(50)] + [(1, 1, 60, 70), (1, 1, 65, 67), (1, 1, 70, 75), (1, 2, 3, 4), (2, 1, 0, 9)]
    got = _maximal(spark.createDataFrame(spans * 2, "gram long, body long, a long, z long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 0, 50), (1, 1, 60, 75), (1, 2, 3, 4), (2, 1, 0, 9)]
