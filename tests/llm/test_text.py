import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, html_extract, language_id, mixing, token_output, toxicity
from graphloom.llm.common import crc_mod

from .conftest import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_decontaminate(spark, docs, corpus, empty):
    long = words(1, 80).split()
    items = [
        (1, " ".join(long[10:40])), (2, "Two, WORDS!"), (3, None), (4, ""), (5, words(77, 30)), (6, "  ONE "),
        (6, "one"), (10, " ".join(long[20:31])),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = Counter()
    for i, t in items:
        w = WORD.findall(fold(t))
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[(str(i), tuple(w[s : s + 10]))] += 1
    want = Counter()
    for i, t in corpus:
        w, hit, found = WORD.findall(fold(t)), set(), set()
        for item, win in windows:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(item)
        want[(i, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit))] += 1
    got = decontaminate.decontaminate(docs, bench).collect()
    assert Counter(
        (r["id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"])
        for r in got
    ) == want
    assert any(x[2] for x in want)
    assert decontaminate.decontaminate(empty, bench).collect() == []
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_decontaminate_by_shuffle(spark, docs, corpus):
    """With nothing broadcast the result is the same."""
    bench = spark.createDataFrame(
        [(1, corpus[6][1]), (2, "two words"), (3, "ab ab ab"), (4, "words")], "item_id long, text string",
    )
    rows = lambda limit: Counter(
        (r["key"], r["n_hit"], *r["items"])
        for r in decontaminate.decontaminate(docs, bench, limit=limit).collect()
    )
    assert rows(0) == rows(1000) and any(k[1] for k in rows(0))
    near = lambda limit: Counter(
        tuple(r)
        for r in decontaminate.near_matches(docs, bench, slop=3, limit=limit).collect()
    )
    assert near(0) == near(1000)


@pytest.mark.parametrize("slop", [0, 1, 5])
def test_proximity(spark, slop):
    rng = random.Random(3)
    texts = [
        " ".join(rng.choice("abcdz") for _ in range(rng.randint(0, 40)))
        for _ in range(60)
    ] + ["c x b y a", "a " + "z " * 30 + "b c", "a b", None]
    items = [(1, "a b c"), (2, "d"), (3, "b b a"), (4, "q a")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {
        (r["id"], r["item"], r["pos"])
        for r in decontaminate.near_matches(
            docs, spark.createDataFrame(items, "item_id long, text string"), slop=slop,
        ).collect()
    }
    seen = Counter(w for t in texts for w in (t or "").split())
    want = set()
    for item, phrase in items:
        terms = phrase.split()
        rarest = min(range(len(terms)), key=lambda k: (seen[terms[k]], terms[k], k))
        for i, t in enumerate(texts):
            w = (t or "").split()
            want |= {
                (i, str(item), p)
                for p, x in enumerate(w) if x == terms[rarest] and set(terms) <= set(w[max(0, p - slop) : p + slop + 1])
            }
    assert got == want and (slop == 0 or want)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav>
<!-- ad --><div class="ad">Buy</div>%s<aside>Side</aside><div id="cookie-notice">We use cookies</div><footer>&copy; x &middot; y</footer></body></html>"""


def lines_of(page):
    got = html_extract.page_lines(page)
    return html_extract.main_lines([x for x, _ in got], [k for _, k in got])


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (
            "<article><h1>A &amp; B</h1><p><b>One<br>two   three<p>Four&nbsp;five</p></article>",
            "A & B One two three Four five",
        ),
        ("<main><p>Main <i>te</i>xt</p><div class='comments'><p>Nice!</p></div></main>", "Main text"),
        (
            "<article><header><h1>H</h1></header><p>Body</p><form><input><label>L</label></form><div class='share-buttons'>S</div></article>",
            "H Body",
        ),
        ("<article><p>a<script>1 < 2</script>b</p><p>and more</p></article>", "a b and more"),
        ("<article><p title='x > y'>question</p><table><tr><td>1<td>2</table></article>", "question 1 2"),
        ("<article><p data=it's>Hello</p><p>don't</p><p>y</p></article>", "Hello don't y"),
        ("<article><p data=it's>Hello there</p></article>", "Hello there"),
        (
            "<article><section id='related-work'><p>Related work</p></section><p class='share-price'>Price</p><label>Name</label></article>",
            "Related work Price Name",
        ),
        (
            "<article><p>short</p></article><p>The text itself stands beside the teaser</p>",
            "short The text itself stands beside the teaser",
        ),
        ("<p a=1 =b c = 'd' e= f/ g>text</p><p x='y>lost</p>", "text"),
        ("<!--><p>one</p><!-- --!><p>two</p></ x><?php y?><p>three</p>", "one two three"),
    ],
)
def test_page_lines(body, want):
    page = PAGE % body
    assert " ".join(lines_of(page)) == want
    assert html_extract.page_lines("") == []


def test_neighbours_and_differences_by_brute_force(spark):
    rng = random.Random(7)
    menu = ["Home", "News", "About us", "Terms", "Contact"]
    rows = []
    for i in range(400):
        site = rng.choice(["a.example", "b.example", "c.example"])
        path = rng.choice([f"/{i}", f"/one/{rng.randrange(9000)}/x", f"/y/{rng.choice('abc')}"])
        words_ = [
            rng.choice(menu)
            for _ in range(rng.randint(0, 6))
        ] + [f"Story {i} {k}" for k in range(rng.randint(0, 3))]
        rng.shuffle(words_)
        marked = i % 7 == 0
        rows.append(
            (
                i if i % 50 else None, f"http://{site}{path}",
                "".join(f"<p>{w}</p>" for w in words_) + (
                    f"<article><p>{'Article text ' * 9}{i}</p></article>" if marked else ""
                ),
            )
        )
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    parsed = []
    for i, url, page in rows:
        got = html_extract.page_lines(page)
        parsed.append((*html_extract._host_path(url), i, [x for x, _ in got], [k for _, k in got]))
    # Pages of one path are in no set order: any order's results count.
    by = {}
    for r in parsed:
        by.setdefault(r[0], []).append(r)
    allowed = {}
    for host, of in by.items():
        paths = sorted({r[1] for r in of})
        for r in of:
            same = [q for q in of if q[1] == r[1] and q is not r]
            k = paths.index(r[1])
            near = same + [q for q in of if q[1] in paths[k + 1 : k + 2]] + [
                q
                for q in of if q[1] in paths[max(0, k - 1) : k]
            ]
            outer = lambda q: [q[3][i] for i in html_extract.outer_places(q[4])]
            allowed.setdefault(r[2], []).append(
                {
                    tuple(html_extract.main_lines(r[3], r[4], html_extract.shared(outer(r), outer(q))))
                    for q in near
                } | ({()} if not near else set())
            )
    for r in html_extract.extract_text(pages).collect():
        assert any(tuple(r["lines"]) in options for options in allowed[r["page_id"]])


def test_longest_common_subsequence():
    rng = random.Random(0)
    for n in [12] * 300 + [70] * 30:
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, n))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = sorted(html_extract.shared(a, b))
        assert len(got) == table[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in got)  # in order
    many = ["x", "y"] * 10_000
    assert len(html_extract.shared(many, many[1:])) == len(many) - 1


def test_hits_exceptions_and_bounds():
    m = toxicity.Lexicon({"trash": 2.0}, ["trash can"]).matcher()
    assert [h[2] for h in m.hits("trash, trashy trash can. trash")] == ["trash", "trash"]
    m = toxicity.Lexicon({"idio*": 2.0}, ["not idiotic", "idio* can", "no idio*"]).matcher()
    assert [h[0] for h in m.hits("idiot, not idiotic, idiots can, not idiots, no idiocy")] == [0, 36]
    assert toxicity.Lexicon().matcher().score("anything") < 1e-20


def test_toxicity_exceptions_of_stems_are_learned(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1500):
        text = words(i, 30).split()
        toxic = i % 3 == 0
        if toxic:
            text.insert(rng.randrange(30), rng.choice(["rottenly", "rottening", "rottened", "rottens"]))
        elif i % 3 == 1 and i % 2:
            text[9:9] = ["never", "rottenness"]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    matcher = lexicon.matcher()
    assert matcher.score("x rottenly y") > 0.5 > matcher.score("x never rottenness y")


def test_samples_are_bounded_by_rows(spark):
    """One id 3,000 times, with texts of its own or one text, and labels of documents that aren't there."""
    rows = [
        (1, f"text number {i}", "aa")
        for i in range(3000)
    ] + [(i, "one text", "bb") for i in range(2, 60)] + [(None, "no id", "cc")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5000)], "doc_id long, toxic int")
    took = toxicity.training_rows(docs, labels, F.lit(True), 100).collect()
    assert 1 < len(took) <= 100
    keys = docs.select("doc_id", F.xxhash64("text").alias("mark"), "lang")
    got = Counter(r["lang"] for r in language_id.sample(keys, 100).collect())
    assert got == {"aa": 33, "bb": 33, "cc": 1}
    model = language_id.fit(docs, crc_mod("doc_id", 4) != 2, 100)
    assert model.langs == ["aa", "bb"]
    for module, n in ((toxicity, 5), (language_id, 4)):
        held = docs.select(module.held_out("doc_id", n, 0)).collect()
        assert all(r[0] is not None for r in held)


def test_differencing_on_unmarked_pages(spark):
    page = "<html><body><p>Site name</p><p>%s</p><p>All rights</p></body></html>"
    rows = [(i, f"http://h.example/news/{i}", page % f"Story {i}") for i in range(5)] + [
        (9, "http://other.example/1", page % "Alone"), (10, None, None), (11, "::bad url[", ""),
        (0, "http://h.example/news/0", page % "Story 0"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = Counter((r["page_id"], tuple(r["lines"])) for r in html_extract.extract_text(pages).collect())
    assert all(got[(i, (f"Story {i}",))] for i in range(2, 5))
    assert got[(9, ("Site name", "Alone", "All rights"))] == 1
    assert got[(10, ())] == got[(11, ())] == 1
    assert html_extract.extract_text(pages.limit(0)).collect() == []


def test_unmarked_pages_alone_in_their_folders(spark):
    page = "<html><body><p>Site name</p><p>%s</p><p>All rights</p></body></html>"
    urls = [f"http://h.example/post/{i * 5000}/title-{i}" for i in range(40)] + [
        f"http://k{i}.example/{d}/"
        for i in range(20)
        for d in ("a/b", "2024/05/17/slug")
    ]
    pages = spark.createDataFrame(
        [(i, u, page % f"Story {i}") for i, u in enumerate(urls)], "page_id long, url string, html string",
    ).repartition(7)
    got = {r["page_id"]: r["lines"] for r in html_extract.extract_text(pages).collect()}
    assert got == {i: [f"Story {i}"] for i in range(len(urls))}
    light = spark.createDataFrame(
        [(i, f"h{i // 5}", f"/{i:03}") for i in range(203)], "row long, host string, path string",
    ).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        near = {r["row"]: r["other"] for r in html_extract._neighbours(light.where("row < 201")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert near == {i: i + 1 if i % 5 < 4 and i < 200 else None if i == 200 else i - 1 for i in range(201)}


def test_folding():
    assert toxicity.fold("1D10T") == "idiot" and toxicity.fold("mor0n!") == "moron!"
    assert toxicity.fold("Idіоt") == "idiot" and toxicity.fold("stÚpìd") == "stupid"
    assert toxicity.fold("in 1990, 50$") == "in 1990, 50$"


def test_toxicity_learns(spark):
    rng = random.Random(2)
    bad = ["vile", "scumm", "rotten"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = words(i, 40).split()
        if toxic:
            text[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(700, None), (701, ""), (702, "V1LE"), (703, "x " * 20000 + "rotten")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(1))
    known = spark.createDataFrame([*labels, (1, None, None)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(docs, known)
    assert set(lexicon.weights) == set(bad)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lexicon).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in held)
    assert got[702] > 0.5 and 0 <= got[700] == got[701] < 0.5
    assert toxicity.reject(docs, lexicon).where("doc_id < 600").count() == 480
    assert toxicity.score(docs.limit(0), lexicon).collect() == []
    none = toxicity.fit(docs, known.limit(0))
    assert {
        r["score"]
        for r in toxicity.score(docs, none).collect()
    } < {0.0} | {x for x in [1 / (1 + np.exp(50))]} | {1 / (1 + np.exp(50.0))}


def test_language_id(spark):
    letters = {"aa": "abcdefg", "bb": "hijklmn", "cc": "aeiouéè"}
    rng = random.Random(1)
    rows = []
    for i in range(240):
        lang = sorted(letters)[i % 3]
        rows.append(
            (i, " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(rng.randint(3, 60))), lang)
        )
    rows += [(500, None, "aa"), (501, "", "aa"), (502, "12 ... 34", "bb"), (503, "abcdefg " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    model = language_id.fit(docs, crc_mod("doc_id", 4) != 2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    held = [(i, lang) for i, _, lang in rows[:240] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i][0] == lang for i, lang in held) >= 0.97 * len(held)
    assert got[500] == got[501] == got[502] == ("und", 0.0) and got[503][0] == "aa"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language_id.identify(docs.limit(0), model).collect() == []
    assert {
        r["lang_pred"]
        for r in language_id.identify(docs, language_id.fit(docs.limit(0), F.lit(True))).collect()
    } == {"und"}


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    rows = [(np.array([k % 2, 2 + int(rng.integers(50))]), np.array([1.0, 0.2]), k % 2) for k in range(200)]
    w = language_id.train_ftrl(rows, 2, 60, l1=0.05)
    assert w[0, 0] > 0 > w[1, 0] and (w[:, 55:60] == 0).all()
    t = language_id.best_temperature(np.array([[4.0, 0], [0, 4.0], [4.0, 0]]), np.array([0, 1, 1]))
    assert t > 1


@pytest.mark.parametrize(
    ("sizes", "weights", "share", "want"),
    [
        (
            [10, 10, 10], (5, 2, 1), 1.5, [20.0, 50 / 3, 25 / 3],
        ), ([1, 1], (1,), 50, [2.0, 2.0]), ([0, 4], (5, 2), 1.5, [0.0, 6.0]), ([], (5, 2, 1), 1.5, []),
        (
            [8, 8], {"s0": 0, "s1": 3}, 1, [0.0, 16.0],
        ), ([8, 8], {"s0": 0, "s1": 0}, 1, [0.0, 0.0]), ([30, 10, 20], {}, 1, [20.0, 20.0, 20.0]),
    ],
)
def test_targets(spark, sizes, weights, share, want):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, n long")
    got = mixing.targets(rows, weights, share).orderBy("k").collect()
    assert [r["target"] for r in got] == pytest.approx(want)


def queued(corpus, packet):
    """Brute force: (source targets, units in the order of service, rows) of the mix."""
    rows = [(i, f"s{(i or 0) % 3}" if i != 9 else None, t or "") for i, t in corpus]
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sized = [
        (
            src, md5(":".join([*([] if i is None else [str(i)]), "7", md5(t)])), i,
            len(re.findall(r"[^\x20\x09-\x0D]+", t)),
        )
        for i, src, t in rows
    ]
    names = sorted({r[0] for r in sized}, key=lambda x: (x is None, x or ""))
    n = {s: sum(r[3] for r in sized if r[0] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, budget = {}, set(names), 1.5 * sum(n.values())
    while open_:
        left, whole = budget - sum(target.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole >= 2 * n[s]]
        if not over:
            target |= {s: left * weight[s] / whole for s in open_}
            break
        target |= {s: 2 * n[s] for s in over}
        open_ -= set(over)
    units = []
    for k, s in enumerate(names):
        at = 0
        for _ in range(2):
            for _, turn, i, size in sorted((r for r in sized if r[0] == s), key=lambda r: r[1]):
                step = size if not size or (at + size) / target[s] <= 1 else packet
                units += [
                    (
                        (at + min(o + step, size)) / target[s], k, at + min(o + step, size), (i, turn),
                        min(step, size - o),
                    )
                    for o in range(0, size, step or 1)
                ]
                at += size
    return target, n, sorted(units), math.floor(budget)


@pytest.mark.parametrize("packet", [1, 16])
def test_mix_is_the_truncated_schedule(docs, corpus, empty, packet):
    target, n, units, budget = queued(corpus, packet)
    want, left = Counter(), budget
    for _, _, _, (i, _), u in units:
        want[i] += min(u, left)
        left -= min(u, left)
    schedule, sized = mixing.mix(docs, packet=packet)
    rows = schedule.collect()
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["taken"]
    assert +got == +want and sum(got.values()) == budget
    by = {r["source"]: (r["source_size"], r["target"]) for r in sized.collect()}
    assert by.keys() == target.keys() and None in by
    assert all(by[s] == (n[s], pytest.approx(target[s])) for s in by)
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 2 * packet for s in by)
    order = sorted(rows, key=lambda r: r["before"])
    assert [r["finish"] for r in order] == sorted(r["finish"] for r in rows)
    again, _ = mixing.mix(docs, packet=packet)
    assert Counter(
        (r["doc_id"], r["copy"], r["before"], r["taken"])
        for r in again.collect()
    ) == Counter((r["doc_id"], r["copy"], r["before"], r["taken"]) for r in rows)
    schedule, sized = mixing.mix(empty)
    assert schedule.collect() == sized.collect() == []


def test_sources_without_weight_give_nothing(spark):
    docs = spark.createDataFrame(
        [(i, "a b c", f"s{i % 2}") for i in range(40)], "doc_id long, text string, source string",
    )
    schedule, sized = mixing.mix(docs, {"s0": 0, "s1": 1})
    assert {r["source"] for r in schedule.collect()} == {"s1"} and sized.count() == 40


def test_mix_by_given_weights_and_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_CHUNK", 50)
    rows = [(None, "a b c", "x")] * 300 + [(i, "d e", "y") for i in range(300)]
    schedule, sized = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"y": 3}, 0.5)
    taken = Counter()
    for r in schedule.collect():
        taken[(r["source"], r["member"])] += r["taken"]
    assert sum(taken.values()) == 750 and sized.count() == 301
    assert abs(sum(v for (s, _), v in taken.items() if s == "x") - 187.5) <= 16
    assert all(v <= 3 for v in taken.values() if v) or max(taken.values()) <= 2 * 600


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for width in (1, 3, 8, 13, 16, 17, 24, 32):
        for n in (0, 1, 7, 4096, 10001):
            ids = rng.integers(0, 2**width, n).astype(np.uint32)
            packed = token_output.PackedFile(token_output.pack(ids, width))
            assert (packed.read() == ids).all() and (packed.read(5, 4200) == ids[5:4200]).all()
    with pytest.raises(ValueError):
        token_output.pack(np.array([8], np.uint32), 3)


def test_whole_texts_go_to_the_tokenizer():
    path = token_output.default_tokenizer()
    plain = token_output.encoder(path)
    texts = ["", "Don't, 'send we'LL. ", "<|endoftext|>x <|ENDOFTEXT|>", "a\x1cb\x85c", "été, …, x. y", words(3, 9000)]
    assert [x.tolist() for x in token_output.encode(plain, texts)] == [
        plain.encode(t, add_special_tokens=False).ids
        for t in texts
    ]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_output(docs, corpus, empty, file):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(file)
    plain = Tokenizer.from_file(path)
    got = token_output.token_output(docs, path).collect()
    assert [
        r["doc_id"]
        for r in sorted(got, key=lambda r: r["start"])
    ] == sorted((i for i, _ in corpus), key=lambda i: (i is not None, i))
    want = Counter()
    for i, t in corpus:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert token_output.token_output(empty, path).collect() == []
