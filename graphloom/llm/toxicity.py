"""Toxicity by a weighted lexicon.

Texts are folded (lower case, homoglyphs and accents to Latin letters, digit and
symbol substitutions to letters) and scanned once by an Aho-Corasick automaton over
the lexicon and the exception phrases. Entries are words or, with a star, stems; hits
count at word bounds only, a stem's at its beginning, and a hit inside an exception
phrase doesn't count. The summed weights, plain and normalised
by length, go through a logistic calibration.

The lexicon, the exceptions and the calibration are learned from at most
`max_rows` labelled texts, taken by the hashes of their id and text; scoring covers
all rows and whole texts.

Defined results: null and empty texts get the score of a text without hits; if no
rows are labelled every score is below 1e-20; documents with conflicting labels count
as toxic in training; rows without an id are never learned from and not held out;
repeated rows are scored alike; other columns are ignored; an empty
table gives an empty result.
"""

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, held_out, id_text, settle, small_batches, table

# What stands in for a letter.
SUBSTITUTES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i",
}
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "​": "", "‌": "", "‍": "", "­": "", "﻿": "",
}


def _table() -> dict[int, str]:
    out = {}
    for i in [
        *range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800),
        *range(0x2460, 0x2500),
    ]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c)).lower()
        if base and base != chr(i) and base.isascii() and base.isalnum():
            out[i] = base
    out |= {i: "" for i in range(0x300, 0x370)}
    return out | {ord(k): v for k, v in HOMOGLYPHS.items()}


_FOLD = _table()
_LEET = str.maketrans(SUBSTITUTES)
_MIXED = re.compile(r"[0-9a-z@$!|]*[0-9@$!|][0-9a-z@$!|]*")
_STEM = (4, 8)
_COUNTED_AT_ONCE = 150_000
_TERM = re.compile(r"[^\W\d_]{3,24}")


def fold(text: str) -> str:
    """Lower case, homoglyphs to letters, and substitutions in words that have a letter on either side or hold letters."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)

    def leet(m: re.Match) -> str:
        w = m[0]
        if not re.search("[a-z]", w):
            return w
        tail = len(w) - len(w.rstrip("!|"))  # closing marks are marks
        return w[: len(w) - tail].translate(_LEET) + w[len(w) - tail :]

    return _MIXED.sub(leet, text)


def _tally(by: tuple[Counter, Counter]) -> pa.RecordBatch:
    """(term, pos, neg) of two counters, which are emptied."""
    words = list(by[0].keys() | by[1].keys())
    out = pa.RecordBatch.from_arrays(
        [pa.array(words, pa.string()), *[pa.array([c[w] for w in words], pa.int64()) for c in (by[1], by[0])]],
        ["term", "pos", "neg"],
    )
    by[0].clear()
    by[1].clear()
    return out


def _entries(words: set[str]) -> set[str]:
    """The words, and the stems of those that go on."""
    return words | {f"{w[:n]}*" for w in words for n in range(_STEM[0], min(_STEM[1], len(w) - 1) + 1)}


def _chosen(candidates: list[tuple[str, float]], max_terms: int) -> dict[str, float]:
    """Of entries by falling evidence, those that neither hold nor are held by one before them."""
    out: dict[str, float] = {}
    shut: set[str] = set()
    for term, weight in candidates:
        text = term.removesuffix("*")
        ups = {f"{text[:n]}*" for n in range(_STEM[0], len(text) + 1)}
        if len(out) < max_terms and not ups & out.keys() and not (term[-1] == "*" and term in shut):
            out[term] = weight
            shut |= ups
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coef: tuple[float, ...] = (0.0, 0.0)
    bias: float = -50.0

    def matcher(self) -> "Matcher":
        return Matcher(self)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for phrase in lexicon.exceptions:
            # After a star, which stands for the rest of a word, only the end of the phrase is left to compare.
            head, star, tail = phrase.partition("*")
            rest = re.compile(rf"\w*{re.escape(tail)}") if star else None
            self.automaton.add_word(head, [*self.automaton.get(head, []), (len(head), None, rest)])
        for term, weight in lexicon.weights.items():
            text = term.removesuffix("*")
            self.automaton.add_word(text, [*self.automaton.get(text, []), (len(text), weight, term)])
        self.any = bool(len(self.automaton))
        if self.any:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, str, float]]:
        """(start, end, term, weight) of counted hits."""
        if not self.any:
            return []
        found, spared = [], []
        for last, entries in self.automaton.iter(folded):
            for n, weight, term in entries:
                a, z = last + 1 - n, last + 1
                stem = weight is not None and term[-1] == "*"
                if weight is None and term is not None:
                    if not (rest := term.match(folded, z)):
                        continue
                    z = rest.end()
                if (a and folded[a - 1].isalnum()) or (z < len(folded) and folded[z].isalnum() and not stem):
                    continue
                (spared if weight is None else found).append((a, z, term, weight))
        if not spared:
            return found
        # Exceptions by start, with the furthest end of those that start no later.
        spared.sort(key=lambda s: s[0])
        starts, reach = [s[0] for s in spared], list(accumulate((s[1] for s in spared), max))
        return [h for h in found if not (k := bisect_right(starts, h[0])) or reach[k - 1] < h[1]]

    def features(self, text: str) -> tuple[float, float]:
        """log of the summed weights, and of the weights per hundred words."""
        got = self.hits(fold(text))
        if not got:
            return 0.0, 0.0
        total = sum(h[3] for h in got)
        return math.log1p(total), math.log1p(100 * total / (20 + text.count(" ")))

    def score(self, text: str) -> float:
        z = self.lexicon.bias + sum(c * x for c, x in zip(self.lexicon.coef, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def training_rows(
    docs: DataFrame, labels: DataFrame, eligible, max_rows: int, id_col="doc_id", text_col="text", label_col="toxic",
) -> DataFrame:
    """At most max_rows distinct labelled texts (text, label), taken by the hashes of id and text.

    Only labels of documents that are there count; a repeated id adds no rows beyond the bound.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & eligible)
        .groupBy(F.col(id_col).cast("long").alias("doc_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
    )
    rows = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    light = (
        rows.select("doc_id", "mark")
        .join(known, "doc_id")
        .groupBy("doc_id", "mark")
        .agg(F.max("label").alias("label"))
    )
    chosen = light.orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(max_rows)  # bounded, so it can be broadcast
    taken = rows.join(F.broadcast(chosen), ["doc_id", "mark"])
    return (
        taken.groupBy(F.md5(F.col("text").cast("binary")).alias("key"))
        .agg(F.first("text").alias("text"), F.max("label").alias("label"))
        .select("text", "label")
    )


def learn(
    rows: DataFrame, max_terms: int = 2000, min_docs: int = 5, min_evidence: float = 15.0, min_weight: float = 2.0,
    min_spread: float = 0.15,
) -> Lexicon:
    """rows: (text, label). A term needs min_evidence nats against the chance that its toxic share is the common one."""
    rows = settle(rows, "labelled")
    counts = dict(rows.groupBy("label").count().collect())
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        return Lexicon()

    def terms(batches):
        by: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by[label].update(_entries(set(_TERM.findall(fold(text)))))
                if len(by[0]) + len(by[1]) > _COUNTED_AT_ONCE:
                    yield _tally(by)
        yield _tally(by)

    found = (
        rows.mapInArrow(terms, "term string, pos long, neg long")
        .groupBy("term")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    logit = lambda k, n: F.log((F.col(k) + 0.5) / (n - F.col(k) + 0.5))
    found = found.where(F.col("pos") >= min_docs).withColumn("weight", logit("pos", n1) - logit("neg", n0))
    share, common = F.col("pos") / (F.col("pos") + F.col("neg")), n1 / (n1 + n0)
    against = F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - common))).otherwise(0.0)
    found = found.withColumn("evidence", F.col("pos") * F.log(share / common) + against).where(
        (share > common) & (F.col("evidence") >= min_evidence) & (F.col("weight") >= min_weight)
    )
    best = (
        found.orderBy(F.desc("evidence"), F.desc(F.length(F.regexp_replace("term", "[*]", ""))), "term")
        .limit(20 * max_terms)
        .collect()
    )
    lexicon = Lexicon(_chosen([(r["term"], float(r["weight"])) for r in best], 2 * max_terms))

    def contexts(batches):
        matcher, seen = lexicon.matcher(), set()
        for b in batches:
            for text in b.column(0).to_pylist():
                folded, first = fold(text), {}
                for a, z, term, _ in matcher.hits(folded):
                    first.setdefault(term, (folded[max(0, a - 12) : a], folded[z : z + 12]))
                seen |= {(term, *place) for term, place in first.items()}
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in seen], pa.string()) for i in range(3)], ["term", "before", "after"],
        )

    # Where an entry first stands in a text: words of near copies have few such places, those of their own accord many.
    places = (
        rows.where("label = 1")
        .mapInArrow(contexts, "term string, before string, after string")
        .distinct()
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("places"))
    )
    spread = found.join(places, "term").where(
        (F.col("places") >= min_spread * F.col("pos")) & (
            F.col("evidence") * F.col("places") / F.col("pos") >= min_evidence
        )
    )
    lexicon = Lexicon(
        {r["term"]: float(r["weight"]) for r in spread.orderBy(F.desc("evidence"), "term").limit(max_terms).collect()}
    )

    def phrases(batches):
        matcher, by = lexicon.matcher(), (Counter(), Counter())
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folded, seen = fold(text), set()
                for a, z, _, _ in matcher.hits(folded):
                    word = folded[a:z] + re.match(r"\w*", folded[z : z + 26])[0]  # the whole word that a stem begins
                    end = a + len(word)
                    before, after = re.search(
                        r"([^\W\d_]+) $", folded[max(0, a - 26) : a],
                    ), re.match(r" ([^\W\d_]+)", folded[end : end + 26])
                    seen |= {f"{before[1]} {word}"} if before else set()
                    seen |= {f"{word} {after[1]}"} if after else set()
                by[label].update(seen)
        yield _tally(by)

    spared = (
        rows.mapInArrow(phrases, "term string, pos long, neg long")
        .groupBy("term")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    spared = (
        spared.where((F.col("neg") >= min_docs) & (F.col("neg") * n1 >= 2 * F.col("pos") * n0))
        .orderBy(F.desc("neg"), "term")
        .limit(max_terms)
    )
    lexicon.exceptions = [r["term"] for r in spared.collect()]

    def features(batches):
        matcher = lexicon.matcher()
        for b in batches:
            got = [matcher.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.float64()), b.column(1)],
                ["total", "dense", "label"],
            )

    # As many rows as the sample has, three numbers each.
    x = rows.mapInArrow(features, "total double, dense double, label int").toPandas()
    lexicon.coef, lexicon.bias = calibrate(x[["total", "dense"]].to_numpy(), x["label"].to_numpy())
    return lexicon


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[tuple[float, ...], float]:
    """Logistic regression by Newton's method: (coefficients, bias)."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w[:-1]), float(w[-1])


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches):
        matcher = lexicon.matcher()
        for b in batches:
            got = [matcher.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """docs, with all their columns, without those that score `limit` or more."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        matcher = lexicon.matcher()
        for b in batches:
            yield b.filter(pa.array([matcher.score(t or "") < limit for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000) -> Lexicon:
    return learn(training_rows(docs, labels, crc_mod("doc_id", 5) != 0, max_rows))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = fit(docs, table(spark, sf_dir, "labels"))
    rows = score(docs, lexicon)
    return rows.select(
        "doc_id", held_out("doc_id", 5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
