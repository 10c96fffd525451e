"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weighted, hashed character n-grams (n = 1 to 3 by default, of
the lower-cased text). The document frequencies are counted over every row that
may be learned from. The weights are trained by follow-the-regularised-leader with
elastic-net penalties on at most `max_rows` different rows of those, the same number
of each language where it has so many, taken by the hashes of id and text; a fifth of
them is kept from training and sets the temperature.

Defined results: a text that is null or has no letter is `und` with score 0, as is
every text if no language can be learned; rows without an id are never learned from
and not held out; repeated rows are predicted alike; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, held_out, settle, small_batches, table

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_SLICES = 16


@dataclass
class Grams:
    bits: int = 15
    longest: int = 3

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(features, occurrences) of the hashed n-grams of a text."""
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        shift = np.uint32(32 - self.bits)
        parts, h = [], np.zeros(len(c), np.uint32)
        for n in range(1, min(self.longest, len(c)) + 1):
            h = (h[: len(c) - n + 1] * _MULTIPLIERS[3]) + c[n - 1 :] * _MULTIPLIERS[0] + np.uint32(n)
            parts.append(((h ^ (h >> np.uint32(15))) * _MULTIPLIERS[1]) >> shift)
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        every = np.concatenate(parts)
        if len(every) < 1 << (self.bits - 3):
            return np.unique(every, return_counts=True)
        whole = np.bincount(every, minlength=1 << self.bits)
        at = np.flatnonzero(whole)
        return at, whole[at]

    def vector(self, text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, TF-IDF) of unit length."""
        at, n = self.counts(text)
        x = (1 + np.log(n)) * idf[at]
        size = np.sqrt((x * x).sum())
        return at, (x / size if size else x).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None  # language by feature, then a bias for each language
    bias: np.ndarray | None = None
    idf: np.ndarray | None = None
    temperature: float = 1.0
    grams: Grams = field(default_factory=Grams)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, scores
        for i, t in enumerate(texts):
            if has_letter(t):
                at, x = self.grams.vector(t, self.idf)
                p = softmax((self.weights[:, at] @ x + self.bias) / self.temperature)
                best = int(p.argmax())
                names[i], scores[i] = self.langs[best], p[best]
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequencies(docs: DataFrame, grams: Grams, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Over all docs; each task adds up its own rows, then slices of the vectors are summed."""
    size = 1 << grams.bits

    def count(batches):
        total, n = np.zeros(size, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                n += 1
                total[grams.counts(t)[0]] += 1
        parts = [x.astype("<i8").tobytes() for x in np.split(total, _SLICES)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(_SLICES), pa.int64()), pa.array([n] * _SLICES, pa.int64()), pa.array(parts, pa.binary())],
            ["slice", "n", "counts"],
        )

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in pdf["counts"])
        return pd.DataFrame({"slice": [key[0]], "n": [pdf["n"].sum()], "counts": [total.astype("<i8").tobytes()]})

    schema = "slice long, n long, counts binary"
    rows = (
        docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .mapInArrow(count, schema)
        .groupBy("slice")
        .applyInPandas(add, schema)
        .orderBy("slice")
        .collect()
    )
    if not rows:
        return 0, np.zeros(size, np.int64)
    return rows[0]["n"], np.concatenate([np.frombuffer(r["counts"], "<i8") for r in rows])


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, size: int, alpha: float = 0.5, beta: float = 1.0,
    l1: float = 1e-3, l2: float = 1e-3, passes: int = 3,
) -> np.ndarray:
    """FTRL-proximal for softmax regression; the last column is the bias. rows: (features, values, language)."""
    z, n, w = (np.zeros((n_langs, size + 1)) for _ in range(3))
    rng = np.random.default_rng(0)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.r_[at, size], np.r_[x, 1.0]
            zi, ni = z[:, at], n[:, at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = softmax(wi @ x)
            p[y] -= 1
            g = p[:, None] * x[None, :]
            grown = ni + g * g
            z[:, at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * wi
            n[:, at] = grown
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Golden-section search on the log of the temperature for the least log loss."""

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    a, b, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def sample(keys: DataFrame, max_rows: int) -> DataFrame:
    """At most max_rows different rows (doc_id, mark, lang) of keys, of each language an equal number at most.

    A language's share is first cut down to about twice its number by hash, so that no
    task ranks all rows of a frequent language.
    """
    rank = F.xxhash64("doc_id", "mark", F.lit(11))
    counts = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    quota = max(1, max_rows // max(1, counts.count()))
    place = (rank.cast("double") + 2.0**63) / 2.0**64
    near = (
        keys.join(F.broadcast(counts), "lang")
        .where(place * F.col("n") < 2 * quota + 20)
        .select(*keys.columns)
        .distinct()
    )
    first = near.withColumn(
        "k", F.row_number().over(Window.partitionBy("lang").orderBy(rank, "doc_id", "mark")),
    ).where(F.col("k") <= quota)
    return first.drop("k").orderBy(rank, "doc_id", "mark", "lang").limit(max_rows)


def fit(
    docs: DataFrame, eligible, max_rows: int = 4000, grams: Grams | None = None, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """eligible: which rows may be learned from."""
    grams = grams or Grams()
    small_batches(docs.sparkSession)
    rows = docs.where(eligible & F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
    )
    n, df = document_frequencies(rows, grams)
    idf = np.log((1 + n) / (1 + df)) + 1

    def vectors(batches):
        for b in batches:
            for k, t, lang in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if has_letter(t):
                    at, x = grams.vector(t, idf)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int64()), pa.array([lang]), pa.array([at.astype(np.int32)]), pa.array([x])],
                        ["doc_id", "lang", "at", "x"],
                    )

    key = ["doc_id", "mark", "lang"]
    marked = rows.where("text is not null").select("doc_id", "lang", F.xxhash64("text").alias("mark"), "text")
    taken = settle(marked.join(F.broadcast(sample(marked.select(*key), max_rows)), key).dropDuplicates(key), "sample")
    # At most max_rows rows.
    got = (
        taken.select("doc_id", "text", "lang")
        .mapInArrow(vectors, "doc_id long, lang string, at array<int>, x array<float>")
        .toPandas()
    )
    got = got.sort_values(["doc_id", "lang"], kind="stable").reset_index(drop=True)
    langs = sorted(set(got["lang"]))
    if not langs:
        return Model()
    cut = [
        (np.asarray(a, np.int64), np.asarray(x, np.float64), langs.index(lang))
        for a, x, lang in zip(got["at"], got["x"], got["lang"], strict=True)
    ]
    kept = [i for i in range(len(cut)) if i % 5 == 4] if len(cut) >= 50 else []
    held = set(kept)
    w = train_ftrl([r for i, r in enumerate(cut) if i not in held], len(langs), 1 << grams.bits)
    weights, bias = w[:, :-1], w[:, -1]
    temperature = best_temperature(
        np.array([weights[:, cut[i][0]] @ cut[i][1] + bias for i in kept]), np.array([cut[i][2] for i in kept]),
    ) if kept else 1.0
    return Model(langs, weights.astype(np.float32), bias.astype(np.float32), idf, temperature, grams)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row. The model's size is fixed by its languages and feature bits."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = sent.value
        for b in batches:
            names, scores = known.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
    ).mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, crc_mod("doc_id", 4) != 2)
    rows = identify(docs, model)
    return rows.select("doc_id", held_out("doc_id", 4, 2), "lang_pred", "score")
