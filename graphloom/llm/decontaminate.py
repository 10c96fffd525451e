"""Benchmark decontamination over a distributed positional inverted index.

A first pass over the training words counts the occurrences of the test items' terms,
which puts the terms of every test window in order from the rarest. The index is the
posting lists (term, document, position). Windows are looked up list by list: the postings
of a window's rarest term, less the term's offset, are its candidate starts; those are
intersected with the offset-adjusted postings of the second rarest, and what is left with
the postings of all other terms. Lists of terms that no window has first or second are
only stored for documents that still have a candidate then. A proximity search asks for
all terms within a slop of the rarest one instead of at adjusted positions.

Only DataFrame functions are used. Test terms and candidate documents are broadcast up to
a stated number, which is counted first, and joined by shuffle beyond; then a word crosses
the network as its term, document key and position.

Defined results: null and empty texts have no words; items without words have no
windows; rows that share both id and text share their result; null ids are ids like any
other; other columns are ignored; an empty table on either side gives no hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, table

# Runs of ASCII digits, ASCII letters and everything beyond ASCII; named classes match several times faster than ranges.
WORD = r"[\p{Alnum}\P{ASCII}]+"
#: At most so many terms, windows or document keys (16 bytes) are broadcast.
_BROADCAST = 200_000


def _lower(c: Column) -> Column:
    """A-Z only: other letters keep their case."""
    return F.when(F.lower(c) == c, c).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def _words(text_col: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, phrase, n): each run of `size` words of an item, or all words of a shorter one."""
    words = F.transform(_words(text_col), _lower)
    cut = items.select(F.col(id_col).cast("string").alias("item"), words.alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - size))
    cut = cut.select("item", "words", F.explode(starts).alias("at"))
    part = F.slice("words", F.col("at") + 1, size)
    return cut.select("item", F.array_join(part, " ").alias("phrase"), F.size(part).alias("n")).distinct()


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def row_key(id_col: Column, text: Column) -> Column:
    """16 bytes, equal for rows that are equal in id and text."""
    name = F.coalesce(F.concat(F.lit("="), id_col.cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws("\x01", name, F.coalesce(text, F.lit(""))).cast("binary")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text); equal keys are equal in id and text."""
    return docs.select(
        F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def ranked_windows(rows: DataFrame, phrases: DataFrame, limit: int = _BROADCAST) -> DataFrame:
    """(phrase, n, ranked): the phrases that may occur, with ranked (seen, term, offset) from the rarest term."""
    at = phrases.select("phrase", "n", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    terms = settle(at.select("term").distinct(), "terms")
    seen = rows.select(F.explode(_words("text")).alias("word")).select(_lower(F.col("word")).alias("term"))
    counts = (
        seen.join(_small(terms, terms.count() <= limit), "term")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("seen"))
    )
    # A window with a term that no document has can't occur.
    ranked = F.array_sort(F.collect_list(F.struct("seen", "term", "offset"))).alias("ranked")
    return (
        at.join(counts, "term", "left")
        .groupBy("phrase", "n")
        .agg(ranked, F.count("seen").alias("known"))
        .where("known = n")
        .drop("known")
    )


def postings(rows: DataFrame, terms: DataFrame, few: bool) -> DataFrame:
    """The index of these terms over rows (key, text): (term, key, pos)."""
    seen = rows.select(
        "key", F.posexplode(_words("text")).alias("pos", "word"),
    ).select(_lower(F.col("word")).alias("term"), "key", "pos")
    return seen.join(_small(terms, few), "term")


def _index(rows: DataFrame, ranked: DataFrame, depth: int, limit: int) -> DataFrame:
    """Postings of the `depth` rarest terms of each window."""
    terms = settle(
        ranked.select(F.explode(F.slice("ranked", 1, depth)).alias("r")).select("r.term").distinct(), "terms",
    )
    return settle(postings(rows, terms, terms.count() <= limit), "postings")


def _others(rows: DataFrame, ranked: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """Postings of all windows' terms in the documents of found (key)."""
    keys = settle(found.select("key").distinct(), "keys")
    terms = settle(ranked.select(F.explode("ranked").alias("r")).select("r.term").distinct(), "terms")
    # One of the rows that share a key: their postings are the same.
    kept = rows.select("key", "text").join(_small(keys, keys.count() <= limit), "key")
    return postings(kept, terms, terms.count() <= limit).distinct()


def phrase_matches(rows: DataFrame, ranked: DataFrame, limit: int = _BROADCAST) -> DataFrame:
    """(key, phrase, n, start) of exact occurrences, by intersecting offset-adjusted postings from the rarest term on."""
    ranked = settle(ranked, "ranked")
    few = ranked.count() <= limit
    index = _index(rows, ranked, 2, limit)
    anchors = ranked.select(
        "phrase", "n", F.col("ranked")[0]["term"].alias("term"), F.col("ranked")[0]["offset"].alias("offset"),
        F.when(F.col("n") > 1, F.col("ranked")[1]).alias("second"),
    )
    starts = (
        index.join(_small(anchors, few), "term")
        .where("pos >= offset")
        .select("key", "phrase", "n", (F.col("pos") - F.col("offset")).alias("start"), "second")
    )
    single = starts.where("n = 1").select("key", "phrase", "n", "start").distinct()
    asked = starts.where("n > 1").select(
        "key", "phrase", "n", "start", F.col("second.term").alias("term"),
        (F.col("start") + F.col("second.offset")).alias("pos"),
    )
    both = settle(
        asked.join(index, ["key", "term", "pos"], "left_semi").select("key", "phrase", "n", "start").distinct(),
        "candidates",
    )
    left = both.where("n > 2").join(
        _small(ranked.select("phrase", F.slice("ranked", 3, 1 << 30).alias("rest")), few), "phrase",
    )
    left = left.select("key", "phrase", "n", "start", F.explode("rest").alias("r")).select(
        "key", "phrase", "n", "start", F.col("r.term").alias("term"), (F.col("start") + F.col("r.offset")).alias("pos"),
    )
    there = left.join(_others(rows, ranked, both.where("n > 2"), limit), ["key", "term", "pos"], "left_semi")
    full = (
        there.groupBy("key", "phrase", "n", "start")
        .agg(F.count(F.lit(1)).alias("agree"))
        .where("agree = n - 2")
        .drop("agree")
    )
    return single.union(both.where("n = 2")).union(full)


def proximity_matches(rows: DataFrame, ranked: DataFrame, slop: int, limit: int = _BROADCAST) -> DataFrame:
    """(key, phrase, pos) where all terms of a phrase stand within slop words of its rarest term, in any order.

    Positions meet by stretches of slop words, so a term's list in a document is never paired as a whole.
    """
    ranked = settle(ranked, "ranked")
    few = ranked.count() <= limit
    index = _index(rows, ranked, 1, limit)
    anchors = ranked.select(
        "phrase", F.col("ranked")[0]["term"].alias("term"),
        F.array_distinct(F.transform(F.slice("ranked", 2, 1 << 30), lambda r: r["term"])).alias("rest"),
    )
    near = settle(
        index.join(_small(anchors, few), "term").select(
            "key", "phrase", "pos", F.array_except("rest", F.array("term")).alias("rest"),
        ).distinct(),
        "candidates",
    )
    width = max(1, slop)
    asked = near.select("key", "phrase", "pos", F.size("rest").alias("want"), F.explode("rest").alias("term"))
    asked = asked.withColumn(
        "part", F.explode(F.sequence(F.floor((F.col("pos") - slop) / width), F.floor((F.col("pos") + slop) / width))),
    )
    lists = _others(rows, ranked, near, limit).select(
        "key", "term", F.col("pos").alias("at"), F.floor(F.col("pos") / width).alias("part"),
    )
    hits = (
        asked.join(lists, ["key", "term", "part"])
        .where(F.abs(F.col("at") - F.col("pos")) <= slop)
        .select("key", "phrase", "pos", "want", "term")
        .distinct()
    )
    full = hits.groupBy("key", "phrase", "pos", "want").agg(F.count(F.lit(1)).alias("agree")).where("agree = want")
    return near.where("size(rest) = 0").select("key", "phrase", "pos").union(full.select("key", "phrase", "pos"))


def _prepare(docs: DataFrame, items: DataFrame, size: int, limit: int, cols: dict[str, str]):
    rows = keyed(docs, cols.get("id_col", "doc_id"), cols.get("text_col", "text"))
    tests = settle(windows(items, size), "windows")
    return rows, tests, ranked_windows(rows, tests.select("phrase", "n").distinct(), limit)


def matches(
    docs: DataFrame, items: DataFrame, size: int = 10, limit: int = _BROADCAST, **cols: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, tests); hits: (key, phrase, n, start), tests: (item, phrase, n)."""
    rows, tests, ranked = _prepare(docs, items, size, limit, cols)
    return rows, phrase_matches(rows, ranked, limit), tests


def near_matches(
    docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 20, limit: int = _BROADCAST, **cols: str,
) -> DataFrame:
    """(id, item, phrase, pos): windows of items whose terms all stand within slop words of the rarest one."""
    rows, tests, ranked = _prepare(docs, items, size, limit, cols)
    found = proximity_matches(rows, ranked, slop, limit).join(tests.select("item", "phrase"), "phrase")
    return rows.select("id", "key").distinct().join(found, "key").select("id", "item", "phrase", "pos")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, limit: int = _BROADCAST, **cols: str) -> DataFrame:
    """One row per document: id, key, n_words, n_hit, n_items, items (sorted), contaminated."""
    rows, hits, tests = matches(docs, items, size, limit, **cols)
    hits = settle(hits, "hits")
    words = hits.select("key", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    words = words.groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    found = (
        hits.select("key", "phrase")
        .distinct()
        .join(tests.select("item", "phrase"), "phrase")
        .select("key", "item")
        .distinct()
    )
    found = found.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"),
    )
    base = rows.select("id", "key", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    out = base.join(words.join(found, "key"), "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = F.array().cast("array<string>")
    return out.select(
        "id", "key", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items", none).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def contaminated_keys(docs: DataFrame, items: DataFrame, size: int = 10, **cols: str) -> DataFrame:
    """row_key of each document that holds a window."""
    _, hits, _ = matches(docs, items, size, **cols)
    return hits.select("key").distinct()


def query(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    joined = F.array_join("items", ",")
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(joined.cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(w[i + 1 : i + 10], ' ') AS phrase, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS i FROM d, sizes)),
hit AS (SELECT doc_id, g.n, i, item FROM grams g JOIN win USING (phrase)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
