"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a fixed shuffled order, served again
from the start when it runs dry, up to `max_repeats` times. What has been served of a
source by a document's end, divided by the source's target, is the document's virtual
finish time. All sources' documents are range-sorted by it over the cluster, their
words are summed along that order, and the schedule is truncated where the sum
reaches the budget. A document that is in service around that time, where every
source has had about its target, is queued in packets of `packet` words, so that the
truncation leaves each source within a packet or two of its target.

Equal rows are queued as one with a number. The targets are found in one sort of the
sources, which are far fewer than the documents.

Defined results: null text has size 0; documents of size 0 take 0; null is a source of
its own and comes last; repeated rows queue separately, one behind the other; null ids
are ids like any other; a source of weight 0 gives nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.order import running_sum
from .common import settle

WORD = r"[^\x20\x09-\x0D]+"
_BUCKET_ROWS = 2000
_RANGE_ROWS = 50_000
_BROADCAST_SOURCES = 100_000
_CHUNK = 10_000


def targets(sizes: DataFrame, weights=(5, 2, 1), budget_share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """(source, k, source_size, target, budget) of sizes (source, n).

    The budget is shared by weight; no share is over max_repeats times its size, and the excess goes to the rest
    by weight. In rising order of cap by weight, the sources that reach their cap come first.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    q = sizes.select(
        "source", F.col("n").cast("long").alias("n"), (F.row_number().over(by_name) - 1).cast("long").alias("k"),
    )
    if isinstance(weights, dict):
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map()
        weight = F.coalesce(F.try_element_at(given, F.coalesce("source", F.lit(""))), F.lit(1)) if weights else F.lit(1)
    else:
        weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))
    w = q.withColumn("w", weight).withColumn("cap", F.col("n") * max_repeats)
    every = Window.partitionBy()
    # A source without weight takes nothing and comes last.
    rising = Window.orderBy(
        F.try_divide(F.col("cap").cast("double"), "w").asc_nulls_last(), F.col("source").isNull(), "source",
    ).rowsBetween(Window.unboundedPreceding, 0)
    o = w.select(
        "*", (F.sum("cap").over(rising) - F.col("cap")).alias("caps_before"),
        (F.sum("w").over(every) - F.sum("w").over(rising) + F.col("w")).alias("open_w"),
        F.least(F.lit(budget_share) * F.sum("n").over(every), F.sum("cap").over(every).cast("double")).alias("budget"),
    )
    reached = F.col("cap") * F.col("open_w") <= F.col("w") * (F.col("budget") - F.col("caps_before"))
    f = o.withColumn("capped", reached & (F.col("w") > 0))
    left = F.col("budget") - F.coalesce(
        F.sum(F.when(F.col("capped"), F.col("cap"))).over(every).cast("double"), F.lit(0.0),
    )
    rest = F.sum(F.when(~F.col("capped"), F.col("w"))).over(every).cast("double")
    share = F.coalesce(F.try_divide(left * F.col("w"), rest), F.lit(0.0))
    return f.select(
        "source", "k", F.col("n").alias("source_size"),
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"), "budget",
    )


def group_key(id_col: Column, source: Column, text: Column) -> Column:
    """Equal for rows that are equal in id, source and text."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.md5(F.concat_ws("\x01", part(id_col), part(source), F.coalesce(text, F.lit(""))).cast("binary"))


def _queue(docs: DataFrame, seed: int, cols: tuple[str, str, str]) -> DataFrame:
    """(key, doc_id, source, size, turn, c): equal rows once, with their number."""
    id_col, text_col, source_col = map(F.col, cols)
    text = F.coalesce(text_col, F.lit(""))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    turn = F.md5(F.concat_ws(":", id_col.cast("string"), F.lit(str(seed)), F.md5(text.cast("binary"))).cast("binary"))
    rows = docs.select(
        group_key(id_col, source_col, text).alias("key"), id_col.alias("doc_id"),
        source_col.cast("string").alias("source"), size.alias("size"), turn.alias("turn"),
    )
    return rows.groupBy("key", "doc_id", "source", "size", "turn").agg(F.count(F.lit(1)).alias("c"))


def mix(
    docs: DataFrame, weights=(5, 2, 1), budget_share: float = 1.5, max_repeats: int = 2, seed: int = 7,
    packet: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(schedule, sized).

    sized: one row for equal documents: key, doc_id, source, size, c (their number), source_size, target.
    schedule: what the mix takes: key, member (0 to c - 1), doc_id, source, copy, start, finish, before, taken.
    weights: a dict by source, or a sequence dealt to the sources by code point, null last.
    """
    queue = settle(_queue(docs, seed, (id_col, text_col, source_col)), "sizes")
    sums = queue.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("n"), F.count(F.lit(1)).alias("rows"))
    plan = settle(
        targets(sums.select("source", "n"), weights, budget_share, max_repeats).join(
            sums.select(
                F.col("source").alias("s"), F.greatest(F.lit(1), F.ceil(F.col("rows") / _BUCKET_ROWS)).alias("buckets"),
            ),
            F.col("source").eqNullSafe(F.col("s")),
        ).drop("s"),
        "targets",
    )
    n_sources, whole = plan.agg(F.count(F.lit(1)), F.max("budget")).first()
    plan = plan.drop("budget").withColumnRenamed("source", "s")
    sized = queue.join(
        F.broadcast(plan) if n_sources <= _BROADCAST_SOURCES else plan, F.col("source").eqNullSafe(F.col("s")),
    ).drop("s")
    # Buckets are stretches of the turn, so the order is that of the turn alone.
    sized = sized.withColumn(
        "bucket", F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * F.col("buckets") / (1 << 32)),
    )
    # Cumulative words in two levels, so that no task holds a whole source.
    words = F.col("size") * F.col("c")
    bucket = sized.groupBy("k", "bucket").agg(F.sum(words).alias("n"))
    earlier = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket = bucket.select("k", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = (
        Window.partitionBy("k", "bucket")
        .orderBy("turn", "doc_id", "key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    queued = sized.withColumn("ahead", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(bucket, ["k", "bucket"])
    queued = queued.where("size > 0 and target > 0").withColumn("ahead", F.col("base") + F.col("ahead"))
    # Equal rows one behind the other; many of them are dealt out first.
    few, many = queued.where(F.col("c") <= _CHUNK).withColumn(
        "first", F.lit(0).cast("long"),
    ), queued.where(F.col("c") > _CHUNK)
    dealt = many.withColumn(
        "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(_CHUNK).cast("long"))),
    ).repartition("key", "first")
    members = few.union(dealt.select(*few.columns)).withColumn(
        "member", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + _CHUNK, F.col("c")) - 1)),
    )
    copies = members.withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_repeats - 1).cast("long"))),
    )
    copies = copies.withColumn(
        "at", F.col("ahead") + F.col("member") * F.col("size") + F.col("copy") * F.col("source_size"),
    )
    # By virtual time 1 every source has had its target, but for the packets in service then: the truncation falls between 1 and this.
    late = 1 + 2 * (n_sources or 0) * packet / max(whole or 0.0, 1.0)
    copies = copies.where(F.col("at") / F.col("target") < late)
    step = F.when(
        (F.col("at") + F.col("size")) / F.col("target") <= 1, F.col("size"),
    ).otherwise(F.lit(packet).cast("long"))
    units = copies.withColumn("step", step).withColumn(
        "off", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.col("step"))),
    )
    units = units.withColumn(
        "n", F.least(F.col("step"), F.col("size") - F.col("off")),
    ).withColumn("end", F.col("at") + F.col("off") + F.col("n"))
    units = units.select(
        "key", "member", "doc_id", "source", "k", "copy", F.col("at").alias("from"),
        ((F.col("at") + F.col("off")) / F.col("target")).alias("start"),
        (F.col("end") / F.col("target")).alias("finish"), "end", "n",
    )
    n_ranges = max(1, queue.count() * max_repeats // _RANGE_ROWS)
    served = running_sum(units, ["finish", "k", "end"], "n", ranges=n_ranges)
    taken = F.least("n", F.lit(math.floor(whole or 0)).cast("long") - F.col("before"))
    schedule = (
        served.withColumn("taken", taken)
        .where("taken > 0")
        .select("key", "member", "doc_id", "source", "copy", "start", "finish", "before", "taken")
    )
    return schedule, sized.select("key", "doc_id", "source", "size", "c", "source_size", "target")


def query(spark, sf_dir: str) -> DataFrame:
    schedule, sized = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = schedule.groupBy("key", "member").agg(F.sum("taken").alias("taken"))
    rows = sized.withColumn("member", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    return rows.join(taken, ["key", "member"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws(':', CAST(doc_id AS VARCHAR), '7', md5(coalesce(text, '')))) AS turn
  FROM documents),
q AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM s GROUP BY source),
w AS (SELECT source, k, n, 2 * n AS cap, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM q),
o AS (
  SELECT *, sum(cap) OVER r - cap AS caps_before, sum(w) OVER () - sum(w) OVER r + w AS open_w, least(1.5 * sum(n) OVER (), sum(cap) OVER ()) AS budget
  FROM w WINDOW r AS (ORDER BY CAST(cap AS DOUBLE) / w, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
f AS (SELECT source, k, n, w, cap, budget, cap * open_w <= w * (budget - caps_before) AS capped FROM o),
t AS (
  SELECT source, k, n, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
    (CAST(budget AS DOUBLE) - coalesce(CAST(sum(CASE WHEN capped THEN cap END) OVER () AS DOUBLE), 0)) * w / CAST(sum(CASE WHEN NOT capped THEN w END) OVER () AS DOUBLE) END AS target
  FROM f),
total AS (SELECT count(*) AS sources, CAST(max(budget) AS DOUBLE) AS words FROM o),
c AS (
  SELECT row_number() OVER () AS row, s.doc_id, s.size, t.k, t.n, t.target,
         CAST(sum(s.size) OVER (PARTITION BY t.k ORDER BY s.turn, s.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS ahead
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT row, size, k, target, ahead + copy * n AS begins, CASE WHEN (ahead + copy * n + size) / target <= 1 THEN size ELSE 16 END AS step
  FROM c, (SELECT unnest([0, 1]) AS copy), total WHERE size > 0 AND (ahead + copy * n) / target < 1 + 2 * sources * 16 / words),
units AS (
  SELECT row, k, begins + off + least(step, size - off) AS stop, (begins + off + least(step, size - off)) / target AS finish, least(step, size - off) AS u
  FROM (SELECT *, unnest(range(0, size, step)) AS off FROM copies)),
served AS (
  SELECT row, u, sum(u) OVER (ORDER BY finish, k, stop ROWS UNBOUNDED PRECEDING) - u AS before FROM units),
taken AS (
  SELECT row, sum(greatest(0, least(u, CAST(floor(words) AS BIGINT) - before))) AS taken FROM served, total GROUP BY row)
SELECT doc_id, size, n AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM c LEFT JOIN taken USING (row)
"""
