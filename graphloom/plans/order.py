"""Running sums over a range sort of the cluster, so that no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import settle


def running_sum(
    rows: DataFrame, order: list[str], value: str, group: list[str] | None = None, ranges: int | None = None,
    out: str = "before",
) -> DataFrame:
    """rows with `out`: the sum of value over all rows of the group (if any) that come earlier in order.

    Rows are sorted into ranges by group and order; sums of whole ranges, one row for each
    group and range, give every range its start.
    """
    group = group or []
    key = [*group, *order]
    ranged = rows.repartitionByRange(ranges, *key) if ranges else rows.repartitionByRange(*key)
    ranged = settle(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part", *group).agg(F.sum(value).alias("_s"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *group, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_base"))
    cut = ranged.withColumn("_ahead", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = cut["_part"] == sums["_part"]
    for c in group:
        same = same & cut[c].eqNullSafe(sums[c])
    joined = cut.join(sums, same, "left").select(*[cut[c] for c in cut.columns], sums["_base"])
    return joined.withColumn(out, F.col("_base") + F.col("_ahead")).drop("_part", "_ahead", "_base")
