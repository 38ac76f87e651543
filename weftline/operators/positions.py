"""Global positions without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a range of order values is meant to hold.
RANGE_ROWS = 4096


def hash_order(text: Column) -> Column:
    """A 60-bit whole number by SHA-256: the order of a seeded shuffle that other engines can repeat."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def positions(df: DataFrame, groups: list[str], order: str, width: int | None = None, tie: str | None = None) -> DataFrame:
    """Adds `pos` (from 0, by the integer column `order` within each group) and `group_rows`.

    Two levels: totals of ranges of order values are summed up per group, and rows are ranked only
    within their range, so a group of any size is numbered in parallel. The width of a range,
    where none is given, follows from the extremes and the number of rows, so sparse orders (hashes) get wide ranges.
    Null group values form a group; rows with a null order come first; equal orders go by `tie`.
    """
    o = F.col(order).cast("long")
    if width is None:
        lo, hi, n = df.agg(F.min(o), F.max(o), F.count(F.lit(1))).first()
        span = (hi or 0) - (lo or 0) + 1
        width = max(1, min(span, span * RANGE_ROWS // max(1, n), 1 << 62))
    d = df.withColumn("_range", F.floor(o / width))
    tot = d.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*groups) if groups else W.partitionBy()
    before = F.coalesce(F.sum("_c").over(w.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tot = tot.withColumns({"_before": before, "group_rows": F.sum("_c").over(w)})
    tot = tot.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_range").alias("_r"), "_before", "group_rows")
    on = F.col("_range").eqNullSafe(F.col("_r"))
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    rank = F.row_number().over(W.partitionBy(*groups, "_range").orderBy(order, *([tie] if tie else [])))
    j = d.withColumn("_rank", rank).join(tot, on)
    return j.withColumn("pos", F.col("_before") + F.col("_rank") - 1).drop("_range", "_rank", "_r", "_before", *[f"_g{i}" for i in range(len(groups))])
