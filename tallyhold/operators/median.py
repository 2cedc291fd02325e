"""Exact median per group, whatever the group's size.

The rows of each group are counted first.  Groups of at most FEW rows are put in order by one shuffle of their values, so
what a task holds of a group is bounded.

Spark's exact percentile keeps every distinct value of a group in one task.  The values of larger groups are narrowed twice
instead.  First, mergeable approximate percentiles bracket the middle: with ACCURACY counts per summary the two
bounds hold both middle elements and a few values in ACCURACY.  Then BUCKETS approximate percentiles of the distinct
values left cut them into buckets, whose counts tell which ones hold the middle.  The few values of these are put in
order.  Every step is a mergeable aggregate or a splittable join, the number of steps is fixed, and only the order of
values matters, so ties, zeros, and infinities need no rule of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhold.session import stage

#: Rows of a group that are put in order as they are.
FEW = 10_000
ACCURACY = 10_000
#: Distance of the bounds from the middle, as a share of the rows: four times the error that the accuracy allows.
MARGIN = 4 / ACCURACY
BUCKETS = 256


def middle_values(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, rows, low, high``: the median is their mean.  ``values`` should be a written table: it is read more than once."""
    kind = values.schema[value].dataType
    present = values.select(*keys, (F.col(value) + F.lit(0)).cast(kind).alias("m_x"))  # -0.0 counts as 0.0
    for name in [*keys, "m_x"]:
        present = present.filter(F.col(name).isNotNull())
    large = stage(present.groupBy(*keys).agg(F.count("*").alias("m_n")).filter(F.col("m_n") > FEW).select(*keys), "median-large")
    if large.isEmpty():
        return _middle_of_few(present, keys)
    return _middle_of_few(present.join(large, keys, "left_anti"), keys).unionByName(_middle_of_many(present.join(large, keys, "left_semi"), keys))


def _middle_of_few(present: DataFrame, keys: list[str]) -> DataFrame:
    group = Window.partitionBy(*keys)
    placed = present.withColumn("m_at", F.row_number().over(group.orderBy("m_x"))).withColumn("rows", F.count("*").over(group))
    first, last = F.floor((F.col("rows") - 1) / 2), F.floor(F.col("rows") / 2)
    return placed.filter((F.col("m_at") - 1).between(first, last)).groupBy(*keys).agg(
        F.max("rows").alias("rows"), F.min("m_x").alias("low"), F.max("m_x").alias("high"))


def _middle_of_many(present: DataFrame, keys: list[str]) -> DataFrame:
    bounds = stage(present.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.percentile_approx("m_x", [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY).alias("m_b")), "median-bounds")
    counted = present.groupBy(*keys, "m_x").agg(F.count("*").alias("m_n"))
    near = stage(counted, "median-counts").join(bounds, keys).withColumn("m_side", F.when(F.col("m_x") < F.col("m_b")[0], 0).when(F.col("m_x") <= F.col("m_b")[1], 1))
    skipped = stage(near.groupBy(*keys).agg(F.sum(F.when(F.col("m_side") == 0, F.col("m_n")).otherwise(0)).alias("m_skipped")), "median-skipped")
    candidates = stage(near.filter("m_side = 1").select(*keys, "m_x", "m_n", "rows"), "median-candidates")

    cuts = stage(candidates.groupBy(*keys).agg(
        F.percentile_approx("m_x", [i / BUCKETS for i in range(1, BUCKETS)], ACCURACY).alias("m_cuts")), "median-cuts")
    bucketed = stage(candidates.join(cuts, keys).select(
        *keys, "m_x", "m_n", "rows", F.size(F.filter("m_cuts", lambda cut: cut < F.col("m_x"))).alias("m_bucket")), "median-buckets")
    sizes = bucketed.groupBy(*keys, "rows", "m_bucket").agg(F.sum("m_n").alias("m_of_bucket")).join(skipped, keys)
    upto = F.col("m_skipped") + F.sum("m_of_bucket").over(Window.partitionBy(*keys).orderBy("m_bucket").rowsBetween(Window.unboundedPreceding, 0))
    first, last = F.floor((F.col("rows") - 1) / 2), F.floor(F.col("rows") / 2)
    ranked = sizes.withColumn("m_upto", upto).withColumn("m_under", F.col("m_upto") - F.col("m_of_bucket"))
    chosen = stage(ranked.filter((F.col("m_under") <= last) & (F.col("m_upto") > first)).select(*keys, "m_bucket", "m_under"), "median-chosen")

    inside = Window.partitionBy(*keys, "m_bucket").orderBy("m_x").rowsBetween(Window.unboundedPreceding, 0)
    placed = bucketed.join(chosen, [*keys, "m_bucket"]).withColumn("m_upto", F.col("m_under") + F.sum("m_n").over(inside))
    return placed.groupBy(*keys).agg(
        F.max("rows").alias("rows"), F.min(F.when(F.col("m_upto") > first, F.col("m_x"))).alias("low"),
        F.min(F.when(F.col("m_upto") > last, F.col("m_x"))).alias("high"))


def median(low, high):
    return (low + high) / 2.0
