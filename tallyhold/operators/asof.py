"""As-of price lookups.

Bars are unique per (symbol, date), and lookups are reduced to distinct (symbol, date) pairs first, so a
symbol's timeline holds at most two rows per calendar day however many positions ask for it.  One shuffle
by symbol answers both directions; no range join and no cross product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_prices(wanted: DataFrame, bars: DataFrame) -> DataFrame:
    """For each distinct (symbol, date) of ``wanted``: last close on or before it, first close after it.

    Symbols match exactly, including case.  Columns: ``symbol, date, before_date, before_close,
    after_date, after_close``.
    """
    asked = wanted.select("symbol", F.col("date")).distinct().select(
        "symbol", "date", F.lit(None).cast("double").alias("close"), F.lit(1).alias("is_lookup"))
    known = bars.select("symbol", F.col("price_date").alias("date"), "close", F.lit(0).alias("is_lookup"))
    bar = F.when(F.col("is_lookup") == 0, F.struct("date", "close"))
    # Both orders put a lookup where running "last" sees the right side of its own day.
    past = Window.partitionBy("symbol").orderBy("date", "is_lookup").rowsBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy("symbol").orderBy(
        F.col("date").desc(), F.col("is_lookup").desc()).rowsBetween(Window.unboundedPreceding, 0)
    timeline = (known.unionByName(asked)
                .withColumn("before", F.last(bar, ignorenulls=True).over(past))
                .withColumn("after", F.last(bar, ignorenulls=True).over(future)))
    return timeline.filter("is_lookup = 1").select(
        "symbol", "date", F.col("before.date").alias("before_date"), F.col("before.close").alias("before_close"),
        F.col("after.date").alias("after_date"), F.col("after.close").alias("after_close"))


def exact_close(bars: DataFrame, day) -> DataFrame:
    """Close of every symbol on one date."""
    return bars.filter(F.col("price_date") == F.lit(day).cast("date")).select(
        "symbol", F.col("close").alias("mark_close"))
