"""Pages of an ordered result by order statistics.

A page near the top is a top-k of few rows.  For a deep one the rows are dealt into ranges of the order and written; counts per
range tell which ranges hold the page, and only those are looked at again, dealt anew while they are still large.  So no task
sorts or keeps all rows before the page, however deep it is; the order must be total, or rows that tie may change places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhold.session import stage

#: Rows that one task may put in order.
SHALLOW = 20_000
_RANGE = "page_range"


@dataclass(frozen=True)
class Page:
    """Rows of a page in order, and how many rows there are in all (known only if the page was deep)."""

    rows: DataFrame
    total: int | None


def page_of(rows: DataFrame, order: list[Column], start: int, size: int, *, shallow: int = SHALLOW, ranges: int | None = None) -> Page:
    """``size`` rows from the ``start``-th on (counted from 0) of ``rows`` in ``order``."""
    ranges = ranges or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total, left = None, None
    while start + size > shallow:
        dealt = stage(rows.repartitionByRange(ranges, *order).withColumn(_RANGE, F.spark_partition_id()), "page-ranges")
        # One row per range comes to the driver.
        counts = dict(sorted((r[_RANGE], r["there"]) for r in dealt.groupBy(_RANGE).agg(F.count("*").alias("there")).collect()))
        found = sum(counts.values())
        total = found if total is None else total
        first = last = before = passed = 0
        for part, there in counts.items():
            if passed + there <= start:
                before, first = passed + there, part + 1
            if passed < start + size:
                last = part
            passed += there
        rows, start = dealt.filter(F.col(_RANGE).between(first, last)).drop(_RANGE), start - before
        if found == left:
            break  # ties that no range can part
        left = sum(there for part, there in counts.items() if first <= part <= last)
        if left == found or not left:
            break
    return Page(rows.orderBy(*order).offset(start).limit(size), total)
