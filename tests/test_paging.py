import pytest
from pyspark.sql import functions as F

from tallyhold.operators import paging


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(20_000).select("id", (F.col("id") * 7919 % 1013).alias("metric"), F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("name")).repartition(5).cache()


@pytest.mark.parametrize("start,size", [(0, 10), (95, 10), (12_345, 50), (19_990, 50), (20_000, 5), (50_000, 5), (7000, 3000), (10_000, 1)])
def test_pages_are_those_of_the_whole_order(spark, rows, start, size):
    order = [F.desc("metric"), F.col("name").asc_nulls_last(), F.asc("id")]
    want = [tuple(r) for r in rows.orderBy(*order).collect()][start:start + size]
    page = paging.page_of(rows, order, start, size, shallow=100, ranges=4)
    assert [tuple(r) for r in page.rows.collect()] == want
    assert page.total == (20_000 if start + size > 100 else None)


def test_only_the_ranges_of_the_page_are_sorted(spark, rows):
    """What the last top-k reads is a small part of the table, and no plan brings all rows before the page together."""
    order = [F.desc("metric"), F.asc("id")]
    page = paging.page_of(rows, order, 15_000, 20, shallow=500, ranges=8)
    plan = page.rows._jdf.queryExecution().optimizedPlan().toString()
    limits = [int(x.split()[0].strip(",)")) for x in plan.replace("GlobalLimit ", "\nGlobalLimit ").split("\nGlobalLimit ")[1:]]
    offsets = [int(x.split()[0].strip(",)")) for x in plan.split("Offset ")[1:]]
    assert max(limits + offsets) <= 500
    assert "page_range" in plan and page.rows.count() == 20


def test_rows_that_all_tie(spark):
    page = paging.page_of(spark.range(1000).select(F.lit(1).alias("k")), [F.asc("k")], 900, 20, shallow=50, ranges=4)
    assert page.rows.count() == 20 and page.total == 1000
    assert paging.page_of(spark.range(0).select(F.col("id").alias("k")), [F.asc("k")], 900, 20, shallow=50, ranges=4).rows.count() == 0
