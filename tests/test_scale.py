"""Plans and results when one key holds a third of all rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyhold.operators import filings, positions, rollups, signals
from tallyhold.session import SETTINGS, configure, stage, staging_root
from tests import golden as G

LOW_THRESHOLDS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def crowded(spark):
    """The session with thresholds low enough that small data shows skew handling."""
    configure(spark)
    before = {key: spark.conf.get(key, None) for key in LOW_THRESHOLDS}
    for key, value in LOW_THRESHOLDS.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_settings_are_applied(spark):
    configure(spark)
    assert all(spark.conf.get(key) == value for key, value in SETTINGS.items())
    assert staging_root(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_shuffles_grow_with_the_input(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    configure(spark, 10_000)
    assert spark.conf.get(key, None) is None
    configure(spark, 100 * 10**12)
    assert int(spark.conf.get(key)) == 372_530
    configure(spark, 10_000)
    assert int(spark.conf.get(key)) == 372_530
    spark.conf.unset(key)


def hot_lines(spark, n=60_000):
    """Two thirds of all rows spread over many filings, one third in a single filing."""
    key = F.col("id")
    return stage(spark.range(n).select(
        F.when(key % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), (key % 997).cast("string"))).alias("accession"),
        (key % 5000).cast("string").alias("cusip"), F.lit(0).alias("position_type"), F.lit(0).alias("shares_type"),
        (key % 13).alias("value"), F.when(key % 7 != 0, (key % 11).cast("double")).alias("shares")).repartition(16), "hot_lines")


def hot_parts(spark):
    key = F.col("id")
    rows = spark.range(997).select(F.concat(F.lit("a"), key.cast("string")).alias("accession"),
                                   (key % 50).cast("string").alias("cik"), F.lit(dt.date(2025, 6, 30)).alias("period"))
    return stage(rows.unionByName(spark.createDataFrame([("hot", "hot", dt.date(2025, 6, 30))], rows.schema)), "hot_parts")


def test_a_hot_filing_is_split(crowded):
    lines, parts = hot_lines(crowded), hot_parts(crowded)
    merged = positions.merge_positions(positions.effective_lines(lines, parts))
    plan = final_plan(merged)
    assert "SortMergeJoin(skew=true)" in plan
    assert plan.index("HashAggregate") < plan.index("SortMergeJoin(skew=true)")
    totals = merged.agg(F.sum("value"), F.count("*")).first()
    expected = lines.join(parts, "accession").groupBy("cik", "cusip").agg(F.sum("value").alias("v"))
    assert totals == expected.agg(F.sum("v"), F.count("*")).first()


def test_a_hot_manager_quarter_needs_no_window(crowded):
    """A third of all filings in one manager-quarter: aggregates only, and the join back is split."""
    key = F.col("id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("BASE", "NEW HOLDINGS", "RESTATEMENT", "NEW HOLDINGS")]), (key % 4 + 1).cast("int"))
    filed = F.date_add(F.lit(dt.date(2025, 7, 1)), (key % 40).cast("int"))
    events = crowded.range(30_000).select(
        F.when(key % 3 == 0, "hot").otherwise((key % 2000).cast("string")).alias("cik"), F.lit(dt.date(2025, 6, 30)).alias("period"),
        F.lpad(key.cast("string"), 8, "0").alias("accession"), filed.alias("filing_date"), F.lit("").alias("filing_label"),
        kind.alias("part_type"), F.lit("13F HOLDINGS REPORT").alias("report_type"), F.lit("").alias("manager_name"),
        F.lit("").alias("state_country"), F.lit("q").alias("source_archive"), F.lit(False).alias("confidential"),
        F.lit(True).alias("is_holdings"), F.lit(1).cast("long").alias("reported_entry_count"), F.lit(1).cast("long").alias("reported_value"))
    events = stage(events.withColumn("order_key", F.struct("filing_date", F.lit(0).cast("long").alias("amendment"), F.when(
        F.col("part_type") == "NEW HOLDINGS", 1).otherwise(0).alias("rank"), "accession")).repartition(12), "hot_events")
    groups = filings.group_states(events)
    assert "partial_max" in final_plan(groups) and "Window" not in final_plan(groups)
    parts = filings.effective_parts(events, stage(groups, "groups"))
    plan = final_plan(parts)
    assert "Window" not in plan
    assert "SortMergeJoin(skew=true)" in plan
    order = sorted(events.filter("cik = 'hot'").select("order_key", "part_type", "accession").collect())
    resets = [at for at, row in enumerate(order) if row.part_type != "NEW HOLDINGS"]
    want = {row.accession for row in order[resets[-1]:]}
    assert {r.accession for r in parts.filter("cik = 'hot'").collect()} == want


def test_the_book_splits_a_hot_manager_and_a_hot_security(crowded):
    """Context reaches the facts, and prices reach the positions, through joins that can be split."""
    lines, parts = hot_lines(crowded), hot_parts(crowded).withColumn("cik", F.lit("one"))
    context = stage(crowded.createDataFrame([("one", dt.date(2025, 6, 30), "COMPLETE")] + [
        (str(i), dt.date(2025, 6, 30), "COMPLETE") for i in range(500)], "cik string, period date, coverage_status string"), "context")
    wide_parts = stage(parts.join(context, ["cik", "period"]), "wide_parts")
    merged = positions.merge_positions(positions.effective_lines(lines, wide_parts), ["coverage_status"])
    assert "SortMergeJoin(skew=true)" in final_plan(merged)
    held = stage(crowded.range(40_000).select(
        (F.col("id") % 20_000).cast("string").alias("cik"), F.lit(dt.date(2025, 6, 30)).alias("period"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 900).cast("string")).alias("cusip"),
        F.lit(0).alias("position_type"), F.lit(0).alias("shares_type"), F.lit(10).cast("long").alias("value"),
        F.lit(1.0).alias("shares")).repartition(12), "held")
    trusted = stage(held.select("cusip").distinct().withColumn("ticker", F.concat(F.lit("T"), "cusip")), "trusted")
    factors = stage(held.select("period", "cusip").distinct().withColumn("close", F.lit(10.0)).withColumn("factor", F.lit(1.0)), "factors")
    priced = signals.priced_positions(held, factors, trusted)
    assert "SortMergeJoin(skew=true)" in final_plan(priced)
    assert priced.filter("cusip = 'hot' and ticker = 'Thot' and factor = 1").count() == held.filter("cusip = 'hot'").count()


def test_popular_securities_aggregate_before_the_shuffle(crowded):
    t = G.tables(crowded)
    plan = rollups.security_weight_stats(t["wide"], t["dashboard_period_stats"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "CartesianProduct" not in plan


def test_no_operator_plans_a_cross_product(spark):
    t = G.tables(spark)
    trusted = spark.createDataFrame([(c, k) for k, c in G.CUSIP.items()], "cusip string, ticker string")
    bars = spark.createDataFrame([("AAPL", G.D[0], 10.0), ("AAPL", G.D[2], 20.0)], "symbol string, price_date date, close double")
    closes = signals.quarter_end_closes(t["wide"], trusted, bars)
    for df in (t["stock_changes"], t["security_weight_stats"], t["period_change_totals"], t["period_stats"], closes):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_positions_scan_prunes_periods_and_columns(spark, tmp_path):
    t = G.tables(spark)
    t["positions"].write.partitionBy("period").parquet(str(tmp_path / "positions"))
    from tallyhold.schemas import TABLES
    stored = spark.read.schema(TABLES["positions"]).parquet(str(tmp_path / "positions"))
    plan = stored.filter(F.col("period") == F.lit(G.D[2])).groupBy("cusip").agg(
        F.sum("value"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan
    assert "ReadSchema: struct<cusip:string,value:bigint>" in plan


def test_staged_tables_do_not_keep_lineage(spark):
    df = stage(spark.range(10).repartition(3), "small")
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 10


def test_tasks_stay_small_as_inputs_grow(spark):
    """A gigabyte of input starts with partitions enough, and merged or unsplit ones are bounded, unless the session asks for less."""
    first, merged, skewed = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
                             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")
    before = {key: spark.conf.get(key, None) for key in (first, merged, skewed)}
    spark.conf.set(merged, "64MB")
    spark.conf.set(skewed, "32m")
    configure(spark, 6 * 10**9)
    assert int(spark.conf.get(first)) >= 700
    assert spark.conf.get(merged) == str(16 * 1024 * 1024) and spark.conf.get(skewed) == "32m"
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
