import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyhold.operators import quality
from tallyhold.schemas import TABLES, conform
from tallyhold.session import stage
from tests import golden as G


@pytest.fixture(scope="module")
def clean(spark):
    t = G.snapshot(G.tables(spark))
    return {name: stage(conform(df, TABLES[name]), name) for name, df in t.items()}


def fired(t, *groups):
    found = {}
    for group in groups:
        for row in quality.failures(group(t)).collect():
            found[row.rule] = row.violations
    return found


@pytest.fixture(scope="module")
def actual(clean):
    return quality.recompute(clean)


FACTS = ("positions", "manager_periods", "manager_period_stats")


def test_clean_snapshot_passes_every_rule(clean):
    rules = quality.snapshot_rules(clean, 3)
    rows = {r.rule: r.violations for r in rules.collect()}
    assert not {rule: n for rule, n in rows.items() if n}
    assert len(rows) == 43
    quality.require(rules, "Snapshot validation")
    assert fired(clean, lambda t: quality.period_count_rule(t, 4)) == {"period count": 1}


def edit(df, key, column, value):
    return df.withColumn(column, F.when(F.expr(key), value).otherwise(F.col(column)).cast(dict(df.dtypes)[column]))


LATEST = "period = date'2025-12-31'"
MUTATIONS = [
    ("latest-period security weight mismatches", "security_weight_stats", quality.latest_period_rules,
     lambda df: edit(df, f"{LATEST} and cusip = '67066G104'", "avg_weight", F.col("avg_weight") + 1e-6)),
    ("latest-period new-holder mismatches", "security_weight_stats", quality.latest_period_rules,
     lambda df: edit(df, f"{LATEST} and cusip = '037833100'", "new_holder_count", F.lit(2))),
    ("dashboard weight-universe counts", "dashboard_period_stats", quality.logic_rules,
     lambda df: edit(df, "period = date'2025-06-30'", "weight_manager_count", F.lit(2))),
    ("dashboard comparable-manager counts", "dashboard_period_stats", quality.logic_rules,
     lambda df: edit(df, LATEST, "comparable_manager_count", F.lit(3))),
    ("dashboard previous-period links", "dashboard_period_stats", quality.logic_rules,
     lambda df: edit(df, LATEST, "previous_period", F.lit(G.D[0]))),
    ("security weight stats row count", "security_weight_stats", quality.total_rules,
     lambda df: df.filter("not (period = date'2025-06-30' and cusip = '594918104')")),
    ("dashboard period stats row count", "dashboard_period_stats", quality.total_rules,
     lambda df: df.filter("period <> date'2025-06-30'")),
    ("orphan security weight stats", "security_weight_stats", quality.orphan_rules,
     lambda df: edit(df, f"{LATEST} and cusip = '67066G104'", "cusip", F.lit("unknown"))),
    ("empty sector tickers", "sectors", quality.domain_rules, lambda df: edit(df, "ticker = 'AAPL'", "ticker", F.lit(""))),
    ("manager stats value total", "manager_period_stats", quality.total_rules,
     lambda df: edit(df, f"{LATEST} and cik = '0000000001'", "total_value", F.col("total_value") + 1)),
    ("manager-period stats mismatches", "manager_period_stats", quality.recompute_rules,
     lambda df: edit(df, f"{LATEST} and cik = '0000000001'", "security_count", F.lit(9))),
    ("security-period stats mismatches", "security_period_stats", quality.recompute_rules,
     lambda df: edit(df, f"{LATEST} and cusip = '037833100'", "manager_count", F.lit(9))),
    ("period stats mismatches", "period_stats", quality.recompute_rules,
     lambda df: edit(df, LATEST, "complete_manager_count", F.lit(9))),
    ("period-change portfolio totals mismatches", "period_change_totals", quality.recompute_rules,
     lambda df: edit(df, "current_period = date'2025-12-31'", "current_value", F.lit(1))),
    ("period-change total row count", "period_change_totals", quality.total_rules,
     lambda df: df.filter("current_period <> date'2025-12-31'")),
    ("orphan positions", "positions", quality.orphan_rules, lambda df: edit(df, "cusip = '88160R101'", "cusip", F.lit("x"))),
    ("negative position values", "positions", quality.total_rules, lambda df: edit(df, "value = 100", "value", F.lit(-1))),
    ("invalid positions", "positions", quality.total_rules, lambda df: edit(df, "value = 100", "shares_type", F.lit(7))),
    ("invalid coverage statuses", "manager_periods", quality.domain_rules,
     lambda df: edit(df, f"{LATEST} and cik = '0000000001'", "coverage_status", F.lit("DONE"))),
    ("invalid effective filing part types", "effective_filing_parts", quality.domain_rules,
     lambda df: edit(df, f"{LATEST} and cik = '0000000001'", "part_type", F.lit("ODD"))),
    ("missing latest effective filing parts", "effective_filing_parts", quality.orphan_rules,
     lambda df: df.filter(f"not ({LATEST} and cik = '0000000001')")),
    ("orphan filing-part stats", "filing_part_stats", quality.orphan_rules,
     lambda df: edit(df, f"{LATEST} and cik = '0000000001'", "accession", F.lit("zzz"))),
    ("invalid summary reconciliation flags", "filing_part_stats", quality.domain_rules,
     lambda df: edit(df, f"{LATEST} and cik = '0000000001'", "value_matches", F.lit(False))),
    ("summary discrepancies marked complete", "filing_part_stats", quality.logic_rules,
     lambda df: edit(df, f"{LATEST} and cik = '0000000001'", "has_discrepancy", F.lit(True))),
    ("invalid dashboard statistics", "security_weight_stats", quality.domain_rules,
     lambda df: edit(df, f"{LATEST} and cusip = '67066G104'", "avg_weight", F.lit(float("nan")))),
    ("negative materialized statistics", "period_stats", quality.domain_rules,
     lambda df: edit(df, LATEST, "total_value", F.lit(-1))),
    ("orphan changes", "stock_changes", quality.change_rules,
     lambda df: edit(df, "cusip = '88160R101'", "previous_period", F.lit(G.D[2]))),
    ("orphan change totals", "period_change_totals", quality.change_rules,
     lambda df: edit(df, "current_period = date'2025-12-31'", "previous_period", F.lit(dt.date(2020, 3, 31)))),
    ("invalid market caps", "market_caps", quality.domain_rules, lambda df: edit(df, "true", "market_cap", F.lit(0))),
    ("invalid manager flags", "managers", quality.domain_rules, lambda df: edit(df, "true", "starred", F.lit(None))),
]


@pytest.mark.parametrize("rule,table,group,change", MUTATIONS, ids=[f"{m[0]}-{m[1]}" for m in MUTATIONS])
def test_each_tampering_fires_its_rule(clean, actual, rule, table, group, change):
    tampered = {**clean, table: change(clean[table])}
    found = quality.recompute(tampered) if table in FACTS else actual
    assert fired(tampered, lambda t: group(t, found).filter(F.col("rule") == rule))


def test_metadata_and_scores(spark, clean):
    values = {"period_count": "3", "manager_count": "4", "security_count": "4", "position_count": "17",
              "latest_period": "31-DEC-2025", "schema_version": "9"}
    good = {**clean, "metadata": spark.createDataFrame(list(values.items()), TABLES["metadata"])}
    assert fired(good, quality.metadata_rules) == {}
    bad = {**clean, "metadata": spark.createDataFrame(list({**values, "position_count": "16", "schema_version": "8"}.items()), TABLES["metadata"])}
    assert set(fired(bad, quality.metadata_rules)) == {"metadata position_count", "schema version"}
    scores = spark.createDataFrame([("1", G.D[0]), ("1", G.D[0]), ("2", G.D[0])], "cik string, period date")
    assert quality.score_rules(scores).first() == ("duplicate manager-period scores", 1)
    with pytest.raises(ValueError, match="duplicate manager-period scores: 1"):
        quality.require(quality.score_rules(scores), "Signal validation")


def test_indicators(clean):
    t = {**clean, "manager_periods": clean["manager_periods"].withColumn("downgraded", F.col("coverage_status") == "PARTIAL")}
    got = {r.key: r.value for r in quality.quality_indicators(t).collect()}
    assert len(got) == 14
    assert got["data_quality_effective_filing_part_count"] == 9
    assert got["data_quality_partial_manager_period_count"] == got["data_quality_coverage_downgrade_count"] == 1
    assert got["data_quality_summary_unavailable_field_count"] == 0
