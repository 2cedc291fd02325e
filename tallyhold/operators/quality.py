"""Data-quality rules and indicators.

Every rule is a row ``(rule, violations)``; ``failures`` keeps the rules that fired.  ``recompute`` reads the
positions once and stages what the rules need; from there on every rule works on tables the size of the
statistics, and the rules of one table share one aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhold import fixed_values as fv
from tallyhold.functions import columns as C
from tallyhold.operators import rollups
from tallyhold.operators.filings import link_periods
from tallyhold.session import stage

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Recomputed:
    """Staged recomputation of the statistics from the positions themselves."""

    holdings: DataFrame  # one row per manager, period, and security
    managers: DataFrame  # per manager and period
    securities: DataFrame  # per period and security
    universe: DataFrame  # complete managers with a positive total
    weights: DataFrame  # per period and security, over the universe


def recompute(t: Tables) -> Recomputed:
    value, plain = F.col("value"), F.col("position_type") == 0
    invalid = ((value < 0) | F.coalesce(F.col("shares") < 0, F.lit(False))
               | ~F.col("position_type").isin(0, 1, 2) | ~F.col("shares_type").isin(0, 1, 2))
    holdings = stage(t["positions"].groupBy("cik", "period", "cusip").agg(
        F.count("*").alias("position_count"), F.sum(value).alias("total_value"),
        F.count_if(plain).alias("plain_count"), F.sum(F.when(plain, value)).alias("plain_value"),
        F.count_if(value < 0).alias("negative"), F.count_if(invalid).alias("invalid")), "quality-holdings")
    counts = [F.sum(name).alias(name) for name in ("position_count", "total_value", "negative", "invalid")]
    managers = stage(holdings.groupBy("cik", "period").agg(F.count("*").alias("security_count"), *counts), "quality-managers")
    securities = stage(holdings.groupBy("period", "cusip").agg(F.count("*").alias("manager_count"), *counts), "quality-securities")
    universe = stage(t["manager_periods"].filter("coverage_status = 'COMPLETE'").select("cik", "period").join(
        t["manager_period_stats"].filter("total_value > 0").select("cik", "period", F.col("total_value").alias("total")),
        ["cik", "period"]), "quality-universe")
    weights = stage(holdings.filter("plain_count > 0").join(universe, ["cik", "period"]).groupBy("period", "cusip").agg(
        F.count("*").alias("holders"),
        F.sum(F.col("plain_value").cast("double") / F.col("total")).alias("weight")), "quality-weights")
    return Recomputed(holdings, managers, securities, universe, weights)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows of ``df`` that break each rule, all counted in one pass."""
    counted = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"r{at}") for at, bad in enumerate(rules.values())])
    pairs = [F.struct(F.lit(rule).alias("rule"), F.col(f"r{at}").alias("violations")) for at, rule in enumerate(rules)]
    return counted.select(F.inline(F.array(*pairs)))


def _rows(rule: str, bad_rows: DataFrame) -> DataFrame:
    return bad_rows.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def _balances(measures: dict[str, tuple[DataFrame, dict[str, Column]]], rules: dict[str, Column]) -> DataFrame:
    """Rules that compare whole-table totals; a violation is the absolute difference.

    ``measures`` gives each table's totals, all taken in one pass over it; ``rules`` are expressions over
    their names that must come out zero.
    """
    rows = _union([df.agg(*[m.alias(name) for name, m in totals.items()]).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("name"), F.coalesce(F.col(name), F.lit(0)).cast("long").alias("value"))
        for name in totals]))) for df, totals in measures.values()])
    names = [name for _, totals in measures.values() for name in totals]
    wide = rows.agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in names])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.abs(balance).alias("violations")) for rule, balance in rules.items()])))


def _orphans(rule: str, child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return _rows(rule, child.join(parent.select(*keys).distinct(), keys, "left_anti"))


def total_rules(t: Tables, actual: Recomputed) -> DataFrame:
    """Row counts agree between tables, and counts and values are conserved from positions to statistics."""
    def rows(name: str) -> dict[str, Column]:
        return {name: F.count("*")}

    stats = ("position_count", "total_value")
    measures = {
        "periods": (t["periods"], rows("periods")),
        "manager_periods": (t["manager_periods"], rows("quarters")),
        "manager_period_stats": (t["manager_period_stats"], {
            **rows("manager_stats"), **{f"manager_{name}": F.sum(name) for name in stats}}),
        "security_period_stats": (t["security_period_stats"], {
            **rows("security_stats"), **{f"security_{name}": F.sum(name) for name in stats}}),
        "period_stats": (t["period_stats"], rows("period_stats")),
        "period_change_totals": (t["period_change_totals"], rows("change_totals")),
        "filing_part_stats": (t["filing_part_stats"], rows("part_stats")),
        "effective_filing_parts": (t["effective_filing_parts"], rows("parts")),
        "dashboard_period_stats": (t["dashboard_period_stats"], rows("dashboard")),
        "security_weight_stats": (t["security_weight_stats"], rows("stored_weights")),
        "actual_weights": (actual.weights, rows("actual_weights")),
        "actual_securities": (actual.securities, {
            **rows("held"), "positions": F.sum("position_count"), "value": F.sum("total_value"),
            "negative": F.sum("negative"), "invalid": F.sum("invalid")}),
    }
    c = F.col
    return _balances(measures, {
        "manager-period stats row count": c("manager_stats") - c("quarters"),
        "security-period stats row count": c("security_stats") - c("held"),
        "period stats row count": c("period_stats") - c("periods"),
        "period-change total row count": c("change_totals") - F.greatest(c("periods") - 1, F.lit(0)),
        "filing-part stats row count": c("part_stats") - c("parts"),
        "dashboard period stats row count": c("dashboard") - c("periods"),
        "security weight stats row count": c("stored_weights") - c("actual_weights"),
        "manager stats position total": c("manager_position_count") - c("positions"),
        "manager stats value total": c("manager_total_value") - c("value"),
        "security stats position total": c("security_position_count") - c("positions"),
        "security stats value total": c("security_total_value") - c("value"),
        "negative position values": c("negative"),
        "invalid positions": c("invalid"),
    })


def period_count_rule(t: Tables, expected: int) -> DataFrame:
    return t["periods"].agg(F.abs(F.count("*") - expected).alias("violations")).select(
        F.lit("period count").alias("rule"), "violations")


def orphan_rules(t: Tables, actual: Recomputed) -> DataFrame:
    periods, quarters, securities = t["periods"], t["manager_periods"], t["securities"]
    quarter = ["cik", "period"]
    # Distinct keys only: a popular security or a large manager is one row on the left side of each check.
    checks = [
        _orphans("orphan positions", actual.managers.select("cik").distinct(), t["managers"], ["cik"]),
        _orphans("orphan positions", actual.managers.select(*quarter), quarters, quarter),
        _orphans("orphan positions", actual.securities.select("period").distinct(), periods, ["period"]),
        _orphans("orphan positions", actual.securities.select("cusip").distinct(), securities, ["cusip"])]
    together = _union(checks).groupBy("rule").agg(F.sum("violations").alias("violations"))
    parts, stats = t["effective_filing_parts"], t["filing_part_stats"]
    weights, dashboard = t["security_weight_stats"], t["dashboard_period_stats"]
    pairs = [
        together,
        _orphans("orphan effective filing parts", parts, quarters, quarter),
        _orphans("missing latest effective filing parts",
                 quarters.filter("part_count > 0").select("accession"), parts, ["accession"]),
        _orphans("orphan filing-part stats", stats, parts, ["accession", *quarter]),
        _orphans("orphan manager-period stats", t["manager_period_stats"], quarters, quarter),
        _orphans("orphan security-period stats", t["security_period_stats"], periods, ["period"]),
        _orphans("orphan security-period stats", t["security_period_stats"], securities, ["cusip"]),
        _orphans("orphan period stats", t["period_stats"], periods, ["period"]),
        _orphans("orphan dashboard period stats", dashboard, periods, ["period"]),
        _orphans("orphan dashboard period stats",
                 dashboard.filter("previous_period is not null").select(F.col("previous_period").alias("period")),
                 periods, ["period"]),
        _orphans("orphan security weight stats", weights, periods, ["period"]),
        _orphans("orphan security weight stats", weights, securities, ["cusip"]),
        _orphans("orphan security weight stats", weights, dashboard, ["period"]),
    ]
    return _union(pairs).groupBy("rule").agg(F.sum("violations").alias("violations"))


def domain_rules(t: Tables, actual: Recomputed) -> DataFrame:
    def negative(*names: str) -> Column:
        return reduce(lambda a, b: a | b, [F.col(name) < 0 for name in names])

    mismatch = F.coalesce(~F.col("entry_count_matches"), F.lit(False)) | F.coalesce(~F.col("value_matches"), F.lit(False))
    per_table = [
        _counts(t["effective_filing_parts"], {
            "invalid effective filing part types": ~F.col("part_type").isin(*fv.PART_TYPES)}),
        _counts(t["manager_periods"], {
            "invalid coverage statuses": ~F.col("coverage_status").isin(*fv.COVERAGE_STATUSES)}),
        _counts(t["manager_period_stats"], {
            "negative materialized statistics": negative("position_count", "security_count", "total_value")}),
        _counts(t["security_period_stats"], {
            "negative materialized statistics": negative("position_count", "manager_count", "total_value")}),
        _counts(t["period_stats"], {
            "negative materialized statistics": negative(*[c for c in t["period_stats"].columns if c != "period"])}),
        _counts(t["filing_part_stats"], {
            "invalid summary reconciliation flags": negative("observed_entry_count", "observed_value")
            | (F.col("has_discrepancy") != mismatch)}),
        _counts(t["dashboard_period_stats"], {
            "invalid dashboard statistics": negative("weight_manager_count", "comparable_manager_count")}),
        _counts(t["security_weight_stats"], {
            "invalid dashboard statistics": (F.col("holder_count") <= 0)
            | negative("weight_sum", "avg_weight", "new_holder_count")
            | F.isnan("weight_sum") | F.isnan("avg_weight")}),
        _counts(t["sectors"], {"empty sector tickers": F.col("ticker") == ""}),
        _counts(t["market_caps"], {"invalid market caps": F.col("market_cap") <= 0}),
        _counts(t["managers"], {"invalid manager flags": F.col("starred").isNull()}),
    ]
    return _union(per_table).groupBy("rule").agg(F.sum("violations").alias("violations"))


def _comparable_quarters(t: Tables) -> DataFrame:
    complete = t["manager_periods"].filter("coverage_status = 'COMPLETE'").select("cik", "period")
    links = F.broadcast(link_periods(t["periods"]).select("period", "previous_period"))
    earlier = complete.select("cik", F.col("period").alias("previous_period"))
    return complete.join(links, "period").join(earlier, ["cik", "previous_period"])


def logic_rules(t: Tables, actual: Recomputed) -> DataFrame:
    complete = t["manager_periods"].filter("coverage_status = 'COMPLETE'").select("cik", "period")
    links = link_periods(t["periods"]).select("period", F.col("previous_period").alias("expected"))
    dashboard = t["dashboard_period_stats"]
    linked = links.join(dashboard.withColumn("stored", F.lit(True)), "period", "left")
    universe = actual.universe.groupBy("period").agg(F.count("*").alias("expected"))
    comparable = _comparable_quarters(t).groupBy("period").agg(F.count("*").alias("expected"))
    return _union([
        _rows("summary discrepancies marked complete",
              t["filing_part_stats"].filter("has_discrepancy").join(complete, ["cik", "period"], "left_semi")),
        _rows("dashboard previous-period links", linked.filter(
            F.col("stored").isNull() | ~F.col("previous_period").eqNullSafe(F.col("expected")))),
        _rows("dashboard weight-universe counts", dashboard.join(universe, "period", "left").filter(
            F.col("weight_manager_count") != F.coalesce("expected", F.lit(0)))),
        _rows("dashboard comparable-manager counts", dashboard.join(comparable, "period", "left").filter(
            F.col("comparable_manager_count") != F.coalesce("expected", F.lit(0)))),
    ])


def _differences(rule: str, stored: DataFrame, actual: DataFrame) -> DataFrame:
    actual = actual.select(stored.columns)
    return _rows(rule, stored.exceptAll(actual).unionByName(actual.exceptAll(stored)))


def recompute_rules(t: Tables, actual: Recomputed) -> DataFrame:
    """Recomputed statistics equal the stored ones, compared as whole tables, both ways."""
    manager = t["manager_periods"].select("cik", "period").join(
        actual.managers.drop("negative", "invalid"), ["cik", "period"], "left").na.fill(0)
    security = actual.securities.drop("negative", "invalid")
    period = rollups.period_stats(t["periods"], t["manager_periods"], manager, security)
    sums = manager.select("cik", "period", "total_value")
    pairs = _comparable_quarters(t).select("cik", "period", "previous_period")
    now = pairs.join(sums, ["cik", "period"]).groupBy("period").agg(F.sum("total_value").alias("current_value"))
    then = (pairs.join(sums.withColumnRenamed("period", "previous_period"), ["cik", "previous_period"])
            .groupBy("period").agg(F.sum("total_value").alias("previous_value")))
    totals = (link_periods(t["periods"]).filter("previous_period is not null").join(now, "period", "left")
              .join(then, "period", "left").na.fill(0).withColumnRenamed("period", "current_period"))
    return _union([
        _differences("period stats mismatches", t["period_stats"], period),
        _differences("manager-period stats mismatches", t["manager_period_stats"], manager),
        _differences("security-period stats mismatches", t["security_period_stats"], security),
        _differences("period-change portfolio totals mismatches", t["period_change_totals"], totals),
    ])


def latest_period_rules(t: Tables, actual: Recomputed) -> DataFrame:
    """The latest period's weights (within 1e-9) and first-time holders (exactly) match the positions."""
    latest = F.broadcast(t["periods"].agg(F.max("period").alias("period")))  # one row
    stored = t["security_weight_stats"].join(latest, "period")
    size = F.broadcast(actual.universe.join(latest, "period").groupBy("period").agg(F.count("*").alias("n")))  # one row
    compared = stored.join(actual.weights, ["period", "cusip"], "left").join(size, "period", "left")
    wrong = (F.col("holders").isNull() | (F.col("holders") != F.col("holder_count"))
             | (F.abs(F.col("weight") - F.col("weight_sum")) >= 1e-9)
             | (F.abs(100.0 * F.col("weight") / F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)) - F.col("avg_weight")) >= 1e-9))
    pairs = _comparable_quarters(t).join(latest, "period")
    plain = actual.holdings.filter("plain_count > 0").select("cik", "period", "cusip")
    # Only the two periods that are compared are shuffled.
    now = plain.join(latest, "period").join(pairs, ["cik", "period"])
    compared_with = F.broadcast(pairs.select("previous_period").distinct())  # one row
    before = plain.withColumnRenamed("period", "previous_period").join(compared_with, "previous_period", "left_semi")
    fresh = now.join(before, ["cik", "previous_period", "cusip"], "left_anti").groupBy("cusip").agg(
        F.count("*").alias("fresh"))
    drift = stored.join(fresh, "cusip", "left").filter(
        F.col("new_holder_count") != F.coalesce("fresh", F.lit(0)))
    return _union([_rows("latest-period security weight mismatches", compared.filter(wrong)),
                   _rows("latest-period new-holder mismatches", drift)])


def change_rules(t: Tables, actual: Recomputed) -> DataFrame:
    ordered = F.col("current_period") <= F.col("previous_period")
    periods = t["periods"].select("period")

    def sides(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array("current_period", "previous_period")).alias("period")).distinct()

    found = [
        _counts(t["stock_changes"], {"orphan changes": ordered}),
        _orphans("orphan changes", sides(t["stock_changes"]), periods, ["period"]),
        _orphans("orphan changes", t["stock_changes"].select("cusip").distinct(), t["securities"], ["cusip"]),
        _counts(t["period_change_totals"], {"orphan change totals": ordered}),
        _orphans("orphan change totals", sides(t["period_change_totals"]), periods, ["period"]),
    ]
    return _union(found).groupBy("rule").agg(F.sum("violations").alias("violations"))


def metadata_rules(t: Tables) -> DataFrame:
    """Stored counts, latest period, and schema version agree with the tables."""
    stored = t["metadata"]
    checks = []
    for key, table in (("period_count", "periods"), ("manager_count", "managers"),
                       ("security_count", "securities"), ("position_count", "positions")):
        checks.append(t[table].agg(F.count("*").cast("string").alias("actual")).withColumn("key", F.lit(key)))
    checks.append(t["periods"].agg(F.max_by("label", "period").alias("actual")).withColumn("key", F.lit("latest_period")))
    expected = _union(checks).withColumn("rule", F.concat(F.lit("metadata "), F.col("key")))
    version = t["periods"].agg(F.lit(fv.SCHEMA_VERSION).alias("actual")).withColumn(
        "key", F.lit("schema_version")).withColumn("rule", F.lit("schema version"))
    joined = expected.unionByName(version).join(stored, "key", "left")
    wrong = F.when(F.col("value").eqNullSafe(F.col("actual")), 0).otherwise(1).cast("long")
    return joined.select("rule", wrong.alias("violations"))


def snapshot_rules(t: Tables, expected_periods: int | None = None) -> DataFrame:
    """Every rule over a snapshot's tables as ``rule, violations`` (stages one recomputation)."""
    actual = recompute(t)
    groups = [rule(t, actual) for rule in (total_rules, orphan_rules, domain_rules, logic_rules, recompute_rules,
                                           latest_period_rules, change_rules)]
    if expected_periods is not None:
        groups.append(period_count_rule(t, expected_periods))
    if "metadata" in t:
        groups.append(metadata_rules(t))
    return _union(groups)


def failures(rules: DataFrame) -> DataFrame:
    return rules.filter("violations > 0")


def require(rules: DataFrame, what: str) -> None:
    """Raise one error that lists every rule that fired (reads only the failed rules)."""
    bad = failures(rules).orderBy("rule").collect()
    if bad:
        raise ValueError(f"{what} failed: " + " | ".join(f"{row.rule}: {row.violations}" for row in bad))


def ingest_rules(members: dict[str, DataFrame], effective: DataFrame) -> DataFrame:
    """Rules over raw members: keys present, numbers readable, archives and accessions unambiguous.

    ``effective`` are the accessions in force; holdings rows of other filings are not judged.
    """
    sub, cover, summary, info = (members[name] for name in ("SUBMISSION", "COVERPAGE", "SUMMARYPAGE", "INFOTABLE"))
    blank = C.is_blank(F.col("accession_number"))
    initial = sub.filter(F.col("submissiontype") == fv.INITIAL_HOLDINGS_TYPE)
    relevant = sub.filter(F.col("submissiontype").startswith(fv.FILING_TYPE_PREFIX))
    primary = (initial.groupBy("archive", "periodofreport").agg(F.count("*").alias("n"), F.min("row_no").alias("r"))
               .groupBy("archive").agg(F.max(F.struct("n", -F.col("r"), "periodofreport")).alias("top"))
               .select(F.col("top.periodofreport").alias("label")))
    held = info.withColumn("accession", C.strip("accession_number")).join(
        effective.select("accession"), "accession", "left_semi")
    return _union([
        _counts(sub, {"submission rows without an accession": blank}),
        _counts(cover, {"cover rows without an accession": blank,
                        "invalid amendment numbers": C.bad_whole_number(F.col("amendmentno"))}),
        _counts(summary, {"summary rows without an accession": blank,
                          "invalid reported totals": C.bad_whole_number(F.col("tableentrytotal"))
                          | C.bad_whole_number(F.col("tablevaluetotal"))}),
        _counts(info, {"holdings rows without an accession": blank}),
        _counts(relevant, {"invalid manager numbers": C.manager_key(F.col("cik")).isNull(),
                           "invalid filing dates": C.filing_date(F.col("filing_date")).isNull()}),
        _counts(held, {"effective holdings without a security": C.is_blank(F.col("cusip")),
                       "invalid holdings values": C.bad_whole_number(F.col("value")),
                       "invalid holdings amounts": C.bad_finite_number(F.col("sshprnamt"))}),
        _rows("archives without initial holdings reports",
              sub.select("archive").distinct().join(initial.select("archive").distinct(), "archive", "left_anti")),
        _rows("archives sharing a primary period", primary.groupBy("label").count().filter("count > 1")),
        _rows("effective accessions listed more than once",
              effective.groupBy("accession").count().filter("count > 1")),
    ])


def watchlist_rule(watchlist: DataFrame, managers: DataFrame) -> DataFrame:
    return _rows("watched managers missing from the filings", watchlist.select("cik").join(managers, "cik", "left_anti"))


def score_rules(scores: DataFrame) -> DataFrame:
    return _rows("duplicate manager-period scores", scores.groupBy("cik", "period").count().filter("count > 1"))


def threshold_rules(found: DataFrame) -> DataFrame:
    """``rule, found, required`` rows to violations."""
    short = F.when(F.col("found") < F.col("required"), 1).otherwise(0).cast("long")
    return found.select("rule", short.alias("violations"))


def quality_indicators(t: Tables) -> DataFrame:
    """The fourteen data-quality counters as ``key, value``; one aggregate per table."""
    def counters(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
        counted = df.agg(*[measure.alias(f"m{at}") for at, measure in enumerate(measures.values())])
        pairs = [F.struct(F.lit(f"data_quality_{name}_count").alias("key"), F.col(f"m{at}").cast("long").alias("value"))
                 for at, name in enumerate(measures)]
        return counted.select(F.inline(F.array(*pairs)))

    entry, value = F.col("entry_count_matches"), F.col("value_matches")
    quarters = t["filing_part_stats"].filter("has_discrepancy").select("cik", "period").distinct()
    return _union([
        counters(t["filing_part_stats"], {
            "effective_filing_part": F.count("*"),
            "summary_discrepancy_part": F.count_if("has_discrepancy"),
            "summary_entry_mismatch_part": F.count_if(~entry),
            "summary_value_mismatch_part": F.count_if(~value),
            "summary_unavailable_field": F.count_if(entry.isNull()) + F.count_if(value.isNull())}),
        counters(quarters, {"summary_discrepancy_manager_period": F.count("*")}),
        counters(t["manager_periods"], {
            "coverage_downgrade": F.count_if("downgraded"),
            **{f"{status.lower()}_manager_period": F.count_if(F.col("coverage_status") == status)
               for status in fv.COVERAGE_STATUSES}}),
        counters(t["securities"], {"missing_ticker_security": F.count_if(F.col("ticker") == "")}),
        counters(t["positions"], {
            "null_shares_position": F.count_if(F.col("shares").isNull()),
            "zero_value_position": F.count_if(F.col("value") == 0)}),
    ])
