"""Materialised statistics over positions.

Inputs called ``positions`` carry the manager-quarter context (see ``positions.with_context``), so no
rollup joins the facts again.  Neighbouring quarters are compared inside one manager-security timeline,
whose length the calendar bounds; popular securities are pre-aggregated map-side before any security-level
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhold import fixed_values as fv
from tallyhold.operators.exact_sum import exact_sums
from tallyhold.operators.filings import link_periods


def _long(value: int = 0):
    return F.lit(value).cast("long")


def manager_period_stats(quarters: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions, distinct securities, and value per manager-quarter; empty quarters stay with zeros."""
    per_security = positions.groupBy("cik", "period", "cusip").agg(
        F.count("*").alias("position_count"), F.sum("value").alias("total_value"))
    totals = per_security.groupBy("cik", "period").agg(
        F.sum("position_count").alias("position_count"), F.count("*").alias("security_count"),
        F.sum("total_value").alias("total_value"))
    return quarters.select("cik", "period").join(totals, ["cik", "period"], "left").na.fill(0)


def security_period_stats(positions: DataFrame) -> DataFrame:
    per_manager = positions.groupBy("period", "cusip", "cik").agg(
        F.count("*").alias("position_count"), F.sum("value").alias("total_value"))
    return per_manager.groupBy("period", "cusip").agg(
        F.sum("position_count").alias("position_count"), F.count("*").alias("manager_count"),
        F.sum("total_value").alias("total_value"))


def period_stats(periods: DataFrame, quarters: DataFrame, manager_stats: DataFrame,
                 security_stats: DataFrame) -> DataFrame:
    """Per-period totals, taken from the two smaller statistics tables instead of the positions."""
    managers = manager_stats.groupBy("period").agg(
        F.sum("position_count").alias("position_count"), F.sum("total_value").alias("total_value"),
        F.count_if(F.col("position_count") > 0).alias("position_manager_count"))
    securities = security_stats.groupBy("period").agg(F.count("*").alias("security_count"))
    statuses = quarters.groupBy("period").agg(
        F.count("*").alias("manager_period_count"),
        *[F.count_if(F.col("coverage_status") == status).alias(f"{status.lower()}_manager_count")
          for status in fv.COVERAGE_STATUSES])
    return (periods.select("period").join(managers, "period", "left").join(securities, "period", "left")
            .join(statuses, "period", "left").na.fill(0))


def _timeline(*keys: str):
    return Window.partitionBy(*keys).orderBy("period")


def stock_changes(positions: DataFrame) -> DataFrame:
    """Share and value changes between neighbouring quarters, share units only, comparable managers only.

    Each position row looks one step back and one step ahead on its own timeline.  It yields the change of
    its own quarter, plus an exit in the next quarter when the manager reports that quarter without it.
    """
    held = positions.filter(F.col("shares_type") == 0).select(
        "cik", "cusip", "position_type", "period", "previous_period", "next_period", "from_previous", "to_next",
        F.coalesce("shares", F.lit(0.0)).alias("shares"), "value")
    line = _timeline("cik", "cusip", "position_type")
    before = F.lag(F.struct("period", "shares", "value")).over(line)
    after = F.lead("period").over(line)
    seen = held.withColumn("before", before).withColumn("after", after)
    had = F.coalesce(F.col("before.period") == F.col("previous_period"), F.lit(False))
    gone = F.col("to_next") & ~F.coalesce(F.col("after") == F.col("next_period"), F.lit(False))

    def change(current, previous, shares, value, old_shares, old_value, has_now, has_before):
        return F.struct(
            current.alias("current_period"), previous.alias("previous_period"),
            shares.alias("shares"), old_shares.alias("old_shares"), value.alias("value"),
            old_value.alias("old_value"), has_now.alias("has_now"), has_before.alias("has_before"))

    own = F.when(F.col("from_previous"), change(
        F.col("period"), F.col("previous_period"), F.col("shares"), F.col("value"),
        F.when(had, F.col("before.shares")).otherwise(0.0),
        F.when(had, F.col("before.value")).otherwise(_long()), F.lit(True), had))
    exited = F.when(gone, change(
        F.col("next_period"), F.col("period"), F.lit(0.0), _long(),
        F.col("shares"), F.col("value"), F.lit(False), F.lit(True)))
    rows = seen.select("cusip", "position_type", F.explode(F.array_compact(F.array(own, exited))).alias("c"))
    rows = rows.select("cusip", "position_type", "c.*")
    adding = F.count_if(F.col("shares") > F.col("old_shares"))
    cutting = F.count_if(F.col("shares") < F.col("old_shares"))
    key = ["current_period", "previous_period", "cusip", "position_type"]
    sums = exact_sums(rows, key, {"units": F.col("shares"), "old_units": F.col("old_shares")}, {
        "comparable_funds": F.count("*"), "adding_funds": adding, "cutting_funds": cutting,
        "current_funds": F.count_if("has_now"), "previous_funds": F.count_if("has_before"),
        "current_value": F.sum("value"), "old_value": F.sum("old_value")})
    return sums.select(
        *key, "comparable_funds", "adding_funds", "cutting_funds", (F.col("adding_funds") - F.col("cutting_funds")).alias("net_add"),
        "current_funds", "previous_funds", (F.col("units") - F.col("old_units")).alias("net_units"),
        "current_value", (F.col("current_value") - F.col("old_value")).alias("value_change"))


def period_change_totals(periods: DataFrame, context: DataFrame) -> DataFrame:
    """Portfolio value of comparable managers on both sides of each pair; all units, options included.

    A manager's total already is the sum of its positions, so the facts are not read at all.
    """
    now = context.filter("from_previous").groupBy(F.col("period").alias("current_period")).agg(
        F.sum("total_value").alias("current_value"))
    then = context.filter("to_next").groupBy(F.col("next_period").alias("current_period")).agg(
        F.sum("total_value").alias("previous_value"))
    pairs = link_periods(periods).filter("previous_period is not null").select(
        F.col("period").alias("current_period"), "previous_period")
    return pairs.join(now, "current_period", "left").join(then, "current_period", "left").na.fill(0)


def dashboard_period_stats(periods: DataFrame, context: DataFrame) -> DataFrame:
    """Weight-universe size and comparable managers per period."""
    counts = context.groupBy("period").agg(
        F.count_if((F.col("coverage_status") == "COMPLETE") & (F.col("total_value") > 0))
        .alias("weight_manager_count"),
        F.count_if("from_previous").alias("comparable_manager_count"))
    return (link_periods(periods).select("period", "previous_period")
            .join(counts, "period", "left").na.fill(0))


def security_weight_stats(positions: DataFrame, universe: DataFrame) -> DataFrame:
    """Equal-weighted average portfolio weight, holders, and first-time holders per period and security.

    Both measures come from one pass over (manager, security) timelines.  ``universe`` is
    ``dashboard_period_stats``: one row per period, so the final join broadcasts a calendar-bounded table.
    A first-time holder outside the universe only counts on securities that have a weight row.
    """
    plain = positions.filter(F.col("position_type") == 0)
    # A manager-security timeline has a handful of rows; one shuffle by it serves grouping and window.
    per_manager = plain.repartition("cik", "cusip").groupBy(
        "cik", "cusip", "period", "coverage_status", "total_value", "previous_period", "from_previous").agg(
        F.sum("value").alias("value"))
    held_before = F.coalesce(
        F.lag("period").over(_timeline("cik", "cusip")) == F.col("previous_period"), F.lit(False))
    rows = per_manager.withColumn("is_new", F.col("from_previous") & ~held_before)
    in_universe = (F.col("coverage_status") == "COMPLETE") & (F.col("total_value") > 0)
    weight = F.when(in_universe, F.col("value").cast("double") / F.col("total_value"))
    stats = exact_sums(rows.withColumn("weight", weight), ["period", "cusip"], {"weight_sum": F.col("weight")}, {
        "holder_count": F.count("weight"), "new_holder_count": F.count_if("is_new")}).filter(F.col("holder_count") > 0)
    sizes = F.broadcast(universe.select("period", "weight_manager_count"))
    return stats.join(sizes, "period").select(
        "period", "cusip", "holder_count", "weight_sum",
        (100.0 * F.col("weight_sum") / F.col("weight_manager_count")).alias("avg_weight"), "new_holder_count")


def security_relevance(securities: DataFrame, security_stats: DataFrame, latest_period) -> DataFrame:
    """Latest-period value and manager count per security; zero when it is not held."""
    latest = security_stats.filter(F.col("period") == F.lit(latest_period)).select(
        "cusip", F.col("total_value").alias("latest_value"), F.col("manager_count").alias("latest_funds"))
    return securities.join(latest, "cusip", "left")
