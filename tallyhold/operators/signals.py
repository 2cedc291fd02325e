"""Post-disclosure signals: price targets, split factors, reporting-unit scale, and manager scores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhold import fixed_values as fv
from tallyhold.functions import columns as C
from tallyhold.operators import asof, median
from tallyhold.operators.exact_sum import exact_sums
from tallyhold.session import stage


def trusted_tickers(records: DataFrame, overrides: DataFrame) -> DataFrame:
    """Exact and manual tickers only; a manual override replaces the exact one."""
    exact = records.filter(F.col("source") == fv.EXACT_SOURCE).select(
        C.security_key(F.col("cusip")).alias("cusip"), C.plain_ticker(F.col("ticker")).alias("ticker"))
    manual = overrides.select(
        C.security_key(F.col("cusip")).alias("cusip"), C.plain_ticker(F.col("ticker")).alias("ticker"))
    manual = manual.filter("ticker != ''")
    return exact.filter("ticker != ''").join(manual, "cusip", "left_anti").unionByName(manual)


def price_targets(positions: DataFrame, securities: DataFrame, trusted: DataFrame) -> DataFrame:
    """Symbols to price: trusted tickers of plain share positions, and every displayed ticker."""
    held = positions.filter("position_type = 0 and shares_type = 0 and shares is not null").select("cusip").distinct()
    scored = trusted.join(held, "cusip", "left_semi").select(F.col("ticker").alias("symbol"))
    shown = securities.select(C.plain_ticker(F.col("ticker")).alias("symbol")).filter("symbol != ''")
    return scored.unionByName(shown).distinct()


def share_positions(positions: DataFrame) -> DataFrame:
    """Plain share positions with known shares; unique per manager, period, and security."""
    return positions.filter("position_type = 0 and shares_type = 0 and shares is not null")


def quarter_end_closes(positions: DataFrame, trusted: DataFrame, bars: DataFrame) -> DataFrame:
    """Trusted ticker and last close on or before the period, per period and held security."""
    held = positions.select("period", "cusip").distinct().join(trusted, "cusip")
    closes = asof.asof_prices(held.select(F.col("ticker").alias("symbol"), F.col("period").alias("date")), bars)
    closes = closes.filter("before_close is not null").select(
        F.col("symbol").alias("ticker"), F.col("date").alias("period"), F.col("before_close").alias("close"))
    return held.join(closes, ["ticker", "period"])


def split_factors(positions: DataFrame, closes: DataFrame) -> DataFrame:
    """Split factor per period and security from the median of reported unit price over close.

    Dividing by one positive close keeps the order of the unit prices, so their middle elements are found
    without joining prices to positions; the ratios themselves are formed exactly as defined.
    """
    unit = share_positions(positions).filter("shares > 0 and value > 0").select(
        "period", "cusip", (F.col("value").cast("double") / F.col("shares")).alias("unit_price"))
    middle = median.middle_values(unit, ["period", "cusip"], "unit_price")
    ratio = median.median(F.col("low") / F.col("close"), F.col("high") / F.col("close"))
    joined = middle.join(closes, ["period", "cusip"]).withColumn("median_ratio", ratio)
    return joined.select(
        "period", "cusip", "ticker", "close", F.col("rows").alias("evidence_count"), "median_ratio",
        C.nearest_split_factor(F.col("median_ratio")).alias("factor"))


def priced_positions(positions: DataFrame, factors: DataFrame, trusted: DataFrame) -> DataFrame:
    """Plain share positions with trusted ticker, close, and factor where known.

    The attributes depend on period and security only.  They are staged, so that both sides of this one
    fact-scale join are shuffled directly and adaptive execution can split a popular security.
    """
    known = factors.select("period", "cusip", "close", "factor")
    attributes = (share_positions(positions).select("period", "cusip").distinct()
                  .join(trusted, "cusip", "left").join(known, ["period", "cusip"], "left"))
    return share_positions(positions).join(stage(attributes, "price_attributes"), ["period", "cusip"])


def scope_values(manager_stats: DataFrame, priced: DataFrame) -> DataFrame:
    """Reported total per manager-quarter, scaled up when filings are plainly in thousands.

    ``priced`` should be a written table (see ``priced_positions``).
    """
    expected = F.col("shares") * F.col("close") * F.col("factor")
    evidence = priced.filter("shares > 0 and value > 0").filter(expected > 0).select(
        "cik", "period", (F.col("value").cast("double") / expected).alias("value_ratio"))
    middle = median.middle_values(evidence, ["cik", "period"], "value_ratio").select(
        "cik", "period", F.col("rows").alias("evidence_count"),
        median.median(F.col("low"), F.col("high")).alias("median_value_ratio"))
    joined = manager_stats.select("cik", "period", F.col("total_value").alias("raw_reported_value")).join(
        middle, ["cik", "period"], "left")
    low, high = fv.LEGACY_RATIO_RANGE
    legacy = F.coalesce((F.col("evidence_count") >= fv.LEGACY_MIN_EVIDENCE)
                        & F.col("median_value_ratio").between(low, high), F.lit(False))
    scale = F.when(legacy, fv.LEGACY_THOUSANDS_SCALE).otherwise(1).cast("long")
    scaled = F.least(F.col("raw_reported_value").cast("decimal(38,0)") * scale.cast("decimal(5,0)"),
                     F.lit(fv.MAX_WHOLE_NUMBER).cast("decimal(38,0)"))
    return joined.select(
        "cik", "period", "raw_reported_value", scale.alias("value_scale"), scaled.cast("long").alias("scope_value"),
        F.coalesce("evidence_count", F.lit(0).cast("long")).alias("evidence_count"), "median_value_ratio",
        legacy.alias("scale_inferred"))


def position_events(priced: DataFrame) -> DataFrame:
    """Share changes between neighbouring complete quarters, split-adjusted.

    One row per comparable (manager, security, pair): ``delta`` is NULL when a side has shares but no
    validated factor; ``is_candidate`` says whether the change counts at all.
    """
    line = Window.partitionBy("cik", "cusip").orderBy("period")
    seen = (priced.withColumn("before", F.lag(F.struct("period", "shares", "factor")).over(line))
            .withColumn("after", F.lead("period").over(line)))
    had = F.coalesce(F.col("before.period") == F.col("previous_period"), F.lit(False))
    gone = F.col("to_next") & ~F.coalesce(F.col("after") == F.col("next_period"), F.lit(False))

    def event(period, previous, filed, now, now_factor, then, then_factor):
        return F.struct(period.alias("period"), previous.alias("previous_period"), filed.alias("filing_date"),
                        now.alias("now"), now_factor.alias("now_factor"),
                        then.alias("then"), then_factor.alias("then_factor"))

    own = F.when(F.col("from_previous"), event(
        F.col("period"), F.col("previous_period"), F.col("filing_date"), F.col("shares"), F.col("factor"),
        F.when(had, F.col("before.shares")).otherwise(0.0), F.when(had, F.col("before.factor")).otherwise(1.0)))
    exited = F.when(gone, event(
        F.col("next_period"), F.col("period"), F.col("next_filing_date"), F.lit(0.0), F.lit(1.0),
        F.col("shares"), F.col("factor")))
    rows = seen.select("cik", "cusip", "ticker", F.explode(F.array_compact(F.array(own, exited))).alias("e"))
    now, then = F.col("e.now") * F.col("e.now_factor"), F.col("e.then") * F.col("e.then_factor")
    unvalidated = F.col("e.now_factor").isNull() | F.col("e.then_factor").isNull()
    tolerance = F.greatest(F.lit(1e-8), F.greatest(F.abs(now), F.abs(then)) * 1e-9)
    moved = F.when(unvalidated, F.abs(F.col("e.now") - F.col("e.then")) > 1e-8).otherwise(
        F.abs(now - then) > tolerance)
    return rows.select(
        "cik", "cusip", "ticker", "e.period", "e.previous_period", "e.filing_date",
        F.when(~unvalidated, now - then).alias("delta"), moved.alias("is_candidate")).filter("is_candidate")


def priced_events(events: DataFrame, bars: DataFrame, mark: dt.date) -> DataFrame:
    """Events with profit since the first close after filing; unpriced events keep NULL profit.

    ``events`` should be a written table: it is read for its lookups and again to be priced.  A few (ticker, filing date) pairs are shared by most managers, so lookups run on distinct pairs and the
    event side of the join back is the splittable one.
    """
    day = F.lit(mark).cast("date")
    eligible = F.col("delta").isNotNull() & F.col("ticker").isNotNull()
    pairs = events.filter(eligible).select(F.col("ticker").alias("symbol"), F.col("filing_date").alias("date"))
    quotes = asof.asof_prices(pairs, bars).filter(F.col("after_date") <= day).select(
        "symbol", "date", F.col("after_date").alias("reference_date"), F.col("after_close").alias("reference_close"))
    quotes = quotes.join(asof.exact_close(bars, mark), "symbol").select(
        F.col("symbol").alias("ticker"), F.col("date").alias("filing_date"),
        "reference_date", "reference_close", "mark_close")
    joined = events.withColumn("is_eligible", eligible).join(quotes, ["ticker", "filing_date"], "left")
    gross = F.abs("delta") * F.col("reference_close")
    usable = F.col("is_eligible") & (gross > 0) & (gross < F.lit(float("inf")))
    return joined.select(
        "cik", "period", "cusip", "is_eligible", "delta",
        F.when(usable, gross).alias("gross"),
        F.when(usable, F.col("delta") * (F.col("mark_close") - F.col("reference_close"))).alias("pnl"),
        F.when(usable, F.col("reference_date")).alias("reference_date"))


def manager_scores(context: DataFrame, events: DataFrame, mark: dt.date) -> DataFrame:
    """One score row per manager-quarter, events or not; ``events`` come from ``priced_events``."""
    own = events.select("cik", "period", "is_eligible", "delta", "reference_date", F.col("pnl").alias("profit"), F.col("gross").alias("size"))
    is_priced = F.col("size").isNotNull()
    sums = exact_sums(own, ["cik", "period"], {"pnl": F.col("profit"), "gross": F.col("size"), "squares": F.col("size") * F.col("size")}, {
        "candidate_events": F.count("*"), "eligible_events": F.count_if("is_eligible"),
        "priced_events": F.count_if(is_priced), "buy_events": F.count_if(is_priced & (F.col("delta") > 0)),
        "sell_events": F.count_if(is_priced & (F.col("delta") < 0)), "hit_events": F.count_if(F.col("profit") > 0)},
        {"reference_date": F.col("reference_date")})
    counts = ["candidate_events", "eligible_events", "priced_events", "buy_events", "sell_events", "hit_events"]
    rows = context.join(sums, ["cik", "period"], "left").na.fill(0, [*counts, "pnl", "gross", "squares"])
    coverage = F.when(F.col("eligible_events") > 0, 100.0 * F.col("priced_events") / F.col("eligible_events")).otherwise(0.0)
    bets = F.when(F.col("squares") > 0, F.col("gross") * F.col("gross") / F.col("squares")).otherwise(0.0)
    rows = rows.withColumn("signal_coverage", coverage).withColumn("effective_bets", bets)
    reasons = F.concat_ws(
        "; ",
        F.when(~F.col("from_previous"), fv.REASON_NOT_COMPARABLE),
        F.when(F.col("priced_events") < fv.MIN_PRICED_EVENTS, fv.REASON_FEW_EVENTS),
        F.when(F.col("signal_coverage") < fv.MIN_EVENT_COVERAGE, fv.REASON_LOW_COVERAGE),
        F.when(F.col("effective_bets") < fv.MIN_EFFECTIVE_BETS, fv.REASON_FEW_BETS))
    oldest = F.col("previous_period").isNull()
    rows = rows.withColumn("reason", F.when(oldest, fv.REASON_OLDEST).otherwise(reasons))
    rankable = F.col("reason") == ""
    traded = F.col("gross") > 0
    raw_return = F.when(traded, 100.0 * F.col("pnl") / F.col("gross"))
    return rows.select(
        "cik", "period", "previous_period", "filing_date", "reference_date", F.lit(mark).cast("date").alias("mark_date"),
        F.when(rankable, raw_return).alias("signal_return"), raw_return.alias("raw_signal_return"),
        F.when(rankable, F.col("pnl")).alias("signal_pnl"), F.when(traded, F.col("pnl")).alias("raw_signal_pnl"),
        F.when(traded, F.col("gross")).alias("gross_notional"),
        *counts, "signal_coverage", "effective_bets", rankable.alias("rankable"), "reason")


def signal_tables(positions: DataFrame, context: DataFrame, manager_stats: DataFrame, trusted: DataFrame,
                  bars: DataFrame, mark: dt.date) -> dict[str, DataFrame]:
    """Split factors, scope values, and scores; priced positions and events are staged once."""
    closes = quarter_end_closes(positions, trusted, bars)
    factors = stage(split_factors(positions, closes), "split_factors")
    priced = stage(priced_positions(positions, factors, trusted), "priced_positions")
    events = priced_events(stage(position_events(priced), "position_events"), bars, mark)
    return {
        "split_factors": factors,
        "scope_values": scope_values(manager_stats, priced),
        "fund_scores": manager_scores(context, events, mark),
        "priced_events": events,
    }
