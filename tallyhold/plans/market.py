"""Price refresh and signal jobs over landed quotes and a published snapshot."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold import fixed_values as fv
from tallyhold.operators import filings, positions, prices, quality, signals
from tallyhold.schemas import TABLES, conform
from tallyhold.session import configure, scanned_bytes, stage


def refresh_bars(spark: SparkSession, tables: dict[str, DataFrame], trusted: DataFrame, payloads: DataFrame,
                 old_path: str | None, new_path: str, mark: dt.date, *, source: str = "") -> prices.PriceCache:
    """Write a new version of the price table: old bars with the landed quotes of wanted symbols over them.

    The new version lists the old one's files where no quote changes them, so the old version's folder must stay.

    ``payloads``: ``symbol, asset_class, payload``.  The metadata is written last, and only when enough
    symbols close on the mark date, so an unfinished version is never used.
    """
    configure(spark, scanned_bytes(tables["positions"], payloads))
    targets = stage(signals.price_targets(tables["positions"], tables["securities"], trusted), "price_targets")
    first_day = tables["periods"].agg(F.min("period")).first()[0]
    wanted = payloads.join(targets, "symbol", "left_semi")
    fresh = stage(prices.parse_history(wanted, first_day.isoformat(), mark.isoformat()), "fresh_bars")
    usable = bool(old_path) and prices.load_price_cache(spark, old_path).usable
    root = new_path.rstrip("/")
    prices.write_bars(f"{old_path.rstrip('/')}/bars" if usable else None, fresh, f"{root}/bars")
    bars, _ = prices.load_bars(spark, f"{root}/bars")
    requested = targets.count()
    found = prices.check_mark_coverage(bars, mark, requested).select(
        F.lit("symbols with the common close").alias("rule"), F.col("mark_symbols").alias("found"), "required")
    quality.require(quality.threshold_rules(found), "Price refresh")
    displayed = tables["securities"].filter("trim(ticker) != ''").agg(
        F.count_distinct(F.upper(F.trim("ticker"))).cast("string").alias("value")).select(
        F.lit("display_symbol_count").alias("key"), "value")
    marked = found.select(F.lit("mark_symbol_count").alias("key"), F.col("found").cast("string").alias("value"))
    failed = targets.join(fresh, "symbol", "left_anti").agg(F.count("*").cast("string").alias("value")).select(
        F.lit("failed_symbol_count").alias("key"), "value")
    stated = spark.createDataFrame(
        [("schema_version", "1"), ("source", source), ("from_date", first_day.isoformat()), ("mark_date", mark.isoformat()),
         ("requested_symbol_count", str(requested)), ("price_adjustment", fv.PRICE_ADJUSTMENT)], TABLES["metadata"])
    stated.unionByName(displayed).unionByName(marked).unionByName(failed).write.parquet(f"{root}/metadata")
    return prices.load_price_cache(spark, root)


def build_signals(spark: SparkSession, tables: dict[str, DataFrame], trusted: DataFrame, bars: DataFrame,
                  mark: dt.date, output: str) -> dict[str, DataFrame]:
    """Write fund scores and scope values with their policy metadata; returns readers of what was written."""
    configure(spark, scanned_bytes(tables["positions"], bars))
    context = stage(filings.manager_context(
        tables["manager_periods"], tables["periods"], tables["manager_period_stats"]), "context")
    # The only join of the facts; everything after it reads the share positions it leaves.
    wide = stage(signals.share_positions(positions.with_context(tables["positions"], context)), "wide_positions")
    made = signals.signal_tables(wide, context, tables["manager_period_stats"], trusted, bars, mark)
    for name in ("fund_scores", "scope_values"):
        conform(made[name], TABLES[name]).write.parquet(f"{output.rstrip('/')}/{name}")
    written = {name: spark.read.schema(TABLES[name]).parquet(f"{output.rstrip('/')}/{name}")
               for name in ("fund_scores", "scope_values")}
    quality.require(quality.score_rules(written["fund_scores"]), "Signal validation")
    scores, scopes = written["fund_scores"], written["scope_values"]
    counted = scores.agg(F.count("*").alias("score_count"), F.count_if("rankable").alias("rankable_score_count"))
    scaled = scopes.agg(F.count("*").alias("scope_value_count"),
                        F.count_if("scale_inferred").alias("scaled_scope_value_count"))
    numbers = [frame.select([F.col(c).cast("string") for c in frame.columns]).unpivot([], frame.columns, "key", "value")
               for frame in (counted, scaled,
                             trusted.agg(F.count_distinct("ticker").alias("trusted_ticker_count")))]
    policy = spark.createDataFrame(
        [("schema_version", "1"), ("metric_version", fv.METRIC_VERSION), ("available", "1"),
         ("mark_date", mark.isoformat()), ("price_adjustment", fv.PRICE_ADJUSTMENT),
         ("reference_policy", fv.REFERENCE_POLICY), ("event_policy", fv.EVENT_POLICY),
         ("ranking_policy", fv.RANKING_POLICY), ("research_cutoff", fv.RESEARCH_CUTOFF)], TABLES["metadata"])
    for frame in numbers:
        policy = policy.unionByName(frame)
    policy.write.parquet(f"{output.rstrip('/')}/signal_metadata")
    return {**written, "signal_metadata": spark.read.schema(TABLES["metadata"]).parquet(
        f"{output.rstrip('/')}/signal_metadata")}
