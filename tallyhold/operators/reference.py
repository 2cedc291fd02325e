"""Reference data from screener rows: market caps and the sector/name map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhold import fixed_values as fv
from tallyhold.functions import columns as C


def market_caps(rows: DataFrame) -> DataFrame:
    """Positive capitalisation per clean symbol; the last row of a symbol wins."""
    typed = rows.select(
        C.screener_symbol(F.col("symbol")).alias("ticker"), C.market_value(F.col("marketCap")).alias("market_cap"),
        "row_no").filter("ticker != '' and market_cap is not null")
    return typed.groupBy("ticker").agg(F.max_by("market_cap", "row_no").alias("market_cap"))


def sector_map(stock_rows: DataFrame, etf_rows: DataFrame) -> DataFrame:
    """Sector and display name per symbol.  Fund names stay verbatim; a stock row beats a fund row."""
    funds = etf_rows.select(
        C.screener_symbol(F.col("symbol")).alias("ticker"), F.lit(0).alias("rank"), "row_no",
        F.lit(fv.ETF_SECTOR).alias("sector"),
        C.collapse_spaces(F.coalesce(F.nullif("companyName", F.lit("")), "name", F.lit(""))).alias("name"))
    stocks = stock_rows.select(
        C.screener_symbol(F.col("symbol")).alias("ticker"), F.lit(1).alias("rank"), "row_no",
        C.collapse_spaces(F.coalesce("sector", F.lit(""))).alias("sector"),
        C.display_name(F.col("name")).alias("name"))
    best = (funds.unionByName(stocks).filter("ticker != ''")
            .groupBy("ticker").agg(F.max(F.struct("rank", "row_no", "sector", "name")).alias("best")))
    return best.select("ticker", "best.sector", "best.name")


def sector_values(sectors: DataFrame) -> DataFrame:
    """Distinct non-blank sector names."""
    return sectors.filter("sector != ''").select("sector").distinct()


def screener_rules(stock_rows: DataFrame, caps: DataFrame) -> DataFrame:
    """Threshold rules: enough stock symbols and enough positive market caps (``rule, found, required``)."""
    stocks = stock_rows.filter(C.screener_symbol(F.col("symbol")) != "").agg(F.count("*").alias("found"))
    return (stocks.withColumn("rule", F.lit("stock screener symbols"))
            .unionByName(caps.agg(F.count("*").alias("found")).withColumn("rule", F.lit("positive market caps")))
            .select("rule", "found", F.lit(fv.MIN_SCREENER_ROWS).alias("required")))
