"""Price bars: parsing landed quotes, merging batches, mark date, and price columns for ranked rows."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold import fixed_values as fv
from tallyhold.functions import columns as C
from tallyhold.schemas import BARS, conform
from tallyhold.sources import keyed

_HISTORY = ("struct<status:struct<rCode:int>,"
            "data:struct<tradesTable:struct<rows:array<struct<date:string,close:string>>>>>")
_PRICE_COLUMNS = ("price", "price_date", "day_change", "ytd_change")


def parse_history(payloads: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Bars from landed price-history payloads (``symbol, asset_class, payload``).

    The stock route is preferred; the fund route counts only where the stock route did not succeed.  All payloads
    of a symbol's route count.  Rows with a bad date or close, or outside the window, are dropped.  The last row of
    a date wins: that of the greatest ``landed`` (if the payloads have such a column), then the last of its payload,
    then the higher close.
    """
    landed = F.col("landed") if "landed" in payloads.columns else F.lit(0)
    route = F.when(F.col("asset_class") == "stocks", 0).otherwise(1)
    good = payloads.select("symbol", route.alias("route"), landed.alias("landed"), F.from_json("payload", _HISTORY).alias("p")).filter(
        F.col("p.status.rCode") == 200)
    best = good.groupBy("symbol").agg(F.min("route").alias("route"))
    rows = good.join(best, ["symbol", "route"]).select("symbol", "landed", F.posexplode("p.data.tradesTable.rows").alias("at", "row"))
    typed = rows.select(
        "symbol", "landed", "at", F.try_to_date(F.col("row.date"), "M/d/yyyy").alias("price_date"),
        C.closing_price(F.col("row.close")).alias("close"))
    kept = typed.filter(F.col("close").isNotNull() & F.col("price_date").between(
        F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    return conform(kept.groupBy("symbol", "price_date").agg(F.max_by("close", F.struct("landed", "at", "close")).alias("close")), BARS)


def merge_bars(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace bars on (symbol ignoring ASCII case, date) and keep every other bar.

    Stored bars are unique, so only the fresh batch is grouped; the (much larger) stored side passes one
    anti-join.  The spelling of a symbol is that of the row that stays.
    """
    fold = C.fold_ascii(F.col("symbol")).alias("fold")
    newest = fresh.groupBy(fold, "price_date").agg(F.max(F.struct("symbol", "close")).alias("bar"))
    kept = current.select("symbol", "price_date", "close", fold).join(newest, ["fold", "price_date"], "left_anti")
    return kept.select("symbol", "price_date", "close").unionByName(
        newest.select("bar.symbol", "price_date", "bar.close"))


def _keyed(bars: DataFrame) -> DataFrame:
    """Bars with the columns that place them in a keyed table: folded symbol and month."""
    return conform(bars, BARS).withColumn("fold", C.fold_ascii(F.col("symbol"))).withColumn("month", F.date_format("price_date", "yyyy-MM"))


def write_bars(current: str | None, fresh: DataFrame, path: str) -> None:
    """A version of the price table: the bars at ``current`` with the fresh ones over them, of which the last of a day counts.

    Files are clustered by month, so a new day leaves all files of earlier months as they are (see ``sources.keyed``).  The
    spelling of a symbol is that of the row that stays.
    """
    spark, keys = fresh.sparkSession, ["fold", "price_date"]
    newest = fresh.groupBy(C.fold_ascii(F.col("symbol")).alias("fold"), "price_date").agg(F.max(F.struct("symbol", "close")).alias("bar"))
    rows = _keyed(newest.select("bar.symbol", "price_date", "bar.close"))
    if current and keyed.is_keyed(spark, current):
        keyed.upsert(current, rows, path, "month", keys)
    else:
        old, _ = load_bars(spark, current) if current else (spark.createDataFrame([], BARS), False)
        keyed.create(_keyed(merge_bars(old, fresh)), path, "month", keys)


def load_bars(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """Bars and True when the table is readable and has the needed columns, else no bars and False."""
    try:
        bars = keyed.read(spark, path) if keyed.is_keyed(spark, path) else spark.read.parquet(path)
        if set(BARS.fieldNames()) <= set(bars.columns):
            return conform(bars, BARS), True
    except Exception:  # a missing or unreadable price table only means that nothing is priced
        pass
    return spark.createDataFrame([], BARS), False


@dataclass(frozen=True)
class PriceCache:
    """Bars with the mark date and source their metadata states; without usable bars nothing is priced."""

    bars: DataFrame
    usable: bool
    stated_mark: str = ""
    source: str = ""


def load_price_cache(spark: SparkSession, path: str) -> PriceCache:
    """Bars and metadata written by the price refresh (the metadata is a dozen rows)."""
    bars, usable = load_bars(spark, f"{path.rstrip('/')}/bars")
    if usable:
        try:
            stated = {row.key: row.value for row in spark.read.parquet(f"{path.rstrip('/')}/metadata").filter(
                F.col("key").isin("mark_date", "source", "available")).collect()}
            if stated.get("available") == "0":
                return PriceCache(spark.createDataFrame([], BARS), False)
            return PriceCache(bars, True, stated.get("mark_date", ""), stated.get("source", ""))
        except Exception:  # bars without metadata are not a finished price table
            pass
    return PriceCache(spark.createDataFrame([], BARS), False)


def mark_date(bars: DataFrame, stated: str = "") -> dt.date | None:
    """The stated mark date when it has the form of an ISO date, else the latest bar date (one small aggregate).

    A stated day that no calendar has prices nothing.
    """
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", stated or ""):
        try:
            return dt.date.fromisoformat(stated)
        except ValueError:
            return None
    return bars.agg(F.max("price_date")).first()[0]


def check_mark_coverage(bars: DataFrame, mark, requested: int) -> DataFrame:
    """One row: symbols with a close on the mark date and how many are required."""
    needed = min(fv.MIN_MARK_SYMBOLS, max(1, requested // 2))
    return bars.filter(F.col("price_date") == F.lit(mark).cast("date")).agg(
        F.count_distinct("symbol").alias("mark_symbols")).withColumn("required", F.lit(needed).cast("long"))


def price_points(bars: DataFrame, mark: dt.date) -> DataFrame:
    """Per symbol: close on the mark date, last close before it, last close of the December before its year.

    One aggregate per symbol that merges map-side; later bars never leave the scan.
    """
    day = F.lit(mark).cast("date")
    date, close = F.col("price_date"), F.col("close")
    december = date.between(F.lit(dt.date(mark.year - 1, 12, 1)), F.lit(dt.date(mark.year - 1, 12, 31)))
    return (bars.filter(date <= day).groupBy(C.fold_ascii(F.col("symbol")).alias("fold")).agg(
        F.max(F.when(date == day, close)).alias("mark_close"),
        F.max_by(close, F.when(date < day, date)).alias("previous_close"),
        F.max_by(close, F.when(december, date)).alias("base_close"))
        .filter("mark_close is not null"))


def with_price_points(rows: DataFrame, bars: DataFrame, mark: dt.date) -> DataFrame:
    """Join the three closes to rows by ticker, ignoring ASCII case; a blank ticker is never priced."""
    keyed = rows.withColumn("fold", F.when(F.col("ticker") != "", C.fold_ascii(F.col("ticker"))))
    return keyed.join(price_points(bars, mark), "fold", "left").drop("fold")


def unpriced(rows: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("double")
    return (rows.withColumn("price", nothing).withColumn("price_date", F.lit(None).cast("date"))
            .withColumn("day_change", nothing).withColumn("ytd_change", nothing))


def price_columns(rows: DataFrame, mark: dt.date) -> DataFrame:
    """Turn the three closes into price, price date, and percent changes."""
    priced = F.col("mark_close").isNotNull()
    return (rows.withColumn("price", F.col("mark_close"))
            .withColumn("price_date", F.when(priced, F.lit(mark).cast("date")))
            .withColumn("day_change", C.percent_change(F.col("mark_close"), F.col("previous_close")))
            .withColumn("ytd_change", C.percent_change(F.col("mark_close"), F.col("base_close")))
            .drop("mark_close", "previous_close", "base_close"))


def with_prices(rows: DataFrame, bars: DataFrame, mark: dt.date | None) -> DataFrame:
    if mark is None:
        return unpriced(rows)
    return price_columns(with_price_points(rows, bars, mark), mark)
