"""Ranked views over the weight statistics: top holdings, fresh initiations, top movers, and the summary.

Each view builds one lazy DataFrame.  Eager steps are reading the two period dates it compares,
which lets partition pruning cut the statistics to those periods, writing a page that is to be priced, and finding a deep page (see ``paging``).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhold import fixed_values as fv
from tallyhold.functions import columns as C
from tallyhold.operators import prices
from tallyhold.operators.paging import page_of
from tallyhold.session import stage


@dataclass(frozen=True)
class ViewOptions:
    view: str = "holdings"
    horizon: int = 1
    side: str = "gainers"
    sort: str = "metric"
    direction: str = "desc"
    unmapped: str = "exclude"
    page: int = 1
    size: int = fv.DEFAULT_PAGE_SIZE


_CHOICES = {"view": fv.VIEWS, "side": fv.SIDES, "sort": fv.SORTS, "direction": fv.DIRECTIONS,
            "unmapped": fv.UNMAPPED_CHOICES}
_RANGES = {"horizon": (1, fv.MAX_HORIZON), "page": (1, fv.MAX_PAGE), "size": fv.PAGE_SIZE_RANGE}


def view_options(**given) -> ViewOptions:
    """Checked options.  Every value is validated even where the view ignores it."""
    unknown = sorted(set(given) - set(_CHOICES) - set(_RANGES))
    if unknown:
        raise ValueError(f"Unknown option: {', '.join(unknown)}")
    checked = {}
    for name, value in given.items():
        text = str(value).strip()
        if len(text) > fv.MAX_PARAMETER_LENGTH or any(ord(char) < 32 for char in text):
            raise ValueError(f"Invalid {name}")
        if name in _CHOICES:
            if text not in _CHOICES[name]:
                raise ValueError(f"Invalid {name}")
            checked[name] = text
            continue
        low, high = _RANGES[name]
        try:
            number = int(text)
        except ValueError:
            raise ValueError(f"Invalid {name}") from None
        if not low <= number <= high:
            raise ValueError(f"Invalid {name}")
        checked[name] = number
    options = ViewOptions(**checked)
    losers_first = options.view == "movers" and options.side == "losers"
    if "direction" not in checked and losers_first:
        options = replace(options, direction="asc")
    return options


@dataclass(frozen=True)
class RankedView:
    """A page of a ranked view with what it compares; ``matching`` is the whole filtered set, unsorted."""

    options: ViewOptions
    period: dt.date
    comparison_period: dt.date | None
    price_date: dt.date | None
    price_source: str
    rows: DataFrame
    matching: DataFrame

    @property
    def price_available(self) -> bool:
        return self.price_date is not None

    def count(self) -> int:
        return self.matching.count()


def compared_periods(periods: DataFrame, steps: int) -> tuple[dt.date, dt.date | None]:
    """Latest period and the one ``steps`` before it in the stored list (reads at most five dates)."""
    latest = [row[0] for row in periods.select("period").distinct().orderBy(F.desc("period")).limit(steps + 1).collect()]
    if not latest:
        raise ValueError("There are no reporting periods")
    return latest[0], (latest[steps] if len(latest) > steps else None)


def _side_by_side(weights: DataFrame, current, previous) -> DataFrame:
    """One row per security with its statistics in both periods; a missing side is NULL."""
    wanted = [day for day in (current, previous) if day is not None]
    two = weights.filter(F.col("period").isin(wanted))

    def at(day, name: str, alias: str) -> Column:
        picked = F.when(F.col("period") == F.lit(day), F.col(name)) if day is not None else F.lit(None)
        return F.max(picked.cast(dict(weights.dtypes)[name])).alias(alias)

    return two.groupBy("cusip").agg(
        at(current, "avg_weight", "weight"), at(current, "holder_count", "holders"),
        at(current, "new_holder_count", "new_holders"),
        at(previous, "avg_weight", "old_weight"), at(previous, "new_holder_count", "old_new_holders"))


def _direction(has_previous: bool, now: Column, then: Column) -> Column:
    if not has_previous:
        return F.lit("flat")
    then = F.coalesce(then, F.lit(0))
    return F.when(now > then, "up").when(now < then, "down").otherwise("flat")


def named(rows: DataFrame, securities: DataFrame, sectors: DataFrame) -> DataFrame:
    """Security attributes plus display name and sector; a blank ticker never finds a sector."""
    listed = sectors.select(
        C.fold_ascii(F.col("ticker")).alias("fold"), F.col("sector").alias("listed_sector"),
        F.col("name").alias("listed_name"))
    keyed = rows.join(securities.select("cusip", "ticker", "issuer"), "cusip").withColumn(
        "fold", F.when(F.col("ticker") != "", C.fold_ascii(F.col("ticker"))))
    return (keyed.join(listed, "fold", "left")
            .withColumn("name", F.coalesce(F.nullif(F.col("listed_name"), F.lit("")), F.col("issuer")))
            .withColumn("sector", F.coalesce("listed_sector", F.lit("")))
            .drop("fold", "listed_sector", "listed_name"))


def _ranked(options: ViewOptions, weights: DataFrame, current, previous) -> DataFrame:
    sides = _side_by_side(weights, current, previous)
    has_previous = previous is not None
    if options.view == "holdings":
        return sides.filter("weight is not null").select(
            "cusip", F.col("weight").alias("metric"), "holders",
            _direction(has_previous, F.col("weight"), F.col("old_weight")).alias("direction"),
            F.col("weight").alias("avg_weight"))
    if options.view == "initiations":
        return sides.filter("weight is not null and new_holders > 0").select(
            "cusip", F.col("new_holders").alias("metric"), "holders",
            _direction(has_previous, F.col("new_holders"), F.col("old_new_holders")).alias("direction"),
            F.col("weight").alias("avg_weight"))
    gaining = options.side == "gainers"
    change = F.coalesce("weight", F.lit(0.0)) - F.coalesce("old_weight", F.lit(0.0))
    moved = sides.select(
        "cusip", change.alias("metric"), F.coalesce("holders", F.lit(0)).alias("holders"),
        F.lit("up" if gaining else "down").alias("direction"), F.col("weight").alias("avg_weight"))
    if not has_previous:
        return moved.filter(F.lit(False))
    return moved.filter(F.col("metric") > 0 if gaining else F.col("metric") < 0)


def sort_order(options: ViewOptions, *, priced: bool) -> list[Column]:
    """Sort columns; text and price keys keep blanks and missing values last in both directions."""
    losers = options.view == "movers" and options.side == "losers"
    ties = {"holdings": [F.desc("holders"), F.asc("cusip")],
            "initiations": [F.desc("avg_weight"), F.asc("cusip")],
            "movers": [F.asc("cusip")]}[options.view]
    default = [F.asc("metric") if losers else F.desc("metric"), *ties]
    rising = options.direction == "asc"
    if options.sort == "metric":
        return [F.asc("metric") if rising else F.desc("metric"), *ties]
    if options.sort in fv.PRICE_SORTS:
        if not priced:
            return default
        close = F.col("mark_close")
        key = {"price": close,
               "day": F.when(F.col("previous_close") > 0, close / F.col("previous_close")),
               "ytd": F.when(F.col("base_close") > 0, close / F.col("base_close"))}[options.sort]
    else:
        key = C.fold_ascii(F.nullif(F.col(options.sort), F.lit("")))
    return [key.asc_nulls_last() if rising else key.desc_nulls_last(), *default]


_ROW = ["cusip", "ticker", "issuer", "name", "sector", "direction", "metric", "holders",
        "price", "price_date", "day_change", "ytd_change"]


def ranked_view(periods: DataFrame, weights: DataFrame, securities: DataFrame, sectors: DataFrame,
                bars: DataFrame | None = None, *, stated_mark: str = "", price_source: str = "",
                **given) -> RankedView:
    """Answer one ranked question.  Prices join the whole set only when they decide the order; otherwise
    they join the one page that is returned."""
    options = view_options(**given)
    steps = options.horizon if options.view == "movers" else 1
    current, previous = compared_periods(periods, steps)
    mark = prices.mark_date(bars, stated_mark) if bars is not None else None
    matching = named(_ranked(options, weights, current, previous), securities, sectors)
    if options.unmapped == "exclude":
        matching = matching.filter(F.col("ticker") != "")
    by_price = options.sort in fv.PRICE_SORTS and mark is not None
    sortable = prices.with_price_points(matching, bars, mark) if by_price else matching
    order = sort_order(options, priced=by_price)
    page = page_of(sortable, order, (options.page - 1) * options.size, options.size).rows
    if by_price:
        rows = prices.price_columns(page, mark)
    elif mark is not None:
        # The page is found once.  At most 200 rows ask for prices, so their symbols are a bounded broadcast into the bars.
        page = stage(page, "page")
        symbols = F.broadcast(page.select(C.fold_ascii(F.col("ticker")).alias("fold")).distinct())
        asked = bars.withColumn("fold", C.fold_ascii(F.col("symbol"))).join(symbols, "fold", "left_semi")
        rows = prices.with_prices(page, asked.select("symbol", "price_date", "close"), mark)
        rows = rows.orderBy(*order)
    else:
        rows = prices.unpriced(page)
    metric = F.col("metric") if options.view == "initiations" else F.round("metric", 4)
    rows = rows.withColumn("metric", metric).select(*_ROW)
    return RankedView(options, current, previous, mark, price_source if mark else "", rows, matching)


def top_holdings(*tables, **options) -> RankedView:
    return ranked_view(*tables, view="holdings", **options)


def fresh_initiations(*tables, **options) -> RankedView:
    return ranked_view(*tables, view="initiations", **options)


def top_movers(*tables, **options) -> RankedView:
    return ranked_view(*tables, view="movers", **options)


def snapshot_summary(period_stats: DataFrame) -> DataFrame:
    """One row: the latest period, how many there are, and the latest totals."""
    return period_stats.agg(
        F.count("*").alias("period_count"), F.max("period").alias("latest_period"),
        F.max_by("position_count", "period").alias("holding_count"),
        F.max_by("total_value", "period").alias("total_value"),
        F.max_by("position_manager_count", "period").alias("distinct_managers"),
        F.max_by("security_count", "period").alias("distinct_issuers"))


def snapshot_facts(metadata: DataFrame, period_stats: DataFrame) -> DataFrame:
    """Metadata rows plus the summary as ``key, value`` text; the summary wins where both name a key."""
    summary = snapshot_summary(period_stats)
    wide = summary.select([F.col(name).cast("string").alias(name) for name in summary.columns])
    rows = wide.unpivot([], wide.columns, "key", "value")
    return metadata.join(rows, "key", "left_anti").unionByName(rows)
