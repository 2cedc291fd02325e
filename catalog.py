"""Registered queries: name -> callable(spark, folder) -> DataFrame over the given tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhold import fixed_values as fv
from tallyhold.functions import columns as C
from tallyhold.functions import report
from tallyhold.operators import (asof, exact_sum, filings, median, paging, positions, prices, quality, reference, resolve,
                                 rollups, signals, views)
from tallyhold.plans.book import Book, warehouse_book
from tallyhold.plans import market, snapshot
from tallyhold.plans.snapshot import book_tables as tables_of_book
from tallyhold.session import configure, passing, remove, stage, staging_root
from tallyhold.sources import archives, exports, fingerprints, landed
from tallyhold.sources.archives import stored_bytes
from tallyhold.sources.warehouse import MARK_DATE, Warehouse, security_number

Query = Callable[[SparkSession, str], DataFrame]
MARK = dt.date.fromisoformat(MARK_DATE)
QUERIES: dict[str, Query] = {}


def shared(make):
    """Build once per session and folder, so queries share staged tables; a new session builds its own."""
    made: dict[tuple[str, str], object] = {}

    @wraps(make)
    def once(spark: SparkSession, folder: str):
        configure(spark)
        key = (spark.sparkContext.applicationId, folder)
        if key not in made:
            made[key] = make(spark, folder)
        return made[key]
    return once


@shared
def book(spark: SparkSession, folder: str) -> Book:
    configure(spark, stored_bytes(f"{folder}/lineitem.parquet", f"{folder}/orders.parquet"))
    return warehouse_book(Warehouse(spark, folder))


@shared
def bars(spark: SparkSession, folder: str) -> DataFrame:
    return stage(Warehouse(spark, folder).bars, "bars")


@shared
def signal_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    b = book(spark, folder)
    return signals.signal_tables(b.wide_positions, b.context, b.manager_period_stats,
                                 Warehouse(spark, folder).trusted, bars(spark, folder), MARK)


def plain(df: DataFrame, *, digits: int = 6) -> DataFrame:
    """Dates as ISO text and doubles rounded, so that two engines compare equal."""
    def shown(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, T.DoubleType):
            c = F.round(c, digits)
        return c.alias(field.name)
    return df.select([shown(field) for field in df.schema])


def query(make: Callable[[SparkSession, str], DataFrame]) -> Query:
    """Register a query; it runs with the library's session settings."""
    @wraps(make)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return make(configure(spark), folder)

    QUERIES[make.__name__] = run
    return run


# ---- filings ----------------------------------------------------------------------------------

@query
def primary_periods(spark, folder):
    return filings.primary_periods(Warehouse(spark, folder).submissions)


@query
def period_dimension(spark, folder):
    return plain(book(spark, folder).periods)


@query
def cover_last_row(spark, folder):
    return filings.last_row_per_accession(Warehouse(spark, folder).covers).select(
        "archive", "accession_number", "row_no", "amendmenttype", "amendmentno", "reporttype")


@query
def filing_part_types(spark, folder):
    return plain(book(spark, folder).events.select(
        "accession", "cik", "period", "filing_date", "submission_type", "part_type",
        F.coalesce("amendment_no", F.lit(0)).alias("amendment_no")))


@query
def effective_parts(spark, folder):
    return plain(book(spark, folder).part_stats.select("cik", "period", "accession", "part_type"))


@query
def manager_coverage(spark, folder):
    return plain(book(spark, folder).quarters.select(
        "cik", "period", "accession", "filing_date", "filing_label", "source_archive", "report_type",
        "coverage_status", "confidential_omitted", "part_count"))


@query
def reconciliation(spark, folder):
    return plain(book(spark, folder).part_stats.drop("part_type", "source_archive"))


@query
def coverage_downgrades(spark, folder):
    return plain(book(spark, folder).quarters.groupBy("period").agg(
        F.count_if("downgraded").alias("downgrades"), F.count("*").alias("manager_periods")))


@query
def comparable_managers(spark, folder):
    return plain(book(spark, folder).context.filter("from_previous").select("cik", "period", "previous_period"))


@query
def manager_dimension(spark, folder):
    return book(spark, folder).managers


@query
def security_dimension(spark, folder):
    return book(spark, folder).securities


# ---- positions and rollups --------------------------------------------------------------------

@query
def typed_holdings_rows(spark, folder):
    return plain(positions.typed_lines(Warehouse(spark, folder).raw_lines).select(
        "row_no", "accession", "cusip", "position_type", "shares_type", "value", "shares"))


@query
def positions_merged(spark, folder):
    return plain(book(spark, folder).positions)


@query
def manager_period_stats(spark, folder):
    return plain(book(spark, folder).manager_period_stats)


@query
def security_period_stats(spark, folder):
    return plain(book(spark, folder).security_period_stats)


@query
def period_stats(spark, folder):
    return plain(book(spark, folder).period_stats)


@query
def stock_changes(spark, folder):
    return plain(book(spark, folder).stock_changes)


@query
def period_change_totals(spark, folder):
    return plain(book(spark, folder).period_change_totals)


@query
def weight_universe(spark, folder):
    return plain(book(spark, folder).dashboard_period_stats)


@query
def security_weights(spark, folder):
    return plain(book(spark, folder).weights.select("period", "cusip", "holder_count", "weight_sum", "avg_weight"))


@query
def exact_value_sums(spark, folder):
    """Market value per security, added up exactly and rounded once."""
    rows = Warehouse(spark, folder).table("lineitem").select(security_number(F.col("l_partkey")).alias("n"), "l_extendedprice")
    return exact_sum.exact_sums(rows, ["n"], {"total": F.col("l_extendedprice")}, {"rows": F.count("*")})


@query
def new_holders(spark, folder):
    return plain(book(spark, folder).weights.select("period", "cusip", "new_holder_count").filter("new_holder_count > 0"))


@query
def snapshot_summary(spark, folder):
    return plain(views.snapshot_summary(book(spark, folder).period_stats))


@query
def period_neighbours(spark, folder):
    return plain(filings.link_periods(book(spark, folder).periods))


# ---- ranked views -----------------------------------------------------------------------------

def view(spark: SparkSession, folder: str, **options) -> DataFrame:
    b, warehouse = book(spark, folder), Warehouse(spark, folder)
    ranked = views.ranked_view(b.periods, b.weights, b.securities, warehouse.sectors, bars(spark, folder),
                               stated_mark=MARK_DATE, price_source="warehouse", **options)
    return plain(ranked.rows)


VIEW_QUERIES = {
    "top_holdings": {"view": "holdings"},
    "top_holdings_unmapped": {"view": "holdings", "unmapped": "include", "size": 200},
    "top_holdings_by_ticker_page2": {"view": "holdings", "sort": "ticker", "direction": "asc", "page": 2, "size": 20},
    "top_holdings_by_name": {"view": "holdings", "sort": "name", "direction": "desc", "size": 200},
    "top_holdings_by_sector": {"view": "holdings", "sort": "sector", "direction": "asc", "size": 200},
    "top_holdings_by_price": {"view": "holdings", "sort": "price", "direction": "desc", "size": 20},
    "top_holdings_by_day": {"view": "holdings", "sort": "day", "direction": "asc", "size": 20},
    "price_sort_ytd": {"view": "holdings", "sort": "ytd", "direction": "desc", "size": 20},
    "top_holdings_lowest": {"view": "holdings", "direction": "asc", "size": 10},
    "fresh_initiations": {"view": "initiations"},
    "movers_gainers_h1": {"view": "movers"},
    "movers_losers_h2": {"view": "movers", "horizon": 2, "side": "losers"},
    "movers_gainers_h4_by_price": {"view": "movers", "horizon": 4, "sort": "price", "direction": "asc"},
    "movers_losers_h3_unmapped": {"view": "movers", "horizon": 3, "side": "losers", "unmapped": "include"},
}
for _name, _options in VIEW_QUERIES.items():
    QUERIES[_name] = lambda spark, folder, _options=_options: view(spark, folder, **_options)


@query
def view_match_counts(spark, folder):
    """How many rows each view matches before paging."""
    b, sectors = book(spark, folder), Warehouse(spark, folder).sectors
    frames = []
    for name, options in (("holdings", {"view": "holdings"}), ("initiations", {"view": "initiations"}),
                          ("gainers", {"view": "movers"}), ("losers", {"view": "movers", "side": "losers"})):
        found = views.ranked_view(b.periods, b.weights, b.securities, sectors, **options).matching
        frames.append(found.agg(F.count("*").alias("matches")).withColumn("view_name", F.lit(name)))
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


@query
def positions_deep_page(spark, folder):
    """The 200 positions behind the three quarters of all that are worth most, with their rank."""
    held = book(spark, folder).positions.withColumn("shares", F.coalesce("shares", F.lit(0.0)))
    start = held.count() * 3 // 4
    order = [F.desc("value"), *[F.asc(c) for c in positions.POSITION_KEY]]
    found = paging.page_of(held, order, start, 200, shallow=2000).rows
    place = F.row_number().over(Window.orderBy(*order))  # of the page alone
    return plain(found.select((place + start).cast("long").alias("place"), *positions.POSITION_KEY, "value", "shares"))


@query
def report_rows(spark, folder):
    b, warehouse = book(spark, folder), Warehouse(spark, folder)
    rows = views.ranked_view(b.periods, b.weights, b.securities, warehouse.sectors, bars(spark, folder),
                             stated_mark=MARK_DATE, unmapped="include", size=200).rows
    return report.report_rows("holdings", rows)


@query
def weight_texts(spark, folder):
    """Formatted weights and weight changes of every security and period."""
    w = book(spark, folder).weights
    return plain(w.select(
        "period", "cusip", report.weight_text(F.round("avg_weight", 4)).alias("weight_text"),
        report.weight_change_text(F.round("avg_weight", 4) - 2, F.lit("")).alias("change_text"),
        report.new_holder_text(F.col("new_holder_count")).alias("new_text")))


# ---- prices -----------------------------------------------------------------------------------

@query
def weekly_bars(spark, folder):
    return plain(bars(spark, folder))


@query
def price_mark_fields(spark, folder):
    rows = Warehouse(spark, folder).tickers
    return plain(prices.with_prices(rows, bars(spark, folder), MARK))


@query
def exact_close(spark, folder):
    return plain(asof.exact_close(bars(spark, folder), MARK))


def _order_lookups(spark, folder) -> DataFrame:
    t = Warehouse(spark, folder)
    return t.table("orders").select(
        F.concat(F.lit("T"), F.floor(F.col("o_custkey") / 25).cast("string")).alias("symbol"),
        F.to_date("o_orderdate").alias("date")).distinct()


@query
def asof_on_or_before(spark, folder):
    found = asof.asof_prices(_order_lookups(spark, folder), bars(spark, folder))
    return plain(found.select("symbol", "date", "before_date", "before_close").filter("before_close is not null"))


@query
def asof_first_after(spark, folder):
    found = asof.asof_prices(_order_lookups(spark, folder), bars(spark, folder))
    return plain(found.select("symbol", "date", "after_date", "after_close").filter("after_close is not null"))


def _corrections(old: DataFrame) -> DataFrame:
    """Lower-case corrections of some bars and new later bars."""
    number = F.substring("symbol", 2, 9).cast("int")
    return old.filter(number % 3 == 0).select(
        F.lower("symbol").alias("symbol"),
        F.when(number % 2 == 0, F.col("price_date")).otherwise(F.date_add("price_date", 3000)).alias("price_date"),
        (F.col("close") + 1.0).alias("close"))


@query
def bars_upsert(spark, folder):
    """Corrections laid over the stored bars, all of which are written again."""
    old = bars(spark, folder)
    return plain(prices.merge_bars(old, _corrections(old)))


@query
def bars_file_upsert(spark, folder):
    """The same, and two more upserts of a few months each, as versions of a price table that share their files."""
    old, root = bars(spark, folder), f"{staging_root(spark)}/price-table-{uuid.uuid4().hex[:8]}"
    fresh, of_year = _corrections(old), F.year("price_date") == 1997
    prices.write_bars(None, old.filter(~of_year), f"{root}/1")
    prices.write_bars(f"{root}/1", old.filter(of_year), f"{root}/2")
    prices.write_bars(f"{root}/2", fresh.filter(of_year), f"{root}/3")
    prices.write_bars(f"{root}/3", fresh.filter(~of_year), f"{root}/4")
    return plain(prices.load_bars(spark, f"{root}/4")[0])


@query
def price_history_rows(spark, folder):
    """Quarterly quote payloads of all bars, several per symbol, written as JSON and parsed back, with dirty rows added."""
    old = bars(spark, folder)
    payload = old.groupBy("symbol", F.year("price_date"), F.quarter("price_date")).agg(F.collect_list(F.struct(
                              F.date_format("price_date", "MM/dd/yyyy").alias("date"),
                              F.concat(F.lit("$"), F.format_number("close", 2)).alias("close"))).alias("rows"))
    dirty = F.array(F.struct(F.lit("bad").alias("date"), F.lit("$1.00").alias("close")),
                    F.struct(F.lit("01/05/1998").alias("date"), F.lit("N/A").alias("close")))
    rows = payload.select("symbol", F.struct(
        F.struct(F.lit(200).alias("rCode")).alias("status"),
        F.struct(F.struct(F.concat("rows", dirty).alias("rows")).alias("tradesTable")).alias("data")).alias("doc"))
    good = rows.select("symbol", F.lit("etf").alias("asset_class"), F.to_json("doc").alias("payload"))
    failed = rows.select("symbol", F.lit("stocks").alias("asset_class"),
                         F.lit('{"status":{"rCode":400},"data":null}').alias("payload"))
    return plain(prices.parse_history(failed.unionByName(good), "1990-01-01", "2010-12-31"), digits=2)


# ---- signals ----------------------------------------------------------------------------------

@query
def price_targets(spark, folder):
    b = book(spark, folder)
    return signals.price_targets(b.positions, b.securities, Warehouse(spark, folder).trusted)


@query
def split_factors(spark, folder):
    return plain(signal_tables(spark, folder)["split_factors"].filter("factor is not null"))


@query
def scope_values(spark, folder):
    return plain(signal_tables(spark, folder)["scope_values"])


@query
def fund_scores(spark, folder):
    return plain(signal_tables(spark, folder)["fund_scores"], digits=8)


@query
def event_counts_by_security(spark, folder):
    events = signal_tables(spark, folder)["priced_events"]
    return plain(events.groupBy("cusip").agg(
        F.count("*").alias("candidates"), F.count_if("is_eligible").alias("eligible"),
        F.count("gross").alias("priced"), F.count_if(F.col("pnl") > 0).alias("hits")))


@query
def nearest_split_factor(spark, folder):
    """Factor of every line's unit price over the part's list price."""
    t = Warehouse(spark, folder)
    ratio = F.col("l_extendedprice") / F.col("l_quantity") / F.col("p_retailprice")
    rows = t.table("lineitem").join(t.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.round(C.nearest_split_factor(ratio), 6).alias("factor")).groupBy("factor").agg(
        F.count("*").alias("lines"))


@query
def unit_price_medians(spark, folder):
    """Exact median unit price per security, through the path for groups of any size."""
    t = Warehouse(spark, folder)
    rows = t.table("lineitem").select(
        security_number(F.col("l_partkey")).alias("n"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    middle = median.middle_values(rows, ["n"], "price")
    return plain(middle.select("n", "rows", median.median(F.col("low"), F.col("high")).alias("median_price")))


# ---- text and reference data ------------------------------------------------------------------

@query
def issuer_keys(spark, folder):
    """Name keys of whole document texts: accents dropped, ampersands spelled out, punctuation to blanks."""
    text = Warehouse(spark, folder).table("documents").select("doc_id", C.issuer_key(F.col("text")).alias("name_key"))
    return text.select("doc_id", F.md5("name_key").alias("key_hash"), F.length("name_key").cast("long").alias("key_length"))


@query
def collapsed_texts(spark, folder):
    text = Warehouse(spark, folder).table("documents").select("doc_id", C.collapse_spaces(F.col("text")).alias("t"))
    return text.select("doc_id", F.md5("t").alias("text_hash"), F.length("t").cast("long").alias("text_length"))


@query
def ticker_keys(spark, folder):
    raw = F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("   "), F.col("c_name"), F.lit(" "))
    raw = F.when(F.col("c_custkey") % 4 == 0, raw).when(
        F.col("c_custkey") % 4 == 1, F.concat(F.lit("\t"), F.substring("c_name", 10, 9))).when(
        F.col("c_custkey") % 4 == 2, F.concat(F.substring("c_name", 1, 3), F.lit("\x01x"))).otherwise(
        F.concat(F.col("c_name"), F.lit(" of a much longer name")))
    return Warehouse(spark, folder).table("customer").select("c_custkey", C.ticker_key(raw).alias("ticker"))


@query
def display_names(spark, folder):
    endings = ["", " Common Stock", " Class A Common Stock", " American Depositary Shares (each representing two (2) Shares)",
               " Preferred Stock Units", " units ", " Warrants Rights", " (Representing 1/10th)"]
    tail = F.element_at(F.array(*[F.lit(e) for e in endings]), (F.col("p_partkey") % len(endings) + 1).cast("int"))
    return Warehouse(spark, folder).table("part").select(
        "p_partkey", C.display_name(F.concat(F.lit(" "), F.col("p_name"), F.lit("  inc."), tail)).alias("display_name"))


@query
def tidy_names(spark, folder):
    """Report names of suppliers and parts written in capitals."""
    raw = F.concat(F.upper("p_name"), F.lit(" & "), F.upper("p_brand"), F.when(F.col("p_size") % 2 == 0, " INC.")
                   .otherwise(" HLDGS (USA) O'NEIL-CO"))
    raw = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(raw)
    return Warehouse(spark, folder).table("part").select(
        "p_partkey", report.tidy_name(F.lit(""), raw).alias("tidy_name"))


@query
def change_texts(spark, folder):
    t = Warehouse(spark, folder).table("lineitem")
    change = F.col("l_discount") * 100 - 5 + F.col("l_linenumber") / 16.0
    return t.select(report.change_text(change).alias("change_text"),
                    report.price_text(F.round(F.col("l_extendedprice") / 8, 3)).alias("price_text")).groupBy(
        "change_text", "price_text").agg(F.count("*").alias("lines"))


@query
def parsed_closes(spark, folder):
    t = Warehouse(spark, folder).table("lineitem")
    text = F.when(F.col("l_linenumber") == 7, "N/A").when(F.col("l_linenumber") == 6, "$0.00").otherwise(
        F.concat(F.lit(" $"), F.format_number("l_extendedprice", 2)))
    return t.select("l_orderkey", "l_linenumber", C.closing_price(text).alias("close")).filter(
        "close is not null").groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("lines"), F.round(F.max("close"), 2).alias("max_close"))


@query
def completed_market_dates(spark, folder):
    return plain(Warehouse(spark, folder).table("events").select(
        "event_id", C.completed_market_date(F.col("ts").cast("timestamp")).alias("market_date")))


def _stock_rows(spark, folder) -> DataFrame:
    return Warehouse(spark, folder).table("part").select(
        F.col("p_partkey").alias("row_no"),
        F.when(F.col("p_partkey") % 31 == 0, " ").otherwise(F.concat(
            F.lit(" s"), (F.col("p_partkey") % 1500).cast("string"))).alias("symbol"),
        F.concat(F.col("p_name"), F.lit("  Co Common Stock")).alias("name"),
        F.concat(F.lit(" "), F.col("p_type")).alias("sector"),
        F.when(F.col("p_partkey") % 17 == 0, "N/A").otherwise(
            F.format_number(F.col("p_retailprice") * 1000 + 0.5, 1)).alias("marketCap"))


def _etf_rows(spark, folder) -> DataFrame:
    return Warehouse(spark, folder).table("supplier").select(
        F.col("s_suppkey").alias("row_no"),
        F.concat(F.when(F.col("s_suppkey") % 2 == 0, "S").otherwise("E"), F.col("s_suppkey").cast("string")).alias("symbol"),
        F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.col("s_name"), F.lit("  Fund  Units")))
        .alias("companyName"), F.col("s_name").alias("name"))


@query
def market_cap_snapshot(spark, folder):
    return reference.market_caps(_stock_rows(spark, folder))


@query
def sector_merge(spark, folder):
    return reference.sector_map(_stock_rows(spark, folder), _etf_rows(spark, folder))


@query
def sector_values(spark, folder):
    return reference.sector_values(reference.sector_map(_stock_rows(spark, folder), _etf_rows(spark, folder)))


@query
def screener_documents(spark, folder):
    """One screener payload per part, in all nestings, parsed back to rows."""
    stock = _stock_rows(spark, folder)
    rows = F.to_json(F.array(F.struct("symbol", "name", "sector", "marketCap")))
    shapes = ('{"data":{"rows":%s}}', '{"data":{"data":{"rows":%s}}}', '{"data":{"records":{"data":{"rows":%s}}}}',
              '{"data":{"rows":[]},"rows":%s}')
    form = F.element_at(F.array(*[F.lit(shape) for shape in shapes]), (F.col("row_no") % 4 + 1).cast("int"))
    documents = stock.select(F.replace(form, F.lit("%s"), rows).alias("document"))
    return landed.screener_rows(documents).select(C.screener_symbol(F.col("symbol")).alias("symbol"), "name").groupBy(
        "symbol", "name").agg(F.count("*").alias("documents"))


@query
def identity_documents(spark, folder):
    """One company-ticker document per supplier, in all three shapes, parsed back to identities."""
    s = Warehouse(spark, folder).table("supplier")
    key, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    table = F.concat(F.lit('{"fields":["CIK","Name","exchange","Ticker"],"data":[['), key, F.lit(',"'), name,
                     F.lit('","X","t'), key, F.lit('"],["short"]]}'))
    listed = F.concat(F.lit('[{"cik":'), key, F.lit(',"name":"'), name, F.lit('","ticker":"t'), key, F.lit('"},null]'))
    keyed = F.concat(F.lit('{"0":{"cik_str":'), key, F.lit(',"title":"'), name, F.lit('","ticker":"t'), key, F.lit('"}}'))
    documents = s.select(F.when(F.col("s_suppkey") % 3 == 0, table).when(F.col("s_suppkey") % 3 == 1, listed)
                         .otherwise(keyed).alias("document"))
    return landed.identity_rows(documents).select("cik", "name", "ticker")


# ---- identifier resolution --------------------------------------------------------------------

def _identities(spark, folder) -> DataFrame:
    """Company identities: part names repeat on purpose, customer names do not."""
    w = Warehouse(spark, folder)
    shared = w.table("part").select(
        F.col("p_partkey").alias("row_no"), (F.col("p_partkey") % 64).cast("string").alias("cik"),
        F.col("p_name").alias("name"), F.concat(F.lit("p"), (F.col("p_partkey") % 64).cast("string")).alias("ticker"))
    own = w.table("customer").select(
        (F.col("c_custkey") + 10_000_000_000).alias("row_no"),
        F.lpad((F.col("c_custkey") * 7).cast("string"), 10, "0").alias("cik"),
        F.when(F.col("c_custkey") % 10 == 0, F.concat(F.upper("c_name"), F.lit(" & Co.")))
        .otherwise(F.concat(F.col("c_name"), F.lit(", INC"))).alias("name"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("ticker"))
    again = own.filter("row_no % 11 = 0").select(
        (F.col("row_no") + 10_000_000_000).alias("row_no"), "cik", F.upper("name").alias("name"),
        F.concat("ticker", F.lit("/w")).alias("ticker"))
    return shared.unionByName(own).unionByName(again)


@shared
def listed_securities(spark, folder) -> DataFrame:
    """Securities to resolve: one per order customer, named like a customer."""
    w = Warehouse(spark, folder)
    held = w.table("orders").groupBy("o_custkey").agg(
        F.sum(F.floor("o_totalprice").cast("long")).alias("latest_value"), F.count("*").alias("latest_funds"))
    key = F.col("c_custkey")
    listed = w.table("customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.when(key % 23 == 0, F.concat(F.lit("bad"), key.cast("string")))
        .otherwise(F.concat(F.lit("x"), F.lpad(key.cast("string"), 8, "0"))).alias("cusip"),
        F.when(key % 9 == 4, F.lit("Shared Name Trust")).when(key % 10 == 0, F.concat("c_name", F.lit(" and co")))
        .otherwise(F.concat(F.upper("c_name"), F.lit(" Inc."))).alias("issuer"),
        F.col("c_mktsegment").alias("class"),
        F.when(key % 3 == 0, F.concat(F.lit("figi"), key.cast("string"))).otherwise("").alias("figi"),
        F.when(key % 6 == 1, F.concat(F.lit(" c"), key.cast("string"))).otherwise("").alias("ticker"),
        "latest_value", F.coalesce("latest_funds", F.lit(0)).alias("latest_funds"), key.alias("key"))
    return stage(resolve.normalised_securities(listed), "listed")


@shared
def _records(spark, folder) -> DataFrame:
    """Cached records for half of the securities, in every status."""
    key = F.col("key")
    statuses = ["unqueried", "resolved", "not_found", "ambiguous", "error"]
    status = F.element_at(F.array(*[F.lit(s) for s in statuses]), (key % 5 + 1).cast("int"))
    source = (F.when(key % 5 == 1, fv.EXACT_SOURCE).when(key % 8 == 0, fv.NAME_SOURCE)
              .when(key % 8 == 2, fv.LEGACY_SOURCE))
    rows = listed_securities(spark, folder).filter(key % 2 == 0).select(
        "cusip", F.when(source.isNotNull(), F.concat(F.lit("c"), key.cast("string"))).alias("ticker"),
        source.alias("source"), status.alias("openfigi_status"), "issuer",
        F.when(key % 5 > 0, F.when(key % 7 == 0, "UN").otherwise("US")).alias("openfigi_exchange"),
        F.when(key % 5 > 0, "2025-01-01").alias("checked_at"),
        *[F.lit(None).cast(t).alias(n) for n, t in (
            ("class", "string"), ("figi", "string"), ("openfigi_message", "string"), ("result_count", "bigint"),
            ("considered_count", "bigint"), ("candidate_tickers", "array<string>"), ("returned_figis", "array<string>"),
            ("matched_figis", "array<string>"), ("sec_cik", "string"), ("sec_name", "string"),
            ("sec_matched_at", "string"), ("last_error", "string"), ("last_attempt_at", "string"))])
    return stage(resolve.canonical_records(rows), "records")


def _overrides(spark, folder) -> DataFrame:
    key = F.col("key")
    rows = listed_securities(spark, folder).filter((key % 50 == 7) & (key % 23 != 0)).select(
        "cusip", F.concat(F.lit("m"), key.cast("string")).alias("ticker"), F.lit(None).cast("string").alias("source"))
    return resolve.canonical_overrides(rows)


def _results(spark, folder) -> DataFrame:
    """Landed lookup answers of every shape for two thirds of the securities."""
    key = F.col("key")
    row = lambda ticker, figi: F.struct(ticker.alias("ticker"), figi.alias("figi"))
    own = row(F.concat(F.lit(" c"), key.cast("string")), F.concat(F.lit("figi"), key.cast("string")))
    other = row(F.concat(F.lit("z"), key.cast("string")), F.lit("figi-other"))
    blank = row(F.lit(""), F.concat(F.lit("FIGI"), key.cast("string")))
    data = (F.when(key % 8 == 0, F.array(own, own)).when(key % 8 == 1, F.array(own, other))
            .when(key % 8 == 2, F.array(other)).when(key % 8 == 3, F.array(blank))
            .when(key % 8 == 4, F.array().cast("array<struct<ticker:string,figi:string>>")))
    error = F.when(key % 8 == 5, "No identifier found.").when(key % 8 == 6, "Bad request")
    return listed_securities(spark, folder).filter(key % 3 != 1).select("cusip", error.alias("error"), data.alias("data"))


@query
def safe_name_index(spark, folder):
    return resolve.safe_name_index(_identities(spark, folder))


@query
def name_matches(spark, folder):
    found = resolve.name_matches(listed_securities(spark, folder), resolve.safe_name_index(_identities(spark, folder)))
    return found.select("cusip", "name_key", "name_ticker", "name_cik", "name")


@query
def exact_resolution(spark, folder):
    found = resolve.resolve_results(listed_securities(spark, folder), _results(spark, folder),
                                    exchange="US", checked_at="2025-06-30")
    return found.select(
        "cusip", "ticker", "source", "openfigi_status", "openfigi_message",
        F.coalesce("result_count", F.lit(-1)).alias("result_count"),
        F.coalesce("considered_count", F.lit(-1)).alias("considered_count"),
        F.array_join("candidate_tickers", ",").alias("candidate_tickers"),
        F.array_join("returned_figis", ",").alias("returned_figis"),
        F.array_join("matched_figis", ",").alias("matched_figis"))


@query
def seed_actions(spark, folder):
    return resolve.seed_actions(listed_securities(spark, folder), _records(spark, folder), _overrides(spark, folder))


@shared
def _merged_records(spark, folder) -> DataFrame:
    """One enrichment round: seeds, lookup answers, and name matches."""
    listed, records, overrides = (listed_securities(spark, folder), _records(spark, folder), _overrides(spark, folder))
    seeded = resolve.apply_seeds(records, resolve.seed_actions(listed, records, overrides))
    fresh = resolve.resolve_results(listed, _results(spark, folder), exchange="US", checked_at="2025-06-30")
    merged = resolve.merge_records(seeded, fresh)
    matches = resolve.name_matches(listed, resolve.safe_name_index(_identities(spark, folder)))
    return stage(resolve.supplement_by_name(merged, matches, matched_at="2025-06-30"), "enriched")


@query
def merged_records(spark, folder):
    return _merged_records(spark, folder).select("cusip", "ticker", "source", "openfigi_status", "sec_cik")


@query
def ticker_mapping(spark, folder):
    return resolve.final_mapping(_merged_records(spark, folder), _overrides(spark, folder))


@query
def cache_statistics(spark, folder):
    return resolve.cache_statistics(_merged_records(spark, folder), _overrides(spark, folder))


@query
def fill_only_mapping(spark, folder):
    return resolve.fill_actions(listed_securities(spark, folder),
                                resolve.final_mapping(_merged_records(spark, folder), _overrides(spark, folder)))


@query
def filled_securities(spark, folder):
    filled = resolve.fill_tickers(listed_securities(spark, folder),
                                  resolve.final_mapping(_merged_records(spark, folder), _overrides(spark, folder)))
    return filled.select("cusip", "ticker")


@query
def lookup_topk(spark, folder):
    """The fifty most valuable securities that still need an exact lookup."""
    found = resolve.lookup_candidates(listed_securities(spark, folder), _records(spark, folder), limit=50, exchange="US")
    return found.select("cusip", F.coalesce("latest_value", F.lit(0)).alias("latest_value"), "latest_funds")


@query
def security_relevance(spark, folder):
    b = book(spark, folder)
    latest = views.compared_periods(b.periods, 0)[0]
    found = rollups.security_relevance(b.securities, b.security_period_stats, latest)
    return found.select("cusip", F.coalesce("latest_value", F.lit(0)).alias("latest_value"),
                        F.coalesce("latest_funds", F.lit(0)).alias("latest_funds"))


@query
def identity_rule(spark, folder):
    return resolve.identity_rule(_identities(spark, folder))


# ---- quality ----------------------------------------------------------------------------------

@shared
def book_tables(spark, folder) -> dict[str, DataFrame]:
    """Written snapshot tables of the warehouse book."""
    caps = reference.market_caps(_stock_rows(spark, folder))
    made = tables_of_book(book(spark, folder), caps, Warehouse(spark, folder).sectors)
    # The book stages what it shares; the rest is written here, as the snapshot job writes it.
    for name in ("managers", "market_caps", "sectors", "period_stats", "stock_changes", "period_change_totals"):
        made[name] = stage(made[name], name)
    return made


@shared
def signal_job(spark, folder) -> dict[str, DataFrame]:
    """What the signal job writes from the written snapshot tables."""
    return market.build_signals(spark, book_tables(spark, folder), Warehouse(spark, folder).trusted, bars(spark, folder), MARK,
                                f"{staging_root(spark)}/signals-{uuid.uuid4().hex[:8]}")


@query
def fund_scores_job(spark, folder):
    return plain(signal_job(spark, folder)["fund_scores"], digits=8)


@query
def signal_metadata_counts(spark, folder):
    """The counts among the job's metadata."""
    return signal_job(spark, folder)["signal_metadata"].filter(F.col("key").endswith("_count"))


# ---- archives and the snapshot job ------------------------------------------------------------

@shared
def archive_folder(spark, folder) -> str:
    """All filings, written as zipped archives."""
    path = f"{staging_root(spark)}/archives-{uuid.uuid4().hex[:8]}"
    with passing(spark):
        archives.write_archives(Warehouse(spark, folder).members, path)
    return path


@query
def archive_holdings(spark, folder):
    """Holdings rows of all archives, read back from their zipped members."""
    rows = positions.typed_lines(archives.read_member(spark, archive_folder(spark, folder), "INFOTABLE"))
    return plain(rows.drop("row_no"))


@query
def archive_inputs(spark, folder):
    """Archives as the job finds them: rows of each member, and whether their hashes stay."""
    path = archive_folder(spark, folder)
    counted = [df.groupBy("archive").agg(F.count("*").alias("rows")).withColumn("member", F.lit(member).cast("string"))
               for member, df in archives.read_archives(spark, path).items()]
    whole = counted[0]
    for other in counted[1:]:
        whole = whole.unionByName(other)
    hashed = stage(fingerprints.fingerprints(spark, path, {}), "hashes")
    moved = fingerprints.changed_inputs(hashed, fingerprints.fingerprints(spark, path, {})).count()
    known = hashed.select(F.col("name").alias("archive"), (F.length("sha256") == 64).alias("hashed"))
    return whole.join(known, "archive", "left").withColumn("moved", F.lit(moved).cast("long"))


@shared
def snapshots(spark, folder) -> dict[str, DataFrame]:
    """Tables of a snapshot that was built without some of the archives, and then incrementally with all of them."""
    root, every = f"{staging_root(spark)}/snapshots-{uuid.uuid4().hex[:8]}", archive_folder(spark, folder)
    members = Warehouse(spark, folder).members
    fewer = f"{root}/fewer"
    # Before: no archive of 1996, and half of the filings in those of 1998.
    kept = ~F.col("archive").startswith("1996") & (~F.col("archive").startswith("1998") | (F.crc32("accession_number") % 2 == 0))
    with passing(spark):
        archives.write_archives({name: df.filter(kept) for name, df in members.items()}, fewer)
    snapshot.build_snapshot(spark, fewer, f"{root}/out")
    remove(spark, fewer)
    snapshot.build_snapshot(spark, every, f"{root}/out", incremental=True)
    return snapshot.read_snapshot(spark, f"{root}/out")


@query
def snapshot_weights(spark, folder):
    """Weights of the incremental snapshot."""
    return plain(snapshots(spark, folder)["security_weight_stats"].select("period", "cusip", "holder_count", "weight_sum", "avg_weight"))


@query
def snapshot_positions(spark, folder):
    return plain(snapshots(spark, folder)["positions"])


@query
def snapshot_stock_changes(spark, folder):
    return plain(snapshots(spark, folder)["stock_changes"])


@query
def snapshot_metadata_counts(spark, folder):
    """Counts, indicators, and versions among the snapshot's metadata."""
    meta = snapshots(spark, folder)["metadata"]
    return meta.filter(F.col("key").endswith("_count") & (F.col("key") != "data_quality_missing_ticker_security_count") | F.col("key").isin("latest_period", "schema_version"))


# ---- landed documents -------------------------------------------------------------------------

#: Entries of one landed document; their number follows the table.
DOCUMENT_ENTRIES = 50_000


def document_of(spark, entries: DataFrame, part: str | None) -> DataFrame:
    """``entries`` (key, value) written as JSON documents, one per bucket of keys, and read back as landed text."""
    buckets = max(1, -(-entries.count() // DOCUMENT_ENTRIES))
    whole = F.map_from_entries(F.collect_list(F.struct("key", "value")))
    text = (entries.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
            .agg(F.to_json(F.struct(whole.alias(part)) if part else whole).alias("value")))
    path = f"{staging_root(spark)}/document-{uuid.uuid4().hex[:8]}"
    text.write.partitionBy("bucket").text(path)  # a bucket is one row of one task, so one file
    return landed.read_documents(spark, f"{path}/bucket=*/part-*")


@query
def ticker_map_document(spark, folder):
    key = F.col("c_custkey")
    rows = Warehouse(spark, folder).table("customer").select(
        F.concat(F.lit(" x"), F.lpad(key.cast("string"), 8, "0")).alias("key"),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("t"), key.cast("string"), F.lit(" "))).alias("value"))
    return landed.ticker_map(document_of(spark, rows, "tickers"))


@query
def market_cap_document(spark, folder):
    key = F.col("p_partkey")
    rows = Warehouse(spark, folder).table("part").select(
        F.concat(F.lit("p"), key.cast("string")).alias("key"),
        F.when(key % 5 == 0, 0).otherwise(F.floor(F.col("p_retailprice") * 100)).cast("long").alias("value"))
    return landed.market_caps(document_of(spark, rows, "market_caps"))


@query
def sector_document(spark, folder):
    rows = Warehouse(spark, folder).table("customer").select(
        F.concat(F.lit(" c"), F.col("c_custkey").cast("string")).alias("key"),
        F.struct(F.concat(F.lit("  "), "c_mktsegment").alias("sector"), F.concat("c_name", F.lit("  Co ")).alias("name")).alias("value"))
    return landed.sectors(document_of(spark, rows, "sectors"))


def object_of(spark, entries: DataFrame, part: str) -> DataFrame:
    """``entries`` (key, value) exported by many tasks as one JSON object, and read back as its members by many tasks."""
    path = f"{staging_root(spark)}/object-{uuid.uuid4().hex[:8]}"
    exports.write_sorted_object(entries, path, "key", "value", part)
    return landed.read_object(spark, path)


@query
def market_cap_object(spark, folder):
    key = F.col("o_orderkey")
    rows = Warehouse(spark, folder).table("orders").select(
        F.concat(F.lit("o"), key.cast("string")).alias("key"),
        F.when(key % 5 == 0, 0).otherwise(F.floor(F.col("o_totalprice"))).cast("long").alias("value"))
    return landed.market_caps(object_of(spark, rows, "market_caps"))


@query
def sector_object(spark, folder):
    """Sector entries whose texts hold commas, quotes, and brackets."""
    rows = Warehouse(spark, folder).table("orders").select(
        F.concat(F.lit(" o"), F.col("o_orderkey").cast("string")).alias("key"),
        F.struct(F.concat(F.lit("  {"), "o_orderpriority", F.lit(',  "x"]')).alias("sector"), F.concat("o_orderstatus", F.lit("  \\ Co, ")).alias("name")).alias("value"))
    return landed.sectors(object_of(spark, rows, "sectors"))


@query
def ticker_cache_object(spark, folder):
    """Records of a ticker cache in its current shape, read as members."""
    key = F.col("o_custkey")
    rows = Warehouse(spark, folder).table("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("p")).select(
        F.concat(F.lit("x"), F.lpad(key.cast("string"), 8, "0")).alias("key"),
        F.struct(F.concat(F.lit("T"), key.cast("string")).alias("ticker"), F.concat(F.lit("{,"), "p").alias("source"), F.col("n").alias("unused")).alias("value"))
    records, overrides = landed.ticker_cache(object_of(spark, rows, "records"))
    return records.select("cusip", "ticker", "source").unionByName(overrides.select("cusip", "ticker", "source"))


@query
def trusted_tickers(spark, folder):
    """Exact and manual tickers among the cached records and overrides."""
    return signals.trusted_tickers(_records(spark, folder), _overrides(spark, folder))


@query
def quality_kpis(spark, folder):
    b = book(spark, folder)
    return quality.quality_indicators({**book_tables(spark, folder), "manager_periods": b.quarters})


@query
def quality_rules(spark, folder):
    return quality.snapshot_rules(book_tables(spark, folder))


@query
def quality_rules_tampered(spark, folder):
    """Rules that fire after known faults are planted in the tables, with their violation counts."""
    t = dict(book_tables(spark, folder))
    last = F.col("cusip").cast("int") % 10

    def change(table: str, column: str, where, value) -> None:
        t[table] = t[table].withColumn(column, F.when(where, value).otherwise(F.col(column)))

    change("manager_period_stats", "position_count", F.col("cik").endswith("3"), F.col("position_count") + 1)
    t["securities"] = t["securities"].filter(last != 4)
    change("security_weight_stats", "new_holder_count", last == 7, F.col("new_holder_count") + 1)
    change("security_weight_stats", "avg_weight", last == 8, F.col("avg_weight") + 0.001)
    change("positions", "shares_type", (last == 6) & (F.col("shares_type") == 1), F.lit(9))
    change("sectors", "ticker", F.col("sector") == "Finance", F.lit(""))
    change("manager_periods", "coverage_status", F.col("coverage_status") == "NOTICE", F.lit("ODD"))
    change("filing_part_stats", "has_discrepancy", F.col("cik").endswith("2"), ~F.col("has_discrepancy"))
    year = F.year("period")
    change("dashboard_period_stats", "weight_manager_count", year == 1997, F.col("weight_manager_count") + 1)
    change("dashboard_period_stats", "comparable_manager_count", year == 1998, F.col("comparable_manager_count") + 1)
    t["period_change_totals"] = t["period_change_totals"].filter(F.year("current_period") != 1996)
    return quality.failures(quality.snapshot_rules(t))


@query
def score_rule(spark, folder):
    return quality.score_rules(signal_tables(spark, folder)["fund_scores"])


@query
def mark_coverage(spark, folder):
    return prices.check_mark_coverage(bars(spark, folder), MARK, price_targets(spark, folder).count())
