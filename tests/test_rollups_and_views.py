import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyhold.operators import prices, views
from tallyhold.schemas import BARS, TABLES
from tallyhold.session import stage
from tests import golden as G


def quarter(day):
    return G.D.index(day) + 1


@pytest.fixture(scope="module")
def golden(spark):
    t = G.tables(spark)
    for name in ("security_weight_stats", "stock_changes", "securities", "sectors", "periods"):
        t[name] = stage(t[name], name)
    return t


def bars(spark, rows):
    return spark.createDataFrame([(s, dt.date.fromisoformat(d), c) for s, d, c in rows], BARS)


def ask(t, bars=None, **options):
    return views.ranked_view(t["periods"], t["security_weight_stats"], t["securities"], t["sectors"], bars, **options)


def shown(view, *names):
    return [tuple(row[name] for name in names) for row in view.rows.collect()]


def test_period_links_and_universe(golden):
    rows = {quarter(r.period): (r.previous_period and quarter(r.previous_period), r.weight_manager_count,
                                r.comparable_manager_count) for r in golden["dashboard_period_stats"].collect()}
    assert rows == {1: (None, 3, 0), 2: (1, 2, 2), 3: (2, 3, 2)}


def test_weights_and_new_holders(golden):
    rows = {(quarter(r.period), G.TICKER[r.cusip]): r for r in golden["security_weight_stats"].collect()}
    assert set(rows) == set(G.WEIGHTS)
    for key, (holders, total, fresh) in G.WEIGHTS.items():
        assert (rows[key].holder_count, rows[key].new_holder_count) == (holders, fresh)
        assert rows[key].weight_sum == pytest.approx(total, abs=1e-9)
        assert rows[key].avg_weight == pytest.approx(G.AVERAGES[key], abs=1e-4)


def test_stock_changes(golden):
    rows = {(quarter(r.current_period), G.TICKER[r.cusip], r.position_type): (
        r.comparable_funds, r.adding_funds, r.cutting_funds, r.net_add, r.current_funds, r.previous_funds,
        r.net_units, r.current_value, r.value_change) for r in golden["stock_changes"].collect()}
    assert rows == G.CHANGES


def test_change_totals_and_summary(golden):
    rows = {quarter(r.current_period): (r.current_value, r.previous_value) for r in golden["period_change_totals"].collect()}
    assert rows == {2: (2450, 2050), 3: (3950, 2450)}
    summary = views.snapshot_summary(golden["period_stats"]).first()
    assert (summary.holding_count, summary.total_value, summary.distinct_managers, summary.distinct_issuers,
            summary.period_count) == (6, 4750, 3, 4, 3)


def test_zero_total_manager_is_comparable_but_outside_the_universe(spark):
    extra = [(G.cik(4), G.D[q - 1], f"4-{q}", G.FILED[q - 1], "", "q.zip", "13F HOLDINGS REPORT", "COMPLETE", False, 1)
             for q in (2, 3)]
    t = G.tables(spark, extra_quarters=extra, extra_positions=[(G.cik(4), G.D[2], "000000000", 0, 0, 0, 10.0)])
    counts = {quarter(r.period): (r.weight_manager_count, r.comparable_manager_count)
              for r in t["dashboard_period_stats"].collect()}
    assert counts[3] == (3, 3)
    weights = {(quarter(r.period), r.cusip): r.new_holder_count for r in t["security_weight_stats"].collect()}
    assert (3, "000000000") not in weights
    assert weights[(3, G.CUSIP["MSFT"])] == 1 and weights[(3, G.CUSIP["NVDA"])] == 0


def test_top_holdings(golden):
    view = ask(golden)
    assert shown(view, "ticker", "direction", "metric", "holders") == [
        ("NVDA", "up", 44.6541, 2), ("TSLA", "down", 25.641, 1), ("AAPL", "down", 20.1258, 1), ("MSFT", "up", 7.6923, 1)]
    assert (view.period, view.comparison_period, view.count(), view.price_available) == (G.D[2], G.D[1], 4, False)
    first = view.rows.first()
    assert (first["name"], first.sector, first.issuer, first.price) == (
        "NVIDIA Corporation", "Technology", "NVIDIA CORP", None)
    beyond = ask(golden, page=2, size=10)
    assert (beyond.rows.collect(), beyond.count()) == ([], 4)


def test_fresh_initiations(golden):
    assert shown(ask(golden, view="initiations"), "ticker", "metric", "direction") == [("MSFT", 1, "up")]


def test_initiations_direction_compares_with_the_prior_quarter(spark, golden):
    extra = [(G.D[q], f"1000{n}X104", 1, 0.01, 1.0, count)
             for n, (old, new) in enumerate([(6, 5), (3, 3), (0, 7)]) for q, count in ((1, old), (2, new))]
    t = dict(golden)
    t["security_weight_stats"] = golden["security_weight_stats"].unionByName(
        spark.createDataFrame(extra, TABLES["security_weight_stats"]))
    t["securities"] = golden["securities"].unionByName(spark.createDataFrame(
        [(f"1000{n}X104", name + " CORP", "COM", "", name) for n, name in enumerate(("COOLING", "STEADY", "FIRST"))],
        TABLES["securities"]))
    assert shown(ask(t, view="initiations"), "ticker", "metric", "direction") == [
        ("FIRST", 7, "up"), ("COOLING", 5, "down"), ("STEADY", 3, "flat"), ("MSFT", 1, "up")]


@pytest.mark.parametrize("horizon,side,expected", [
    (1, "gainers", [("NVDA", 34.6541), ("MSFT", 7.6923)]), (1, "losers", [("AAPL", -30.7075), ("TSLA", -11.0256)]),
    (2, "gainers", [("NVDA", 11.3208), ("TSLA", 7.4592)]), (2, "losers", [("AAPL", -17.2479), ("MSFT", -3.4188)]),
    (3, "gainers", []), (4, "losers", [])])
def test_top_movers(golden, horizon, side, expected):
    view = ask(golden, view="movers", horizon=horizon, side=side)
    assert [t for t, _ in shown(view, "ticker", "metric")] == [t for t, _ in expected]
    assert [m for _, m in shown(view, "ticker", "metric")] == pytest.approx([m for _, m in expected], abs=5e-4)
    assert view.count() == len(expected)


def test_sold_out_unchanged_and_unmapped_securities(spark, golden):
    extra = [(G.D[1], "70001A109", 2, 0.42, 21.0, 0), (G.D[1], "70002A109", 1, 0.04, 4.0, 0), (G.D[2], "70002A109", 1, 0.04, 4.0, 0)]
    t = dict(golden)
    t["security_weight_stats"] = golden["security_weight_stats"].unionByName(
        spark.createDataFrame(extra, TABLES["security_weight_stats"]))
    t["securities"] = golden["securities"].unionByName(spark.createDataFrame(
        [("70001A109", "SOLD OUT LTD", "ORD", "", ""), ("70002A109", "CALM WATERS", "ORD", "", "CALM")], TABLES["securities"]))
    losers = ask(t, view="movers", side="losers", unmapped="include")
    assert shown(losers, "ticker", "metric", "holders") == [("AAPL", -30.7075, 1), ("", -21.0, 0), ("TSLA", -11.0256, 1)]
    assert shown(ask(t, view="movers", side="losers"), "ticker") == [("AAPL",), ("TSLA",)]
    assert ("CALM",) not in shown(ask(t, view="movers"), "ticker")
    assert ("CALM", "flat") in shown(ask(t), "ticker", "direction")


def test_single_period(spark):
    t = G.tables(spark, keep_periods=(3,))
    view = ask(t)
    assert view.comparison_period is None
    assert {row.direction for row in view.rows.collect()} == {"flat"}
    assert ask(t, view="movers").rows.collect() == []


def test_blank_ticker_and_missing_sector(spark, golden):
    t = dict(golden)
    t["securities"] = golden["securities"].withColumn(
        "ticker", F.when(F.col("ticker") == "TSLA", "").otherwise(F.col("ticker")))
    t["sectors"] = golden["sectors"].filter("ticker != 'MSFT'").unionByName(
        spark.createDataFrame([("", "Bogus", "Trap")], TABLES["sectors"]))
    prices_ = bars(spark, [("", "2026-01-15", 2.0), ("msft", "2025-12-31", 400.0), ("msft", "2026-01-14", 410.0),
                           ("msft", "2026-01-15", 420.0)])
    rows = {r.cusip: r for r in ask(t, prices_, unmapped="include").rows.collect()}
    tesla, microsoft = rows[G.CUSIP["TSLA"]], rows[G.CUSIP["MSFT"]]
    assert (tesla["name"], tesla.sector, tesla.price) == ("TESLA INC", "", None)
    assert (microsoft["name"], microsoft.sector, microsoft.price, microsoft.ytd_change) == ("MICROSOFT CORP", "", 420.0, 5.0)

    def order(**options):
        return [G.TICKER[c] for (c,) in shown(ask(t, prices_, unmapped="include", **options), "cusip")]
    assert order(sort="ticker", direction="asc") == ["AAPL", "MSFT", "NVDA", "TSLA"]
    assert order(sort="ticker", direction="desc") == ["NVDA", "MSFT", "AAPL", "TSLA"]
    for direction in ("asc", "desc"):
        assert order(sort="sector", direction=direction) == ["NVDA", "AAPL", "TSLA", "MSFT"]
        assert order(sort="price", direction=direction) == ["MSFT", "NVDA", "TSLA", "AAPL"]


def test_prices_follow_the_mark_date(spark, golden):
    view = ask(golden, bars(spark, G.BARS_ROWS), price_source="quotes")
    rows = {r.ticker: r for r in view.rows.collect()}
    assert (view.price_date, view.price_source) == (dt.date(2026, 1, 15), "quotes")
    assert (rows["AAPL"].price, rows["AAPL"].day_change, rows["AAPL"].ytd_change) == (265.0, 1.9231, 6.0)
    assert (rows["TSLA"].price, rows["TSLA"].price_date) == (None, None)
    assert (rows["NVDA"].price, rows["NVDA"].day_change, rows["NVDA"].ytd_change) == (180.0, None, None)


@pytest.mark.parametrize("sort,direction,expected", [
    ("price", "desc", ["MSFT", "AAPL", "NVDA", "TSLA"]), ("price", "asc", ["NVDA", "AAPL", "MSFT", "TSLA"]),
    ("day", "desc", ["AAPL", "MSFT", "NVDA", "TSLA"]), ("day", "asc", ["MSFT", "AAPL", "NVDA", "TSLA"]),
    ("ytd", "desc", ["AAPL", "MSFT", "NVDA", "TSLA"]), ("ytd", "asc", ["MSFT", "AAPL", "NVDA", "TSLA"])])
def test_price_sorts(spark, golden, sort, direction, expected):
    assert [t for (t,) in shown(ask(golden, bars(spark, G.TWO_PRICED), sort=sort, direction=direction), "ticker")] == expected
    unpriced = ask(golden, sort=sort, direction=direction)
    assert [t for (t,) in shown(unpriced, "ticker")] == ["NVDA", "TSLA", "AAPL", "MSFT"]


def test_mark_date_rules(spark, tmp_path):
    some = bars(spark, G.BARS_ROWS)
    assert prices.mark_date(some, "2026-01-14") == dt.date(2026, 1, 14)
    assert prices.mark_date(some, "not-a-date") == dt.date(2026, 1, 15)
    assert prices.mark_date(some, "2025-13-45") is None
    empty, usable = prices.load_bars(spark, str(tmp_path / "missing"))
    assert (usable, empty.count(), prices.mark_date(empty)) == (False, 0, None)
    some.drop("close").write.parquet(str(tmp_path / "no_close"))
    assert prices.load_bars(spark, str(tmp_path / "no_close"))[1] is False
    some.write.parquet(str(tmp_path / "good"))
    assert prices.load_bars(spark, str(tmp_path / "good"))[1] is True


def test_year_to_date_base_must_fall_in_december(spark):
    """QA has no December close, QB opens on the mark date, QC has one; a blank ticker is never priced."""
    rows = spark.createDataFrame([("1", "QA"), ("2", "QB"), ("3", "QC"), ("4", "")], "cusip string, ticker string")
    found = bars(spark, [("QA", "2024-11-29", 80.0), ("QA", "2025-03-03", 100.0), ("QB", "2025-03-03", 7.0), ("QC", "2024-12-30", 40.0),
                         ("QC", "2025-02-28", 48.0), ("QC", "2025-03-03", 60.0), ("", "2025-03-03", 3.0)])
    got = {r.cusip: (r.price, r.day_change, r.ytd_change)
           for r in prices.with_prices(rows, found, dt.date(2025, 3, 3)).collect()}
    assert got == {"1": (100.0, 25.0, None), "2": (7.0, None, None), "3": (60.0, 25.0, 50.0), "4": (None, None, None)}


def test_options_are_checked():
    assert views.view_options() == views.ViewOptions()
    assert views.view_options(view="movers", side="losers").direction == "asc"
    assert views.view_options(view="movers", side="losers", direction="desc").direction == "desc"
    assert views.view_options(view="holdings", side="losers").direction == "desc"
    assert views.view_options(page="3", size="10", horizon="4").horizon == 4
    for bad in ({"view": "funds"}, {"side": "up"}, {"horizon": 0}, {"horizon": 5}, {"horizon": "1.5"}, {"page": 0},
                {"size": 9}, {"size": 201}, {"sort": "Metric"}, {"sort": ""}, {"direction": "ASC"}, {"unmapped": "yes"},
                {"view": "hold\nings"}, {"view": "x" * 300}, {"pages": 1}):
        with pytest.raises(ValueError):
            views.view_options(**bad)


def test_merge_bars_replaces_by_folded_symbol(spark):
    old = bars(spark, [("AAPL", "2026-01-14", 1.0), ("AAPL", "2026-01-15", 2.0), ("É", "2026-01-15", 3.0)])
    new = bars(spark, [("aapl", "2026-01-15", 9.0), ("é", "2026-01-15", 4.0)])
    got = {(r.symbol, r.price_date.day): r.close for r in prices.merge_bars(old, new).collect()}
    assert got == {("AAPL", 14): 1.0, ("aapl", 15): 9.0, ("É", 15): 3.0, ("é", 15): 4.0}
