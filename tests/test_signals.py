import datetime as dt
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyhold import fixed_values as fv
from tallyhold.operators import asof, median, prices, signals
from tallyhold.schemas import BARS, OVERRIDES
from tests import golden as G


def day(text):
    return dt.date.fromisoformat(text)


def bars(spark, rows):
    return spark.createDataFrame([(s, day(d), c) for s, d, c in rows], BARS)


def test_asof_lookups(spark):
    known = bars(spark, [("A", "2025-01-02", 1.0), ("A", "2025-01-05", 2.0), ("a", "2025-01-03", 9.0)])
    wanted = spark.createDataFrame([("A", day(d)) for d in ("2025-01-01", "2025-01-02", "2025-01-04", "2025-01-05", "2025-01-02")],
                                   "symbol string, date date")
    got = {r.date.isoformat(): (r.before_close, r.after_close) for r in asof.asof_prices(wanted, known).collect()}
    assert got == {"2025-01-01": (None, 1.0), "2025-01-02": (1.0, 2.0), "2025-01-04": (1.0, 2.0), "2025-01-05": (2.0, None)}


def test_median_of_any_group_size(spark):
    """One group holds a third of the rows; ties, zeros, and infinities; the same path gives every median."""
    rng = random.Random(3)
    rows = [("hot", rng.choice([1.0, 1.0, 1.0, rng.lognormvariate(0, 3)])) for _ in range(3001)]
    rows += [("even", rng.uniform(-5, 5)) for _ in range(1000)] + [("same", 4.0)] * 500
    rows += [("zeros", 0.0)] * 30 + [("zeros", 1e-300)] * 30 + [("wide", 10.0 ** e) for e in range(-150, 150)]
    rows += [("endless", float(v)) for v in range(1, 1001)] + [("endless", float("inf")), ("all", float("inf")), ("both", float("-inf")), ("both", 1.0), ("both", float("inf"))]
    rows += [("long", float(v % 50_021)) for v in range(120_000)]
    rows += [(f"g{i}", rng.random()) for i in range(1500) for _ in range(1 + i % 3)] + [("none", None)]
    values = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.k: (r.rows, r.m) for r in median.middle_values(values, ["k"], "v").select(
        "k", "rows", median.median(F.col("low"), F.col("high")).alias("m")).collect()}
    groups = {}
    for key, value in rows:
        if value is not None:
            groups.setdefault(key, []).append(value)
    assert got == {key: (len(vs), statistics.median(vs)) for key, vs in groups.items()}


def test_median_of_small_groups_is_one_shuffle_of_their_values(spark, monkeypatch):
    """Groups of few rows need no bounds or buckets; groups of either size have the same medians, and null keys none."""
    staged = []
    stage = median.stage
    monkeypatch.setattr(median, "stage", lambda df, name, **options: (staged.append(name), stage(df, name, **options))[1])
    rng = random.Random(4)
    rows = [(f"k{i % 40}", i % 3, rng.choice([-0.0, 0.0, 1.0, rng.uniform(-9, 9)])) for i in range(8000)]
    rows += [("big", 0, float(i % 701)) for i in range(2000)] + [("odd", 1, float("nan")), ("odd", 1, 2.0), ("odd", 1, None)]
    rows += [("k0", None, 5.0), (None, 0, 6.0), (None, None, 7.0)] + [(None, 1, float(i)) for i in range(3000)]
    values = spark.createDataFrame(rows, "k string, p int, v double").repartition(5)
    found = lambda: {(r.k, r.p): (r.rows, str(r.low), str(r.high)) for r in median.middle_values(values, ["k", "p"], "v").collect()}
    few = found()
    assert staged == ["median-large"]
    groups = {}
    for k, p, v in rows:
        if None not in (k, p, v):
            groups.setdefault((k, p), []).append(v + 0.0)
    order = lambda v: (v != v, v)
    want = {key: (len(vs), *(str(sorted(vs, key=order)[at]) for at in ((len(vs) - 1) // 2, len(vs) // 2))) for key, vs in groups.items()}
    assert few == want
    monkeypatch.setattr(median, "FEW", 1000)
    assert found() == want and "median-buckets" in staged


def test_trusted_tickers_and_targets(spark):
    records = spark.createDataFrame(
        [("aaa", " exact ", "openfigi"), ("bbb", "GUESS", "sec_name"), ("ddd", "OLD", "openfigi")],
        "cusip string, ticker string, source string")
    overrides = spark.createDataFrame([("ccc", "manual", None), ("ddd", "NEW", None)], OVERRIDES)
    got = {r.cusip: r.ticker for r in signals.trusted_tickers(records, overrides).collect()}
    assert got == {"AAA": "EXACT", "CCC": "MANUAL", "DDD": "NEW"}
    t = G.tables(spark)
    trusted = spark.createDataFrame([(G.CUSIP["MSFT"], "MSFTX")], "cusip string, ticker string")
    shown = t["securities"].withColumn("ticker", F.when(F.col("ticker") == "TSLA", "").when(
        F.col("ticker") == "NVDA", " nvda ").otherwise(F.col("ticker")))
    targets = {r.symbol for r in signals.price_targets(t["positions"], shown, trusted).collect()}
    assert targets == {"AAPL", "MSFT", "MSFTX", "NVDA"}


def test_history_payloads(spark):
    def payload(code, *quotes):
        return json.dumps({"status": {"rCode": code}, "data": {"tradesTable": {"rows": [{"date": d, "close": c} for d, c in quotes]}}})

    first = payload(200, ("01/09/2025", "$10.50"), ("01/09/2025", "$11.25"), ("01/06/2024", "$1.00"), ("soon", "$2.00"), ("01/10/2025", "-"))
    second = payload(200, ("04/02/2025", "$1,012.00"), ("01/09/2025", "$99.00"))
    rows = [("FUND", "stocks", payload(404), 1), ("FUND", "etf", second, 1), ("FUND", "etf", first, 2),
            ("FIRM", "stocks", first, 1), ("FIRM", "stocks", second, 2), ("FIRM", "etf", payload(200, ("02/03/2025", "$5.00")), 9), ("NONE", "etf", payload(500), 1)]
    payloads = spark.createDataFrame(rows, "symbol string, asset_class string, payload string, landed int")
    got = sorted((r.symbol, r.price_date.isoformat(), r.close) for r in prices.parse_history(payloads, "2025-01-01", "2025-12-31").collect())
    # Both payloads of a route count; where they overlap, the one that landed last.
    assert got == [("FIRM", "2025-01-09", 99.0), ("FIRM", "2025-04-02", 1012.0), ("FUND", "2025-01-09", 11.25), ("FUND", "2025-04-02", 1012.0)]


def test_scores_and_scales_worked_by_hand(spark):
    """Managers A, C, D hold the same; B reports the same kinds of holdings in thousands.

    At both quarter ends T1 closes at 10, T2 at 20, T4 at 5, T5 at 10.  After the filing T1 is at 12 and ends at 15,
    T2 goes from 20 to 25, T4 from 5 to 4.  S3 has no ticker.  S5 is reported at 20 a share before its split.
    """
    from tallyhold.operators import filings, positions, rollups
    old, new, mark = dt.date(2025, 3, 31), dt.date(2025, 6, 30), dt.date(2025, 12, 1)
    filed = {old: dt.date(2025, 5, 15), new: dt.date(2025, 8, 14)}
    held = []
    for m in "ACD":
        held += [(m, old, "S1", 1000, 100.0), (m, new, "S1", 1500, 150.0), (m, old, "S2", 4000, 200.0), (m, new, "S2", 2400, 120.0),
                 (m, old, "S3", 70, 10.0), (m, new, "S3", 210, 30.0), (m, old, "S4", 200, 40.0), (m, old, "S5", 200, 10.0), (m, new, "S5", 200, 20.0)]
    for period in (old, new):
        held += [("B", period, "S1", 1000, 100_000.0), ("B", period, "S2", 4000, 200_000.0), ("B", period, "S4", 2000, 400_000.0)]
    quarters = [(m, p, "COMPLETE", filed[p]) for m in "ABCD" for p in (old, new)]
    plain = spark.createDataFrame([(m, p, c, 0, 0, v, s) for m, p, c, v, s in held],
                                  "cik string, period date, cusip string, position_type int, shares_type int, value bigint, shares double")
    quarters = spark.createDataFrame(quarters, "cik string, period date, coverage_status string, filing_date date")
    periods = spark.createDataFrame([(p, "", "") for p in (old, new)], "period date, label string, source_archive string")
    rows = [(t, d, c) for t, c in (("T1", 10.0), ("T2", 20.0), ("T4", 5.0), ("T5", 10.0)) for d in (dt.date(2025, 3, 28), new)]
    rows += [("T1", dt.date(2025, 8, 15), 12.0), ("T1", mark, 15.0), ("T2", dt.date(2025, 8, 18), 20.0), ("T2", mark, 25.0),
             ("T4", dt.date(2025, 8, 15), 5.0), ("T4", mark, 4.0), ("T5", mark, 11.0)]
    trusted = spark.createDataFrame([("S1", "T1"), ("S2", "T2"), ("S4", "T4"), ("S5", "T5")], "cusip string, ticker string")
    stats = rollups.manager_period_stats(quarters, plain)
    context = filings.manager_context(quarters, periods, stats)
    made = signals.signal_tables(positions.with_context(plain, context), context, stats, trusted, spark.createDataFrame(rows, BARS), mark)

    factors = {(r.period, r.cusip): r.factor for r in made["split_factors"].collect()}
    assert factors == {(old, "S1"): 1.0, (new, "S1"): 1.0, (old, "S2"): 1.0, (new, "S2"): 1.0, (old, "S4"): 1.0,
                       (new, "S4"): None, (old, "S5"): 2.0, (new, "S5"): 1.0}
    scores = {(r.cik, r.period): r for r in made["fund_scores"].collect()}
    assert len(scores) == 8 and all(scores[m, old].reason == fv.REASON_OLDEST for m in "ABCD")
    for m in "ACD":
        # S1 buys 50: 50 * 3; S2 sells 80: -80 * 5; S4 sells 40: -40 * -1; S3 counts but is not eligible; S5 did not change.
        r = scores[m, new]
        assert (r.candidate_events, r.eligible_events, r.priced_events, r.buy_events, r.sell_events, r.hit_events) == (4, 3, 3, 1, 2, 2)
        assert r.raw_signal_pnl == pytest.approx(-210.0) and r.gross_notional == pytest.approx(600.0 + 1600.0 + 200.0)
        assert not r.rankable and r.signal_return is None and fv.REASON_FEW_EVENTS in r.reason
    scopes = {(r.cik, r.period): r for r in made["scope_values"].collect()}
    assert {k: r.value_scale for k, r in scopes.items()} == {(m, p): 1000 if (m, p) == ("B", old) else 1 for m in "ABCD" for p in (old, new)}
    assert scopes["B", old].scope_value == 7_000_000 and scopes["B", old].scale_inferred


def test_scope_value_is_capped(spark):
    stats = spark.createDataFrame([("1", dt.date(2025, 6, 30), 8_999_999_999_999_999_999)], "cik string, period date, total_value bigint")
    rows = [("1", dt.date(2025, 6, 30), 1, 1000.0, 1.0, 1.0)] * 3
    priced = spark.createDataFrame(rows, "cik string, period date, value bigint, shares double, close double, factor double")
    row = signals.scope_values(stats, priced).first()
    assert (row.value_scale, row.scope_value, row.evidence_count) == (1000, fv.MAX_WHOLE_NUMBER, 3)
