"""A tiny snapshot: three quarters, three managers, four securities, seventeen positions."""

import datetime as dt

from tallyhold.operators import filings, positions, rollups
from tallyhold.schemas import TABLES

# The fixture and what it must give.
D = [dt.date(2025, 6, 30), dt.date(2025, 9, 30), dt.date(2025, 12, 31)]
LABELS = ["30-JUN-2025", "30-SEP-2025", "31-DEC-2025"]
FILED = [dt.date(2025, 8, 14), dt.date(2025, 11, 14), dt.date(2026, 2, 14)]
CUSIP = {"AAPL": "037833100", "MSFT": "594918104", "NVDA": "67066G104", "TSLA": "88160R101"}
TICKER = {cusip: ticker for ticker, cusip in CUSIP.items()}
ISSUER = {"AAPL": "APPLE INC", "MSFT": "MICROSOFT CORP", "NVDA": "NVIDIA CORP", "TSLA": "TESLA INC"}
SECTORS = [("AAPL", "Technology", "Apple Inc."), ("MSFT", "Technology", "Microsoft Corporation"),
           ("NVDA", "Technology", "NVIDIA Corporation"), ("TSLA", "Consumer Discretionary", "Tesla, Inc.")]
# manager, quarter, ticker, position type, value, shares
POSITIONS = [
    (1, 1, "AAPL", 0, 1000, 100.0), (1, 1, "MSFT", 0, 500, 50.0), (2, 1, "AAPL", 0, 250, 25.0),
    (2, 1, "TSLA", 0, 300, 30.0), (3, 1, "NVDA", 0, 150, 15.0),
    (1, 2, "AAPL", 0, 1500, 120.0), (1, 2, "AAPL", 1, 100, 2.0), (1, 2, "NVDA", 0, 400, 20.0),
    (2, 2, "AAPL", 0, 120, 10.0), (2, 2, "TSLA", 0, 330, 30.0), (3, 2, "NVDA", 0, 260, 20.0),
    (1, 3, "AAPL", 0, 1600, 80.0), (1, 3, "AAPL", 1, 150, 3.0), (1, 3, "NVDA", 0, 900, 30.0),
    (2, 3, "MSFT", 0, 300, 10.0), (2, 3, "TSLA", 0, 1000, 60.0), (3, 3, "NVDA", 0, 800, 25.0),
]
WEIGHTS = {
    (1, "AAPL"): (2, 1000 / 1500 + 250 / 550, 0), (1, "MSFT"): (1, 500 / 1500, 0), (1, "NVDA"): (1, 1.0, 0),
    (1, "TSLA"): (1, 300 / 550, 0), (2, "AAPL"): (2, 1500 / 2000 + 120 / 450, 0), (2, "NVDA"): (1, 400 / 2000, 1),
    (2, "TSLA"): (1, 330 / 450, 0), (3, "AAPL"): (1, 1600 / 2650, 0), (3, "MSFT"): (1, 300 / 1300, 1),
    (3, "NVDA"): (2, 900 / 2650 + 1, 0), (3, "TSLA"): (1, 1000 / 1300, 0),
}
AVERAGES = {(1, "AAPL"): 37.3737, (1, "MSFT"): 11.1111, (1, "NVDA"): 33.3333, (1, "TSLA"): 18.1818,
            (2, "AAPL"): 50.8333, (2, "NVDA"): 10.0, (2, "TSLA"): 36.6667, (3, "AAPL"): 20.1258,
            (3, "MSFT"): 7.6923, (3, "NVDA"): 44.6541, (3, "TSLA"): 25.6410}
CHANGES = {
    (2, "AAPL", 0): (2, 1, 1, 0, 2, 2, 5, 1620, 370), (2, "MSFT", 0): (1, 0, 1, -1, 0, 1, -50, 0, -500),
    (2, "NVDA", 0): (1, 1, 0, 1, 1, 0, 20, 400, 400), (2, "TSLA", 0): (1, 0, 0, 0, 1, 1, 0, 330, 30),
    (2, "AAPL", 1): (1, 1, 0, 1, 1, 0, 2, 100, 100),
    (3, "AAPL", 0): (2, 0, 2, -2, 1, 2, -50, 1600, -20), (3, "MSFT", 0): (1, 1, 0, 1, 1, 0, 10, 300, 300),
    (3, "NVDA", 0): (1, 1, 0, 1, 1, 1, 10, 900, 500), (3, "TSLA", 0): (1, 1, 0, 1, 1, 1, 30, 1000, 670),
    (3, "AAPL", 1): (1, 1, 0, 1, 1, 1, 1, 150, 50),
}
BARS_ROWS = [("AAPL", "2025-12-31", 250.0), ("AAPL", "2026-01-14", 260.0), ("AAPL", "2026-01-15", 265.0),
             ("TSLA", "2026-01-14", 400.0), ("NVDA", "2026-01-15", 180.0)]
TWO_PRICED = BARS_ROWS + [("MSFT", "2025-12-31", 400.0), ("MSFT", "2026-01-14", 430.0), ("MSFT", "2026-01-15", 420.0)]


def cik(number: int) -> str:
    return f"{number:010d}"


def tables(spark, *, extra_quarters=(), extra_positions=(), keep_periods=(1, 2, 3)) -> dict:
    """Base tables plus every rollup computed from them."""
    def frame(name, rows):
        return spark.createDataFrame(rows, TABLES[name])

    t = {"periods": frame("periods", [(D[q - 1], LABELS[q - 1], f"q{q}_form13f.zip") for q in keep_periods])}
    quarters = [(cik(m), D[q - 1], f"{m:010d}-25-{q:06d}", FILED[q - 1], "", f"q{q}_form13f.zip", "13F HOLDINGS REPORT",
                 "PARTIAL" if (m, q) == (3, 2) else "COMPLETE", False, 1)
                for m in (1, 2, 3) for q in keep_periods] + list(extra_quarters)
    t["manager_periods"] = frame("manager_periods", quarters)
    held = [(cik(m), D[q - 1], CUSIP[s], kind, 0, value, shares) for m, q, s, kind, value, shares in POSITIONS
            if q in keep_periods] + list(extra_positions)
    t["positions"] = frame("positions", held)
    t["managers"] = frame("managers", [(cik(m), name, state, m == 1) for m, name, state in (
        (1, "Alpha Capital", "NY"), (2, "Beta Partners", "CA"), (3, "Gamma Advisors", "GB"), (4, "Delta Zero", "TX"))])
    t["securities"] = frame("securities", [(CUSIP[s], ISSUER[s], "COM", "", s) for s in CUSIP] + [
        (c, "ZERO VALUE CO", "COM", "", "") for c in sorted({p[2] for p in extra_positions} - set(TICKER))])
    t["sectors"] = frame("sectors", SECTORS)
    t["market_caps"] = frame("market_caps", [("AAPL", 3_100_000_000_000)])
    t["effective_filing_parts"] = t["manager_periods"].selectExpr("cik", "period", "accession", "'BASE' as part_type")
    return with_rollups(t)


def with_rollups(t: dict) -> dict:
    t["manager_period_stats"] = rollups.manager_period_stats(t["manager_periods"], t["positions"])
    t["context"] = filings.manager_context(t["manager_periods"], t["periods"], t["manager_period_stats"])
    t["wide"] = positions.with_context(t["positions"], t["context"])
    t["security_period_stats"] = rollups.security_period_stats(t["positions"])
    t["period_stats"] = rollups.period_stats(
        t["periods"], t["manager_periods"], t["manager_period_stats"], t["security_period_stats"])
    t["stock_changes"] = rollups.stock_changes(t["wide"])
    t["period_change_totals"] = rollups.period_change_totals(t["periods"], t["context"])
    t["dashboard_period_stats"] = rollups.dashboard_period_stats(t["periods"], t["context"])
    t["security_weight_stats"] = rollups.security_weight_stats(t["wide"], t["dashboard_period_stats"])
    stats = t["manager_period_stats"].join(t["manager_periods"].select("cik", "period", "accession"), ["cik", "period"])
    t["filing_part_stats"] = stats.selectExpr(
        "accession", "cik", "period", "position_count as reported_entry_count", "total_value as reported_value",
        "position_count as observed_entry_count", "total_value as observed_value", "true as entry_count_matches",
        "true as value_matches", "false as has_discrepancy")
    return t


def snapshot(t: dict) -> dict:
    return {name: df for name, df in t.items() if name in TABLES}
