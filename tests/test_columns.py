import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyhold.functions import columns as C
from tallyhold.functions import report


def apply(spark, make, values, kind="string"):
    """Evaluate a column expression over literal values, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    got = {r.i: r.out for r in rows.select("i", make(F.col("v")).alias("out")).collect()}
    return [got[i] for i in range(len(values))]


def test_dates(spark):
    assert apply(spark, C.filing_date, ["30-JUN-2025", "14-Aug-2025", "1-aug-2025", "junk", None]) == [
        dt.date(2025, 6, 30), dt.date(2025, 8, 14), dt.date(2025, 8, 1), None, None]
    assert apply(spark, C.date_label, [dt.date(2025, 6, 3)], "date") == ["03-JUN-2025"]


def test_whole_numbers(spark):
    texts = ["10", "10.0", "1e3", " 7 ", "", None, "1.5", "-1", "NaN", "abc", "9000000000000000000", "9000000000000000001",
             "10.0000001", "1.0000000000000000001", "1." + "0" * 40, "1.5e1", "150e-1", "15e-1", "-0.0", "0e99", "1e30", ".5", "5.", ".", "+12"]
    assert apply(spark, C.whole_number, texts) == [
        10, 10, 1000, 7, None, None, None, None, None, None, 9_000_000_000_000_000_000, None, None, None, 1, 15, 15, None, 0, 0, None, None, 5, None, 12]
    assert apply(spark, C.bad_whole_number, texts) == [
        False, False, False, False, False, False, True, True, True, True, False, True, True, True, False, False, False, True, False, False, True, True,
        False, True, False]


def test_finite_numbers(spark):
    texts = ["10.5", " ", "Infinity", "-1", "x", "0"]
    assert apply(spark, C.finite_number, texts) == [10.5, None, None, None, None, 0.0]
    assert apply(spark, C.bad_finite_number, texts) == [False, False, True, True, True, False]


def test_keys(spark):
    assert apply(spark, C.manager_key, [" 1067983 ", "12345678901", "12a", ""]) == ["0001067983", None, None, None]
    keys = apply(spark, C.security_key, [" 037833100 ", "abc*@#123", None])
    assert keys == ["037833100", "ABC*@#123", ""]
    assert apply(spark, C.is_valid_security_key, ["037833100", "ABC*@#123", "short", "037833100\n"]) == [
        True, True, False, False]
    assert apply(spark, C.fold_ascii, ["AbÉ"]) == ["abÉ"]
    assert apply(spark, C.quote_symbol, ["BRK/B"]) == ["BRK.B"]


def test_tickers_and_issuers(spark):
    assert apply(spark, C.ticker_key, [" brk/b ", "Ａapl", "a  b", "A\x01B", "x" * 33, None, " spy "]) == [
        "BRK/B", "AAPL", "A B", "", "", "", "SPY"]
    assert apply(spark, C.issuer_key, ["Nestlé S.A.", "Johnson & Johnson", "AT&T  Inc", "ﬁne-Ltd", None, "Straße"]) == [
        "NESTLE S A", "JOHNSON AND JOHNSON", "AT AND T INC", "FINE LTD", "", "STRASSE"]
    assert apply(spark, C.screener_symbol, [" brk/b ", "A\x01B", "X" * 33, None]) == ["BRK/B", "", "", ""]


def test_closes_and_caps(spark):
    assert apply(spark, C.closing_price, ["$1,234.50", "N/A", "$0", "-3", "inf", None]) == [
        1234.5, None, None, None, None, None]
    assert apply(spark, C.market_value, ["1,234.5", "1235.5", "0", "x", "inf"]) == [1234, 1236, None, None, None]


def test_split_factors(spark):
    got = apply(spark, C.nearest_split_factor, [9.98, 0.101, 1.02, 0.001, 1.28, 0.0, float("nan"), float("inf"), 0.34],
                "double")
    assert got[:3] == [10.0, 0.1, 1.0]
    assert got[3:8] == [None] * 5
    assert got[8] == pytest.approx(1 / 3)


def test_completed_market_date(spark):
    moments = [dt.datetime(2026, 8, 17, 20, 30), dt.datetime(2026, 8, 17, 22, 0), dt.datetime(2026, 8, 16, 22, 0),
               dt.datetime(2026, 1, 13, 21, 59), dt.datetime(2026, 1, 13, 22, 0)]
    assert apply(spark, C.completed_market_date, moments, "timestamp") == [
        dt.date(2026, 8, 14), dt.date(2026, 8, 17), dt.date(2026, 8, 14), dt.date(2026, 1, 12), dt.date(2026, 1, 13)]


def test_percent_change(spark):
    rows = spark.createDataFrame([(110.0, 100.0), (265.0, 260.0), (None, 100.0), (100.0, None), (100.0, 0.0), (1.0, -1.0)],
                                 "a double, b double")
    got = [r[0] for r in rows.select(C.percent_change(F.col("a"), F.col("b"))).collect()]
    assert got == [10.0, 1.9231, None, None, None, None]


# Names and what is left of them.
NAMES = {
    "Apple Inc. Common Stock": "Apple Inc.",
    "Alphabet Inc. Class A Common Stock": "Alphabet Inc.",
    "Ambev S.A. American Depositary Shares (Each representing 1 Common Share)": "Ambev S.A.",
    "Taiwan Semi Ltd. American Depository Shares (each representing five ordinary shares)": "Taiwan Semi Ltd.",
    "Grupo C.V. American Depositary Shares (each representing ten (10) Common Shares)": "Grupo C.V.",
    "Nested Corp. American Depositary Shares (each representing one (1 (one)) Share)":
        "Nested Corp. American Depositary Shares (each representing one (1 (one)) Share)",
    "Arbor Trust 6.375% Series D Cumulative Redeemable Preferred Stock":
        "Arbor Trust 6.375% Series D Cumulative Redeemable Preferred Stock",
    "Sample Corp. Units": "Sample Corp.", "Sample Corp. Warrant": "Sample Corp.", "Sample Corp. Rights": "Sample Corp.",
    "Example Holdings Ordinary Shares": "Example Holdings", "Example Holdings ORDINARY SHARE": "Example Holdings",
    "Example Holdings Units Common Stock": "Example Holdings Units",
    "  Spaced   Name  Common Stock  ": "Spaced Name", "CommonStock": "CommonStock", "Common Stock": "Common Stock", "": "",
}


def test_display_names(spark):
    assert dict(zip(NAMES, apply(spark, C.display_name, list(NAMES)))) == NAMES


def test_report_text(spark):
    assert apply(spark, report.weight_text, [44.6541, 0.125, 0.5, None, 12.25, 0.999], "double") == [
        "44.7%", "0.13%", "0.50%", "—", "12.3%", "1.00%"]
    assert apply(spark, report.change_text, [-0.04, 1.9231, -2.35, None, 0.25], "double") == [
        "0.0%", "+1.9%", "−2.4%", "—", "+0.3%"]
    assert apply(spark, report.price_text, [1234.5, 0.125, None], "double") == ["$1,234.50", "$0.13", "—"]
    assert apply(spark, report.new_holder_text, [1200, None], "bigint") == ["1,200 new", "—"]
    assert apply(spark, lambda c: report.weight_change_text(c, F.lit("down")), [-0.0, -30.7], "double") == [
        "−0.00pp", "−30.7pp"]
    assert apply(spark, lambda c: report.weight_change_text(c, F.lit("")), [34.65, -0.5], "double") == ["+34.6pp", "−0.50pp"]
    assert apply(spark, report.sector_abbreviation, ["Technology", "Real Estate", "Mystery", " ", None]) == [
        "Tech", "RE", "Myst", "—", "—"]
    assert apply(spark, lambda c: report.tidy_name(c, F.lit("")), [
        "APPLE INC", "Apple Inc.", "BERKSHIRE HATHAWAY INC DEL", "AT&T INC", "O'REILLY AUTO & CO", "3M CO.", "ÉCOLE SA", ""]) == [
        "Apple Inc", "Apple Inc.", "Berkshire Hathaway Inc Del", "At&T Inc", "O'reilly Auto & Co", "3M Co.", "éCole SA", "—"]
    assert apply(spark, report.quote_url, ["BRK/B", "A B", ""]) == [
        "https://finance.yahoo.com/quote/BRK-B", "https://finance.yahoo.com/quote/A%20B", ""]


def test_whole_numbers_are_cut_once(spark):
    plan = spark.createDataFrame([("1",)], "t string").select(C.whole_number(F.col("t")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 0 and plan.count("regexp_replace") <= 1 and plan.count("RLIKE") <= 2
