import json

import pytest
from pyspark.sql import functions as F

from tallyhold.operators import reference, resolve
from tallyhold.schemas import OVERRIDES, RECORDS, conform
from tallyhold.sources import landed


def documents(spark, *values):
    texts = [v if isinstance(v, str) else json.dumps(v) for v in values]
    return spark.createDataFrame([(t,) for t in texts], "document string")


def pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_ticker_maps(spark, tmp_path):
    assert pairs(landed.ticker_map(documents(spark, {"tickers": {" abc ": " xyz ", "empty": ""}})), "cusip", "ticker") == [("ABC", "XYZ")]
    assert pairs(landed.ticker_map(documents(spark, {"abc": "x", "ABC ": "y"})), "cusip", "ticker") == [("ABC", "Y")]
    (tmp_path / "t.json").write_bytes(b"\xef\xbb\xbf" + json.dumps({"tickers": {"a": "b"}}, indent=1).encode())
    assert pairs(landed.ticker_map(landed.read_documents(spark, str(tmp_path / "t.json"))), "cusip", "ticker") == [("A", "B")]
    for bad in ("[]", "not json", {"tickers": []}):
        with pytest.raises(Exception, match="ticker map"):
            landed.ticker_map(documents(spark, bad)).collect()


def test_market_cap_snapshots(spark):
    doc = {"source": "S", "market_caps": {" aapl ": 100, "bad": 0, "neg": -5, "half": 7.9}}
    assert pairs(landed.market_caps(documents(spark, doc)), "ticker", "market_cap") == [("AAPL", 100), ("HALF", 7)]
    assert landed.document_fields(documents(spark, doc), "source", "currency").first() == ("S", "")
    for bad in ({"market_caps": []}, {"market_caps": {"A": "x"}}):
        with pytest.raises(Exception, match="market-cap snapshot"):
            landed.market_caps(documents(spark, bad)).collect()


def test_sector_snapshots(spark):
    doc = {"sectors": {" aapl ": {"sector": " Technology ", "name": "Apple  Inc."}, "brk/b": {"sector": "", "name": "B"},
                       "   ": {"sector": "Finance"}, "NONAME": {}, "NULLS": {"sector": None, "name": None}}}
    assert pairs(landed.sectors(documents(spark, doc)), "ticker", "sector", "name") == [
        ("AAPL", "Technology", "Apple Inc."), ("BRK/B", "", "B"), ("NONAME", "", ""), ("NULLS", "", "")]
    for bad in ("not json", {"sectors": []}, {"sectors": {"AAPL": "Tech"}}, {"sectors": {"AAA": {"sector": ["T"]}}},
                {"sectors": {"AAA": {"name": {"x": 1}}}}, {"sectors": {"BBB": {"sector": 12}}},
                {"sectors": {"CCC": {"sector": "Tech\u0001x"}}}, {"sectors": {"X" * 33: {}}}):
        with pytest.raises(Exception, match="sector snapshot"):
            landed.sectors(documents(spark, bad)).collect()


def test_watchlists(spark):
    doc = {"name": "W", "sources": [{"url": "u"}], "funds": [{"cik": str(i), "brand": f"F{i}"} for i in range(1, 21)]}
    assert len(pairs(landed.watchlist(documents(spark, doc)), "cik")) == 20
    for bad in ({**doc, "funds": doc["funds"][:19]}, {**doc, "funds": [*doc["funds"][:19], {"cik": "1"}]},
                {k: v for k, v in doc.items() if k != "sources"}, {**doc, "funds": [*doc["funds"][:19], {"cik": "x"}]}):
        with pytest.raises(Exception, match="watchlist"):
            landed.watchlist(documents(spark, bad)).collect()


def test_screener_shapes(spark):
    rows = [{"symbol": "x", "marketCap": "1"}, None]
    for shape in ({"data": {"rows": rows}}, {"data": {"data": {"rows": rows}}}, {"data": {"records": {"data": {"rows": rows}}}},
                  {"data": {"records": {"rows": rows}}}, {"data": {"rows": []}, "rows": rows}, {"rows": rows}):
        assert pairs(landed.screener_rows(documents(spark, shape)), "symbol") == [("x",)]
    assert landed.screener_rows(documents(spark, {"data": None})).collect() == []


def test_identity_shapes(spark):
    shapes = ({"fields": ["CIK", "Name", "exchange", "ticker"], "data": [[1, "A Co", "N", "a"], [2]]},
              [{"cik": 1, "name": "A Co", "ticker": "a"}, None], {"0": {"cik_str": 1, "title": "A Co", "ticker": "a"}})
    for shape in shapes:
        assert pairs(landed.identity_rows(documents(spark, shape)), "cik", "name", "ticker") == [("1", "A Co", "a")]
    with pytest.raises(Exception, match="company-ticker file"):
        landed.identity_rows(documents(spark, {"fields": ["cik"], "data": [["1"]]})).collect()


def test_ticker_cache_shapes(spark):
    key, other, third = "037833100", "594918104", "88160R101"
    for old in ({"tickers": {key: " aapl "}}, {"mappings": {key: "AAPL"}}, {key: "AAPL", "short": "X"}):
        records, overrides = landed.ticker_cache(documents(spark, old))
        assert pairs(records, "cusip", "ticker", "source", "openfigi_status") == [(key, "AAPL", "legacy_cache", "unqueried")]
        assert overrides.collect() == []
    now = {"version": 1, "tickers": {key: "IGNORED", other: "MSFT", third: "TSLA"},
           "records": {key: {"ticker": "AAPL", "source": "openfigi", "candidate_tickers": ["A"], "result_count": 2}},
           "manual_overrides": {third: {"ticker": "tsla2"}}}
    records, overrides = landed.ticker_cache(documents(spark, now))
    assert pairs(records, "cusip", "ticker", "source") == [(key, "AAPL", "openfigi"), (other, "MSFT", "legacy_cache")]
    assert records.filter(F.col("cusip") == key).first().candidate_tickers == ["A"]
    assert pairs(overrides, "cusip", "ticker") == [(third, "TSLA2")]
    with pytest.raises(Exception, match="unsupported version"):
        landed.ticker_cache(documents(spark, {**now, "version": 2}))[0].collect()


def test_sector_map_and_caps(spark):
    """Blank symbols go, the last row of a symbol counts, stocks win over funds, names are tidied, caps must be positive."""
    stocks = spark.createDataFrame(
        [(10, "quay", "Quay Dredging plc Ordinary Shares", "Harbours", "12,500.5"), (11, " ", "nobody", "Harbours", "9"),
         (12, "KELP", "Kelp & Daughters Common Stock", None, "n/a"), (13, "QUAY", "Quay Dredging plc Class B Common Stock", " Harbours", "41.5")],
        "row_no bigint, symbol string, name string, sector string, marketCap string")
    funds = spark.createDataFrame([(20, "kelp", "Kelp Fund", None), (21, "TIDE", "Tidal   Range Index Units", None), (22, "EBB", "", "Ebb Tracker")],
                                  "row_no bigint, symbol string, companyName string, name string")
    sectors = reference.sector_map(stocks, funds)
    got = pairs(sectors, "ticker", "sector", "name")
    assert [(t, s) for t, s, _ in got] == [("EBB", "ETF"), ("KELP", ""), ("QUAY", "Harbours"), ("TIDE", "ETF")]
    assert all("  " not in name and not name.endswith("Common Stock") for _, _, name in got) and got[0][2] == "Ebb Tracker"
    assert pairs(reference.sector_values(sectors), "sector") == [("ETF",), ("Harbours",)]
    caps = reference.market_caps(stocks)
    assert pairs(caps, "ticker", "market_cap") == [("QUAY", 42)]
    assert pairs(reference.screener_rules(stocks, caps), "rule", "found", "required") == [
        ("positive market caps", 1, 1000), ("stock screener symbols", 3, 1000)]


def securities(spark, rows):
    return spark.createDataFrame([(c, i, "COM", f, t, v, 1) for c, i, f, t, v in rows],
                                 "cusip string, issuer string, class string, figi string, ticker string, latest_value bigint, latest_funds bigint")


def records(spark, rows):
    df = spark.createDataFrame(rows, "cusip string, ticker string, source string, openfigi_status string")
    for field in RECORDS:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return conform(df, RECORDS)


K = [f"{i:09d}" for i in range(20)]


def test_every_lookup_status(spark):
    listed = resolve.normalised_securities(securities(spark, [
        (K[0], "A", "", "", 1), (K[1], "A", "f1", "", 1), (K[2], "A", "f1", "", 1), (K[3], "A", "", "", 1), (K[4], "A", "", "", 1),
        (K[5], "A", "", "", 1), (K[6], "A", "", "", 1), ("short", "A", "", "", 1), (K[7], "A", "f1", "", 1), (K[8], "A", "", "", 1),
        (K[9], "A", "f1", "", 1), (K[10], "A", "", "", 1)]))
    answer = "cusip string, error string, data array<struct<ticker:string,figi:string>>"
    results = spark.createDataFrame([
        (K[0], None, [(" aapl ", "f1"), ("AAPL", "f2")]), (K[1], None, [("aapl", "f1"), ("other", "f2")]),
        (K[2], None, [("aapl", "f9"), ("b", "f3"), (None, None)]), (K[3], None, [("a", "f1"), ("b", "f2")]), (K[4], None, [("", "f1")]),
        (K[5], "No identifier found.", None), (K[6], "Bad request", None), ("SHORT", None, [("x", "f")]), (K[7], None, []),
        (K[8], "warned", [("ok", "f1")]), (K[9], None, [None]), (K[10], None, [None])], answer)
    got = {r.cusip: r for r in resolve.resolve_results(listed, results, exchange="US", checked_at="now").collect()}
    assert {k: r.openfigi_status for k, r in got.items()} == {
        K[0]: "resolved", K[1]: "resolved", K[2]: "figi_mismatch", K[3]: "ambiguous", K[4]: "no_ticker", K[5]: "not_found",
        K[6]: "rejected", "SHORT": "invalid_cusip", K[7]: "not_found", K[8]: "resolved",
        # Answers without a usable row are answers all the same.
        K[9]: "figi_mismatch", K[10]: "no_ticker"}
    assert (got[K[0]].ticker, got[K[0]].source, got[K[0]].matched_figis) == ("AAPL", "openfigi", ["F1", "F2"])
    assert (got[K[1]].ticker, got[K[1]].result_count, got[K[1]].considered_count) == ("AAPL", 2, 1)
    assert (got[K[2]].ticker, got[K[2]].returned_figis) == (None, ["F3", "F9"])
    assert got[K[3]].candidate_tickers == ["A", "B"]
    assert got[K[6]].openfigi_message == "Bad request"


def test_merge_keeps_or_drops_old_tickers(spark):
    old = records(spark, [(K[0], "A", "openfigi", "resolved"), (K[1], "B", "existing_db", "unqueried"),
                          (K[2], "C", "existing_db", "unqueried"), (K[3], "D", "legacy_cache", "error"), (K[4], "E", "x", "y")])
    old = old.withColumn("openfigi_message", F.lit("stale"))
    new = records(spark, [(K[0], None, None, "not_found"), (K[1], None, None, "not_found"), (K[2], None, None, "ambiguous"),
                          (K[3], "DD", "openfigi", "resolved"), (K[5], "F", "openfigi", "resolved")])
    merged = resolve.merge_records(old, new)
    assert pairs(merged.na.fill("-"), "cusip", "ticker", "source", "openfigi_status", "openfigi_message") == [
        (K[0], "-", "-", "not_found", "-"), (K[1], "B", "existing_db", "not_found", "-"), (K[2], "-", "-", "ambiguous", "-"),
        (K[3], "DD", "openfigi", "resolved", "-"), (K[4], "E", "x", "y", "stale"), (K[5], "F", "openfigi", "resolved", "-")]


def test_seeds(spark):
    listed = securities(spark, [(K[0], "I0", "", "A", 1), (K[1], "I1", "", "B", 1), (K[2], "I2", "", "C", 1), (K[3], "I3", "", "D", 1), (K[4], "I4", "", "", 1)])
    old = records(spark, [(K[1], "B", "openfigi", "resolved"), (K[2], "X", "openfigi", "resolved")])
    manual = spark.createDataFrame([(K[3], "M", "manual_verified")], OVERRIDES)
    actions = resolve.seed_actions(listed, old, manual)
    assert pairs(actions, "cusip", "action") == [(K[0], "seed"), (K[1], "keep"), (K[2], "conflict")]
    seeded = resolve.apply_seeds(old, actions)
    assert pairs(seeded, "cusip", "ticker", "source", "openfigi_status") == [
        (K[0], "A", "existing_db", "unqueried"), (K[1], "B", "openfigi", "resolved"), (K[2], "X", "openfigi", "resolved")]


def test_lookup_candidates(spark):
    listed = securities(spark, [(K[0], "I", "", "", 5), (K[1], "I", "", "T", 50), (K[2], "I", "", "T", 40), (K[3], "I", "", "", 30),
                                (K[4], "I", "", "", 20), (K[5], "I", "", "", None), (K[6], "I", "", "", 30)])
    old = records(spark, [(K[2], "T", "sec_name", "unqueried"), (K[3], None, None, "not_found"), (K[4], None, None, "ambiguous")])
    old = old.withColumn("openfigi_exchange", F.when(F.col("cusip") == K[4], "UN").otherwise("US"))
    found = [r.cusip for r in resolve.lookup_candidates(listed, old, limit=10, exchange="US").collect()]
    # K2 was never checked, so a different exchange does not matter; K4 was checked elsewhere.
    assert found == [K[2], K[6], K[4], K[0], K[5]]
    assert [r.cusip for r in resolve.lookup_candidates(listed, old, limit=2, exchange="US", refresh=True).collect()] == [K[1], K[2]]


def test_name_matching(spark):
    ids = spark.createDataFrame([
        (1, "0000000007", "Nestlé S.A.", "nsrgy"), (2, "7", "NESTLE SA", "NSRGY"), (3, "8", "Twin Co", "a"), (4, "8", "TWIN CO.", "b"),
        (5, "9", "Other & Sons", "oth"), (6, "10", "Unique Inc", "unq"), (7, "11", "", "x"), (8, "12", "No Ticker", "")],
        "row_no bigint, cik string, name string, ticker string")
    index = resolve.safe_name_index(ids)
    assert pairs(index, "name_key", "ticker", "cik", "name") == [
        ("NESTLE S A", "NSRGY", "7", "Nestlé S.A."), ("NESTLE SA", "NSRGY", "7", "NESTLE SA"),
        ("OTHER AND SONS", "OTH", "9", "Other & Sons"), ("UNIQUE INC", "UNQ", "10", "Unique Inc")]
    listed = securities(spark, [(K[0], "nestle s.a.", "", "", 1), (K[1], "OTHER AND SONS", "", "", 1), (K[2], "Other & Sons!", "", "", 1),
                                (K[3], "UNIQUE, INC.", "", "", 1)])
    matches = resolve.name_matches(listed, index)
    assert pairs(matches, "cusip", "name_ticker") == [(K[0], "NSRGY"), (K[3], "UNQ")]
    old = records(spark, [(K[0], "OLD", "sec_name", "not_found"), (K[1], "STALE", "sec_name", "unqueried"), (K[3], None, None, "ambiguous")])
    done = resolve.supplement_by_name(old, matches, matched_at="now")
    assert pairs(done.na.fill("-"), "cusip", "ticker", "source", "openfigi_status", "sec_cik") == [
        (K[0], "NSRGY", "sec_name", "not_found", "7"), (K[1], "-", "-", "unqueried", "-"), (K[3], "-", "-", "ambiguous", "-")]
    fresh = resolve.supplement_by_name(records(spark, []), matches, matched_at="now")
    assert pairs(fresh, "cusip", "ticker", "openfigi_status") == [(K[0], "NSRGY", "unqueried"), (K[3], "UNQ", "unqueried")]
    assert resolve.identity_rule(ids).first() == (5, 1000)  # the blank name and the blank ticker do not count


def test_mapping_and_fill_only_update(spark):
    recs = resolve.canonical_records(records(spark, [(K[0], " a ", "openfigi", "resolved"), (K[1], "b", None, None), (K[2], "c", "x", "y"), (K[3], " ", "x", "y")]))
    manual = resolve.canonical_overrides(spark.createDataFrame([(K[2], "m", None)], OVERRIDES))
    mapping = resolve.final_mapping(recs, manual)
    assert pairs(mapping, "cusip", "ticker", "source") == [
        (K[0], "A", "openfigi"), (K[1], "B", "unknown"), (K[2], "M", "manual_verified")]
    assert pairs(resolve.cache_statistics(recs, manual), "kind", "label", "securities") == [
        ("source", "manual_verified", 1), ("source", "openfigi", 1), ("source", "unknown", 1), ("source", "x", 1),
        ("status", "resolved", 1), ("status", "unqueried", 1), ("status", "y", 2)]
    listed = securities(spark, [(K[0], "I", "", "", 1), (K[1], "I", "", "B", 1), (K[2], "I", "", "Z", 1), (K[9], "I", "", "", 1)])
    assert pairs(resolve.fill_actions(listed, mapping), "cusip", "action") == [(K[0], "fill"), (K[1], "same"), (K[2], "conflict")]
    assert pairs(resolve.fill_tickers(listed, mapping), "cusip", "ticker") == [(K[0], "A"), (K[1], "B"), (K[2], "Z"), (K[9], "")]
    with pytest.raises(Exception, match="manual ticker override"):
        resolve.canonical_overrides(spark.createDataFrame([("bad", "m", None)], OVERRIDES)).collect()


def test_failed_lookup_round(spark):
    old = records(spark, [(K[0], "A", "existing_db", "unqueried")])
    listed = securities(spark, [(K[0], "I0", "", "A", 1), (K[1], "I1", "", "", 1)])
    done = resolve.mark_lookup_error(old, listed, "offline", "now")
    assert pairs(done.na.fill("-"), "cusip", "ticker", "openfigi_status", "last_error") == [
        (K[0], "A", "error", "offline"), (K[1], "-", "error", "offline")]
