import datetime as dt
import json
import zipfile

import pytest

from tallyhold.operators import prices, views
from tallyhold.plans import enrichment, market, reference_data, snapshot
from tallyhold.schemas import BARS, OVERRIDES, RECORDS
from tallyhold.sources import archives, exports, landed
from tallyhold.sources.archives import list_archives, read_member

QUARTERS = [("2025q3_form13f.zip", "30-JUN-2025", "14-AUG-2025"), ("2025q4_form13f.zip", "30-SEP-2025", "14-NOV-2025")]


def tsv(header, rows):
    return "\t".join(header) + "\n" + "".join("\t".join(map(str, row)) + "\n" for row in rows)


def write_archive(path, period, filed, number, *, info=None, submissions=(), bom=True):
    """Twenty-one managers with two holdings each; manager 21 adds holdings in a second filing."""
    sub = [(f"{m:04d}-{number}", m, "13F-HR", period, filed) for m in range(1, 22)]
    sub.append((f"0021-{number}-A", 21, "13F-HR/A", period, filed))
    sub += list(submissions)
    cover = [(s[0], "Y" if s[2].endswith("/A") else "N", "NEW HOLDINGS" if s[2].endswith("/A") else "",
              "1" if s[2].endswith("/A") else "", "13F HOLDINGS REPORT", f"Fund {s[1]}", "NY") for s in sub]
    rows = info if info is not None else [
        (s[0], cusip, "APPLE INC" if cusip[0] == "0" else '"QUOTED ""NAME"""', "COM", "", f"{100 * s[1] * number if isinstance(s[1], int) else 1}.0", 10 * number, "SH", "")
        for s in sub if s[2].startswith("13F-HR") for cusip in (("037833100", "594918104") if "-A" not in s[0] else ("67066G104",))]
    counts = {}
    for row in rows:
        counts.setdefault(row[0], []).append(int(float(row[5])) if row[5] != "bad" else 0)
    summary = [(s[0], "N", len(counts.get(s[0], [])) + (1 if s[1] == 5 else 0), sum(counts.get(s[0], []))) for s in sub]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("nested/submission.tsv", ("﻿" if bom else "") + tsv(
            ["ACCESSION_NUMBER", "CIK", "SUBMISSIONTYPE", "PERIODOFREPORT", "FILING_DATE"], sub))
        archive.writestr("COVERPAGE.tsv", tsv(
            ["ACCESSION_NUMBER", "ISAMENDMENT", "AMENDMENTTYPE", "AMENDMENTNO", "REPORTTYPE", "FILINGMANAGER_NAME",
             "FILINGMANAGER_STATEORCOUNTRY"], cover))
        archive.writestr("SUMMARYPAGE.tsv", tsv(
            ["ACCESSION_NUMBER", "ISCONFIDENTIALOMITTED", "TABLEENTRYTOTAL", "TABLEVALUETOTAL"], summary))
        archive.writestr("INFOTABLE.tsv", tsv(
            ["ACCESSION_NUMBER", "CUSIP", "NAMEOFISSUER", "TITLEOFCLASS", "FIGI", "VALUE", "SSHPRNAMT", "SSHPRNAMTTYPE", "PUTCALL"],
            rows))


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    root = tmp_path_factory.mktemp("archives")
    for number, (name, period, filed) in enumerate(QUARTERS, 1):
        write_archive(root / name, period, filed, number)
    (root / "ignored.zip").write_bytes(b"not listed")
    docs = tmp_path_factory.mktemp("documents")
    (docs / "tickers.json").write_text(json.dumps({"tickers": {"037833100": "aapl", "594918104": "MSFT"}}))
    (docs / "caps.json").write_text(json.dumps({"source": "S", "market_caps": {"AAPL": 100}}))
    (docs / "sectors.json").write_text(json.dumps({"sectors": {"AAPL": {"sector": "Technology", "name": "Apple Inc."}}}))
    (docs / "watch.json").write_text(json.dumps(
        {"name": "W", "sources": [{"url": "u"}], "funds": [{"cik": str(i), "brand": f"B{i}"} for i in range(1, 21)]}))
    return {"archives": str(root), "ticker_map": str(docs / "tickers.json"), "market_caps": str(docs / "caps.json"),
            "sectors": str(docs / "sectors.json"), "watchlist": str(docs / "watch.json")}


@pytest.fixture(scope="module")
def published(spark, inputs, tmp_path_factory):
    output = str(tmp_path_factory.mktemp("snapshots"))
    paths = dict(inputs)
    snapshot.build_snapshot(spark, paths.pop("archives"), output, **paths)
    return output


def test_archive_reader(spark, inputs, tmp_path):
    assert [p.rsplit("/", 1)[-1] for p in list_archives(inputs["archives"])] == [q[0] for q in QUARTERS]
    rows = read_member(spark, inputs["archives"], "INFOTABLE")
    assert rows.rdd.getNumPartitions() == 2
    first = rows.filter("archive = '2025q3_form13f.zip' and row_no = 2").first()
    assert (first.accession_number, first.cusip, first.nameofissuer, first.value) == (
        "0001-1", "594918104", 'QUOTED "NAME"', "100.0")
    path = tmp_path / "x_form13f.zip"
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("deep/Submission.TSV", b"\xef\xbb\xbfCIK\tACCESSION_NUMBER\textra\n1\ta\xff\n\n2\tb\tc\td\n")
    got = [(r.row_no, r.cik, r.accession_number, r.filing_date) for r in read_member(spark, str(path), "SUBMISSION").collect()]
    assert got == [(1, "1", "a�", None), (2, "2", "b", None)]
    with pytest.raises(Exception, match="does not contain INFOTABLE.TSV"):
        read_member(spark, str(path), "INFOTABLE").collect()


def test_published_snapshot(spark, published):
    t = snapshot.read_snapshot(spark, published)
    assert [(r.label, r.source_archive) for r in t["periods"].orderBy("period").collect()] == [
        ("30-JUN-2025", QUARTERS[0][0]), ("30-SEP-2025", QUARTERS[1][0])]
    statuses = {(r.coverage_status, r["count"]) for r in t["manager_periods"].groupBy("coverage_status").count().collect()}
    assert statuses == {("COMPLETE", 40), ("PARTIAL", 2)}  # manager 5 reports one entry too many, twice
    assert t["positions"].count() == 2 * (21 * 2 + 1)
    assert t["managers"].filter("starred").count() == 20
    apple = t["securities"].filter("cusip = '037833100'").first()
    assert (apple.issuer, apple.ticker) == ("APPLE INC", "AAPL")
    last = t["positions"].filter("cik = '0000000021' and period = date'2025-09-30'").orderBy("cusip").collect()
    assert [(r.cusip, r.value, r.shares) for r in last] == [
        ("037833100", 4200, 20.0), ("594918104", 4200, 20.0), ("67066G104", 4200, 20.0)]
    meta = {r.key: r.value for r in t["metadata"].collect()}
    assert (meta["position_count"], meta["latest_period"], meta["schema_version"]) == ("86", "30-SEP-2025", "9")
    assert (meta["data_quality_coverage_downgrade_count"], meta["market_cap_source"]) == ("2", "S")
    assert json.loads(meta["source_archives"]) == [q[0] for q in QUARTERS]
    assert len(json.loads(meta["source_archive_hashes"])[0]["sha256"]) == 64
    assert t["market_caps"].first() == ("AAPL", 100)


def test_freshness(spark, inputs, published, tmp_path):
    paths = dict(inputs)
    archives = paths.pop("archives")
    assert snapshot.snapshot_is_current(spark, published, archives, **paths)
    for name in paths:
        assert not snapshot.snapshot_is_current(spark, published, archives, **{**paths, name: None})
    other = tmp_path / "tickers.json"
    other.write_text("{}")
    assert not snapshot.snapshot_is_current(spark, published, archives, **{**paths, "ticker_map": str(other)})
    assert not snapshot.snapshot_is_current(spark, published, archives + "/" + QUARTERS[0][0], **paths)
    assert snapshot.snapshot_is_current(spark, published, "/nowhere", trust=True)
    assert not snapshot.snapshot_is_current(spark, str(tmp_path), archives, trust=True)


def test_bad_sources_are_rejected_together_before_publication(spark, tmp_path):
    root, output = tmp_path / "in", tmp_path / "out"
    root.mkdir()
    write_archive(root / QUARTERS[0][0], *QUARTERS[0][1:], 1, info=[
        ("0001-1", "", "N", "C", "", "1", "1", "SH", ""), ("0001-1", "x", "N", "C", "", "1.5", "1", "SH", ""),
        ("0001-1", "x", "N", "C", "", "1", "-4", "SH", ""), (" ", "x", "N", "C", "", "1", "4", "SH", ""),
        ("elsewhere", "", "N", "C", "", "bad", "bad", "SH", "")],
        submissions=[("bad-1", "abc", "13F-HR", "30-JUN-2025", "14-AUG-2025"), ("bad-2", "77", "13F-HR", "30-JUN-2025", "someday"),
                     ("0002-1", "2", "13F-HR/A", "30-JUN-2025", "15-AUG-2025")])
    with pytest.raises(ValueError) as failure:
        snapshot.build_snapshot(spark, str(root), str(output))
    for rule in ("effective holdings without a security: 1", "invalid holdings values: 1", "invalid holdings amounts: 1",
                 "holdings rows without an accession: 1", "invalid manager numbers: 1", "invalid filing dates: 1"):
        assert rule in str(failure.value)
    assert not (output / "manifest").exists()


def test_archives_must_not_share_a_period(spark, tmp_path):
    write_archive(tmp_path / "a_form13f.zip", "30-JUN-2025", "14-AUG-2025", 1)
    write_archive(tmp_path / "b_form13f.zip", "30-JUN-2025", "15-AUG-2025", 1)
    with pytest.raises(ValueError, match="archives sharing a primary period"):
        snapshot.build_snapshot(spark, str(tmp_path), str(tmp_path / "out"))


def test_market_and_enrichment_jobs(spark, published, tmp_path):
    t = snapshot.read_snapshot(spark, published)
    trusted = spark.createDataFrame([("037833100", "AAPL"), ("594918104", "MSFT")], "cusip string, ticker string")

    def payload(*rows):
        return json.dumps({"status": {"rCode": 200}, "data": {"tradesTable": {"rows": [
            {"date": d, "close": c} for d, c in rows]}}})

    quotes = [(s, "stocks", payload(("06/30/2025", p), ("09/30/2025", p), ("11/17/2025", p), ("01/15/2026", "$12.00")))
              for s, p in (("AAPL", "$10.00"), ("MSFT", "$10.00"), ("UNWANTED", "$1.00"))]
    mark = dt.date(2026, 1, 15)
    cache = market.refresh_bars(spark, t, trusted, spark.createDataFrame(quotes, "symbol string, asset_class string, payload string"),
                                None, str(tmp_path / "bars"), mark, source="quotes")
    bars = cache.bars
    assert (bars.count(), cache.usable, cache.stated_mark, cache.source) == (8, True, "2026-01-15", "quotes")
    counts = {r.key: r.value for r in spark.read.parquet(str(tmp_path / "bars" / "metadata")).collect()}
    assert (counts["requested_symbol_count"], counts["mark_symbol_count"], counts["failed_symbol_count"]) == ("2", "2", "0")
    made = market.build_signals(spark, t, trusted, bars, mark, str(tmp_path / "signals"))
    assert made["fund_scores"].count() == made["scope_values"].count() == 42
    meta = {r.key: r.value for r in made["signal_metadata"].collect()}
    assert (meta["score_count"], meta["trusted_ticker_count"], meta["mark_date"]) == ("42", "2", "2026-01-15")
    empty = quotes[:1]
    with pytest.raises(ValueError, match="symbols with the common close"):
        market.refresh_bars(spark, t, trusted, spark.createDataFrame(
            [(s, a, payload(("06/30/2025", "$1"))) for s, a, _ in empty], "symbol string, asset_class string, payload string"),
            str(tmp_path / "gone"), str(tmp_path / "bars2"), mark)
    assert not prices.load_price_cache(spark, str(tmp_path / "bars2")).usable
    facts = {r.key: r.value for r in views.snapshot_facts(t["metadata"], t["period_stats"]).collect()}
    assert (facts["holding_count"], facts["distinct_managers"], facts["schema_version"]) == ("43", "21", "9")
    view = views.top_holdings(t["periods"], t["security_weight_stats"], t["securities"], t["sectors"], bars,
                              stated_mark=cache.stated_mark, price_source=cache.source)
    assert [(r.ticker, r.price, r["name"]) for r in view.rows.collect()] == [("AAPL", 12.0, "Apple Inc."), ("MSFT", 12.0, 'QUOTED "NAME"')]
    results = spark.createDataFrame([("67066G104", None, [("nvda", "F")])],
                                    "cusip string, error string, data array<struct<ticker:string,figi:string>>")
    done = enrichment.enrich(t, spark.createDataFrame([], RECORDS), spark.createDataFrame([], OVERRIDES),
                             exchange="US", at="now", limit=5, results=results)
    assert [r.cusip for r in done.candidates.collect()] == ["67066G104"]
    assert {r.cusip: r.ticker for r in done.securities.collect()} == {
        "037833100": "AAPL", "594918104": "MSFT", "67066G104": "NVDA"}
    assert {(r.kind, r.label): r.securities for r in done.statistics.collect()}[("source", "existing_db")] == 2


def test_sorted_json_export(spark, tmp_path):
    rows = spark.createDataFrame([(f"K{i:03d}", i) for i in reversed(range(50))], "ticker string, market_cap bigint")
    exports.write_sorted_json(rows, str(tmp_path / "caps"), "ticker")
    parts = sorted((tmp_path / "caps").glob("part-*.json"))
    lines = [json.loads(line)["ticker"] for part in parts for line in part.read_text().splitlines()]
    assert lines == [f"K{i:03d}" for i in range(50)]


def test_unavailable_prices_and_missing_documents(spark, tmp_path):
    bars = spark.createDataFrame([("A", dt.date(2025, 1, 2), 1.0)], BARS)
    for available in ("1", "0"):
        root = f"{tmp_path}/prices{available}"
        bars.write.parquet(f"{root}/bars")
        spark.createDataFrame([("available", available), ("mark_date", "2025-01-02")], "key string, value string").write.parquet(f"{root}/metadata")
        assert prices.load_price_cache(spark, root).usable == (available == "1")
    assert landed.read_documents(spark, f"{tmp_path}/none.json").count() == 0
    assert landed.ticker_map(landed.read_documents(spark, f"{tmp_path}/none.json")).count() == 0


def test_archives_keep_the_spelling_of_their_folder(tmp_path, monkeypatch):
    (tmp_path / "2025q1_form13f.zip").write_bytes(b"")
    assert list_archives(f"file://{tmp_path}") == [f"file://{tmp_path}/2025q1_form13f.zip"]
    asked = []
    found = archives.pafs.FileSystem.from_uri(f"file://{tmp_path}")

    class Stores:
        @staticmethod
        def from_uri(uri):
            asked.append(uri)
            return found

    monkeypatch.setattr(archives.pafs, "FileSystem", Stores)
    for folder in ("s3a://bucket/x", "abfss://box@account.dfs.core.windows.net/x", "hdfs://host:8020/x"):
        assert list_archives(folder) == [f"{folder}/2025q1_form13f.zip"]
    assert asked[0] == "s3://bucket/x"


def screener(path, n, *, fund=False):
    rows = [{"symbol": f"S{i}", "name": f"Name {i} Common Stock", "marketCap": f"{1000 + i}.00", "sector": ["Energy", "", "Finance"][i % 3]} for i in range(n)]
    if fund:
        rows = [{"symbol": f"F{i}", "companyName": f"Fund {i} Common Stock"} for i in range(n)] + [{"symbol": "S1", "companyName": "not this"}]
    path.write_text(json.dumps({"data": {"rows": rows}}))
    return str(path)


def test_jobs_take_each_others_tables(spark, inputs, published, tmp_path):
    stocks = screener(tmp_path / "stocks.json", 1200)
    funds = screener(tmp_path / "funds.json", 5, fund=True)
    made = reference_data.refresh_reference(spark, stocks, funds, str(tmp_path / "reference"))
    assert made["market_caps"].count() == 1200
    sectors = {r.ticker: (r.sector, r.name) for r in made["sectors"].collect()}
    assert sectors["S0"] == ("Energy", "Name 0") and sectors["S1"] == ("", "Name 1") and sectors["F3"][0] == "ETF"
    assert sorted(r.sector for r in made["sector_values"].collect()) == ["ETF", "Energy", "Finance"]

    t = snapshot.read_snapshot(spark, published)
    first = enrichment.enrich(t, spark.createDataFrame([], RECORDS), spark.createDataFrame([], OVERRIDES), exchange="US", at="now", limit=5,
                              output=str(tmp_path / "round1"))
    second = enrichment.enrich(t, first.records, spark.createDataFrame([], OVERRIDES), exchange="US", at="later", limit=5)
    assert second.mapping.count() == first.mapping.count() > 0
    output = str(tmp_path / "snapshots")
    paths = dict(ticker_map=str(tmp_path / "round1" / "mapping"), market_caps=str(tmp_path / "reference" / "market_caps"),
                 sectors=str(tmp_path / "reference" / "sectors"))
    snapshot.build_snapshot(spark, inputs["archives"], output, **paths)
    again = snapshot.read_snapshot(spark, output)
    assert again["market_caps"].count() == 1200 and again["sectors"].count() == 1205
    filled = {r.cusip: r.ticker for r in first.mapping.select("cusip", "ticker").collect()}
    assert {r.cusip: r.ticker for r in again["securities"].filter("ticker != ''").collect()} == {
        k: v for k, v in filled.items() if k in {r.cusip for r in again["securities"].collect()}}
    assert snapshot.snapshot_is_current(spark, output, inputs["archives"], **paths)


def test_too_few_stocks_stop_the_refresh_and_missing_funds_do_not(spark, tmp_path):
    with pytest.raises(ValueError):
        reference_data.refresh_reference(spark, screener(tmp_path / "few.json", 3), None, str(tmp_path / "few"))
    assert not (tmp_path / "few").exists()
    broken = tmp_path / "broken.json"
    broken.write_bytes(b"\xff\xfe not a document")
    made = reference_data.refresh_reference(spark, screener(tmp_path / "s.json", 1001), str(broken), str(tmp_path / "out"))
    assert made["sectors"].count() == 1001
