import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyhold.operators import filings, positions
from tallyhold.schemas import raw_schema

LABEL = "30-JUN-2025"
PERIODS = [(dt.date(2025, 6, 30), LABEL)]


def raw(spark, member, rows):
    schema = raw_schema(member)
    width = len(schema) - 2
    return spark.createDataFrame([("q.zip", i + 1, *row, *[None] * (width - len(row))) for i, row in enumerate(rows)], schema)


def members(spark, filed):
    """``filed``: dicts with accession, cik, type, and optional date, flag, amendment, number, report, secret."""
    sub = raw(spark, "SUBMISSION", [(f["accession"], f.get("cik", "1"), f["type"], LABEL, f.get("date", "14-AUG-2025"))
                                    for f in filed])
    cover = raw(spark, "COVERPAGE", [(f["accession"], f.get("flag", "N"), f.get("amendment", ""), f.get("number", ""),
                                      f.get("report", "13F HOLDINGS REPORT"), "Name", "NY") for f in filed])
    summary = raw(spark, "SUMMARYPAGE", [(f["accession"], f.get("secret", "N"), "1", "10") for f in filed])
    return sub, cover, summary


def states(spark, filed):
    sub, cover, summary = members(spark, filed)
    events = filings.filing_events(sub, cover, summary, spark.createDataFrame(PERIODS, "period date, label string"))
    groups = filings.group_states(events)
    return events, groups, filings.effective_parts(events, groups)


def test_part_types(spark):
    events, _, _ = states(spark, [
        {"accession": "a", "type": "13F-HR"}, {"accession": "b", "type": "13F-HR/A", "amendment": " new holdings "},
        {"accession": "c", "type": "13F-HR", "flag": "Y", "amendment": "RESTATEMENT"},
        {"accession": "d", "type": "13F-NT"}, {"accession": "e", "type": "13F-HR/A", "amendment": "odd"},
        {"accession": "f", "type": "OTHER"}])
    assert {r.accession: r.part_type for r in events.collect()} == {
        "a": "BASE", "b": "NEW HOLDINGS", "c": "RESTATEMENT", "d": "NOTICE", "e": "UNKNOWN AMENDMENT"}


def fold(kinds):
    """Walk one chain the slow way: parts in force and whether it is inferred."""
    kept, inferred = [], False
    for at, kind in enumerate(kinds):
        if kind == "N":
            inferred = inferred or not kept
            kept = [*kept, at]
        else:
            inferred = inferred or kind == "U"
            kept = [at]
    return kept, inferred


def test_every_short_chain_matches_a_walk(spark):
    kinds = {"B": ("13F-HR", "N", ""), "R": ("13F-HR/A", "Y", "RESTATEMENT"), "N": ("13F-HR/A", "Y", "NEW HOLDINGS"),
             "U": ("13F-HR/A", "Y", "")}
    filed, expected = [], {}
    chains = [c for n in (1, 2, 3, 4) for c in itertools.product("BRNU", repeat=n)]
    for number, chain in enumerate(chains, 1):
        for at, kind in enumerate(chain):
            form, flag, amendment = kinds[kind]
            filed.append({"accession": f"{number:04d}-{at}", "cik": str(number), "type": form, "flag": flag,
                          "amendment": amendment, "date": f"{at + 1}-AUG-2025"})
        expected[f"{number:010d}"] = fold(chain)
    random.Random(7).shuffle(filed)
    _, groups, parts = states(spark, filed)
    kept = {}
    for row in parts.collect():
        kept.setdefault(row.cik, set()).add(int(row.accession[-1]))
    for row in groups.collect():
        positions_, inferred = expected[row.cik]
        assert kept[row.cik] == set(positions_)
        assert row.coverage_status == ("INFERRED" if inferred else "COMPLETE")


def test_order_and_coverage(spark):
    _, groups, parts = states(spark, [
        # Same day: a restatement counts before an addition, whatever the accession says.
        {"accession": "z", "cik": "1", "type": "13F-HR/A", "amendment": "RESTATEMENT", "number": "1"},
        {"accession": "a", "cik": "1", "type": "13F-HR/A", "amendment": "NEW HOLDINGS", "number": "1"},
        {"accession": "b", "cik": "2", "type": "13F-HR", "secret": "Y"},
        {"accession": "c", "cik": "3", "type": "13F-HR", "report": "13F COMBINATION REPORT"},
        {"accession": "d", "cik": "4", "type": "13F-NT"},
        {"accession": "e", "cik": "5", "type": "13F-HR", "secret": "Y"},
        {"accession": "f", "cik": "5", "type": "13F-HR/A", "amendment": "RESTATEMENT", "date": "20-AUG-2025"},
        {"accession": "g", "cik": "6", "type": "13F-HR/A", "amendment": "NEW HOLDINGS"},
        {"accession": "h", "cik": "6", "type": "13F-HR/A", "amendment": "RESTATEMENT", "date": "20-AUG-2025"}])
    status = {int(r.cik): (r.coverage_status, r.accession, r.confidential_omitted) for r in groups.collect()}
    assert status == {1: ("COMPLETE", "a", False), 2: ("PARTIAL", "b", True), 3: ("PARTIAL", "c", False),
                      4: ("NOTICE", "d", False), 5: ("COMPLETE", "f", False), 6: ("INFERRED", "h", False)}
    assert sorted((int(r.cik), r.accession) for r in parts.collect()) == [
        (1, "a"), (1, "z"), (2, "b"), (3, "c"), (5, "f"), (6, "h")]


def test_last_cover_row_wins(spark):
    cover = raw(spark, "COVERPAGE", [("a", "N", "first"), (" a ", "N", "second"), ("b", "N", "only")])
    assert {r.accession_number: r.amendmenttype for r in filings.last_row_per_accession(cover).collect()} == {
        "a": "second", "b": "only"}


def test_primary_period_ties_go_to_the_first_seen(spark):
    sub = raw(spark, "SUBMISSION", [("a", "1", "13F-HR", "30-SEP-2025"), ("b", "1", "13F-HR", LABEL),
                                    ("c", "1", "13F-HR", LABEL), ("d", "1", "13F-HR", "30-SEP-2025"),
                                    ("e", "1", "13F-HR/A", LABEL)])
    assert [(r.label, r.filings) for r in filings.primary_periods(sub).collect()] == [("30-SEP-2025", 2)]


def test_reconciliation_and_downgrade(spark):
    filed = [{"accession": "a", "cik": "1", "type": "13F-HR"}, {"accession": "b", "cik": "2", "type": "13F-HR"},
             {"accession": "c", "cik": "3", "type": "13F-HR", "report": "13F NOTICE"}]
    events, groups, parts = states(spark, filed)
    lines = spark.createDataFrame([("a", 10), ("b", 4), ("b", 6)], "accession string, value bigint")
    parts = parts.withColumn("reported_value", F.when(F.col("accession") == "b", None).otherwise(F.col("reported_value")))
    stats = filings.reconcile_parts(parts, filings.observed_totals(lines))
    got = {r.accession: (r.observed_entry_count, r.observed_value, r.entry_count_matches, r.value_matches, r.has_discrepancy)
           for r in stats.collect()}
    assert got == {"a": (1, 10, True, True, False), "b": (2, 10, False, None, True), "c": (0, 0, False, False, True)}
    quarters = {int(r.cik): (r.coverage_status, r.downgraded, r.part_count, r.reconciled_value)
                for r in filings.manager_periods(groups, stats).collect()}
    assert quarters == {1: ("COMPLETE", False, 1, 10), 2: ("PARTIAL", True, 1, 10), 3: ("PARTIAL", False, 1, 0)}


def test_merge_keeps_a_lone_missing_share_count(spark):
    rows = [("x", 1, None), ("y", 1, None), ("y", 2, None), ("z", 1, 5.0), ("z", 2, None)]
    lines = spark.createDataFrame([("1", dt.date(2025, 6, 30), c, 0, 0, v, s) for c, v, s in rows],
                                  "cik string, period date, cusip string, position_type int, shares_type int, value bigint, shares double")
    got = {r.cusip: (r.value, r.shares) for r in positions.merge_positions(lines).collect()}
    assert got == {"x": (1, None), "y": (3, 0.0), "z": (3, 5.0)}


def test_security_comes_from_the_first_row_of_the_last_archive(spark):
    lines = spark.createDataFrame(
        [("old.zip", 1, "c", "Old Name"), ("new.zip", 9, "c", "Later Row"), ("new.zip", 3, "c", "New Name")],
        "archive string, row_no bigint, cusip string, issuer string").withColumn("class", F.lit("")).withColumn("figi", F.lit(""))
    archives = spark.createDataFrame([("old.zip", dt.date(2025, 1, 1)), ("new.zip", dt.date(2025, 4, 1))],
                                     "archive string, first_filed date")
    assert positions.security_dimension(lines, archives).first().issuer == "New Name"


def test_manager_names(spark):
    rows = [("1", dt.date(2025, 6, 30), "Old", "NY"), ("1", dt.date(2025, 9, 30), "New", "CA"), ("2", dt.date(2025, 6, 30), "", "")]
    quarters = spark.createDataFrame(rows, "cik string, period date, manager_name string, state_country string")
    watched = spark.createDataFrame([("1",)], "cik string")
    got = {r.cik: (r["name"], r.state_country, r.starred) for r in filings.manager_dimension(quarters, watched).collect()}
    assert got == {"1": ("New", "CA", True), "2": ("CIK 2", "", False)}
