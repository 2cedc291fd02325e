"""Explicit schemas of every table.  Natural keys (manager number, security key, period date) join them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
          "date": T.DateType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


def _schema(columns: str) -> StructType:
    """``"name type, name type"`` without needing a running session."""
    pairs = [column.strip().rsplit(" ", 1) for column in columns.split(",")]
    return StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Raw text inputs, one per member of a filing archive.
RAW_MEMBERS = {
    "SUBMISSION": ("ACCESSION_NUMBER", "CIK", "SUBMISSIONTYPE", "PERIODOFREPORT", "FILING_DATE"),
    "COVERPAGE": ("ACCESSION_NUMBER", "ISAMENDMENT", "AMENDMENTTYPE", "AMENDMENTNO", "REPORTTYPE",
                  "FILINGMANAGER_NAME", "FILINGMANAGER_STATEORCOUNTRY"),
    "SUMMARYPAGE": ("ACCESSION_NUMBER", "ISCONFIDENTIALOMITTED", "TABLEENTRYTOTAL", "TABLEVALUETOTAL"),
    "INFOTABLE": ("ACCESSION_NUMBER", "CUSIP", "NAMEOFISSUER", "TITLEOFCLASS", "FIGI", "VALUE",
                  "SSHPRNAMT", "SSHPRNAMTTYPE", "PUTCALL"),
}


def raw_schema(member: str) -> StructType:
    columns = ", ".join(f"{name.lower()} string" for name in RAW_MEMBERS[member])
    return _schema(f"archive string, row_no bigint, {columns}")


BARS = _schema("symbol string, price_date date, close double")

TABLES = {
    "periods": _schema("period date, label string, source_archive string"),
    "managers": _schema("cik string, name string, state_country string, starred boolean"),
    "securities": _schema("cusip string, issuer string, class string, figi string, ticker string"),
    "market_caps": _schema("ticker string, market_cap bigint"),
    "sectors": _schema("ticker string, sector string, name string"),
    "manager_periods": _schema(
        "cik string, period date, accession string, filing_date date, filing_label string, source_archive string, "
        "report_type string, coverage_status string, confidential_omitted boolean, part_count bigint"),
    "effective_filing_parts": _schema("cik string, period date, accession string, part_type string"),
    "positions": _schema(
        "cik string, period date, cusip string, position_type int, shares_type int, value bigint, shares double"),
    "filing_part_stats": _schema(
        "accession string, cik string, period date, reported_entry_count bigint, reported_value bigint, "
        "observed_entry_count bigint, observed_value bigint, entry_count_matches boolean, value_matches boolean, "
        "has_discrepancy boolean"),
    "manager_period_stats": _schema(
        "cik string, period date, position_count bigint, security_count bigint, total_value bigint"),
    "security_period_stats": _schema(
        "period date, cusip string, position_count bigint, manager_count bigint, total_value bigint"),
    "period_stats": _schema(
        "period date, position_count bigint, total_value bigint, position_manager_count bigint, "
        "security_count bigint, manager_period_count bigint, complete_manager_count bigint, "
        "partial_manager_count bigint, inferred_manager_count bigint, notice_manager_count bigint"),
    "stock_changes": _schema(
        "current_period date, previous_period date, cusip string, position_type int, comparable_funds bigint, "
        "adding_funds bigint, cutting_funds bigint, net_add bigint, current_funds bigint, previous_funds bigint, "
        "net_units double, current_value bigint, value_change bigint"),
    "period_change_totals": _schema(
        "current_period date, previous_period date, current_value bigint, previous_value bigint"),
    "dashboard_period_stats": _schema(
        "period date, previous_period date, weight_manager_count bigint, comparable_manager_count bigint"),
    "security_weight_stats": _schema(
        "period date, cusip string, holder_count bigint, weight_sum double, avg_weight double, "
        "new_holder_count bigint"),
    "metadata": _schema("key string, value string"),
    "fund_scores": _schema(
        "cik string, period date, previous_period date, filing_date date, reference_date date, mark_date date, "
        "signal_return double, raw_signal_return double, signal_pnl double, raw_signal_pnl double, "
        "gross_notional double, candidate_events bigint, eligible_events bigint, priced_events bigint, "
        "buy_events bigint, sell_events bigint, hit_events bigint, signal_coverage double, effective_bets double, "
        "rankable boolean, reason string"),
    "scope_values": _schema(
        "cik string, period date, raw_reported_value bigint, value_scale bigint, scope_value bigint, "
        "evidence_count bigint, median_value_ratio double, scale_inferred boolean"),
}

# Kept beside a snapshot's tables for the next build.
KEPT = {
    "spellings": _schema("period date, cusip string, archive string, row_no bigint, issuer string, class string, figi string"),
    "layout": _schema("table string, period date, snapshot_id string"),
}

# Ticker-cache records, one row per security.
RECORDS = _schema(
    "cusip string, ticker string, source string, openfigi_status string, issuer string, class string, figi string, "
    "openfigi_exchange string, checked_at string, openfigi_message string, result_count bigint, "
    "considered_count bigint, candidate_tickers array<string>, returned_figis array<string>, "
    "matched_figis array<string>, sec_cik string, sec_name string, sec_matched_at string, last_error string, "
    "last_attempt_at string")
OVERRIDES = _schema("cusip string, ticker string, source string")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select and cast exactly the schema's columns, in order."""
    return df.select([F.col(f"`{field.name}`").cast(field.dataType).alias(field.name) for field in schema])
