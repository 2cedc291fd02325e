"""Identifier-to-ticker resolution with provenance.

The cache of records is a table with one row per security; every step is a join plus column rules, and
diagnostics say how each ticker was found or why it was not.  Tickers are made canonical once, when a table
enters (``normalised_securities``, ``canonical_records``, ``canonical_overrides``); later steps compare them
as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhold import fixed_values as fv
from tallyhold.functions import columns as C
from tallyhold.schemas import RECORDS, conform


def normalised_securities(securities: DataFrame) -> DataFrame:
    """Securities with canonical key, trimmed names, upper-case FIGI, and canonical ticker."""
    def text(name: str) -> Column:
        return C.strip(F.coalesce(name, F.lit("")))
    return (securities.withColumn("cusip", C.security_key(F.col("cusip"))).withColumn("issuer", text("issuer"))
            .withColumn("class", text("class")).withColumn("figi", F.upper(text("figi")))
            .withColumn("ticker", C.ticker_key(F.col("ticker"))))


def canonical_records(records: DataFrame) -> DataFrame:
    """Records with canonical key and ticker; a record without a ticker has no source either."""
    typed = records.withColumn("cusip", C.security_key(F.col("cusip"))).withColumn(
        "ticker", F.nullif(C.ticker_key(F.col("ticker")), F.lit("")))
    return conform(typed.withColumn("source", F.when(F.col("ticker").isNotNull(), F.col("source"))), RECORDS)


def canonical_overrides(overrides: DataFrame) -> DataFrame:
    """Manual overrides with canonical key and ticker; one without a usable ticker is an error."""
    key, ticker = C.security_key(F.col("cusip")), C.ticker_key(F.col("ticker"))
    usable = C.is_valid_security_key(key) & (ticker != "")
    return overrides.select(
        key.alias("cusip"),
        F.when(usable, ticker).otherwise(F.raise_error(F.lit("Invalid manual ticker override"))).alias("ticker"),
        F.coalesce(F.nullif("source", F.lit("")), F.lit(fv.MANUAL_SOURCE)).alias("source"))


def seed_actions(securities: DataFrame, records: DataFrame, overrides: DataFrame) -> DataFrame:
    """What each already tickered security does to the cache: ``seed``, ``conflict``, or ``keep``."""
    held = securities.filter("ticker != ''").select("cusip", "ticker", "issuer").join(overrides, "cusip", "left_anti")
    cached = records.select("cusip", F.col("ticker").alias("cached"))
    joined = held.join(cached, "cusip", "left").withColumn("cached", F.coalesce("cached", F.lit("")))
    action = F.when(F.col("cached") == "", "seed").when(F.col("cached") != F.col("ticker"), "conflict").otherwise("keep")
    return joined.withColumn("action", action)


def apply_seeds(records: DataFrame, actions: DataFrame) -> DataFrame:
    """Records with the seeds filled in; conflicts leave both sides as they are."""
    seeds = actions.filter("action = 'seed'").select(
        "cusip", F.col("ticker").alias("seed_ticker"), F.col("issuer").alias("seed_issuer"))
    joined = records.join(seeds, "cusip", "full_outer")
    seeded = F.col("seed_ticker").isNotNull()
    return conform(
        joined.withColumn("ticker", F.coalesce("seed_ticker", "ticker"))
        .withColumn("source", F.when(seeded, fv.SEEDED_SOURCE).otherwise(F.col("source")))
        .withColumn("openfigi_status", F.when(seeded, F.coalesce("openfigi_status", F.lit(fv.UNQUERIED)))
                    .otherwise(F.col("openfigi_status")))
        .withColumn("issuer", F.coalesce("seed_issuer", "issuer")), RECORDS)


def lookup_candidates(securities: DataFrame, records: DataFrame, *, limit: int, exchange: str,
                      refresh: bool = False) -> DataFrame:
    """The most relevant securities still worth an exact lookup.

    ``securities`` carries ``latest_value`` (NULL when not held in the latest period) and ``latest_funds``.
    A top-N, so Spark keeps N rows per task and never sorts the whole table.
    """
    known = records.select(
        "cusip", F.col("openfigi_status").alias("status"), "source",
        F.upper(F.coalesce("openfigi_exchange", F.lit(""))).alias("checked_exchange"), "checked_at")
    joined = securities.join(known, "cusip", "left").withColumn("status", F.coalesce("status", F.lit(fv.UNQUERIED)))
    terminal = F.col("status").isin(*fv.TERMINAL_STATUSES)
    checked = F.coalesce(F.col("checked_at") != "", F.lit(False)) | terminal
    changed = checked & (F.coalesce("checked_exchange", F.lit("")) != exchange)
    settled = (F.col("ticker") != "") & (F.coalesce("source", F.lit("")) != fv.NAME_SOURCE)
    open_cases = joined.filter(F.lit(refresh) | changed | ~(settled | terminal))
    return open_cases.orderBy(F.desc_nulls_last("latest_value"), F.desc("latest_funds"), "cusip").limit(limit)


def _listed(rows: Column) -> Column:
    figis = F.transform(rows, lambda row: F.upper(F.coalesce(row["figi"], F.lit(""))))
    return F.array_sort(F.array_distinct(F.filter(figis, lambda figi: figi != "")))


def resolve_results(securities: DataFrame, results: DataFrame, *, exchange: str, checked_at: str) -> DataFrame:
    """Landed lookup results to record rows.

    ``results`` has one row per security: ``cusip, error, data`` with ``data`` an array of
    ``struct<ticker, figi>`` (NULL when the answer was not a list).  A result stays one row throughout.
    """
    asked = securities.join(results, "cusip")
    valid = C.is_valid_security_key(F.col("cusip"))
    rows = F.filter(F.coalesce("data", F.array().cast("array<struct<ticker:string,figi:string>>")),
                    lambda row: row.isNotNull())
    figi = F.col("figi")
    considered = F.when(figi == "", F.col("rows")).otherwise(
        F.filter("rows", lambda row: F.upper(F.coalesce(row["figi"], F.lit(""))) == figi))
    base = asked.withColumn("rows", rows).withColumn("considered", considered)
    # Array lambdas cannot hold a Python function, so tickers are normalised after one explode; the
    # distinct tickers of a security are counted by their smallest and largest value.
    exploded = base.select("cusip", F.explode("considered").alias("row")).select(
        "cusip", C.ticker_key(F.col("row.ticker")).alias("candidate")).filter("candidate != ''").distinct()
    tickers = exploded.groupBy("cusip").agg(
        F.min("candidate").alias("first_ticker"), F.max("candidate").alias("last_ticker"),
        F.array_sort(F.collect_set("candidate")).alias("candidates"))
    error = C.strip(F.coalesce("error", F.lit("")))
    lowered = F.lower(error)
    missing = F.contains(lowered, F.lit("not found")) | F.contains(lowered, F.lit("no identifier"))
    failed = (error != "") & F.col("data").isNull()
    status = (F.when(~valid, "invalid_cusip")
              .when(failed & missing, "not_found").when(failed, "rejected")
              .when(F.coalesce(F.size("data"), F.lit(0)) <= 0, "not_found")
              .when((figi != "") & (F.size("considered") == 0), "figi_mismatch")
              .when(F.col("first_ticker").isNull(), "no_ticker")
              .when(F.col("first_ticker") == F.col("last_ticker"), "resolved").otherwise("ambiguous"))
    joined = base.join(tickers, "cusip", "left").withColumn("status", status)
    resolved, counted = F.col("status") == "resolved", F.col("status").isin("resolved", "ambiguous", "no_ticker")
    typed = joined.select(
        "cusip", F.when(resolved, F.col("first_ticker")).alias("ticker"),
        F.when(resolved, fv.EXACT_SOURCE).alias("source"), F.col("status").alias("openfigi_status"),
        "issuer", "class", "figi", F.lit(exchange).alias("openfigi_exchange"), F.lit(checked_at).alias("checked_at"),
        F.when(valid & failed, error).alias("openfigi_message"),
        F.when(counted | (F.col("status") == "figi_mismatch"), F.size("rows")).alias("result_count"),
        F.when(counted, F.size("considered")).alias("considered_count"),
        F.when(F.col("status") == "ambiguous", F.col("candidates")).alias("candidate_tickers"),
        F.when(F.col("status") == "figi_mismatch", F.slice(_listed(F.col("rows")), 1, fv.MAX_LISTED_FIGIS))
        .alias("returned_figis"),
        F.when(resolved, F.slice(_listed(F.col("considered")), 1, fv.MAX_LISTED_FIGIS)).alias("matched_figis"),
        *[F.lit(None).alias(name) for name in ("sec_cik", "sec_name", "sec_matched_at", "last_error", "last_attempt_at")])
    return conform(typed, RECORDS)


_DIAGNOSTICS = ("candidate_tickers", "returned_figis", "matched_figis", "openfigi_message", "result_count",
                "considered_count", "last_error", "last_attempt_at")


def merge_records(records: DataFrame, fresh: DataFrame) -> DataFrame:
    """Existing records with fresh lookup results laid over them.

    Stale diagnostics go.  An unresolved answer removes the ticker only if that ticker came from an exact
    lookup, or the answer itself is a hard ambiguity.
    """
    new = fresh.select("cusip", *[F.col(name).alias(f"new_{name}") for name in fresh.columns if name != "cusip"])
    joined = records.join(new.withColumn("answered", F.lit(True)), "cusip", "full_outer")
    answered = F.coalesce("answered", F.lit(False))
    found = F.col("new_openfigi_status") == "resolved"
    dropped = (F.coalesce(F.col("source") == fv.EXACT_SOURCE, F.lit(False))
               | F.col("new_openfigi_status").isin(*fv.HARD_AMBIGUITY_STATUSES))

    def merged(name: str) -> Column:
        old, fresh_value = F.col(name), F.col(f"new_{name}")
        if name in ("ticker", "source"):
            return F.when(~answered, old).when(found, fresh_value).when(dropped, None).otherwise(old)
        if name in _DIAGNOSTICS:
            return F.when(answered, fresh_value).otherwise(old)
        return F.when(answered, F.coalesce(fresh_value, old)).otherwise(old)

    return joined.select("cusip", *[
        merged(field.name).alias(field.name) for field in RECORDS if field.name != "cusip"])


def mark_lookup_error(records: DataFrame, failed: DataFrame, message: str, at: str) -> DataFrame:
    """Securities whose lookup could not be made: status ``error``, ticker untouched, retried later."""
    marks = failed.select("cusip", *[F.col(name).alias(f"new_{name}") for name in ("issuer", "class", "figi")],
                          F.lit(True).alias("failed"))
    joined = records.join(marks, "cusip", "full_outer")
    hit = F.coalesce("failed", F.lit(False))
    for name in ("issuer", "class", "figi"):
        joined = joined.withColumn(name, F.when(hit, F.col(f"new_{name}")).otherwise(F.col(name)))
    for name, value in (("openfigi_status", "error"), ("last_error", message), ("last_attempt_at", at)):
        joined = joined.withColumn(name, F.when(hit, value).otherwise(F.col(name)))
    return conform(joined, RECORDS)


# ---- name matching ----------------------------------------------------------------------------

def plain_identity(cik: Column) -> Column:
    """Company number without leading zeros."""
    return F.coalesce(F.nullif(F.regexp_replace(C.strip(cik), "^0+", ""), F.lit("")), F.lit("0"))


def safe_name_index(identities: DataFrame) -> DataFrame:
    """Names that stand for exactly one ticker and one company: ``name_key, ticker, cik, name``.

    Exactly one distinct value means smallest equals largest, so nothing is collected per name.
    """
    keyed = identities.select(
        C.issuer_key(F.col("name")).alias("name_key"), C.ticker_key(F.col("ticker")).alias("ticker"),
        plain_identity(F.col("cik")).alias("cik"), C.strip("name").alias("name"), "row_no")
    grouped = keyed.filter("name_key != '' and ticker != ''").groupBy("name_key").agg(
        F.min("ticker").alias("ticker"), F.max("ticker").alias("last_ticker"),
        F.min("cik").alias("cik"), F.max("cik").alias("last_cik"), F.min_by("name", "row_no").alias("name"))
    return grouped.filter("ticker = last_ticker and cik = last_cik").select("name_key", "ticker", "cik", "name")


def name_matches(securities: DataFrame, index: DataFrame) -> DataFrame:
    """Securities whose name belongs to them alone here and is safe in the index."""
    keyed = securities.select("cusip", "issuer", "class", "figi", C.issuer_key(F.col("issuer")).alias("name_key"))
    own = keyed.filter("name_key != ''").groupBy("name_key").agg(
        F.min("cusip").alias("cusip"), F.max("cusip").alias("last_cusip"),
        F.min(F.struct("cusip", "issuer", "class", "figi")).alias("s")).filter("cusip = last_cusip")
    return own.join(index, "name_key").select(
        "cusip", F.col("s.issuer").alias("issuer"), F.col("s.class").alias("class"), F.col("s.figi").alias("figi"),
        "name_key", F.col("ticker").alias("name_ticker"), F.col("cik").alias("name_cik"), F.col("name").alias("name"))


def supplement_by_name(records: DataFrame, matches: DataFrame, *, matched_at: str) -> DataFrame:
    """Re-evaluate name-based tickers: old ones are cleared, then safe unique matches fill the gaps.

    Resolved and hard-ambiguous securities, and tickers from any other source, are left alone.
    """
    by_name = F.coalesce(F.col("source") == fv.NAME_SOURCE, F.lit(False))
    cleared = records
    for name in ("ticker", "sec_cik", "sec_name", "source"):  # the source last: it decides the others
        cleared = cleared.withColumn(name, F.when(by_name, F.lit(None)).otherwise(F.col(name)))
    offers = matches.select(
        "cusip", *[F.col(name).alias(f"new_{name}") for name in ("issuer", "class", "figi")],
        "name_ticker", "name_cik", F.col("name").alias("matched_name"), F.lit(True).alias("offered"))
    known = cleared.withColumn("recorded", F.lit(True))
    joined = known.join(offers, "cusip", "full_outer")
    status = F.coalesce("openfigi_status", F.lit(fv.UNQUERIED))
    blocked = status.isin("resolved", *fv.HARD_AMBIGUITY_STATUSES) | F.col("ticker").isNotNull()
    joined = joined.withColumn("take", F.coalesce("offered", F.lit(False)) & ~blocked)
    joined = joined.withColumn("openfigi_status", F.when(F.col("recorded").isNull(), fv.UNQUERIED)
                               .otherwise(F.col("openfigi_status")))
    for name in ("issuer", "class", "figi"):
        joined = joined.withColumn(name, F.when(F.col("take") | F.col("recorded").isNull(), F.col(f"new_{name}"))
                                   .otherwise(F.col(name)))
    for name, value in (("ticker", F.col("name_ticker")), ("source", F.lit(fv.NAME_SOURCE)),
                        ("sec_cik", F.col("name_cik")), ("sec_name", F.col("matched_name")),
                        ("sec_matched_at", F.lit(matched_at))):
        joined = joined.withColumn(name, F.when(F.col("take"), value).otherwise(F.col(name)))
    return conform(joined, RECORDS)


def identity_rule(identities: DataFrame) -> DataFrame:
    """One row: distinct valid (company, ticker) identities and how many are required."""
    valid = identities.select(
        plain_identity(F.col("cik")).alias("cik"), C.ticker_key(F.col("ticker")).alias("ticker"),
        C.strip("name").alias("name")).filter(
        F.col("cik").rlike("^[0-9]+$") & (F.col("name") != "") & (F.col("ticker") != ""))
    return valid.select("cik", "ticker").distinct().agg(F.count("*").alias("found")).withColumn(
        "required", F.lit(fv.MIN_IDENTITIES))


# ---- final mapping ----------------------------------------------------------------------------

def _sourced(records: DataFrame) -> DataFrame:
    return records.filter("ticker is not null").select(
        "cusip", "ticker", F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source"))


def final_mapping(records: DataFrame, overrides: DataFrame) -> DataFrame:
    """``cusip, ticker, source``: record tickers, replaced by manual overrides."""
    manual = overrides.select("cusip", "ticker", "source")
    return _sourced(records).join(manual, "cusip", "left_anti").unionByName(manual)


def cache_statistics(records: DataFrame, overrides: DataFrame) -> DataFrame:
    """``kind, label, securities``: tickers by source (records and overrides) and records by status."""
    sources = _sourced(records).unionByName(overrides.select("cusip", "ticker", "source")).select(
        F.lit("source").alias("kind"), F.col("source").alias("label"))
    statuses = records.select(F.lit("status").alias("kind"), F.coalesce(
        F.nullif("openfigi_status", F.lit("")), F.lit(fv.UNQUERIED)).alias("label"))
    return sources.unionByName(statuses).groupBy("kind", "label").agg(F.count("*").alias("securities"))


def fill_actions(securities: DataFrame, mapping: DataFrame) -> DataFrame:
    """What the mapping does to each (normalised) security: ``fill``, ``same``, or ``conflict`` (left alone)."""
    wanted = mapping.select("cusip", F.col("ticker").alias("mapped")).filter("mapped != ''")
    joined = securities.withColumn("current", F.coalesce("ticker", F.lit(""))).join(wanted, "cusip")
    action = F.when(F.col("current") == "", "fill").when(F.col("current") == F.col("mapped"), "same").otherwise("conflict")
    return joined.select("cusip", "current", "mapped", action.alias("action"))


def fill_tickers(securities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Securities with blank tickers filled from the mapping; existing tickers never change."""
    wanted = mapping.select("cusip", F.col("ticker").alias("mapped"))
    joined = securities.join(wanted, "cusip", "left")
    blank = F.col("ticker").isNull() | (F.trim("ticker") == "")
    filled = F.when(blank, F.coalesce("mapped", "ticker")).otherwise(F.col("ticker"))
    return joined.withColumn("ticker", filled).select(*securities.columns)
