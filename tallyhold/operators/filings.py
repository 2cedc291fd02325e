"""From raw submissions to canonical filings: primary periods, effective parts, coverage, reconciliation.

A manager-quarter can own any number of filings, so nothing here sorts or collects one group: the latest
reset, the latest filing, and every flag come out of mergeable aggregates, and the parts that survive are
found by joining filings back to that one row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhold import fixed_values as fv
from tallyhold.functions import columns as C

GROUP = ["cik", "period"]


def last_row_per_accession(member: DataFrame) -> DataFrame:
    """Cover and summary pages may repeat an accession; the last row of the file counts."""
    values = [c for c in member.columns if c not in ("archive", "accession_number")]
    keyed = member.withColumn("accession_number", C.strip("accession_number"))
    last = keyed.groupBy("archive", "accession_number").agg(
        F.max(F.struct("row_no", *[v for v in values if v != "row_no"])).alias("last"))
    return last.select("archive", "accession_number", "last.*")


def primary_periods(submissions: DataFrame) -> DataFrame:
    """Most frequent reporting period among the initial holdings reports of each archive; first seen wins ties."""
    counts = (submissions.filter(F.col("submissiontype") == fv.INITIAL_HOLDINGS_TYPE)
              .groupBy("archive", F.col("periodofreport").alias("label"))
              .agg(F.count("*").alias("filings"), F.min("row_no").alias("first_row")))
    return (counts.groupBy("archive")
            .agg(F.max(F.struct("filings", (-F.col("first_row")).alias("earliest"), "label")).alias("top"))
            .select("archive", F.col("top.label").alias("label"), F.col("top.filings").alias("filings")))


def period_table(primary: DataFrame) -> DataFrame:
    """Period dimension.  One archive per period is a data-quality rule (see ``ingest_rules``)."""
    return primary.groupBy(C.filing_date(F.col("label")).alias("period")).agg(
        F.min("label").alias("label"), F.min("archive").alias("source_archive"))


def archive_order(submissions: DataFrame) -> DataFrame:
    """Archives ordered by their earliest filing date."""
    return submissions.groupBy("archive").agg(F.min(C.filing_date(F.col("filing_date"))).alias("first_filed"))


def _part_type(submission_type: Column, flagged: Column, amendment: Column) -> Column:
    amended = submission_type.endswith("/A") | F.coalesce(flagged == "Y", F.lit(False))
    named = F.upper(C.strip(F.coalesce(amendment, F.lit(""))))
    return (F.when(~amended & submission_type.startswith(fv.NOTICE_TYPE_PREFIX), "NOTICE")
            .when(~amended, "BASE")
            .when(named.isin("NEW HOLDINGS", "RESTATEMENT"), named)
            .otherwise("UNKNOWN AMENDMENT"))


def filing_events(submissions: DataFrame, covers: DataFrame, summaries: DataFrame, periods: DataFrame) -> DataFrame:
    """One typed row per filing of a known period, with its part type and sort key.

    ``periods`` holds one row per calendar quarter, so broadcasting its labels is bounded by the calendar.
    """
    page = ["archive", "accession_number"]
    kept = (submissions.withColumn("accession_number", C.strip("accession_number"))
            .filter(F.col("submissiontype").startswith(fv.FILING_TYPE_PREFIX))
            .join(F.broadcast(periods.select(F.col("label").alias("periodofreport"), "period")), "periodofreport"))
    cover = last_row_per_accession(covers).drop("row_no")
    summary = last_row_per_accession(summaries).drop("row_no")
    joined = kept.join(cover, page, "left").join(summary, page, "left")
    typed = joined.select(
        F.col("accession_number").alias("accession"),
        C.manager_key(F.col("cik")).alias("cik"), "period",
        C.filing_date(F.col("filing_date")).alias("filing_date"),
        F.col("filing_date").alias("filing_label"),
        F.col("submissiontype").alias("submission_type"),
        _part_type(F.col("submissiontype"), F.col("isamendment"), F.col("amendmenttype")).alias("part_type"),
        C.whole_number(F.col("amendmentno")).alias("amendment_no"),
        F.coalesce("reporttype", F.lit("")).alias("report_type"),
        F.coalesce("filingmanager_name", F.lit("")).alias("manager_name"),
        F.coalesce("filingmanager_stateorcountry", F.lit("")).alias("state_country"),
        F.coalesce(F.col("isconfidentialomitted") == "Y", F.lit(False)).alias("confidential"),
        C.whole_number(F.col("tableentrytotal")).alias("reported_entry_count"),
        C.whole_number(F.col("tablevaluetotal")).alias("reported_value"),
        F.col("archive").alias("source_archive"),
    )
    # A full filing of the same day and number sorts before an addition to it.
    return (typed.withColumn("is_holdings", F.col("submission_type").startswith(fv.HOLDINGS_TYPE_PREFIX))
            .withColumn("order_key", F.struct(
                "filing_date", F.coalesce("amendment_no", F.lit(0)).alias("amendment"),
                F.when(F.col("part_type") == "NEW HOLDINGS", 1).otherwise(0).alias("rank"), "accession")))


_LATEST = ["accession", "filing_date", "filing_label", "report_type", "manager_name", "state_country", "source_archive"]


def group_states(events: DataFrame) -> DataFrame:
    """One row per manager-quarter: latest filing, last reset, and coverage before reconciliation.

    Walking the filings in order, a base, restatement, or unknown amendment starts over and an addition
    appends.  So the parts in force are those at or after the last reset (all of them when nothing resets),
    and the chain is inferred when any amendment was unknown or it opens with an addition.
    """
    holdings = F.col("is_holdings")
    addition = F.col("part_type") == "NEW HOLDINGS"
    latest = F.struct("order_key", *_LATEST)
    grouped = events.groupBy(GROUP).agg(
        F.max(F.when(holdings, latest)).alias("latest_holdings"),
        F.max(latest).alias("latest_any"),
        F.max(F.when(holdings & ~addition, F.col("order_key"))).alias("last_reset"),
        F.min(F.when(holdings, F.struct("order_key", "part_type"))).alias("first_holdings"),
        F.max(F.when(holdings & F.col("confidential"), F.col("order_key"))).alias("last_confidential"),
        F.max(holdings & (F.col("part_type") == "UNKNOWN AMENDMENT")).alias("any_unknown"),
    )
    has_holdings = F.col("latest_holdings").isNotNull()
    inferred = F.col("any_unknown") | (F.col("first_holdings.part_type") == "NEW HOLDINGS")
    confidential = F.col("last_confidential").isNotNull() & (
        F.col("last_reset").isNull() | (F.col("last_confidential") >= F.col("last_reset")))
    chosen = grouped.select(
        *GROUP, "last_reset", F.coalesce("latest_holdings", "latest_any").alias("latest"),
        has_holdings.alias("has_holdings"), inferred.alias("inferred"), confidential.alias("confidential_omitted"))
    status = (F.when(~F.col("has_holdings"), "NOTICE")
              .when(F.col("inferred"), "INFERRED")
              .when(F.col("confidential_omitted") | (F.col("latest.report_type") != fv.FULL_REPORT_TYPE), "PARTIAL")
              .otherwise("COMPLETE"))
    return chosen.select(
        *GROUP, "last_reset", *[F.col(f"latest.{name}").alias(name) for name in _LATEST],
        "confidential_omitted", status.alias("coverage_status"))


def effective_parts(events: DataFrame, groups: DataFrame) -> DataFrame:
    """Filings in force for each manager-quarter, with their reported totals."""
    resets = groups.select(*GROUP, "last_reset")
    joined = events.filter("is_holdings").join(resets, GROUP)
    in_force = F.col("last_reset").isNull() | (F.col("order_key") >= F.col("last_reset"))
    return joined.filter(in_force).select(
        *GROUP, "accession", "part_type", "source_archive", "reported_entry_count", "reported_value")


def observed_totals(lines: DataFrame) -> DataFrame:
    """Rows and value per accession; combined map-side, so a huge filing costs one partial row per task."""
    return lines.groupBy("accession").agg(
        F.count("*").alias("observed_entry_count"), F.sum("value").alias("observed_value"))


def summed_totals(observed: DataFrame) -> DataFrame:
    """Observed totals per accession from those per archive and accession."""
    return observed.groupBy("accession").agg(
        F.sum("observed_entry_count").alias("observed_entry_count"), F.sum("observed_value").alias("observed_value"))


def reconcile_parts(parts: DataFrame, observed: DataFrame) -> DataFrame:
    """Reported against observed totals; a flag is NULL when the filing reports no such total."""
    joined = parts.join(observed, "accession", "left")
    entries = F.coalesce("observed_entry_count", F.lit(0).cast("long"))
    value = F.coalesce("observed_value", F.lit(0).cast("long"))
    flagged = joined.select(
        "accession", *GROUP, "part_type", "source_archive", "reported_entry_count", "reported_value",
        entries.alias("observed_entry_count"), value.alias("observed_value"),
        (F.col("reported_entry_count") == entries).alias("entry_count_matches"),
        (F.col("reported_value") == value).alias("value_matches"))
    mismatch = (F.coalesce(~F.col("entry_count_matches"), F.lit(False))
                | F.coalesce(~F.col("value_matches"), F.lit(False)))
    return flagged.withColumn("has_discrepancy", mismatch)


def manager_periods(groups: DataFrame, part_stats: DataFrame) -> DataFrame:
    """Manager-quarters with part counts and reconciled coverage.

    Besides the published columns the result carries ``reconciled_value`` (what all parts in force add up
    to) and ``downgraded`` (complete before reconciliation, partial after it).
    """
    per_group = part_stats.groupBy(GROUP).agg(
        F.count("*").alias("part_count"), F.sum("observed_value").alias("reconciled_value"),
        F.max("has_discrepancy").alias("discrepant"))
    joined = groups.drop("last_reset").join(per_group, GROUP, "left")
    downgraded = (F.col("coverage_status") == "COMPLETE") & F.coalesce("discrepant", F.lit(False))
    return (joined.withColumn("downgraded", downgraded)
            .withColumn("coverage_status", F.when(F.col("downgraded"), "PARTIAL").otherwise(F.col("coverage_status")))
            .withColumn("part_count", F.coalesce("part_count", F.lit(0).cast("long")))
            .withColumn("reconciled_value", F.coalesce("reconciled_value", F.lit(0).cast("long")))
            .drop("discrepant"))


def manager_dimension(quarters: DataFrame, watchlist: DataFrame | None = None) -> DataFrame:
    """Name and state of each manager's latest quarter; ``starred`` when the watchlist names it.

    The watchlist is validated to twenty rows, which bounds the broadcast.
    """
    latest = quarters.groupBy("cik").agg(
        F.max(F.struct("period", "manager_name", "state_country")).alias("latest"))
    name = F.coalesce(F.nullif(F.col("latest.manager_name"), F.lit("")), F.concat(F.lit("CIK "), F.col("cik")))
    named = latest.select("cik", name.alias("name"), F.col("latest.state_country").alias("state_country"))
    if watchlist is None:
        return named.withColumn("starred", F.lit(False))
    marks = watchlist.select("cik", F.lit(True).alias("starred"))
    return named.join(marks, "cik", "left").withColumn("starred", F.coalesce("starred", F.lit(False)))


def link_periods(periods: DataFrame) -> DataFrame:
    """Each period with its neighbours in the stored list; at most one row per calendar quarter."""
    order = Window.orderBy("period")
    return periods.select("period").distinct().select(
        "period", F.lag("period").over(order).alias("previous_period"),
        F.lead("period").over(order).alias("next_period"))


def manager_context(quarters: DataFrame, periods: DataFrame, totals: DataFrame) -> DataFrame:
    """Every manager-quarter with its total, its neighbours, and whether it is comparable with them.

    ``totals`` is ``cik, period, total_value``.  Added columns: ``from_previous`` / ``to_next`` (complete on
    both sides), ``next_filing_date``.  The window runs over one manager's quarters, which the calendar
    bounds.  Stage the result before joining it to facts: adaptive execution splits a hot key only when
    both sides of the join are read or shuffled directly.
    """
    links = F.broadcast(link_periods(periods))
    timeline = Window.partitionBy("cik").orderBy("period")
    state = F.struct("period", "coverage_status", "filing_date")
    seen = (quarters.select("cik", "period", "coverage_status", "filing_date").join(links, "period")
            .join(totals.select("cik", "period", "total_value"), ["cik", "period"])
            .withColumn("before", F.lag(state).over(timeline))
            .withColumn("after", F.lead(state).over(timeline)))

    def comparable(side: str, neighbour: str) -> Column:
        return F.coalesce(
            (F.col("coverage_status") == "COMPLETE") & (F.col(f"{side}.coverage_status") == "COMPLETE")
            & (F.col(f"{side}.period") == F.col(neighbour)), F.lit(False))

    return seen.select(
        "cik", "period", "coverage_status", "total_value", "filing_date", "previous_period", "next_period",
        comparable("before", "previous_period").alias("from_previous"),
        comparable("after", "next_period").alias("to_next"),
        F.when(F.col("after.period") == F.col("next_period"), F.col("after.filing_date")).alias("next_filing_date"))
