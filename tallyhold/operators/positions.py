"""Holdings rows to merged positions and the security dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhold import fixed_values as fv
from tallyhold.functions import columns as C

POSITION_KEY = ["cik", "period", "cusip", "position_type", "shares_type"]
CONTEXT = ["coverage_status", "total_value", "filing_date", "previous_period", "next_period",
           "from_previous", "to_next", "next_filing_date"]


def _code(c, codes: dict[str, int], other: int):
    text = F.upper(C.strip(F.coalesce(c, F.lit(""))))
    coded = F.lit(other)
    for word, number in codes.items():
        coded = F.when(text == word, number).otherwise(coded)
    return coded.cast("int")


def typed_lines(infotable: DataFrame) -> DataFrame:
    """Raw holdings rows with typed values.  Rejected text is counted by ``ingest_rules``, never dropped."""
    return infotable.select(
        "archive", "row_no",
        C.strip(F.coalesce("accession_number", F.lit(""))).alias("accession"),
        C.security_key(F.col("cusip")).alias("cusip"),
        _code(F.col("putcall"), fv.POSITION_TYPES, 0).alias("position_type"),
        _code(F.col("sshprnamttype"), fv.SHARES_TYPES, 2).alias("shares_type"),
        F.coalesce(C.whole_number(F.col("value")), F.lit(0).cast("long")).alias("value"),
        C.finite_number(F.col("sshprnamt")).alias("shares"),
        F.coalesce("nameofissuer", F.lit("")).alias("issuer"),
        F.coalesce("titleofclass", F.lit("")).alias("class"),
        F.coalesce("figi", F.lit("")).alias("figi"),
    )


def effective_lines(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Holdings rows of filings in force, tagged with manager and period.

    An accession may hold a third of all rows: this is an inner sort-merge join with the holdings rows on
    the splittable side, so adaptive execution cuts a hot accession into ordinary-sized tasks.
    """
    return lines.join(parts, "accession")


def merge_positions(lines: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """Sum duplicate rows of one position; ``carried`` columns depend on (cik, period) and ride along.

    Value always sums.  Shares stay NULL for a single row without shares, but a merge of several rows
    treats missing shares as zero.  Of lines with a ``name_row`` (see ``with_name_row``) the greatest is kept.
    """
    named = [F.max("name_row").alias("name_row")] if "name_row" in lines.columns else []
    merged = lines.groupBy(*POSITION_KEY, *(carried or [])).agg(
        F.count("*").alias("rows"), F.sum("value").alias("value"), F.sum("shares").alias("known_shares"), *named)
    shares = F.when(F.col("rows") == 1, F.col("known_shares")).otherwise(F.coalesce("known_shares", F.lit(0.0)))
    return merged.select(*POSITION_KEY, *(carried or []), "value", shares.alias("shares"), *(["name_row"] if named else []))


def with_context(positions: DataFrame, context: DataFrame) -> DataFrame:
    """Attach (staged) manager-quarter context to plain positions, for tables not built with it."""
    return positions.join(context, ["cik", "period"])


#: Rows of an archive number less than 2 ** NAME_BITS.
NAME_BITS = 42


def ranked_archives(archives: DataFrame) -> DataFrame:
    """``archive, archive_rank`` by first filing date; archives number one per reporting quarter, so one task ranks them."""
    return archives.select("archive", F.row_number().over(Window.orderBy("first_filed", "archive")).cast("long").alias("archive_rank"))


def with_name_row(lines: DataFrame) -> DataFrame:
    """Lines (``archive_rank, row_no``) with one long that is greatest for the first row of the last archive.

    A maximum of longs is a hash aggregate, so the row that names a security is found while its positions are added up.
    """
    return lines.withColumn("name_row", F.shiftleft("archive_rank", NAME_BITS) - F.col("row_no")).drop("archive_rank")


def first_names(best: DataFrame, lines: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows that ``best`` (keys with ``cusip``, and ``name_row``) points at: keys, archive, row_no, issuer, class, figi.

    One row per security is looked up, so the lines are the side that need not move.
    """
    rank = F.shiftright(F.col("name_row") + ((1 << NAME_BITS) - 1), NAME_BITS)
    wanted = (best.withColumn("archive_rank", rank).withColumn("row_no", F.shiftleft("archive_rank", NAME_BITS) - F.col("name_row"))
              .join(F.broadcast(ranks), "archive_rank").drop("archive_rank", "name_row"))
    place = ["cusip", "row_no", *(["archive"] if "archive" in lines.columns else [])]
    names = F.max(F.struct("issuer", "class", "figi")).alias("names")
    keys = [c for c in wanted.columns]
    return wanted.join(lines.select(*place, "issuer", "class", "figi"), place).groupBy(*keys).agg(names).select(
        *keys, "names.issuer", "names.class", "names.figi")


def security_dimension(lines: DataFrame, archives: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Issuer, class, and FIGI from the first effective row of the last archive that holds the security.

    Rows are first reduced to distinct spellings with a hash aggregate, so the structs that decide between
    them stay few however popular a security is.  Archives number one per reporting quarter, which bounds
    the broadcast.
    """
    spelling = ["cusip", "archive", "issuer", "class", "figi"]
    spellings = lines.groupBy(*spelling).agg(F.min("row_no").alias("row_no")).join(F.broadcast(archives), "archive")
    rank = F.struct("first_filed", "archive", (-F.col("row_no")).alias("earliest"), "issuer", "class", "figi")
    best = spellings.groupBy("cusip").agg(F.max(rank).alias("best"))
    named = best.select("cusip", "best.issuer", "best.class", "best.figi")
    if tickers is None:
        return named.withColumn("ticker", F.lit(""))
    return named.join(tickers.select("cusip", "ticker"), "cusip", "left").withColumn(
        "ticker", F.coalesce("ticker", F.lit("")))
