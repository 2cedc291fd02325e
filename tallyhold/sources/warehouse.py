"""Adapter: reads an orders/lineitem warehouse as if it were a set of holdings filings.

Every order is one filing, every line one holdings row, fifteen neighbouring customers a manager, and
thirty-three neighbouring parts a security, so managers and securities grow with the tables.  Filing-level
members keep the raw text form of an archive, so the same parsers run.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold.functions import columns as C

CUSTOMERS_PER_MANAGER = 15
PARTS_PER_SECURITY = 33
MARK_DATE = "2001-09-03"


def _text(c: Column) -> Column:
    return c.cast("string")


def _accession(c: Column) -> Column:
    return F.lpad(_text(c), 10, "0")


def manager_number(customer_key: Column) -> Column:
    return F.floor(customer_key / CUSTOMERS_PER_MANAGER)


def security_number(part_key: Column) -> Column:
    return F.floor(part_key / PARTS_PER_SECURITY)


def cusip_of(number: Column) -> Column:
    return F.lpad(_text(number), 9, "0")


def ticker_of(number: Column) -> Column:
    return F.when(number % 11 == 0, "").otherwise(F.concat(F.lit("T"), _text(number)))


@dataclass(frozen=True)
class Warehouse:
    """Lazy views over the Parquet tables in ``folder``."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")

    @cached_property
    def _filings(self) -> DataFrame:
        day = F.to_date("o_orderdate")
        key = F.col("o_orderkey")
        filed = F.date_add(day, 92)
        kind = (F.when(key % 17 == 3, "13F-NT").when(F.month(day) % 3 == 1, "13F-HR").otherwise("13F-HR/A"))
        return self.table("orders").select(
            key, manager_number(F.col("o_custkey")).alias("manager"), filed.alias("filed"), kind.alias("kind"),
            F.last_day(F.add_months(F.trunc(day, "quarter"), 2)).alias("period"),
            F.concat(_text(F.year(filed)), F.lit("q"), _text(F.quarter(filed)), F.lit("_form13f.zip"))
            .alias("archive"))

    @property
    def submissions(self) -> DataFrame:
        return self._filings.select(
            "archive", F.col("o_orderkey").alias("row_no"),
            _accession(F.col("o_orderkey")).alias("accession_number"),
            _text(F.col("manager")).alias("cik"), F.col("kind").alias("submissiontype"),
            C.date_label(F.col("period")).alias("periodofreport"), C.date_label(F.col("filed")).alias("filing_date"))

    @property
    def covers(self) -> DataFrame:
        """One cover per filing; some filings have none, and some repeat theirs (only the last row counts)."""
        key = F.col("o_orderkey")
        amendment = (F.when(key % 10 == 0, " Restatement ").when(key % 50 == 7, "").otherwise("NEW HOLDINGS"))
        page = self._filings.filter(key % 97 != 11)
        rows = page.withColumn("copy", F.explode(
            F.when(key % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
        return rows.select(
            "archive", (key * 2 + F.col("copy")).alias("row_no"), _accession(key).alias("accession_number"),
            F.when(key % 19 == 5, "Y").otherwise("N").alias("isamendment"),
            F.when(F.col("copy") == 0, "STALE").otherwise(amendment).alias("amendmenttype"),
            F.when(key % 5 == 0, "").otherwise(_text(key % 5)).alias("amendmentno"),
            F.when(key % 29 == 0, "13F COMBINATION REPORT").otherwise("13F HOLDINGS REPORT").alias("reporttype"),
            F.when(F.col("manager") % 100 == 9, "")
            .otherwise(F.concat(F.lit("Manager "), _text(F.col("manager")))).alias("filingmanager_name"),
            F.when(F.col("manager") % 2 == 0, "NY").otherwise("CA").alias("filingmanager_stateorcountry"))

    @property
    def observed(self) -> DataFrame:
        return self.lines.groupBy("accession").agg(F.count("*").alias("entries"), F.sum("value").alias("total"))

    @property
    def summaries(self) -> DataFrame:
        """Reported totals: exact for most filings, one entry too many for some, absent for others."""
        key = F.col("o_orderkey")
        joined = self._filings.withColumn("accession", _accession(key)).join(self.observed, "accession", "left")
        entries = F.coalesce("entries", F.lit(0)) + F.when(key % 23 == 0, 1).otherwise(0)
        return joined.select(
            "archive", key.alias("row_no"), F.col("accession").alias("accession_number"),
            F.when(key % 41 == 0, "Y").otherwise("N").alias("isconfidentialomitted"),
            F.when(key % 31 == 0, F.lit(None)).otherwise(_text(entries)).alias("tableentrytotal"),
            F.when(key % 53 == 1, "").otherwise(
                _text(F.coalesce("total", F.lit(0)) + F.when(key % 47 == 0, 1).otherwise(0))).alias("tablevaluetotal"))

    @cached_property
    def lines(self) -> DataFrame:
        """Holdings rows, already typed (the warehouse stores numbers, not text)."""
        number = security_number(F.col("l_partkey"))
        option = F.when(F.col("l_returnflag") != "R", 0).when(F.col("l_linestatus") == "F", 1).otherwise(2)
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_no"),
            _accession(F.col("l_orderkey")).alias("accession"), cusip_of(number).alias("cusip"),
            option.cast("int").alias("position_type"),
            F.when(F.col("l_linenumber") % 7 == 0, 1).otherwise(0).cast("int").alias("shares_type"),
            F.floor("l_extendedprice").cast("long").alias("value"),
            F.when(F.col("l_orderkey") % 37 != 0, F.col("l_quantity")).alias("shares"),
            F.concat(F.lit("HOLDING CO "), _text(number), F.lit(" & SONS "), _text(F.col("l_suppkey") % 7))
            .alias("issuer"),
            F.when(F.col("l_linestatus") == "F", "COM").otherwise("CL A").alias("class"),
            F.lit("").alias("figi"))

    @property
    def raw_lines(self) -> DataFrame:
        """The same holdings rows as archive text, with the number spellings that filers use."""
        key = F.col("l_orderkey")
        whole = _text(F.floor("l_extendedprice").cast("long"))
        value = (F.when(key % 5 == 0, F.concat(whole, F.lit(".0"))).when(key % 5 == 1, F.concat(F.lit(" "), whole))
                 .when(key % 43 == 2, "").otherwise(whole))
        return self.table("lineitem").select(
            F.lit("").alias("archive"), (key * 8 + F.col("l_linenumber")).alias("row_no"),
            F.concat(F.lit(" "), _accession(key), F.lit(" ")).alias("accession_number"),
            F.concat(F.lit("x"), F.lpad(_text(security_number(F.col("l_partkey"))), 8, "0"), F.lit(" ")).alias("cusip"),
            F.lit("ISSUER").alias("nameofissuer"), F.lit("COM").alias("titleofclass"), F.lit("").alias("figi"),
            value.alias("value"),
            F.when(key % 37 == 0, " ").otherwise(_text(F.col("l_quantity").cast("long"))).alias("sshprnamt"),
            F.when(F.col("l_linenumber") == 7, "Other").when(F.col("l_linenumber") == 6, "prn ").otherwise("sh")
            .alias("sshprnamttype"),
            F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "F", " put").otherwise("Call"))
            .otherwise("").alias("putcall"))

    @property
    def members(self) -> dict[str, DataFrame]:
        """All filings as the members of archives: text, and the holdings rows in the archive of their filing."""
        held = self.lines.join(self.submissions.select(F.col("accession_number").alias("accession"), "archive"), "accession")
        info = held.select(
            "archive", "row_no", F.col("accession").alias("accession_number"), "cusip", F.col("issuer").alias("nameofissuer"),
            F.col("class").alias("titleofclass"), "figi", _text(F.col("value")).alias("value"), _text(F.col("shares")).alias("sshprnamt"),
            F.when(F.col("shares_type") == 1, "PRN").otherwise("SH").alias("sshprnamttype"),
            F.when(F.col("position_type") == 1, "Put").when(F.col("position_type") == 2, "Call").otherwise("").alias("putcall"))
        return {"SUBMISSION": self.submissions, "COVERPAGE": self.covers, "SUMMARYPAGE": self.summaries, "INFOTABLE": info}

    @property
    def archives(self) -> DataFrame:
        return self._filings.groupBy("archive").agg(F.min("filed").alias("first_filed"))

    @property
    def watchlist(self) -> DataFrame:
        """Twenty managers: every fifth of the first hundred."""
        return self.spark.range(0, 100, 5).select(F.lpad(_text(F.col("id")), 10, "0").alias("cik"))

    @property
    def tickers(self) -> DataFrame:
        numbers = self.table("part").select(security_number(F.col("p_partkey")).alias("n")).distinct()
        return numbers.select(cusip_of(F.col("n")).alias("cusip"), ticker_of(F.col("n")).alias("ticker"))

    @property
    def sectors(self) -> DataFrame:
        """Screener sectors: lower-case tickers (matching ignores ASCII case), some without a name."""
        numbers = self.table("part").select(security_number(F.col("p_partkey")).alias("n")).distinct()
        return numbers.filter("n % 11 != 0 and n % 4 != 0").select(
            F.lower(ticker_of(F.col("n"))).alias("ticker"),
            F.when(F.col("n") % 3 == 0, "Technology").otherwise("Finance").alias("sector"),
            F.when(F.col("n") % 5 == 0, "").otherwise(F.concat(F.lit("Listed Company "), _text(F.col("n"))))
            .alias("name"))

    @property
    def trusted(self) -> DataFrame:
        """Exact tickers for most securities; every seventh has only a name match and is not trusted."""
        return self.tickers.filter((F.col("ticker") != "") & (F.col("cusip").cast("int") % 7 != 0))

    @cached_property
    def bars(self) -> DataFrame:
        """Weekly closes: volume-weighted unit price of each security in each ship week (exact sums)."""
        number = security_number(F.col("l_partkey"))
        week = F.to_date(F.date_trunc("week", F.col("l_shipdate")))
        cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(20,0)")
        units = F.col("l_quantity").cast("decimal(20,0)")
        sums = (self.table("lineitem").filter(number % 11 != 0)
                .groupBy(number.alias("n"), week.alias("price_date"))
                .agg(F.sum(cents).alias("cents"), F.sum(units).alias("units")))
        # Whole ten-thousandths, halves up, in exact integers: no engine-dependent rounding of ties.
        ticks = F.expr("(cents * 200 + units) div (units * 2)")
        return sums.select(ticker_of(F.col("n")).alias("symbol"), "price_date", (ticks / 10000.0).alias("close"))
