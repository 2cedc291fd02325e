"""Snapshot job: land archives, build every table, validate, publish.

A snapshot is a set of Parquet tables under ``snapshot_id=<id>``.  It becomes current when one manifest
row is appended after validation, so readers see either the old snapshot or the whole new one.  An incremental
build reads the holdings of changed quarters only and shares the others with earlier snapshots (see ``quarters``).
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold import fixed_values as fv
from tallyhold.operators import filings, positions, quality, rollups
from tallyhold.operators.positions import typed_lines
from tallyhold.plans import quarters
from tallyhold.plans.book import Book
from tallyhold.plans.quarters import QUARTERLY
from tallyhold.schemas import KEPT, TABLES, conform
from tallyhold.session import configure, passing, stage
from tallyhold.sources import landed
from tallyhold.sources.archives import stored_bytes
from tallyhold.sources.fingerprints import changed_inputs, fingerprints

_DOCUMENTS = ("ticker_map", "market_caps", "sectors", "watchlist")
_MANIFEST = "snapshot_id string, published_at timestamp, schema_version string"


def book_tables(book: Book, caps: DataFrame, sectors: DataFrame) -> dict[str, DataFrame]:
    frames = {
        "periods": book.periods, "managers": book.managers, "securities": book.securities,
        "market_caps": caps, "sectors": sectors, "manager_periods": book.quarters,
        "effective_filing_parts": book.part_stats, "positions": book.positions,
        "filing_part_stats": book.part_stats, "manager_period_stats": book.manager_period_stats,
        "security_period_stats": book.security_period_stats, "period_stats": book.period_stats,
        "stock_changes": book.stock_changes, "period_change_totals": book.period_change_totals,
        "dashboard_period_stats": book.dashboard_period_stats, "security_weight_stats": book.weights,
    }
    return {name: conform(df, TABLES[name]) for name, df in frames.items()}


def _write(df: DataFrame, path: str, name: str) -> None:
    column = QUARTERLY[name][0] if name in QUARTERLY else None
    if name == "positions":
        # Rebalancing gives each period files of an ordinary size, and cuts a period that is too large.
        (df.hint("rebalance", "period").sortWithinPartitions("period", "cusip", "cik")
         .write.partitionBy("period").parquet(path))
    elif column:
        df.hint("rebalance", column).write.partitionBy(column).parquet(path)
    else:
        df.write.parquet(path)


def _metadata(tables: dict[str, DataFrame], book: Book, manifest: DataFrame, documents: dict[str, DataFrame | None],
              spark: SparkSession) -> DataFrame:
    counts = [tables[table].agg(F.count("*").cast("string").alias("value")).withColumn("key", F.lit(key))
              for key, table in (("period_count", "periods"), ("manager_count", "managers"),
                                 ("security_count", "securities"), ("position_count", "positions"),
                                 ("market_cap_count", "market_caps"), ("sector_count", "sectors"))]
    latest = tables["periods"].agg(F.max_by("label", "period").alias("value")).withColumn("key", F.lit("latest_period"))
    indicators = quality.quality_indicators({**tables, "manager_periods": book.quarters}).withColumn(
        "value", F.col("value").cast("string"))
    hashes = manifest.filter("kind = 'document'").select(F.concat("name", F.lit("_sha256")).alias("key"),
                                                         F.col("sha256").alias("value"))
    archives = manifest.filter("kind = 'archive'").agg(
        F.to_json(F.array_sort(F.collect_list("name"))).alias("source_archives"),
        F.to_json(F.array_sort(F.collect_list(F.struct("name", "sha256")))).alias("source_archive_hashes"))
    archives = archives.unpivot([], ["source_archives", "source_archive_hashes"], "key", "value")
    fixed = spark.createDataFrame(
        [("schema_version", fv.SCHEMA_VERSION), ("snapshot_policy", fv.SNAPSHOT_POLICY),
         ("summary_reconciliation_policy", fv.RECONCILIATION_POLICY)], "key string, value string").unionByName(
        spark.range(1).select(F.lit("built_at").alias("key"), F.current_timestamp().cast("string").alias("value")))
    described = []
    for name, prefix, fields in (("market_caps", "market_cap", ("source", "source_page", "retrieved_at", "currency")),
                                 ("sectors", "sector", ("source", "source_page", "retrieved_at")),
                                 ("watchlist", "fund_watchlist", ("name", "selected_at", "methodology", "sources"))):
        if documents[name] is not None:
            wide = landed.document_fields(documents[name], *fields)
            named = wide.select([F.col(field).alias(f"{prefix}_{field}") for field in fields])
            described.append(named.unpivot([], named.columns, "key", "value"))
    frames = [*counts, latest, indicators, hashes, archives, fixed, *described]
    whole = frames[0].select("key", "value")
    for frame in frames[1:]:
        whole = whole.unionByName(frame.select("key", "value"))
    return conform(whole, TABLES["metadata"])


def build_snapshot(spark: SparkSession, archives: str, output: str, *, ticker_map: str | None = None,
                   market_caps: str | None = None, sectors: str | None = None, watchlist: str | None = None,
                   incremental: bool = False) -> str:
    """Build, validate, and publish a snapshot; returns its id.  Nothing is published when a rule fires.

    Ticker map, market caps, and sectors are JSON documents, or Parquet folders that the enrichment and
    reference-data jobs have written.  An incremental build gives the same tables as a full one; it lands only archives that the
    current snapshot doesn't know and makes only the quarters that differ from it.
    """
    with passing(spark):
        return _built(spark, archives, output, ticker_map, market_caps, sectors, watchlist, incremental)


def _built(spark: SparkSession, archives: str, output: str, ticker_map: str | None, market_caps: str | None, sectors: str | None,
           watchlist: str | None, incremental: bool) -> str:
    configure(spark, stored_bytes(archives))
    paths = dict(zip(_DOCUMENTS, (ticker_map, market_caps, sectors, watchlist)))
    folders = {name: spark.read.parquet(path) for name, path in paths.items() if landed.is_table(spark, path)}
    read = lambda name: landed.read_documents if name == "watchlist" else landed.read_object
    documents = {name: read(name)(spark, path) if path and name not in folders else None for name, path in paths.items()}
    manifest = stage(fingerprints(spark, archives, paths), "inputs")

    def rows(name: str, reader, table: str) -> DataFrame:
        if name in folders:
            return folders[name]
        if documents[name] is None:
            return spark.createDataFrame([], TABLES[table])
        return reader(documents[name])

    tickers = folders.get("ticker_map")
    if tickers is None and ticker_map:
        tickers = landed.ticker_map(documents["ticker_map"])
    watched = landed.watchlist(documents["watchlist"]) if watchlist else None
    snapshot_id = uuid.uuid4().hex
    root = f"{output.rstrip('/')}/snapshot_id={snapshot_id}"
    base = _base(spark, output) if incremental else {}
    found = quarters.land(spark, archives, output, manifest, base.get("inputs"), snapshot_id)
    members = found.members

    book = Book(members["SUBMISSION"], members["COVERPAGE"], members["SUMMARYPAGE"], typed_lines(members["INFOTABLE"]),
                filings.archive_order(members["SUBMISSION"]), tickers, watched, observed=filings.summed_totals(found.observed))
    signed = stage(quarters.signatures(book.part_stats, book.context, found), "signatures")
    changed = quarters.changes(book.periods, base.get("signatures"), signed)
    needed = sorted({*found.fresh, *quarters.archives_of(book.part_stats, found.observed, changed.holdings)})
    holdings = quarters.only_archives(members["INFOTABLE"], needed)
    quality.require(quality.ingest_rules({**members, "INFOTABLE": holdings}, book.part_stats), "Source validation")
    if watched is not None:
        quality.require(quality.watchlist_rule(watched, book.managers), "Watchlist validation")

    # From here on the book has the holdings of the changed quarters only.
    book.lines, book.only = typed_lines(holdings), tuple(changed.holdings)
    layout = stage(quarters.new_layout(spark, book.periods, base.get("layout"), changed, snapshot_id), "layout")
    wide = book.wide_positions
    if changed.stored:
        stored = quarters.read_quarters(spark, output, base["layout"], "positions")
        others = quarters.positions_with_context(stored, book.context, changed.stored)
        wide = wide.select(others.columns).unionByName(others)
    of = lambda df, column, which: df.filter(F.col(column).isin(which)) if which else df.filter(F.lit(False))
    made = {
        "positions": book.positions, "spellings": book.first_names("period"),
        "manager_period_stats": of(rollups.manager_period_stats(book.quarters, book.wide_positions), "period", changed.holdings),
        "security_period_stats": rollups.security_period_stats(book.wide_positions),
        "stock_changes": of(rollups.stock_changes(wide), "current_period", changed.compared),
        "security_weight_stats": of(rollups.security_weight_stats(wide, book.dashboard_period_stats), "period", changed.compared)}
    for name, df in made.items():
        _write(conform(df, (TABLES | KEPT)[name]), f"{root}/{name}", name)
    layout.write.parquet(f"{root}/layout")
    signed.write.parquet(f"{root}/signatures")
    kept = {name: quarters.read_quarters(spark, output, layout, name) for name in QUARTERLY}
    securities = stage(positions.security_dimension(kept["spellings"], book.archives, tickers), "securities")
    whole = {
        "periods": book.periods, "managers": book.managers, "securities": securities,
        "market_caps": rows("market_caps", landed.market_caps, "market_caps"), "sectors": rows("sectors", landed.sectors, "sectors"),
        "manager_periods": book.quarters, "effective_filing_parts": book.part_stats, "filing_part_stats": book.part_stats,
        "period_stats": rollups.period_stats(book.periods, book.quarters, kept["manager_period_stats"], kept["security_period_stats"]),
        "period_change_totals": book.period_change_totals, "dashboard_period_stats": book.dashboard_period_stats}
    for name, df in whole.items():
        _write(conform(df, TABLES[name]), f"{root}/{name}", name)
    tables = _tables(spark, output, root, [name for name in TABLES if name not in ("metadata", "fund_scores", "scope_values")])
    _metadata(tables, book, manifest, documents, spark).write.parquet(f"{root}/metadata")
    found.inputs.write.parquet(f"{root}/inputs")
    tables["metadata"] = spark.read.schema(TABLES["metadata"]).parquet(f"{root}/metadata")
    expected = members["SUBMISSION"].select("archive").distinct().count()
    quality.require(quality.snapshot_rules(tables, expected), "Snapshot validation")
    moved = changed_inputs(manifest, fingerprints(spark, archives, paths))
    if not moved.isEmpty():
        raise ValueError("An input changed while the snapshot was built")
    (spark.range(1).select(F.lit(snapshot_id).alias("snapshot_id"), F.current_timestamp().alias("published_at"),
                           F.lit(fv.SCHEMA_VERSION).alias("schema_version"))
     .write.mode("append").parquet(f"{output.rstrip('/')}/manifest"))
    return snapshot_id


def _base(spark: SparkSession, output: str) -> dict[str, DataFrame]:
    """What an incremental build needs of the current snapshot; nothing when there is none of this schema version."""
    try:
        published = spark.read.schema(_MANIFEST).parquet(f"{output.rstrip('/')}/manifest")
    except AnalysisException:  # nothing was published yet
        return {}
    if published.agg(F.max_by("schema_version", "published_at")).first()[0] != fv.SCHEMA_VERSION:
        return {}
    root = current_snapshot(spark, output)
    return {name: spark.read.parquet(f"{root}/{name}") for name in ("inputs", "signatures", "layout")}


def _tables(spark: SparkSession, output: str, root: str, names) -> dict[str, DataFrame]:
    layout = spark.read.schema(KEPT["layout"]).parquet(f"{root}/layout")
    return {name: quarters.read_quarters(spark, output, layout, name) if name in QUARTERLY
            else spark.read.schema(TABLES[name]).parquet(f"{root}/{name}") for name in names}


def current_snapshot(spark: SparkSession, output: str) -> str:
    """Root folder of the latest published snapshot."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{output.rstrip('/')}/manifest")
    latest = manifest.agg(F.max_by("snapshot_id", "published_at")).first()[0]
    return f"{output.rstrip('/')}/snapshot_id={latest}"


def read_snapshot(spark: SparkSession, output: str) -> dict[str, DataFrame]:
    """Tables of the current snapshot."""
    root = current_snapshot(spark, output)
    return _tables(spark, output, root, [name for name in TABLES if name not in ("fund_scores", "scope_values")])


def snapshot_is_current(spark: SparkSession, output: str, archives: str, *, trust: bool = False,
                        **paths: str | None) -> bool:
    """True when schema version and, unless trusted, every input hash match the current snapshot."""
    try:
        root = current_snapshot(spark, output)
        stored = spark.read.schema(TABLES["metadata"]).parquet(f"{root}/metadata")
        if stored.filter((F.col("key") == "schema_version") & (F.col("value") == fv.SCHEMA_VERSION)).isEmpty():
            return False
        if trust:
            return True
        before = spark.read.parquet(f"{root}/inputs")
        documents = {name: paths.get(name) for name in _DOCUMENTS}
        return changed_inputs(before, fingerprints(spark, archives, documents)).isEmpty()
    except Exception:  # an unreadable snapshot is simply not current
        return False
