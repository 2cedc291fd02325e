"""Ticker enrichment job: seed, exact lookups, name matches, final mapping, fill-only update.

Lookups themselves happen outside: the job names the securities worth asking about and takes the landed
answers of an earlier round.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhold.operators import quality, resolve, rollups
from tallyhold.session import configure, scanned_bytes, stage


@dataclass(frozen=True)
class Enrichment:
    candidates: DataFrame
    records: DataFrame
    mapping: DataFrame
    statistics: DataFrame
    fill_actions: DataFrame
    securities: DataFrame


def enrich(tables: dict[str, DataFrame], records: DataFrame, overrides: DataFrame, *, exchange: str, at: str,
           limit: int, results: DataFrame | None = None, identities: DataFrame | None = None,
           refresh: bool = False, output: str | None = None) -> Enrichment:
    """Run one enrichment round.  Record tables are staged between rounds of joins.

    With ``output``, every table of the round is written there as Parquet; the next round takes its ``records``, and a
    snapshot its ``mapping`` as the ticker map.
    """
    spark = tables["periods"].sparkSession
    configure(spark, scanned_bytes(tables["securities"], tables["security_period_stats"], records))
    latest = tables["periods"].agg(F.max("period")).first()[0]
    securities = stage(resolve.normalised_securities(rollups.security_relevance(
        tables["securities"], tables["security_period_stats"], latest)), "relevant_securities")
    records = stage(resolve.canonical_records(records), "records")
    overrides = stage(resolve.canonical_overrides(overrides), "overrides")
    seeded = stage(resolve.apply_seeds(records, resolve.seed_actions(securities, records, overrides)), "records")
    candidates = resolve.lookup_candidates(securities, seeded, limit=limit, exchange=exchange, refresh=refresh)
    current = seeded
    if results is not None:
        fresh = resolve.resolve_results(securities, results, exchange=exchange, checked_at=at)
        current = stage(resolve.merge_records(seeded, fresh), "records")
    if identities is not None:
        quality.require(quality.threshold_rules(resolve.identity_rule(identities).withColumn(
            "rule", F.lit("valid company identities"))), "Company-ticker file")
        matches = resolve.name_matches(securities, resolve.safe_name_index(identities))
        current = stage(resolve.supplement_by_name(current, matches, matched_at=at), "records")
    mapping = stage(resolve.final_mapping(current, overrides), "mapping")
    made = Enrichment(
        candidates, current, mapping, resolve.cache_statistics(current, overrides),
        resolve.fill_actions(securities, mapping), resolve.fill_tickers(tables["securities"], mapping))
    if output is None:
        return made
    written = {}
    for field in fields(made):
        path = f"{output.rstrip('/')}/{field.name}"
        getattr(made, field.name).write.parquet(path)
        written[field.name] = spark.read.parquet(path)
    return Enrichment(**written)
