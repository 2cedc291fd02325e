"""Time the headline queries and print one JSON line.

Jobs (book build, signals, enrichment, quality) are timed once, from the raw tables.  Views follow the usual
budget check: one warm-up, then the median of two timed runs.  Results go to Spark's no-op sink, so every
row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

import catalog  # noqa: E402
from tallyhold.operators import rollups  # noqa: E402
from tallyhold.sources.warehouse import Warehouse  # noqa: E402

VIEWS = ("top_holdings", "fresh_initiations", "movers_gainers_h1", "movers_losers_h2", "price_sort_ytd", "snapshot_summary")
QUERIES = ("stock_changes", "period_change_totals", "asof_on_or_before",
           "asof_first_after", "typed_holdings_rows", "nearest_split_factor", "issuer_keys", "sector_merge")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    run(Warehouse(spark, folder).table("nation"))  # starts the executor threads

    def book_build() -> None:
        book = catalog.book(spark, folder)
        for table in (book.periods, book.managers, book.securities, book.quarters, book.positions, book.part_stats,
                      book.manager_period_stats, book.security_period_stats, book.period_stats, book.stock_changes,
                      book.period_change_totals, book.dashboard_period_stats, book.weights):
            run(table)

    def signal_build() -> None:
        made = catalog.signal_tables(spark, folder)
        run(made["fund_scores"])
        run(made["scope_values"])

    times = {"book_build": timed(book_build),
             "price_bars": timed(lambda: run(catalog.bars(spark, folder))),
             "signal_build": timed(signal_build),
             "enrichment": timed(lambda: run(catalog.QUERIES["ticker_mapping"](spark, folder))),
             "quality_kpis": timed(lambda: run(catalog.QUERIES["quality_kpis"](spark, folder)))}
    # Operators over the written tables, and the jobs over them.
    book = catalog.book(spark, folder)
    times["weights_operator"] = timed(lambda: run(rollups.security_weight_stats(book.wide_positions, book.dashboard_period_stats)))
    times["period_stats_operator"] = timed(lambda: run(rollups.period_stats(
        book.periods, book.quarters, book.manager_period_stats, book.security_period_stats)))
    times["signal_job"] = timed(lambda: run(catalog.QUERIES["fund_scores_job"](spark, folder)))
    times["quality_rules"] = timed(lambda: run(catalog.QUERIES["quality_rules"](spark, folder)))
    for name in QUERIES:
        times[name] = timed(lambda: run(catalog.QUERIES[name](spark, folder)))
    for name in VIEWS:
        run(catalog.QUERIES[name](spark, folder))
        times[name] = statistics.median(timed(lambda: run(catalog.QUERIES[name](spark, folder))) for _ in range(2))
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": scale}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
