"""Reference-data refresh: landed screener documents to written market caps, sectors, and sector values."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession

from tallyhold.operators import quality, reference
from tallyhold.schemas import TABLES, conform
from tallyhold.session import configure, stage
from tallyhold.sources import landed


def refresh_reference(spark: SparkSession, stocks: str, funds: str | None, output: str, *, with_sectors: bool = True) -> dict[str, DataFrame]:
    """Write ``market_caps``, ``sectors``, and ``sector_values`` under ``output`` as Parquet and return readers of them.

    The job stops when the stock document has too few symbols or market caps.  Funds are best effort: without a
    readable fund document the sectors are those of the stocks alone.
    """
    configure(spark)
    root = output.rstrip("/")
    stock_rows = stage(landed.screener_rows(landed.read_documents(spark, stocks)), "stock_rows")
    caps = stage(conform(reference.market_caps(stock_rows), TABLES["market_caps"]), "caps")
    quality.require(quality.threshold_rules(reference.screener_rules(stock_rows, caps)), "Reference refresh")
    caps.write.parquet(f"{root}/market_caps")
    names = ["market_caps"]
    if with_sectors:
        fund_rows = stock_rows.limit(0)
        if funds:
            try:
                fund_rows = stage(landed.screener_rows(landed.read_documents(spark, funds)), "fund_rows")
            except Exception as reason:  # stocks alone are still useful
                warnings.warn(f"No fund rows ({type(reason).__name__}); writing stock sectors only", stacklevel=2)
        conform(reference.sector_map(stock_rows, fund_rows), TABLES["sectors"]).write.parquet(f"{root}/sectors")
        reference.sector_values(spark.read.parquet(f"{root}/sectors")).write.parquet(f"{root}/sector_values")
        names += ["sectors", "sector_values"]
    return {name: spark.read.parquet(f"{root}/{name}") for name in names}
