"""Keyed tables whose versions share files: an upsert rewrites only the files that its keys may lie in.

A version is a folder with the data files that it added and ``files``, the list of all files that make it up, with the cluster and the
range of keys of each.  The files of a cluster (a month of bars, say) are sorted by key, so a batch of keys hits few of them: those
of its clusters whose ranges hold one of its keys.  Hit files are read, merged, and written anew; all others are listed again as they are.
A version is complete once ``files`` is written, and never changes; a version that failed half-way has no such list and is not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold.session import stage

_FILES = "files"


def _ranges(data: DataFrame, cluster: str, keys: list[str]) -> DataFrame:
    """One row per file: its cluster, smallest and largest keys, and rows."""
    return data.groupBy(F.input_file_name().alias("file"), F.col(cluster).alias("cluster")).agg(
        *[F.min(k).alias(f"low_{k}") for k in keys], *[F.max(k).alias(f"high_{k}") for k in keys], F.count("*").alias("rows"))


def _written(rows: DataFrame, path: str, cluster: str, keys: list[str]) -> DataFrame:
    """``rows`` as files sorted by key, each of one cluster and of an ordinary size; a reader of them."""
    part = "of_cluster"  # the cluster itself stays in the files, so that they can be read one by one
    dealt = rows.withColumn(part, F.col(cluster)).hint("rebalance", part)
    dealt.sortWithinPartitions(part, *keys).write.partitionBy(part).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{part}=*")


def is_keyed(spark: SparkSession, path: str) -> bool:
    """True when there is a finished version at ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{_FILES}/_SUCCESS")
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder))


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{_FILES}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a version."""
    listed = [row.file for row in files(spark, path).select("file").collect()]  # what a scan lists on the driver anyway
    return spark.read.parquet(*listed) if listed else spark.read.parquet(f"{path.rstrip('/')}/empty")


def create(rows: DataFrame, path: str, cluster: str, keys: list[str]) -> None:
    """The first version of a table; keys are unique in ``rows``."""
    _publish(rows, None, path, cluster, keys)


def upsert(base: str, fresh: DataFrame, path: str, cluster: str, keys: list[str]) -> list[str]:
    """A version with the rows of ``fresh`` (unique keys) in place of, or beside, those at ``base``; the files that were rewritten."""
    spark = fresh.sparkSession
    fresh = stage(fresh, "upsert")
    old = files(spark, base)
    within = reduce(lambda a, b: a & b, [F.col(k).between(F.col(f"low_{k}"), F.col(f"high_{k}")) for k in keys])
    hit = stage(old.join(fresh.select(F.col(cluster).alias("cluster"), *keys), "cluster").filter(within).select("file").distinct(), "upsert-hit")
    names = [row.file for row in hit.collect()]  # at most one per file
    merged = fresh
    if names:
        kept = spark.read.schema(fresh.schema).parquet(*names).join(fresh.select(*keys), keys, "left_anti")
        merged = kept.select(*fresh.columns).unionByName(fresh)
    _publish(merged, old.join(hit, "file", "left_anti"), path, cluster, keys)
    return names


def _publish(rows: DataFrame, others: DataFrame | None, path: str, cluster: str, keys: list[str]) -> None:
    root = path.rstrip("/")
    rows.limit(0).write.parquet(f"{root}/empty")
    if rows.isEmpty():
        listed = _ranges(rows.limit(0), cluster, keys)
    else:
        listed = _ranges(_written(rows, f"{root}/data", cluster, keys), cluster, keys)
    (listed if others is None else others.unionByName(listed)).write.parquet(f"{root}/{_FILES}")
