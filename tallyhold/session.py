"""Session settings and the shared staging area.

Nothing here caches in executor memory: a staged table is a Parquet directory in the shared folder
the cluster names in ``spark.checkpoint.dir``, so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# One random name per Python process and application keeps concurrent runs apart.
_RUN_TOKEN = uuid.uuid4().hex[:12]
_LOCAL_ROOTS: dict[str, str] = {}

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins here are often followed by a grouping on a superset of the join keys.  Without this
    # setting Spark would keep the join's partitioning for that grouping and leave a hot key in one task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


# One rule for every job: shuffles start with one partition per FINE_BYTES of stored input, as compressed columns grow some
# thirty times until a task sorts them, up to FINE_PARTITIONS; very large inputs have one per PARTITION_BYTES.  Adaptive
# execution merges the partitions that turn out small.
PARTITION_BYTES = 256 * 1024 * 1024
FINE_BYTES, FINE_PARTITIONS = 8 * 1024 * 1024, 10_000
_INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Bytes at most, unless the session asks for less: what merged partitions hold, and from when on one may count as skewed.
#: A task sorts some ten times what it reads, and a task that sorts more than its share of memory spills.
_AT_MOST = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 * 1024 * 1024,
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": 64 * 1024 * 1024,
}


def bytes_of(setting: str | None) -> float:
    """Bytes of a size as sessions spell it (``64MB``, ``8m``, ``1024``); infinite if it is not set or not readable."""
    found = re.fullmatch(r"(\d+)([kmgtp]?)b?", (setting or "").strip().lower())
    return int(found[1]) * 1024 ** " kmgtp".index(found[2] or " ") if found else float("inf")


def configure(spark: SparkSession, input_bytes: int = 0) -> SparkSession:
    """Apply the runtime settings every job relies on; returns the same session.

    ``input_bytes`` (stored size of the inputs) raises the number of shuffle partitions for large inputs;
    it never lowers what the session already asks for.
    """
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, most in _AT_MOST.items():
        if bytes_of(spark.conf.get(key, None)) > most:
            spark.conf.set(key, str(most))
    more_partitions(spark, input_bytes)
    return spark


def more_partitions(spark: SparkSession, input_bytes: int) -> None:
    """Raise the number of partitions that shuffles start with to what inputs of this stored size need."""
    wanted = max(-(-input_bytes // PARTITION_BYTES), min(-(-input_bytes // FINE_BYTES), FINE_PARTITIONS))
    current = spark.conf.get(_INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions")
    if wanted > int(current):
        spark.conf.set(_INITIAL_PARTITIONS, str(wanted))


def scanned_bytes(*frames: DataFrame) -> int:
    """Stored size of the tables that the frames scan, as far as Spark knows it."""
    total = 0
    for frame in frames:
        leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
        total += sum(size for size in sizes if size < 1 << 60)  # what Spark doesn't know counts as huge there
    return total


def staging_root(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's checkpoint folder, or a fresh temporary one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    application = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/tallyhold-{application}-{_RUN_TOKEN}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach")
    if application not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="tallyhold-")
    return _LOCAL_ROOTS[application]


#: What is staged inside a ``passing`` block, innermost last.
_PASSING: list[list[str]] = []
#: Shuffle files go when the query that made them ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing(spark: SparkSession):
    """A job that writes all it keeps elsewhere: what it stages, and the files of its shuffles, go as soon as nothing reads them."""
    before, mine = spark.conf.get(_CLEANUP, None), []
    spark.conf.set(_CLEANUP, "true")
    _PASSING.append(mine)
    try:
        yield
    finally:
        _PASSING.remove(mine)
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
        for path in mine:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this application has written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the staging area and return a reader of the written table."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    if _PASSING:
        _PASSING[-1].append(path)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
