"""Sorted text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sorted_json(df: DataFrame, path: str, *keys: str) -> None:
    """JSON lines sorted by key across the part files: range-partitioned, never through one task."""
    df.orderBy(*keys).write.json(path)


def write_sorted_object(df: DataFrame, path: str, key: str, value: str, part: str | None = None) -> None:
    """One JSON object, its members sorted by key, across the part files; joined in the order of their names they are the text.

    With ``part`` the members are those of an object of that name.  Null keys are left out; a null value is JSON null; keys must
    differ.  A folder written so is read by ``landed.read_object``; ``hdfs dfs -getmerge`` makes it one file.
    """
    def text(c: str):  # the JSON text of any value, taken from a list of one
        listed = F.to_json(F.array(c), {"ignoreNullFields": "false"})
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(value).alias("value"))
    first = F.broadcast(rows.agg(F.min("key").alias("first")))  # one row
    lines = rows.join(first).select(
        F.lit(1).alias("place"), "key", F.concat(F.when(F.col("key") == F.col("first"), "").otherwise(","), text("key"), F.lit(":"), text("value")).alias("line"))
    name = df.sparkSession.range(1).select(F.to_json(F.array(F.lit(part))).alias("name"))
    opening = F.concat(F.lit("{"), F.substring("name", F.lit(2), F.length("name") - 2), F.lit(":{")) if part else F.lit("{")
    ends = name.select(F.explode(F.array(F.struct(F.lit(0).alias("place"), opening.alias("line")),
                                         F.struct(F.lit(2).alias("place"), F.lit("}}" if part else "}").alias("line")))).alias("end"))
    whole = lines.unionByName(ends.select("end.place", F.lit("").alias("key"), "end.line"))
    whole.orderBy("place", "key").select("line").write.text(path)
