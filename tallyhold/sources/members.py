"""Members of one large JSON object, read by many tasks.

A whole-text reader gives an object to one task.  Here the text is cut at its commas by Spark's own reader, each task reading one
byte range, and every piece learns where it stands from sums: whether it begins inside a string (parity of the quotes before it)
and how deep it is nested (brackets outside strings before it).  A range doesn't know what stands before it, so it sums for both parities, and
the ranges, one row each, are then summed among themselves.  Pieces between two commas at depth one or two make one member of the
object, or of an object or list that is a member's value.  One member is the largest thing that a task holds.

The path is a file, or a folder whose files are one text in the order of their names, as ``exports.write_sorted_object`` leaves it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhold.session import bytes_of, more_partitions, stage

#: Commas at this depth or above end a member.
DEPTH = 2
_MAP, _LIST = "map<string,string>", "array<string>"
_RANGE = ("file", "block")
#: Bytes of a range at most.  A range is put in order by one task, and its pieces take some ten times its text.
RANGE_BYTES = 4 * 1024 * 1024
_READ_BYTES = "spark.sql.files.maxPartitionBytes"


def _depth_change(text: Column) -> Column:
    """Brackets opened less brackets closed, outside strings; escapes are gone and the text begins outside a string."""
    bare = F.regexp_replace(text, r'"[^"]*("|\z)', "")
    return F.length(F.regexp_replace(bare, r"[^{\[]", "")) - F.length(F.regexp_replace(bare, r"[^}\]]", ""))


def _before(value: Column, order) -> Column:
    return F.coalesce(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text between commas with its range, whether it begins inside a string, and sums of depth in its range for both parities."""
    read = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value")
    clean = F.regexp_replace("value", r"(?s)\\.", "")  # an escape never spans a comma
    counted = read.select(
        "*", ((F.length(clean) - F.length(F.replace(clean, F.lit('"'), F.lit("")))) % 2).alias("odd"),
        _depth_change(clean).alias("outside"), _depth_change(F.regexp_replace(clean, r'^[^"]*("|\z)', "")).alias("inside"))
    order = Window.partitionBy(*_RANGE).orderBy("id")
    here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = counted.withColumn("turned", _before(F.col("odd"), order) % 2)
    even = F.when(F.col("turned") == 0, F.col("outside")).otherwise(F.col("inside"))
    odd = F.when(F.col("turned") == 0, F.col("inside")).otherwise(F.col("outside"))
    return turned.withColumns({"if_even": even, "if_odd": odd}).withColumns(
        {"even_here": F.sum("if_even").over(here), "odd_here": F.sum("if_odd").over(here)}).drop("inside", "outside")


def staged_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The pieces, written; Spark's reader cuts the text into ranges of RANGE_BYTES, however long it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    length = target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    more_partitions(spark, length)
    before = spark.conf.get(_READ_BYTES)
    if bytes_of(before) > RANGE_BYTES:
        spark.conf.set(_READ_BYTES, str(RANGE_BYTES))
    try:
        return stage(pieces(spark, path), "object-pieces")
    finally:
        spark.conf.set(_READ_BYTES, before)


def ranges(found: DataFrame) -> DataFrame:
    """One row per byte range, in the order of the text: its number, parity and depth at its start, and whether the whole text is closed."""
    sums = found.groupBy(*_RANGE).agg(F.sum("odd").alias("quotes"), F.sum("if_even").alias("even"), F.sum("if_odd").alias("odd"), F.max("id").alias("last_id"))
    every = Window.partitionBy(F.lit(0))  # one row per byte range
    order = every.orderBy(F.length("file"), "file", "block")
    parity = sums.withColumns({"number": F.row_number().over(order), "parity": _before(F.col("quotes"), order) % 2})
    change = F.when(F.col("parity") == 0, F.col("even")).otherwise(F.col("odd"))
    return parity.withColumn("change", change).select(
        *_RANGE, "number", "parity", _before(F.col("change"), order).alias("depth"),
        F.when(F.col("block") == F.max("block").over(Window.partitionBy("file")), F.col("last_id")).alias("file_end"),
        ((F.sum("change").over(every) == 0) & (F.sum("quotes").over(every) % 2 == 0)).alias("closed"))


def _groups(spark: SparkSession, path: str) -> DataFrame:
    """Text between two cuts, numbered through, with the depth before and after it."""
    found = staged_pieces(spark, path)
    placed = found.join(F.broadcast(stage(ranges(found), "object-ranges")), list(_RANGE))  # one row per byte range
    own, here = (F.when(F.col("parity") == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("if_even", "if_odd"), ("even_here", "odd_here")))
    after = F.col("depth") + here
    quiet = (F.col("parity") + F.col("turned") + F.col("odd")) % 2 == 0
    comma = F.col("file_end").isNull() | (F.col("id") != F.col("file_end"))  # no comma follows the last piece of a file
    marked = placed.select("number", "id", "closed", "value", (after - own).alias("before"), after.alias("after"), comma.alias("comma"),
                           (quiet & comma & (after <= DEPTH)).cast("int").alias("cut"))
    cuts = stage(marked.withColumn("n", _before(F.col("cut"), Window.partitionBy("number").orderBy("id"))), "object-cuts")
    order = Window.partitionBy(F.lit(0)).orderBy("number")  # one row per byte range
    base = cuts.groupBy("number").agg(F.sum("cut").alias("cuts")).select("number", _before(F.col("cuts"), order).alias("base"))
    text = F.concat("value", F.when((F.col("cut") == 0) & F.col("comma"), ",").otherwise(""))
    grouped = cuts.join(F.broadcast(base), "number").select(
        (F.col("base") + F.col("n")).alias("at"), "closed", F.struct("number", "id", "before", "after", text.alias("text")).alias("piece"))
    listed = grouped.groupBy("at").agg(F.sort_array(F.collect_list("piece")).alias("p"), F.first("closed").alias("closed"))  # one member
    return listed.select("at", "closed", F.col("p")[0]["number"].alias("number"), F.col("p")[0]["before"].alias("before"),
                         F.element_at("p", -1)["after"].alias("after"), F.array_join(F.col("p")["text"], "").alias("text"))


def _checked(text: Column, *others: Column) -> Column:
    """The first of the texts that is JSON, else an error."""
    valid = [F.when(F.try_parse_json(t).isNotNull(), t) for t in (text, *others)]
    return F.coalesce(*valid, F.raise_error(F.lit("Invalid JSON object: a member cannot be read")).cast("string"))


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """``at, part, inner, key, value`` of the object at ``path``.

    A member of the object whose value is short or has no comma is one row: ``part`` is its name and ``value`` its text.  Of other objects and lists
    each member is a row (``inner``): ``part`` names the outer one, ``key`` is null in lists.  ``at`` ascends in the order of the text.
    An object that is not closed, or a text that is no object, is an error; an empty object has no rows, nor has an empty file.
    """
    groups = _groups(spark, path)
    start = r"^﻿?\s*\{"
    opened = (F.when(~F.col("closed"), F.raise_error(F.lit("Invalid JSON object: it is not closed")).cast("string"))
              .when((F.col("before") == 0) & ~F.col("text").rlike(start), F.raise_error(F.lit("Invalid JSON object: it is none")).cast("string"))
              .when(F.col("before") == 0, F.regexp_replace("text", start, "")).otherwise(F.col("text")))
    body, top, after = F.col("body"), F.col("before") <= 1, F.col("after")
    begun = F.concat(F.lit("{"), body)
    whole = (F.when(~top, None).when(after == 0, _checked(begun)).when(after == 1, _checked(F.concat(begun, F.lit("}"))))
             .otherwise(_checked(F.concat(begun, F.lit("}}")), F.concat(begun, F.lit("]}")))))
    first = F.get(F.map_entries(F.from_json("whole", _MAP)), 0)
    opener = F.when(top & (after == DEPTH), F.struct(F.col("entry.key").alias("part"), F.substring(F.ltrim("entry.value"), 1, 1).alias("kind")))
    named = stage(groups.withColumn("body", opened).withColumn("whole", whole).withColumn("entry", first).withColumn("opener", opener)
                  .select("at", "number", "before", "after", "body", "entry", "opener"), "object-groups")
    # The outer member of an inner one is the last that was opened: in this range, or else in the ranges before it.
    order = Window.partitionBy(F.lit(0)).orderBy("number")  # one row per byte range
    carried = named.groupBy("number").agg(F.max_by("opener", F.when(F.col("opener").isNotNull(), F.col("at"))).alias("last")).select(
        "number", F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    within = Window.partitionBy("number").orderBy("at")
    of = named.join(F.broadcast(carried), "number").withColumn("of", F.coalesce(F.last("opener", ignorenulls=True).over(within), "carried"))
    in_list = F.col("of.kind") == "["
    closing = F.when(in_list, "]").otherwise("}")
    inner = F.concat(F.col("of.kind"), F.when(after == 0, F.regexp_replace(body, r"\}\s*\z", "")).otherwise(body), F.when(after == DEPTH, closing).otherwise(""))
    text = F.when(top, F.col("entry.value")).otherwise(_checked(inner))
    entry = lambda key, value: F.struct(F.lit(True).alias("inner"), key.cast("string").alias("key"), value.alias("value"))
    single = F.array(F.struct(F.lit(False).alias("inner"), F.lit(None).cast("string").alias("key"), F.col("text").alias("value")))
    rows = (F.when(top & F.col("opener").isNull(), F.when(F.col("entry").isNotNull(), single))
            .when(in_list, F.transform(F.from_json("text", _LIST), lambda v: entry(F.lit(None), v)))
            .otherwise(F.transform(F.map_entries(F.from_json("text", _MAP)), lambda e: entry(e["key"], e["value"]))))
    return of.withColumn("text", text).select(
        "at", F.when(top, F.col("entry.key")).otherwise(F.col("of.part")).alias("part"), F.explode(rows).alias("row")).select("at", "part", "row.*")
