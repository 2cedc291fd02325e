"""Mixing sources to target weights by weighted fair queueing.

Targets share all words among the sources by weight; a source gives at most EPOCHS times its size, and what it can't
give is shared again.  The documents of a source stand in a shuffled line (by a digest of their id) that repeats up to
EPOCHS times.  A copy's virtual finish time is the words of its source up to its end divided by the source's target;
copies that start before time 1 are put in order of finish time across all sources and taken while the running total
stays within the budget.

Both running totals are two-level: sums of small buckets, then rows inside a bucket, so no source and no range of
finish times is one task.

Null texts have size 0 and are never taken; a null source is a source of its own, last in order; null ids share one
place in the line; equal rows are separate documents with neighbouring places.  A source without words has target 0.
An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhold.llm import common

WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: Rows of a bucket of the running totals, as long as there are fewer than MOST_BUCKETS.
BUCKET_ROWS = 500
MOST_BUCKETS = 16 ** 5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) with ``rank`` and ``target``.  One row per source passes through one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy("need", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight)
    ranked = ranked.withColumn("need", F.col("source_size") / F.col("weight"))
    # In order of need, a source is capped while its cap is within its share of what the capped ones before it leave.
    left = F.sum("source_size").over(whole) - epochs * (F.sum("source_size").over(by_need) - F.col("source_size"))
    open_weight = F.sum("weight").over(whole) - (F.sum("weight").over(by_need) - F.col("weight"))
    level = ranked.withColumn("level", left.cast("double") / open_weight.cast("double"))
    capped = level.withColumn("capped", epochs * F.col("source_size").cast("double") <= F.col("level") * F.col("weight"))
    water = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(
        Window.orderBy("need", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return capped.withColumn("water", water).select(
        "source", "source_size", "rank",
        F.when(F.col("capped"), epochs * F.col("source_size").cast("double")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def running_total(rows: DataFrame, value: str, groups: list[str], bucket: str, order: list) -> Column | DataFrame:
    """``rows`` with ``running``: the sum of ``value`` up to each row, by bucket and then by ``order``."""
    sums = rows.groupBy(*groups, bucket).agg(F.sum(value).alias("of_bucket"))
    before = sums.withColumn("before", F.sum("of_bucket").over(Window.partitionBy(*groups).orderBy(bucket)) - F.col("of_bucket"))
    before = common.written(before.drop("of_bucket"), "mix-buckets")
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("inside", F.sum(value).over(inside))
    same = [placed[c].eqNullSafe(before[c]) for c in (*groups, bucket)]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    return placed.join(before, condition).select(*[placed[c] for c in rows.columns], (F.col("inside") + F.col("before")).alias("running"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Per row of ``documents`` (doc_id, source, text): row_key, size, source_size, target, and the words taken."""
    sized = common.written(
        documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("row_key"))
        .withColumn("uid", F.monotonically_increasing_id())
        .withColumn("place", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))), "mix-sizes")
    n = sized.count()
    digits = max(1, math.ceil(math.log(max(n / BUCKET_ROWS, 2), 16)))
    digits = min(digits, round(math.log(MOST_BUCKETS, 16)))
    cells = max(1, min(n // BUCKET_ROWS, MOST_BUCKETS))

    sources = common.written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs), "mix-sources")
    line = running_total(sized.withColumn("start_of_place", F.substring("place", 1, digits)), "size", ["source"], "start_of_place",
                         ["place", "doc_id", "size", "uid"])
    line = line.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    line = common.written(line.select("uid", "row_key", "doc_id", "size", "place", "rank", "source_size", "target", "running"), "mix-line")
    copies = (line.filter("size > 0 and target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
              .withColumn("end", F.col("epoch") * F.col("source_size") + F.col("running"))
              .filter(F.col("end") - F.col("size") < F.col("target"))
              .withColumn("finish", F.col("end").cast("double") / F.col("target"))
              .withColumn("cell", F.least(F.floor(F.col("finish") * cells), F.lit(cells))))
    ordered = running_total(copies.select("uid", "size", "rank", "place", "doc_id", "epoch", "finish", "cell"), "size", [], "cell",
                            ["finish", "rank", "place", "doc_id", "size", "uid", "epoch"])
    budget = sources.agg(F.sum("source_size").alias("budget"))
    taken = (ordered.crossJoin(F.broadcast(budget)).filter("running <= budget")  # one row
             .groupBy("uid").agg(F.sum("size").alias("taken")))
    return (line.join(taken, "uid", "left")
            .select("doc_id", "row_key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``documents`` with each row as often as the mix takes it."""
    times = mix(documents.select("doc_id", "source", "text"), weights, epochs).filter("taken > 0").groupBy("row_key").agg(
        (F.sum("taken") / F.min("size")).cast("int").alias("times"))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    keyed = documents.select(F.struct(*columns).alias("row"), F.xxhash64("doc_id", "source", "text").alias("row_key"))
    # Equal rows share a key and what the mix takes of them.
    once = keyed.join(common.written(times, "mix-times"), "row_key").dropDuplicates(["row_key"])
    return once.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    common.ready(spark)
    return mix(common.table(spark, folder, "documents").select("doc_id", "source", "text")).drop("row_key")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sized GROUP BY source),
weighted AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT] AS weight FROM sources),
needs AS (SELECT *, source_size::DOUBLE / weight::DOUBLE AS need FROM weighted),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * (sum(source_size) OVER up_to - source_size))::DOUBLE
            / (sum(weight) OVER () - (sum(weight) OVER up_to - weight))::DOUBLE AS level
  FROM needs WINDOW up_to AS (ORDER BY need, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
capped AS (SELECT *, 3 * source_size::DOUBLE <= level * weight AS capped FROM levels),
water AS (SELECT arg_min(level, need) AS water FROM (SELECT level, need FROM capped WHERE NOT capped ORDER BY need, rank LIMIT 1)),
goals AS (SELECT source, source_size, rank, CASE WHEN capped THEN 3 * source_size::DOUBLE ELSE water * weight END AS target FROM capped CROSS JOIN water),
line AS (
  SELECT d.doc_id, d.size, d.place, g.rank, g.source_size, g.target,
         sum(d.size) OVER (PARTITION BY g.rank ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
copies AS (
  SELECT *, epoch * source_size + running AS finish_words FROM line CROSS JOIN (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0 AND target > 0),
ordered AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish_words::DOUBLE / target, rank, place, doc_id, size, epoch
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
  FROM copies WHERE (finish_words - size)::DOUBLE < target),
taken AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM ordered WHERE so_far <= (SELECT sum(source_size) FROM goals) GROUP BY doc_id)
SELECT l.doc_id, l.size, l.source_size, l.target, coalesce(t.taken, 0)::BIGINT AS taken FROM line l LEFT JOIN taken t ON l.doc_id = t.doc_id
"""
