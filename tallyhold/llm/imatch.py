"""Document fingerprints by I-Match over randomised lexicon subsets, with DataFrame functions only.

Terms are lower-cased words, named by 64-bit hashes.  The lexicon holds the terms whose document frequency lies in a band: at least
LEAST_DOCUMENTS and at most the share MOST_SHARE of all documents.  A document's distinct lexicon terms are sorted, and each of several
randomised lexicon subsets gives one hash of the sorted terms that it holds.  Subsets come in LEVELS of SUBSETS each; every level keeps a
quarter of the lexicon that the level before keeps, so short and long documents both have subsets that hold a few of their terms.
The likeness of two different fingerprints is the greatest share, over the levels, of equal hashes among the subsets in which either
has a term (of LEAST_SUBSETS, where there are fewer).

Frequencies are counted exactly.  The terms above the band are few (at most the mean number of distinct terms of a document divided by
MOST_SHARE), so they are left out before anything moves.  The (document, term) pairs stay where their range of documents is: the distinct
terms of a range meet the lexicon in a join by term, those found come back to the range, and are joined there with the range's pairs.  For that
the texts are dealt to their ranges twice, which moves less than their terms would; the files of a shuffle go as soon as its table is written.
An edited text shares most terms with its own, so both are one list of pairs.

A document without a term in the band has hashes of the whole of its terms: it is like those with the same terms only.  Null texts
count as empty; texts without words have the fingerprint of no terms, and two such are alike (1).  Null ids come last in descending
order.  Rows with equal ids are put in order by a hash of their text; of equal rows either may come first.  A single row is its own
next document.  An empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhold.llm import common

LEAST_DOCUMENTS, MOST_SHARE = 2, 0.1
LEVELS, SUBSETS, LEAST_SUBSETS = 5, 16, 6
#: Documents of one range of ids, as long as there are fewer than MANY_RANGES, and twice as many, as long as there are fewer than MOST_RANGES.
RANGE_ROWS, MANY_RANGES, MOST_RANGES = 500, 50, 16_384


# ---- terms and fingerprints ---------------------------------------------------------------------

def terms_of(text: Column) -> Column:
    """Distinct terms of a text."""
    words = F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")
    found = F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))
    return F.when(F.length(F.btrim(text, F.lit(" \t\n\x0b\f\r"))) > 0, found).otherwise(F.array().cast("array<bigint>"))


def most_documents(n: int) -> int:
    return max(LEAST_DOCUMENTS, math.floor(MOST_SHARE * n))


def frequencies(rows: DataFrame, terms: str = "terms") -> DataFrame:
    """(term, df) of all terms; counts combine before they are sent."""
    return rows.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def with_subset_hashes(rows: DataFrame, terms: str, name: str) -> DataFrame:
    """``rows`` with ``name``: one hash per level and subset, 0 where it holds no term of the row."""
    def split(held: Column, shift: int, ways: int) -> Column:
        return F.array(*[F.filter(held, lambda t: F.shiftrightunsigned(t, shift).bitwiseAND(F.lit(ways - 1)) == way) for way in range(ways)])

    def thinned(wanted: int):
        return lambda held: F.filter(held, lambda t: t.bitwiseAND(F.lit(wanted)) == 0)

    # Subsets are found in two steps of four, and a level's are the subsets of the level before without the terms it lacks.
    parts = [f"{name}_{level}" for level in range(LEVELS)]
    rows = rows.withColumn(parts[0], F.flatten(F.transform(split(F.col(terms), 34, SUBSETS // 4), lambda held: split(held, 32, 4))))
    for level in range(1, LEVELS):
        rows = rows.withColumn(parts[level], F.transform(parts[level - 1], thinned((1 << (2 * level)) - 1)))
    return rows.withColumn(name, F.transform(F.concat(*parts), lambda held: F.when(F.size(held) > 0, F.hash(held)).otherwise(F.lit(0)))).drop(*parts)


def likeness(a: str, b: str) -> Column:
    """1 for equal hashes, else the greatest share of equal hashes of any level."""
    shares = []
    for level in range(LEVELS):
        pairs = F.arrays_zip(F.slice(a, level * SUBSETS + 1, SUBSETS).alias("x"), F.slice(b, level * SUBSETS + 1, SUBSETS).alias("y"))
        either = F.size(F.filter(pairs, lambda p: (p["x"] != 0) | (p["y"] != 0)))
        equal = F.size(F.filter(pairs, lambda p: (p["x"] != 0) & (p["x"] == p["y"])))
        shares.append(equal / F.greatest(either, F.lit(LEAST_SUBSETS)))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.greatest(*shares))


def shown(hashes: str) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


# ---- the next document --------------------------------------------------------------------------

def range_of(place: Column, bounds: Column, steps: int) -> Column:
    """How many of the sorted ``bounds`` lie below ``place``, by halving."""
    def step(low: Column, i: Column) -> Column:
        half = F.pow(F.lit(2.0), F.lit(steps - 1) - i).cast("int")
        return F.when(F.get(bounds, low + half - 1) < place, low + half).otherwise(low)
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0), step)


def with_next(documents: DataFrame, text: str, carried: list[str]) -> DataFrame:
    """``documents`` (id, text) with their ``range`` and ``next_``-columns of the document with the next lower id, after the last the first.

    The ids are cut into ranges of about equal size; a range is one group of a window.  The first document of each
    range also visits the range above it, and the first of all the last range, so no range looks beyond itself.
    """
    place = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
    placed = documents.withColumn("place", place).withColumn("tie", F.xxhash64(text))
    n = documents.count()
    k = max(1, min(MANY_RANGES, n // RANGE_ROWS), min(MOST_RANGES, n // (2 * RANGE_ROWS)))
    steps = max(1, math.ceil(math.log2(k + 1)))
    ids = common.written(documents.select(place.alias("place"), F.xxhash64(text).alias("tie")), "match-ids")
    # Ranges are cut by id and text, so many null or equal ids are many ranges, too.
    cut = ids.repartitionByRange(k, "place", "tie").groupBy(F.spark_partition_id().alias("part")).agg(F.max(F.struct("place", "tie")).alias("upper"))
    bounds = common.written(cut.agg(F.sort_array(F.collect_list("upper")).alias("bounds")), "match-bounds")  # at most MOST_RANGES places

    def ranged(rows):
        return rows.crossJoin(F.broadcast(bounds)).withColumn("range", range_of(F.struct("place", "tie"), F.col("bounds"), steps)).drop("bounds")  # one row

    # One row per range: its first document, and the range above, for which that document is the next of the last.
    tops = ranged(ids).groupBy("range").agg(F.max(F.struct("place", "tie")).alias("top"))
    upward = Window.orderBy("range")
    whole = upward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = common.written(tops.select("range", F.col("top.place").alias("top_place"), F.col("top.tie").alias("top_tie"),
                                      F.coalesce(F.lead("range").over(upward), F.min("range").over(whole)).alias("above")), "match-tops")
    is_top = (F.col("place") == F.col("top_place")) & (F.col("tie") == F.col("top_tie"))
    dealt = (ranged(placed).join(F.broadcast(tops), "range")  # at most MOST_RANGES rows
             .withColumn("dealt", F.explode(F.when(is_top, F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")),
                                                                   F.struct(F.col("above").alias("range"), F.lit(1).alias("guest"))))
                                            .otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))))))
             .select("id", *carried, "place", "tie", "dealt.range", "dealt.guest"))
    down = Window.partitionBy("range").orderBy("guest", F.desc("place"), F.desc("tie"))
    return (dealt.select("range", "id", *carried, "guest", *[F.lead(c).over(down).alias(f"next_{c}") for c in carried])
            .filter("guest = 0").drop("guest"))


def _names(key: Column, text: Column) -> Column:
    """Two hashes that name a row; equal rows share them."""
    return F.struct(F.xxhash64(key, text).alias("r1"), F.xxhash64(F.lit(5), text, key).alias("r2"))


def texts_with_edits(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: its range, a number, id, n_chars, names of the row and the next one, digest of the edited text, and the distinct terms
    of both texts with a hash of all of them."""
    texts = documents.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    both = with_next(texts.withColumn("row", _names(F.col("id"), F.col("text"))), "text", ["text", "row"]).select(
        "range", "id", "text", "row", "next_row", n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    rows = both.select(
        "range", F.monotonically_increasing_id().alias("number"), "id", "n_chars", "row", "next_row", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        terms_of(F.col("text")).alias("terms"), terms_of(F.col("edited")).alias("edited_terms"))
    whole = lambda terms: F.when(F.size(terms) > 0, F.hash(F.sort_array(terms)))
    return rows.withColumns({"whole": whole("terms"), "edited_whole": whole("edited_terms")})


OWN, EDITED = 1, 2


def without_above(rows: DataFrame, above: DataFrame) -> DataFrame:
    """``rows`` without the terms that are above the band."""
    return rows.crossJoin(F.broadcast(above.agg(F.collect_list("term").alias("above")))).withColumns({  # one row
        "terms": F.array_except("terms", "above"), "edited_terms": F.array_except("edited_terms", "above")}).drop("above")


def pairs_of(rows: DataFrame) -> DataFrame:
    """(range, number, term, side, doc): a term of both texts is one pair; a pair without a term carries the other columns as ``doc``."""
    doc = F.struct(*[c for c in rows.columns if c not in ("range", "number", "terms", "edited_terms")])
    kind = rows.select(doc.alias("doc")).schema["doc"].dataType

    def side(terms, n):
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(n).cast("byte").alias("side"), F.lit(None).cast(kind).alias("doc")))

    listed = F.concat(F.array(F.struct(F.lit(None).cast("long").alias("term"), F.lit(0).cast("byte").alias("side"), doc.alias("doc"))),
                      side(F.array_intersect("terms", "edited_terms"), OWN + EDITED), side(F.array_except("terms", "edited_terms"), OWN),
                      side(F.array_except("edited_terms", "terms"), EDITED))
    return rows.select("range", "number", F.explode(listed).alias("pair")).select("range", "number", "pair.*")


def lexicon_terms(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """The rows with (own, edited), sorted hashes of their lexicon terms, in place of their terms.

    ``every`` has the same ``terms`` where the texts were not dealt to ranges.
    """
    every = rows if every is None else every
    counted = common.written_lean(frequencies(every).filter(F.col("df") >= LEAST_DOCUMENTS), "match-frequencies")
    most = most_documents(every.count())
    below = without_above(rows, counted.filter(F.col("df") > most).select("term"))
    # A range is in one partition already, so its distinct terms are found, and joined with its pairs, without a shuffle of pairs.
    asked = below.select("range", F.explode(F.array_union("terms", "edited_terms")).alias("term")).distinct()
    known = common.written_lean(asked.join(counted.filter(F.col("df") <= most).select("term"), "term", "left_semi"), "match-known")
    joined = pairs_of(below).join(known.withColumn("known", F.lit(True)).hint("shuffle_hash"), ["range", "term"], "left")
    of = lambda n: F.sort_array(F.transform(F.filter("pairs", lambda p: p["side"].bitwiseAND(F.lit(n).cast("byte")) > 0), lambda p: F.xxhash64(p["term"])))
    found = joined.filter("known OR doc IS NOT NULL").groupBy("range", "number").agg(
        F.first("doc", ignorenulls=True).alias("doc"), F.collect_list(F.when(F.col("known"), F.struct("term", "side"))).alias("pairs"))  # at most a document's terms
    return found.select("doc.*", of(OWN).alias("own"), of(EDITED).alias("edited"))


def hashes_of(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """The rows with ``hashes`` and ``edited_hashes`` in place of their terms."""
    found = lexicon_terms(rows, every)
    for terms, all_of, name in (("own", "whole", "hashes"), ("edited", "edited_whole", "edited_hashes")):
        found = with_subset_hashes(found, terms, name)
        without = F.array(*[F.hash(F.col(all_of), F.lit(k)) for k in range(LEVELS * SUBSETS)])
        found = found.withColumn(name, F.when((F.size(terms) > 0) | F.col(all_of).isNull(), F.col(name)).otherwise(without))
    return found.drop("own", "edited", "whole", "edited_whole")


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_chars, fingerprint, and the same for its edited text, with both likenesses."""
    every = documents.select(terms_of(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    made = common.written_lean(hashes_of(texts_with_edits(documents, key, text), every), "match-hashes")
    of_next = made.select("row.*", F.col("hashes").alias("next_hashes")).dropDuplicates(["r1", "r2"])
    both = made.withColumns({"r1": F.col("next_row.r1"), "r2": F.col("next_row.r2")}).join(of_next, ["r1", "r2"])
    return both.select("id", "n_chars", "edited_sha256", shown("hashes").alias("fingerprint"), shown("edited_hashes").alias("edited_fingerprint"),
                       likeness("hashes", "edited_hashes").alias("near_edited"), likeness("hashes", "next_hashes").alias("near_next"))


def op3_imatch(spark: SparkSession, folder: str) -> DataFrame:
    common.ready(spark)
    return fingerprints(common.table(spark, folder, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
