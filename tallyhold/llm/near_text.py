"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets are one class; only classes are compared.  Signatures are cut into bands; classes
that share a band share a bucket.  A candidate pair is compared by batches of its signature: after each batch the
posterior (uniform prior) that its similarity reaches the limit must stay above MISS, or the pair is dropped.  Pairs
that pass all batches are decided by their full sets.

A bucket never emits all of its pairs.  First each member is compared with the bucket's pivot, the one that shares the most, and the links
are made into components.  Large buckets that still hold several get further stars around members outside their largest one, while
that helps.  What is left is cut into chunks; a task compares the members of two chunks across components, those of the
largest component only with others, and emits a spanning forest of the links that it has found.  So every candidate pair
whose ends are not yet linked is compared, and rows are |largest| + |others| * chunks, not a square.

Null texts count as empty; a document without words has an empty set and links with nothing.  With fewer than SHINGLE
words the whole sequence is the one shingle.  Repeated rows and equal texts are one class.  A component's id is its
smallest id that isn't null; rows with a null id are not ``kept``.  An empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold.llm import common

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 20, 6
HASHES = BANDS * ROWS
#: Bands of the same signature for limits below PERCENT: at 80 percent no band of a pair matches with 7e-5 (20 x 6: 2.3e-3).
LOW_BANDS, LOW_ROWS = 24, 5
#: Signature values compared at a time, and the probability with which a pair at the limit may be lost by that.
STEP, MISS = 24, 1e-4
#: Members of a bucket whose signatures a task compares with those of as many others; larger buckets get further stars first.
CHUNK = 1000
#: Members whose full sets a task holds at most, some of them from either chunk.
SETS = 400
#: Further stars stop once a round leaves more than this share of the members outside.
STALLED = 0.8
#: Rows of an Arrow batch: the sets of two very long texts may stand in one row.
BATCH_ROWS = 100
#: Bits of the sketch of the classes in shared buckets; others' sets and signatures are not looked at again.
SKETCH_BITS = 25


# ---- sets and signatures ------------------------------------------------------------------------

def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after another, and the offsets of the rows."""
    words = common.words_of(column, lower=True)
    h = words.hashes()
    sizes = np.diff(words.rows)
    each = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(sizes)), each)
    first = words.rows[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    length = np.minimum(SHINGLE, sizes)[owner]
    padded = np.concatenate((h, np.zeros(SHINGLE, np.uint64)))
    value = np.zeros(len(owner), np.uint64)
    for k in range(SHINGLE):
        value = np.where(k < length, common.mixed(value * np.uint64(0x9E3779B97F4A7C15) + padded[first + k]), value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])))[:len(owner)]
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(sizes) + 1))


@lru_cache(maxsize=1)
def _factors() -> list[tuple[np.uint64, np.uint64]]:
    rng = np.random.Generator(np.random.PCG64(99))
    odd = rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return list(zip(odd, rng.integers(0, 2**63, HASHES, dtype=np.uint64)))


def signatures(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One row of HASHES 32-bit minima per set; rows of empty sets are all ones."""
    out = np.full((len(rows) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(rows))
    if len(full):
        starts = rows[:-1][full]
        for k, (a, b) in enumerate(_factors()):
            out[full, k] = np.minimum.reduceat(((values * a + b) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def set_digests(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name a set."""
    out = []
    for seed in (0x1234567, 0x89ABCDE):
        total = np.concatenate(([np.uint64(0)], np.cumsum(common.mixed(values ^ np.uint64(seed)), dtype=np.uint64)))
        out.append((total[rows[1:]] - total[rows[:-1]]).astype(np.int64))
    return out[0], out[1]


def banding(percent: int) -> tuple[int, int]:
    return (BANDS, ROWS) if percent >= PERCENT else (LOW_BANDS, LOW_ROWS)


def bucket_keys(signature: np.ndarray, n: int = BANDS, width: int = ROWS) -> np.ndarray:
    """One 64-bit key per row and band."""
    bands = signature.reshape(len(signature), n, width).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(width):
        key = common.mixed(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
    return key.astype(np.int64)


# ---- verification -------------------------------------------------------------------------------

@lru_cache(maxsize=4)
def least_matches(percent: int = PERCENT, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(values compared, matches needed) after each batch."""
    limit, needed = percent / 100, []
    for n in range(STEP, HASHES + 1, STEP):
        # P(similarity >= limit | m of n) under a uniform prior is P(Binomial(n + 1, limit) <= m).
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * limit ** m * (1 - limit) ** (n + 1 - m)
        needed.append((n, m))
    return tuple(needed)


def passing(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Indices of the pairs of signature rows that no batch rules out."""
    left, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, needed in least_matches(percent):
        part = slice(n - STEP, n)
        matches = matches + (a[left, part] == b[left, part]).sum(axis=1)
        stays = matches >= needed
        left, matches = left[stays], matches[stays]
    return left


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def cross_pairs(chunk: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different labels: across the two chunks of a task, or inside its only one."""
    kinds = np.unique(chunk)
    if len(kinds) == 2:
        i, j = np.meshgrid(np.flatnonzero(chunk == kinds[0]), np.flatnonzero(chunk == kinds[1]), indexing="ij")
        i, j = i.ravel(), j.ravel()
    else:
        i, j = np.triu_indices(len(chunk), 1)
    other = label[i] != label[j]
    return i[other], j[other]


# ---- jobs ---------------------------------------------------------------------------------------

def row_keys(key: Column, text: Column) -> list[Column]:
    return [F.xxhash64(key, text).alias("row_key"), F.xxhash64(F.lit(29), text, key).alias("row_key2")]


def signed(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(id, row_key, row_key2, n_shingles, c1, c2, signature); both row keys together name the id and text."""
    rows = documents.select(F.col(key).alias("id"), F.col(text).alias("text"), *row_keys(F.col(key), F.col(text)))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, at = shingles(batch.column("text"))
        c1, c2 = set_digests(values, at)
        signature = signatures(values, at)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("row_key"), batch.column("row_key2"), pa.array(np.diff(at), pa.int64()), pa.array(c1), pa.array(c2),
             pa.array([s.tobytes() for s in signature], pa.binary())], ["id", "row_key", "row_key2", "n_shingles", "c1", "c2", "signature"])

    kind = documents.schema[key].dataType.simpleString()
    return rows.mapInArrow(common.in_slices(make), f"id {kind}, row_key long, row_key2 long, n_shingles long, c1 long, c2 long, signature binary")


def full_sets(documents: DataFrame, sketch, key: str, text: str) -> DataFrame:
    """(class, values) of the rows that may stand for a class in the sketch."""
    rows = documents.select(F.xxhash64(key, text).alias("class"), F.col(text).alias("text"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(common.in_sketch(sketch.value, batch.column("class").to_numpy())))
        values, at = shingles(batch.column("text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("class"), pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["class", "values"])

    return rows.mapInArrow(common.in_slices(make), "class long, values binary")


def in_buckets(signed_classes: DataFrame, sketch) -> DataFrame:
    """The rows of (class, signature) that may be in the sketch."""
    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(common.in_sketch(sketch.value, batch.column("class").to_numpy())))
    return signed_classes.mapInArrow(keep, signed_classes.schema)


def with_both(pairs: DataFrame, of: DataFrame, value: str) -> DataFrame:
    one = pairs.join(of.withColumnsRenamed({"class": "a", value: "of_a"}), "a")
    return one.join(of.withColumnsRenamed({"class": "b", value: "of_b"}), "b").select("a", "b", "of_a", "of_b")


def _kept_pairs(decide):
    def run(batches):
        for batch in batches:
            yield batch.take(pa.array(decide(batch), pa.int64())).select(["a", "b"])
    return run


def verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked: signatures batch by batch, then full sets."""
    def hopeful(part):
        return passing(common.stacked(part.column("of_a"), np.uint32), common.stacked(part.column("of_b"), np.uint32), percent) if part.num_rows else []

    def exact(part):
        return [i for i, (x, y) in enumerate(zip(part.column("of_a"), part.column("of_b")))
                if linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)]

    left = common.written(with_both(common.written(pairs, "near-pairs"), reps, "signature").mapInArrow(_kept_pairs(hopeful), "a long, b long"), "near-hopeful")
    return common.written(with_both(left, sets, "values").mapInArrow(_kept_pairs(exact), "a long, b long"), "near-edges")


def link(documents: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``documents``: id, row_key, row_key2, n_shingles, group (null without words), component_id, kept."""
    common.ready(documents.sparkSession, BATCH_ROWS)
    rows = common.written(signed(documents, key, text), "near-rows")
    filled = rows.filter("n_shingles > 0")
    classes = common.written(filled.groupBy("c1", "c2").agg(F.min("row_key").alias("class"), F.min("id").alias("least")), "near-classes")
    reps = common.written(filled.select(F.col("row_key").alias("class"), "signature")
                          .join(classes.select("class"), "class", "left_semi").dropDuplicates(["class"]), "near-signatures")

    n, width = banding(percent)

    def banded(batches):
        for batch in batches:
            keys = bucket_keys(common.stacked(batch.column("signature"), np.uint32), n, width) if batch.num_rows else np.zeros((0, n), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("class").to_numpy(), n))], ["bucket", "class"])

    bands = reps.mapInArrow(banded, "bucket long, class long")
    buckets = common.written(bands.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "near-buckets")
    shared = common.written(bands.join(buckets, "bucket"), "near-shared")
    # The class that shares the most is the likeliest to be near the others of its buckets: an unedited copy, say.
    members = common.written(shared.join(shared.groupBy("class").agg(F.sum("m").alias("weight")), "class"), "near-members")

    sketch = documents.sparkSession.sparkContext.broadcast(common.bit_sketch(members.select("class"), "class", SKETCH_BITS))
    reps = in_buckets(reps, sketch)
    sets = common.written(full_sets(documents, sketch, key, text)
                          .join(members.select("class").distinct(), "class", "left_semi").dropDuplicates(["class"]), "near-sets")
    pivots = members.groupBy("bucket").agg(F.max(F.struct("weight", "class"))["class"].alias("pivot"))
    edges = verified(star(members, pivots), reps, sets, percent)
    edges, labels = more_stars(members, edges, reps, sets, percent)
    more = unsettled_links(members, labels, reps, sets, percent)
    final = common.components(edges.union(more), "near-last").withColumnsRenamed({"id": "class", "component": "label"})

    named = common.written(classes.join(final, "class", "left").select("c1", "c2", "least", F.coalesce("label", "class").alias("label")), "near-named")
    smallest = common.written(named.groupBy("label").agg(F.min("least").alias("component_id")), "near-smallest")
    of_class = common.written(named.join(smallest, "label").select("c1", "c2", "component_id", F.col("label").alias("group")), "near-components")
    single = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return (rows.select("id", "row_key", "row_key2", "n_shingles", "c1", "c2").join(of_class, ["c1", "c2"], "left")
            .select("id", "row_key", "row_key2", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("group")).alias("group"), single.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))))


def without_near_copies(documents: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one row of each group: that of the smallest id, a null id last.  Rows without words all stay."""
    rows = common.written(link(documents, percent, key, text).select("id", "row_key", "row_key2", "group"), "near-linked")
    first = (rows.filter("group is not null").groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row_key", "row_key2")).alias("first"))
             .select("first.row_key", "first.row_key2", F.lit(True).alias("grouped")))
    alone = rows.filter("group is null").select("row_key", "row_key2", F.lit(False).alias("grouped")).distinct()
    chosen = common.written(first.union(alone), "near-chosen")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    found = documents.select(F.struct(*columns).alias("row"), *row_keys(F.col(key), F.col(text))).join(chosen, ["row_key", "row_key2"])
    # Equal rows share their keys; one of them stays if they have words.
    once = found.filter("grouped").dropDuplicates(["row_key", "row_key2"]).select("row.*")
    return once.union(found.filter("not grouped").select("row.*"))


def star(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's pivot with its other members, each pair once."""
    pairs = members.join(pivots, "bucket").filter("class <> pivot")
    return pairs.select(F.least("pivot", "class").alias("a"), F.greatest("pivot", "class").alias("b")).distinct()


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return common.written(members.filter("m > 2").join(labels, "class", "left")
                          .select("bucket", "class", "m", "weight", F.coalesce("label", "class").alias("label")), "near-labelled")


def open_buckets(labelled: DataFrame) -> DataFrame:
    """(bucket, main, outside) of the buckets that hold several components: the largest, and the number of members outside it."""
    sizes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("there"), F.first("m").alias("m"),
                                                    F.sum(F.xxhash64("class") % (1 << 40)).alias("s1"), F.sum(F.xxhash64(F.lit(7), "class") % (1 << 40)).alias("s2"))
    mains = sizes.groupBy("bucket").agg(F.max(F.struct("there", "label")).alias("top"), F.first("m").alias("m"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    # Buckets with the same members are looked at once.
    once = mains.filter("top.there < m").groupBy("m", "s1", "s2").agg(F.min(F.struct("bucket", "top")).alias("one"))
    return common.written(once.select("one.bucket", F.col("one.top.label").alias("main"), (F.col("m") - F.col("one.top.there")).alias("outside")), "near-open")


def more_stars(members: DataFrame, edges: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(edges, labels) after further stars in large buckets, while these leave less and less outside the largest components.

    A star's pivot is the heaviest member outside the largest component; it is compared with all members of other components,
    so a round costs at most one row per member.
    """
    last = None
    while True:
        labels = common.written(common.components(edges, "near-first").withColumnsRenamed({"id": "class", "component": "label"}), "near-labels")
        labelled = _labelled(members.filter(F.col("m") > CHUNK), labels)
        left = open_buckets(labelled)
        outside = left.agg(F.sum("outside")).first()[0] or 0
        if not outside or (last is not None and outside > STALLED * last):
            return edges, labels
        last = outside
        there = labelled.join(left, "bucket")
        pivots = (there.filter("label <> main").groupBy("bucket").agg(F.max(F.struct("weight", "class", "label")).alias("p"))
                  .select("bucket", F.col("p.class").alias("pivot"), F.col("p.label").alias("of_pivot")))
        edges = common.written(edges.union(verified(star(there.join(pivots.select("bucket", "of_pivot"), "bucket").filter("label <> of_pivot"),
                                                         pivots.select("bucket", "pivot")), reps, sets, percent)), "near-edges")


def dealt(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, low, high, chunk, class, label): the members of open buckets in each task that they take part in.

    The members of a bucket's largest component need only meet those outside it, so they are repeated for chunks of the latter alone.
    """
    labelled = _labelled(members, labels)
    inside, outside = F.col("label") == F.col("main"), F.ceil(F.col("outside") / CHUNK).cast("int")
    first_outside = F.ceil((F.col("m") - F.col("outside")) / CHUNK).cast("int")
    part = lambda n: F.pmod(F.xxhash64(F.lit(11), "class"), n).cast("int")
    return (labelled.join(open_buckets(labelled), "bucket")
            .withColumn("chunk", F.when(inside, part(first_outside)).otherwise(first_outside + part(outside)))
            .withColumn("other", F.explode(F.sequence(F.when(inside, first_outside).otherwise(F.lit(0)), first_outside + outside - 1)))
            .select("bucket", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "class", "label"))


def unsettled_links(members: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Spanning links between components that share a bucket and aren't linked by stars."""
    placed = dealt(members, labels)
    task = ["bucket", "low", "high"]

    def with_survivors(batches):
        for group in common.runs(batches, task):
            group = group.combine_chunks()
            i, j = cross_pairs(group.column("chunk").to_numpy(), group.column("label").to_numpy())
            signature = common.stacked(group.column("signature"), np.uint32)
            found = set()
            for at in range(0, len(i), 20_000):
                a, b = i[at:at + 20_000], j[at:at + 20_000]
                stay = passing(signature[a], signature[b], percent)
                found.update(a[stay].tolist(), b[stay].tolist())
            if found:
                yield from group.take(pa.array(sorted(found))).drop_columns(["signature"]).to_batches()

    shape = "bucket long, low int, high int, chunk int, class long, label long"
    alive = common.written(placed.join(reps, "class").select(*task, "chunk", "class", "label", "signature")
                           .repartition(*task).sortWithinPartitions(*task).mapInArrow(with_survivors, shape), "near-alive")

    def forest(batches):
        for group in common.runs(batches, task):
            group = group.combine_chunks()
            names, label = group.column("class").to_numpy(), group.column("label").to_numpy()
            signature = common.stacked(group.column("signature"), np.uint32)
            values = [np.frombuffer(v.as_buffer(), np.uint64) for v in group.column("values")]
            root = {int(x): int(x) for x in label}

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            i, j = cross_pairs(group.column("chunk").to_numpy(), label)
            a, b = [], []
            for at in range(0, len(i), 20_000):
                stay = at + passing(signature[i[at:at + 20_000]], signature[j[at:at + 20_000]], percent)
                for x, y in zip(i[stay].tolist(), j[stay].tolist()):
                    p, q = top(int(label[x])), top(int(label[y]))
                    if p != q and linked(values[x], values[y], percent):
                        root[p] = q
                        a.append(names[x])
                        b.append(names[y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    # What is left of a task is cut again if its full sets would be many.
    parts = F.ceil(2 * F.col("there") / SETS).cast("int")
    cut = (alive.join(alive.groupBy(*task).agg(F.count("*").alias("there")), task)
           .withColumn("chunk", F.pmod(F.xxhash64(F.lit(13), "class"), parts).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
           .select(*task, F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"), "chunk", "class", "label"))
    task = [*task, "first", "second"]
    loaded = cut.join(reps, "class").join(sets, "class").select(*task, "chunk", "class", "label", "signature", "values")
    return common.written(loaded.repartition(*task).sortWithinPartitions(*task).mapInArrow(forest, "a long, b long"), "near-more-edges")


def op10_near_text(spark: SparkSession, folder: str) -> DataFrame:
    documents = common.table(spark, folder, "documents").select("doc_id", "text")
    return link(documents).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
