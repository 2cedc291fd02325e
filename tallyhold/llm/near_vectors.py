"""Embedding near-dedup by product quantisation.

Equal vectors are one class; only classes are compared.  A bounded sample fits coarse centroids and sub-space
codebooks of the residuals; every class is indexed.  A class visits each coarse list whose boundary is within reach of
a neighbour at the limit (see ``visits``); there, table look-ups give the distance to each member's code, and a member
stays if that distance allows the limit given the exact error of its code.  Members that stay are decided by their exact
cosine in double precision.

Classes are dealt to blocks of whole lists or of parts of one, about CHUNK classes each; one row of the index is a block, with its vectors as given.
Every two blocks meet once, in a product of the index with itself that reads the stored blocks again and moves none through a
shuffle, so the index and its files grow with the vectors and not with the lists they visit.  Who visits whom is decided where two blocks
meet.  A meeting emits link counts and a spanning forest, never all pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing.  Vectors of different lengths
are compared as if zeros followed the shorter.  Repeated rows are one class and link with each other.  A component's id
is its smallest id that isn't null; rows with a null id are not kept.  An empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold.llm import common

LIMIT = 0.95
#: Rows that the centroids and codebooks are fitted on.
SAMPLE = 12_000
MOST_LISTS = 4096
SUBSPACES, WORDS = 16, 16
#: How many standard deviations of a neighbour's offset across a list boundary the probes allow for.
SIGMAS = 4.0
CHUNK = 4096
#: Bytes of a block's vectors in double precision, at most (unless that is less than 16 vectors).
BLOCK_BYTES = 8 << 20
#: The index has up to so many files however small it is, and then one per FILE_BYTES of vectors.
MOST_FILES, FILE_BYTES = 24, 16 << 20
#: Rows of the index are blocks, so few of them make a batch.
_FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2", "spark.sql.parquet.columnarReaderBatchSize": "16"}
#: Visitors whose distances to a list's codes are held at a time.
VISITORS = 512


# ---- index --------------------------------------------------------------------------------------

def means(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty cell takes a random point."""
    centers = points[rng.permutation(len(points))[:k]].copy()
    if len(centers) < k:
        centers = np.concatenate((centers, centers[rng.integers(0, len(centers), k - len(centers))]))
    for _ in range(rounds):
        cell = nearest(points, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, cell, points)
        n = np.bincount(cell, minlength=k)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], points[rng.integers(0, len(points), k)])
    return centers


def squared(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((points ** 2).sum(axis=1)[:, None] + (centers ** 2).sum(axis=1) - 2 * points @ centers.T, 0)


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(points[at:at + 4096], centers).argmin(axis=1) for at in range(0, len(points), 4096)]) if len(points) else np.zeros(0, int)


class Index:
    """Coarse centroids of unit vectors, and codebooks of their residuals per sub-space."""

    def __init__(self, sample: np.ndarray, n_lists: int, limit: float):
        rng = np.random.Generator(np.random.PCG64(5))
        self.width, self.limit = sample.shape[1], limit
        self.reach = math.sqrt(max(0.0, 2 - 2 * limit))
        self.centers = means(sample, n_lists, 6, rng)
        residual = self.padded(sample - self.centers[nearest(sample, self.centers)])
        self.books = [means(part, WORDS, 8, rng) for part in np.split(residual, SUBSPACES, axis=1)]

    def padded(self, x: np.ndarray) -> np.ndarray:
        extra = -x.shape[1] % SUBSPACES
        return np.concatenate((x, np.zeros((len(x), extra))), axis=1) if extra else x

    def codes(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code of each unit vector in its home list, and the distance between the vector and what its code stands for."""
        residual = self.padded(x - self.centers[home])
        code = np.zeros((len(x), SUBSPACES), np.uint8)
        error = np.zeros(len(x))
        for m, part in enumerate(np.split(residual, SUBSPACES, axis=1)):
            distance = squared(part, self.books[m])
            code[:, m] = distance.argmin(axis=1)
            error += ((part - self.books[m][code[:, m]]) ** 2).sum(axis=1)
        return code, np.sqrt(error)

    def homes(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centers)

    def visits(self, x: np.ndarray, home: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """(vector, list): whether a vector visits each of some lists; its home list counts as visited.

        A neighbour at distance ``reach`` lies in list c, not in the home list h, only if its offset along c - h crosses
        the boundary.  That offset is at most ``reach`` and has standard deviation reach / sqrt(width) for neighbours
        in no special direction; lists within SIGMAS of these (or ``reach``, if that is less) are visited.
        """
        margin = squared(x, self.centers[lists]) - ((x - self.centers[home]) ** 2).sum(axis=1)[:, None]
        apart = np.sqrt(squared(self.centers, self.centers[lists]))
        return (margin <= 2 * apart[home] * self.reach * min(1.0, SIGMAS / math.sqrt(self.width)) + 1e-9) | (home[:, None] == lists)

    def hopeful(self, visitors: np.ndarray, center: int, marks: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(visitor, member) whose asymmetric distance allows the limit; ``marks`` are the members' codes (see ``marked``)."""
        residual = self.padded(visitors - self.centers[center])
        tables = np.concatenate([squared(part, self.books[m]) for m, part in enumerate(np.split(residual, SUBSPACES, axis=1))], axis=1)
        distance = tables.astype(np.float32) @ marks.T
        return np.nonzero(distance <= ((self.reach + errors) ** 2 + 1e-3).astype(np.float32))


def marked(codes: np.ndarray) -> np.ndarray:
    """Codes as rows with a one at each word, so that the sums of table look-ups are a matrix product."""
    out = np.zeros((len(codes), SUBSPACES * WORDS), np.float32)
    out[np.arange(len(codes))[:, None], np.arange(SUBSPACES) * WORDS + codes] = 1
    return out


def dense(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as a matrix of their own type, zeros after shorter ones."""
    lists = pa.concat_arrays([column])
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def unit(given: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    out = given.astype(np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)  # neither huge nor tiny components overflow
    return out / np.sqrt((out ** 2).sum(axis=1, keepdims=True))


# ---- jobs ---------------------------------------------------------------------------------------

def usable(vector: str) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def link(vectors: DataFrame, limit: float = LIMIT, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row of ``vectors``: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast(kind).alias("vector")).withColumns(
        {"usable": F.coalesce(usable("vector"), F.lit(False)), "c1": F.xxhash64("vector"), "c2": F.xxhash64(F.lit(3), "vector"),
         "row_key": F.xxhash64("id", "vector")})
    good = rows.filter("usable")
    classes = common.written_lean(good.groupBy("c1", "c2").agg(F.min("row_key").alias("class"), F.min("id").alias("least"), F.count("*").alias("n"),
                                                               F.first("vector").alias("vector")), "vector-classes")
    reps = classes.select("class", "n", "vector")
    shape = reps.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    if shape.n:
        # The rows of least hash; those that cannot be among them are dropped first, so no task returns a whole sample.
        place = F.pmod(F.xxhash64(F.lit(1), "class"), F.lit(1 << 40))
        drawn = reps.filter(place < int(min(1.0, 2 * SAMPLE / shape.n) * (1 << 40)))
        sample = unit(dense(drawn.orderBy(place, "class").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks(), shape.width))
        n_lists = int(min(MOST_LISTS, max(1, round(math.sqrt(shape.n)))))
        index = Index(sample, n_lists, limit)
        counts, edges = compared(reps, index, Blocks(index.homes(sample), n_lists, shape.n, shape.width))
    else:
        counts = spark.createDataFrame([], "class long, links long")
        edges = spark.createDataFrame([], "a long, b long")
    labels = common.components(edges, "vector").withColumnsRenamed({"id": "class", "component": "label"})
    named = common.written(classes.join(counts, "class", "left").join(labels, "class", "left").select(
        "c1", "c2", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("label", "class").alias("label")), "vector-named")
    smallest = common.written(named.groupBy("label").agg(F.min("least").alias("component")), "vector-smallest")
    of_class = common.written(named.join(smallest, "label").select("c1", "c2", "links", "component"), "vector-components")
    alone = (rows.filter(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return (good.select("id", "c1", "c2").join(of_class, ["c1", "c2"])
            .select("id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
            .union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))))


class Blocks:
    """Which block a class goes to: lists share blocks of about ``size`` classes, and large lists have several, by what the sample says of their sizes."""

    def __init__(self, homes: np.ndarray, n_lists: int, n: int, width: int):
        self.size = max(16, min(CHUNK, BLOCK_BYTES // (8 * max(width, 1))))
        members = np.bincount(homes, minlength=n_lists) / len(homes) * n
        self.spread = np.maximum(1, np.ceil(members / self.size)).astype(np.int64)
        small = self.spread == 1
        self.first = np.zeros(n_lists, np.int64)
        self.first[small] = (np.cumsum(members[small]) - members[small]) // self.size
        self.first[~small] = 1 + self.first.max() + np.cumsum(self.spread[~small]) - self.spread[~small]
        self.n = int((self.first + self.spread).max())
        #: Files of the index: the product has a task for every two of them.
        self.files = min(self.n, max(MOST_FILES, n * width * 4 // FILE_BYTES))

    def of(self, classes: np.ndarray, homes: np.ndarray) -> np.ndarray:
        return self.first[homes] + (classes.view(np.uint64) % self.spread[homes].astype(np.uint64)).astype(np.int64)


class Block:
    """Classes of an index row, in the order of their lists."""

    FIELDS = {"class": np.dtype(np.int64), "n": np.dtype(np.int64), "home": np.dtype(np.int32), "error": np.dtype(np.float64), "code": np.dtype((np.uint8, SUBSPACES))}

    def __init__(self, data: bytes, rows: int):
        at, fields = 0, {}
        for name, kind in self.FIELDS.items():
            fields[name] = np.frombuffer(data, kind.base, rows * kind.itemsize // kind.base.itemsize, at).reshape(rows, *kind.shape)
            at += rows * kind.itemsize
        self.names, self.n, self.home, self.errors = (fields[name] for name in ("class", "n", "home", "error"))
        exact = np.float64 if data[-1] else np.float32
        self.units = unit(np.frombuffer(data, exact, (len(data) - 1 - at) // np.dtype(exact).itemsize, at).reshape(rows, -1))
        self.marks = marked(fields["code"])
        self.lists, first = np.unique(self.home, return_index=True)
        self.bounds = np.append(first, rows)
        self.at = np.searchsorted(self.lists, self.home)

    @staticmethod
    def packed(table: pa.Table) -> bytes:
        code = b"".join(table.column("code").to_pylist())
        fields = [table.column(name).to_numpy().astype(kind).tobytes() for name, kind in Block.FIELDS.items() if name != "code"]
        given = table.column("given").to_pylist()
        return b"".join([*fields, code, *given, b"\1" if table.column("exact")[0].as_py() else b"\0"])


def compared(reps: DataFrame, index: Index, blocks: Blocks) -> tuple[DataFrame, DataFrame]:
    """Link counts per class (rows of linked classes), and a spanning forest of the links."""
    shared = reps.sparkSession.sparkContext.broadcast((index, blocks))

    def place(batches):
        made, dealt = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            given = dense(batch.column("vector"), made.width)
            x = unit(given)
            home = made.homes(x)
            codes, errors = made.codes(x, home)
            yield pa.RecordBatch.from_arrays(
                [pa.array(dealt.of(batch.column("class").to_numpy(), home)), batch.column("class"), batch.column("n"), pa.array(home, pa.int32()), pa.array(errors),
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in given], pa.binary()), pa.array([given.dtype == np.float64] * len(given))],
                ["part", "class", "n", "home", "error", "code", "given", "exact"])

    def pack(batches):
        size = shared.value[1].size
        for run in common.runs(batches, ["part"]):
            part = run.column("part")[0].as_py()
            for at in range(0, run.num_rows, 2 * size):  # longer than that only if the sample said too little of a list
                piece = run.slice(at, 2 * size)
                yield pa.RecordBatch.from_arrays([pa.array([part * 2**31 + at]), pa.array([piece.num_rows]), pa.array([Block.packed(piece)], pa.binary())], ["block", "rows", "data"])

    placed = reps.mapInArrow(place, "part long, class long, n long, home int, error double, code binary, given binary, exact boolean")
    dealt = placed.repartition(blocks.files, "part").sortWithinPartitions("part", "home")
    table = common.written_lean(dealt.mapInArrow(pack, "block long, rows long, data binary"), "vector-index")
    one, other = (table.select([F.col(c).alias(f"{side}_{c}") for c in table.columns]) for side in ("a", "b"))

    def meet(batches):
        made = shared.value[0]
        held = {}
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["a_block"] not in held:
                    held = {row["a_block"]: Block(row["a_data"], row["a_rows"])}
                a = held[row["a_block"]]
                b = a if row["a_block"] == row["b_block"] else Block(row["b_data"], row["b_rows"])
                links, forest = meeting(made, a, b)
                for number, block, own in ((row["a_block"], a, links[:len(a.names)]), (row["b_block"], b, links[-len(b.names):] if b is not a else None)):
                    if own is not None and own.any():
                        sums[number] = (block.names, sums[number][1] + own if number in sums else own)
                if len(forest):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(forest), pa.int64())] * 2 + [pa.array(forest[:, 0]), pa.array(forest[:, 1])], ["class", "links", "a", "b"])
        for names, links in sums.values():
            there = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(names[there]), pa.array(links[there])] + [pa.nulls(len(there), pa.int64())] * 2, ["class", "links", "a", "b"])

    met = common.written_with(one.join(other, F.col("a_block") <= F.col("b_block")).mapInArrow(meet, "class long, links long, a long, b long"), "vector-links", _FEW_ROWS)
    counts = met.filter("class is not null").groupBy("class").agg(F.sum("links").alias("links"))
    return counts, met.filter("a is not null").select("a", "b")


def meeting(index: Index, a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Links of the classes of two blocks (first a's, then b's) with each other, and a spanning forest as pairs of classes; a block may meet itself."""
    same = a is b
    names, n = (a.names, a.n) if same else (np.concatenate((a.names, b.names)), np.concatenate((a.n, b.n)))
    links, root = np.zeros(len(names), np.int64), np.arange(len(names))
    forest: list[tuple[int, int]] = []
    shift = 0 if same else len(a.names)
    to_a, to_b = index.visits(b.units, b.home, a.lists), index.visits(a.units, a.home, b.lists)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def linked(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal root
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        apart = root[i] != root[j]
        for x, y in zip(i[apart].tolist(), j[apart].tolist()):
            p, q = top(x), top(y)
            if p != q:
                root[p] = q
                forest.append((names[x], names[y]))
        while (further := root[root]).tolist() != root.tolist():
            root = further

    def visit(hosts: Block, guests: Block, visits: np.ndarray, back: np.ndarray, of_host: int, of_guest: int, again: bool) -> None:
        """Pairs of guests and the hosts of the lists they visit; where both visit each other, the pair counts once."""
        for k, center in enumerate(hosts.lists):
            first, end = hosts.bounds[k:k + 2]
            coming = np.flatnonzero(visits[:, k])
            for at in range(0, len(coming), VISITORS):
                there = coming[at:at + VISITORS]
                i, j = index.hopeful(guests.units[there], center, hosts.marks[first:end], hosts.errors[first:end])
                i, j = there[i], j + first
                if same:
                    once = (i < j) | ((i > j) & ~back[j, guests.at[i]])
                    i, j = i[once], j[once]
                elif again:
                    once = ~back[j, guests.at[i]]
                    i, j = i[once], j[once]
                step = max(1, (2 << 20) // index.width)
                for cut in range(0, len(i), step):
                    p, q = i[cut:cut + step], j[cut:cut + step]
                    near = (guests.units[p] * hosts.units[q]).sum(axis=1) >= index.limit
                    if near.any():
                        linked(p[near] + of_guest, q[near] + of_host)

    visit(a, b, to_a, to_b, 0, shift, False)
    if not same:
        visit(b, a, to_b, to_a, shift, 0, True)
    return links, np.array(forest, np.int64).reshape(-1, 2)


def op9_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    common.ready(spark)
    return link(common.table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")
