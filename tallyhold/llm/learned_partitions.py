"""Approximate nearest neighbours by learned partitions.

A node of the index holds vectors.  One with more than LEAF_ROWS is split: about SAMPLE of its vectors, drawn by digest, form a
neighbour graph; recursive bisection (a smooth vector on the graph, cut at its median, then swaps that shorten the cut) deals the
graph into parts of equal size; a small classifier learns the parts.  Its most probable part is where *every* vector of
the node goes.  A second classifier, trained from the first, learns how a vector's neighbours are spread over the parts;
vectors held out of its training say how much predicted mass must be probed so that TARGET of their neighbours are found.
A query goes on to the most probable parts until that mass is reached, node by node, and its candidates in all of the
leaves it reaches are compared.  Nearest vectors are ranked by their cosines in double precision, computed from the original vectors.

Fits run in one task per node on a bounded sample; routing and comparing deal rows of any node or leaf, however many, over
tasks of CHUNK rows, and candidates have no cap.  Equal vectors are one class: it is indexed once with its smallest
ids, one more than a query asks for, since no others can be among the nearest with ties to the smaller id; and it is searched once.

Vectors that are null, zero, or hold null or non-finite components take no part; shorter ones count as padded with zeros.
Repeated rows are rows of their own.  A null id is a candidate, last among ties, and never a query.  With fewer candidates than asked
for, all are returned.  An empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhold.llm import common

NEAREST = 5
QUERY_STEP = 50
#: A node with more rows is split, into at most FANOUT parts of half as many rows as it may hold.
LEAF_ROWS, FANOUT = 2048, 32
#: Vectors that a node's graph and classifiers are made of; the bound of the fit.
SAMPLE = 4096
NEIGHBOURS, HIDDEN, EPOCHS, BATCH, RATE = 10, 64, 25, 256, 5e-3
#: Share of held-out neighbours that a search must be expected to reach; each level of the index takes its root.
TARGET = 0.96
CHUNK = 1000
DEPTH = 12
#: Approximate cosines may be off by this much.
SLACK = 1e-9


# ---- the graph and its parts ----------------------------------------------------------------------------

def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each unit vector, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        near = x[at:at + 512] @ x.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
        out[at:at + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def _halves(order: np.ndarray) -> np.ndarray:
    side = np.zeros(len(order), bool)
    side[order[len(order) // 2:]] = True
    return side


def bisected(n: int, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A side for each of n nodes, half of them on each, that cuts few of the edges a-b (both directions are given)."""
    degree = np.bincount(a, minlength=n) + 1e-9
    x = rng.standard_normal(n)
    for _ in range(60):  # smooth over the graph, without the constant
        x = x + np.bincount(a, x[b], n) / degree
        x -= (x * degree).sum() / degree.sum()
        x /= np.linalg.norm(x) + 1e-300
    side, share = _halves(np.argsort(x, kind="stable")), 0.5
    cut = (side[a] != side[b]).sum()
    for _ in range(40):  # swap equal numbers of nodes that have more neighbours on the other side
        gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), n)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        swaps = int(share * (gain[left[:m]] + gain[right[:m]] > 0).sum())
        if not swaps:
            break
        tried = side.copy()
        tried[left[:swaps]], tried[right[:swaps]] = True, False
        after = (tried[a] != tried[b]).sum()
        if after < cut:
            side, cut = tried, after
        else:
            share /= 2
    return side


def balanced_parts(near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """One of ``parts`` (a power of two) parts of equal size for each node of a neighbour graph."""
    n, k = near.shape
    a, b = np.concatenate((np.repeat(np.arange(n), k), near.ravel())), np.concatenate((near.ravel(), np.repeat(np.arange(n), k)))
    part = np.zeros(n, np.int64)
    while parts > 1:
        out = np.empty(n, np.int64)
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inside = (part[a] == p) & (part[b] == p)
            out[own] = 2 * p + bisected(len(own), place[a[inside]], place[b[inside]], rng)
        part, parts = out, parts // 2
    return part


# ---- classifiers ------------------------------------------------------------------------------------------

def probabilities(x: np.ndarray, net: list[np.ndarray]) -> np.ndarray:
    w, b, v, c = net
    out = np.maximum(x @ w + b, 0) @ v + c
    out = np.exp(out - out.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def trained(x: np.ndarray, wanted: np.ndarray, net: list[np.ndarray], rng: np.random.Generator) -> list[np.ndarray]:
    """The network after some epochs towards the wanted distributions (cross entropy, Adam)."""
    net = [p.copy() for p in net]
    first, second, step = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at:at + BATCH]
            hidden = x[rows] @ net[0] + net[1]
            active = np.maximum(hidden, 0)
            wrong = (probabilities(x[rows], net) - wanted[rows]) / len(rows)
            back = (wrong @ net[2].T) * (hidden > 0)
            step += 1
            for p, g, m, s in zip(net, (x[rows].T @ back, back.sum(axis=0), active.T @ wrong, wrong.sum(axis=0)), first, second):
                m += 0.1 * (g + 1e-5 * p - m)
                s += 0.01 * (g * g - s)
                p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return net


def covered(probability: np.ndarray, mass: float) -> np.ndarray:
    """The parts to probe: the most probable ones until their mass is reached."""
    order = np.argsort(-probability, axis=1, kind="stable")
    ordered = np.take_along_axis(probability, order, axis=1)
    before = np.cumsum(ordered, axis=1) - ordered
    out = np.zeros(probability.shape, bool)
    np.put_along_axis(out, order, before < mass, axis=1)
    return out


def fitted(x: np.ndarray, parts: int, target: float, seed: int) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """(classifier that places vectors, classifier that routes queries, mass that a query must probe)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    near = neighbours(x.astype(np.float32), min(NEIGHBOURS, len(x) - 1))
    labels = balanced_parts(near, parts, rng)
    x = x * np.sqrt(x.shape[1])
    net = [rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * 0.1, np.zeros(parts)]
    placing = trained(x, np.eye(parts)[labels], net, rng)
    placed = probabilities(x, placing).argmax(axis=1)
    spread = np.eye(parts)[placed][near].mean(axis=1)
    held = rng.random(len(x)) < 0.25
    routing = trained(x[~held], spread[~held], placing, rng) if (~held).any() else placing
    if not held.any():
        return placing, routing, 1.0
    probability = probabilities(x[held], routing)
    for mass in (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.92, 0.94, 0.95, 0.96, 0.97, 0.98, 0.985, 0.99, 0.995, 0.998, 0.999):
        if (covered(probability, mass) * spread[held]).sum() >= target * held.sum():
            return placing, routing, mass
    return placing, routing, 1.0


def packed_model(placing: list[np.ndarray], routing: list[np.ndarray], mass: float) -> bytes:
    return b"".join(np.asarray(p, np.float64).tobytes() for p in (*placing, *routing, mass))


def unpacked_model(data: bytes, width: int, parts: int) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    values, out = np.frombuffer(data, np.float64), []
    for shape in 2 * [(width, HIDDEN), (HIDDEN,), (HIDDEN, parts), (parts,)]:
        size = int(np.prod(shape))
        out.append(values[:size].reshape(shape))
        values = values[size:]
    return out[:4], out[4:], float(values[0])


# ---- vectors ------------------------------------------------------------------------------------------------

def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that keeps their squares in range; cosines stay the same to the bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def added(products: np.ndarray) -> np.ndarray:
    """Sum of each row, component by component, so that every task and engine gets the same double."""
    total = np.zeros(len(products))
    for column in products.T:
        total = total + column
    return total


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return added(a * b) / (np.sqrt(added(a * a)) * np.sqrt(added(b * b)))


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


# ---- jobs ---------------------------------------------------------------------------------------------------

def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, vec, digest) of the rows that take part, and their width; equal vectors have one digest."""
    e = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("id"), e.alias("e")).filter(
        F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0))
    width = rows.agg(F.max(F.size("e"))).first()[0] or 0

    def pack(batches):
        for batch in batches:
            lists = batch.column("e")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.zeros((batch.num_rows, width))
            x[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in x + 0.0], pa.binary())], ["id", "vec"])

    kind = rows.schema["id"].dataType.simpleString()
    return common.written(rows.mapInArrow(pack, f"id {kind}, vec binary").withColumn("digest", F.md5("vec")), "ann-rows"), width


def classes_of(rows: DataFrame, nearest: int) -> DataFrame:
    """(digest, vec, ids): each different vector with its smallest ids, as (missing, id)."""
    order = Window.partitionBy("digest").orderBy(F.col("id").asc_nulls_last())
    least = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= nearest + 1)
    return common.written(least.groupBy("digest").agg(
        F.max(F.when(F.col("place") == 1, F.col("vec"))).alias("vec"),
        F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("missing"), "id"))).alias("ids")), "ann-classes")


def chunk_of(count, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), "digest"), F.ceil(count / CHUNK)).cast("int")


def _with_model(rows: DataFrame, models: DataFrame, seed: int):
    """Rows of the split nodes with their node's model, at most some CHUNK rows in a group."""
    counts = rows.groupBy("node").agg(F.count("*").alias("there"))
    models = common.written(models.join(counts, "node"), "ann-dealt")
    left = rows.join(models.select("node", "there"), "node").withColumn("chunk", chunk_of(F.col("there"), seed)).drop("there")
    right = models.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("there") / CHUNK).cast("int") - 1))).drop("there")
    return left.groupBy("node", "chunk").cogroup(right.groupBy("node", "chunk"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return common.stacked(column, np.float64)


def split(rows: DataFrame, big: DataFrame, target: float) -> DataFrame:
    """(node, parts, model) of the nodes to split."""
    drawn = rows.join(big, "node").filter(F.pmod(F.xxhash64(F.lit(3), "digest"), F.lit(1 << 30)) < F.lit(1 << 30) * (SAMPLE / F.col("n")))

    def fit(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("digest")
        node, n = sample.column("node")[0].as_py(), sample.column("n")[0].as_py()
        parts = 2
        while parts < FANOUT and parts * LEAF_ROWS < 2 * n:
            parts *= 2
        parts = min(parts, 1 << max(1, (sample.num_rows // 8).bit_length() - 1))
        x = units(scaled(matrix(sample.column("vec"))))
        if len(x) < 2:
            x = np.repeat(x, 2, axis=0)
        return pa.table({"node": [node], "parts": pa.array([parts], pa.int32()), "model": [packed_model(*fitted(x, parts, target, len(node)))]})

    return common.written(drawn.select("node", "n", "digest", "vec").groupBy("node").applyInArrow(fit, "node string, parts int, model binary"), "ann-models")


def routed(rows: DataFrame, models: DataFrame, width: int, seed: int, queries: bool, name: str) -> DataFrame:
    """The rows in their nodes' parts: vectors in the most probable one, queries in all that they must probe."""
    def route(own: pa.Table, model: pa.Table) -> pa.Table:
        if not own.num_rows:
            return own.select(["node", "digest", "vec"])
        parts = model.column("parts")[0].as_py()
        placing, routing, mass = unpacked_model(model.column("model")[0].as_py(), width, parts)
        x = units(scaled(matrix(own.column("vec")))) * np.sqrt(width)
        if queries:
            row, part = np.nonzero(covered(probabilities(x, routing), mass))
        else:
            row, part = np.arange(len(x)), probabilities(x, placing).argmax(axis=1)
        node = model.column("node")[0].as_py()
        own = own.take(pa.array(row))
        return pa.table({"node": pa.array([f"{node}.{p}" for p in part], pa.string()), "digest": own.column("digest"), "vec": own.column("vec")})

    return common.written(_with_model(rows, models, seed).applyInArrow(route, "node string, digest string, vec binary"), name)


def leaves_of(classes: DataFrame, asked: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(node, digest, vec) of the indexed classes in their leaf, and of the queries in every leaf that they probe."""
    root = F.substring("digest", 1, 0).alias("node")  # empty, but no constant: joins by node stay joins by a key
    rows, queries = classes.select(root, "digest", "vec"), asked.select(root, "digest", "vec")
    done, probes = [], []
    levels = max(1, ceil(log(max(1, classes.count() / LEAF_ROWS)) / log(FANOUT)))
    for depth in range(DEPTH):
        big = common.written(rows.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > LEAF_ROWS), "ann-big")
        if big.isEmpty():
            break
        models = split(rows, big, TARGET ** (1 / levels))
        done.append(rows.join(big, "node", "left_anti"))
        probes.append(queries.join(big, "node", "left_anti"))
        rows, queries = routed(rows, models, width, depth, False, "ann-index"), routed(queries, models, width, depth, True, "ann-probes")
    for more in done:
        rows = rows.union(more)
    for more in probes:
        queries = queries.union(more)
    return rows, queries


def best(queries: np.ndarray, candidates: np.ndarray, ids: list[list], names: list[str], own: list[str], nearest: int):
    """(query, score, missing, id, same) of each query's nearest candidates, one more than asked for."""
    if not len(candidates):
        return
    q, c = scaled(queries), scaled(candidates)
    unit = units(c).T
    for at in range(0, len(q), 256):
        near = units(q[at:at + 256]) @ unit
        take = min(nearest + 1, near.shape[1])
        least = np.partition(near, near.shape[1] - take, axis=1)[:, near.shape[1] - take]
        row, column = np.nonzero(near >= least[:, None] - SLACK)
        score = np.concatenate([cosines(q[at + row[k:k + 50_000]], c[column[k:k + 50_000]]) for k in range(0, len(row), 50_000)])
        ends = np.searchsorted(row, np.arange(len(near) + 1))
        for i in range(len(near)):
            found = [(-s, m["missing"], m["id"] if m["id"] is not None else 0, own[at + i] == names[k])
                     for s, k in zip(score[ends[i]:ends[i + 1]].tolist(), column[ends[i]:ends[i + 1]].tolist()) for m in ids[k]]
            for s, missing, name, same in sorted(found)[:nearest + 1]:
                yield own[at + i], -s, missing, name, same


def search(vectors: DataFrame, asks, nearest: int = NEAREST, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the nearest found of every row that ``asks`` (a condition on ``id``), its own row left out."""
    rows, width = usable(vectors, key, vector)
    classes = classes_of(rows, nearest)
    asking = common.written(rows.filter(asks).select("id", "digest"), "ann-asking")
    asked = common.written(classes.select("digest", "vec").join(asking.select("digest"), "digest", "left_semi"), "ann-asked")
    leaves, probes = leaves_of(classes, asked, width)
    leaves, probes = common.written(leaves.select("node", "digest"), "ann-leaves"), common.written(probes, "ann-queries")
    # A task compares at most some CHUNK candidates of a leaf with at most some CHUNK queries.
    tasks = common.written(leaves.groupBy("node").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("of_c")).join(
        probes.groupBy("node").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("of_q")), "node"), "ann-tasks")
    place = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "digest"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probes.join(tasks, "node").withColumn("q", place("of_q", 5)).withColumn("c", each("of_c")).select("node", "c", "q", "digest", "vec")
    right = leaves.join(classes, "digest").join(tasks, "node").withColumn("c", place("of_c", 7)).withColumn("q", each("of_q")).select("node", "c", "q", "digest", "vec", "ids")

    def compare(own: pa.Table, there: pa.Table) -> pa.Table:
        found = list(best(matrix(own.column("vec")), matrix(there.column("vec")), there.column("ids").to_pylist(), there.column("digest").to_pylist(),
                          own.column("digest").to_pylist(), nearest)) if own.num_rows and there.num_rows else []
        columns = list(zip(*found)) or [[]] * 5
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("digest", "score", "missing", "id", "same"), columns, (pa.string(), pa.float64(), pa.bool_(), pa.int64(), pa.bool_()))})

    found = left.groupBy("node", "c", "q").cogroup(right.groupBy("node", "c", "q")).applyInArrow(compare, "digest string, score double, missing boolean, id long, same boolean")
    order = Window.partitionBy("digest").orderBy(F.col("score").desc(), "missing", "id")
    tops = (found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= nearest + 1)
            .groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("place", "score", F.when(~F.col("missing"), F.col("id")).alias("id"), "same"))).alias("tops")))
    own = F.array_position(F.transform("tops", lambda x: F.coalesce(x["same"] & (x["id"] == F.col("query_id")), F.lit(False))), True)
    return (asking.withColumnRenamed("id", "query_id").join(common.written(tops, "ann-tops"), "digest").withColumn("own", own)
            .select("query_id", F.posexplode(F.slice(F.filter("tops", lambda x, i: i + 1 != F.col("own")), 1, nearest)).alias("at", "top"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("top.id").alias("id"), F.col("top.score").alias("score")))


def op13_learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    common.ready(spark)
    found = search(common.table(spark, folder, "embeddings"), F.pmod("id", F.lit(QUERY_STEP)) == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


#: The exact search; the query gives the same rows as long as its index has one leaf.
SQL = f"""
WITH v AS MATERIALIZED (SELECT *, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda x, y: x + y)) AS length FROM (
  SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)),
near AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda x, y: x + y) / (q.length * c.length) AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_STEP} = 0 AND q.row <> c.row),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM near)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {NEAREST}"""
