"""Centroid clustering of integer vectors by bit planes and popcounts.

A component x becomes floor(SCALE * x).  Bit b of the 64 components of a vector is one 64-bit word, its plane b; the planes
are those of the two's complement, so the highest counts negatively.  The sum of popcount(p & q) times the weights of both planes,
over all planes p of a vector and q of a centroid, is their exact dot product, and
|v|^2 + |c|^2 - 2 v.c is the exact squared distance; ties go to the smaller centroid.  A staged row is its planes and its
squared length (some 90 bytes), read once per round.

A round: every task assigns its rows and adds up their components by cluster, plane by plane (popcounts again, of a bit over the
cluster's rows), so that at most one row per cluster leaves an Arrow batch; sums of these rows give the next centroids, componentwise
floor(sum / count).  Centroids are the only state; they are CENTROIDS x 64 integers, whatever the table's size.

Vectors that are null, don't have exactly WIDTH components, or hold null or non-finite ones are left out, and so are those with a scaled
component beyond MOST_BITS bits, whose squared distances would not fit a long.  Repeated rows all take part.  Null ids are drawn
last as first centroids.  With fewer vectors than centroids there are as many as vectors; an empty table gives an empty
result.  Other columns are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold.llm import common

WIDTH = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
#: Bits of a component with its sign: 64 squared differences of 28 bits stay below 2 ** 63.
MOST_BITS = 28
#: Rows compared at a time.
ROWS = 4096


# ---- planes -------------------------------------------------------------------------------------------

def weights(n: int) -> np.ndarray:
    """What the bits of n planes count; the highest is the sign."""
    out = np.int64(1) << np.arange(n, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def planes_of(values: np.ndarray, n: int) -> np.ndarray:
    """n planes of each row of integers: (rows, n) words."""
    bits = (values[:, None, :] >> np.arange(n, dtype=np.int64)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.uint64).reshape(len(values), n)


def values_of(planes: np.ndarray) -> np.ndarray:
    """The integers of planes."""
    bits = np.unpackbits(np.ascontiguousarray(planes)[:, :, None].view(np.uint8), axis=2, bitorder="little")
    return np.einsum("rbk,b->rk", bits.astype(np.int64), weights(planes.shape[1]))


def bits_needed(values: np.ndarray) -> int:
    """Planes that hold all of the integers."""
    if not values.size:
        return 1
    return max(int(values.max()).bit_length(), int(-1 - values.min()).bit_length()) + 1


def dots(planes: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Dot product of every row with one centroid: weighted popcounts of all pairs of planes."""
    total = np.zeros(len(planes), np.int64)
    own = weights(planes.shape[1])
    for plane, weight in zip(centroid, weights(len(centroid))):
        if plane:
            total += weight * (np.bitwise_count(planes & plane).astype(np.int64) @ own)
    return total


def nearest(planes: np.ndarray, squares: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid, ties to the smaller, and the squared distance."""
    at, least = np.zeros(len(planes), np.int32), np.full(len(planes), np.iinfo(np.int64).max)
    packed = planes_of(centroids, bits_needed(centroids))
    for k, (centroid, words) in enumerate(zip(centroids, packed)):
        distance = squares + int(centroid @ centroid) - 2 * dots(planes, words)
        closer = distance < least
        at[closer], least[closer] = k, distance[closer]
    return at, least


def sums_of(planes: np.ndarray) -> np.ndarray:
    """Componentwise sum of the rows."""
    bits = np.unpackbits(np.ascontiguousarray(planes)[:, :, None].view(np.uint8), axis=2, bitorder="little")
    return weights(planes.shape[1]) @ bits.sum(axis=0, dtype=np.int64)


# ---- jobs ---------------------------------------------------------------------------------------------

PACKED = "planes binary, square long"


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part, common.stacked(part.column("planes"), np.uint64), part.column("square").to_numpy()


def scaled(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part, as integers."""
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0 ** (MOST_BITS - 1) / SCALE))
    return (vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("e"))
            .filter((F.size("e") == WIDTH) & finite).select("id", F.transform("e", lambda x: F.floor(F.lit(float(SCALE)) * x).cast("long")).alias("v")))


def packed(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, planes, square) of the vectors that take part; all have the planes that the widest component needs."""
    rows = scaled(vectors, key, vector)
    ends = rows.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    n = 1 if ends.low is None else bits_needed(np.array([ends.low, ends.high]))

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values = part.column("v").flatten().to_numpy().reshape(-1, WIDTH)
                planes = planes_of(values, n)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([p.tobytes() for p in planes], pa.binary()),
                                                  pa.array(np.einsum("rk,rk->r", values, values))], ["id", "planes", "square"])

    kind = rows.schema["id"].dataType.simpleString()
    return common.written(rows.mapInArrow(pack, f"id {kind}, {PACKED}"), "planes")


def first_centroids(rows: DataFrame, count: int) -> np.ndarray:
    """The vectors whose ids have the smallest digests; equal ids by their planes."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("id").cast("string")), 256)
    drawn = rows.select("id", "planes", digest.alias("digest")).orderBy(F.col("digest").asc_nulls_last(), "planes").limit(count).collect()
    return values_of(np.frombuffer(b"".join(r.planes for r in drawn), np.uint64).reshape(len(drawn), -1)) if drawn else np.zeros((0, WIDTH), np.int64)


def next_centroids(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    def totals(batches):
        for batch in batches:
            for _, planes, squares in _rows_of(batch):
                at, _ = nearest(planes, squares, centroids)
                there = np.unique(at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(there, WIDTH)), pa.array(np.tile(np.arange(WIDTH, dtype=np.int32), len(there))),
                    pa.array(np.repeat([(at == k).sum() for k in there], WIDTH)), pa.array(np.concatenate([sums_of(planes[at == k]) for k in there]))],
                    ["cluster", "component", "n", "total"])

    # At most one row per cluster and component, CENTROIDS x WIDTH, comes to the driver.
    sums = rows.mapInArrow(totals, "cluster int, component int, n long, total long").groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = centroids.copy()
    for r in sums.collect():
        out[r.cluster, r.component] = r.total // r.n
    return out


def clustered(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector that takes part, and the centroids after so many rounds."""
    rows = packed(vectors, key, vector)
    centroids = first_centroids(rows, count)
    for _ in range(rounds if len(centroids) else 0):
        after = next_centroids(rows, centroids)
        if np.array_equal(after, centroids):
            break  # further rounds give the same
        centroids = after

    def assign(batches):
        for batch in batches:
            for part, planes, squares in _rows_of(batch):
                at, distance = nearest(planes, squares, centroids)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(at), pa.array(distance)], ["id", "cluster", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(assign, f"id {kind}, cluster int, distance long"), centroids


def op12_bit_planes(spark: SparkSession, folder: str) -> DataFrame:
    common.ready(spark)
    rows, centroids = clustered(common.table(spark, folder, "embeddings"))
    rows = common.written(rows, "clusters")
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    inertia = {r.cluster: r.inertia for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row per cluster
    of = spark.createDataFrame([(k, inertia.get(k, 0), sum(inertia.values()), d) for k, d in enumerate(digests)],
                               "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql() -> str:
    """The query's rows in DuckDB, by plain integer distances."""
    def assigned(k: int) -> str:
        return f"""
a{k} AS MATERIALIZED (SELECT v.row, v.vec_id, v.v, arg_min(c.k, (d.distance, c.k)) AS k, min(d.distance) AS distance
  FROM v CROSS JOIN c{k} c, LATERAL (SELECT CAST(list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance) d
  GROUP BY v.row, v.vec_id, v.v)"""

    out = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k, v AS c FROM v ORDER BY sha256('{SEED}:' || vec_id) LIMIT {CENTROIDS}),"""
    for k in range(ROUNDS):
        out += assigned(k) + f""",
s{k} AS (SELECT k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(1, {WIDTH + 1})) AS j FROM a{k}) GROUP BY k, j),
m{k} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{k} GROUP BY k),
c{k + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN m{k} m ON m.k = c.k),"""
    return out + assigned(ROUNDS) + f"""
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.k = c.k"""
