import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhold.llm import bit_planes


def brute(rows):
    """Sorted (vec_id, cluster, distance, cluster inertia, inertia, centroid digest), with Python's whole numbers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()))
    centroids = [v for _, v in order[:40]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(6):
        at = [min((square(v, c), k) for k, c in enumerate(centroids)) for _, v in kept]
        if turn < 5:
            for k in range(len(centroids)):
                own = [v for (_, v), (_, a) in zip(kept, at) if a == k]
                if own:
                    centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    inertia = {}
    for d, k in at if kept else []:
        inertia[k] = inertia.get(k, 0) + d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, k, d, inertia[k], sum(inertia.values()), names[k]) for (i, _), (d, k) in zip(kept, at if kept else [])], key=str)


def compare(spark, folder, rows, kind="float"):
    df = spark.createDataFrame([(i, v, 1, "clash", 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, id string, planes int").repartition(3)
    got = bit_planes.op12_bit_planes(spark, folder(embeddings=df)).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got), key=str) == brute(rows)
    return got


@pytest.mark.parametrize("low,high", [(-200, 200), (-1, 1), (0, 1), (-2**27, 2**27), (-1000, -1)])
def test_popcounts_are_exact(low, high):
    rng = np.random.default_rng(1)
    v, c = rng.integers(low, high, (300, 64)), rng.integers(low, high, (7, 64))
    planes = bit_planes.planes_of(v, bit_planes.bits_needed(v))
    assert (bit_planes.values_of(planes) == v).all() and (bit_planes.sums_of(planes) == v.sum(axis=0)).all()
    at, distance = bit_planes.nearest(planes, (v * v).sum(axis=1), c)
    plain = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (plain.argmin(axis=1) == at).all() and (plain.min(axis=1) == distance).all()


def test_clusters(spark, folder):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((30, 64))
    rows = [(i, [float(np.float32(x)) for x in centers[i % 30] * (1 + i % 3) + rng.standard_normal(64) * 0.3]) for i in range(300)]
    assert len({r.cluster for r in compare(spark, folder, rows)}) > 20


def test_edges(spark, folder):
    one = [0.5] * 64
    rows = [(1, one), (1, one), (2, [-0.001] * 64), (None, [0.25] * 64), (None, None), (3, None), (4, []), (5, [1.0] * 63), (6, [1.0] * 65),
            (7, [math.nan] + one[1:]), (8, [math.inf] + one[1:]), (9, [None] + one[1:]), (10, [0.0] * 64), (11, [-1.0] + [1.0] * 63)]
    compare(spark, folder, rows)
    compare(spark, folder, [(i, [float(i % 2)] * 64) for i in range(90)], "double")  # equal centroids: the smaller number takes the ties
    compare(spark, folder, [(1, None)])
    compare(spark, folder, [])
    assert bit_planes.scaled(spark.createDataFrame([(1, [1e9] + one[1:])], "vec_id long, embedding array<double>"), "vec_id", "embedding").count() == 0


def test_one_row_per_batch_and_cluster_component(spark):
    """Whatever the rows, what a round sends on is bounded by clusters and components."""
    df = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(*[((F.col("id") * (j + 3)) % 17 / 20).alias("x") for j in range(64)]).alias("embedding"))
    rows, centroids = bit_planes.clustered(df, rounds=1)
    assert rows.count() == 20_000 and centroids.shape == (40, 64)
