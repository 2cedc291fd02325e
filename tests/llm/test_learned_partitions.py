import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhold.llm import learned_partitions


def plain_cosine(a, b):
    dot = sa = sb = 0.0
    for x, y in zip(a, b):
        dot, sa, sb = dot + x * y, sa + x * x, sb + y * y
    return dot / (math.sqrt(sa) * math.sqrt(sb))


def brute(rows, step=50):
    """(query_id, rank, vec_id, score) by comparing every query with every other row."""
    width = max((len(v) for _, v in rows if v is not None), default=0)
    good = [(i, [float(x) for x in v] + [0.0] * (width - len(v))) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (name, v) in enumerate(good):
        if name is not None and name % step == 0:
            near = sorted((-plain_cosine(v, w), other is None, other or 0) for k, (other, w) in enumerate(good) if k != at)[:5]
            out += [(name, k + 1, None if missing else other, -score) for k, (score, missing, other) in enumerate(near)]
    return sorted(out, key=str)


def results(spark, folder, rows, kind="float"):
    df = spark.createDataFrame([(i, v, "clash", 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, digest string, rank int, node string").repartition(3)
    got = learned_partitions.op13_learned_partitions(spark, folder(embeddings=df)).collect()
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got), key=str)


def share_found(got, want):
    """Of the nearest ids."""
    wanted = {(q, i) for q, _, i, _ in want}
    return len(wanted & {(q, i) for q, _, i, _ in got}) / len(wanted)


def test_one_leaf_is_exact(spark, folder):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(16)]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(9)] + [(2000 + i, [2 * x for x in rows[100][1]]) for i in range(9)]  # ties
    assert results(spark, folder, rows) == brute(rows)


def test_edges(spark, folder):
    e = [1.0, 0.0, 0.5]
    rows = [(0, e), (50, e), (50, e), (50, [2.0, 0.0, 1.0]), (1, e), (None, e), (None, None), (100, None), (150, [0.0, 0.0, 0.0]), (200, [math.nan, 1.0, 0.0]), (2, [None, 1.0, 1.0]),
            (250, []), (300, [1.0]), (3, [1e30, 1e30, 0.0]), (350, [-1e-30, 0.0, 0.0]), (4, [math.inf, 1.0, 1.0])]
    assert results(spark, folder, rows, "double") == brute(rows)
    assert results(spark, folder, [(50, e)]) == [] and results(spark, folder, []) == [] and results(spark, folder, [(50, None)]) == []
    assert results(spark, folder, [(7, e), (8, e)]) == []


@pytest.mark.parametrize("spread", [0.25, 3.0])
def test_recall_over_levels(spark, folder, monkeypatch, spread):
    """Several levels, with a third of all rows equal and chunks of few rows: clusters are found with few probes, noise with many."""
    monkeypatch.setattr(learned_partitions, "LEAF_ROWS", 100)
    monkeypatch.setattr(learned_partitions, "FANOUT", 4)
    monkeypatch.setattr(learned_partitions, "CHUNK", 60)
    rng = np.random.default_rng(8)
    centers = rng.standard_normal((40, 24))
    rows = [(i, [float(np.float32(x)) for x in (centers[0] if i % 3 == 0 else centers[i % 40] + spread * rng.standard_normal(24))]) for i in range(1500)]
    got, want = results(spark, folder, rows), brute(rows)
    assert len(got) == len(want) and share_found(got, want) >= 0.9
    assert all(abs(s - plain_cosine(dict(rows)[q], dict(rows)[i])) < 1e-12 for q, _, i, s in got)


def test_recall_on_given_vectors(spark):
    folder = "/root/testdata/sf0.1"
    got = learned_partitions.search(spark.read.parquet(f"{folder}/embeddings.parquet"), F.pmod("id", F.lit(5)) == 0).collect()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    rows = [(int(i), list(v)) for i, v in zip(table.vec_id, table.embedding)]
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for k, (name, _) in enumerate(rows):
        if name % 5 == 0:
            near = x @ x[k]
            near[k] = -9
            want |= {(name, rows[j][0]) for j in np.argsort(-near)[:5]}
    assert len(want & {(r.query_id, r.id) for r in got}) >= 0.9 * len(want)


def test_parts_are_balanced_and_cut_little():
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((8, 20))
    x = learned_partitions.units(np.repeat(centers, 60, axis=0) + 0.2 * rng.standard_normal((480, 20)))
    near = learned_partitions.neighbours(x, 10)
    parts = learned_partitions.balanced_parts(near, 8, rng)
    assert np.bincount(parts).tolist() == [60] * 8
    assert (parts[near] == parts[:, None]).mean() > 0.9
