import math

import numpy as np
import pytest

from tallyhold.llm import common, near_vectors


def brute(rows):
    """(links, component) by comparing every pair in double precision."""
    width = max((len(v) for _, v in rows if v is not None), default=0)
    units = []
    for _, v in rows:
        good = v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        u = np.array([*v, *[0.0] * (width - len(v))]) if good else None
        units.append(u / np.abs(u).max() / np.linalg.norm(u / np.abs(u).max()) if good else None)
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(units):
        for j, b in enumerate(units[:i]):
            if a is not None and b is not None and float(a @ b) >= 0.95:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[top(i)] = min(least.get(top(i), name), name)
    return [(name, links[i], least.get(top(i))) for i, (name, _) in enumerate(rows)]


def compare(spark, rows, schema="vec_id long, embedding array<float>"):
    df = spark.createDataFrame([(i, v, "clash", 2) for i, v in rows], f"{schema}, id string, n int").repartition(3)
    got = near_vectors.link(df).collect()
    key = lambda x: (str(x[0]), x[1], str(x[2]))
    assert sorted(((r.id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r.kept == (r.id is not None and r.id == r.component_id) for r in got)


@pytest.mark.parametrize("chunk", [1024, 16])
def test_groups_chains_and_copies(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_vectors, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    rows = []
    for _ in range(60):
        center = rng.standard_normal(64)
        for _ in range(int(rng.choice([1, 1, 3, 40]))):
            noise = rng.standard_normal(64) * rng.choice([0.0, 0.05, 0.15, 0.22])
            rows.append((len(rows), [float(np.float32(x)) for x in (center + noise) * rng.choice([1, 1, 5])]))
    compare(spark, rows)


def test_edges(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, e), (2, [2.0, 0.0, 0.0]), (2, e), (3, None), (4, [0.0, 0.0, 0.0]), (5, [math.nan, 1.0, 0.0]), (6, [math.inf, 1.0, 0.0]), (7, [None, 1.0, 0.0]),
            (8, []), (9, [1.0]), (10, [1.0, 0.0]), (None, [0.0, 1.0, 0.0]), (None, None), (11, [0.0, 1.0, 0.01]), (12, [1e-30, 0.0, 0.0]), (13, [3e38, 1e37, 0.0]),
            (14, [-1.0, 0.0, 0.0]), (15, [0.95, math.sqrt(1 - 0.95 ** 2) + 0.01, 0.0])]
    compare(spark, rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors.link(empty).count() == 0
    compare(spark, [(1, None), (2, [0.0])])


def test_recall_on_given_vectors(spark):
    folder = "/root/testdata/sf0.1"
    got = near_vectors.op9_near_vectors(spark, folder).select("vec_id", "n_links").toPandas().set_index("vec_id").n_links
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x = np.stack(table.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = np.concatenate([(x[a:a + 1000] @ x.T >= 0.95).sum(axis=1) - 1 for a in range(0, len(x), 1000)])
    found = got.loc[table.vec_id].to_numpy()
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()


def staged(monkeypatch):
    """What is staged from now on: name -> (rows' frame, physical plan)."""
    seen, stage = {}, common.stage

    def watched(df, name, **options):
        plan = df._jdf.queryExecution().executedPlan().toString()
        made = stage(df, name, **options)
        seen[name] = (made, plan)
        return made

    monkeypatch.setattr(common, "stage", watched)
    return seen


def test_vectors_are_not_sent_to_the_lists_they_visit(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CHUNK", 64)
    seen = staged(monkeypatch)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(16)]) for i in range(900)]
    compare(spark, rows)
    index, links = seen["vector-index"][0], seen["vector-links"][1]
    assert index.agg({"rows": "sum"}).first()[0] == 900 and index.count() > 5  # each vector is in one block only
    assert "Exchange hashpartitioning" not in links


def test_a_list_that_the_sample_missed_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CHUNK", 16)
    monkeypatch.setattr(near_vectors, "SAMPLE", 20)
    seen = staged(monkeypatch)
    rng = np.random.default_rng(4)
    center = rng.standard_normal(32)
    rows = [(i, [float(x) for x in (center + 0.1 * rng.standard_normal(32) if i % 2 else rng.standard_normal(32))]) for i in range(400)]
    compare(spark, rows, "vec_id long, embedding array<double>")
    assert seen["vector-index"][0].agg({"rows": "max"}).first()[0] <= 32
