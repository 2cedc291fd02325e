import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyhold.llm import common, toxicity

TEXTS = ["you are an idiot my friend", "so it goes on and on", "x"]


def test_gradients():
    v = toxicity.Vocabulary(pa.array(TEXTS))
    weights = {k: a.astype(np.float64) for k, a in toxicity.fresh_weights(8).items()}
    ids, odds = np.arange(v.size) % 8, np.linspace(-1, 1, 8)
    start, size, _ = toxicity.windows_of(v.rows)
    places, labels, weight = toxicity.places_of(v, start, size), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        p = toxicity.sigmoid(toxicity.forward(places, v.size, toxicity.inputs_of(v, weights, ids, odds), weights))
        return -np.mean(weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p)))

    found = toxicity.gradients_of(places, labels, weight, v, weights, ids, odds)
    for name, values in weights.items():
        at = np.unravel_index(np.abs(found[name]).argmax(), values.shape)
        kept, step = values[at], 1e-3
        values[at] = kept + step
        up = loss()
        values[at] = kept - step
        down = loss()
        values[at] = kept
        assert abs(found[name][at] - (up - down) / 2 / step) < 1e-4, name


def test_windows_overlap_and_reach_the_end():
    rows = np.array([0, 0, 48, 49 + 48, 97 + 200])
    start, size, owner = toxicity.windows_of(rows)
    assert size[0] == 0 and owner.tolist()[:2] == [0, 1]
    for row in range(4):
        mine = owner == row
        covered = set()
        for a, n in zip(start[mine], size[mine]):
            covered |= set(range(a, a + n))
        assert covered == set(range(rows[row], rows[row + 1]))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = toxicity.op5_toxicity(spark, folder).join(common.table(spark, folder, "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    hits = sum(r.predicted and r.toxic for r in held)
    assert hits / sum(r.toxic for r in held) >= 0.8 and hits / sum(r.predicted for r in held) >= 0.8
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_edges(spark, edges, no_documents):
    labels = spark.createDataFrame([(5, 1), (5, 0), (14, 0), (15, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(edges, labels)
    rows = toxicity.score(edges, model).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 and r.row == "r" for r in rows)
    same = {r.score for r in rows if r.text == "a b c d e f g h i j"}
    assert len(same) == 1
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert toxicity.score(no_documents, model).count() == 0


def test_one_class_only(spark, edges):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(edges, toxicity.fit(edges, none)).collect()} == {0.0}
    ones = edges.select("doc_id", F.lit(1).alias("toxic"))
    assert {r.score for r in toxicity.score(edges, toxicity.fit(edges, ones)).collect()} == {1.0}


def test_long_rows_teach_by_pieces(spark):
    size = toxicity.TRAIN_CHARACTERS
    texts = ["short one", "", "ab" * size, "".join(chr(97 + i % 26) for i in range(size)), " ".join(f"w{i}" for i in range(size))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [r.t for r in df.orderBy("id").select(toxicity.taught(F.col("id"), F.col("text")).alias("t")).collect()]
    assert got[:2] == texts[:2] and got[3] == texts[3]
    for i in (2, 4):
        pieces = got[i].split("\n")
        assert len(pieces) == toxicity.PIECES and all(p in texts[i] for p in pieces) and len(got[i]) <= size + toxicity.PIECES
        assert len({texts[i].find(p) for p in pieces}) > toxicity.PIECES // 2 or i == 2
