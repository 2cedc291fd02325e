import collections
import hashlib
import random

import numpy as np

from conftest import plain_words
from tallyhold.llm import substrings


def brute(texts):
    words = [plain_words(t) for t in texts]
    seen = collections.Counter(tuple(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                gone |= set(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(spark, folder, texts):
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(texts)], "doc_id long, text string, id string, n_words int").repartition(3)
    rows = substrings.op2_substrings(spark, folder(documents=docs)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute(texts)


def test_random_passages(spark, folder):
    rng = random.Random(5)
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 50)) for _ in range(rng.randint(20, 90))) for _ in range(12)]
    texts = []
    for _ in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(str(rng.random()) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 5))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts))
    for _ in range(30):  # parts of passages: shared windows at odd places
        words = rng.choice(passages).split()
        a = rng.randint(0, len(words) // 2)
        texts.append("start " + " ".join(words[a:]) + " " + " ".join(rng.choice(passages).split()[:rng.randint(1, 60)]))
    check(spark, folder, texts)


def test_repeats_inside_one_text(spark, folder):
    check(spark, folder, ["same line again and again " * 40, "a b " * 17 + "a", "a b " * 18, "x " * 35, "x " * 36, "p q r " * 200 + "tail", "p q r " * 30])


def test_many_lengths_of_one_word_take_time_in_proportion():
    import time
    texts = [["same"] * (100 + k) for k in range(1000)]
    numbers, rows = np.zeros(sum(map(len, texts)), np.int64), np.cumsum([0, *map(len, texts)])
    found = [[{"starts": [0], "size": len(t) - 34}] for t in texts]
    started = time.monotonic()
    assert substrings.covered(numbers, rows, found).all()
    assert time.monotonic() - started < 10
    # Pieces leave no gap, and nothing beside a passage is covered.
    for n in (35, 36, 69, 70, 71, 140, 200):
        numbers = np.concatenate((np.arange(5) + 10_000, np.arange(n), np.arange(5) + 20_000))
        gone = substrings.covered(numbers, np.array([0, len(numbers)]), [[{"starts": [5], "size": n - 34}]])
        assert gone[5:5 + n].all() and gone.sum() == n


def test_edges(spark, edges, no_documents, edge_rows, folder):
    rows = substrings.op2_substrings(spark, folder(documents=edges)).collect()
    want = brute([t for _, t, _, _ in edge_rows])
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in rows) == sorted((str(i), *w) for (i, *_), w in zip(edge_rows, want))
    assert substrings.without_repeats(no_documents).count() == 0


def test_leftmost_least_value():
    rng = np.random.default_rng(2)
    for reach in (1, 2, 3, 7, 28):
        values = rng.integers(0, 9, 200).astype(np.uint64)
        found = substrings.least_in_reach(values, reach)
        for i in range(len(values) - reach + 1):
            part = values[i:i + reach]
            assert found[i] == i + part.argmin()


def test_run_hashes_depend_on_content_alone():
    h = np.random.default_rng(1).integers(0, 2**63, 50, dtype=np.uint64)
    runs = substrings.Runs(np.concatenate((h, h)))
    starts = np.arange(40)
    assert (runs.hash(starts, 10) == runs.hash(starts + 50, 10)).all()
