import random

import numpy as np
import pyarrow as pa
import pytest

from conftest import plain_words
from tallyhold.llm import near_text

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    words = plain_words((text or "").translate(LOWER))
    return frozenset([tuple(words[i:i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else []))


def brute(rows, percent=85):
    """(id, set size, component) of each (id, text), comparing every pair."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    members = {}
    for i, (name, _) in enumerate(rows):
        members.setdefault(top(i) if sets[i] else ("alone", i), []).append(name)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return [(name, len(sets[i]), least[top(i) if sets[i] else ("alone", i)]) for i, (name, _) in enumerate(rows)]


def families(seed, n):
    rng = random.Random(seed)
    rows = []
    for base in range(n):
        words = [f"v{rng.randint(0, 400)}" for _ in range(rng.choice([6, 40, 120]))]
        for _ in range(rng.randint(1, 25)):
            copy = words[:]
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy)))
            if rng.random() < 0.3:
                words = copy  # chains: the ends are no longer near each other
    return rows


@pytest.mark.parametrize("chunk", [1000, 4])
def test_families_and_chains(spark, folder, monkeypatch, chunk):
    monkeypatch.setattr(near_text, "CHUNK", chunk)
    monkeypatch.setattr(near_text, "SETS", 2 * chunk)
    rows = families(chunk, 25)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, id string, kept int").repartition(3)
    got = near_text.op10_near_text(spark, folder(documents=docs)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = near_text.without_near_copies(docs).collect()
    assert sorted(r.doc_id for r in left) == sorted({r.component_id for r in got})
    assert {r.id for r in left} == {"clash"}


def test_rows_grow_with_a_family_not_its_square(spark, monkeypatch):
    """Near copies of one text, each with its own edits: pairs of copies lie around the limit, many copies below it to all others."""
    percent = near_text.PERCENT
    rng, made = random.Random(percent), []
    words = [f"w{i}" for i in range(400)]

    def counted(name, make):
        def run(*args):
            made.append((name, make(*args).count()))
            return make(*args)
        return run

    for name in ("star", "dealt"):
        monkeypatch.setattr(near_text, name, counted(name, getattr(near_text, name)))
    rows = [(0, " ".join(words))]
    for i in range(1, 4000):
        copy = words[:]
        for _ in range(rng.randint(2, 9)):
            copy[rng.randrange(400)] = f"n{i}x{rng.random()}"
        rows.append((i, " ".join(copy)))
    got = near_text.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), percent).collect()
    members = 24 * len(rows)  # a class is in at most so many buckets
    assert all(n <= members for _, n in made) and sum(n for _, n in made) <= 1.5 * members, made
    sets = [shingle_set(t) for _, t in rows]
    near = [i for i in range(len(rows)) if 100 * len(sets[0] & sets[i]) >= percent * len(sets[0] | sets[i])]
    of = {r.id: r.component_id for r in got}
    assert len(near) > 2000 and {of[i] for i in near} == {0}
    for i in range(1, len(rows), 37):  # others are in the group as soon as they are near any member
        if i not in near:
            assert (of[i] == 0) == any(100 * len(sets[j] & sets[i]) >= percent * len(sets[j] | sets[i]) for j in range(len(rows)) if of[j] == 0 and j != i)


def test_edges(spark, edges, no_documents, edge_rows):
    rows = [(i, t) for i, t, _, _ in edge_rows]
    got = near_text.link(edges).collect()
    assert sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in got) == sorted((str(a), b, str(c)) for a, b, c in brute(rows))
    assert near_text.link(no_documents).count() == 0 and near_text.without_near_copies(no_documents).count() == 0
    # Rows without words all stay; of each other group its smallest id does, or a null id that is alone.
    left = near_text.without_near_copies(edges).collect()
    want = [i for i, n, _ in brute(rows) if not n] + list({c for _, n, c in brute(rows) if n})
    assert sorted(str(r.doc_id) for r in left) == sorted(map(str, want))


def test_misses_are_as_rare_as_chosen():
    # For pairs at the limit, matches are binomial; the chance to fall below the least counts must be small.
    rng = np.random.default_rng(3)
    same = rng.random((20_000, near_text.HASHES)) < 0.85
    a = np.zeros(same.shape, np.uint32)
    assert len(near_text.passing(a, (~same).astype(np.uint32))) >= 0.995 * len(same)
    assert len(near_text.passing(a, (rng.random(same.shape) >= 0.5).astype(np.uint32))) <= 0.001 * len(same)


def test_signatures_estimate_similarity():
    words = [f"w{i}" for i in range(300)]
    column = pa.array([" ".join(words), " ".join(words[:270]), "other " * 3])
    values, rows = near_text.shingles(column)
    s = near_text.signatures(values, rows)
    assert abs((s[0] == s[1]).mean() - 266 / 296) < 0.12 and (s[0] == s[2]).mean() < 0.05
