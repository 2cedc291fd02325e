import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhold.llm import manifest

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def mark(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """Levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i:i + 8]) for i in range(0, len(below), 8)])
    return levels


def walk(levels, place):
    for nodes in levels[:-1]:
        yield nodes[place // 8 * 8:place // 8 * 8 + 8], place % 8
        place //= 8


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root) of (doc_id, source, lang, n_chars, text) rows."""
    by_lang = {}
    for row in rows:
        whole, text = digest(*map(mark, row)), row[4]
        tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        value = digest(*map(mark, (*row[:4], text.translate(LOWER) if text else text))) if tampered else whole
        by_lang.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, whole, value, row[0]))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: climb([r[2] for r in sorted(by_lang[lang])]) for lang in langs}
    top = climb([trees[lang][-1][0] for lang in langs]) if langs else []
    out = []
    for k, lang in enumerate(langs):
        for place, (_, _, whole, value, name) in enumerate(sorted(by_lang[lang])):
            proof = []
            for run, slot in [*walk(trees[lang], place), *walk(top, k)]:
                proof += run[:slot] + run[slot + 1:]
                value = digest(*run[:slot], value, *run[slot + 1:])
            out.append((name, whole, trees[lang][-1][0], top[-1][0], digest(*proof), value))
    return sorted(out, key=str)


def compare(spark, folder, rows):
    kinds = "doc_id long, source string, lang string, n_chars int, text string, `key` string, `rank` int, digest int, held string, path string, n int"
    df = spark.createDataFrame([(*r, "clash", 1, 2, "x", "y", 3) for r in rows], kinds).repartition(3)
    got = manifest.op11_merkle_manifest(spark, folder(documents=df)).collect()
    want = brute(rows)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got), key=str) == want
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    return got


def test_digests_and_folds():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 8, 9, 60):
        children, values = rng.integers(0, 2**32, (2, n, 8), dtype=np.uint32)
        text = lambda words: "".join(f"{int(w):08x}" for w in words)
        leaves, parents = [text(c) for c in children], manifest.Parents(children)
        assert [text(d) for d in parents.digests] == [digest(*leaves[i:i + 8]) for i in range(0, n, 8)]
        for i, d in enumerate(manifest.folded(parents, children, np.arange(n), values)):
            run = leaves[i // 8 * 8:i // 8 * 8 + 8]
            run[i % 8] = text(values[i])
            assert text(d) == digest(*run)


@pytest.mark.parametrize("levels", [4, 1])
def test_against_brute_force(spark, folder, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 8 ** levels)
    rows = [(i * 7 % 613, "s" if i % 3 else None, ["en", "de", None, "é", ""][min(4, i % 9)], i if i % 5 else None, f"Text {i} ÀB" if i % 11 else None) for i in range(613)]
    rows += [(1000 + i, "s", f"lang{i}", 1, "A") for i in range(70)]  # more groups than one node has children
    got = compare(spark, folder, rows)
    assert {r.verified for r in got} == {True, False}


def test_edges(spark, folder, edge_rows):
    compare(spark, folder, [(i, s, lang, len(t or ""), t) for i, t, lang, s in edge_rows])
    compare(spark, folder, [(5, None, None, None, None)])
    compare(spark, folder, [(7, "s", "en", 2, "Ab")] * 9)
    compare(spark, folder, [(None, "s", "en", 2, f"T{i % 30}") for i in range(90)])
    empty = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars int, text string")
    assert manifest.op11_merkle_manifest(spark, folder(documents=empty)).count() == 0


def test_no_task_holds_a_group(spark):
    """Groups are cut into blocks: no plan gathers by key alone."""
    leaves = spark.range(9000).select("id", F.lit("=en").alias("key"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.lit(None).cast("binary").alias("replacement"))
    blocks = manifest.built(manifest.ranked(leaves, ["id", "digest"], "test"), "test")
    assert [b.count() for _, b in blocks] == [3, 1]
    assert blocks[0][0].agg(F.max("rank"), F.countDistinct("rank")).first() == (8999, 9000)
