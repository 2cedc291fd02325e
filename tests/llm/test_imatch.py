import hashlib
import random
import re

from conftest import plain_words
from pyspark.sql import functions as F
from tallyhold.llm import imatch


def edited(rows):
    """Edited text of each (id, text), in descending order of ids, null last."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    texts = [t or "" for _, t in order]
    return [(i, len(t), t[:len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][:len(t) // 2]) for k, ((i, _), t) in enumerate(zip(order, texts))]


def test_edited_texts_and_likeness(spark, folder, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 7)
    rng = random.Random(6)
    rows = [(rng.randrange(10**9) * (1 if k % 3 else -1), " ".join(f"t{int(rng.paretovariate(0.3)) % 5000}é" for _ in range(rng.randint(0, 200)))) for k in range(150)]
    rows += [(10**15, rows[0][1]), (10**16, ""), (-10**17, "x")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, id string, n_chars int").repartition(4)
    got = {r.doc_id: r for r in imatch.op3_imatch(spark, folder(documents=docs)).collect()}
    want = edited(rows)
    assert len(got) == len(want)
    for i, n, text in want:
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[rows[0][0]].fingerprint == got[10**15].fingerprint
    long_ones = [got[i] for i, n, _ in want if n > 200]
    assert sum(r.near_edited > r.near_next for r in long_ones) > 0.9 * len(long_ones)


def test_edges(spark, edges, no_documents, edge_rows, folder):
    rows = imatch.op3_imatch(spark, folder(documents=edges)).collect()
    assert len(rows) == len(edge_rows)
    by_text = {}
    for (i, text, _, _) in edge_rows:
        if i is not None:
            by_text.setdefault(text or "", set()).update(r.fingerprint for r in rows if r.doc_id == i)
    assert all(len(v) == 1 for v in by_text.values())
    assert imatch.fingerprints(no_documents).count() == 0


def test_single_row_is_its_own_next(spark):
    one = spark.createDataFrame([(5, "alpha beta")], "doc_id long, text string")
    row = imatch.fingerprints(one).first()
    assert row.edited_sha256 == hashlib.sha256(b"alphaalpha").hexdigest() and row.near_next == 1.0


def test_main_path_has_no_python(spark, edges):
    plan = imatch.fingerprints(edges)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_given_documents(spark):
    rows = imatch.op3_imatch(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)


# ---- the same by plain Python, on the engine's hashes of words and lists ----

def plain(spark, rows):
    """{id: (own hashes, edited hashes)} from frequencies counted in Python."""
    from pyspark.sql import functions as F
    texts = {i: ((t or ""), e) for (i, t), (_, _, e) in zip(sorted(rows, reverse=True), edited(rows))}
    words = lambda t: {w.lower() for w in plain_words(t)}
    df = {}
    for own, _ in texts.values():
        for w in words(own):
            df[w] = df.get(w, 0) + 1
    most = imatch.most_documents(len(rows))
    band = {w for w, n in df.items() if imatch.LEAST_DOCUMENTS <= n <= most}
    every = sorted({w for pair in texts.values() for t in pair for w in words(t)})
    named = spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("term"), F.xxhash64(F.xxhash64("w")).alias("place")).collect()
    term, place = {r.w: r.term for r in named}, {r.w: r.place for r in named}
    lists, keys = [], []
    for i, pair in texts.items():
        for side, t in enumerate(pair):
            inside = sorted(place[w] for w in words(t) & band)
            if inside or not words(t):
                for level in range(imatch.LEVELS):
                    for subset in range(imatch.SUBSETS):
                        chosen = [x for x in inside if x & (4 ** level - 1) == 0 and (x % 2 ** 64 >> 32) & (imatch.SUBSETS - 1) == subset]
                        keys.append((i, side, level * imatch.SUBSETS + subset))
                        lists.append((len(lists), chosen))
            else:
                keys.append((i, side, None))
                lists.append((len(lists), sorted(term[w] for w in words(t))))
    got = {r.k: r.h for r in spark.createDataFrame(lists, "k int, l array<bigint>").select("k", F.hash("l").alias("h")).collect()}
    out = {i: ([0] * 80, [0] * 80) for i in texts}
    for (i, side, slot), (k, chosen) in zip(keys, lists):
        if slot is None:
            row = spark.createDataFrame([(got[k],)], "h int").select(F.array(*[F.hash(F.col("h"), F.lit(n)) for n in range(80)])).first()[0]
            out[i][side][:] = row
        elif chosen:
            out[i][side][slot] = got[k]
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    shares = []
    for level in range(imatch.LEVELS):
        pairs = list(zip(a[level * 16:level * 16 + 16], b[level * 16:level * 16 + 16]))
        shares.append(sum(x == y != 0 for x, y in pairs) / max(6, sum(x != 0 or y != 0 for x, y in pairs)))
    return max(shares)


def test_against_plain_python(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(f"W{int(rng.paretovariate(0.4)) % 900}" for _ in range(rng.randint(1, 80)))) for i in range(60)]
    rows += [(100, "only here alone"), (101, ""), (102, None)]
    got = {r.id: r for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want, order = plain(spark, rows), sorted((i for i, _ in rows), reverse=True)
    shown = lambda hashes: "".join(f"{h & 0xFFFFFFFF:08x}" for h in hashes)
    for k, i in enumerate(order):
        own, changed = want[i]
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (shown(own), shown(changed)), i
        assert abs(got[i].near_edited - plain_likeness(own, changed)) < 1e-12 and abs(got[i].near_next - plain_likeness(own, want[order[(k + 1) % len(order)]][0])) < 1e-12


def test_the_band_is_judged_on_terms_however_many(spark):
    """More distinct terms than 2 ** 20, each of one document: none enters the lexicon, and terms of two documents do."""
    from pyspark.sql import functions as F
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(599)), lambda k: F.concat(F.lit("t"), F.col("id"), F.lit("_"), k)))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(words, F.lit(" pair"), F.floor(F.col("id") / 2)).alias("text"))
    rows = imatch.texts_with_edits(docs, "doc_id", "text")
    counted = imatch.frequencies(rows).filter(F.col("df") >= imatch.LEAST_DOCUMENTS)
    assert rows.agg(F.sum(F.size("terms"))).first()[0] > 2 ** 20 and counted.count() == 1000
    assert {r.n for r in imatch.lexicon_terms(rows).select(F.size("own").alias("n")).collect()} == {1}


def test_null_ids_are_many_ranges(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(imatch, "RANGE_ROWS", 10)
    docs = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    seen = []
    written = imatch.common.written
    monkeypatch.setattr(imatch.common, "written", lambda df, name: (seen.append((name, written(df, name))), seen[-1][1])[1])
    assert imatch.fingerprints(docs).count() == 400
    bounds = next(df for name, df in seen if name == "match-bounds").first().bounds
    assert len(bounds) > 20


def test_pairs_stay_in_their_range(spark, monkeypatch):
    """(document, term) pairs are neither dealt anew by term nor by document; only distinct terms of a range move."""
    plans = {}
    written = imatch.common.written
    monkeypatch.setattr(imatch.common, "written", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), written(df, name))[1])
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("both one"), F.floor(F.col("id") / 2), F.lit(" only"), "id").alias("text"))
    imatch.fingerprints(docs)
    assert not any("hashpartitioning(number" in plan for plan in plans.values())
    dealt = re.findall(r"hashpartitioning\((.*?), \d+\)", plans["match-hashes"])
    assert len(dealt) >= 2 and all(re.fullmatch(r"range#\d+", keys) for keys in dealt)
