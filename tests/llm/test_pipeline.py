import base64
import hashlib

import corpus_pipeline
import public_tokenizers
import tiktoken

import __spark_entry__ as driver
from conftest import plain_words
from tallyhold.llm import byte_bpe, common, mixing, near_text, toxicity
from test_near_text import brute as near_groups, shingle_set
from test_personal import cleaned

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = set(driver.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in driver.oracle_sql() and {"op2_substrings", "op8_mixing", "op9_near_vectors", "op10_near_text", "op11_merkle_manifest", "op12_bit_planes", "op13_learned_partitions"} <= set(driver.oracle_sql())


def test_stages_against_brute_force(spark):
    docs = common.table(spark, FOLDER, "documents")
    columns = docs.columns
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, FOLDER), "stage")
        made[name] = (before.collect(), docs.collect())
        if name != "byte-level BPE":
            assert docs.columns == columns
    before, after = made["toxicity"]
    model = toxicity.fit(common.table(spark, FOLDER, "documents"), common.table(spark, FOLDER, "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(common.table(spark, FOLDER, "documents"), model).collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if scores[r.doc_id] < 0.3}

    before, after = made["near copies"]
    want = {c for _, _, c in near_groups([(r.doc_id, r.text) for r in before], corpus_pipeline.COPY_PERCENT)}
    assert sorted(r.doc_id for r in after) == sorted(want)

    before, after = made["personal data"]
    texts = {r.doc_id: r.text for r in after}
    assert len(before) == len(after) and all(texts[r.doc_id] == cleaned(r.text) for r in before)
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = made["mixing"]
    taken = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(before)).collect()}
    counts = {}
    for r in after:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + len(plain_words(r.text))
    assert counts == {k: v for k, v in taken.items() if v}

    before, after = made["byte-level BPE"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(byte_bpe.RANKS), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert len(before) == len(after)
    for r, b in zip(sorted(after, key=lambda r: r.doc_id), sorted(before, key=lambda r: r.doc_id)):
        assert r.ids == library.encode_ordinary(b.text) and r.decoded_sha256 == hashlib.sha256(b.text.encode()).hexdigest()


def test_near_copies_from_four_fifths(spark):
    """Pairs around 0.80: the copies end in more and more new words."""
    rows = []
    for family in range(12):
        words = [f"f{family}w{i}" for i in range(64)]
        rows += [(2 * family, " ".join(words)), (2 * family + 1, " ".join(words[:-1] + [f"n{family}_{i}" for i in range(family + 5)]))]
    sets = [shingle_set(t) for _, t in rows]
    likeness = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert any(0.80 <= x < 0.85 for x in likeness) and any(x < 0.80 for x in likeness) and any(x >= 0.85 for x in likeness)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, FOLDER).collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0 or likeness[i // 2] < 0.80}


def test_bands_miss_few_pairs_at_the_limit():
    for percent in (80, 85):
        n, width = near_text.banding(percent)
        assert n * width == near_text.HASHES and (1 - (percent / 100) ** width) ** n < 1e-4


def test_edges_pass_every_stage(spark, edges, folder):
    documents = edges.select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(4, 0), (5, 0), (None, 1)], "doc_id long, toxic int")
    path = folder(documents=documents, labels=labels)
    rows = corpus_pipeline.run(spark, path).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)
    assert corpus_pipeline.run(spark, folder(documents=documents.limit(0))).count() == 0
