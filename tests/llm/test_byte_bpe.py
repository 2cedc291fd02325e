import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tallyhold.llm import byte_bpe

PATH = public_tokenizers.path(byte_bpe.RANKS)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(texts, library):
    ids, rows = byte_bpe.encode(pa.array(texts, pa.string()), byte_bpe.vocabulary(PATH))
    for i, text in enumerate(texts):
        assert ids[rows[i]:rows[i + 1]].tolist() == library.encode_ordinary(text or ""), text


def test_random_texts(library):
    rng = random.Random(4)
    signs = [chr(c) for c in [*range(1, 127), 0xA0, 0x85, 0x2003, 0x3000, 0x200B, 0xE9, 0x4E2D, 0x1F600, 0x660, 0x2160, 0x301, 0x0]]
    signs += ["'s", "'ll", "'re", " '", "  ", "\n ", "the", "ing"] * 4
    check(["".join(rng.choice(signs) for _ in range(rng.randint(0, 70))) for _ in range(2000)], library)


def test_code_points(library):
    signs = [chr(c) for c in range(1, 0x110000, 211) if not 0xD800 <= c < 0xE000]
    check([f"a{s}b{s} {s}" for s in signs], library)


def test_long_pieces(library):
    check(["a" * 2000, "=" * 700 + "abc " * 300, "ab" * 129, "xy" * 128, " " * 500, "\n" * 300 + "x", "東京" * 200], library)


def test_edges_round_trip(spark, edges, no_documents, library, edge_rows):
    rows = byte_bpe.round_trip(edges.select("doc_id", "text", "size"), PATH, keep_ids=True).collect()
    want = sorted((str(i), len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
                  for i, t, _, _ in edge_rows for e in [library.encode_ordinary(t or "")])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert all(len(r.ids) == r.n_tokens and r["size"] == 3 for r in rows)
    assert byte_bpe.round_trip(no_documents.select("doc_id", "text"), PATH).count() == 0


def test_ids_and_back(edges, edge_rows):
    back = byte_bpe.with_text(byte_bpe.with_ids(edges.select("doc_id", "text", "lang"), PATH), PATH)
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back.collect()) == sorted((str(i), t or "") for i, t, _, _ in edge_rows)


def test_query(spark, folder, edges):
    rows = byte_bpe.op4_byte_bpe(spark, folder(documents=edges))
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() == edges.count()
