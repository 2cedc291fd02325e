import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyhold.llm import token_files

PATH = public_tokenizers.path(token_files.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return lambda text: [*made.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]


def test_random_texts(library):
    rng = random.Random(9)
    signs = [chr(c) for c in [*range(1, 127), 0xA0, 0x85, 0x2003, 0x200B, 0xE9, 0x4E2D, 0x1F600, 0x301, 0x307, 0x3A3, 0x130, 0x2019]]
    signs += ["'s", "'LL", "  ", "<|endoftext|>", "the ", "Cat,", "İ"] * 4
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    ids, rows = token_files.encode(pa.array([*texts, None]), PATH)
    for i, text in enumerate([*texts, None]):
        assert ids[rows[i]:rows[i + 1]].tolist() == library(text), text


def test_words_are_learned_anew_when_there_are_too_many(library, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 40)
    texts = [" ".join(f"word{i}x{j}" for j in range(30)) for i in range(5)]
    for text in texts:
        ids, _ = token_files.encode(pa.array([text]), PATH)
        assert ids.tolist() == library(text)


@pytest.mark.parametrize("counts", [{5: 1}, {1: 3, 2: 1}, {i: 1 for i in range(100)}, {i: 2 ** i for i in range(40)},
                                    {i: (i * 7919) % 1000 + 1 for i in range(3000)}])
def test_code_is_a_limited_prefix_code(counts):
    lengths = token_files.code_lengths(counts)
    assert set(lengths) == set(counts) and 1 <= min(lengths.values()) and max(lengths.values()) <= token_files.MAX_BITS
    kraft = sum(2.0 ** -n for n in lengths.values())
    assert kraft == 1 or len(counts) == 1
    code = token_files.Code(lengths)
    symbols = np.array(list(counts), np.int64)
    ids = np.random.default_rng(1).choice(symbols, 5000)
    data, checkpoints = code.encode(ids)
    assert code.decode(data, checkpoints, len(ids)).tolist() == ids.tolist()


def test_code_lengths_are_optimal_without_a_limit():
    # Worked by hand: counts 1, 1, 2, 3, 5 give 4, 4, 3, 2, 1 bits.
    assert token_files.code_lengths({0: 1, 1: 1, 2: 2, 3: 3, 4: 5}) == {0: 4, 1: 4, 2: 3, 3: 2, 4: 1}
    assert sorted(token_files.code_lengths({0: 1, 1: 1, 2: 2, 3: 3, 4: 5}, 3).values()) == [2, 2, 2, 3, 3]


def test_files(spark, edges, no_documents, library, edge_rows, monkeypatch):
    monkeypatch.setattr(token_files, "ROWS_PER_PART", 4)
    files = token_files.write(edges, PATH)
    rows = token_files.read(files).orderBy("start").collect()
    assert [r.key for r in rows] == sorted((i for i, *_ in edge_rows), key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == (np.cumsum([r.n_tokens for r in rows]) - [r.n_tokens for r in rows]).tolist()
    got = sorted((str(r.key), np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert got == sorted((str(i), library(t)) for i, t, _, _ in edge_rows)
    assert token_files.read(token_files.write(no_documents, PATH)).count() == 0


def test_query(spark, folder, edges, library, edge_rows):
    rows = token_files.op6_token_files(spark, folder(documents=edges)).collect()
    want = sorted((str(i), zlib.crc32(np.array(library(t), "<u4").tobytes())) for i, t, _, _ in edge_rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in rows) == want
