import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")

#: Empty, null, very long, tied, and repeated texts, with null ids and sources, and columns that clash with names the operators use.
PASSAGE = " ".join(f"shared{i}" for i in range(60))
EDGES = [
    (1, "", "en", "a"), (2, None, "en", "a"), (3, "   \n\t ", "de", "b"), (4, "one", None, None), (5, "one", "en", "c"),
    (6, f"before it {PASSAGE} after it", "en", "a"), (7, f"{PASSAGE} and more of it", "en", "b"), (8, f"x {PASSAGE}", "fr", "b"),
    (8, f"x {PASSAGE}", "fr", "b"), (None, "no id here at all, none", "en", "a"), (None, None, None, None),
    (9, "word " * 60, "en", "a"), (10, "z" * 30_000, "en", "c"), (11, " ".join(f"w{i % 977}" for i in range(40_000)), "en", "a"),
    (12, "It's 1,234 café — don’t “quote” 東京 \U0001F600 ok then\r\n\r\n  end ", "fr", "b"), (13, "One", "en", "c"),
    (14, "a b c d e f g h i j", "en", "a"), (15, "a b c d e f g h i j", "en", "d"),
]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, id long, row string, size int, `group` string, "
          "row_key long, hits int, score double, kept boolean")


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(i, t, lang, s, len(t or ""), 7, "r", 3, "g", 5, 1, 0.5, True) for i, t, lang, s in EDGES]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    return EDGES


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables into a folder, as the queries read them."""
    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write


def plain_words(text):
    return WORDS.findall(text or "")
