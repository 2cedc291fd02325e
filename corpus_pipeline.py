"""A corpus pipeline: toxic documents go, one document of each near-copy group stays, personal data is generalised,
sources are mixed to their target weights, and texts become token ids.

A stage takes (spark, docs, folder) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All stages but the last return the columns of ``documents``; the last returns doc_id, lang, source,
n_tokens, digests of the ids and of the bytes decoded from them, and the ids.  Null texts count as empty throughout.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold.llm import byte_bpe, common, mixing, near_text, personal, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score below the threshold; learned from the labelled rows that aren't held out."""
    common.ready(spark)
    model = toxicity.fit(docs, common.table(spark, folder, "labels"))
    return toxicity.score(docs, model, name="toxic_score").filter(F.col("toxic_score") < toxicity.THRESHOLD).drop("toxic_score")


#: Likeness of word shingles from which two documents are copies here; op10_near_text has its own limit.
COPY_PERCENT = 80


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    common.ready(spark)
    return near_text.without_near_copies(docs, COPY_PERCENT)


def without_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The same documents, sanitised; n_chars follows the new text."""
    common.ready(spark)
    kind = docs.schema["n_chars"].dataType
    return personal.sanitised(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    common.ready(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    common.ready(spark)
    return byte_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(byte_bpe.RANKS), keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("personal data", without_personal_data),
    ("mixing", mixed),
    ("byte-level BPE", tokens),
]

#: A trained network has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``."""
    common.ready(spark)
    docs = common.table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, folder), f"pipeline-{name.replace(' ', '-')}")
    return docs
