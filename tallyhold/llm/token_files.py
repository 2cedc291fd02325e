"""Token ids in Huffman-coded block files.

The ids of the documents, in ascending key order, form one stream.  A canonical code of at most MAX_BITS bits comes
from the global counts of the ids.  Whole documents that follow each other make a block; a block is one row of a
Parquet table (part of the key range, first row, number of ids, keys and sizes of its documents, coded bits, bit offset
of every LANE-th id), so any block can be decoded alone, and inside it every checkpoint starts a lane; all lanes
advance together by table look-up.  A second table holds the code lengths.

Null texts count as empty; empty texts consist of the end id alone.  Repeated rows and equal or null keys are written
once per row (null keys first).  An empty table gives no block and no row.  Further columns are not stored.
"""

from __future__ import annotations

import heapq
import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhold.llm import common

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MAX_BITS = 16
BLOCK_IDS = 1 << 16
LANE = 64
#: Words whose ids a Python worker remembers; it forgets all of them when there are more.
CACHE_WORDS = 2_000_000
ENCODE_BYTES = 2_000_000
ROWS_PER_PART = 20_000


# ---- ids of texts -------------------------------------------------------------------------------

class KnownWords:
    """Ids of words by two hashes of each word (128 bits), in sorted arrays: a tenth of the memory of a dictionary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def look_up(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word and whether it is known."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, (self.keys[at] == keys) & (self.checks[at] == checks) if len(self.keys) else np.zeros(len(keys), bool)

    def learn(self, words: pa.Array, keys: np.ndarray, checks: np.ndarray) -> None:
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self.forget()
        sizes, ids = [], []
        for at in range(0, len(words), 5_000):
            made = self.tokenizer.encode_batch_fast([w.decode() for w in words[at:at + 5_000].to_pylist()], add_special_tokens=False)
            part = [e.ids for e in made]
            sizes += map(len, part)
            ids.append(np.fromiter(itertools.chain.from_iterable(part), np.uint32))
        sizes = np.array(sizes, np.int32)
        order = np.argsort(keys, kind="stable")
        into = np.searchsorted(self.keys, keys[order])
        starts = (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)
        self.keys = np.insert(self.keys, into, keys[order])
        self.checks = np.insert(self.checks, into, checks[order])
        self.starts = np.insert(self.starts, into, starts[order])
        self.sizes = np.insert(self.sizes, into, sizes[order])
        self.ids = np.concatenate((self.ids, *ids))

    def ids_of(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and the place of the first and the number of ids of each word."""
        keys, checks = (common.binary_hashes(words, seed) for seed in (0, 1))
        for again in (False, True):
            at, known = self.look_up(keys, checks)
            new = np.flatnonzero(~known)
            if not len(new):
                return self.ids, self.starts[at].astype(np.int64), self.sizes[at].astype(np.int64)
            if again or len(self.keys) + len(new) > CACHE_WORDS:
                self.forget()
                new = np.arange(len(words))
            self.learn(words.take(pa.array(new)), keys[new], checks[new])
        at, _ = self.look_up(keys, checks)
        return self.ids, self.starts[at].astype(np.int64), self.sizes[at].astype(np.int64)


@lru_cache(maxsize=2)
def known_words(path: str) -> KnownWords:
    return KnownWords(path)


def cut_endings(words: common.Words) -> None:
    """Make the punctuation at the end of a word a word of its own."""
    if not len(words):
        return
    data = words.data
    plain = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    mark = (data > 32) & (data < 127) & ~plain & ~((data >= 65) & (data <= 90))
    last = np.maximum.reduceat(np.where(mark, -1, np.arange(len(data))), words.offsets[:-1])
    cuts = last[(last >= 0) & (last + 1 < words.offsets[1:]) & plain[last]] + 1
    words.rows = words.rows + np.searchsorted(cuts, words.offsets[words.rows])
    words.offsets = np.sort(np.concatenate((words.offsets, cuts)))


def encode(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by END_ID, and the offsets of the rows.

    The tokenizer drops white space and never merges across it, so each distinct word is encoded once.  It also
    ignores case, and a run of ASCII punctuation that ends a word after an ASCII letter or digit is a piece of its own.
    """
    words = common.words_of(column, lower=True)
    cut_endings(words)
    coded = words.arrow().dictionary_encode()
    ids, starts, lengths = known_words(path).ids_of(pa.concat_arrays([coded.dictionary]))
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # The end id is one more "word" at the end of each row.
    end, ids = len(starts), np.append(ids, np.uint32(END_ID))
    starts, lengths = np.append(starts, len(ids) - 1), np.append(lengths, 1)
    order = np.insert(which, words.rows[1:], end)
    found, at = common.gathered(ids, starts[order], lengths[order])
    rows = words.rows + np.arange(len(words.rows))
    return found, at[rows]


# ---- the code -----------------------------------------------------------------------------------

def code_lengths(counts: dict[int, int], longest: int = MAX_BITS) -> dict[int, int]:
    """Lengths of an optimal prefix code with at most ``longest`` bits: coin collecting by package and merge."""
    if not counts:
        return {}
    if len(counts) == 1:
        return {next(iter(counts)): 1}
    if len(counts) > 1 << longest:
        raise ValueError("More symbols than codes")
    coins = sorted((n, i) for i, n in enumerate(n for _, n in sorted(counts.items())))
    values = [n for n, _ in coins]
    # A package is (weight, left, right); it is opened again only for the chosen ones.
    level = [(w, k, None) for k, w in enumerate(values)]
    merged = level
    for _ in range(longest - 1):
        packages = [(a[0] + b[0], a, b) for a, b in zip(merged[::2], merged[1::2])]
        merged = list(heapq.merge(level, packages, key=lambda x: x[0]))
    lengths = [0] * len(values)
    todo = merged[:2 * len(values) - 2]
    while todo:
        _, left, right = todo.pop()
        if right is None:
            lengths[left] += 1
        else:
            todo += (left, right)
    symbols = sorted(counts)
    return {symbols[i]: lengths[k] for k, (_, i) in enumerate(coins)}


class Code:
    """Canonical codes: by length, then by id."""

    def __init__(self, lengths: dict[int, int]):
        order = sorted(lengths, key=lambda s: (lengths[s], s))
        size = max(order, default=0) + 1
        self.codes, self.lengths = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.table_ids, self.table_lengths = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.int64)
        code = last = 0
        for symbol in order:
            size = lengths[symbol]
            code <<= size - last
            last = size
            self.codes[symbol], self.lengths[symbol] = code, size
            low = code << (MAX_BITS - size)
            self.table_ids[low:low + (1 << (MAX_BITS - size))] = symbol
            self.table_lengths[low:low + (1 << (MAX_BITS - size))] = size
            code += 1

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Coded bits of a block (high bit first), and the bit offset of every LANE-th id."""
        sizes = self.lengths[ids]
        at = np.cumsum(sizes) - sizes
        word, offset = at >> 5, at & 31
        window = self.codes[ids] << (64 - offset - sizes).astype(np.uint64)
        out = np.zeros(int((at[-1] + sizes[-1]) >> 5) + 2, np.uint64)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        # Codes of one word take different bits, so adding them up joins them.
        out[word[first]] += np.add.reduceat(window >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(window & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes(), at[::LANE].astype("<i4")

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        words = np.frombuffer(data, dtype=">u4").astype(np.uint64)
        words = np.concatenate((words, np.zeros(2, np.uint64)))
        at = checkpoints.astype(np.int64)
        out = np.zeros((len(at), LANE), np.uint32)
        for step in range(LANE):
            word = np.minimum(at >> 5, len(words) - 2)
            window = (words[word] << np.uint64(32)) | words[word + 1]
            top = ((window >> (64 - MAX_BITS - (at & 31)).astype(np.uint64)) & np.uint64((1 << MAX_BITS) - 1)).astype(np.int64)
            out[:, step] = self.table_ids[top]
            at = at + self.table_lengths[top]
        return out.ravel()[:n]


# ---- the job ------------------------------------------------------------------------------------

def write(texts: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> dict[str, DataFrame]:
    """Encode ``text`` and write the files; returns the tables ``blocks`` and ``code``.

    The driver sees the count of each id (at most the vocabulary) and nothing that grows with the texts.
    """
    spark = texts.sparkSession
    n_parts = max(1, -(-texts.count() // ROWS_PER_PART))
    ordered = (texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
               .repartitionByRange(n_parts, F.col("key").asc_nulls_first(), F.xxhash64("text"))
               .sortWithinPartitions(F.col("key").asc_nulls_first()))

    def tokens(batches):
        for batch in batches:
            for part in common.sliced(batch, limit=ENCODE_BYTES):
                ids, rows = encode(part.column("text"), path)
                data = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), part.num_rows, [None, pa.py_buffer(rows * 2), pa.py_buffer(_narrow(ids))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("key"), data], ["key", "ids"])

    key_type = texts.schema[key].dataType
    coded = common.written(
        ordered.mapInArrow(tokens, T.StructType([T.StructField("key", key_type), T.StructField("ids", T.BinaryType())]))
        .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "token-ids")

    def partial_counts(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for data in batch.column("ids"):
                total += np.bincount(np.frombuffer(data.as_buffer(), dtype="<u2"), minlength=1 << 16)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["id", "n"])

    counts = coded.select("ids").mapInArrow(partial_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    lengths = code_lengths({r.id: r.n for r in counts.collect()})
    code = common.written(spark.createDataFrame(sorted(lengths.items()), "id int, bits int").coalesce(1), "token-code")
    shared = spark.sparkContext.broadcast(lengths)

    def blocks(batches):
        made = Code(shared.value)
        for batch in batches:
            part, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "row"))
            sizes = pc.binary_length(batch.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64) // 2
            # A block holds whole documents that follow each other in one part.
            turn = np.concatenate(([True], (part[1:] != part[:-1]) | (row[1:] != row[:-1] + 1)))
            group = np.cumsum(turn) * (1 << 40) + (np.cumsum(sizes) - sizes) // BLOCK_IDS
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(part)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b == a:
                    continue
                ids = np.concatenate([np.frombuffer(x.as_buffer(), dtype="<u2") for x in batch.column("ids")[a:b]])
                data, checkpoints = made.encode(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part[a]], pa.int32()), pa.array([row[a]], pa.int64()), pa.array([len(ids)], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), pa.concat_arrays([batch.column("key")[a:b]])),
                     pa.array([sizes[a:b].tolist()], pa.list_(pa.int64())), pa.array([data], pa.binary()),
                     pa.array([checkpoints.tobytes()], pa.binary())], ["part", "row", "n", "keys", "sizes", "data", "checkpoints"])

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("keys", T.ArrayType(key_type)), T.StructField("sizes", T.ArrayType(T.LongType())),
                           T.StructField("data", T.BinaryType()), T.StructField("checkpoints", T.BinaryType())])
    table = common.written(coded.select("part", "row", "key", "ids").mapInArrow(blocks, schema), "token-blocks")
    return {"blocks": table, "code": code}


def _narrow(ids: np.ndarray) -> np.ndarray:
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("An id takes more than 16 bits")
    return ids.astype("<u2")


def read(files: dict[str, DataFrame]) -> DataFrame:
    """Documents of the files: key, start, n_tokens, and ids as little-endian 32-bit integers."""
    blocks, spark = files["blocks"], files["blocks"].sparkSession
    lengths = spark.sparkContext.broadcast({r.id: r.bits for r in files["code"].collect()})
    # Two running sums: blocks inside a part, and one row per part.
    parts = blocks.groupBy("part").agg(F.sum("n").alias("all")).select(
        "part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("part_start"))
    inside = (blocks.select("part", "row", "n")
              .withColumn("start", F.sum("n").over(Window.partitionBy("part").orderBy("row")) - F.col("n"))
              .join(parts, "part").select("part", "row", (F.col("start") + F.col("part_start")).alias("start")))
    placed = blocks.join(inside, ["part", "row"])
    key_type = blocks.schema["keys"].dataType.elementType

    def decoded(batches):
        made = Code(lengths.value)
        for batch in batches:
            for start, n, keys, sizes, data, checkpoints in zip(*(batch.column(c) for c in ("start", "n", "keys", "sizes", "data", "checkpoints"))):
                ids = made.decode(data.as_py(), np.frombuffer(checkpoints.as_py(), dtype="<i4"), n.as_py()).astype("<u4")
                length = np.array(sizes.as_py(), np.int64)
                ends = np.cumsum(length)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [
                    None, pa.py_buffer(np.concatenate(([0], ends * 4))), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(start.as_py() + ends - length, pa.int64()), pa.array(length, pa.int64()), raw],
                                                 ["key", "start", "n_tokens", "ids"])

    return placed.mapInArrow(decoded, T.StructType([T.StructField("key", key_type), T.StructField("start", T.LongType()),
                                                    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    common.ready(spark)
    files = write(common.table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return read(files).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
