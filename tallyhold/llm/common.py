"""Reading, staging, and Arrow text helpers shared by the operators.

The numpy helpers work on one slice of an Arrow batch, cut by bytes, so that memory stays bounded
whatever the texts' lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold.session import configure, stage

#: White space that separates words: space and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2_000_000
BATCH_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ready(spark: SparkSession, batch_rows: int = BATCH_ROWS) -> SparkSession:
    """Session settings of the library, and Arrow batches small enough for very long texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts lineage and survives lost executors."""
    return stage(df, name)


#: A join by more columns than its sides are dealt by deals none of them anew; shuffle files go when their table is written.
_LEAN = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def written_lean(df: DataFrame, name: str) -> DataFrame:
    """``written`` for what moves nearly as much as the disk may hold."""
    return written_with(df, name, _LEAN)


def written_with(df: DataFrame, name: str, settings: dict[str, str]) -> DataFrame:
    """``written`` under some settings of the session, which has its own again afterwards."""
    conf = df.sparkSession.conf
    before = {key: conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            conf.set(key, value)
        return written(df, name)
    finally:
        for key, value in before.items():
            conf.set(key, value)


def in_slices(make: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], text: str = "text"):
    """A mapInArrow function that calls ``make`` on row slices of about SLICE_BYTES of text each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, text):
                made = make(part)
                if isinstance(made, pa.RecordBatch):
                    yield made
                else:
                    yield from made
    return run


def sliced(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths.astype(np.int64)) // limit
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(int(a), int(b - a))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    column = pa.concat_arrays([column])  # drops the slice's offset
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


class Words:
    """Words of the rows of a text column.

    ``data``/``offsets`` hold the words' bytes without gaps, ``rows`` the offsets of each row's words.
    """

    def __init__(self, data: np.ndarray, row_offsets: np.ndarray, separator: np.ndarray):
        inside = ~separator
        first = inside.copy()
        first[1:] &= separator[:-1]
        inner = row_offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        first[inner] = inside[inner]  # a word ends with its row
        starts = np.flatnonzero(first)
        kept = np.concatenate(([0], np.cumsum(inside, dtype=np.int32 if len(data) < 1 << 31 else np.int64)))
        self.starts = starts
        self.data = data[inside]
        self.offsets = np.concatenate((kept[starts], [len(self.data)])).astype(np.int64)
        self.rows = np.searchsorted(starts, row_offsets).astype(np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def arrow(self) -> pa.Array:
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self), [None, pa.py_buffer(self.offsets), pa.py_buffer(np.ascontiguousarray(self.data))])

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of random byte values, then a finishing mix."""
        return _hashes(self.data, self.offsets, seed)


def words_of(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = utf8(column)
    if lower:
        data = ascii_lower(data)
    return Words(data, offsets, is_space(data))


def _hashes(data: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    if len(offsets) < 2:
        return np.zeros(0, np.uint64)
    lengths = np.diff(offsets)
    at = np.arange(len(data), dtype=np.int64) - np.repeat(offsets[:-1], lengths)
    values, power = _byte_values(seed)
    powers = np.full(int(lengths.max()), power, np.uint64)
    powers[:1] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    return mixed(np.add.reduceat(values[data] * powers[at], offsets[:-1]))


def binary_hashes(words: pa.LargeBinaryArray, seed: int = 0) -> np.ndarray:
    """The same hashes for an array of words, none of them empty and without an offset of its own."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[:len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    return _hashes(data[:int(offsets[-1])] if len(words) else data[:0], offsets, seed)


def _byte_values(seed: int) -> tuple[np.ndarray, np.uint64]:
    drawn = np.random.Generator(np.random.PCG64(20_240 + seed)).integers(1, 2**63, 257, dtype=np.uint64)
    return drawn[:256] * np.uint64(2) + np.uint64(1), drawn[256] * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash (shift, multiply, shift)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def gathered(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of ``source`` put one after another, and their offsets."""
    out = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    index = np.arange(out[-1], dtype=np.int64) + np.repeat(starts - out[:-1], lengths)
    return source[index], out


def bit_sketch(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit array of 2 ** bits places with the leading bits of each key set; its size doesn't grow with the keys.

    It lets work be skipped for keys that surely aren't there; what it lets pass must still be joined exactly.
    """
    place = F.shiftrightunsigned(column, 64 - bits)
    words = keys.select(place.alias("place")).selectExpr("cast(shiftright(place, 5) AS int) AS word", "shiftleft(1L, cast(place & 31 AS int)) AS bits")
    found = words.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out


def in_sketch(sketch: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be in the sketch."""
    place = (keys.view(np.uint64) >> np.uint64(64 - (len(sketch).bit_length() + 4))).astype(np.int64)
    return ((sketch[place >> 5] >> (place & 31).astype(np.uint32)) & 1).astype(bool)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Smallest id reachable: (id, component) for every id of the edges (a, b), by min-label hooking and jumping.

    Each round gives every id the smallest label among its neighbours and then the label of that label, so the number
    of rounds grows with the logarithm of a component's diameter in practice.  Every aggregate is a minimum, which combines before the shuffle.
    """
    both = written(edges.select(F.col("a"), F.col("b")).union(edges.select(F.col("b"), F.col("a")))
                   .filter("a <> b").distinct(), f"{name}-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("least"))
                     .select(F.col("a").alias("id"), F.least("a", "least").alias("component")), f"{name}-labels")
    while True:
        near = (both.join(labels.withColumnsRenamed({"id": "b"}), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near")))
        hooked = written(labels.join(near, "id")
                         .select("id", F.col("component").alias("was"), F.least("component", "near").alias("component")),
                         f"{name}-hooked")
        # Roots learn of the smallest label that any member of theirs has seen, and members follow their root.
        roots = written(hooked.groupBy(F.col("was").alias("root")).agg(F.min("component").alias("root_component")), f"{name}-roots")
        followed = (hooked.join(roots, hooked.component == roots.root, "left")
                    .select("id", "was", F.least("component", F.coalesce("root_component", "component")).alias("component")))
        labels = written(followed, f"{name}-labels")
        if labels.filter("was <> component").isEmpty():
            return labels.select("id", "component")
        labels = labels.drop("was")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches in which they follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        turn = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            turn |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(turn) + 1).tolist(), batch.num_rows]
        if held and any(held[0].column(k)[0].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def stacked(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """A matrix from a binary column whose values have one length."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(len(values), -1)
