"""Substring dedup: remove the words of every window of WINDOW words that occurs more than once.

1. Each window picks its anchor, the run of ANCHOR words in it with the least hash (the leftmost of equals).  Equal
   windows have equal anchors.  Successive windows with one anchor form a span.  Anchors are counted.
2. A fixed-size bit sketch of the anchors that recur tells which spans can matter; it only saves work.  Spans that occur
   more than once are repeated as a whole.  Where an anchor also has single spans, their windows are counted one by one.
   So the repeated windows are exactly known, and a hot passage is combined before it is shuffled.
3. Runs of repeated windows are the confirmed passages.  Each slice of documents compiles its passages, cut into pieces of
   WINDOW words, into one Aho-Corasick automaton over word numbers (a shard), streams all of its documents through it, and removes every
   occurrence.  A passage that a document holds is among the document's own, so no other shard can match in it.

Null texts have no words; texts with fewer than WINDOW words have no window.  Repeated rows are separate documents, so
their windows repeat.  Null ids are joined as equal.  An empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold.llm import common

WINDOW, ANCHOR = 35, 8
#: Bits of the sketch.  Beyond some ten million recurring anchors it lets more and more spans pass and stays right.
SKETCH_BITS = 26


# ---- windows ------------------------------------------------------------------------------------

def sums_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of values times powers, and the inverse powers that make sums of equal runs equal."""
    power, n = 0x9E3779B97F4A7C15, len(values)
    powers = np.full(n, power, np.uint64)
    inverse = np.full(n + 1, pow(power, -1, 1 << 64), np.uint64)
    powers[:1] = inverse[:1] = 1
    powers, inverse = np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers, dtype=np.uint64))), inverse


class Runs:
    """Hashes of any run of words."""

    def __init__(self, words: np.ndarray):
        self.sums, self.inverse = sums_of(words)

    def hash(self, start: np.ndarray, size) -> np.ndarray:
        return common.mixed((self.sums[start + size] - self.sums[start]) * self.inverse[start])


def least_in_reach(values: np.ndarray, reach: int) -> np.ndarray:
    """For each place, the leftmost place of the least value among ``reach`` values from there on."""
    best, at, out, done = values, np.arange(len(values)), None, 0
    width = 1
    while True:
        if reach & width:
            if out is None:
                out = at.copy()
            else:
                n = max(0, len(values) - done)
                other = at[done:done + n]
                out[:n] = np.where(values[other] < values[out[:n]], other, out[:n])
            done += width
        if done >= reach:
            return out
        n = max(0, len(values) - width)
        worse = best[width:] < best[:n]
        at = np.concatenate((np.where(worse, at[width:], at[:n]), at[n:]))
        best = values[at]
        width *= 2


class Spans:
    """The spans of the texts of a column: row, first window (counted from the row's start), number of windows, anchor."""

    def __init__(self, column: pa.Array):
        self.words = common.words_of(column)
        h = self.words.hashes()
        self.runs = Runs(h)
        rows = self.words.rows
        n = max(0, len(h) - ANCHOR + 1)
        gram = self.runs.hash(np.arange(n), ANCHOR)
        each = np.maximum(np.diff(rows) - WINDOW + 1, 0)
        owner = np.repeat(np.arange(len(each)), each)
        window = rows[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
        anchor = least_in_reach(gram, WINDOW - ANCHOR + 1)[window] if n else window
        first = np.ones(len(window), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(first)
        self.row, self.window = owner[at], window[at]
        self.size = np.diff(np.append(at, len(window)))
        self.anchor = common.mixed(gram[anchor[at]] + np.uint64(1)) if n else np.zeros(0, np.uint64)
        self.start = self.window - rows[self.row]

    def hash(self) -> np.ndarray:
        return common.mixed(self.runs.hash(self.window, self.size + WINDOW - 1) + self.size.astype(np.uint64))

    def window_hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[which]
        start = np.repeat(self.window[which], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.runs.hash(start, WINDOW), np.concatenate(([0], np.cumsum(size)))


# ---- jobs ---------------------------------------------------------------------------------------

def keyed(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("row_key", F.xxhash64("text"))


def sketch(documents: DataFrame) -> np.ndarray:
    """Bits of the anchors that occur more than once; the driver sees at most 2 ** SKETCH_BITS bits."""
    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        anchors, n = np.unique(Spans(part.column("text")).anchor, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(n, pa.int64())], ["anchor", "n"])

    counts = documents.select("text").mapInArrow(common.in_slices(count), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return common.bit_sketch(counts.filter("n > 1"), "anchor", SKETCH_BITS)


def recurring_spans(documents: DataFrame) -> DataFrame:
    """(anchor, span, id, row_key, starts, size, windows): equal spans of a document in one row."""
    shared = documents.sparkSession.sparkContext.broadcast(sketch(documents))

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        spans = Spans(part.column("text"))
        there = np.flatnonzero(common.in_sketch(shared.value, spans.anchor))
        digest = spans.hash()
        order = there[np.lexsort((spans.start[there], digest[there], spans.anchor[there], spans.row[there]))]
        row, anchor, span = spans.row[order], spans.anchor[order], digest[order]
        new = np.ones(len(order), bool)
        new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (span[1:] != span[:-1])
        first = np.flatnonzero(new)
        windows, at = spans.window_hashes(order[first])
        owner = pa.array(row[first])
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor[first].view(np.int64)), pa.array(span[first].view(np.int64)), part.column("id").take(owner), part.column("row_key").take(owner),
             pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(spans.start[order], pa.int32())),
             pa.array(spans.size[order[first]], pa.int32()),
             pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(windows.view(np.int64)))],
            ["anchor", "span", "id", "row_key", "starts", "size", "windows"])

    kind = documents.schema["id"].dataType.simpleString()
    return common.written(documents.mapInArrow(
        common.in_slices(make), f"anchor long, span long, id {kind}, row_key long, starts array<int>, size int, windows array<long>"), "repeat-spans")


def repeated_windows(documents: DataFrame) -> DataFrame:
    """(id, row_key, found): starts and numbers of repeated windows of each document that has some."""
    spans = recurring_spans(documents).withColumn("place", F.xxhash64("id", "row_key", F.element_at("starts", 1)))
    counts = common.written(spans.groupBy("anchor", "span").agg(F.sum(F.size("starts")).alias("n"), F.min("place").alias("first")), "repeat-counts")
    one_of = (F.col("n") == 1) | (F.col("place") == F.col("first"))
    judged = common.written(spans.join(counts, ["anchor", "span"]).select(
        "anchor", "id", "row_key", "starts", "size", "n", F.when(one_of, F.col("windows")).alias("windows")), "repeat-judged")
    whole = judged.filter("n > 1").select("id", "row_key", "starts", "size")

    # Anchors with a single span: its windows may still equal windows of the anchor's other spans.
    single = judged.filter("n = 1").select("anchor", "id", "row_key", F.element_at("starts", 1).alias("start"), "windows")
    anchors = common.written(single.groupBy("anchor").count().select("anchor"), "repeat-open-anchors")
    rivals = judged.filter("n > 1 and windows is not null").join(anchors, "anchor", "left_semi").select("anchor", "windows")
    every = single.select("anchor", F.explode("windows").alias("window")).union(rivals.select("anchor", F.explode("windows").alias("window")))
    again = common.written(every.groupBy("anchor", "window").count().filter("count > 1").select("anchor", "window"), "repeat-windows")
    partly = (single.select("anchor", "id", "row_key", "start", F.posexplode("windows").alias("offset", "window"))
              .join(again, ["anchor", "window"])
              .select("id", "row_key", F.array(F.col("start") + F.col("offset")).alias("starts"), F.lit(1).alias("size")))
    return common.written(whole.union(partly).groupBy("id", "row_key").agg(F.collect_list(F.struct("starts", "size")).alias("found")), "repeat-found")


def passages(found, n_words: int) -> list[tuple[int, int]]:
    """First and last + 1 word of each maximal run of repeated windows."""
    edge = np.zeros(n_words + 1, np.int64)
    for item in found:
        starts = np.asarray(item["starts"])
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + item["size"], -1)
    inside = np.concatenate(([False], np.cumsum(edge)[:-1] > 0, [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return [(int(a), int(b) + WINDOW - 1) for a, b in zip(turns[::2], turns[1::2])]


def covered(numbers: np.ndarray, rows: np.ndarray, found: list) -> np.ndarray:
    """Which words of some texts lie in an occurrence of a passage of any of them."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for row, items in enumerate(found):
        if items:
            words = numbers[rows[row]:rows[row + 1]]
            # Pieces of one length: every word of a passage is in one, each is a repeated window, and at most one ends at a place.
            for a, b in passages(items, len(words)):
                for start in {*range(a, b - WINDOW, WINDOW), b - WINDOW}:
                    automaton.add_word(tuple(words[start:start + WINDOW].tolist()), WINDOW)
    edge = np.zeros(len(numbers) + 1, np.int64)
    if len(automaton):
        automaton.make_automaton()
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            for end, size in automaton.iter(tuple(numbers[a:b].tolist())):
                edge[a + end + 1 - size] += 1
                edge[a + end + 1] -= 1
    return np.cumsum(edge)[:-1] > 0


def without_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept (the words that stay, joined by a blank)."""
    rows = keyed(documents, key, text)
    found = repeated_windows(rows)
    joined = rows.join(found.withColumnsRenamed({"id": "of_id", "row_key": "of_key"}),
                       F.col("id").eqNullSafe(F.col("of_id")) & (F.col("row_key") == F.col("of_key")), "left").select("id", "text", "found")

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        words = common.words_of(part.column("text"))
        numbers = words.arrow().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        gone = covered(numbers, words.rows, part.column("found").to_pylist())
        stays = np.flatnonzero(~gone)
        lengths = np.diff(words.offsets)[stays]
        # Each word with the blank after it; the last one of a row loses it.
        spaced = np.insert(words.data, words.offsets[1:], 32)
        starts = words.offsets[:-1][stays] + stays
        data, at = common.gathered(spaced, starts, lengths + 1)
        rows_at = np.searchsorted(stays, words.rows)
        ends = at[rows_at]
        kept = [data[a:max(a, b - 1)].tobytes().decode() for a, b in zip(ends[:-1], ends[1:])]
        n_words = np.diff(words.rows)
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(n_words, pa.int64()), pa.array(n_words - np.diff(rows_at), pa.int64()), pa.array(kept, pa.string())],
                                          ["id", "n_words", "n_removed", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    return joined.mapInArrow(common.in_slices(make), f"id {kind}, n_words long, n_removed long, kept string")


def op2_substrings(spark: SparkSession, folder: str) -> DataFrame:
    common.ready(spark)
    kept = without_repeats(common.table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
