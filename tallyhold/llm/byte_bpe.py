"""Byte-level BPE encoding and decoding with length-bucketed padded numpy matrices.

A batch of texts is cut into pieces, the distinct pieces become rows of matrices (one matrix per length class), and
in each round every row merges its leftmost pair of minimum rank.  Pair ranks come from a hash table of all mergeable
pairs; finished rows leave the matrix.

Null texts count as empty; empty texts have no tokens.  Rows are handled one by one, so ties, repeated rows, null ids,
and an empty table need no rule, and further columns pass through under their own names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyhold.llm import common

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pieces with more bytes than this are merged by a heap: a matrix row costs its length squared.
MATRIX_BYTES = 256
LETTER, NUMBER, OTHER, SPACE, BREAK = range(5)
NONE = np.int32(2**31 - 1)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point under the splitting pattern."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], dtype=np.uint8)
    white = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[white] = SPACE
    return table


def piece_starts(chars: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern begin, for texts put one after another with a BREAK before each and at the end.

    A piece is a run of one class; a blank right before a run belongs to it; the last white space before a run is a
    piece of its own unless it is that blank; and an apostrophe piece takes the ending of a contraction.
    """
    before = np.concatenate(([BREAK], classes[:-1]))
    after = np.concatenate((classes[1:], [BREAK]))
    blank_before = np.concatenate(([False], chars[:-1] == 32))
    changed = classes != before
    starts = np.where(classes == SPACE, changed | (after < SPACE), changed & ~(blank_before & (classes < SPACE)))
    starts |= classes == BREAK
    mark = np.flatnonzero((chars[:-2] == 39) & starts[:-2] & (classes[:-2] == OTHER))  # a BREAK always ends the arrays
    one, two = chars[mark + 1], chars[mark + 2]
    pair = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    single = np.isin(one, [ord(c) for c in "stmd"])
    for at, size in ((mark[single], 1), (mark[pair], 2)):
        at = at[classes[at + size] == LETTER]
        starts[at + 1] = False
        follows = at + 1 + size
        starts[follows[classes[follows] == LETTER]] = True
    return np.flatnonzero(starts)


class Vocabulary:
    """Ranks, single-byte ids, and an open-addressing hash table from pairs of ids to the id of their merge."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        size = max(ranks.values()) + 1
        words = [b""] * size
        for word, rank in ranks.items():
            words[rank] = word
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        digits = [f"{rank}," for rank in range(size)]
        self.digit_lengths = np.array([len(d) for d in digits], dtype=np.int64)
        self.digits = np.frombuffer("".join(digits).encode(), dtype=np.uint8)
        self.digit_starts = np.cumsum(self.digit_lengths) - self.digit_lengths
        self.known = pa.array(words, pa.large_binary())
        self.pairs = {}
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
                if left is not None and right is not None:
                    self.pairs[(left << 17) | right] = rank
        self._fill()

    def _fill(self) -> None:
        keys = np.array(list(self.pairs), dtype=np.int64)
        ranks = np.array(list(self.pairs.values()), dtype=np.int32)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] == -1
            candidates = left[free]
            _, first = np.unique(slot[candidates], return_index=True)
            placed = candidates[first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], ranks[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NONE if there is none or a side is padding."""
        keys = (left.astype(np.int64) << 17) | right
        keys[(left < 0) | (right < 0)] = -2
        found = np.full(keys.shape, NONE, dtype=np.int32)
        open_at = np.flatnonzero(keys >= 0)
        wanted = keys.ravel()[open_at]
        slot, flat = self._slot(wanted), found.ravel()
        while len(open_at):
            there = self.keys[slot]
            hit = there == wanted
            flat[open_at[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            open_at, wanted, slot = open_at[on], wanted[on], (slot[on] + 1) & (len(self.keys) - 1)
        return flat.reshape(keys.shape)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_matrix(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Merge rows of ids (padded with -1) until no pair of any row has a rank."""
    done = np.full(ids.shape, -1, dtype=np.int32)
    rows = np.arange(len(ids))
    ranks = v.merge_ranks(ids[:, :-1], ids[:, 1:])
    while len(rows):
        best = ranks.min(axis=1)
        over = best == NONE
        if over.any():
            done[rows[over], :ids.shape[1]] = ids[over]
            rows, ids, ranks, best = rows[~over], ids[~over], ranks[~over], best[~over]
            if not len(rows):
                break
        at = ranks.argmin(axis=1)
        each = np.arange(len(rows))
        shifted = np.concatenate((ids[:, 1:], np.full((len(ids), 1), -1, np.int32)), axis=1)
        columns = np.arange(ids.shape[1])
        moved = columns[None, :] > at[:, None]
        ids = np.where(moved, shifted, ids)
        ids[each, at] = best
        ranks = np.where(moved[:, :-1], np.concatenate((ranks[:, 1:], np.full((len(ids), 1), NONE, np.int32)), axis=1), ranks)
        right = at < ranks.shape[1]
        ranks[each[right], at[right]] = v.merge_ranks(best[right], ids[each[right], at[right] + 1])
        left = at > 0
        ranks[each[left], at[left] - 1] = v.merge_ranks(ids[each[left], at[left] - 1], best[left])
        width = int((ids >= 0).sum(axis=1).max())
        if width < ids.shape[1]:
            ids, ranks = ids[:, :max(width, 2)], ranks[:, :max(width, 2) - 1]
    return done


def merge_long(piece: bytes, v: Vocabulary) -> list[int]:
    """The same merges for one long piece, by a heap over a linked list."""
    ids = [int(v.byte_ids[b]) for b in piece]
    after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
    heap = [(rank, i) for i in range(len(ids) - 1) if (rank := v.pairs.get((ids[i] << 17) | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= len(ids) or v.pairs.get((ids[i] << 17) | ids[j]) != rank:
            continue
        ids[i], alive[j], after[i] = rank, False, after[j]
        if after[j] < len(ids):
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < len(ids):
                made = v.pairs.get((ids[a] << 17) | ids[after[a]])
                if made is not None:
                    heapq.heappush(heap, (made, a))
    return [x for x, kept in zip(ids, alive) if kept]


def encode_pieces(pieces: pa.LargeBinaryArray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of each piece, put one after another, and how many each has."""
    whole = pc.index_in(pieces, value_set=v.known)
    known = whole.is_valid().to_numpy(zero_copy_only=False)
    counts = np.where(known, 1, 0).astype(np.int64)
    offsets = np.frombuffer(pieces.buffers()[1], dtype=np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2] or b"", dtype=np.uint8)
    lengths = np.diff(offsets)
    parts: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(known), whole.drop_null().to_numpy().astype(np.int32))]
    rest = np.flatnonzero(~known)
    sizes = lengths[rest]
    low = 1
    for high in (4, 6, 8, 10, 12, 16, 24, 40, 80, 140, MATRIX_BYTES):
        bucket = rest[(sizes > low) & (sizes <= high)]
        low = high
        step = max(1, 4_000_000 // high)
        for at in range(0, len(bucket), step):
            rows = bucket[at:at + step]
            columns = offsets[rows][:, None] + np.arange(high)
            inside = np.arange(high) < lengths[rows][:, None]
            ids = np.where(inside, v.byte_ids[data[np.minimum(columns, len(data) - 1)]], np.int32(-1))
            merged = merge_matrix(ids, v)
            real = merged >= 0
            counts[rows] = real.sum(axis=1)
            parts.append((np.repeat(rows, counts[rows]), merged[real]))
    for row in rest[sizes > MATRIX_BYTES]:
        ids = merge_long(data[offsets[row]:offsets[row + 1]].tobytes(), v)
        counts[row] = len(ids)
        parts.append((np.full(len(ids), row), np.array(ids, dtype=np.int32)))
    owner, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    return ids[np.argsort(owner, kind="stable")], counts


def encode(column: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a column, and the offsets of its rows."""
    texts = column.cast(pa.large_string()).fill_null("").to_pylist()
    joined = "\x00" + "\x00".join(texts) + "\x00"
    chars = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    classes = character_classes()[chars]
    ends = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    classes[ends] = BREAK
    starts = piece_starts(chars, classes)
    sizes = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
    at_byte = np.concatenate(([0], np.cumsum(sizes)))
    piece_offsets = np.concatenate((at_byte[starts], at_byte[-1:]))
    real = classes[starts] != BREAK
    data = joined.encode()
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(piece_offsets), pa.py_buffer(data)])
    coded = pieces.filter(pa.array(real)).dictionary_encode()
    distinct = pa.concat_arrays([coded.dictionary])
    ids, counts = encode_pieces(distinct, v)
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(counts) - counts
    all_ids, offsets = common.gathered(ids, first[which], counts[which])
    rows = np.searchsorted(np.flatnonzero(real), np.searchsorted(starts, ends))
    return all_ids, offsets[rows]


def decode(ids: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ids and the offset of each id's bytes."""
    return common.gathered(v.bytes, v.starts[ids], v.lengths[ids])


def with_ids(texts: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``texts`` with an array column of token ids in place of the text."""
    rest = [f for f in texts.schema if f.name not in (text, ids)]
    schema = T.StructType([*rest, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, rows = encode(batch.column(text), vocabulary(path))
        made = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(found, pa.int32()))
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), made], [*(f.name for f in rest), ids])

    return texts.select(*[f"`{f.name}`" for f in rest], f"`{text}`").mapInArrow(common.in_slices(make, text), schema)


def with_text(coded: DataFrame, path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``coded`` with the decoded bytes in place of the ids."""
    rest = [f for f in coded.schema if f.name not in (ids, data)]
    schema = T.StructType([*rest, T.StructField(data, T.BinaryType())])

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = pa.concat_arrays([batch.column(ids)])
        v = vocabulary(path)
        found, at = decode(lists.flatten().to_numpy(zero_copy_only=False), v)
        rows = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())))
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at[rows]), pa.py_buffer(found)])
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), made.cast(pa.binary())], [*(f.name for f in rest), data])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                yield make(batch.slice(at, 200))

    return coded.select(*[f"`{f.name}`" for f in rest], f"`{ids}`").mapInArrow(run, schema)


def round_trip(texts: DataFrame, path: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: number of tokens, digest of the decimal ids, and digest of the bytes decoded from the ids; the ids too, if wanted.

    These columns replace any of the same names.
    """
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    added += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * keep_ids
    rest = [f for f in texts.schema if f.name != text and f.name not in {a.name for a in added}]
    schema = T.StructType([*rest, *added])

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(path)
        ids, rows = encode(batch.column(text), v)
        back, at = decode(ids, v)
        shown, digits = common.gathered(v.digits, v.digit_starts[ids], v.digit_lengths[ids])
        spans = list(zip(rows[:-1], rows[1:]))
        made = [pa.array(np.diff(rows), pa.int64()),
                pa.array([hashlib.sha256(shown[digits[a]:max(digits[a], digits[b] - 1)]).hexdigest() for a, b in spans], pa.string()),
                pa.array([hashlib.sha256(back[at[a]:at[b]]).hexdigest() for a, b in spans], pa.string())]
        if keep_ids:
            made.append(pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32())))
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *made], schema.names)

    return texts.select(*[f"`{f.name}`" for f in rest], f"`{text}`").mapInArrow(common.in_slices(make, text), schema)


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    common.ready(spark)
    documents = common.table(spark, folder, "documents").select("doc_id", "text")
    return round_trip(documents, public_tokenizers.path(RANKS))
