"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters with three inputs: a trained embedding, the mean of trained embeddings of its character trigrams, and its
smoothed log-odds between toxic and clean training rows.  Words that fewer than FREQUENT training rows have share one
embedding and have log-odds 0.  A network reads windows of WINDOW words
that overlap by half; the score of a text is that of its most toxic window, so only such windows of toxic rows teach
the network.  All windows of all texts are scored.

The training sample is bounded (TRAIN_ROWS of each class, drawn by a digest of the id; of a text longer than
TRAIN_CHARACTERS, PIECES pieces drawn by digests teach); the statistics and weights are those of that sample.  Training runs on the driver with
fixed seeds, so reruns agree.

Null texts count as empty and are scored as a window without words.  Null ids are never held out and never labelled.
Repeated rows get equal scores.  Several labels of one id count as toxic if one of them does; null labels don't count.
Without training rows of both classes every score is the class that there is (0 if there is none).  An empty table
gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold.llm import common

WINDOW, STRIDE = 48, 24
HIDDEN, EMBEDDING, ATTENTION = 8, 8, 8
TRIGRAM_BITS = 12
TRAIN_ROWS, TRAIN_CHARACTERS, PIECES = 2000, 30_000, 12
FREQUENT = 3
#: Training ends after STEPS batches and EPOCHS rounds over the rows, whichever takes longer.
STEPS, EPOCHS, BATCH, RATE = 200, 5, 128, 0.01
THRESHOLD = 0.3
CHUNK = 4096


# ---- words --------------------------------------------------------------------------------------

def words_of(column: pa.Array) -> common.Words:
    """Runs of letters, lower-cased in ASCII; every byte beyond ASCII counts as a letter."""
    data, offsets = common.utf8(column)
    data = common.ascii_lower(data)
    return common.Words(data, offsets, ~(((data >= 97) & (data <= 122)) | (data >= 0x80)))


class Vocabulary:
    """Distinct words of a column: their hashes, trigram buckets, and the index of every word."""

    def __init__(self, column: pa.Array):
        words = words_of(column)
        coded = words.arrow().dictionary_encode()
        self.rows = words.rows
        self.index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        plain = pa.concat_arrays([coded.dictionary])
        offsets = np.frombuffer(plain.buffers()[1], dtype=np.int64)[:len(plain) + 1] if len(plain) else np.zeros(1, np.int64)
        self.size = len(plain)
        self.hashes = common.binary_hashes(plain)
        # Trigrams over <word>: every byte with its neighbours, a mark at both ends.
        data = np.frombuffer(plain.buffers()[2] or b"", dtype=np.uint8)[:int(offsets[-1])].astype(np.uint64)
        first = np.zeros(len(data), bool)
        first[offsets[:-1]] = True
        edge = np.zeros(min(1, len(data)), np.uint64)
        before = np.where(first, np.uint64(1), np.concatenate((edge, data[:-1])))
        after = np.where(np.append(first[1:], True)[:len(data)], np.uint64(2), np.concatenate((data[1:], edge)))
        self.trigrams = (common.mixed((before << np.uint64(16)) | (data << np.uint64(8)) | after) >> np.uint64(64 - TRIGRAM_BITS)).astype(np.int64)
        self.starts = offsets[:-1].copy()
        self.lengths = np.diff(offsets)

    def known(self, keys: np.ndarray) -> np.ndarray:
        """1 + the place of each distinct word among the sorted hashes ``keys``, 0 if it isn't there."""
        at = np.minimum(np.searchsorted(keys, self.hashes), len(keys) - 1)
        return np.where(keys[at] == self.hashes, at + 1, 0) if len(keys) else np.zeros(self.size, np.int64)

    def trigram_means(self, table: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.zeros((0, table.shape[1]), table.dtype)
        return np.add.reduceat(table[self.trigrams], self.starts, axis=0) / self.lengths[:, None].astype(table.dtype)


def windows_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and number of words of every window, and the row that it belongs to; a row without words has one empty window."""
    sizes = np.diff(rows)
    each = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(sizes)), each)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    start = rows[owner] + turn * STRIDE
    return start, np.minimum(WINDOW, rows[owner + 1] - start), owner


# ---- the network --------------------------------------------------------------------------------

def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def fresh_weights(n_words: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    inputs = EMBEDDING + 1

    def drawn(*shape, scale=None):
        return (rng.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)

    made = {"words": drawn(n_words, EMBEDDING, scale=0.05), "trigrams": drawn(1 << TRIGRAM_BITS, EMBEDDING, scale=0.1)}
    for side in ("f", "b"):
        made |= {f"{side}W": drawn(inputs, 3 * HIDDEN), f"{side}U": drawn(HIDDEN, 3 * HIDDEN), f"{side}b": np.zeros(3 * HIDDEN, np.float32)}
    made |= {"aW": drawn(2 * HIDDEN, ATTENTION), "ab": np.zeros(ATTENTION, np.float32), "av": drawn(ATTENTION),
             "oW": drawn(2 * HIDDEN), "ob": np.zeros(1, np.float32)}
    return made


def inputs_of(v: Vocabulary, weights: dict, ids: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Input vector of each distinct word (``ids``: its known word), and one of zeros at the end for places without a word."""
    vectors = weights["words"][ids] + v.trigram_means(weights["trigrams"])
    whole = np.concatenate((vectors, odds[ids][:, None]), axis=1)
    return np.concatenate((whole, np.zeros((1, whole.shape[1]), np.float32)))


def places_of(v: Vocabulary, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Word index at each place of each window; the last index (no word) beyond its end."""
    columns = np.arange(WINDOW)
    inside = columns < size[:, None]
    at = np.minimum(start[:, None] + columns, max(len(v.index) - 1, 0))
    return np.where(inside, v.index[at] if len(v.index) else 0, v.size).astype(np.int32)


def gru(gates: np.ndarray, places: np.ndarray, real: np.ndarray, U: np.ndarray, backward: bool, keep: list | None = None) -> np.ndarray:
    """Hidden states (places, windows, HIDDEN); where there is no word the state stays."""
    n, steps = places.shape
    h = np.zeros((n, HIDDEN), np.float32)
    states = np.empty((steps, n, HIDDEN), np.float32)
    for t in (range(steps - 1, -1, -1) if backward else range(steps)):
        x, u = gates[places[:, t]], h @ U
        zr = sigmoid(x[:, :2 * HIDDEN] + u[:, :2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
        there = real[:, t, None]
        if keep is not None:
            keep.append((t, h, z, r, new, u[:, 2 * HIDDEN:], there))
        h = np.where(there, new + z * (h - new), h)
        states[t] = h
    return states


def forward(places: np.ndarray, none: int, x: np.ndarray, w: dict, keep: dict | None = None) -> np.ndarray:
    """Logit of each window."""
    real = places != none
    kept_f, kept_b = ([], []) if keep is not None else (None, None)
    f = gru(x @ w["fW"] + w["fb"], places, real, w["fU"], False, kept_f)
    b = gru(x @ w["bW"] + w["bb"], places, real, w["bU"], True, kept_b)
    h = np.concatenate((f, b), axis=2)
    t = np.tanh(h @ w["aW"] + w["ab"])
    score = np.where(real.T, t @ w["av"], np.float32(-1e4))
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * h).sum(axis=0)
    if keep is not None:
        keep.update(f=kept_f, b=kept_b, h=h, t=t, weight=weight, pooled=pooled, real=real)
    return pooled @ w["oW"] + w["ob"]


def back_gru(kept: list, dstates: np.ndarray, gates_grad: np.ndarray, places: np.ndarray, U: np.ndarray) -> np.ndarray:
    """Adds the gradient of the gate inputs into ``gates_grad``; returns that of U."""
    dU, dh = np.zeros_like(U), np.zeros_like(dstates[0])
    for t, h, z, r, new, un, there in reversed(kept):
        dh = dh + dstates[t]
        d = np.where(there, dh, 0)
        dnew = d * (1 - z) * (1 - new * new)
        dz = d * (h - new) * z * (1 - z)
        dr = dnew * un * r * (1 - r)
        du = np.concatenate((dz, dr, dnew * r), axis=1)
        np.add.at(gates_grad, places[:, t], np.concatenate((dz, dr, dnew), axis=1))
        dU += h.T @ du
        dh = np.where(there, d * z + du @ U.T, dh)
    return dU


def gradients(places: np.ndarray, labels: np.ndarray, weight: np.ndarray, v: "Part", w: dict, x: np.ndarray, ids: np.ndarray) -> dict:
    """Gradients of the weighted mean log loss of some windows; ``x`` are the input vectors."""
    keep: dict = {}
    logit = forward(places, v.size, x, w, keep)
    dlogit = (weight * (sigmoid(logit) - labels) / len(labels)).astype(np.float32)
    g = {"oW": keep["pooled"].T @ dlogit, "ob": np.array([dlogit.sum()], np.float32)}
    dpooled = dlogit[:, None] * w["oW"]
    dh = keep["weight"][:, :, None] * dpooled
    dweight = (keep["h"] * dpooled).sum(axis=2)
    dscore = keep["weight"] * (dweight - (keep["weight"] * dweight).sum(axis=0))
    dt = dscore[:, :, None] * w["av"] * (1 - keep["t"] ** 2)
    g["av"] = (dscore[:, :, None] * keep["t"]).sum(axis=(0, 1))
    g["ab"] = dt.sum(axis=(0, 1))
    g["aW"] = np.tensordot(keep["h"], dt, axes=((0, 1), (0, 1)))
    dh = dh + dt @ w["aW"].T
    dx = np.zeros_like(x)
    for side, part, backward in (("f", dh[:, :, :HIDDEN], False), ("b", dh[:, :, HIDDEN:], True)):
        dgates = np.zeros((len(x), 3 * HIDDEN), np.float32)
        g[f"{side}U"] = back_gru(keep[side], part, dgates, places, w[f"{side}U"])
        g[f"{side}W"], g[f"{side}b"] = x.T @ dgates, dgates.sum(axis=0)
        dx += dgates @ w[f"{side}W"].T
    used = np.unique(places[places != v.size])
    dword = dx[used, :EMBEDDING]
    g["words"] = np.zeros_like(w["words"])
    np.add.at(g["words"], ids[used], dword)
    g["trigrams"] = np.zeros_like(w["trigrams"])
    sizes = v.lengths[used]
    flat, _ = common.gathered(v.trigrams, v.starts[used], sizes)
    np.add.at(g["trigrams"], flat, np.repeat(dword / sizes[:, None], sizes, axis=0))
    return g


# ---- training -----------------------------------------------------------------------------------

class Part:
    """The words of a few windows, as a small vocabulary."""

    def __init__(self, v: Vocabulary, places: np.ndarray):
        there, self.places = np.unique(np.append(places, v.size), return_inverse=True)
        self.places = self.places[:-1].reshape(places.shape)
        words = self.words = there[:-1]
        self.size, self.lengths = len(words), v.lengths[words]
        self.trigrams, offsets = common.gathered(v.trigrams, v.starts[words], self.lengths)
        self.starts = offsets[:-1]

    trigram_means = Vocabulary.trigram_means


def gradients_of(places: np.ndarray, labels: np.ndarray, weight: np.ndarray, v: Vocabulary, w: dict, ids: np.ndarray, odds: np.ndarray) -> dict:
    part = Part(v, places)
    return gradients(part.places, labels, weight, part, w, inputs_of(part, w, ids[part.words], odds), ids[part.words])


def word_table(v: Vocabulary, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the frequent words, and log-odds of toxic to clean rows for each (and for 0, all others)."""
    row = np.repeat(np.arange(len(labels)), np.diff(v.rows))
    pairs = np.unique(row * max(v.size, 1) + v.index)
    word, toxic = pairs % max(v.size, 1), labels[pairs // max(v.size, 1)] == 1
    n1, n0 = np.bincount(word[toxic], minlength=v.size), np.bincount(word[~toxic], minlength=v.size)
    odds = np.log((n1 + 0.5) / (labels.sum() + 1)) - np.log((n0 + 0.5) / ((1 - labels).sum() + 1))
    odds *= np.maximum(n1 + n0 - FREQUENT + 1, 0) / (n1 + n0 + 4)  # shrunk where few rows have the word
    frequent = np.flatnonzero(n1 + n0 >= FREQUENT)
    frequent = frequent[np.argsort(v.hashes[frequent])]
    return v.hashes[frequent], np.concatenate(([0], odds[frequent])).astype(np.float32)


def train(texts: list[str], labels: list[int]) -> dict:
    """Weights and log-odds from labelled texts."""
    y = np.array(labels, dtype=np.int64)
    v = Vocabulary(pa.array(texts, pa.string()))
    keys, odds = word_table(v, y)
    ids = v.known(keys)
    start, size, owner = windows_of(v.rows)
    places = places_of(v, start, size)
    w = fresh_weights(len(odds))
    rng = np.random.Generator(np.random.PCG64(11))
    moments = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in w.items()}
    strongest = odds[np.append(ids, 0)][places]
    score = strongest.max(axis=1)
    step = epoch = 0
    weight = np.where(y == 1, min(4.0, (y == 0).sum() / y.sum()), 1.0).astype(np.float32)
    while epoch < EPOCHS or step < STEPS:
        epoch += 1
        # The most toxic window of each row so far, and one more of each clean row.
        order = np.lexsort((-score, owner))
        top = order[np.concatenate(([True], np.diff(owner[order]) > 0))]
        counts = np.bincount(owner, minlength=len(y))
        some = (np.cumsum(counts) - counts + rng.integers(0, 1 << 30, len(y)) % counts)[y == 0]
        chosen = rng.permutation(np.concatenate((top, some)))
        for at in range(0, len(chosen), BATCH):
            part = chosen[at:at + BATCH]
            step += 1
            for k, g in gradients_of(places[part], y[owner[part]].astype(np.float32), weight[owner[part]], v, w, ids, odds).items():
                m, s = moments[k]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w[k] -= (RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        score = logits(places, v.size, inputs_of(v, w, ids, odds), w)
    return w | {"keys": keys, "odds": odds}


def logits(places: np.ndarray, none: int, x: np.ndarray, w: dict) -> np.ndarray:
    parts = [forward(places[at:at + CHUNK], none, x, w) for at in range(0, len(places), CHUNK)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def score_column(column: pa.Array, model: dict) -> np.ndarray:
    """Score of each text: that of its most toxic window."""
    if "constant" in model:
        return np.full(len(column), float(model["constant"]))
    v = Vocabulary(column)
    x = inputs_of(v, model, v.known(model["keys"]), model["odds"])
    start, size, owner = windows_of(v.rows)
    scores = np.zeros(len(column))
    for at in range(0, len(start), CHUNK):  # the places of a very long text never stand in memory together
        part = slice(at, at + CHUNK)
        np.maximum.at(scores, owner[part], sigmoid(forward(places_of(v, start[part], size[part]), v.size, x, model).astype(np.float64)))
    return scores


# ---- jobs ---------------------------------------------------------------------------------------

def remainder(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4, F.lit(0))


def taught(key: Column, text: Column) -> Column:
    """The text, or of a long one pieces at places drawn by digests of its id, so that a row's share of the sample is bounded."""
    size = TRAIN_CHARACTERS // PIECES
    pieces = [F.substring(text, F.pmod(F.xxhash64(key, F.lit(k)), F.length(text) - size).cast("int") + 1, F.lit(size)) for k in range(PIECES)]
    return F.when(F.length(text) <= TRAIN_CHARACTERS, text).otherwise(F.concat_ws("\n", *pieces))


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> dict:
    """A model from a bounded sample of the labelled rows that aren't held out."""
    known = (labels.filter("toxic is not null").groupBy(F.col(key).alias("id")).agg(F.max("toxic").alias("toxic"))
             .filter(remainder(F.col("id")) != 2))
    place = F.md5(F.col("id").cast("string").cast("binary"))
    there = documents.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text is not null")
    sample = None
    for toxic in (0, 1):
        # Twice the rows, as some labelled ids may have no text; the sample is cut again below.
        ids = known.filter(F.col("toxic") == toxic).orderBy(place).limit(2 * rows)
        sample = ids if sample is None else sample.union(ids)
    drawn = there.join(F.broadcast(sample), "id").withColumn("text", taught(F.col("id"), F.col("text")))  # at most 4 * rows ids
    found = drawn.groupBy("id", "toxic").agg(F.min("text").alias("text")).withColumn("place", place)
    texts, marks = [], []
    for toxic in (0, 1):
        for row in found.filter(F.col("toxic") == toxic).orderBy("place").limit(rows).collect():
            texts.append(row.text)
            marks.append(toxic)
    if len(set(marks)) < 2:
        return {"constant": max(marks, default=0)}
    return train(texts, marks)


def score(documents: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """``documents`` with a score column."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in documents.columns if c != name]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name != name) + f", `{name}` double"

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = score_column(batch.column(text), shared.value)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*columns, name])

    return documents.select(*[f"`{c}`" for c in columns]).mapInArrow(common.in_slices(make, text), schema)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    common.ready(spark)
    documents = common.table(spark, folder, "documents").select("doc_id", "text")
    model = fit(documents, common.table(spark, folder, "labels"))
    return score(documents, model).select(
        "doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
