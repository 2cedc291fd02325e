"""Merkle manifest of a table: a SHA-256 tree whose parents retain hash states.

A leaf is the digest of a row.  Within a group (a null group is one too) leaves ascend by key, null keys first and
equal keys by leaf; every ARITY consecutive nodes become their parent until one node, the group's subroot, remains.
Subroots, ordered by group, are the leaves of one more such tree, whose root names the table.

A child's digest as hex text is exactly one SHA-256 block.  So the hash state before each child slot is eight words;
every parent retains its states, and a changed child is folded by resuming the state before its slot with the
replacement and the right siblings only; left siblings are not read again.

Leaves are ranked by ranges: a range counts its rows, and ranges before it give the offset, so a group may have any
size.  A task climbs LEVELS levels, that is, at most ARITY ** LEVELS nodes of one group; its states and digests are one row
of a table.  From the top, each node receives its path (per level: slot, retained state, siblings), and the leaves fold last.

Null columns have their own mark in a leaf, so null and empty texts differ.  Repeated rows are leaves of their own.  An
empty table gives an empty result.  Other columns are passed by, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhold.llm import common

ARITY = 8
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---- SHA-256 over many messages at once -----------------------------------------------------------

def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle ** 3 <= x else (low, middle - 1)
    return low


@lru_cache(maxsize=1)
def _constants() -> tuple[list[np.uint32], np.ndarray]:
    """Round constants and initial state: fractions of the cube and square roots of the first primes."""
    primes = [p for p in range(2, 312) if all(p % d for d in range(2, math.isqrt(p) + 1))][:64]
    rounds = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in primes]
    return rounds, np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in primes[:8]], np.uint32)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compressed(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The states (n x 8 words) after one block (n x 16 words) each."""
    if not len(blocks):
        return np.zeros((0, 8), np.uint32)
    rounds, _ = _constants()
    w = list(np.ascontiguousarray(blocks.T))
    a, b, c, d, e, f, g, h = np.broadcast_to(states, (len(blocks), 8)).T.copy()
    for k, constant in enumerate(rounds):
        if k >= 16:
            near, far = w[k - 15], w[k - 2]
            w.append(w[k - 16] + w[k - 7] + (_turned(near, 7) ^ _turned(near, 18) ^ (near >> np.uint32(3)))
                     + (_turned(far, 17) ^ _turned(far, 19) ^ (far >> np.uint32(10))))
        t = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + constant + w[k]
        u = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return np.stack([a, b, c, d, e, f, g, h], axis=1) + states


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Digests (n x 8 words) as lowercase hex text: one block of 16 words each."""
    raw = np.ascontiguousarray(digests).astype(">u4").view(np.uint8).reshape(-1, 32)
    nibbles = np.stack([raw >> 4, raw & 15], axis=2).reshape(-1, 64)
    return (nibbles + np.where(nibbles < 10, 48, 87).astype(np.uint8)).view(">u4").astype(np.uint32)


def ending(counts: np.ndarray) -> np.ndarray:
    """The last block of a message of so many whole blocks."""
    out = np.zeros((len(counts), 16), np.uint32)
    out[:, 0], out[:, 15] = 0x80000000, counts * 512
    return out


class Parents:
    """One level of a block: per parent the number of children, the states before and after each child slot, and the digest."""

    def __init__(self, children: np.ndarray):
        n = -(-len(children) // ARITY)
        self.counts = np.minimum(ARITY, len(children) - ARITY * np.arange(n))
        blocks = np.zeros((n * ARITY, 16), np.uint32)
        blocks[:len(children)] = hex_blocks(children)
        blocks = blocks.reshape(n, ARITY, 16)
        self.states = np.empty((n, ARITY + 1, 8), np.uint32)
        self.states[:, 0] = _constants()[1]
        for slot in range(ARITY):
            there = self.counts > slot
            self.states[:, slot + 1] = self.states[:, slot]
            self.states[there, slot + 1] = compressed(self.states[there, slot], blocks[there, slot])
        self.digests = compressed(self.states[:, ARITY], ending(self.counts))

    def packed(self) -> bytes:
        return self.states.tobytes() + self.digests.tobytes()

    @classmethod
    def unpacked(cls, data: memoryview, children: int) -> tuple[Parents, int]:
        """The level above so many children, as it was retained, and the bytes that it took."""
        self, n = cls.__new__(cls), -(-children // ARITY)
        self.counts = np.minimum(ARITY, children - ARITY * np.arange(n))
        words = np.frombuffer(data, np.uint32, n * (ARITY + 2) * 8)
        self.states = words[:n * (ARITY + 1) * 8].reshape(n, ARITY + 1, 8)
        self.digests = words[n * (ARITY + 1) * 8:].reshape(n, 8)
        return self, words.nbytes


def resumed(states: np.ndarray, replacements: np.ndarray, right: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    """Parents' digests from the states before the replaced slots, the replacements, and the right siblings.

    ``right`` has one array per place to the right: digests of the first rows that have a sibling there (rows stand by falling number of these).
    """
    states = compressed(states, hex_blocks(replacements))
    for siblings in right:
        states[:len(siblings)] = compressed(states[:len(siblings)], hex_blocks(siblings))
    return compressed(states, ending(counts))


def folded(parents: Parents, children: np.ndarray, place: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Digests of the parents of the nodes at ``place`` when each node alone has its value replaced."""
    parent, slot = place // ARITY, place % ARITY
    after = parents.counts[parent] - slot - 1
    order = np.argsort(-after, kind="stable")
    place, parent, slot, after = place[order], parent[order], slot[order], after[order]
    right = [children[place[:np.searchsorted(-after, -k, side="right")] + k] for k in range(1, int(after.max(initial=0)) + 1)]
    out = np.empty((len(place), 8), np.uint32)
    out[order] = resumed(parents.states[parent, slot], values[order], right, parents.counts[parent])
    return out


# ---- paths ------------------------------------------------------------------------------------------

def step_of(parents: Parents, children: np.ndarray, place: int) -> bytes:
    """A level of a path: number of siblings, slot, the state before the slot, siblings from left to right."""
    parent, slot = divmod(place, ARITY)
    n = int(parents.counts[parent])
    family = children[parent * ARITY:parent * ARITY + n]
    return bytes([n - 1, slot]) + parents.states[parent, slot].tobytes() + np.delete(family, slot, axis=0).tobytes()


def steps_in(path: bytes):
    """(slot, state, siblings) per level of a path, lowest first."""
    at = 0
    while at < len(path):
        n, slot = path[at], path[at + 1]
        words = np.frombuffer(path, np.uint32, 8 * (n + 1), at + 2).reshape(-1, 8)
        yield slot, words[0], words[1:]
        at += 2 + words.nbytes


def height(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while ARITY ** levels < n:
        levels += 1
    return levels


def words_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return common.stacked(column, ">u4").astype(np.uint32).reshape(-1, 8) if len(column) else np.zeros((0, 8), np.uint32)


def digests_of(words: np.ndarray) -> pa.Array:
    return pa.array([w.tobytes() for w in words.astype(">u4")], pa.binary())


def levels_of(children: np.ndarray, held: bytes) -> list[tuple[Parents, np.ndarray]]:
    """(retained parents, their children) of a block, lowest level first."""
    out, data = [], memoryview(held)
    while len(data):
        parents, taken = Parents.unpacked(data, len(children))
        out.append((parents, children))
        data, children = data[taken:], parents.digests
    return out


# ---- jobs ---------------------------------------------------------------------------------------------

BLOCK = ARITY ** LEVELS
BLOCKS = "key string, rank long, n long, digest binary, held binary"


def field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """Digest of a row: every column by its length and value, or a mark where it is null."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def ranked(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` with ``rank`` by the order within their ``key`` (a string that isn't null), and ``n``, the number of its nodes."""
    there = nodes.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("part", F.spark_partition_id())

    def placed(batches):
        last, seen = None, 0
        for batch in batches:
            keys = batch.column("key")
            runs = keys.dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
            place = np.empty(len(runs), np.int64)
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a < b:
                    seen = seen if keys[a].as_py() == last else 0
                    place[a:b] = seen + np.arange(b - a)
                    last, seen = keys[a].as_py(), seen + b - a
            yield batch.append_column("place", pa.array(place))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in there.schema)
    rows = common.written(there.mapInArrow(placed, f"{kinds}, place long"), f"{name}-places")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range and key
    starts = (rows.groupBy("key", "part").agg(F.count("*").alias("there"))
              .select("key", "part", F.coalesce(F.sum("there").over(before), F.lit(0)).alias("start"), F.sum("there").over(Window.partitionBy("key")).alias("n")))
    return common.written(rows.join(starts, ["key", "part"]).withColumn("rank", F.col("start") + F.col("place")).drop("part", "place", "start"), f"{name}-ranked")


def climbed(nodes: DataFrame, name: str) -> DataFrame:
    """A row per block of nodes: its root as a node of the next step, and the states and digests that its parents retain."""
    def climb(block: pa.Table) -> pa.Table:
        block = block.sort_by("rank")
        digests, n, held = words_of(block.column("digest")), block.column("n")[0].as_py(), []
        levels = min(LEVELS, height(n))
        for _ in range(levels):
            parents = Parents(digests)
            held.append(parents.packed())
            digests = parents.digests
        return pa.table({"key": [block.column("key")[0].as_py()], "rank": [block.column("rank")[0].as_py() // BLOCK], "n": [-(-n // ARITY ** levels)],
                         "digest": digests_of(digests), "held": pa.array([b"".join(held)], pa.binary())})

    rows = nodes.select("key", "rank", "n", "digest", F.floor(F.col("rank") / BLOCK).alias("block"))
    return common.written(rows.groupBy("key", "block").applyInArrow(climb, BLOCKS), f"{name}-blocks")


def built(nodes: DataFrame, name: str) -> list[tuple[DataFrame, DataFrame]]:
    """(nodes, their blocks) of each step, up to one node per key."""
    steps = [(nodes, climbed(nodes, name))]
    while (steps[-1][1].agg(F.max("n")).first()[0] or 1) > 1:
        steps.append((steps[-1][1], climbed(steps[-1][1], name)))
    return steps


def _dealt(nodes: DataFrame, blocks: DataFrame):
    """Nodes and their blocks, each block of at most BLOCK nodes in one group."""
    left = nodes.withColumn("block", F.floor(F.col("rank") / BLOCK)).groupBy("key", "block")
    return left.cogroup(blocks.withColumnRenamed("rank", "block").groupBy("key", "block"))


def block_paths(steps: list[tuple[DataFrame, DataFrame]], tops: DataFrame, name: str) -> DataFrame:
    """(key, rank, held, path, ...) of the lowest blocks; ``tops`` has the path above each key's root."""
    extra = [c for c in tops.columns if c != "key"]
    blocks = steps[-1][1].join(tops, "key").select("key", "rank", "held", *extra)
    for (nodes, _), (_, below) in zip(reversed(steps), reversed([(None, None), *steps[:-1]])):
        if below is None:
            return common.written(blocks, f"{name}-paths")

        def spread(own: pa.Table, block: pa.Table) -> pa.Table:
            own = own.sort_by("rank")
            levels = levels_of(words_of(own.column("digest")), block.column("held")[0].as_py())
            above = block.column("path")[0].as_py()
            paths = [b"".join(step_of(parents, children, place // ARITY ** k) for k, (parents, children) in enumerate(levels)) + above
                     for place in range(own.num_rows)]
            more = {c: pa.array(block.column(c).to_pylist() * own.num_rows, block.column(c).type) for c in extra if c != "path"}
            return pa.table({"key": own.column("key"), "rank": own.column("rank"), "path": pa.array(paths, pa.binary()), **more})

        kinds = ", ".join(f"{c} {tops.schema[c].dataType.simpleString()}" for c in extra if c != "path")
        shape = "key string, rank long, path binary" + (f", {kinds}" if kinds else "")
        paths = _dealt(nodes.select("key", "rank", "digest"), blocks).applyInArrow(spread, shape)
        blocks = below.select("key", "rank", "held").join(paths, ["key", "rank"])
    raise AssertionError("a tree has a step")


def manifest(leaves: DataFrame, name: str = "manifest") -> DataFrame:
    """Proofs and folded roots of ``leaves`` (id, key, digest, replacement): id, leaf, subroot, root, proof, folded_root.

    ``key`` is a string that isn't null and orders the groups; ``replacement`` is the digest to fold instead of a leaf, null for the leaf itself.
    """
    steps = built(ranked(common.written(leaves, f"{name}-leaves"), ["id", "digest"], f"{name}-leaf"), f"{name}-leaf")
    subroots = steps[-1][1].select(F.lit("").alias("key"), F.col("key").alias("of"), "digest")
    above = built(ranked(subroots, ["of"], f"{name}-root"), f"{name}-root")
    root = above[-1][1].select("key", F.col("digest").alias("root"), F.lit(b"").alias("path"))
    spread = block_paths(above, root, f"{name}-root")

    def root_paths(own: pa.Table, block: pa.Table) -> pa.Table:
        own = own.sort_by("rank")
        levels = levels_of(words_of(own.column("digest")), block.column("held")[0].as_py())
        paths = [b"".join(step_of(p, c, place // ARITY ** k) for k, (p, c) in enumerate(levels)) + block.column("path")[0].as_py() for place in range(own.num_rows)]
        return pa.table({"key": own.column("of"), "path": pa.array(paths, pa.binary()), "subroot": own.column("digest"),
                         "root": pa.array(block.column("root").to_pylist() * own.num_rows, pa.binary())})

    tops = common.written(_dealt(above[0][0], spread).applyInArrow(root_paths, "key string, path binary, subroot binary, root binary"), f"{name}-tops")
    blocks = block_paths(steps, tops, f"{name}-leaf")
    id_kind = leaves.schema["id"].dataType.simpleString()

    def fold(own: pa.Table, block: pa.Table) -> pa.Table:
        own = own.sort_by("rank")
        children = words_of(own.column("digest"))
        replaced = own.column("replacement").to_pylist()
        values = words_of(pa.array([r or d for r, d in zip(replaced, own.column("digest").to_pylist())], pa.binary()))
        place, proofs = np.arange(own.num_rows), [[] for _ in range(own.num_rows)]
        for parents, nodes in levels_of(children, block.column("held")[0].as_py()):
            values = folded(parents, nodes, place, values)
            text = hex_blocks(nodes).astype(">u4").tobytes()
            for proof, p in zip(proofs, place.tolist()):
                low, high = p // ARITY * ARITY * 64, min(len(text), (p // ARITY + 1) * ARITY * 64)
                proof += (text[low:p * 64], text[(p + 1) * 64:high])
            place = place // ARITY
        rest = b""
        for slot, state, siblings in steps_in(block.column("path")[0].as_py()):
            right = [np.broadcast_to(s, (len(values), 8)) for s in siblings[slot:]]
            values = resumed(np.broadcast_to(state, (len(values), 8)), values, right, np.full(len(values), len(siblings) + 1))
            rest += hex_blocks(siblings).astype(">u4").tobytes()
        return pa.table({
            "id": own.column("id"), "leaf": own.column("digest"), "subroot": pa.array(block.column("subroot").to_pylist() * own.num_rows, pa.binary()),
            "root": pa.array(block.column("root").to_pylist() * own.num_rows, pa.binary()),
            "proof": pa.array([hashlib.sha256(b"".join(p) + rest).digest() for p in proofs], pa.binary()), "folded_root": digests_of(values)})

    return _dealt(steps[0][0].select("key", "rank", "id", "digest", "replacement"), blocks).applyInArrow(
        fold, f"id {id_kind}, leaf binary, subroot binary, root binary, proof binary, folded_root binary")


def group_key(column: Column) -> Column:
    """A string that isn't null and sorts as the column does: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    common.ready(spark)
    documents = common.table(spark, folder, "documents").select(*FIELDS)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    changed = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    leaves = documents.select(F.col("doc_id").alias("id"), group_key(F.col("lang")).alias("key"), leaf([F.col(c) for c in FIELDS]).alias("digest"),
                              F.when(tampered, leaf(changed)).alias("replacement"))
    text = lambda c: F.lower(F.hex(c))
    return manifest(leaves).select(F.col("id").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
                                   text("proof").alias("proof_sha256"), text("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


# ---- the same in DuckDB -------------------------------------------------------------------------------

def sql(levels: int = 7) -> str:
    """The query's rows for tables of up to ARITY ** levels rows per group and groups in all: a level is a pair of tables.

    A level gives each node its parent, and each row the proof so far and the digest that its changed leaf folds to.
    """
    def mark(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, CAST(b AS UBIGINT)), list_transform(range(8), lambda z: CAST(z AS UBIGINT))), lambda c, z: {bit})"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS UBIGINT))), lambda c, b: {byte}), 4294967295)"
    plain = " || ".join(mark(c) for c in FIELDS)
    lower = " || ".join(mark(f"translate(text, '{UPPER}', '{LOWER}')" if c == "text" else c) for c in FIELDS)
    out = f"""
WITH given AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '-') AS key, sha256({plain}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({lower}) ELSE sha256({plain}) END AS value FROM documents),
n0 AS MATERIALIZED (SELECT key, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS digest, doc_id, value FROM given),
f0 AS (SELECT doc_id, key, i, digest AS leaf, value, '' AS proof FROM n0),"""

    def climb(nodes: str, fold: str, k: str) -> str:
        """Tables p<k> (key, i, digests, digest), n<k>, and f<k> from nodes and folds below."""
        return f"""
m{k} AS MATERIALIZED (SELECT key, i // {ARITY} AS i, list(digest ORDER BY i) AS children, (SELECT count(*) FROM {nodes} z WHERE z.key = x.key) AS n FROM {nodes} x GROUP BY key, i // {ARITY}),
n{k} AS MATERIALIZED (SELECT key, i, CASE WHEN n = 1 THEN children[1] ELSE sha256(array_to_string(children, '')) END AS digest FROM m{k}),
f{k} AS MATERIALIZED (SELECT f.doc_id, f.key, f.i // {ARITY} AS i, f.leaf,
  CASE WHEN m.n = 1 THEN f.value ELSE sha256(array_to_string(m.children[:f.i % {ARITY}] || [f.value] || m.children[f.i % {ARITY} + 2:], '')) END AS value,
  CASE WHEN m.n = 1 THEN f.proof ELSE f.proof || array_to_string(m.children[:f.i % {ARITY}] || m.children[f.i % {ARITY} + 2:], '') END AS proof
  FROM {fold} f JOIN m{k} m ON f.key = m.key AND f.i // {ARITY} = m.i),"""

    nodes, fold = "n0", "f0"
    for k in range(levels):
        out += climb(nodes, fold, f"a{k}")
        nodes, fold = f"na{k}", f"fa{k}"
    out += f"""
t0 AS MATERIALIZED (SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS i, digest, key AS lang FROM {nodes}),
g0 AS (SELECT f.doc_id, '' AS key, t.i, f.leaf, f.value, f.proof, f.key AS lang FROM {fold} f JOIN t0 t ON f.key = t.lang),
s0 AS (SELECT doc_id, key, i, leaf || lang AS leaf, value, proof FROM g0),"""
    nodes, fold = "t0", "s0"
    for k in range(levels):
        out += climb(nodes, fold, f"b{k}")
        nodes, fold = f"nb{k}", f"fb{k}"
    return out.rstrip(",") + f"""
SELECT f.doc_id, f.leaf[:64] AS leaf, t.digest AS subroot, r.digest AS root, sha256(f.proof) AS proof_sha256, f.value AS folded_root, f.value = r.digest AS verified
FROM {fold} f JOIN t0 t ON f.leaf[65:] = t.lang CROSS JOIN {nodes} r"""
