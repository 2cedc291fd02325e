"""Secret scan: fixed forms, and novelty measured by dictionary-primed zstandard compression.

A string in a sensitive context (shortly after a word such as ``auth`` or ``credential``) is compressed behind a fixed ordinary
text, with the code around it and the corpus's identifiers as history.  The history starts with a zstandard dictionary trained on
identifiers, whose entropy tables give ordinary letters few bits from the first byte on.  The bytes that the string adds, per character,
are its novelty.  It is reported as ``novel``, unless a fixed form covers it, if nearly all ordinary identifiers of its length
add less: compounds of frequent words that the dictionary of the comparison has not seen, in the usual spellings.  A name in capitals
is measured in lower case.

Null and empty texts have no spans.  Rows are handled one by one, so ties, repeated rows, null ids, and an empty table
need no rule; other columns, whatever their names, are passed by.  The scan is linear in a text but for the compression of its candidates.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold.llm import common

# The forms that every scan must find, with the least length of the part that counts.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

KINDS = ("assign", "access", "hex", "novel")
CONTEXT = r"(?:passw|passphrase|secret|credential|bearer|authorization|auth_|private_?key|access_?key|api_?key|client_?key|signature|token|pwd)"
#: A candidate begins at most this many characters after its context word.
REACH = 40
SHORTEST = 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
SURROUNDING = 600
#: A novel string adds more than this share of the ordinary identifiers of its length, and a little more than that.
QUANTILE, MARGIN = 0.99, 0.03
#: Lengths for which ordinary identifiers are measured, and how many; longer strings are held against the next smaller length.
LENGTHS, COMPOUNDS = (16, 18, 20, 22, 24, 28, 32, 40, 48, 64, 96, 128, 256, 512), 256
TRAINED_BYTES, SAMPLES = 8192, 1500
#: Ordinary words of code, so that a small corpus has enough of them.
ORDINARY = """access account action address analysis archive argument attribute authentication available background balance
boundary branch browser builder calculate callback capacity category certificate channel character collection column command comment
component compressed condition configuration connection container content context controller convert counter customer database default
definition deployment description destination developer directory document domain duration element enabled encoding environment equals error
example exception execution expected export expression external factory feature filename filter folder format function gateway generate graphic
handbook handler header history identifier image import income index information initial input instance integer interface internal
internationalization invoice iterator keyboard language layout library license listener location logger manager maximum measure member memory
message method minimum module monitor network notification number object operation option output package parameter parser password payment
performance permission pipeline platform pointer position printer priority private process product profile progress property protocol provider
public quality query record reference register release remote report request resource response result return schedule schema screen script
search section security segment selection server service session setting signature simple socket source standard statement status storage
stream string structure support system table target template terminal thread timeout total transaction transfer transport update upload
validator value variable verify version warning window worker workspace""".split()
DICTIONARY_WORDS, DICTIONARY_WORD_BYTES = 4096, 32
LEAST_DIGITS = 3
#: What stands only once in the corpus is no identifier of it.
LEAST_USES = 2

_assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_access = re.compile(ACCESS)
_hex = re.compile(r"[0-9a-f]{24,}")  # whole runs; shorter ones fail anyway
_context = re.compile(CONTEXT, re.ASCII | re.IGNORECASE)
_candidate = re.compile(CANDIDATE)
_capitals = re.compile(r"[A-Z/_-]+[0-9]{0,4}")
#: RE2 forms that every document with a span matches.
_ANY_BASE = (r"(?i:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6})"
             r"|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
_ANY_CONTEXT = f"(?i:{CONTEXT})"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in _assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in _access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return found + [(m.start(), m.end(), "hex") for m in _hex.finditer(text)]


@dataclass(frozen=True)
class Ordinary:
    """The history that every candidate gets, the text before it, and what ordinary identifiers of each length add at most."""

    history: bytes
    prefix: bytes
    limits: tuple[float, ...]

    def limit(self, length: int) -> float:
        return self.limits[bisect.bisect_right(LENGTHS, max(length, LENGTHS[0])) - 1]


def novelty(candidate: str, history: bytes, prefix: bytes) -> float:
    """Bytes that the candidate adds to the prefix when both are compressed with the history, per character."""
    primed = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(history))
    text = candidate.lower() if _capitals.fullmatch(candidate) else candidate
    return (len(primed.compress(prefix + text.encode())) - len(primed.compress(prefix))) / len(candidate)


def compound(words: list[str], length: int, rng: random.Random) -> str:
    """An ordinary identifier of some length: words in one of the usual spellings, sometimes with a number behind."""
    parts: list[str] = []
    while sum(map(len, parts)) < length:
        parts.append(rng.choice(words))
    style = rng.randrange(4)
    capital = [p[:1].upper() + p[1:] for p in parts]
    whole = ("_".join(parts), "".join(capital), "".join([parts[0], *capital[1:]]), "/".join(parts))[style][:length]
    number = str(rng.randrange(10 ** rng.randint(1, 4)))
    return whole[:length - len(number)] + number if rng.randrange(8) == 0 else whole


def trained_on(words: list[str], rng: random.Random) -> bytes:
    """A zstandard dictionary with entropy tables of identifiers, and the words themselves behind it, the first ones last."""
    samples = [" ".join(compound(words, rng.choice((16, 20, 28, 40)), rng) for _ in range(8)).encode() for _ in range(SAMPLES)]
    return zstandard.train_dictionary(TRAINED_BYTES, samples, k=64, d=8).as_bytes() + b" " + " ".join(reversed(words)).encode()


def ordinary(words: list[str]) -> Ordinary:
    """From the corpus's frequent identifiers, the most frequent first: every other one stands for those that a dictionary has not seen."""
    words = [*words, *(w for w in ORDINARY if w not in set(words))]
    seen, unseen = words[::2], words[1::2]
    rng = random.Random(17)
    prefix = (" ".join(compound(unseen, 24, rng) for _ in range(8)) + " ").encode()
    partial = trained_on(seen, rng)
    limits = []
    for length in LENGTHS:
        added = sorted(novelty(compound(unseen, length, rng), partial, prefix) for _ in range(COMPOUNDS))
        limits.append(added[int(QUANTILE * COMPOUNDS)] + MARGIN)
    return Ordinary(trained_on(words, rng), prefix, tuple(limits))


def is_novel(candidate: str, around: str, known: Ordinary) -> bool:
    return novelty(candidate, known.history + around.encode(), known.prefix) > known.limit(len(candidate))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Long runs that begin within REACH of a context word, or what follows the word within its run.

    Context words and runs are each walked once, side by side.
    """
    runs = _candidate.finditer(text)
    run, after = next(runs, None), 0
    for context in _context.finditer(text):
        at = max(context.end(), after)
        while run:
            start = max(run.start(), at)
            if run.end() - start < SHORTEST:
                run = next(runs, None)
            elif start > context.end() + REACH:
                break
            else:
                yield start, run.end()
                at = after = run.end()
                run = next(runs, None)


def novel_spans(text: str, base: list[tuple[int, int, str]], known: Ordinary) -> list[tuple[int, int, str]]:
    taken: list[list[int]] = []
    for a, b, _ in sorted(base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    found, place = [], 0
    for start, end in candidates(text):
        while place < len(taken) and taken[place][1] <= start:
            place += 1
        if place < len(taken) and taken[place][0] < end:
            continue
        around = text[max(0, start - SURROUNDING):start] + text[end:end + SURROUNDING]
        if is_novel(text[start:end], around, known):
            found.append((start, end, "novel"))
    return found


def identifiers(documents: DataFrame, text: str = "text") -> list[str]:
    """The corpus's most frequent identifiers, the most frequent first.

    At most DICTIONARY_WORDS of DICTIONARY_WORD_BYTES reach the driver; counts cover all documents.
    """
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = common.utf8(batch.column(0))
        letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        words = common.Words(data, offsets, ~(letter | ((data >= 48) & (data <= 57)) | (data == 95)))
        sizes = np.diff(words.offsets)
        # Generated strings have digits among letters; a secret must not be its own dictionary.
        digit = np.concatenate((((words.data >= 48) & (words.data <= 57)).astype(np.int64), [0]))
        digits = np.add.reduceat(digit, words.offsets[:-1]) if len(words) else sizes
        kept = (sizes >= 6) & (sizes <= DICTIONARY_WORD_BYTES) & (digits < LEAST_DIGITS)
        counted = words.arrow().filter(pa.array(kept)).value_counts()
        return pa.RecordBatch.from_arrays([counted.field(0).cast(pa.string()), counted.field(1)], ["word", "n"])

    counts = documents.select(f"`{text}`").mapInArrow(common.in_slices(count, text), "word string, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_USES).orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS).collect()
    return [r.word for r in top]


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the fixed forms and novel strings, digest of the fixed forms' spans, and all spans."""
    shared = documents.sparkSession.sparkContext.broadcast(ordinary(identifiers(documents, text)))
    key_type = documents.schema[key].dataType.simpleString()

    def shown(spans: list[tuple[int, int, str]]) -> str:
        return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text)
        any_base = pc.fill_null(pc.match_substring_regex(texts, _ANY_BASE), False).to_pylist()
        any_context = pc.fill_null(pc.match_substring_regex(texts, _ANY_CONTEXT), False).to_pylist()
        rows = []
        for i, (has_base, has_context) in enumerate(zip(any_base, any_context)):
            if not (has_base or has_context):
                rows.append((0, 0, 0, 0, "", ""))
                continue
            whole = texts[i].as_py()
            base = base_spans(whole) if has_base else []
            novel = novel_spans(whole, base, shared.value) if has_context else []
            n = [sum(kind == k for _, _, k in base) for kind in KINDS[:3]]
            rows.append((*n, len(novel), shown(base), shown(base + novel)))
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [batch.column(key), *(pa.array(c, pa.int64()) for c in columns[:4]),
             pa.array([hashlib.sha256(s.encode()).hexdigest() for s in columns[4]], pa.string()), pa.array(columns[5], pa.string())],
            [key, "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return documents.select(f"`{key}`", f"`{text}`").mapInArrow(
        common.in_slices(make, text),
        f"`{key}` {key_type}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    common.ready(spark)
    return scan(common.table(spark, folder, "documents"))
