"""Zipped filing archives as a batch data source: one input partition per archive and member.

A compressed member is one sequential stream, so a member is the unit of parallel work; rows leave the
reader in small Arrow batches with their line number, and the ingest job lands them as Parquet once.
Files are opened through Arrow's file systems, so local, HDFS, and object-store paths all work.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import re
import uuid
import zipfile
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyhold.schemas import RAW_MEMBERS, raw_schema

ARCHIVE_GLOB = "*_form13f.zip"
_ROWS_PER_BATCH = 20_000
_BLOCK_BYTES = 2 << 20
#: Values with one of these are written in quotes.
_ODD = '["\t\r\n]'


def list_archives(location: str) -> list[str]:
    """Paths of one archive, or of every archive in a folder, sorted by path."""
    system, path = _located(location)
    info = system.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [location]
    found = system.get_file_info(pafs.FileSelector(path))
    # Arrow's paths have no scheme, host, or account; the archive keeps the spelling of its folder, which Spark needs too.
    return sorted(f"{location.rstrip('/')}/{item.base_name}" for item in found if fnmatch.fnmatch(item.base_name, ARCHIVE_GLOB))


def _located(path: str):
    """File system and inner path; Spark's ``s3a`` and ``s3n`` are Arrow's ``s3``."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path)) if "://" in path else (pafs.LocalFileSystem(), path)


def _open(path: str):
    system, inner = _located(path)
    return system.open_input_file(inner)


def stored_bytes(*paths: str) -> int:
    """Size of files or folders as stored; missing paths count as nothing."""
    total = 0
    for path in paths:
        system, inner = _located(path)
        info = system.get_file_info(inner)
        if info.type == pafs.FileType.File:
            total += info.size
        elif info.type == pafs.FileType.Directory:
            found = system.get_file_info(pafs.FileSelector(inner, recursive=True))
            total += sum(item.size for item in found if item.type == pafs.FileType.File)
    return total


def write_archives(members: dict[str, DataFrame], location: str) -> None:
    """Zipped archives as ``read_archives`` takes them, from one table per member (``archive``, ``row_no``, the member's columns).

    An archive is one file, so one task writes it, line by line in the order of the rows; a file appears under its name once it is whole.
    """
    def quoted(value):
        return F.when(value.rlike(_ODD), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)

    def line(columns: list[str]):
        values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
        return F.when(F.concat(*values).rlike(_ODD), F.concat_ws("\t", *[quoted(v) for v in values])).otherwise(F.concat_ws("\t", *values))

    rows = None
    for at, member in enumerate(RAW_MEMBERS):
        lines = members[member].select("archive", F.lit(at).alias("member"), "row_no", line([c.lower() for c in RAW_MEMBERS[member]]).alias("line"))
        rows = lines if rows is None else rows.unionByName(lines)
    dealt = rows.repartition("archive").sortWithinPartitions("archive", "member", "row_no", F.desc("line"))

    def write(batches):
        name = target = stream = archive = entry = None
        at = -1
        system, folder = _located(location)
        system.create_dir(folder, recursive=True)

        def opened(upto: int) -> None:
            """The entries up to a member; one without rows has its header only."""
            nonlocal entry, at
            while at < upto:
                if entry:
                    entry.close()
                at += 1
                member = list(RAW_MEMBERS)[at]
                entry = archive.open(f"{member}.tsv", "w", force_zip64=True)
                entry.write(("\t".join(RAW_MEMBERS[member]) + "\n").encode())

        def finished() -> None:
            opened(len(RAW_MEMBERS) - 1)
            entry.close()
            archive.close()
            stream.close()
            system.move(target, f"{folder.rstrip('/')}/{name}")

        for batch in batches:
            owner = batch.column("archive").dictionary_encode()
            of, in_member = owner.indices.to_numpy(), batch.column("member").to_numpy()
            # Every line with its end, one after the other: a run of lines is a slice of these bytes.
            ended = pc.binary_join_element_wise(batch.column("line").cast(pa.large_string()), *[pa.scalar(x, pa.large_string()) for x in ("", "\n")])
            places = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset:]
            turns = np.flatnonzero((of[1:] != of[:-1]) | (in_member[1:] != in_member[:-1])) + 1
            for first, end in pairwise([0, *turns.tolist(), batch.num_rows]):
                if first == end:
                    continue
                this = owner.dictionary[int(of[first])].as_py()
                if this != name:
                    if name is not None:
                        finished()
                    name, at, entry = this, -1, None
                    target = f"{folder.rstrip('/')}/.{uuid.uuid4().hex}.part"
                    stream = system.open_output_stream(target)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                opened(int(in_member[first]))
                entry.write(memoryview(ended.buffers()[2])[places[first]:places[end]])
        if name is not None:
            finished()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["archive"])

    dealt.mapInArrow(write, "archive string").count()


class MemberSlice(InputPartition):
    def __init__(self, path: str, member: str):
        super().__init__((path, member))
        self.path, self.member = path, member


class FilingArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str], member: str):
        self.paths, self.member = paths, member

    def partitions(self):
        return [MemberSlice(path, self.member) for path in self.paths]

    def read(self, partition: MemberSlice):
        wanted = f"{partition.member}.TSV"
        columns = RAW_MEMBERS[partition.member]
        archive_name = partition.path.rsplit("/", 1)[-1]
        names = ["archive", "row_no", *[column.lower() for column in columns]]
        with _open(partition.path) as handle, zipfile.ZipFile(handle) as archive:
            entries = [n for n in archive.namelist() if n.rsplit("/", 1)[-1].upper() == wanted]
            if not entries:
                raise ValueError(f"{archive_name} does not contain {wanted}")
            with archive.open(entries[0]) as raw:
                yield from _rows_of(raw, archive_name, columns, names)


def _rows_of(raw, archive_name: str, columns: tuple[str, ...], names: list[str]):
    """Batches of a member's rows.

    Blocks of whole lines without quotes and with equally many fields are cut by Arrow; from the first other block on, line by line.
    """
    header, row_no, rest, more = None, 0, b"", True
    while more:
        block = raw.read(_BLOCK_BYTES)
        more = bool(block)
        rest += block
        cut = rest.rfind(b"\n") + 1 if more else len(rest)
        plain = _plain(rest[:cut], header is None) if cut or len(rest) < csv.field_size_limit() else None
        if plain is None:
            yield from _lines_of(_Rest(rest, raw), header, row_no, archive_name, columns, names)
            return
        rest = rest[cut:]
        if header is None and plain:
            first, _, plain = plain.partition(b"\n")
            header = {name: at for at, name in enumerate(first.decode().split("\t"))}
        table = _cut(plain, [header.get(column) for column in columns]) if plain else None
        if table is None and plain:
            rest = plain + rest
            yield from _lines_of(_Rest(rest, raw), header, row_no, archive_name, columns, names)
            return
        for batch in table.to_batches(_ROWS_PER_BATCH) if plain else ():
            number = pa.array(np.arange(row_no + 1, row_no + 1 + batch.num_rows))
            row_no += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.repeat(archive_name, batch.num_rows), number, *batch.columns], names=names)


def _plain(block: bytes, first: bool) -> bytes | None:
    """Whole lines with plain ends if only tabs and line ends have a meaning in them; None if a reader of quoted text must decide."""
    if first:
        block = block.removeprefix(b"\xef\xbb\xbf")
    if b"\r" in block:
        block = block.replace(b"\r\n", b"\n")
    if b'"' in block or b"\r" in block or b"\0" in block or (first and block.startswith(b"\n")):
        return None
    ends = np.flatnonzero(np.frombuffer(block, np.uint8) == 10)
    if np.diff(ends, prepend=-1, append=len(block)).max() > csv.field_size_limit():
        return None
    try:
        block.decode()
    except UnicodeDecodeError:
        return None
    return block


def _cut(block: bytes, picks: list[int | None]) -> pa.Table | None:
    """The picked fields of each line; None if the lines differ in their number of fields."""
    start = next((at for at in range(len(block)) if block[at] != 10), None)
    if start is None:
        return pa.table({f"c{k}": pa.array([], pa.string()) for k in range(len(picks))})
    end = block.find(b"\n", start)
    width = block.count(b"\t", start, end if end >= 0 else len(block)) + 1
    wanted = sorted({at for at in picks if at is not None and at < width}) or [0]
    try:
        read = pacsv.read_csv(
            pa.BufferReader(block), pacsv.ReadOptions(use_threads=False, block_size=len(block) + 1, column_names=[f"f{at}" for at in range(width)]),
            pacsv.ParseOptions(delimiter="\t", quote_char=False, double_quote=False, escape_char=False),
            pacsv.ConvertOptions(column_types={f"f{at}": pa.string() for at in wanted}, include_columns=[f"f{at}" for at in wanted], strings_can_be_null=False, check_utf8=False))
    except pa.ArrowInvalid:
        return None
    return pa.table({f"c{k}": read.column(f"f{at}") if at in wanted else pa.nulls(read.num_rows, pa.string()) for k, at in enumerate(picks)})


class _Rest(io.RawIOBase):
    """Bytes already read, and then the rest of their stream."""

    def __init__(self, head: bytes, raw):
        self.head, self.raw = head, raw

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        if self.head:
            size = min(len(buffer), len(self.head))
            buffer[:size], self.head = self.head[:size], self.head[size:]
            return size
        found = self.raw.read(len(buffer))
        buffer[:len(found)] = found
        return len(found)


def _lines_of(rest: _Rest, header: dict[str, int] | None, row_no: int, archive_name: str, columns: tuple[str, ...], names: list[str]):
    """Batches of rows line by line, as the reader of quoted text cuts them; ``header`` is None if its line is still ahead."""
    text = io.TextIOWrapper(io.BufferedReader(rest, 1 << 16), encoding="utf-8-sig" if header is None else "utf-8", errors="replace", newline="")
    lines = csv.reader(text, delimiter="\t")
    if header is None:
        header = {name: at for at, name in enumerate(next(lines, []))}
    picks = [header.get(column) for column in columns]
    batch: list[tuple] = []
    for row_no, line in enumerate(filter(None, lines), row_no + 1):
        batch.append((archive_name, row_no, *[line[at] if at is not None and at < len(line) else None for at in picks]))
        if len(batch) == _ROWS_PER_BATCH:
            yield _arrow_batch(batch, names)
            batch = []
    if batch:
        yield _arrow_batch(batch, names)


def _arrow_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64()] + [pa.string()] * (len(names) - 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(zip(*rows), types)], names=names)


class FilingArchiveSource(DataSource):
    """``spark.read.format("filing_archive").option("member", "INFOTABLE").load(folder_or_zip)``."""

    @classmethod
    def name(cls):
        return "filing_archive"

    def schema(self):
        return raw_schema(self.options["member"].upper())

    def reader(self, schema):
        locations = self.options["path"].split(",")
        paths = [path for location in locations for path in list_archives(location)]
        if not paths:
            raise ValueError(f"No {ARCHIVE_GLOB} archives found in {self.options['path']}")
        return FilingArchiveReader(paths, self.options["member"].upper())


def read_member(spark: SparkSession, location: str, member: str) -> DataFrame:
    """Rows of one member of every archive: ``archive``, ``row_no``, then the member's columns as text."""
    spark.dataSource.register(FilingArchiveSource)
    return spark.read.format("filing_archive").option("member", member).load(location)


def read_archives(spark: SparkSession, location: str) -> dict[str, DataFrame]:
    return {member: read_member(spark, location, member) for member in RAW_MEMBERS}
