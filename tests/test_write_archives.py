import csv
import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyhold.schemas import RAW_MEMBERS, raw_schema
from tallyhold.sources import archives


def tables(spark, name="2025q1_form13f.zip", lines=300):
    def rows(member):
        width = len(RAW_MEMBERS[member]) - 1
        return [(name, n, f"a{n}", *(["v"] * width)) for n in range(1, lines + 1)]
    return {member: spark.createDataFrame(rows(member), raw_schema(member)) for member in RAW_MEMBERS}


def test_a_run_of_lines_is_one_write(spark, tmp_path, monkeypatch):
    made, taken, calls = tables(spark), {}, []

    def take(self, function, schema):
        taken["write"] = function
        return self.select("archive").limit(0)

    monkeypatch.setattr(type(made["SUBMISSION"]), "mapInArrow", take)
    archives.write_archives(made, str(tmp_path))
    opened = zipfile.ZipFile.open

    def counted(self, *args, **options):
        entry = opened(self, *args, **options)
        write = entry.write
        entry.write = lambda data: calls.append(len(data)) or write(data)
        return entry

    monkeypatch.setattr(zipfile.ZipFile, "open", counted)
    batch = pa.RecordBatch.from_pylist([{"archive": "x_form13f.zip", "member": at, "line": f"{at}-{n}"} for at in range(4) for n in range(500)])
    list(taken["write"]([batch.slice(0, 900), batch.slice(900)]))
    assert len(calls) <= 4 * 2 + 1  # a header and a run each, one run in two batches
    with zipfile.ZipFile(tmp_path / "x_form13f.zip") as whole:
        for at, member in enumerate(RAW_MEMBERS):
            assert whole.read(f"{member}.tsv").decode().split("\n") == ["\t".join(RAW_MEMBERS[member]), *[f"{at}-{n}" for n in range(500)], ""]


def test_odd_values_come_back(spark, tmp_path):
    made = tables(spark, lines=6)
    odd = ['two\ttabs', 'a "quote"', "line\nbreak", "\r", "", None]
    names = F.array(*[F.lit(v) for v in odd])
    made["INFOTABLE"] = made["INFOTABLE"].withColumn("nameofissuer", names[F.col("row_no").cast("int") - 1])
    archives.write_archives(made, str(tmp_path))
    back = archives.read_member(spark, str(tmp_path), "INFOTABLE").orderBy("row_no").collect()
    assert [r.nameofissuer for r in back] == [v or "" for v in odd]
    assert [r.accession_number for r in back] == [f"a{n}" for n in range(1, 7)] and {r.cusip for r in back} == {"v"}


def test_a_run_of_lines_is_a_slice_of_the_batch(spark, tmp_path, monkeypatch):
    made, taken, kinds = tables(spark), {}, []

    def take(self, function, schema):
        taken["write"] = function
        return self.select("archive").limit(0)

    monkeypatch.setattr(type(made["SUBMISSION"]), "mapInArrow", take)
    archives.write_archives(made, str(tmp_path))
    opened = zipfile.ZipFile.open

    def watched(self, *args, **options):
        entry = opened(self, *args, **options)
        write = entry.write
        entry.write = lambda data: kinds.append(type(data)) or write(data)
        return entry

    monkeypatch.setattr(zipfile.ZipFile, "open", watched)
    rows = [{"archive": f"{name}_form13f.zip", "member": at, "line": f"é{at}-{n}" if n else ""} for name in "ab" for at in range(4) for n in range(3)]
    batch = pa.RecordBatch.from_pylist(rows)
    assert list(taken["write"]([batch.slice(0, 5), batch.slice(5, 0), batch.slice(5)]))[-1].to_pylist() == [{"archive": "b_form13f.zip"}]
    assert memoryview in kinds  # no line became an object of its own
    for name in "ab":
        with zipfile.ZipFile(tmp_path / f"{name}_form13f.zip") as whole:
            assert [whole.read(f"{m}.tsv").decode().split("\n")[1:] for m in RAW_MEMBERS] == [["", f"é{at}-1", f"é{at}-2", ""] for at in range(4)]


HEADER = list(RAW_MEMBERS["INFOTABLE"])
PLAIN = [[f"{c}{n}" for c in "abcdefghi"] for n in range(50)]


def lines_of(rows, header=HEADER, end="\n"):
    return end.join("\t".join(row) for row in [header, *rows]) + end


def read(tmp_path, text):
    raw = text if isinstance(text, bytes) else text.encode()
    path = str(tmp_path / "2025q1_form13f.zip")
    with zipfile.ZipFile(path, "w") as whole:
        whole.writestr("INFOTABLE.tsv", raw)
    got = archives.FilingArchiveReader([path], "INFOTABLE").read(archives.MemberSlice(path, "INFOTABLE"))
    return [tuple(row.values()) for batch in got for row in batch.to_pylist()]


def expected(raw):
    text = io.TextIOWrapper(io.BytesIO(raw), encoding="utf-8-sig", errors="replace", newline="")
    lines = csv.reader(text, delimiter="\t")
    header = {name: at for at, name in enumerate(next(lines, []))}
    picks = [header.get(c) for c in HEADER]
    return [("2025q1_form13f.zip", n, *[line[at] if at is not None and at < len(line) else None for at in picks]) for n, line in enumerate(filter(None, lines), 1)]


@pytest.mark.parametrize("block", [64, 1 << 21])
@pytest.mark.parametrize("raw", [
    lines_of(PLAIN).encode(), lines_of(PLAIN).encode()[:-1], b"\xef\xbb\xbf" + lines_of(PLAIN, end="\r\n").encode(), lines_of(PLAIN, end="\r").encode(),
    lines_of(PLAIN, ["X", *HEADER[::-1][:5]]).encode(), lines_of([*PLAIN[:20], ["short"], [], ["x"] * 12, *PLAIN]).encode(), lines_of([row[:4] for row in PLAIN]).encode(),
    lines_of([*PLAIN[:30], ['"a\tb', 'c\nd"', *"efghijk"], *PLAIN]).encode(), lines_of([*PLAIN[:30], ['5" disk', *"bcdefghi"], *PLAIN]).encode(),
    lines_of([["", *["é\x85 "] * 8], *PLAIN]).encode(), lines_of(PLAIN).encode() + b"\xff\xc3\tx\n", lines_of([*PLAIN, ["\0"] * 9]).encode(),
    b"", b"\n", ("\t".join(HEADER)).encode(), b"\n" + lines_of(PLAIN).encode()], ids=lambda raw: str(len(raw)))
def test_members_are_cut_as_by_a_reader_of_quoted_text(tmp_path, monkeypatch, raw, block):
    monkeypatch.setattr(archives, "_BLOCK_BYTES", block, raising=False)
    assert read(tmp_path, raw) == expected(raw)


def test_plain_members_are_not_read_line_by_line(tmp_path, monkeypatch):
    def refuse(*args, **options):
        raise AssertionError("a plain member was read line by line")

    monkeypatch.setattr(archives.csv, "reader", refuse)
    rows = read(tmp_path, lines_of(PLAIN))
    assert [row[1:] for row in rows] == [(n, *row) for n, row in enumerate(PLAIN, 1)]
