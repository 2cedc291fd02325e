import json
import random

import pytest
from pyspark.sql import functions as F
from tallyhold import fixed_values as fv
from tallyhold.sources import exports, landed, members

PIECE = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_ranges(spark):
    wanted = {PIECE: "700", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def value(rng, depth):
    """Any JSON value, with strings that look like structure."""
    kind = rng.randrange(8 if depth else 5)
    text = "".join(rng.choice(['a', ',', '{', '}', '[', ']', '"', '\\', ':', 'é', '\n', '雪', ' ', '😀']) for _ in range(rng.randrange(12)))
    if kind >= 5:
        inner = [value(rng, depth - 1) for _ in range(rng.randrange(5))]
        return [inner, {f"{text}{k}": v for k, v in enumerate(inner)}, {}][kind - 5]
    return [text, rng.randrange(10**6), rng.random() < 0.5, None, text + ","][kind]


def flat(rows):
    return [(r.part, r.key, r.value) for r in sorted(rows, key=lambda r: r.at)]


def same(found, expected):
    """Text of a member against its value: strings as they are, other values as JSON."""
    if isinstance(expected, str) or expected is None:
        return found == expected
    return json.loads(found) == expected


def test_members_of_any_object(spark, tmp_path, small_ranges):
    rng = random.Random(4)
    for turn in range(4):
        whole = {f"m,{k}{{": value(rng, 3) for k in range(rng.choice([1, 5, 40]))}
        whole["large"] = {f'k"{k}': value(rng, 2) for k in range(rng.choice([2, 80]) if turn < 3 else 200)}
        whole["list"] = [value(rng, 2) for _ in range(60)]
        path = tmp_path / f"{turn}.json"
        path.write_text(("﻿" if turn == 1 else "") + json.dumps(whole, ensure_ascii=turn % 2 == 0, indent=2 if turn > 1 else None) + "\n" * turn)
        rows = members.read_members(spark, str(path)).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r.at):
            got.setdefault(r.part, []).append(r)
        assert set(got) == set(whole)
        for name, expected in whole.items():
            if not got[name][0].inner:
                assert len(got[name]) == 1 and same(got[name][0].value, expected)
            elif isinstance(expected, dict):
                assert [r.key for r in got[name]] == list(expected) and all(same(r.value, expected[r.key]) for r in got[name])
            else:
                assert len(got[name]) == len(expected) and all(r.key is None and same(r.value, e) for r, e in zip(got[name], expected))
        assert got["list"][0].inner
    assert members.pieces(spark, str(path)).select('block').distinct().count() > 3


def test_edges(spark, tmp_path):
    def read(text):
        path = tmp_path / f"{abs(hash(text))}.json"
        path.write_text(text)
        return flat(members.read_members(spark, str(path)).collect())
    assert read(" { }\n") == []
    assert read('{"a": {}, "n": null}') == [("a", None, "{}"), ("n", None, None)]
    assert read('{"a": {"b": "c"}, "d": 1}') == [("a", None, '{"b":"c"}'), ("d", None, "1")]
    assert read('{"a": {"b": "c", "d": "e"}}') == [("a", "b", "c"), ("a", "d", "e")]
    for bad in ('[1, 2]', '{"a": "b, c}', '{"a" 1, "b": 2}', '{"a": {"b": 1, 2}}'):
        with pytest.raises(Exception, match="Invalid JSON object"):
            read(bad)


def both(spark, path, reader, monkeypatch):
    """Rows by the whole document and by its members."""
    found = []
    for limit in (1 << 40, 0):
        monkeypatch.setattr(landed, "WHOLE_BYTES", limit)
        source = landed.read_object(spark, str(path))
        assert ("document" in source.columns) == (limit > 0)
        made = reader(source)
        found.append([sorted(map(str, df.collect())) for df in (made if isinstance(made, tuple) else (made,))])
    return found


def test_readers_agree_for_both_forms(spark, tmp_path, small_ranges, monkeypatch):
    def put(name, whole):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(whole))
        return path
    keys = [f"{k:08d}X" for k in range(150)]
    for k, whole in enumerate([{"tickers": {f" {c} ": f"t{c},\"" for c in keys}, "n": 1}, {"tickers": None, "abc": "x", "ABC ": "y"},
                               {"tickers": {}}]):
        one, many = both(spark, put(f"map{k}", whole), landed.ticker_map, monkeypatch)
        assert one == many and (k == 2 or one[0])
    caps = put("caps", {"source": "S, T", "market_caps": {f"a{c}": i * 7.9 - 20 for i, c in enumerate(keys)}, "currency": "C"})
    one, many = both(spark, caps, landed.market_caps, monkeypatch)
    assert one == many and len(one[0]) > 100
    one, many = both(spark, caps, lambda d: landed.document_fields(d, "source", "none", "currency"), monkeypatch)
    assert one == many
    one, many = both(spark, put("sectors", {"sectors": {f" {c}": {"sector": f"  A, {c}", "name": "Co  \"{"} for c in keys}}), landed.sectors, monkeypatch)
    assert one == many and len(one[0]) == 150
    record = lambda c: {"ticker": f"T{c}", "source": "s, t"}
    for k, whole in enumerate([{"version": fv.CACHE_VERSION, "records": {c: record(c) for c in keys}, "manual_overrides": {keys[3]: record(keys[3])}, "tickers": {"99999999Z": "q"}},
                               {"mappings": {c: c for c in keys}}]):
        one, many = both(spark, put(f"cache{k}", whole), landed.ticker_cache, monkeypatch)
        assert one == many and one[0]


def test_wrong_shapes_are_errors_in_members_too(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landed, "WHOLE_BYTES", 0)
    for name, whole, reader in (("a", {"market_caps": [1, 2]}, landed.market_caps), ("b", {"market_caps": {"x": "y", "z": 1}}, landed.market_caps),
                                ("c", {"sectors": {"x": 5, "y": {}}}, landed.sectors), ("d", {"tickers": 5}, landed.ticker_map),
                                ("e", {"version": 99, "records": {"x": {}, "y": {}}}, lambda d: landed.ticker_cache(d)[0])):
        (tmp_path / name).write_text(json.dumps(whole))
        with pytest.raises(Exception, match="Invalid"):
            reader(landed.read_object(spark, str(tmp_path / name))).collect()


def test_sorted_object_from_many_tasks(spark, tmp_path, small_ranges):
    rows = spark.range(500).select(F.concat(F.lit('k,"'), F.pmod(F.col("id") * 7919, F.lit(500))).alias("key"), F.struct(F.col("id").alias("n"), F.lit("a,}").alias("t")).alias("value"))
    for part in ("caps", None):
        path = tmp_path / f"object-{part}"
        exports.write_sorted_object(rows.repartition(9), str(path), "key", "value", part)
        files = sorted(path.glob("part-*"))
        text = json.loads("".join(f.read_text() for f in files))
        whole = text[part] if part else text
        assert len(files) > 1 and list(whole) == sorted(whole) and len(whole) == 500
        read = members.read_members(spark, str(path)).collect()
        values = {r.key: r.value for r in read} if part else None
        if part:
            assert {k: json.loads(v) for k, v in values.items()} == whole
        else:
            assert {(r.part, r.key) for r in read} == {(k, name) for k in whole for name in ("n", "t")}
    exports.write_sorted_object(rows.limit(0), str(tmp_path / "none"), "key", "value", "caps")
    assert flat(members.read_members(spark, str(tmp_path / "none")).collect()) == [("caps", None, "{}")]


def test_a_range_is_bounded_whatever_the_reader_takes(spark, tmp_path, monkeypatch):
    """One task puts a range in order, so the range must not grow with the text or with the reader's setting."""
    path, text = tmp_path / "o.json", json.dumps({"sectors": {f"k{i}": {"name": f'a,"{i}'} for i in range(4_000)}})
    path.write_text(text)
    monkeypatch.setattr(members, "RANGE_BYTES", 10_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = members.staged_pieces(spark, str(path))
    sizes = found.groupBy("file", "block").agg(F.sum(F.octet_length("value") + 1).alias("n")).agg(F.count("*"), F.max("n")).first()
    assert sizes[0] >= len(text) // 10_000 and sizes[1] <= 11_000
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert members.read_members(spark, str(path)).filter("part = 'sectors' and inner").count() == 4_000
