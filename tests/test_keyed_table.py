import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tallyhold.operators import prices
from tallyhold.sources import keyed


def bars(spark, rows):
    return spark.createDataFrame([(s, dt.date.fromisoformat(d), c) for s, d, c in rows], "symbol string, price_date date, close double")


def stamps(spark, path):
    return {r.file: os.stat(r.file.removeprefix("file://").replace("%3D", "=")).st_mtime_ns for r in keyed.files(spark, path).collect()}


@pytest.fixture(scope="module")
def year(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(0, 366, 3)]
    return bars(spark, [(f"S{k:02d}", str(day), 1.0 + k + day.day) for k in range(20) for day in days])


def rows_of(df):
    return sorted(tuple(r) for r in df.select("symbol", "price_date", "close").collect())


@pytest.mark.parametrize("fresh,months", [
    ([("s03", "2024-05-03", 9.0), ("s03", "2024-05-04", 8.0), ("NEW", "2024-05-05", 7.0)], {"2024-05"}),
    ([("S01", "2025-01-02", 5.0)], set()),
    ([("S01", "2024-12-29", 5.0), ("S01", "2024-12-30", 5.5), ("S02", "2024-02-10", 6.0)], {"2024-12", "2024-02"}),
    ([], set())])
def test_an_upsert_is_the_full_merge_and_leaves_other_files(spark, year, tmp_path, fresh, months):
    first, second = str(tmp_path / "1"), str(tmp_path / "2")
    prices.write_bars(None, year, first)
    before, new = stamps(spark, first), bars(spark, fresh)
    prices.write_bars(first, new, second)
    got, usable = prices.load_bars(spark, second)
    assert usable and rows_of(got) == rows_of(prices.merge_bars(year, new))
    assert rows_of(prices.load_bars(spark, first)[0]) == rows_of(year)  # the old version still is what it was
    after, cluster = stamps(spark, second), {r.file: r.cluster for r in keyed.files(spark, first).collect()}
    assert {cluster[f] for f in before if f not in after} == months
    assert all(after[f] == t for f, t in before.items() if f in after)


def test_an_unfinished_version_is_not_read(spark, year, tmp_path):
    path = str(tmp_path / "1")
    prices.write_bars(None, year, path)
    os.remove(f"{path}/files/_SUCCESS")
    assert not keyed.is_keyed(spark, path) and not prices.load_bars(spark, path)[1]


def test_an_empty_table(spark, tmp_path):
    nothing = bars(spark, [])
    prices.write_bars(None, nothing, str(tmp_path / "1"))
    assert prices.load_bars(spark, str(tmp_path / "1"))[0].count() == 0
    prices.write_bars(str(tmp_path / "1"), bars(spark, [("A", "2024-01-02", 1.0)]), str(tmp_path / "2"))
    assert rows_of(prices.load_bars(spark, str(tmp_path / "2"))[0]) == [("A", dt.date(2024, 1, 2), 1.0)]
