import math
import random

import pytest
from pyspark.sql import functions as F

from tallyhold.operators import exact_sum, rollups, signals

KINDS = "k int, x double, n int"


def wide(rng, k):
    """Doubles of very different sizes, with exact cancellation."""
    spread = rng.choice([1, 20, 300, 1000])
    rows = [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randint(-spread, min(spread, 1000)) for _ in range(rng.randint(1, 60))]
    return rows + [-x for x in rows[::3]] + [5e-324] * rng.randint(0, 3)


CASES = {1: [1e16, 1.0, -1e16], 2: [0.1] * 10, 3: [2.0 ** 53, 1.0], 4: [2.0 ** 53, 1.0, 2.0 ** -1000], 5: [0.0, -0.0], 6: [None], 7: [None, -3.5], 8: [5e-324, 5e-324],
         9: [1.7e308, -1.7e308, 2.0], 10: [-(2.0 ** 53), -3.0], 11: [1.0, -1.0], 12: [2.2250738585072014e-308, -5e-324], 13: [3.5, 4.5, -8.0, 2.0 ** -26, 2.0 ** 26]}


def test_like_exact_arithmetic(spark):
    rng = random.Random(6)
    groups = CASES | {k: wide(rng, k) for k in range(20, 120)}
    rows = [(k, x, 1) for k, xs in groups.items() for x in xs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, KINDS)
    for partitions in (1, 7, 200):
        got = exact_sum.exact_sums(df.repartition(partitions), ["k"], {"total": F.col("x")}, {"rows": F.count("*")}, {"least": F.col("n")}).collect()
        assert len(got) == len(groups)
        for r in got:
            xs = [x for x in groups[r.k] if x is not None]
            assert r.total == (math.fsum(xs) if xs else None), (r.k, xs)
            assert r.rows == len(groups[r.k]) and r.least == 1


def test_values_that_are_not_finite(spark):
    inf = math.inf
    df = spark.createDataFrame([(1, inf, 1), (1, 2.0, 1), (2, inf, 1), (2, -inf, 1), (3, math.nan, 1), (3, 1.0, 1), (4, 1.7e308, 1), (4, 1.7e308, 1), (5, -inf, 1), (5, None, 1)], KINDS)
    got = {r.k: r.total for r in exact_sum.exact_sums(df, ["k"], {"total": F.col("x")}).collect()}
    assert got[1] == inf and math.isnan(got[2]) and math.isnan(got[3]) and got[4] == inf and got[5] == -inf


def test_several_values_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, 0.1, 3), (1, 0.2, 2), (2, 0.7, 9)], KINDS)
    got = exact_sum.exact_sums(df, ["k"], {"a": F.col("x"), "b": F.col("x") * F.col("x") * 1e200}).orderBy("k").collect()
    assert [(r.a, r.b) for r in got] == [(math.fsum([0.1, 0.2]), math.fsum([0.1 * 0.1 * 1e200, 0.2 * 0.2 * 1e200])), (0.7, 0.7 * 0.7 * 1e200)]
    assert exact_sum.exact_sums(df.limit(0), ["k"], {"a": F.col("x")}).count() == 0


def test_partial_sums_before_the_shuffle(spark):
    plan = exact_sum.exact_sums(spark.range(10).select((F.col("id") % 2).alias("k"), F.rand(1).alias("x")), ["k"], {"s": F.col("x")})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and text.count("partial_sum") >= 4


@pytest.mark.parametrize("name", ["weights", "scores"])
def test_bits_do_not_depend_on_partitions(spark, name):
    from tallyhold.sources.warehouse import MARK_DATE
    import catalog
    import datetime as dt
    folder, seen = "/root/testdata/sf0.001", set()
    b = catalog.book(spark, folder)
    events = None
    for n in (1, 7, 200):
        if name == "weights":
            made = rollups.security_weight_stats(b.wide_positions.repartition(n), b.dashboard_period_stats).select("period", "cusip", "weight_sum", "avg_weight")
        else:
            events = events or catalog.signal_tables(spark, folder)["priced_events"]
            made = signals.manager_scores(b.context, events.repartition(n), dt.date.fromisoformat(MARK_DATE)).select("cik", "period", "raw_signal_return", "raw_signal_pnl", "gross_notional", "effective_bets")
        seen.add(tuple(sorted(map(str, made.collect()))))
    assert len(seen) == 1


def test_each_step_is_worked_out_once(spark):
    """A chain of digits inside every expression that uses it made a group cost a millisecond."""
    rows = spark.range(10).select((F.col("id") % 2).alias("k"), F.rand(1).alias("x"))
    text = exact_sum.exact_sums(rows, ["k"], {"s": F.col("x")})._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= text.count("aggregate(") <= 3
