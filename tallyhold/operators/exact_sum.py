"""Sums of doubles that do not depend on the order of the rows: exact, and rounded once.

A finite double is three whole numbers (limbs) of BITS bits above one of the bands into which the exponents fall, times a power
of two.  Limbs are added as longs, per group and band, in aggregates that combine map-side; a group has at most some eighty
bands, so what is shuffled stays small.  The bands of a group then become one chain of digits with carries, whose
highest four digits and a mark for the rest are rounded to the nearest double (ties to even) in a single addition.

2 ** 37 rows of a band fit a long.  As with a plain sum, nulls are skipped, a group without values gives NULL, and infinities and
NaN decide a sum that holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26
_BASE = float(1 << BITS)
#: Power of two of the lowest limb of band 0: the smallest positive double.
_LOWEST = -1074


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent)


def _times(name: str, part: str) -> str:
    return f"__{name}_{part}"


def _with_limbs(rows: DataFrame, names: list[str]) -> DataFrame:
    """Band and limbs of each value column; every step is exact, because it scales by powers of two or takes whole parts."""
    def each(make) -> dict[str, Column]:
        return {_times(n, part): c for n in names for part, c in make(lambda p, n=n: F.col(_times(n, p))).items()}

    rows = rows.withColumns(each(lambda c: {
        "size": F.when((F.abs(c("x")) < float("inf")) & (c("x") != 0), F.abs(c("x"))),
        "odd": F.when(F.isnan(c("x")) | (F.abs(c("x")) == float("inf")), c("x"))}))
    rows = rows.withColumns(each(lambda c: {"guess": F.when(c("size").isNotNull(), F.greatest(F.floor((F.log2(c("size")) - _LOWEST) / BITS).cast("int"), F.lit(2)))}))
    rows = rows.withColumns(each(lambda c: {"near": _power(c("guess") * BITS + _LOWEST)}))
    # The logarithm may round over a border.
    low, high = lambda c: (c("size") < c("near")) & (c("guess") > 2), lambda c: c("size") >= c("near") * _BASE
    rows = rows.withColumns(each(lambda c: {
        "band": F.when(low(c), c("guess") - 1).when(high(c), c("guess") + 1).otherwise(c("guess")),
        "unit": F.when(low(c), c("near") / _BASE).when(high(c), c("near") * _BASE).otherwise(c("near"))}))
    rows = rows.withColumns(each(lambda c: {"limb2": F.floor(c("size") / c("unit"))}))
    rows = rows.withColumns(each(lambda c: {"rest2": c("size") - c("limb2") * c("unit"), "unit1": c("unit") / _BASE}))
    rows = rows.withColumns(each(lambda c: {"limb1": F.floor(c("rest2") / c("unit1"))}))
    rows = rows.withColumns(each(lambda c: {"limb0": F.floor((c("rest2") - c("limb1") * c("unit1")) / (c("unit1") / _BASE))}))
    signed = lambda c, part: F.when(c("x") < 0, -c(part)).otherwise(c(part))
    return rows.withColumns(each(lambda c: {part: signed(c, part) for part in ("limb2", "limb1", "limb0")}))


def _with_rounded(grouped: DataFrame, names: list[str]) -> DataFrame:
    """With the double nearest to the sum of each name's (band, limb2, limb1, limb0) entries.

    Each step is a column of its own, since a step used several times inside one expression would be worked out each time.
    """
    def each(make) -> dict[str, Column]:
        return {_times(n, part): c for n in names for part, c in make(lambda p, n=n: F.col(_times(n, p))).items()}

    nothing = F.lit(0).cast("long")

    def total(entries: Column, j: Column) -> Column:
        return F.aggregate(entries, nothing, lambda t, e: t + F.when(e["band"] == j, e["limb2"]).when(e["band"] - 1 == j, e["limb1"])
                           .when(e["band"] - 2 == j, e["limb0"]).otherwise(nothing))

    def chained(of: Column) -> Column:
        start = F.struct(nothing.alias("carry"), F.array().cast("array<bigint>").alias("digits"))
        return F.aggregate(of, start, lambda s, t: F.struct(
            F.shiftright(t + s["carry"], BITS).alias("carry"),
            F.concat(s["digits"], F.array((t + s["carry"]).bitwiseAND(F.lit((1 << BITS) - 1)))).alias("digits")))

    def nearest(c) -> Column:
        digit = lambda down: F.when(c("top") >= down, F.get(c("digits"), c("top") - down)).otherwise(nothing)
        more = F.coalesce(F.array_max(F.transform(c("digits"), lambda d, i: F.when((d != 0) & (i < c("top") - 3), 1))), F.lit(0))
        high = digit(0) * (1 << BITS) + digit(1)
        low = (digit(2) * (1 << BITS) + digit(3)).bitwiseOR(more.cast("long"))
        value = high.cast("double") * (_BASE * _BASE) + low.cast("double")  # the one rounding
        return F.when(c("top").isNull(), 0.0).otherwise(value / (_BASE * _BASE * _BASE) * _power((c("lowest") + c("top")) * BITS + _LOWEST))

    bands = lambda c: F.transform(c("entries"), lambda e: e["band"])
    grouped = grouped.withColumns(each(lambda c: {"lowest": F.array_min(bands(c)) - 2, "highest": F.array_max(bands(c)) + 3}))
    grouped = grouped.withColumns(each(lambda c: {
        "totals": F.transform(F.sequence(c("lowest"), c("highest")), lambda j: total(c("entries"), j))}))
    grouped = grouped.withColumns(each(lambda c: {"chain": chained(c("totals"))}))
    grouped = grouped.withColumns(each(lambda c: {"negative": c("chain")["carry"] < 0}))
    grouped = grouped.withColumns(each(lambda c: {"digits": F.when(
        c("negative"), chained(F.transform(c("totals"), lambda t: -t))["digits"]).otherwise(c("chain")["digits"])}))
    grouped = grouped.withColumns(each(lambda c: {"top": F.array_max(F.transform(c("digits"), lambda d, i: F.when(d != 0, i)))}))
    grouped = grouped.withColumns(each(lambda c: {"nearest": nearest(c)}))
    return grouped.withColumns(each(lambda c: {"rounded": F.when(F.size(c("entries")) == 0, 0.0).otherwise(
        F.when(c("negative"), -c("nearest")).otherwise(c("nearest")))}))


def exact_sums(rows: DataFrame, keys: list[str], values: dict[str, Column], counts: dict[str, Column] | None = None,
               least: dict[str, Column] | None = None) -> DataFrame:
    """Per group: the exact sum of each value, together with further aggregates over the same rows.

    ``counts`` are aggregates that add up over parts of a group (counts, sums of whole numbers), ``least`` columns whose minimum is taken.
    """
    names, counts, least = list(values), counts or {}, least or {}
    typed = rows.withColumns({_times(n, "x"): c.cast("double") for n, c in values.items()})
    limbs = _with_limbs(typed, names)
    parts = [F.sum(_times(n, part)).alias(_times(n, part)) for n in names for part in ("limb2", "limb1", "limb0", "odd")]
    there = [F.count(_times(n, "x")).alias(_times(n, "there")) for n in names]
    banded = limbs.groupBy(*keys, *[_times(n, "band") for n in names]).agg(
        *parts, *there, *[c.alias(n) for n, c in counts.items()], *[F.min(c).alias(n) for n, c in least.items()])
    entry = lambda n: F.when(F.col(_times(n, "band")).isNotNull(), F.struct(  # noqa: E731  a null leaves no entry
        F.col(_times(n, "band")).alias("band"), *[F.col(_times(n, part)).alias(part) for part in ("limb2", "limb1", "limb0")]))
    grouped = banded.groupBy(*keys).agg(
        *[F.collect_list(entry(n)).alias(_times(n, "entries")) for n in names], *[F.sum(_times(n, "odd")).alias(_times(n, "odd")) for n in names],
        *[F.sum(_times(n, "there")).alias(_times(n, "there")) for n in names],
        *[F.sum(n).alias(n) for n in counts], *[F.min(n).alias(n) for n in least])
    total = lambda n: F.when(F.col(_times(n, "there")) > 0, F.coalesce(_times(n, "odd"), _times(n, "rounded"))).alias(n)
    return _with_rounded(grouped, names).select(*keys, *[total(n) for n in names], *counts, *least)
