"""Report text for ranked rows: short sector, tidy name, formatted metric, price, change, quote link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhold import fixed_values as fv
from tallyhold.functions.columns import strip

DASH = "—"
MINUS = "−"


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(item) for pair in table.items() for item in pair])


def fixed_digits(value: Column, digits: int) -> Column:
    """Magnitude with ``digits`` decimals and thousands separators; exact halves round away from zero.

    ``format_number`` already rounds by the exact binary value but sends exact halves to the even
    digit, so those (and only those) are nudged up first.  Scaling by a power of two is exact.
    """
    magnitude = F.abs(value)
    scaled = magnitude * float(2 ** (digits + 1))
    half = (scaled == F.floor(scaled)) & (scaled * float(5 ** digits) % 2 == 1)
    return F.format_number(F.when(half, magnitude + 10.0 ** -(digits + 3)).otherwise(magnitude), digits)


def _plain_digits(value: Column, digits: int) -> Column:
    return F.replace(fixed_digits(value, digits), F.lit(","), F.lit(""))


def _share_digits(value: Column) -> Column:
    return F.when(F.abs(value) >= 1, _plain_digits(value, 1)).otherwise(_plain_digits(value, 2))


def weight_text(value: Column) -> Column:
    signed = F.concat(F.when(value < 0, "-").otherwise(""), _share_digits(value), F.lit("%"))
    return F.when(value.isNull(), DASH).otherwise(signed)


def new_holder_text(value: Column) -> Column:
    return F.when(value.isNull(), DASH).otherwise(F.concat(F.format_number(value, 0), F.lit(" new")))


def weight_change_text(value: Column, direction: Column) -> Column:
    falling = (direction == "down") | ((direction != "up") & (value < 0))
    text = F.concat(F.when(falling, MINUS).otherwise("+"), _share_digits(value), F.lit("pp"))
    return F.when(value.isNull(), DASH).otherwise(text)


def metric_text(view: str, value: Column, direction: Column) -> Column:
    if view == "initiations":
        return new_holder_text(value)
    if view == "movers":
        return weight_change_text(value, direction)
    return weight_text(value)


def price_text(value: Column) -> Column:
    signed = F.concat(F.lit("$"), F.when(value < 0, "-").otherwise(""), fixed_digits(value, 2))
    return F.when(value.isNull(), DASH).otherwise(signed)


def change_text(value: Column) -> Column:
    """Percent with one decimal; the sign follows the printed digits, so -0.04 prints as plain 0.0%."""
    digits = _plain_digits(value, 1)
    sign = F.when(digits == "0.0", "").when(value > 0, "+").otherwise(MINUS)
    return F.when(value.isNull(), DASH).otherwise(F.concat(sign, digits, F.lit("%")))


def sector_abbreviation(sector: Column) -> Column:
    text = strip(F.coalesce(sector, F.lit("")))
    short = F.coalesce(_lookup(fv.SECTOR_ABBREVIATIONS)[text], F.substring(text, 1, 4))
    return F.when(text == "", DASH).otherwise(short)


def _capitalised_runs(token: Column) -> Column:
    pieces = F.regexp_extract_all(F.lower(token), F.lit("([a-z][a-z']*|[^a-z])"), F.lit(1))
    raised = F.transform(pieces, lambda piece: F.when(
        piece.rlike("^[a-z]"),
        F.concat(F.upper(F.substring(piece, 1, 1)), piece.substr(F.lit(2), F.length(piece))),
    ).otherwise(piece))
    return F.array_join(raised, "")


def _title_token(token: Column) -> Column:
    shape = "^([^A-Za-z]*)([A-Za-z]+)([^A-Za-z]*)$"
    known = _lookup(fv.NAME_TOKENS)[F.upper(F.regexp_extract(token, shape, 2))]
    fixed = F.concat(F.regexp_extract(token, shape, 1), known, F.regexp_extract(token, shape, 3))
    return F.when(token == "&", token).otherwise(F.coalesce(fixed, _capitalised_runs(token)))


def tidy_name(name: Column, issuer: Column) -> Column:
    """All-capital names in title case with fixed abbreviations; mixed-case names stay as they are."""
    raw = strip(F.coalesce(F.nullif(name, F.lit("")), issuer, F.lit("")))
    titled = F.array_join(F.transform(F.split(raw, r"(?U)\s+"), _title_token), " ")
    return F.when(raw == "", DASH).when(raw.rlike("[a-z]"), raw).otherwise(titled)


def quote_url(ticker: Column) -> Column:
    encoded = F.url_encode(F.replace(ticker, F.lit("/"), F.lit("-")))
    # Form encoding escapes a few characters that URI components keep, and writes blanks as "+".
    for escaped, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(escaped), F.lit(plain))
    return F.when(ticker == "", "").otherwise(F.concat(F.lit(fv.QUOTE_URL_PREFIX), encoded))


def report_rows(view: str, ranked: DataFrame) -> DataFrame:
    """Printable columns for the rows of a ranked view."""
    return ranked.select(
        "cusip", "ticker",
        tidy_name(F.col("name"), F.col("issuer")).alias("display_name"),
        sector_abbreviation(F.col("sector")).alias("sector_short"),
        "direction", "holders",
        metric_text(view, F.col("metric"), F.col("direction")).alias("metric_text"),
        price_text(F.col("price")).alias("price_text"),
        change_text(F.col("day_change")).alias("day_text"),
        change_text(F.col("ytd_change")).alias("ytd_text"),
        quote_url(F.col("ticker")).alias("quote_url"),
    )
