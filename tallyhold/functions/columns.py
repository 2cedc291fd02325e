"""Typed projections and normalisation as column expressions.

Parsers come in pairs: ``x(c)`` gives the typed value or NULL, ``bad_x(c)`` flags text the value rule
rejects (so jobs can count rejects, or fail, instead of silently losing rows).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhold import fixed_values as fv

# Unicode white space plus the four ASCII separators that Python also strips.
_SPACE_CHARACTERS = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
                     "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_SPACE = "[" + _SPACE_CHARACTERS + "]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(_SPACE_CHARACTERS))


def collapse_spaces(c: Column | str) -> Column:
    return strip(F.regexp_replace(c, f"{_SPACE}+", " "))


def has_control_character(c: Column) -> Column:
    return c.rlike(r"[\x00-\x1f]")


def fold_ascii(c: Column) -> Column:
    """Case-insensitive key that folds A-Z only, so accented letters stay distinct."""
    return F.translate(c, _UPPER, _UPPER.lower())


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


# ---- dates and numbers ------------------------------------------------------------------------

def filing_date(c: Column) -> Column:
    """``30-JUN-2025`` to a date; NULL when the text is not such a date."""
    return F.try_to_date(F.initcap(c), "d-MMM-yyyy")


def date_label(c: Column) -> Column:
    return F.upper(F.date_format(c, "dd-MMM-yyyy"))


def whole_number(c: Column) -> Column:
    """Non-negative integer written any decimal way (``10``, ``10.0``, ``1e3``); NULL when blank or invalid.

    Plain digits, also with zeros behind the point, take a cheap cast.  Other spellings are cut into sign, digits, and
    power once; the significant digits and their power of ten decide, so a fraction counts however far behind the point it stands.
    """
    text = strip(c)
    form = r"^([+-]?)(?=\.?[0-9])([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]{1,9}))?$"
    cut = F.split(F.regexp_replace(text, form, "$1|$2|$3|$4"), "[|]", 4)
    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)  # noqa: E731  a lambda's argument is computed once

    def scaled(d: Column) -> Column:
        size = F.length(d["kept"]) + d["exponent"]
        value = F.rpad(d["kept"], F.least(size, F.lit(20)).cast("int"), F.lit("0")).try_cast(T.DecimalType(20, 0))
        written = (F.when(d["kept"] == "", F.lit(0).cast(T.DecimalType(20, 0)))
                   .when((d["sign"] != "-") & (d["exponent"] >= 0) & (size <= 19), value))
        return F.when(written <= F.lit(fv.MAX_WHOLE_NUMBER), written.cast("long"))

    def trimmed(d: Column) -> Column:
        kept = F.rtrim(d["digits"], F.lit("0"))
        exponent = F.coalesce(d["power"].try_cast("bigint"), F.lit(0)) - d["behind"] + F.length(d["digits"]) - F.length(kept)
        return F.struct(d["sign"].alias("sign"), kept.alias("kept"), exponent.alias("exponent"))

    def parts(p: Column) -> Column:
        return F.struct(p[0].alias("sign"), F.ltrim(F.concat(p[1], p[2]), F.lit("0")).alias("digits"), F.length(p[2]).alias("behind"), p[3].alias("power"))

    return (F.when(text.rlike(r"^[0-9]{1,18}(\.0*)?$"), F.substring_index(text, ".", 1).try_cast("bigint"))
            .when(text.rlike(form), once(once(once(cut, parts), trimmed), scaled)))


def bad_whole_number(c: Column) -> Column:
    return ~is_blank(c) & whole_number(c).isNull()


def finite_number(c: Column) -> Column:
    """Finite non-negative double; NULL when blank or invalid."""
    value = strip(c).try_cast("double")
    return F.when(~F.isnan(value) & (value < F.lit(float("inf"))) & (value >= 0), value)


def bad_finite_number(c: Column) -> Column:
    return ~is_blank(c) & finite_number(c).isNull()


def manager_key(c: Column) -> Column:
    """Manager number padded to ten digits; NULL when it is not one to ten digits."""
    trimmed = strip(c)
    return F.when(trimmed.rlike("^[0-9]{1,10}$"), F.lpad(trimmed, 10, "0"))


def closing_price(c: Column) -> Column:
    """``$1,234.50`` to a positive finite double, else NULL."""
    value = strip(F.regexp_replace(c, "[$,]", "")).try_cast("double")
    return F.when(~F.isnan(value) & (value < F.lit(float("inf"))) & (value > 0), value)


def market_value(c: Column) -> Column:
    """Market capitalisation text to a positive long, rounded half to even; NULL when unusable."""
    value = strip(F.regexp_replace(c.cast("string"), ",", "")).try_cast("double")
    usable = ~F.isnan(value) & (value < F.lit(float("inf"))) & (value > 0)
    return F.when(usable, F.bround(value, 0).cast("long"))


def percent_change(current: Column, base: Column) -> Column:
    return F.when(base > 0, F.round(100.0 * (current / base - 1.0), 4))


def nearest_split_factor(ratio: Column) -> Column:
    """The known split factor within tolerance of the ratio, or NULL.

    Neighbouring factors are at least a quarter apart and the tolerance is eight percent, so at most one
    factor fits and it is the nearest one; a plain chain of comparisons stays in generated code.
    """
    chosen = F.lit(None).cast("double")
    for factor in fv.SPLIT_FACTORS:
        chosen = F.when(F.abs(ratio / F.lit(factor) - 1.0) <= fv.SPLIT_TOLERANCE, F.lit(factor)).otherwise(chosen)
    return F.when(~F.isnan(ratio), chosen)


def completed_market_date(moment: Column) -> Column:
    """Latest finished trading day for a UTC timestamp: 17:00 New York cut-off, weekends skipped."""
    eastern = F.from_utc_timestamp(moment, "America/New_York")
    day = F.when(F.hour(eastern) < 17, F.date_sub(F.to_date(eastern), 1)).otherwise(F.to_date(eastern))
    weekday = F.dayofweek(day)  # 1 = Sunday, 7 = Saturday
    return F.when(weekday == 7, F.date_sub(day, 1)).when(weekday == 1, F.date_sub(day, 2)).otherwise(day)


# ---- identifiers and names --------------------------------------------------------------------

def security_key(c: Column) -> Column:
    return F.upper(strip(F.coalesce(c, F.lit(""))))


def is_valid_security_key(c: Column) -> Column:
    return c.rlike(fv.CUSIP_PATTERN) & (F.length(c) == 9)  # "$" alone would accept a trailing newline


def _unicode_form(form: str):
    @F.pandas_udf(T.StringType())
    def normalise(values: pd.Series) -> pd.Series:
        return values.map(lambda text: None if text is None else unicodedata.normalize(form, text))
    return normalise


def _normalised(c: Column, form: str) -> Column:
    """Unicode normal form; plain ASCII text bypasses Python (the UDF is handed NULL for it)."""
    ascii_only = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only, c).otherwise(_unicode_form(form)(F.when(~ascii_only, c)))


def ticker_key(c: Column) -> Column:
    """Canonical ticker, or '' when blank, over-long, or holding control characters."""
    text = F.upper(strip(_normalised(F.coalesce(c, F.lit("")), "NFKC")))
    text = F.regexp_replace(text, f"{_SPACE}+", " ")
    return F.when((F.length(text) > fv.MAX_SYMBOL_LENGTH) | has_control_character(text), "").otherwise(text)


def plain_ticker(c: Column) -> Column:
    return F.upper(strip(F.coalesce(c, F.lit(""))))


def issuer_key(c: Column) -> Column:
    """Name key for matching: accents and punctuation dropped, meaningful words kept."""
    text = F.upper(_normalised(F.coalesce(c, F.lit("")), "NFKD"))
    text = F.regexp_replace(text, r"\p{M}", "")
    text = F.replace(text, F.lit("&"), F.lit(" AND "))
    return F.trim(F.regexp_replace(text, "[^A-Z0-9]+", " "))


def screener_symbol(c: Column) -> Column:
    symbol = F.upper(strip(F.coalesce(c, F.lit(""))))
    return F.when((F.length(symbol) > fv.MAX_SYMBOL_LENGTH) | has_control_character(symbol), "").otherwise(symbol)


def quote_symbol(c: Column) -> Column:
    """Class shares are written with a dot by the quote route and with a slash everywhere else."""
    return F.replace(c, F.lit("/"), F.lit("."))


def display_name(c: Column) -> Column:
    """Company name without one trailing ratio note and one trailing share-class suffix."""
    original = F.coalesce(c, F.lit(""))
    kept = F.coalesce(F.nullif(collapse_spaces(original), F.lit("")), original)
    cleaned = collapse_spaces(F.regexp_replace(F.regexp_replace(original, fv.RATIO_NOTE_PATTERN, ""), fv.SHARE_CLASS_PATTERN, ""))
    return F.when(F.contains(F.lower(original), F.lit("preferred")) | (cleaned == ""), kept).otherwise(cleaned)
