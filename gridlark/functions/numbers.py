"""Numbers in text: plain, with a currency symbol, with a percent sign; and how such numbers are shown."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Currency symbols that may lead or trail a number (fixed values).
CURRENCY = "₩$¥￥元€£"
_BODY = r"(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_PLAIN = rf"^(?:[+-]?{_BODY}|{_BODY}[+-]|\(\s*{_BODY}\s*\))$"


def text(c: Column) -> Column:
    """The cell as text; a missing cell is the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def plain(c: Column) -> Column:
    """Number of a text with sign before or after, thousands commas, exponent or parentheses for negative; else null.

    Words such as NaN or Infinity, suffixes such as 1d and hexadecimal are no numbers.
    """
    t = F.trim(c)
    size = F.regexp_replace(F.regexp_extract(t, _BODY, 0), ",", "").try_cast("double")
    negative = t.startswith("-") | t.startswith("(") | t.endswith("-")
    return F.when(t.rlike(_PLAIN), F.when(negative, -size).otherwise(size))


def plain_value(t: str) -> float | None:
    """What ``plain`` makes of a text, for constants."""
    t = t.strip(" ")
    if not re.fullmatch(_PLAIN[1:-1], t, re.A):
        return None
    size = float(re.search(_BODY, t).group().replace(",", ""))
    return -size if t[0] in "-(" or t[-1] == "-" else size


def currency(c: Column, symbol_needed: bool = False) -> Column:
    """Number with one currency symbol before or after it, or without unless one is needed."""
    t = F.trim(c)
    leads, trails = t.rlike(f"^[{CURRENCY}]"), t.rlike(f"[{CURRENCY}]$")
    rest = F.when(leads, F.substr(t, F.lit(2))).when(trails, F.left(t, F.length(t) - 1)).otherwise(t)
    found = plain(F.replace(F.trim(rest), F.lit(","), F.lit("")))
    return F.when(leads | trails, found) if symbol_needed else found


def percent(c: Column, sign_needed: bool = False) -> Column:
    """Number before a percent sign, as written (5% is 5)."""
    t = F.trim(c)
    signed = t.endswith("%")
    found = plain(F.replace(F.trim(F.when(signed, F.left(t, F.length(t) - 1)).otherwise(t)), F.lit(","), F.lit("")))
    return F.when(signed, found) if sign_needed else found


def any_number(c: Column) -> Column:
    """Plain, else with currency symbol, else with percent sign."""
    return F.coalesce(plain(c), currency(c, True), percent(c, True))


def number(c: Column, kind: T.DataType | None = None, affix: bool = False) -> Column:
    """A cell's number: numeric columns as they are, without NaN; text is parsed, with affixes on request."""
    if isinstance(kind, T.NumericType):
        v = c.cast("double")
        return F.when(~F.isnan(v), v)
    return (any_number if affix else plain)(text(c))


def trimmed_decimal(v: Column, places: int = 16) -> Column:
    """Digits without trailing zeros, at most ``places`` after the point, without thousands separators."""
    s = F.format_number(v, places)
    s = F.regexp_replace(F.replace(s, F.lit(","), F.lit("")), r"(\.[0-9]*?)0+$", "$1")
    return F.regexp_replace(s, r"\.$", "")


def grouped_decimal(v: Column, places: int = 3) -> Column:
    """Thousands separators, at most ``places`` digits after the point and no trailing zeros."""
    s = F.regexp_replace(F.format_number(v, places), r"(\.[0-9]*?)0+$", "$1")
    return F.regexp_replace(s, r"\.$", "")


def show_currency(raw: Column, symbol: str | None) -> Column:
    """Symbol and thousands separators before a bare number; anything else stays."""
    if symbol is None:
        return raw
    v = plain(raw)
    return F.when(v.isNull(), raw).when(v < 0, F.concat(F.lit(symbol + "-"), grouped_decimal(-v, 10))).otherwise(F.concat(F.lit(symbol), grouped_decimal(v, 10)))


def show_percent(raw: Column, fraction: bool = False) -> Column:
    """A percent sign after a bare number, times 100 if it is a fraction; anything else stays."""
    v = plain(raw)
    shown = F.round(v * 100, 10) if fraction else v
    return F.when(F.rtrim(raw).endswith("%") | v.isNull(), raw).otherwise(F.concat(trimmed_decimal(shown, 10), F.lit("%")))
