"""Dates, times and both in text, and the labels of date bins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accepted orders of fields, tried from the top (fixed values); single letters also take padded fields.
DATETIME_FORMATS = ("yyyy-M-d H:mm:ss", "yyyy-M-d H:mm", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy.M.d H:mm:ss", "yyyy.M.d H:mm", "yyyy'년' M'월' d'일' H:mm:ss", "yyyy'년' M'월' d'일' H:mm")
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyy. MM. dd", "yyyy-M", "yyyy/M", "yyyy.M", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "yyyy'년' M'월' d'일'")
#: Words that make a header look like a date's (fixed values).
DATE_TOKENS = frozenset(("date", "datetime", "time", "timestamp", "dt", "dob"))
DATE_SUBSTRINGS = ("날짜", "일자", "일시", "생년", "년월", "월일")
PERIODS = ("day", "week", "month", "year")
COMPACT_YEARS = (1900, 2100)

_TIME = r"^[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?$"
_FIELD = {"yyyy": "[0-9]{4}", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}", "M": "[0-9]{1,2}", "d": "[0-9]{1,2}", "H": "[0-9]{1,2}"}


def _shape(pattern: str) -> str:
    """Regular expression of the texts that a format may accept."""
    parts = re.findall(r"'[^']*'|yyyy|MM|dd|mm|ss|M|d|H|.", pattern)
    return "^" + "".join(_FIELD.get(p) or (p.strip("'") if p[0] == "'" else re.escape(p).replace("/", "[/]")) for p in parts) + "$"


def _try(t: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(t.rlike(_shape(f)), F.try_to_timestamp(t, F.lit(f))) for f in formats])


def _looks_like_date(t: Column, compact: bool) -> Column:
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    marked = (digits >= 5) & t.rlike(r"[-/.: TZ+년월일]")
    return marked | t.rlike(r"^(?:[0-9]{8}|[0-9]{14})$") if compact else marked


def parse(c: Column, compact: bool = True) -> Column:
    """Struct of ``at`` (timestamp) and ``kind`` ('date', 'datetime', 'time') of a text; nulls where it is none of them.

    A time alone is on 1970-01-01. Times with an offset are in UTC. Texts of 8 or 14 digits count, if ``compact``,
    from year 1900 to 2100. Month-first comes before day-first.
    """
    t = F.trim(F.coalesce(c, F.lit("")))
    clock = F.when(t.rlike(_TIME), F.coalesce(F.try_to_timestamp(t, F.lit("H:mm:ss")), F.try_to_timestamp(t, F.lit("H:mm"))))
    dated = _looks_like_date(t, compact)
    iso = F.when(dated & (t.contains("T") | t.endswith("Z")) & t.rlike(r"^[0-9]{4}-"), F.try_to_timestamp(t))
    both = F.when(dated, _try(t, DATETIME_FORMATS))
    day = F.when(dated, _try(t, DATE_FORMATS))
    found = [(clock, "time"), (iso, "datetime"), (both, "datetime"), (day, "date")]
    if compact:
        for size, f, kind in ((14, "yyyyMMddHHmmss", "datetime"), (8, "yyyyMMdd", "date")):
            at = F.when(t.rlike(f"^[0-9]{{{size}}}$"), F.try_to_timestamp(t, F.lit(f)))
            found.append((F.when(F.year(at).between(*COMPACT_YEARS), at), kind))
    # all of them begin with a figure
    able = t.rlike("^[0-9]")
    return F.struct(F.when(able, F.coalesce(*[at for at, _ in found])).alias("at"), F.when(able, F.coalesce(*[F.when(at.isNotNull(), F.lit(kind)) for at, kind in found])).alias("kind"))


def moment(c: Column, kind: T.DataType | None = None) -> Column:
    """Timestamp of a cell: temporal columns as they are, text parsed; times alone and other text are null."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz")
    found = parse(c.cast("string"))
    return F.when(found["kind"] != "time", found["at"]).cast("timestamp_ntz")


def seconds_of_day(c: Column, kind: T.DataType | None = None) -> Column:
    """Seconds since midnight, with fractions, of a cell with a time (or with a date: 0)."""
    at = c.cast("timestamp_ntz") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else parse(c.cast("string"))["at"].cast("timestamp_ntz")
    return F.hour(at) * 3600 + F.minute(at) * 60 + F.extract(F.lit("SECOND"), at).cast("double")


def label(at: Column, period: str) -> Column:
    """yyyy-MM-dd, ISO yyyy-Www, yyyy-MM or yyyy."""
    if period == "week":
        return F.when(at.isNotNull(), F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), at).cast("int"), F.weekofyear(at)))
    return F.date_format(at, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[period])


def header_suggests_date(name: str) -> bool:
    tokens = {t for t in re.split(r"[^0-9a-z]+", name.lower()) if t}
    return bool(tokens & DATE_TOKENS) or any(s in name for s in DATE_SUBSTRINGS)
