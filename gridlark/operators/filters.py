"""Column filters as data: at most one kind per column, each of which becomes one Column condition."""

from __future__ import annotations

import datetime
import math
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers, temporal, texts

#: Gives the column of an ordinal and its type.
Cells = Callable[[int], tuple[Column, T.DataType]]
FEW_VALUES = 12

# Conditions are null where a cell is missing, which a filter takes for false; so plain comparisons of typed columns
# with constants stay visible to the optimizer and reach the scan.


def is_one_of(cell: Column, kind: T.DataType, values: list[str]) -> Column:
    """The cell's text is one of the values."""
    if isinstance(kind, T.StringType):
        return cell.isin(*values) if values else F.lit(False)
    if isinstance(kind, T.IntegralType):
        written = [int(v) for v in values if re.fullmatch("0|-?[1-9][0-9]{0,17}", v)]
        return cell.isin(*written) if written else F.lit(False)
    return numbers.text(cell).isin(*values) if values else F.lit(False)


_COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def compared(cell: Column, kind: T.DataType, op: str, value: float) -> Column | None:
    """A whole or double column against a number; None for other columns, or numbers that a whole column's type may not hold."""
    if isinstance(kind, T.DoubleType) and math.isfinite(value):
        return _COMPARE[op](cell, F.lit(float(value)))
    if isinstance(kind, T.IntegralType) and abs(value) < 2**31 - 1:
        # the whole numbers on the same side
        whole = math.floor(value) if op in (">", "<=") else math.ceil(value)
        return _COMPARE[op](cell, F.lit(whole))
    return None


@dataclass(frozen=True)
class Values:
    """The cell is one of the values, or blank where blanks are included."""

    column: int
    values: tuple[str, ...]
    blanks: bool = False

    def condition(self, cell: Column, kind: T.DataType) -> Column:
        found = is_one_of(cell, kind, [v for v in self.values if v != ""])
        if not self.blanks and "" not in self.values:
            return found
        return found | cell.isNull() | (cell == "") if isinstance(kind, T.StringType) else found | (numbers.text(cell) == "")


def _day(end: float | str) -> datetime.date | None:
    try:
        return datetime.date.fromisoformat(str(end))
    except ValueError:
        return None


@dataclass(frozen=True)
class Range:
    """The cell's number, date, moment or time of day lies within both ends; an end of None is open, other cells fail."""

    column: int
    kind: str  # number, date, datetime, time
    low: float | str | None = None
    high: float | str | None = None

    def _value(self, cell: Column, kind: T.DataType) -> Column:
        if self.kind == "number":
            return numbers.number(cell, kind, affix=True)
        if self.kind == "time":
            return temporal.seconds_of_day(cell, kind)
        at = temporal.moment(cell, kind)
        return F.to_date(at) if self.kind == "date" else at

    def _end(self, end: float | str) -> Column:
        if self.kind == "number":
            return F.lit(float(end))
        if self.kind == "time":
            h, m, *s = str(end).split(":")
            return F.lit(int(h) * 3600 + int(m) * 60 + float(s[0] if s else 0))
        return F.lit(str(end)).cast("date" if self.kind == "date" else "timestamp_ntz")

    def _plain(self, cell: Column, kind: T.DataType) -> list[Column] | None:
        """Comparisons of the column itself, where its type allows them."""
        ends = [(op, e) for op, e in ((">=", self.low), ("<=", self.high)) if e is not None]
        if self.kind == "number":
            found = [compared(cell, kind, op, float(e)) for op, e in ends]
            return None if any(f is None for f in found) else found + ([cell <= F.lit(math.inf)] if isinstance(kind, T.DoubleType) and self.high is None else [])  # NaN is greater than all
        if self.kind not in ("date", "datetime") or not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return None
        if self.kind == "datetime":
            return None if isinstance(kind, T.DateType) else [_COMPARE[op](cell, F.lit(str(e)).cast(kind)) for op, e in ends]
        days = [(op, _day(e)) for op, e in ends]
        if any(d is None for _, d in days):
            return None
        if isinstance(kind, T.DateType):
            return [_COMPARE[op](cell, F.lit(d)) for op, d in days]
        # a day ends before the next one begins
        return [cell >= F.lit(str(d)).cast(kind) if op == ">=" else cell < F.lit(str(d + datetime.timedelta(1))).cast(kind) for op, d in days]

    def condition(self, cell: Column, kind: T.DataType) -> Column:
        found = self._plain(cell, kind)
        if found is None:
            v = self._value(cell, kind)
            found = [v.isNotNull()] + [_COMPARE[op](v, self._end(e)) for op, e in ((">=", self.low), ("<=", self.high)) if e is not None]
        return reduce(lambda a, b: a & b, found) if found else cell.isNotNull()


TEXT_SIGNS = {"contains": "⊃", "equals": "=", "starts": "^", "ends": "$", "regex": "/./", "blank": "= ∅", "not_blank": "≠ ∅", "in_list": "∈"}


@dataclass(frozen=True)
class Text:
    """contains, equals, starts, ends, regex, in_list, blank or not_blank; a wrong regex matches nothing."""

    column: int
    op: str
    value: str = ""
    case: bool = False

    def listed(self) -> list[str]:
        return [x.strip() for x in re.split(r"[\n\r,]", self.value) if x.strip()]

    def condition(self, cell: Column, kind: T.DataType) -> Column:
        t = numbers.text(cell)
        if self.op == "blank":
            return cell.isNull() | (cell == "") if isinstance(kind, T.StringType) else t == ""
        if self.op == "not_blank":
            return cell != "" if isinstance(kind, T.StringType) else t != ""
        if self.op == "regex":
            pattern = texts.regex_or_none(self.value, not self.case)
            return F.lit(False) if pattern is None else t.rlike(pattern)
        if self.case and isinstance(kind, T.StringType) and self.value and self.op in ("equals", "starts"):
            return cell == F.lit(self.value) if self.op == "equals" else cell.startswith(self.value)
        same = (lambda x: x) if self.case else F.upper
        if self.op == "in_list":
            listed = self.listed()
            return same(t).isin(*[v if self.case else v.upper() for v in listed]) if listed else F.lit(False)
        test = {"contains": F.contains, "equals": lambda a, b: a == b, "starts": F.startswith, "ends": F.endswith}[self.op]
        return test(same(t), same(F.lit(self.value)))


Filter = Values | Range | Text
KINDS = {"values": Values, "range": Range, "text": Text}


@dataclass(frozen=True)
class FilterState:
    """The column filters of a view; setting one replaces any other of its column, an empty one clears it."""

    filters: tuple[Filter, ...] = field(default=())

    def set(self, f: Filter) -> FilterState:
        rest = self.clear(f.column)
        nothing = isinstance(f, Values) and not f.values and not f.blanks or isinstance(f, Range) and f.low is None and f.high is None or isinstance(f, Text) and not f.value and f.op not in ("blank", "not_blank")
        return rest if nothing else FilterState((*rest.filters, f))

    def set_all_values(self, column: int, chosen: tuple[str, ...], present: tuple[str, ...]) -> FilterState:
        """Values as ticked in a list; all ticked is no filter."""
        return self.clear(column) if set(chosen) >= set(present) else self.set(Values(column, tuple(c for c in chosen if c), "" in chosen))

    def clear(self, column: int) -> FilterState:
        return FilterState(tuple(f for f in self.filters if f.column != column))

    def conditions(self, cells: Cells) -> list[Column]:
        return [f.condition(*cells(f.column)) for f in self.filters]

    def to_list(self) -> list[dict]:
        name = {v: k for k, v in KINDS.items()}
        return [{"filter": name[type(f)], **asdict(f)} for f in self.filters]

    @staticmethod
    def from_list(items: list[dict]) -> FilterState:
        made = []
        for x in items:
            rest = {k: tuple(v) if isinstance(v, list) else v for k, v in x.items() if k != "filter"}
            made.append(KINDS[x["filter"]](**rest))
        return FilterState(tuple(made))

    def descriptions(self, names: list[str]) -> list[tuple[int, str]]:
        """(column, text) of each filter, for display."""
        out = []
        for f in self.filters:
            name = texts.shown_name(names, f.column)
            if isinstance(f, Values):
                out.append((f.column, f"{name} ∈ {len(f.values) + f.blanks}"))
            elif isinstance(f, Range):
                low, high = (("…" if x is None else f"{x:g}" if isinstance(x, float) else str(x)) for x in (f.low, f.high))
                out.append((f.column, f"{name} {low}~{high}"))
            elif f.op in ("blank", "not_blank"):
                out.append((f.column, f"{name} {TEXT_SIGNS[f.op]}"))
            else:
                out.append((f.column, f"{name} {TEXT_SIGNS[f.op]} {len(f.listed())}" if f.op == "in_list" else f'{name} {TEXT_SIGNS[f.op]} "{f.value}"'))
        return out


def text_contains(cells: list[Column], term: str) -> Column:
    """The term in any of the cells, ignoring case."""
    return reduce(lambda a, b: a | b, [F.contains(F.upper(numbers.text(c)), F.upper(F.lit(term))) for c in cells], F.lit(False))


def cell_equals(cell: Column, value: str, kind: T.DataType | None = None) -> Column:
    """Exact equality with a cell's text; a missing cell never matches."""
    if isinstance(kind, T.IntegralType):
        return is_one_of(cell, kind, [value])
    return cell.cast("string") == F.lit(value)


def combined(conditions: list[Column], match_any: bool = False) -> Column:
    """All or any of the conditions; none at all holds for every row."""
    if not conditions:
        return F.lit(True)
    return reduce((lambda a, b: a | b) if match_any else (lambda a, b: a & b), conditions)


def suggested(column_type: str, unique: int) -> str:
    """Which filter suits a column of an inferred type."""
    if unique <= FEW_VALUES:
        return "values"
    if column_type in ("integer", "float", "currency", "percent", "scientific"):
        return "number"
    if column_type in ("date", "datetime", "time"):
        return column_type
    return "text" if column_type in ("string", "identifier") else "values"


def moved(f: Filter, column: int) -> Filter:
    return replace(f, column=column)
