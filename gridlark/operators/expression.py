"""The filter language: column op value, with AND, OR and parentheses, as Column conditions.

``age >= 30 AND (city = "New York" OR Column3 contains x)``. Columns go by
header, ignoring case, or as ColumnN. ``=`` and ``!=`` compare text exactly;
``> >= < <=`` compare as numbers where both sides are numbers and otherwise as
text ignoring case; ``contains`` ignores case and accents.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers, texts
from .filters import _COMPARE, Cells, cell_equals, compared, is_one_of

_TEXT = T.StringType()


class ExpressionError(ValueError):
    pass


_TOKEN = re.compile(r'\s+|(?P<quoted>"(?:\\.|[^"\\])*(?:"|$))|(?P<mark>[()]|[=!<>]=?)|(?P<bare>[^\s"()=!<>]+)')
_OPERATORS = frozenset(("contains", "=", "==", "!=", ">", ">=", "<", "<="))


def _tokens(source: str) -> list[tuple[str, str]]:
    out = []
    for m in _TOKEN.finditer(source):
        if m.lastgroup == "quoted":
            body = m.group()[1:]
            body = body[:-1] if body.endswith('"') and not re.search(r'(?<!\\)(?:\\\\)*\\"$', body) else body
            out.append(("quoted", re.sub(r"\\(.)", r"\1", body, flags=re.S)))
        elif m.lastgroup:
            out.append((m.lastgroup, m.group()))
    return out


class _Reader:
    def __init__(self, source: str, headers: list[str], cells: Cells) -> None:
        self.tokens, self.at, self.headers, self.cells = _tokens(source), 0, headers, cells

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def keyword(self, word: str) -> bool:
        kind, value = self.peek()
        if kind == "bare" and value.lower() == word:
            self.at += 1
            return True
        return False

    def either(self) -> Column:
        found = self.both()
        while self.keyword("or"):
            found = found | self.both()
        return found

    def both(self) -> Column:
        found = self.single()
        while self.keyword("and"):
            found = found & self.single()
        return found

    def single(self) -> Column:
        kind, value = self.next()
        if (kind, value) == ("mark", "("):
            inner = self.either()
            if self.next() != ("mark", ")"):
                raise ExpressionError("a parenthesis isn't closed")
            return inner
        if kind not in ("bare", "quoted"):
            raise ExpressionError("a column is missing")
        cell, of = self.cells(self.column(value if kind == "bare" else f'"{value}"'))
        _, op = self.next()
        if op.lower() not in _OPERATORS:
            raise ExpressionError(f"unknown operator {op!r}")
        kind, operand = self.next()
        if kind not in ("bare", "quoted"):
            raise ExpressionError("a value is missing")
        return comparison(cell, op.lower(), operand, of)

    def column(self, token: str) -> int:
        for k, name in enumerate(self.headers):
            if name.lower() == token.lower():
                return k
        digits = re.sub(r"[^0-9]", "", token)
        if token.lower().startswith("column") and digits and 1 <= int(digits) <= len(self.headers):
            return int(digits) - 1
        raise ExpressionError(f"unknown column {token!r}")


def comparison(cell: Column, op: str, value: str, kind: T.DataType = _TEXT) -> Column:
    """One comparison of a cell's text; a missing cell fails all but ``!=`` (null counts as false).

    Whole and double columns are compared with a number as they are, so that the scan can skip rows.
    """
    whole = isinstance(kind, T.IntegralType)
    t = cell.cast("string")
    if op == "contains":
        return texts.contains_loosely(t, value) & cell.isNotNull()
    if op in ("=", "=="):
        return cell_equals(cell, value, kind)
    if op == "!=":
        return cell.isNull() | (~is_one_of(cell, kind, [value]) if whole else t != F.lit(value))
    number = numbers.plain_value(value)
    found = compared(cell, kind, op, number) if number is not None else None
    if found is not None:
        return found
    test = _COMPARE[op]
    left, right = numbers.plain(t), numbers.plain(F.lit(value))
    return F.when(left.isNotNull() & right.isNotNull(), test(left, right)).otherwise(test(F.upper(t), F.upper(F.lit(value))))


def compile_expression(source: str, headers: list[str], cells: Cells) -> Column:
    """The condition of a filter expression; raises ExpressionError where it can't be read."""
    if not source.strip():
        raise ExpressionError("the expression is empty")
    reader = _Reader(source, headers, cells)
    found = reader.either()
    if reader.peek()[0] != "end":
        raise ExpressionError(f"unexpected {reader.peek()[1]!r}")
    return found
