"""Search over the cells of a row: literal, regular expression or fuzzy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numbers, texts


@dataclass(frozen=True)
class Query:
    mode: str  # contains, regex, fuzzy
    needle: str

    def matches(self, cell: Column) -> Column:
        t = numbers.text(cell)
        if self.mode == "contains":
            return texts.contains_loosely(t, self.needle)
        return t.rlike("(?iu)" + self.needle) if self.mode == "regex" else texts.fuzzy_contains(t, self.needle)

    def any_of(self, cells: list[Column]) -> Column:
        return F.exists(F.array(*[self.matches(c) for c in cells]), lambda x: x)

    def first_of(self, cells: list[Column]) -> Column:
        """Struct of the ordinal and text of the first matching cell, or null."""
        found = F.coalesce(*[F.when(self.matches(c), F.struct(F.lit(k).alias("column"), numbers.text(c).alias("value"))) for k, c in enumerate(cells)])
        return found


def query(user_input: str) -> Query | None:
    """``regex:…`` and ``/…/`` are regular expressions, ``fuzzy:…`` is fuzzy, the rest literal; blank is no query.

    Raises ValueError for a regular expression that can't be read.
    """
    s = user_input.strip()
    if not s:
        return None
    low = s.lower()
    if low.startswith("fuzzy:"):
        return Query("fuzzy", s[6:].strip()) if s[6:].strip() else None
    pattern = s[6:].strip() if low.startswith("regex:") else s[1:-1] if len(s) > 2 and s[0] == s[-1] == "/" else None
    if pattern is None:
        return Query("contains", s)
    if not pattern:
        return None
    if texts.regex_or_none(pattern) is None:
        raise ValueError(f"not a regular expression: {pattern}")
    return Query("regex", pattern)
