"""A view over a table: conditions, order and visible columns, put together lazily.

Every method returns a new view; ``df`` is the DataFrame of its rows. All
conditions become one filter, so the optimizer sees the whole and hands what it
can to the scan.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers, texts
from ..operators import analytics, filters, order, pivot, profile, search, stats
from ..operators.expression import compile_expression


@dataclass(frozen=True)
class View:
    """``rows`` holds the cells in ``columns`` (names in ``rows``), shown under ``names``; ``key`` orders rows where nothing else does."""

    rows: DataFrame
    columns: tuple[str, ...]
    names: tuple[str, ...]
    key: tuple[str, ...]
    state: filters.FilterState = field(default_factory=filters.FilterState)
    term: tuple[str, int | None] | None = None
    equal: tuple[tuple[int, str], ...] = ()
    expressions: tuple[str, ...] = ()
    extra: tuple[Column, ...] = ()
    match_any: bool = False
    order: tuple[tuple[int, bool], ...] = ()
    hidden: tuple[int, ...] = ()
    found: tuple[str, int | None] | None = None

    # -- cells ---------------------------------------------------------------------------------

    def at(self, column: int | str) -> int:
        if isinstance(column, int):
            return column
        for k, n in enumerate(self.names):
            if n.lower() == column.lower():
                return k
        raise KeyError(column)

    def cell(self, column: int | str) -> tuple[Column, T.DataType]:
        name = self.columns[self.at(column)]
        return F.col(f"`{name}`"), self.rows.schema[name].dataType

    def cells(self) -> list[Column]:
        return [self.cell(k)[0] for k in range(len(self.columns))]

    # -- conditions ----------------------------------------------------------------------------

    def filter(self, f: filters.Filter) -> View:
        return replace(self, state=self.state.set(f))

    def values(self, column: int | str, values: list[str], blanks: bool = False) -> View:
        return self.filter(filters.Values(self.at(column), tuple(values), blanks))

    def range(self, column: int | str, kind: str, low: float | str | None = None, high: float | str | None = None) -> View:
        return self.filter(filters.Range(self.at(column), kind, low, high))

    def text_op(self, column: int | str, op: str, value: str = "", case: bool = False) -> View:
        return self.filter(filters.Text(self.at(column), op, value, case))

    def text(self, term: str, column: int | str | None = None) -> View:
        """Rows with the term in a column or in any; there is one such condition at a time."""
        return replace(self, term=(term, None if column is None else self.at(column)) if term else None)

    def same_as(self, column: int | str, value: str) -> View:
        return replace(self, equal=(*self.equal, (self.at(column), value)))

    def expr(self, source: str) -> View:
        compile_expression(source, list(self.names), self.cell)
        return replace(self, expressions=(*self.expressions, source))

    def where(self, condition: Column) -> View:
        return replace(self, extra=(*self.extra, condition))

    def match(self, any_of: bool) -> View:
        return replace(self, match_any=any_of)

    def clear(self, column: int | str | None = None) -> View:
        """Without the filter of one column, or without any condition and order."""
        if column is not None:
            return replace(self, state=self.state.clear(self.at(column)))
        return replace(self, state=filters.FilterState(), term=None, equal=(), expressions=(), extra=(), order=())

    def condition(self) -> Column:
        found = self.state.conditions(self.cell)
        if self.term:
            text, k = self.term
            found.append(filters.text_contains(self.cells() if k is None else [self.cell(k)[0]], text))
        found += [filters.cell_equals(self.cell(k)[0], v, self.cell(k)[1]) for k, v in self.equal]
        found += [compile_expression(s, list(self.names), self.cell) for s in self.expressions]
        return filters.combined(found + list(self.extra), self.match_any)

    def descriptions(self) -> list[tuple[int, str]]:
        return self.state.descriptions(list(self.names))

    # -- rows ----------------------------------------------------------------------------------

    @property
    def unordered(self) -> DataFrame:
        return self.rows.filter(self.condition())

    def keys(self) -> list[Column]:
        ties = [F.col(f"`{k}`") for k in self.key]
        if not self.order:
            return [t.asc() for t in ties]
        return order.sort_keys(self.unordered, [self.cell(k) for k, _ in self.order], [up for _, up in self.order], ties)

    @property
    def df(self) -> DataFrame:
        """The view's rows and visible columns; sorted if an order is set."""
        rows = self.unordered.orderBy(*self.keys()) if self.order else self.unordered
        return rows.select(*[f"`{self.columns[k]}`" for k in self.visible()])

    def sort(self, *keys: tuple[int | str, bool]) -> View:
        """By columns, each ascending (True) or not; equal rows stay in the order of the key."""
        return replace(self, order=tuple((self.at(c), up) for c, up in keys))

    def toggle_sort(self, column: int | str, add: bool = False) -> View:
        """As clicks on a header do: ascending, then descending, then not at all; ``add`` keeps the other keys."""
        k = self.at(column)
        now = dict(self.order).get(k)
        if add:
            kept = [(c, up) for c, up in self.order if c != k]
            if now is None:
                return replace(self, order=(*self.order, (k, True)))
            return replace(self, order=tuple((c, not up) if c == k else (c, up) for c, up in self.order) if now else tuple(kept))
        return replace(self, order=((k, True),) if now is None or len(self.order) > 1 else ((k, False),) if now else ())

    def reset_order(self) -> View:
        return replace(self, order=())

    def select(self, columns: list[int | str]) -> DataFrame:
        """The view's rows with the given columns, in that order."""
        rows = self.unordered.orderBy(*self.keys()) if self.order else self.unordered
        return rows.select(*[f"`{self.columns[self.at(c)]}`" for c in columns])

    def hide(self, *columns: int | str) -> View:
        return replace(self, hidden=tuple(dict.fromkeys((*self.hidden, *map(self.at, columns)))))

    def show(self, *columns: int | str) -> View:
        return replace(self, hidden=tuple(h for h in self.hidden if h not in set(map(self.at, columns))) if columns else ())

    def visible(self) -> list[int]:
        return [k for k in range(len(self.columns)) if k not in self.hidden]

    def numbered(self) -> DataFrame:
        """All columns and ``_position``, the 1-based place of each row in the view."""
        return order.positioned(self.unordered, self.keys())

    def page(self, first: int, count: int) -> DataFrame:
        return self.numbered().filter(F.col("_position").between(first, first + count - 1)).orderBy("_position")

    def record(self, **key: object) -> DataFrame:
        """name, value of the cells of one row, found by its key."""
        row = self.rows
        for k, v in key.items():
            row = row.filter(F.col(f"`{k}`") == F.lit(v))
        pairs = F.array(*[F.struct(F.lit(texts.shown_name(list(self.names), i)).alias("name"), numbers.text(c).alias("value")) for i, c in enumerate(self.cells())])
        return row.select(F.inline(pairs))

    # -- search --------------------------------------------------------------------------------

    def _cells_of(self, column: int | str | None) -> list[Column]:
        return self.cells() if column is None else [self.cell(column)[0]]

    def search(self, text: str, column: int | str | None = None) -> DataFrame:
        """Rows that match, with ``_match`` (column and value of the first matching cell)."""
        q = search.query(text)
        if q is None:
            return self.unordered.limit(0).withColumn("_match", F.lit(None).cast("struct<column:int,value:string>"))
        cells = self._cells_of(column)
        offset = 0 if column is None else self.at(column)
        first = q.first_of(cells)
        return self.unordered.filter(q.any_of(cells)).withColumn("_match", F.struct((first["column"] + offset).alias("column"), first["value"].alias("value")))

    def find_next(self, text: str, start: int, column: int | str | None = None) -> DataFrame:
        """The next matching row at or after position ``start``, else the first from the top: one row or none."""
        q = search.query(text)
        rows = self.numbered()
        rows = rows.filter(q.any_of(self._cells_of(column)) if q else F.lit(False))
        return rows.orderBy((F.col("_position") < start).asc(), "_position").limit(1)

    def goto(self, **key: object) -> DataFrame:
        """The row with the given key, with its ``_position`` in the view."""
        rows = self.numbered()
        for k, v in key.items():
            rows = rows.filter(F.col(f"`{k}`") == F.lit(v))
        return rows

    # -- analysis ------------------------------------------------------------------------------

    def profile(self, sample: int | None = None) -> DataFrame:
        return profile.profile_table(self.unordered.select(*[f"`{c}`" for c in self.columns]), list(self.names), sample)

    def distinct(self, column: int | str) -> DataFrame:
        return analytics.distinct_values(self.unordered, self.cell(column)[0])

    def top(self, column: int | str, k: int = analytics.TOP_VALUES) -> DataFrame:
        return analytics.top_values(self.unordered, self.cell(column)[0], k)

    def duplicates(self, columns: list[int | str]) -> DataFrame:
        return analytics.duplicates(self.unordered, [(self.columns[self.at(c)], self.cell(c)[0]) for c in columns], F.col(f"`{self.key[0]}`"))

    def group_by(self, columns: list[int | str], value: int | str | None, functions: list[str]) -> DataFrame:
        cell, kind = self.cell(value) if value is not None else (None, None)
        return analytics.group_by(self.unordered, [(self.columns[self.at(c)], self.cell(c)[0]) for c in columns], cell, kind, functions)

    def distribution(self, column: int | str) -> DataFrame:
        return analytics.distribution(self.unordered, *self.cell(column))

    def histogram(self, column: int | str, bins: int = 10) -> DataFrame:
        return analytics.histogram(self.unordered, *self.cell(column), bins)

    def date_histogram(self, column: int | str, period: str, value: int | str | None = None) -> DataFrame:
        cell, kind = self.cell(value) if value is not None else (None, None)
        return analytics.date_histogram(self.unordered, *self.cell(column), period, cell, kind)

    def facet(self, column: int | str, column_type: str) -> DataFrame:
        return analytics.facet(self.unordered, *self.cell(column), column_type)

    def facets(self, types: dict[int | str, str]) -> dict[str, DataFrame]:
        """Facets of several columns over this view; a filtered view gives filtered facets."""
        return {self.names[self.at(c)]: self.facet(c, t) for c, t in types.items()}

    def key_of(self, column: int | str, period: str | None = None) -> pivot.Key:
        return pivot.Key(self.columns[self.at(column)], *self.cell(column), period)

    def pivot(self, rows: list[int | str], columns: list[int | str], measures: list[tuple[str, int | str, str]], filters_: dict[int | str, str | None] | None = None, periods: dict[int | str, str] | None = None, totals: bool = False) -> DataFrame:
        """Long form of a pivot table; measures are (name, column, function)."""
        periods = {self.at(c): p for c, p in (periods or {}).items()}
        key = lambda c: self.key_of(c, periods.get(self.at(c)))
        made = [pivot.Measure(n, *self.cell(c), f) for n, c, f in measures]
        return pivot.pivot(self.unordered, list(map(key, rows)), list(map(key, columns)), made, [(key(c), v) for c, v in (filters_ or {}).items()], totals)

    def correlation(self, x: int | str, y: int | str, method: str = "pearson") -> DataFrame:
        return stats.correlation(self.unordered, numbers.number(*self.cell(x)), numbers.number(*self.cell(y)), method)

    def ttest(self, value: int | str, group: int | str, pair: tuple[str, str] | None = None) -> DataFrame:
        return stats.welch(self.unordered, numbers.number(*self.cell(value)), self.cell(group)[0], F.col(f"`{self.key[0]}`"), pair)

    def paired_ttest(self, before: int | str, after: int | str) -> DataFrame:
        return stats.paired(self.unordered, numbers.number(*self.cell(before)), numbers.number(*self.cell(after)))

    def chi_square(self, a: int | str, b: int | str) -> DataFrame:
        return stats.chi_square(self.unordered, self.cell(a)[0], self.cell(b)[0])

    # -- saved views ---------------------------------------------------------------------------

    def to_json(self) -> str:
        """All of the view but its rows and the conditions given as Columns."""
        return json.dumps({"filters": self.state.to_list(), "text": self.term, "equal": self.equal, "expressions": self.expressions, "match_any": self.match_any, "order": self.order, "hidden": self.hidden, "search": self.found}, ensure_ascii=False)

    def remember_search(self, text: str, column: int | str | None = None) -> View:
        return replace(self, found=(text, None if column is None else self.at(column)))

    def restore(self, saved: str) -> View:
        """This view's rows under a saved view's filters, order, columns and search."""
        x = json.loads(saved)
        pairs = lambda items: tuple(tuple(i) for i in items)
        return replace(self, state=filters.FilterState.from_list(x["filters"]), term=tuple(x["text"]) if x["text"] else None, equal=pairs(x["equal"]), expressions=tuple(x["expressions"]), match_any=x["match_any"], order=pairs(x["order"]), hidden=tuple(x["hidden"]), found=tuple(x["search"]) if x["search"] else None)


def view_of(df: DataFrame, key: list[str], names: list[str] | None = None, columns: list[str] | None = None) -> View:
    """A view of a DataFrame whose ``key`` tells its rows apart and gives their order."""
    columns = columns or [c for c in df.columns if not c.startswith("_")]
    return View(df, tuple(columns), tuple(names or columns), tuple(key))
