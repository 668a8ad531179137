"""Pivot tables: any measures over row and column keys in one pass, with exact totals by grouping sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers, temporal, texts
from .analytics import measured

LISTED_VALUES = 500
LOOKS_TEMPORAL = r"^[0-9]{4}(-[0-9]{2}){0,2}$|^[0-9]{4}-W[0-9]{2}$"


@dataclass(frozen=True)
class Key:
    """A dimension: its name, cell and type, and for dates the period they are grouped by (None: as they are)."""

    name: str
    cell: Column
    kind: T.DataType
    period: str | None = None

    def value(self) -> Column:
        """The key's text: "null" for null tokens, the period's label for dates, else the raw text."""
        t = numbers.text(self.cell)
        shown = t if self.period is None else F.coalesce(temporal.label(temporal.moment(self.cell, self.kind), self.period), t)
        return F.when(texts.is_null_token(t), F.lit("null")).otherwise(shown)


@dataclass(frozen=True)
class Measure:
    name: str
    cell: Column
    kind: T.DataType
    function: str


def allowed_functions(column_type: str) -> tuple[str, ...]:
    """Functions for a measure of an inferred type, the usual one first."""
    if column_type in ("integer", "float"):
        return ("sum", "count", "mean", "median", "min", "max", "unique", "std")
    return ("count", "unique")


def usual_period(column_type: str) -> str | None:
    return "month" if column_type in ("date", "datetime") else None


def _keyed(df: DataFrame, rows: list[Key], columns: list[Key], measures: list[Measure], filters: list[tuple[Key, str | None]]) -> DataFrame:
    for key, chosen in filters:
        if chosen is not None:
            df = df.filter(key.value() == chosen)
    cells = [x for i, m in enumerate(measures) for x in (m.cell.alias(f"_raw{i}"), numbers.number(m.cell, m.kind).alias(f"_x{i}"))]
    return df.select(*[k.value().alias(k.name) for k in [*rows, *columns]], *cells)


def _measured(keyed: DataFrame, names: list[str], measures: list[Measure], sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    return measured(keyed, names, [(m.name, m.function, f"_x{i}", f"_raw{i}") for i, m in enumerate(measures)], sets)


def pivot(df: DataFrame, rows: list[Key], columns: list[Key], measures: list[Measure], filters: list[tuple[Key, str | None]] = (), totals: bool = False) -> DataFrame:
    """Long form: a row for each combination of keys with all measures; ordered by keys.

    With ``totals`` also the row, column and grand totals, aggregated from the rows themselves: keys summed over
    are null and ``level`` says which total it is (cell, row, column, grand).
    """
    keyed = _keyed(df, rows, columns, measures, list(filters))
    names, r, c = [k.name for k in [*rows, *columns]], [k.name for k in rows], [k.name for k in columns]
    if not totals:
        found = _measured(keyed, names, measures)
        return found.orderBy(*names) if names else found
    sets = list(dict.fromkeys([tuple(names), tuple(r), tuple(c), ()]))
    grouped = _measured(keyed, names, measures, sets)
    bit = {n: 1 << (len(names) - 1 - i) for i, n in enumerate(names)}
    gone = {s: sum(bit[n] for n in names if n not in s) for s in sets}
    level = F.when(F.col("_id") == gone[tuple(names)], "cell")
    if r and c:
        level = level.when(F.col("_id") == gone[tuple(r)], "row")
        level = level.when(F.col("_id") == gone[tuple(c)], "column")
    return grouped.select(level.otherwise("grand").alias("level"), *names, *[m.name for m in measures]).orderBy("level", *names)


def wide(df: DataFrame, rows: list[Key], columns: list[Key], measure: Measure, filters: list[tuple[Key, str | None]] = ()) -> DataFrame:
    """Cross table of one measure: a column for each combination of column keys, joined by " / "; missing cells are 0."""
    keyed = _keyed(df, rows, columns, [measure], list(filters))
    r = [k.name for k in rows]
    keyed = keyed.withColumn("_column", F.concat_ws(" / ", *[k.name for k in columns]))
    found = _measured(keyed, [*r, "_column"], [measure]).groupBy(*r).pivot("_column").agg(F.first(measure.name))
    return found.fillna(0.0, [c for c in found.columns if c not in r]).orderBy(*r)


def filter_values(df: DataFrame, key: Key, limit: int = LISTED_VALUES) -> DataFrame:
    """The key's distinct values in order, as a list to choose from."""
    return df.select(key.value().alias("value")).distinct().orderBy("value").limit(limit)


def series(long: DataFrame, rows: list[str], columns: list[str], measure: str) -> tuple[DataFrame, str]:
    """(category, series, value) of a pivot for a chart, and the kind of chart that suits it.

    Lines for categories that look like periods (two or more), grouped bars for several series, else bars.
    """
    category = F.concat_ws(" / ", *rows) if rows else F.lit("")
    named = F.concat_ws(" / ", *columns) if columns else F.lit(measure)
    points = long.select(category.alias("category"), named.alias("series"), F.col(measure).cast("double").alias("value"))
    known = F.col("category") != "null"
    shape = points.agg(F.coalesce(F.bool_and(F.when(known, F.col("category").rlike(LOOKS_TEMPORAL))), F.lit(False)).alias("temporal"), F.count_distinct(F.when(known, F.col("category"))).alias("n"), F.count_distinct("series").alias("s")).first()
    kind = "line" if shape.temporal and shape.n >= 2 else "grouped_bar" if shape.s > 1 else "bar"
    return points, kind
