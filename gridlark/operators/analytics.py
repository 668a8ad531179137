"""Group-by, distinct values, duplicates, distributions, histograms and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers, temporal
from . import order

FUNCTIONS = ("count", "sum", "mean", "median", "min", "max", "unique", "std")
FACET_BINS, FACET_VALUES, TOP_VALUES = 6, 6, 10


def aggregate(fn: str, x: Column, raw: Column) -> Column:
    """One of FUNCTIONS over the numbers x of the raw cells; without numbers the result is 0."""
    zero = F.lit(0.0)
    found = {
        "count": lambda: F.count(F.lit(1)).cast("double"),
        "sum": lambda: F.coalesce(F.sum(x), zero),
        "mean": lambda: F.coalesce(F.avg(x), zero),
        "median": lambda: F.coalesce(F.percentile(x, 0.5), zero),
        "min": lambda: F.coalesce(F.min(x), zero),
        "max": lambda: F.coalesce(F.max(x), zero),
        "unique": lambda: F.count_distinct(numbers.text(raw)).cast("double"),
        "std": lambda: F.coalesce(F.stddev_pop(x), zero),
    }
    if fn not in found:
        raise ValueError(f"unknown function {fn!r}; there are {', '.join(FUNCTIONS)}")
    return found[fn]()


def measured(rows: DataFrame, keys: list[str], measures: list[tuple[str, str, str, str]], sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """keys and measures (name, function, column of numbers, column of raw cells) of groups, or of all grouping ``sets``, with ``_id``.

    Medians and numbers of distinct cells come from values counted once, so that no task holds the values of a group.
    """

    def grouped(df: DataFrame, *found: Column) -> DataFrame:
        if sets is None:
            return df.groupBy(*keys).agg(*found)
        return df.groupingSets([[F.col(k) for k in s] for s in sets], *map(F.col, keys)).agg(F.grouping_id().alias("_id"), *found)

    def spread(df: DataFrame, *columns: str) -> DataFrame:
        """The rows once for each of the sets, with nulls for the keys it lacks."""
        if sets is None:
            return df
        of = [F.struct(F.lit(sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)).cast("long").alias("_id"), *[(F.col(k) if k in s else F.lit(None).cast("string")).alias(k) for k in keys], *columns) for s in sets]
        return df.select(F.inline(F.array(*of)))

    by = keys if sets is None else ["_id", *keys]
    plain = [m for m in measures if m[1] not in ("median", "unique")]
    out = grouped(rows, *[aggregate(f, F.col(x), F.col(raw)).alias(name) for name, f, x, raw in plain], F.count(F.lit(1)).alias("_rows"))
    for i, (name, f, x, raw) in enumerate(m for m in measures if m not in plain):
        if f == "median":
            counts = rows.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("n"))
            found = order.medians(spread(counts, "x", "n"), by, few=not by).withColumnRenamed("median", f"_found{i}")
        else:
            cells = rows.select(*keys, numbers.text(F.col(raw)).alias("_cell")).distinct()
            found = spread(cells, "_cell").distinct().groupBy(*by).agg(F.count("_cell").alias(f"_found{i}"))
        found = found.withColumnsRenamed({k: f"_of{i}_{k}" for k in by})
        same = [F.col(k).eqNullSafe(F.col(f"_of{i}_{k}")) for k in by]
        out = out.join(found, same or F.lit(True), "left").withColumn(name, F.coalesce(F.col(f"_found{i}").cast("double"), F.lit(0.0)))
    return out.select(*by, *[m[0] for m in measures])


def group_by(df: DataFrame, keys: list[tuple[str, Column]], value: Column | None, kind: T.DataType | None, functions: list[str]) -> DataFrame:
    """A row for each distinct combination of key texts, with the functions of one value column; ordered by keys ignoring case."""
    raw = value if value is not None else F.lit("")
    x = numbers.number(raw, kind)
    names = [n for n, _ in keys]
    rows = df.select(*[numbers.text(c).alias(n) for n, c in keys], raw.alias("_raw"), x.alias("_x"))
    found = measured(rows, names, [(f, f, "_x", "_raw") for f in functions])
    return found.orderBy(*[F.upper(n) for n in names], *names)


def distinct_values(df: DataFrame, cell: Column) -> DataFrame:
    """value, n: the most frequent first, ties by text ignoring case."""
    found = df.groupBy(numbers.text(cell).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("n"), F.upper("value"), "value")


def top_values(df: DataFrame, cell: Column, k: int = TOP_VALUES) -> DataFrame:
    return distinct_values(df, cell).limit(k)


def duplicates(df: DataFrame, cells: list[tuple[str, Column]], row: Column) -> DataFrame:
    """Groups of rows that agree in all cells: the cells, n, first and the sorted row numbers; ordered by first."""
    keyed = df.select(*[numbers.text(c).alias(n) for n, c in cells], row.alias("_row"))
    names = [n for n, _ in cells]
    # groups of one row leave before row numbers are gathered
    often = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first")).filter("n > 1")
    rows = keyed.join(often.drop("n", "first"), names, "left_semi").groupBy(*names).agg(F.sort_array(F.collect_list("_row")).alias("rows"))
    return often.join(rows, names).select(*names, "n", "first", "rows").orderBy("first")


def duplicate_rows(df: DataFrame, cells: list[tuple[str, Column]], row: Column) -> DataFrame:
    """The duplicate groups without gathered lists: a line for each row, with its group's first row and size.

    For groups of any size; ordered by group and row.
    """
    names = [n for n, _ in cells]
    keyed = df.select(*[numbers.text(c).alias(n) for n, c in cells], row.alias("row"))
    often = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).filter("n > 1")
    return keyed.join(often, names).select("first", "n", "row").orderBy("first", "row")


def distribution(df: DataFrame, cell: Column, kind: T.DataType | None = None) -> DataFrame:
    """One row of count, min, max, mean, median, q1, q3 and population std of a column's numbers."""
    rows = df.select(numbers.number(cell, kind).alias("x"))
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    zero = F.lit(0.0)
    found = rows.agg(F.count("x").alias("count"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), q.alias("q"), F.stddev_pop("x").alias("std"))
    return found.select("count", *[F.coalesce(c, zero).alias(n) for n, c in (("min", F.col("min")), ("max", F.col("max")), ("mean", F.col("mean")), ("q1", F.col("q")[0]), ("median", F.col("q")[1]), ("q3", F.col("q")[2]), ("std", F.col("std")))])


def histogram(df: DataFrame, cell: Column, kind: T.DataType | None = None, bins: int = 10) -> DataFrame:
    """bin, lower, upper, n of equal widths, empty bins too; one bin if all numbers are equal, no rows without numbers."""
    rows = df.select(numbers.number(cell, kind).alias("x")).filter(F.col("x").isNotNull())
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, n long")
    bins = 1 if low == high else bins
    width = (high - low) / bins
    at = F.lit(0) if bins == 1 else F.least(F.lit(bins - 1), F.floor((F.col("x") - low) / width)).cast("int")
    counted = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = [(k, low + k * width, high if k == bins - 1 else low + (k + 1) * width) for k in range(bins)]
    return spark.createDataFrame(edges, "bin int, lower double, upper double").join(counted, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0).cast("long")).alias("n")).orderBy("bin")


def date_histogram(df: DataFrame, at: Column, at_kind: T.DataType | None, period: str, value: Column | None = None, kind: T.DataType | None = None) -> DataFrame:
    """label, n, sum, avg of each period that has rows; avg divides by all rows of the period, also those without a number."""
    x = F.lit(0.0) if value is None else F.coalesce(numbers.number(value, kind), F.lit(0.0))
    rows = df.select(temporal.label(temporal.moment(at, at_kind), period).alias("label"), x.alias("x")).filter(F.col("label").isNotNull())
    found = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum"))
    return found.select("label", "n", "sum", (F.col("sum") / F.col("n")).alias("avg")).orderBy("label")


def facet(df: DataFrame, cell: Column, kind: T.DataType, column_type: str) -> DataFrame:
    """label, low, high, n: 6 bins of a number column (integer, float), else the 6 most frequent values."""
    if column_type in ("integer", "float"):
        found = histogram(df, cell, kind, FACET_BINS)
        digits = F.when((F.abs("lower") >= 1000) | (F.abs("upper") >= 1000), F.concat(F.format_number("lower", 0), F.lit(" – "), F.format_number("upper", 0)))
        return found.select(F.coalesce(digits, F.concat(numbers.grouped_decimal(F.col("lower")), F.lit(" – "), numbers.grouped_decimal(F.col("upper")))).alias("label"), F.col("lower").alias("low"), F.col("upper").alias("high"), "n")
    none = F.lit(None).cast("double")
    return top_values(df, cell, FACET_VALUES).select(F.col("value").alias("label"), none.alias("low"), none.alias("high"), "n")
