"""Column profiles: inferred semantic type, counts, numeric summary and most frequent values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers, temporal, texts
from . import order
from .analytics import TOP_VALUES

#: Texts of booleans, after lower-casing (fixed values).
BOOLEANS = ("true", "false", "yes", "no", "y", "n", "0", "1")
TYPES = ("empty", "boolean", "date", "datetime", "time", "percent", "currency", "identifier", "scientific", "integer", "float", "categorical", "string", "ordinal")
NUMERIC_TYPES = ("integer", "float", "currency", "percent", "scientific")
SAMPLE_ROWS = 10_000


@dataclass(frozen=True)
class Hint:
    """A declared type: it overrides the inferred one."""

    type: str
    symbol: str | None = None
    fraction: bool = False


@dataclass(frozen=True)
class Profile:
    index: int
    name: str
    type: str
    nulls: int
    non_nulls: int
    unique: int
    #: min, max, mean, median, std of the numbers, or None.
    numeric: dict[str, float] | None
    top: list[tuple[str, int]] = field(default_factory=list)


def _facts(value: Column, kinds: list[T.DataType]) -> dict[str, Column]:
    """Facts about a trimmed, known text of the column ``index``; over a column they are aggregated with and/or.

    Texts are parsed; what the kind of column says alone isn't.
    """

    def of(*types: type) -> Column:
        return F.col("index").isin([i for i, k in enumerate(kinds) if isinstance(k, types)])

    number, dated, parsed = of(T.NumericType), of(T.DateType, T.TimestampType, T.TimestampNTZType), F.col("parsed")
    whole = F.when(of(T.IntegralType), True).when(number, F.col("x") % 1 == 0).when(parsed, (F.col("plain") % 1 == 0) & ~value.contains(".") & ~value.rlike("[eE]"))
    return {
        "number": number | F.col("plain").isNotNull(), "whole": whole,
        "boolean": F.when(of(T.IntegralType), F.col("x").isin(0.0, 1.0)).otherwise(of(T.BooleanType) | parsed & F.lower(value).isin(*BOOLEANS)),
        "temporal": dated | F.col("moment").isNotNull(), "currency": F.col("money").isNotNull(), "percent": F.col("share").isNotNull(),
        "exponent": F.col("plain").isNotNull() & value.rlike("[eE]"),
        "dated": dated | (F.col("moment") != "time"), "timed": of(T.TimestampType, T.TimestampNTZType) | (F.col("moment") != "date"), "zeros": parsed & value.rlike("^0[0-9]+$"),
    }


ALL_OF = ("number", "whole", "boolean", "temporal", "currency", "percent")
ANY_OF = ("exponent", "dated", "timed", "zeros")


def profile_table(df: DataFrame, names: list[str] | None = None, sample: int | None = None) -> DataFrame:
    """index, name, type, nulls, non_nulls, unique, min, max, mean, median, std: one row for each column of ``df``.

    Values are counted first, so that each distinct text is parsed once for its column's facts and once for its
    numbers, and no task holds a column's values. ``sample`` takes the first rows only, as viewers do; None takes all.
    """
    df = df.limit(sample) if sample else df
    fields = df.schema.fields
    names = names or [f.name for f in fields]
    kinds = [f.dataType for f in fields]
    none = F.lit(None).cast("double")
    parts = []
    for i, f in enumerate(fields):
        cell = F.col(f"`{f.name}`")
        value = F.trim(cell.cast("string"))
        x = numbers.number(cell, f.dataType) if isinstance(f.dataType, T.NumericType) else none
        parts.append(F.struct(F.lit(i).alias("index"), F.when(~texts.is_null_token(value), value).alias("value"), x.alias("x")))
    counts = df.select(F.inline(F.array(*parts))).groupBy("index", "value").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("x"))

    given = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    value, n = F.col("value"), F.col("n")
    text, parsed = F.col("index").isin([i for i, k in enumerate(kinds) if isinstance(k, T.StringType)]), F.col("index").isin([i for i, k in enumerate(kinds) if not isinstance(k, given)])
    # a lambda keeps this out of a generated method too long to be compiled
    known = F.exists(F.array(value), lambda v: v.isNotNull())
    cells = counts.select("index", "value", "n", "x", known.alias("known"), parsed.alias("parsed"), F.when(parsed, numbers.plain(value)).alias("plain"), F.when(parsed, temporal.parse(value)["kind"]).alias("moment"), F.when(parsed, numbers.currency(value, True)).alias("money"), F.when(parsed, numbers.percent(value, True)).alias("share"))
    facts = _facts(value, kinds)
    cells = cells.select("index", "n", "known", *[F.when(F.col("known"), F.coalesce(facts[k], F.lit(False)) if k in ALL_OF else facts[k]).alias(k) for k in (*ALL_OF, *ANY_OF)])
    wide = [F.sum("n").alias("rows"), F.sum(F.when(F.col("known"), n)).alias("known"), F.count_if("known").alias("unique")]
    wide += [F.bool_and(k).alias(k) for k in ALL_OF] + [F.bool_or(k).alias(k) for k in ANY_OF]
    named = df.sparkSession.createDataFrame([(i, n, texts.header_suggests_id(n)) for i, n in enumerate(names)], "index int, name string, is_id boolean").coalesce(1)
    # a table without rows has columns as well
    rows = named.join(F.broadcast(cells.groupBy("index").agg(*wide)), "index", "left")
    rows = rows.select("index", "name", "is_id", *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in ("rows", "known", "unique")], *[F.coalesce(k, F.lit(False)).alias(k) for k in (*ALL_OF, *ANY_OF)])
    when = F.when(F.col("known") == 0, "empty").when(F.col("boolean"), "boolean")
    when = when.when(F.col("temporal") & F.col("dated") & F.col("timed"), "datetime").when(F.col("temporal") & F.col("timed"), "time").when(F.col("temporal"), "date")
    when = when.when(F.col("percent"), "percent").when(F.col("currency"), "currency").when(F.col("whole") & (F.col("zeros") | F.col("is_id")), "identifier")
    when = when.when(F.col("number") & F.col("exponent"), "scientific").when(F.col("whole"), "integer").when(F.col("number"), "float")
    when = when.when(F.col("unique") <= F.greatest(F.lit(20).cast("long"), F.expr("known div 2")), "categorical").otherwise("string")
    rows = rows.withColumn("type", when)
    # numbers with a symbol count only where the whole column has it, whatever the order of rows; they are never plain ones
    bare = F.coalesce("x", F.when(text, numbers.plain(value)))
    found = counts.select("index", "n", bare.alias("bare"), F.when(text & bare.isNull(), F.coalesce(numbers.currency(value, True), numbers.percent(value, True))).alias("other"))
    found = found.select("index", F.col("other").isNotNull().alias("affixed"), "n", F.coalesce("bare", "other").alias("x")).filter("x is not null")
    off, total = F.col("x") - F.col("median"), F.sum("n")
    # the mean is within a standard deviation of the median, so that this difference of squares keeps its digits
    spread = F.sum(n * off * off) / total - (F.sum(n * F.col("x")) / total - F.max("median")) * (F.sum(n * F.col("x")) / total - F.max("median"))
    stats = found.join(F.broadcast(order.medians(found, ["index", "affixed"], few=True)), ["index", "affixed"]).groupBy("index", "affixed")
    stats = stats.agg(F.min("x").alias("min"), F.max("x").alias("max"), (F.sum(n * F.col("x")) / total).alias("mean"), F.max("median").alias("median"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("std"))
    rows = rows.withColumn("affixed", F.when(F.col("type") != "identifier", F.col("type").isin("currency", "percent"))).join(F.broadcast(stats), ["index", "affixed"], "left")
    return rows.select("index", "name", "type", (F.col("rows") - F.col("known")).alias("nulls"), F.col("known").alias("non_nulls"), "unique", "min", "max", "mean", "median", "std").orderBy("index")


def top_values_table(df: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """index, value, n, rank: the k most frequent values of every column, in one pass."""
    parts = [F.struct(F.lit(i).alias("index"), F.trim(F.col(f"`{f.name}`").cast("string")).alias("value")) for i, f in enumerate(df.schema.fields)]
    counts = df.select(F.inline(F.array(*parts))).filter(~texts.is_null_token(F.col("value"))).groupBy("index", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("index").orderBy(F.desc("n"), F.upper("value"), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def profiles(df: DataFrame, names: list[str] | None = None, hints: list[Hint | None] | None = None, sample: int | None = None) -> list[Profile]:
    """The profile of every column, with declared types in place of inferred ones."""
    tops: dict[int, list[tuple[str, int]]] = {}
    for r in top_values_table(df.limit(sample) if sample else df).orderBy("index", "rank").collect():
        tops.setdefault(r["index"], []).append((r.value, r.n))
    out = []
    for r in profile_table(df, names, sample).collect():
        hint = hints[r["index"]] if hints else None
        kind = hint.type if hint else r.type
        numeric = {k: r[k] for k in ("min", "max", "mean", "median", "std")} if r["min"] is not None else None
        out.append(Profile(r["index"], r.name, kind, r.nulls, r.non_nulls, r.unique, numeric if not hint or kind in NUMERIC_TYPES else None, tops.get(r["index"], [])))
    return out
