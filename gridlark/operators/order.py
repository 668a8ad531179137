"""Order without gathering: running totals, row positions and medians over range partitions, and sort keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers


def running_total(df: DataFrame, by: list[Column], amount: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows before each in the order ``by``.

    Rows are dealt to range partitions; only the partitions' sums are ordered in one place. The dealt rows are
    persisted, as both the sums and the result read them.
    """
    dealt = df.withColumn("_amount", amount).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()).persist()
    totals = dealt.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    zero = F.lit(0).cast("long")
    before = totals.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), zero)).join(F.broadcast(before), "_part")
    return summed.withColumn(name, F.col("_start") + F.col("_inside")).drop("_amount", "_part", "_start", "_inside")


def positioned(df: DataFrame, by: list[Column], name: str = "_position") -> DataFrame:
    """``df`` with 1-based positions in the order ``by``, which should tell all rows apart."""
    return running_total(df, by, F.lit(1).cast("long"), name).withColumn(name, F.col(name) + 1)


def medians(counts: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
    """keys, median: the exact median of the numbers ``x``, each ``n`` times, of every combination of ``keys``.

    Numbers are dealt to range partitions, of which only counts and bounds are ordered; then the numbers within the
    bounds around each middle are. Bounds are numbers, so the result is right if rows are dealt otherwise another time.
    ``few`` sends all bounds to every executor; without it, their size decides.
    """
    rows = counts.filter("x is not null").select(*keys, "x", "n")
    # a given number of ranges isn't lessened for small tables, whose bounds would be all numbers of a key
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *keys, "x").withColumn("_part", F.spark_partition_id())
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"), F.min("x").alias("_low"), F.max("x").alias("_high"))
    every = Window.partitionBy(*keys)
    sums = sums.select(*keys, "_n", "_low", "_high", F.sum("_n").over(every.orderBy("_low")).alias("_upto"), F.sum("_n").over(every).alias("_all"))
    middles = [F.expr("(_all + 1) div 2"), F.expr("(_all + 2) div 2")]
    holds = [(F.col("_upto") - F.col("_n") < m) & (m <= F.col("_upto")) for m in middles]
    bounds = sums.filter(holds[0] | holds[1]).groupBy(*keys).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.min(F.col("_upto") - F.col("_n")).alias("_before"), F.max("_all").alias("_all"))
    bounds = bounds.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    near = rows.join(F.broadcast(bounds) if few else bounds, [*same, F.col("x").between(F.col("_low"), F.col("_high"))])
    # rows of a number stay apart; whichever of them holds a middle, the number is the same
    upto = F.col("_before") + F.sum("n").over(every.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("_upto", upto)
    at = [F.max(F.when((F.col("_upto") - F.col("n") < m) & (m <= F.col("_upto")), F.col("x"))) for m in middles]
    return near.groupBy(*keys).agg((at[0] * 0.5 + at[1] * 0.5).alias("median"))


def numeric_flags(df: DataFrame, cells: list[tuple[Column, T.DataType]]) -> list[bool]:
    """Which of the cells are all numbers or empty, in one pass over the rows."""
    open_ones = [k for k, (_, kind) in enumerate(cells) if not isinstance(kind, T.NumericType)]
    flags = [True] * len(cells)
    if open_ones:
        tests = [F.coalesce(F.bool_and((numbers.text(cells[k][0]) == "") | numbers.plain(numbers.text(cells[k][0])).isNotNull()), F.lit(True)).alias(f"f{k}") for k in open_ones]
        row = df.agg(*tests).first()
        for k in open_ones:
            flags[k] = row[f"f{k}"]
    return flags


def sort_keys(df: DataFrame, cells: list[tuple[Column, T.DataType]], ascending: list[bool], ties: list[Column]) -> list[Column]:
    """Sort expressions: a key is numeric, empty cells first, where all cells are numbers; else text ignoring case. Ties always ascend."""
    keys = []
    for (c, kind), numeric, up in zip(cells, numeric_flags(df, cells), ascending, strict=True):
        v = F.coalesce(numbers.number(c, kind), F.lit(float("-inf"))) if numeric else F.upper(numbers.text(c))
        keys.append(v.asc() if up else v.desc())
    return keys + [t.asc() for t in ties]
