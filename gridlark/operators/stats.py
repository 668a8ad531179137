"""Correlation, t-tests and chi-square: distributed sums, then distribution functions on one row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special
from .order import running_total

CORRELATION = "method string, n long, r double, t double, df double, p double, interpretation string"
WELCH = "group_a string, group_b string, n_a long, n_b long, mean_a double, mean_b double, difference double, t double, df double, p double, ci_low double, ci_high double, d double, interpretation string"
PAIRED = "n long, mean_difference double, t double, df double, p double, ci_low double, ci_high double, d double, interpretation string"
CHI_SQUARE = "n long, chi2 double, df long, p double, interpretation string"


def _one(spark: SparkSession, schema: str, *values: object) -> DataFrame:
    return spark.createDataFrame([values], schema)


def _pearson(pairs: DataFrame) -> tuple[int, float]:
    """n and r of the finite pairs (x, y); 0 without variance. Moments about the means, by the engine's merging sums."""
    finite = pairs.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    row = finite.agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("a"), F.var_pop("y").alias("b")).first()
    if row.n <= 1 or not row.a or not row.b:
        return row.n, 0.0
    return row.n, max(-1.0, min(1.0, row.c / math.sqrt(row.a * row.b)))


def ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """value → average rank among ties, from counts of the distinct values and a running total over them."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return running_total(counts, [F.col(column)], F.col("_n"), "_before").select(column, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))


def correlation(df: DataFrame, x: Column, y: Column, method: str = "pearson") -> DataFrame:
    """One row: r, t and the two-sided p of Pearson's or Spearman's coefficient."""
    pairs = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).dropna()
    if method == "spearman":
        pairs = pairs.filter(~F.isnan("x") & ~F.isnan("y"))
        pairs = pairs.join(ranks(pairs, "x", "rx"), "x").join(ranks(pairs, "y", "ry"), "y").select(F.col("rx").alias("x"), F.col("ry").alias("y"))
    elif method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    n, r = _pearson(pairs)
    df_ = max(0, n - 2)
    if n <= 2:
        t, p = 0.0, 1.0
    else:
        t = abs(r) * math.sqrt(df_ / max(1e-12, 1 - r * r))
        p = 0.0 if abs(r) >= 1 else special.t_two_sided(t, df_)
    return _one(df.sparkSession, CORRELATION, method, n, r, t, float(df_), p, special.interpretation(p))


def welch(df: DataFrame, value: Column, group: Column, row: Column, pair: tuple[str, str] | None = None) -> DataFrame:
    """Welch's t-test between two groups: the given ones, or the two with most numbers, ties by first appearance."""
    sums = df.select(F.coalesce(group.cast("string"), F.lit("")).alias("g"), value.cast("double").alias("x"), row.alias("_row")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    per = sums.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.min("_row").alias("first"))
    if pair:
        found = {r.g: r for r in per.filter(F.col("g").isin(*pair)).collect()}
        two = [found[g] for g in pair if g in found]
    else:
        two = per.orderBy(F.desc("n"), "first").limit(2).collect()
    if len(two) < 2:
        raise ValueError("two groups with numbers are needed")
    a, b = two
    va, vb = (a.v or 0.0) / a.n, (b.v or 0.0) / b.n
    se, diff = math.sqrt(va + vb), a.m - b.m
    if se == 0:
        t, dof, p = 0.0, float(a.n + b.n - 2), 1.0
    else:
        t = diff / se
        dof = (va + vb) ** 2 / ((va**2 / (a.n - 1) if a.n > 1 else 0) + (vb**2 / (b.n - 1) if b.n > 1 else 0))
        p = special.t_two_sided(t, dof)
    half = special.t_critical(0.05, dof) * se
    pooled = math.sqrt(((a.n - 1) * (a.v or 0.0) + (b.n - 1) * (b.v or 0.0)) / max(1, a.n + b.n - 2))
    return _one(df.sparkSession, WELCH, a.g, b.g, a.n, b.n, a.m, b.m, diff, t, dof, p, diff - half, diff + half, diff / pooled if pooled else 0.0, special.interpretation(p))


def paired(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """Paired t-test of after − before over rows where both are numbers; two such rows are needed."""
    diffs = df.select((after.cast("double") - before.cast("double")).alias("d")).filter(F.col("d").isNotNull() & ~F.isnan("d"))
    row = diffs.agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s")).first()
    if row.n < 2:
        raise ValueError("two pairs of numbers are needed")
    se, dof = row.s / math.sqrt(row.n), float(row.n - 1)
    t, p = (row.m / se, special.t_two_sided(row.m / se, dof)) if se else (0.0, 1.0)
    half = special.t_critical(0.05, dof) * se
    return _one(df.sparkSession, PAIRED, row.n, row.m, t, dof, p, row.m - half, row.m + half, row.m / row.s if row.s else 0.0, special.interpretation(p))


def contingency(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """a, b, observed, expected of every pair of labels, pairs that don't occur too; blank labels count."""
    rows = df.select(F.coalesce(a.cast("string"), F.lit("")).alias("a"), F.coalesce(b.cast("string"), F.lit("")).alias("b"))
    cells = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("observed"))
    by_a, by_b = cells.groupBy("a").agg(F.sum("observed").alias("na")), cells.groupBy("b").agg(F.sum("observed").alias("nb"))
    total = cells.agg(F.sum("observed").alias("n")).first().n or 0
    grid = by_a.join(by_b, F.lit(True))  # labels by labels, the size of the result
    return grid.join(cells, ["a", "b"], "left").select("a", "b", F.coalesce("observed", F.lit(0).cast("long")).alias("observed"), (F.col("na") * F.col("nb") / F.lit(float(max(1, total)))).alias("expected")).orderBy("a", "b")


def chi_square(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row of the test of independence. Only pairs that occur are visited: the sum of O²/E over them, less n."""
    rows = df.select(F.coalesce(a.cast("string"), F.lit("")).alias("a"), F.coalesce(b.cast("string"), F.lit("")).alias("b"))
    cells = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("o"))
    by_a, by_b = cells.groupBy("a").agg(F.sum("o").alias("na")), cells.groupBy("b").agg(F.sum("o").alias("nb"))
    ratio = F.col("o").cast("double") * F.col("o") / (F.col("na").cast("double") * F.col("nb"))
    row = cells.join(by_a, "a").join(by_b, "b").agg(F.sum("o").alias("n"), F.sum(ratio).alias("s"), F.count_distinct("a").alias("ra"), F.count_distinct("b").alias("rb")).first()
    n = row.n or 0
    chi2 = max(0.0, n * ((row.s or 1.0) - 1)) if n else 0.0
    dof = max(0, (row.ra - 1) * (row.rb - 1))
    p = special.chi_square_upper(chi2, dof)
    return _one(df.sparkSession, CHI_SQUARE, n, chi2, dof, p, special.interpretation(p))
