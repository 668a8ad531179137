"""Display queries show every row of their table."""

from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from gridlark import catalog
from gridlark.operators import order, pivot, profile
from gridlark.plans.view import view_of
from tests.test_queries import DATA

TABLES = {"currency_display_all": "part", "percent_display_all": "lineitem"}


@pytest.mark.parametrize("name", TABLES)
def test_every_row_is_shown(spark, name):
    found = catalog.QUERIES[name](spark, DATA)
    rows = spark.read.parquet(f"{DATA}/{TABLES[name]}.parquet").count()
    assert rows and found.count() == found.filter("shown is not null").count() == rows


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_profile_counts_values_before_it_reads_them(spark):
    rows = [(i * 37 % 101 - 7.5, f"${i % 13}", f"{i % 7}%" if i % 5 else "n/a", str(i % 9) if i % 2 else f"t{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "x double, p string, s string, m string")
    found = profile.profile_table(df)
    assert "percentile" not in planned(found)
    expected = [[r[0] for r in rows], [i % 13 for i in range(1000)], [i % 7 for i in range(1000) if i % 5], [i % 9 for i in range(1000) if i % 2]]
    for got, numbers in zip(found.collect(), expected, strict=True):
        assert (got.non_nulls, got.min, got.max, got.median) == (1000 if got.name == "m" else len(numbers), min(numbers), max(numbers), statistics.median(numbers))
        assert (got["mean"], got["std"]) == (pytest.approx(statistics.fmean(numbers)), pytest.approx(statistics.pstdev(numbers)))
    none = profile.profile_table(df.limit(0)).collect()
    assert [(r.type, r.nulls, r.unique, r.median) for r in none] == [("empty", 0, 0, None)] * 4


def test_profile_of_numbers_far_from_zero(spark):
    got = profile.profile_table(spark.range(1000).select((F.col("id") + 1e9).alias("x"))).first()
    assert (got["mean"], got["median"], got["std"]) == (1e9 + 499.5, 1e9 + 499.5, pytest.approx(statistics.pstdev(range(1000)), rel=1e-9))


@pytest.mark.parametrize("few", [True, False])
def test_medians(spark, few):
    rows = [(k, float(i * 31 % 997 // (k or 1)), i % 3 + 1) for k in (None, 1, 2, 3) for i in range(600 if k != 3 else 1)]
    found = order.medians(spark.createDataFrame(rows, "k int, x double, n long").repartition(7), ["k"], few).collect()
    assert {r.k: r.median for r in found} == {k: statistics.median([x for g, x, n in rows for _ in range(n) if g == k]) for k in (None, 1, 2, 3)}


def test_pivot_totals_count_values_before_they_read_them(spark):
    rows = [(i, "ab"[i % 2], "xyz"[i * i % 3] if i % 11 else "n/a", str(i * 7 % 23) if i % 5 else "none", f"c{i % 9}") for i in range(300)]
    v = view_of(spark.createDataFrame(rows, "k int, r string, q string, v string, c string"), ["k"])
    measures = [("m", "v", "median"), ("d", "c", "unique"), ("w", "v", "unique"), ("e", "k", "median"), ("s", "v", "sum"), ("n", "v", "count")]
    found = v.pivot(["r"], ["q"], measures, totals=True)
    assert "percentile" not in planned(found) and "percentile" not in planned(v.pivot(["r"], ["q"], measures)) and "percentile" not in planned(v.group_by(["r"], "v", ["median", "unique"]))
    got = {(t.level, t.r, t.q): tuple(t[m[0]] for m in measures) for t in found.collect()}
    expected = {}
    for k, r, q, n, c in rows:
        q = "null" if q == "n/a" else q
        for at in (("cell", r, q), ("row", r, None), ("column", None, q), ("grand", None, None)):
            expected.setdefault(at, []).append((k, n, c))
    of = lambda cells: [float(n) for _, n, _ in cells if n != "none"]
    assert got == {at: (statistics.median(of(g)), len({c for _, _, c in g}), len({n for _, n, _ in g}), statistics.median(k for k, _, _ in g), sum(of(g)), len(g)) for at, g in expected.items()}
    cells = {(t.r, t.q): t.m for t in v.pivot(["r"], ["q"], measures).collect()}
    assert cells == {(r, q): m[0] for (level, r, q), m in got.items() if level == "cell"}
    cross = pivot.wide(v.unordered, [v.key_of("r")], [v.key_of("q")], pivot.Measure("m", *v.cell("v"), "median")).collect()
    assert {(t.r, q): t[q] for t in cross for q in ("x", "y", "null") if (t.r, q) in cells} == {at: m for at, m in cells.items() if at[1] in ("x", "y", "null")}
    assert v.pivot([], [], measures).collect() == found.filter("level = 'grand'").select(*[m[0] for m in measures]).collect()
    assert v.pivot(["r"], [], [("m", "r", "median")]).first().m == 0.0
