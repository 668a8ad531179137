"""Aggregates, profiles, pivots and statistics on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.operators import analytics, pivot, profile, stats
from gridlark.operators.order import positioned, running_total
from gridlark.plans.view import view_of


def table(spark, rows, *names):
    return view_of(spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "_row long, " + ", ".join(f"{n} string" for n in names)), ["_row"])


def test_duplicates(spark):
    v = table(spark, [("a", "1"), ("b", "2"), ("a", "1"), ("a", "1"), ("", None), (None, "")], "x", "y")
    assert [(r.n, r["first"], r.rows) for r in v.duplicates(["x", "y"]).collect()] == [(3, 1, [1, 3, 4]), (2, 5, [5, 6])]
    lines = analytics.duplicate_rows(v.unordered, [("x", F.col("x")), ("y", F.col("y"))], F.col("_row")).collect()
    assert [tuple(r) for r in lines] == [(1, 3, 1), (1, 3, 3), (1, 3, 4), (5, 2, 5), (5, 2, 6)]


def test_group_by(spark):
    v = table(spark, [("A", "10"), ("A", "20"), ("B", "100"), ("b", "x"), ("B", "")], "k", "v")
    found = {r.k: r.asDict() for r in v.group_by(["k"], "v", list(analytics.FUNCTIONS)).collect()}
    assert found["A"] == {"k": "A", "count": 2, "sum": 30, "mean": 15, "median": 15, "min": 10, "max": 20, "unique": 2, "std": 5}
    assert found["b"] == {"k": "b", "count": 1, "sum": 0, "mean": 0, "median": 0, "min": 0, "max": 0, "unique": 1, "std": 0} and found["B"]["unique"] == 2
    with pytest.raises(ValueError):
        v.group_by(["k"], "v", ["mode"])


def test_distributions(spark):
    v = table(spark, [(str(i),) for i in range(1, 6)] + [("x",)], "n")
    d = v.distribution("n").first()
    assert (d["count"], d.min, d.max, d["mean"], d.median, d.q1, d.q3) == (5, 1, 5, 3, 3, 2, 4) and d.std == pytest.approx(2**0.5)
    assert [(r.bin, r.n) for r in v.histogram("n", 5).collect()] == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1)]
    assert [(r.lower, r.upper, r.n) for r in table(spark, [("7",), ("7",)], "n").histogram("n").collect()] == [(7, 7, 2)]
    assert table(spark, [("a",)], "n").histogram("n").count() == 0 and table(spark, [("a",)], "n").distribution("n").first().max == 0
    gaps = [r.n for r in table(spark, [("0",), ("10",), ("10",)], "n").histogram("n", 5).collect()]
    assert gaps == [1, 0, 0, 0, 2]


def test_date_histogram(spark):
    v = table(spark, [("2024-01-05", "10"), ("2024-01-20", "20"), ("2024-02-10", "30"), ("2024-02-11", "x"), ("no", "9")], "d", "v")
    assert [tuple(r) for r in v.date_histogram("d", "month", "v").collect()] == [("2024-01", 2, 30, 15), ("2024-02", 2, 30, 15)]


def test_facets_and_cross_filter(spark):
    v = table(spark, [(c, str(i)) for i, c in enumerate("aabbbcdefgh")], "c", "n")
    assert [(r.label, r.n) for r in v.facet("c", "string").collect()][:2] == [("b", 3), ("a", 2)] and v.facet("c", "string").count() == 6
    assert sum(r.n for r in v.values("c", ["b"]).facets({"n": "integer"})["n"].collect()) == 3


def inferred(spark, name, values):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("c", T.StringType())]))
    return profile.profile_table(df, [name]).first()


@pytest.mark.parametrize(
    ("name", "values", "kind"),
    [
        ("x", ["", "N/A", None], "empty"), ("x", ["yes", "No", ""], "boolean"), ("x", ["0", "1"], "boolean"), ("x", ["2024-01-05", "2024/2/1"], "date"), ("x", ["20240105"], "date"), ("x", ["2024-01-05", "2024-01-05 10:00"], "datetime"),
        ("x", ["9:30", "10:00:01"], "time"), ("x", ["5%", "7.5 %"], "percent"), ("x", ["5%", "7"], "string"), ("x", ["$5", "1,000₩"], "currency"), ("x", ["007", "12"], "identifier"), ("user id", ["7", "12"], "identifier"),
        ("x", ["1e3", "2"], "scientific"), ("x", ["3", "-4"], "integer"), ("x", ["3.0", "4"], "float"), ("x", ["red", "blue"], "categorical"), ("x", [f"t{i}" for i in range(50)], "string"), ("x", ["5%", "x"] + [f"t{i}" for i in range(50)], "string"),
    ],
)
def test_inferred_types(spark, name, values, kind):
    expected = "categorical" if values == ["5%", "7"] else kind
    assert inferred(spark, name, values).type == expected


def test_profiles(spark):
    df = spark.createDataFrame([("$10", 1.0, "a"), ("$30", 2.0, "a"), ("", None, "b")], "p string, x double, c string")
    p, x, c = profile.profiles(df)
    assert (p.type, p.nulls, p.non_nulls, p.unique, p.numeric["mean"]) == ("currency", 1, 2, 2, 20) and x.numeric["std"] == 0.5 and x.type == "integer"
    assert c.top == [("a", 2), ("b", 1)] and c.numeric is None
    hinted = profile.profiles(df, hints=[profile.Hint("categorical"), None, None])
    assert hinted[0].type == "categorical" and hinted[0].numeric is None


def test_pivot(spark):
    v = table(spark, [("East", "Q1", "100"), ("East", "Q2", "200"), ("West", "Q1", "50"), ("n/a", "Q1", "5"), ("", "Q1", "5")], "r", "q", "v")
    cross = {r.r: r.asDict() for r in pivot.wide(v.unordered, [v.key_of("r")], [v.key_of("q")], pivot.Measure("s", *v.cell("v"), "sum")).collect()}
    assert cross["West"] == {"r": "West", "Q1": 50.0, "Q2": 0.0} and cross["null"]["Q1"] == 10.0 and len(cross) == 3
    totals = v.pivot(["r"], ["q"], [("m", "v", "median"), ("n", "v", "count")], totals=True).collect()
    by = {(t.level, t.r, t.q): (t.m, t.n) for t in totals}
    assert by["grand", None, None] == (50.0, 5.0) and by["row", "East", None] == (150.0, 2.0) and by["column", None, "Q1"] == (27.5, 4.0)
    only = v.pivot(["r"], [], [("n", "v", "count")], {"q": "Q2", "r": None}, totals=True).collect()
    assert {(t.level, t.r, t.n) for t in only} == {("cell", "East", 1.0), ("grand", None, 1.0)}
    assert v.pivot([], [], [("n", "v", "count")]).first().n == 5 and v.pivot([], [], [("n", "v", "count")], totals=True).count() == 1
    assert pivot.allowed_functions("currency") == ("count", "unique") and pivot.usual_period("date") == "month"
    points, kind = pivot.series(v.pivot(["r"], ["q"], [("s", "v", "sum")]), ["r"], ["q"], "s")
    assert kind == "grouped_bar" and points.count() == 4


def test_correlation(spark):
    v = table(spark, [(str(i), str(2 * i), str(-i), "3") for i in range(1, 8)] + [("x", "1", "", "3")], "a", "b", "c", "k")
    up, down = v.correlation("a", "b").first(), v.correlation("a", "c").first()
    assert (up.n, up.r, up.p) == (7, pytest.approx(1), pytest.approx(0, abs=1e-6)) and down.r == pytest.approx(-1)
    flat = v.correlation("a", "k").first()
    assert (flat.r, flat.p) == (0, 1)
    ties = table(spark, [("1", "10"), ("2", "20"), ("2", "15"), ("3", "40"), ("9", "30")], "a", "b")
    assert ties.correlation("a", "b", "spearman").first().r == pytest.approx(0.8720815992)
    assert table(spark, [("1", "2")], "a", "b").correlation("a", "b").first().p == 1
    with pytest.raises(ValueError):
        v.correlation("a", "b", "kendall")


def test_t_tests(spark):
    v = table(spark, [("a", str(x)) for x in (1, 2, 3, 4, 5)] + [("b", str(x)) for x in (3, 4, 5, 6, 7)] + [("c", "1")], "g", "x")
    r = v.ttest("x", "g").first()
    assert (r.group_a, r.group_b, r.difference, r.df) == ("a", "b", -2, 8) and r.t == pytest.approx(-2) and r.p == pytest.approx(0.08051624) and r.d == pytest.approx(-1.2649111)
    assert r.ci_low == pytest.approx(-4.3060042) and v.ttest("x", "g", ("b", "a")).first().difference == 2
    p = table(spark, [("1", "4"), ("2", "3"), ("3", "7"), ("4", "5"), ("5", "8"), ("x", "1")], "b", "a").paired_ttest("b", "a").first()
    assert (p.n, p.mean_difference) == (5, pytest.approx(2.4)) and p.t == pytest.approx(2.4 / (1.8**0.5 / 5**0.5))
    same = table(spark, [("1", "2"), ("2", "3")], "b", "a").paired_ttest("b", "a").first()
    assert (same.t, same.p) == (0, 1)
    with pytest.raises(ValueError):
        table(spark, [("a", "1")], "g", "x").ttest("x", "g")
    with pytest.raises(ValueError):
        table(spark, [("1", "1")], "b", "a").paired_ttest("b", "a")


def test_chi_square(spark):
    rows = [("m", "y")] * 10 + [("m", "n")] * 20 + [("f", "y")] * 20 + [("f", "n")] * 10
    v = table(spark, rows, "a", "b")
    r = v.chi_square("a", "b").first()
    assert (r.n, r.df, r.chi2) == (60, 1, pytest.approx(6.6666667)) and r.p == pytest.approx(0.0098232745) and r.interpretation == "significant"
    assert [(x.a, x.b, x.observed, x.expected) for x in stats.contingency(v.unordered, F.col("a"), F.col("b")).collect()] == [("f", "n", 10, 15), ("f", "y", 20, 15), ("m", "n", 20, 15), ("m", "y", 10, 15)]
    assert table(spark, [("m", "y")], "a", "b").chi_square("a", "b").first().p == 1


def test_positions_and_totals(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    assert positioned(df, [F.col("k").asc()]).filter("_position != k + 1").count() == 0
    assert running_total(df, [F.col("k").asc()], F.col("k"), "s").filter("s != k * (k - 1) / 2").count() == 0
    assert positioned(df.limit(0), [F.col("k").asc()]).count() == 0
