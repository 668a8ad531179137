"""Filters, the filter language, search, order and saved views."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridlark.operators import filters
from gridlark.operators.expression import ExpressionError
from gridlark.operators.search import query
from gridlark.plans.view import view_of

PEOPLE = [(1, "bob", "40", "서울"), (2, "al", "20", "부산"), (3, "Carol", "30.0", "서울"), (4, "Dée", "", None), (5, "eve", "n/a", "")]


@pytest.fixture(scope="module")
def people(spark):
    return view_of(spark.createDataFrame(PEOPLE, "_row long, name string, age string, city string"), ["_row"])


def ids(v):
    return [r[0] for r in (v.unordered if hasattr(v, "unordered") else v).select("_row").orderBy("_row").collect()]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("age > 25", [1, 3, 5]), ("age>=30", [1, 3, 5]), ("age<=20", [2, 4]), ("age = 30", []), ('age = "30.0"', [3]), ("city = 서울 AND age > 35", [1]), ("name contains DEE or name contains bo", [1, 4]),
        ("(age = 40 OR age = 20) AND city = 부산", [2]), ("city != 서울", [2, 4, 5]), ("Column1 contains a", [2, 3]), ('name = "b\\ob"', [1]), ("NAME == al", [2]), ("name > bz", [3, 4, 5]),
    ],
)
def test_expressions(people, source, expected):
    assert ids(people.expr(source)) == expected


@pytest.mark.parametrize("source", ["", "  ", "age", "age >", "what = 1", "age ~ 1", "(age > 1", "age > 1)", "age > 1 age > 2", "Column9 = 1"])
def test_wrong_expressions(people, source):
    with pytest.raises(ExpressionError):
        people.expr(source)


def test_column_filters(people):
    assert ids(people.values("city", ["서울"])) == [1, 3]
    assert ids(people.values("city", ["부산"], blanks=True)) == [2, 4, 5]
    assert ids(people.range("age", "number", 20, 35)) == [2, 3]
    assert ids(people.range("age", "number", 30)) == [1, 3]
    assert ids(people.text_op("age", "blank")) == [4] and ids(people.text_op("age", "not_blank")) == [1, 2, 3, 5]
    assert ids(people.text_op("name", "contains", "O")) == [1, 3] and ids(people.text_op("name", "contains", "O", case=True)) == []
    assert ids(people.text_op("name", "equals", "CAROL")) == [3] and ids(people.text_op("name", "starts", "C")) == [3] and ids(people.text_op("name", "ends", "E")) == [4, 5]
    assert ids(people.text_op("name", "regex", "^[ab]")) == [1, 2] and ids(people.text_op("name", "regex", "([")) == []
    assert ids(people.text_op("name", "in_list", "AL, eve\n ,zoe")) == [2, 5]
    assert ids(people.text("서")) == [1, 3] and ids(people.text("o", "name")) == [1, 3]
    assert ids(people.same_as("city", "서울").same_as("name", "bob")) == [1] and ids(people.same_as("city", "")) == [5]


def test_temporal_ranges(spark):
    rows = [(1, "2024-01-05 08:30"), (2, "2024-01-05"), (3, "2024-02-01 23:59:59"), (4, "x"), (5, "09:15")]
    v = view_of(spark.createDataFrame(rows, "_row long, at string"), ["_row"])
    assert ids(v.range("at", "date", "2024-01-05", "2024-01-05")) == [1, 2]
    assert ids(v.range("at", "datetime", "2024-01-05 08:00:00", "2024-02-01 00:00:00")) == [1]
    assert ids(v.range("at", "time", "08:30", "09:15")) == [1, 5]


def test_any_all_clear(people):
    v = people.values("city", ["서울"]).range("age", "number", 20, 20)
    assert ids(v) == [] and ids(v.match(True)) == [1, 2, 3]
    assert ids(v.clear("age")) == [1, 3] and ids(v.clear()) == [1, 2, 3, 4, 5]
    assert ids(people.where(F.length("name") == 3)) == [1, 4, 5]


def test_filter_state_rules():
    s = filters.FilterState().set(filters.Values(0, ("a",))).set(filters.Text(0, "contains", "b")).set(filters.Range(1, "number", 1.0, None))
    assert len(s.filters) == 2 and isinstance(s.filters[0], filters.Text)
    assert filters.FilterState.from_list(s.to_list()) == s
    assert s.set(filters.Range(1, "number")).filters == s.filters[:1]
    assert s.set_all_values(0, ("a", "b"), ("a", "b")).filters == s.filters[1:]
    assert s.descriptions(["n", ""]) == [(0, 'n ⊃ "b"'), (1, "Column2 1~…")]
    assert [filters.suggested(*x) for x in (("integer", 5), ("integer", 50), ("date", 99), ("identifier", 99), ("boolean", 20))] == ["values", "number", "date", "text", "values"]


def test_search(people):
    assert query("  ") is None and query("regex:a+").mode == "regex" and query("/a/").needle == "a" and query("fuzzy: x").needle == "x"
    with pytest.raises(ValueError):
        query("/(/")
    assert ids(people.search("dee")) == [4] and ids(people.search("fuzzy:crl")) == [3] and ids(people.search("regex:^[ae]", "name")) == [2, 5] and ids(people.search("")) == []
    hit = people.search("서울").first()["_match"]
    assert (hit.column, hit.value) == (2, "서울")


def test_order(spark, people):
    by = lambda *keys: [r._row for r in people.sort(*keys).numbered().orderBy("_position").collect()]
    assert by(("name", True)) == [2, 1, 3, 4, 5] and by(("age", False)) == [5, 1, 3, 2, 4] and by(("city", True), ("name", False)) == [5, 4, 2, 3, 1]
    numeric = view_of(spark.createDataFrame([(1, "2"), (2, "10"), (3, ""), (4, "-1"), (5, "2")], "_row long, n string"), ["_row"])
    assert [r._row for r in numeric.sort(("n", True)).numbered().orderBy("_position").collect()] == [3, 4, 1, 5, 2]
    assert [r._row for r in numeric.sort(("n", False)).numbered().orderBy("_position").collect()] == [2, 1, 5, 4, 3]
    v = people.toggle_sort("name").toggle_sort("age", add=True)
    assert v.order == ((0, True), (1, True)) and v.toggle_sort("age", add=True).order == ((0, True), (1, False)) and people.toggle_sort(0).toggle_sort(0).toggle_sort(0).order == ()
    assert people.sort(("name", True)).find_next("서울", 3).first()._position == 3 and people.sort(("name", True)).find_next("서울", 4).first()._position == 2
    assert people.sort(("age", False)).goto(_row=3).first()._position == 3 and [r._row for r in people.page(2, 2).collect()] == [2, 3]


def test_saved_views(people):
    v = people.values("city", ["서울"]).expr("age > 1").text("o").sort(("name", False)).hide("age").match(True).remember_search("fuzzy:abc", "city")
    w = people.restore(v.to_json())
    assert w.to_json() == v.to_json() and ids(w) == ids(v) and w.df.columns == ["name", "city"] and w.found == ("fuzzy:abc", 2)
    assert v.show("age").visible() == [0, 1, 2]


def test_record(people):
    assert [tuple(r) for r in people.record(_row=4).collect()] == [("name", "Dée"), ("age", ""), ("city", "")]


PUSHED = {"filter_numeric_range": "l_extendedprice", "filter_numeric_open": "p_size", "filter_date_range": "l_shipdate", "filter_datetime_range": "ts", "filter_values": "o_orderstatus", "filter_by_cell": "o_orderpriority", "filter_all": "o_totalprice", "filter_any": "o_totalprice", "filter_incremental": "o_orderpriority", "expr_and_or": "p_size", "expr_neq": "c_custkey", "expr_mixed_compare": "c_nationkey"}


def test_filters_reach_the_scan(spark):
    """The column is among the filters that the Parquet reader gets."""
    from gridlark import catalog

    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    for name, column in PUSHED.items():
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
        assert column in pushed.replace(f"IsNotNull({column})", ""), (name, pushed)


def test_typed_comparisons_equal_those_of_text(spark):
    """Whole and double columns, nulls and NaN included, give the rows that their text gives."""
    from pyspark.sql import functions as F

    from gridlark.operators import expression, filters

    rows = [(None, None), (0, 0.0), (-3, -3.5), (7, float("nan")), (30, 30.0), (31, 30.5), (2**31 - 1, 1e10), (-(2**31), -1e-3)]
    df = spark.createDataFrame(rows, "i int, d double")
    for column in ("i", "d"):
        kind = df.schema[column].dataType
        for value in ("30", "30.5", "-3", "0", "-3.5", "007", "1e10", "99999999999", "(3)", "x", "NaN"):
            for op in ("=", "!=", ">", ">=", "<", "<="):
                typed, text = expression.comparison(F.col(column), op, value, kind), expression.comparison(F.col(column).cast("string"), op, value)
                assert df.filter(typed).collect().__repr__() == df.filter(text).collect().__repr__(), (column, op, value)
        for low, high in ((None, 30.0), (30.2, None), (-3.5, 30.0), (0.0, 0.0)):
            typed, text = (filters.Range(0, "number", low, high).condition(c, k) for c, k in ((F.col(column), kind), (F.col(column).cast("string"), df.select(F.col(column).cast("string").alias("t")).schema["t"].dataType)))
            assert df.filter(typed).collect().__repr__() == df.filter(text).collect().__repr__(), (column, low, high)
