"""Numbers, dates, texts and distribution functions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gridlark.functions import numbers, special, temporal, texts


def mapped(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_numbers(spark):
    cases = {"30": 30.0, " 1,234.50 ": 1234.5, "(5)": -5.0, "5-": -5.0, "+7": 7.0, "1e-3": 0.001, ".5": 0.5, "5.": 5.0, "1d": None, "0x1p3": None, "NaN": None, "Infinity": None, "": None, "1 2": None, "--5": None, None: None}
    assert mapped(spark, list(cases), numbers.plain) == list(cases.values())
    assert mapped(spark, ["₩1,000", "1,000원", "12元", "€ 5", "$", "5%", "5"], numbers.any_number) == [1000.0, None, 12.0, 5.0, None, 5.0, 5.0]
    assert mapped(spark, ["$5", "5"], lambda c: numbers.currency(c, True)) == [5.0, None]
    assert mapped(spark, ["12.5 %", "7"], numbers.percent) == [12.5, 7.0]


def test_shown_numbers(spark):
    assert mapped(spark, ["1234567.5", "$3", "abc", "-1000", ""], lambda c: numbers.show_currency(c, "$")) == ["$1,234,567.5", "$3", "abc", "$-1,000", ""]
    assert mapped(spark, ["1000"], lambda c: numbers.show_currency(c, None)) == ["1000"]
    assert mapped(spark, ["0.07", "12%", "x"], lambda c: numbers.show_percent(c, True)) == ["7%", "12%", "x"]
    assert mapped(spark, ["12.50"], numbers.show_percent) == ["12.5%"]


def test_temporal(spark):
    cases = {
        "2024-01-15": ("2024-01-15 00:00:00", "date"), "2024-1-5": ("2024-01-05 00:00:00", "date"), "2024.01.05": ("2024-01-05 00:00:00", "date"), "2024. 01. 05": ("2024-01-05 00:00:00", "date"), "2024/03": ("2024-03-01 00:00:00", "date"),
        "03/04/2024": ("2024-03-04 00:00:00", "date"), "13/04/2024": ("2024-04-13 00:00:00", "date"), "25-12-2024": ("2024-12-25 00:00:00", "date"), "2023-02-30": None, "2024년 1월 5일 7:30": ("2024-01-05 07:30:00", "datetime"),
        "2024-01-05 07:30:59": ("2024-01-05 07:30:59", "datetime"), "2024-01-05T07:30:00Z": ("2024-01-05 07:30:00", "datetime"), "9:05": ("1970-01-01 09:05:00", "time"), "25:00": None, "20240105": ("2024-01-05 00:00:00", "date"),
        "20240105123000": ("2024-01-05 12:30:00", "datetime"), "18991231": None, "21010101": None, "1234": None, "hello": None, "": None, "12345": None,
    }
    found = mapped(spark, list(cases), lambda c: F.struct(F.date_format(temporal.parse(c)["at"], "yyyy-MM-dd HH:mm:ss"), temporal.parse(c)["kind"]))
    assert [None if x[1] is None else tuple(x) for x in found] == list(cases.values())
    assert mapped(spark, ["20240105"], lambda c: temporal.parse(c, compact=False)["kind"]) == [None]


def test_labels(spark):
    at = lambda p: lambda c: temporal.label(temporal.moment(c), p)
    days = ["2024-12-30", "2021-01-03", "9:30", "x"]
    assert mapped(spark, days, at("week")) == ["2025-W01", "2020-W53", None, None]
    assert [mapped(spark, days[:1], at(p))[0] for p in ("day", "month", "year")] == ["2024-12-30", "2024-12", "2024"]


def test_texts(spark):
    assert mapped(spark, ["Café", "CAFE", "tea", ""], lambda c: texts.contains_loosely(c, "café")) == [True, True, False, False]
    assert mapped(spark, ["axbxxc", "ÀxB\nc", "acb"], lambda c: texts.fuzzy_contains(c, " ABC ")) == [True, True, False]
    assert mapped(spark, [" N/A ", "null", "0", None, "Missing"], texts.is_null_token) == [True, True, False, True, True]
    assert mapped(spark, ["x" * 1001, "y"], texts.preview) == ["x" * 1000 + " …", "y"]
    assert texts.stable_keys(["", "a", "a", "value", "a"]) == ["value", "a", "a (2)", "value (2)", "a (3)"]
    assert texts.header_suggests_id("Order ID") and texts.header_suggests_id("고객번호") and not texts.header_suggests_id("paid")
    assert temporal.header_suggests_date("Order Date") and temporal.header_suggests_date("생년월일") and not temporal.header_suggests_date("update")


def test_distributions():
    assert special.t_two_sided(1, 1) == pytest.approx(0.5, abs=1e-9)
    assert special.t_two_sided(2, 5) == pytest.approx(0.10193948, abs=1e-7)
    assert special.chi_square_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.chi_square_upper(10, 2) == pytest.approx(math.exp(-5), abs=1e-12)
    assert special.t_critical(0.05, 10) == pytest.approx(2.2281388520, abs=1e-8)
    assert (special.t_two_sided(math.inf, 3), special.t_two_sided(1, 0), special.chi_square_upper(1, 0), special.t_critical(0.05, 0)) == (0, 1, 1, 0)
    for t, df in ((0.3, 2.5), (4.2, 17), (1.7, 250)):
        steps = 200_000
        density = lambda x: (1 + x * x / df) ** (-(df + 1) / 2)  # noqa: B023, E731
        area = sum(density((i + 0.5) * t / steps) for i in range(steps)) * t / steps
        scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        assert special.t_two_sided(t, df) == pytest.approx(1 - 2 * scale * area, abs=1e-9)
    assert [special.nice_number(x, True) for x in (0.12, 3.4, 68)] == [0.1, 5.0, 50.0] and special.nice_number(68, False) == 100.0
