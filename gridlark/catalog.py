"""Registered queries of the table engine, each with its DuckDB equivalent."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numbers, temporal, texts
from .operators import analytics, pivot, profile, stats
from .operators.filters import Text
from .plans.view import View, view_of
from .sinks import export
from .sources import delimited
from .streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = {"lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "events": ["event_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"], "documents": ["doc_id"], "labels": ["doc_id"], "nation": ["n_nationkey"], "region": ["r_regionkey"]}


def view(spark: SparkSession, sf_dir: str, table: str) -> View:
    return view_of(spark.read.parquet(f"{sf_dir}/{table}.parquet"), KEYS[table])


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, counts as longs."""
    kinds = {"double": lambda c: F.round(c, places), "int": lambda c: c.cast("long")}
    return df.select(*[kinds.get(t, lambda c: c)(F.col(f"`{n}`")).alias(n) for n, t in df.dtypes])


ALL = ["count", "sum", "mean", "median", "min", "max", "unique", "std"]
_ALL_SQL = "CAST(count(*) AS DOUBLE) AS count, round(sum({0}), 4) AS sum, round(avg({0}), 4) AS mean, round(quantile_cont({0}, 0.5), 4) AS median, min({0}) AS min, max({0}) AS max, CAST(count(DISTINCT {0}) AS DOUBLE) AS \"unique\", round(stddev_pop({0}), 4) AS std"

# -- group-by, distinct values, duplicates -------------------------------------------------------


@register(f"SELECT l_returnflag, {_ALL_SQL.format('l_extendedprice')} FROM lineitem GROUP BY l_returnflag")
def group_by_all_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, "lineitem").group_by(["l_returnflag"], "l_extendedprice", ALL))


@register(f"SELECT l_returnflag, l_linestatus, {_ALL_SQL.format('l_quantity')} FROM lineitem GROUP BY ALL")
def group_by_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, "lineitem").group_by(["l_returnflag", "l_linestatus"], "l_quantity", ALL))


@register("SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events").distinct("event_type")


@register("SELECT p_name AS value, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, upper(p_name), p_name LIMIT 10")
def top10_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "part").top("p_name")


@register("SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS members FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def duplicates_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "lineitem")
    groups = v.unordered.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("members"))


@register("SELECT count(*) AS n, min(doc_id) AS first, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS doc_ids FROM documents GROUP BY text HAVING count(*) > 1")
def duplicates_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, "documents").duplicates(["text"])
    return found.select("n", "first", F.array_join(F.transform("rows", lambda x: x.cast("string")), ",").alias("doc_ids"))


@register("SELECT first, n, doc_id AS \"row\" FROM (SELECT doc_id, min(doc_id) OVER g AS first, count(*) OVER g AS n FROM documents WINDOW g AS (PARTITION BY lang, source, n_chars)) WHERE n > 1")
def duplicates_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "documents")
    return analytics.duplicate_rows(v.unordered, [(c, F.col(c)) for c in ("lang", "source", "n_chars")], F.col("doc_id"))


# -- distributions -------------------------------------------------------------------------------


@register("SELECT count(*) AS count, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(stddev_pop(o_totalprice), 4) AS std FROM orders")
def numeric_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, "orders").distribution("o_totalprice"))


_HISTOGRAM = """
WITH x AS (SELECT CAST({0} AS DOUBLE) AS x FROM {1} WHERE {2}), r AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
b AS (SELECT CAST(least({3} - 1, trunc((x - lo) / ((hi - lo) / {3}))) AS BIGINT) AS bin, count(*) AS n FROM x, r GROUP BY 1),
s AS (SELECT unnest(range(0, {3})) AS bin)
SELECT s.bin, round(lo + s.bin * ((hi - lo) / {3}), 4) AS lower, round(CASE WHEN s.bin = {3} - 1 THEN hi ELSE lo + (s.bin + 1) * ((hi - lo) / {3}) END, 4) AS upper, coalesce(n, 0) AS n
FROM s LEFT JOIN b USING (bin), r
"""


@register(_HISTOGRAM.format("o_totalprice", "orders", "true", 10))
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, "orders").histogram("o_totalprice"))


def _date_histogram(period: str, label: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = view(spark, sf_dir, "orders").date_histogram("o_orderdate", period, "o_totalprice")
        return found.select("label", "n", F.round("sum", 2).alias("sum"), F.round("avg", 7).alias("avg"))

    run.__name__ = f"date_hist_{period}"
    register(f"SELECT strftime(o_orderdate, '{label}') AS label, count(*) AS n, round(sum(o_totalprice), 2) AS sum, round(sum(o_totalprice) / count(*), 7) AS avg FROM orders GROUP BY 1")(run)


for _period, _label in (("day", "%Y-%m-%d"), ("week", "%G-W%V"), ("month", "%Y-%m"), ("year", "%Y")):
    _date_histogram(_period, _label)


@register("SELECT strftime(ts, '%Y-%m-%d') AS label, count(*) AS n, 0.0::DOUBLE AS sum, 0.0::DOUBLE AS avg FROM events GROUP BY 1")
def date_hist_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events").date_histogram("ts", "day")


# -- filters -------------------------------------------------------------------------------------


def _filtered(name: str, table: str, columns: str, make: Callable[[View], View], where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(view(spark, sf_dir, table)).select(columns.split(", "))

    run.__name__ = name
    register(f"SELECT {columns} FROM {table} WHERE {where}")(run)


_LINE, _ORDER, _CUSTOMER, _PART = "l_orderkey, l_linenumber", "o_orderkey, o_totalprice", "c_custkey, c_name", "p_partkey, p_name"
_SECONDS = "hour(ts) * 3600 + minute(ts) * 60 + second(ts)"
for _name, _table, _columns, _make, _where in (
    ("filter_numeric_range", "lineitem", _LINE, lambda v: v.range("l_extendedprice", "number", 20000, 40000), "l_extendedprice BETWEEN 20000 AND 40000"),
    ("filter_numeric_open", "part", _PART, lambda v: v.range("p_size", "number", 40), "p_size >= 40"),
    ("filter_date_range", "lineitem", _LINE, lambda v: v.range("l_shipdate", "date", "1995-01-01", "1995-06-30"), "CAST(l_shipdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-06-30'"),
    ("filter_datetime_range", "events", "event_id", lambda v: v.range("ts", "datetime", "2024-01-02 00:00:00", "2024-01-20 12:30:00"), "ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-20 12:30:00'"),
    ("filter_time_range", "events", "event_id", lambda v: v.range("ts", "time", "09:00", "17:30:00"), f"{_SECONDS} + (microsecond(ts) % 1000000) / 1000000.0 BETWEEN 32400 AND 63000"),
    ("filter_values", "orders", _ORDER, lambda v: v.values("o_orderstatus", ["O", "P"]), "o_orderstatus IN ('O', 'P')"),
    ("filter_text_contains", "part", _PART, lambda v: v.text_op("p_name", "contains", "RED"), "contains(upper(p_name), 'RED')"),
    ("filter_text_equals", "nation", "n_nationkey, n_name", lambda v: v.text_op("n_name", "equals", "nation_3"), "upper(n_name) = 'NATION_3'"),
    ("filter_text_starts", "customer", _CUSTOMER, lambda v: v.text_op("c_name", "starts", "customer#00000001"), "starts_with(upper(c_name), 'CUSTOMER#00000001')"),
    ("filter_text_ends", "customer", _CUSTOMER, lambda v: v.text_op("c_name", "ends", "7"), "ends_with(c_name, '7')"),
    ("filter_text_regex", "customer", _CUSTOMER, lambda v: v.text_op("c_name", "regex", "0[12]3$"), "regexp_matches(c_name, '(?i)0[12]3$')"),
    ("filter_text_bad_regex", "customer", _CUSTOMER, lambda v: v.text_op("c_name", "regex", "(["), "false"),
    ("filter_text_in_list", "customer", "c_custkey, c_mktsegment", lambda v: v.text_op("c_mktsegment", "in_list", "building, AUTOMOBILE\nnone"), "upper(c_mktsegment) IN ('BUILDING', 'AUTOMOBILE', 'NONE')"),
    ("filter_text_not_blank", "pages", "page_id", lambda v: v.text_op("url", "not_blank"), "coalesce(url, '') <> ''"),
    ("filter_all", "orders", _ORDER, lambda v: v.values("o_orderstatus", ["F"]).range("o_totalprice", "number", 100000), "o_orderstatus = 'F' AND o_totalprice >= 100000"),
    ("filter_any", "orders", _ORDER, lambda v: v.values("o_orderstatus", ["F"]).range("o_totalprice", "number", 300000).match(True), "o_orderstatus = 'F' OR o_totalprice >= 300000"),
    ("filter_by_cell", "orders", _ORDER, lambda v: v.same_as("o_orderpriority", "1-URGENT"), "o_orderpriority = '1-URGENT'"),
    ("filter_text_any_column", "customer", _CUSTOMER, lambda v: v.text("build"), "contains(upper(c_name), 'BUILD') OR contains(upper(c_mktsegment), 'BUILD') OR contains(CAST(c_custkey AS VARCHAR), 'BUILD')"),
    ("filter_incremental", "orders", _ORDER, lambda v: v.values("o_orderstatus", ["O"]).expr("o_orderpriority = 5-LOW").range("o_totalprice", "number", None, 50000), "o_orderstatus = 'O' AND o_orderpriority = '5-LOW' AND o_totalprice <= 50000"),
    ("expr_and_or", "part", _PART, lambda v: v.expr('p_size >= 45 AND (p_name contains blue OR p_brand = "Brand#11")'), "p_size >= 45 AND (contains(lower(p_name), 'blue') OR p_brand = 'Brand#11')"),
    ("expr_contains", "conversations", "conv_id, turn", lambda v: v.expr("role = user AND text contains THE"), "role = 'user' AND contains(lower(strip_accents(text)), 'the')"),
    ("expr_neq", "customer", _CUSTOMER, lambda v: v.expr("c_mktsegment != BUILDING AND Column1<=200"), "c_mktsegment <> 'BUILDING' AND c_custkey <= 200"),
    ("expr_mixed_compare", "customer", _CUSTOMER, lambda v: v.expr("c_mktsegment > f and c_nationkey<10"), "upper(c_mktsegment) > 'F' AND c_nationkey < 10"),
    ("search_contains", "conversations", "conv_id, turn", lambda v: v.where(v_search(v, "Thé")), "contains(lower(strip_accents(text)), 'the') OR contains(lower(role), 'the')"),
    ("search_regex", "pages", "page_id", lambda v: v.where(v_search(v, "/https?:.*[05]$/", "url")), "regexp_matches(url, '(?i)https?:.*[05]$')"),
    ("search_fuzzy", "part", _PART, lambda v: v.where(v_search(v, "fuzzy: ade", "p_name")), "regexp_matches(lower(p_name), 'a.*d.*e')"),
):
    _filtered(_name, _table, _columns, _make, _where)


def v_search(v: View, text: str, column: str | None = None) -> Column:
    from .operators import search

    return search.query(text).any_of(v.cells() if column is None else [v.cell(column)[0]])


@register("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '') OR o_orderpriority = '2-HIGH'")
def filter_values_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("p", F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_orderpriority")))
    return view_of(rows, ["o_orderkey"]).values("p", ["1-URGENT"], blanks=True).select(["o_orderkey"])


@register("SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'")
def filter_text_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("p", F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_orderpriority")))
    return view_of(rows, ["o_orderkey"]).text_op("p", "blank").select(["o_orderkey"])


@register("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000")
def saved_view_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "customer")
    saved = v.values("c_mktsegment", ["BUILDING"]).range("c_acctbal", "number", 1000).sort(("c_name", False)).hide("c_name").to_json()
    return v.restore(saved).unordered.select("c_custkey")


@register("SELECT * FROM (VALUES (0, 'c_name ⊃ \"x\"'), (2, 'c_nationkey ∈ 2'), (3, 'c_acctbal 0~…')) t(col, text)")
def filter_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view_of(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name", "c_custkey", "c_nationkey", "c_acctbal"), ["c_custkey"])
    v = v.values("c_nationkey", ["1"]).filter(Text(0, "contains", "x")).values("c_nationkey", ["1", "2"]).range("c_acctbal", "number", 0.0)
    return spark.createDataFrame(v.descriptions(), "col int, text string")


# -- search --------------------------------------------------------------------------------------


@register("SELECT conv_id, turn, CASE WHEN contains(lower(role), 'user') THEN 2 ELSE 3 END AS col FROM conversations WHERE contains(lower(role), 'user') OR contains(lower(strip_accents(text)), 'user')")
def search_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "conversations").search("user").select("conv_id", "turn", F.col("_match.column").alias("col"))


@register("SELECT c_custkey, p AS position FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS p FROM customer) WHERE contains(c_mktsegment, 'MACHINERY') ORDER BY p < 100, p LIMIT 1")
def find_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, "customer").sort(("c_acctbal", False)).find_next("machinery", 100, "c_mktsegment")
    return found.select("c_custkey", F.col("_position").alias("position"))


@register("SELECT o_orderkey, p AS position FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS p FROM orders) WHERE o_orderkey = 7")
def goto_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "orders").sort(("o_totalprice", False)).goto(o_orderkey=7).select("o_orderkey", F.col("_position").alias("position"))


@register("SELECT 'c_custkey' AS name, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'c_name', c_name FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer WHERE c_custkey = 5")
def row_inspector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "customer").record(c_custkey=5).filter(F.col("name").isin("c_custkey", "c_name", "c_mktsegment"))


# -- order and projection ------------------------------------------------------------------------


@register("SELECT p_partkey, row_number() OVER (ORDER BY upper(p_brand), p_size DESC, p_partkey) AS position FROM part")
def sort_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "part").sort(("p_brand", True), ("p_size", False)).numbered().select("p_partkey", F.col("_position").alias("position"))


@register("SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size % 7 = 0 THEN -1 ELSE p_size END, p_partkey) AS position FROM part")
def sort_numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_size").cast("string")).alias("size"))
    return view_of(rows, ["p_partkey"]).sort(("size", True)).numbered().select("p_partkey", F.col("_position").alias("position"))


@register("SELECT c_custkey, row_number() OVER (ORDER BY upper(c_mktsegment) DESC, c_custkey) AS position FROM customer")
def sort_text_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "customer").sort(("c_mktsegment", False)).numbered().select("c_custkey", F.col("_position").alias("position"))


@register("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def project_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "customer").hide("c_name", "c_acctbal").df


@register("SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS position FROM supplier QUALIFY position BETWEEN 11 AND 30")
def view_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "supplier").page(11, 20).select("s_suppkey", F.col("_position").alias("position"))


# -- profiles and facets -------------------------------------------------------------------------

_PROFILED = ("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS \"index\", '{c}' AS name, '{t}' AS type, CAST(0 AS BIGINT) AS nulls, count(*) AS non_nulls, count(DISTINCT {c}) AS \"unique\", " + ", ".join((f"round(CAST({f.format(c)} AS DOUBLE), 4)" if numeric else "CAST(NULL AS DOUBLE)") + f" AS {n}" for n, f in (("min", "min({0})"), ("max", "max({0})"), ("mean", "avg({0})"), ("median", "quantile_cont({0}, 0.5)"), ("std", "stddev_pop({0})"))) + " FROM lineitem"
    for i, (c, t, numeric) in enumerate((("l_orderkey", "integer", True), ("l_quantity", "integer", True), ("l_extendedprice", "float", True), ("l_returnflag", "categorical", False), ("l_shipdate", "datetime", False)))
)


@register(_PROFILE_SQL)
def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.profile_table(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_PROFILED)))


_INFERRED = (("flag", "boolean"), ("day", "date"), ("at", "datetime"), ("clock", "time"), ("share", "percent"), ("price", "currency"), ("order id", "identifier"), ("code5", "identifier"), ("tiny", "scientific"), ("n", "integer"), ("x", "float"), ("kind", "categorical"), ("name", "string"), ("none", "empty"))


@register("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}')" for n, t in _INFERRED) + ") t(name, type)")
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    made = [F.when(k % 2 == 0, "yes").otherwise("N"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.format_string("%d:%02d", (k % 24).cast("int"), (k % 60).cast("int")), F.concat(s(k % 100), F.lit("%")), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)), s(k), F.lpad(s(k), 9, "0"), F.concat(s(k), F.lit("e-3")), s(k), F.concat(s(k + 40000), F.lit(".25")), F.when(k % 5 == 0, "n/a").otherwise(F.col("o_orderpriority")), F.concat(F.lit("order "), s(k)), F.when(k % 3 == 0, " NULL ").otherwise("")]
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*[c.alias(n) for c, (n, _) in zip(made, _INFERRED, strict=True)])
    return profile.profile_table(rows).select("name", "type")


@register(_HISTOGRAM.format("l_extendedprice", "lineitem", "true", 6).replace("SELECT s.bin, round", "SELECT round").replace("lower,", "low,").replace("AS upper", "AS high"))
def facet_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, "lineitem").facet("l_extendedprice", "float").drop("label"))


@register("SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, label LIMIT 6")
def facet_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "lineitem").facet("l_returnflag", "categorical").select("label", "n")


@register(_HISTOGRAM.format("l_quantity", "lineitem", "l_returnflag = 'R'", 6).replace("SELECT s.bin, round", "SELECT round").replace("lower,", "low,").replace("AS upper", "AS high"))
def cross_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "lineitem").values("l_returnflag", ["R"])
    return rounded(v.facets({"l_quantity": "float"})["l_quantity"].drop("label"))


# -- pivots --------------------------------------------------------------------------------------


@register("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 4) AS total FROM lineitem GROUP BY ALL")
def pivot_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, "lineitem").pivot(["l_returnflag"], ["l_linestatus"], [("total", "l_extendedprice", "sum")]))


@register("SELECT o_orderpriority, " + ", ".join(f"round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 0), 4) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY 1")
def pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "orders")
    return rounded(pivot.wide(v.unordered, [v.key_of("o_orderpriority")], [v.key_of("o_orderstatus")], pivot.Measure("total", *v.cell("o_totalprice"), "sum")))


@register("SELECT l_returnflag, round(sum(l_quantity), 4) AS s, round(avg(l_discount), 4) AS m, round(quantile_cont(l_tax, 0.5), 4) AS d, CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS u FROM lineitem GROUP BY ALL")
def pivot_multi_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, "lineitem").pivot(["l_returnflag"], [], [("s", "l_quantity", "sum"), ("m", "l_discount", "mean"), ("d", "l_tax", "median"), ("u", "l_suppkey", "unique")]))


@register("SELECT l_linestatus, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL")
def pivot_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "lineitem").pivot([], ["l_linestatus"], [("n", "l_orderkey", "count")], {"l_returnflag": "N", "l_linestatus": None})


@register("SELECT strftime(o_orderdate, '%Y-%m') AS o_orderdate, o_orderstatus, CAST(count(*) AS DOUBLE) AS n, round(max(o_totalprice), 4) AS top FROM orders GROUP BY ALL")
def pivot_date_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, "orders").pivot(["o_orderdate"], ["o_orderstatus"], [("n", "o_orderkey", "count"), ("top", "o_totalprice", "max")], periods={"o_orderdate": "month"}))


@register("SELECT CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE o_orderstatus END AS s, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY ALL")
def pivot_null_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "P", F.when(F.col("o_orderkey") % 2 == 0, " N/A")).otherwise(F.col("o_orderstatus"))
    return view_of(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", s.alias("s")), ["o_orderkey"]).pivot(["s"], [], [("n", "o_orderkey", "count")])


@register("SELECT round(sum(o_totalprice), 4) AS total, round(stddev_pop(o_totalprice), 4) AS spread FROM orders")
def pivot_values_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, "orders").pivot([], [], [("total", "o_totalprice", "sum"), ("spread", "o_totalprice", "std")]))


@register("""SELECT CASE grouping(l_returnflag) * 2 + grouping(l_linestatus) WHEN 0 THEN 'cell' WHEN 1 THEN 'row' WHEN 2 THEN 'column' ELSE 'grand' END AS level, l_returnflag, l_linestatus,
round(sum(l_quantity), 4) AS s, round(quantile_cont(l_extendedprice, 0.5), 4) AS d, CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS u
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())""")
def pivot_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, "lineitem").pivot(["l_returnflag"], ["l_linestatus"], [("s", "l_quantity", "sum"), ("d", "l_extendedprice", "median"), ("u", "l_suppkey", "unique")], totals=True))


@register("SELECT DISTINCT o_orderpriority AS value FROM orders ORDER BY 1 LIMIT 500")
def pivot_filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "orders")
    return pivot.filter_values(v.unordered, v.key_of("o_orderpriority"))


@register("SELECT strftime(o_orderdate, '%Y-%m') AS category, o_orderstatus AS series, CAST(count(*) AS DOUBLE) AS value, 'line' AS chart FROM orders GROUP BY ALL")
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = view(spark, sf_dir, "orders").pivot(["o_orderdate"], ["o_orderstatus"], [("n", "o_orderkey", "count")], periods={"o_orderdate": "month"})
    points, kind = pivot.series(long, ["o_orderdate"], ["o_orderstatus"], "n")
    return points.withColumn("chart", F.lit(kind))


# -- statistics ----------------------------------------------------------------------------------


@register("SELECT 'pearson' AS method, count(*) AS n, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem")
def corr_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, "lineitem").correlation("l_quantity", "l_extendedprice").select("method", "n", "r"), 8)


@register("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT 'spearman' AS method, count(*) AS n, round(corr(a, b), 8) AS r FROM r")
def corr_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(spark, sf_dir, "lineitem").correlation("l_quantity", "l_extendedprice", "spearman").select("method", "n", "r"), 8)


_T_P = "least(1, greatest(0, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * (SELECT sum(pow(1 + pow((i + 0.5) * abs(t) / 20000, 2) / df, -(df + 1) / 2)) * abs(t) / 20000 FROM range(20000) q(i))))"


@register(f"""WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem WHERE l_linestatus IN ('F', 'O') GROUP BY 1),
s AS (SELECT a.n AS n_a, b.n AS n_b, a.m - b.m AS difference, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t,
      pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS df FROM g a, g b WHERE a.g = 'F' AND b.g = 'O')
SELECT n_a, n_b, round(difference, 4) AS difference, round(t, 6) AS t, round(df, 4) AS df, round({_T_P}, 4) AS p FROM s""")
def ttest_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "lineitem").ttest("l_extendedprice", "l_linestatus", ("F", "O"))
    return r.select("n_a", "n_b", F.round("difference", 4).alias("difference"), F.round("t", 6).alias("t"), F.round("df", 4).alias("df"), F.round("p", 4).alias("p"))


@register("WITH d AS (SELECT l_tax - l_discount AS d FROM lineitem) SELECT count(*) AS n, round(avg(d), 8) AS mean_difference, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, CAST(count(*) - 1 AS DOUBLE) AS df, round(avg(d) / stddev_samp(d), 6) AS d FROM d")
def ttest_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "lineitem").paired_ttest("l_discount", "l_tax")
    return r.select("n", F.round("mean_difference", 8).alias("mean_difference"), F.round("t", 6).alias("t"), "df", F.round("d", 6).alias("d"))


@register("""WITH o AS (SELECT l_returnflag a, l_linestatus b, count(*) o FROM lineitem GROUP BY ALL), ra AS (SELECT a, sum(o) na FROM o GROUP BY a), rb AS (SELECT b, sum(o) nb FROM o GROUP BY b), n AS (SELECT sum(o) n FROM o),
x AS (SELECT sum(pow(coalesce(o, 0) - na * nb / n, 2) / (na * nb / n)) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM ra CROSS JOIN rb CROSS JOIN n LEFT JOIN o USING (a, b))
SELECT CAST(n AS BIGINT) AS n, round(chi2, 4) AS chi2, df, round(exp(-chi2 / 2), 8) AS p FROM x, n""")
def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "lineitem").chi_square("l_returnflag", "l_linestatus")
    return r.select("n", F.round("chi2", 4).alias("chi2"), "df", F.round("p", 8).alias("p"))


@register("""WITH o AS (SELECT l_returnflag a, l_linestatus b, count(*) o FROM lineitem GROUP BY ALL), ra AS (SELECT a, sum(o) na FROM o GROUP BY a), rb AS (SELECT b, sum(o) nb FROM o GROUP BY b), n AS (SELECT sum(o) n FROM o)
SELECT a, b, coalesce(o, 0) AS observed, round(CAST(na * nb AS DOUBLE) / n, 4) AS expected FROM ra CROSS JOIN rb CROSS JOIN n LEFT JOIN o USING (a, b)""")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "lineitem")
    return rounded(stats.contingency(v.unordered, F.col("l_returnflag"), F.col("l_linestatus")))


# -- functions on literals -----------------------------------------------------------------------

_NUMBERS = (("1,000", 1000.0), ("(5)", -5.0), ("5-", -5.0), (" +2.5 ", 2.5), ("1e3", 1000.0), ("1d", None), ("0x10", None), ("NaN", None), ("$1,234.5", 1234.5), ("12 €", 12.0), ("7%", 7.0), (".5", 0.5), ("", None), ("abc", None))
_MOMENTS = (("2024-01-05", "2024-01-05 00:00:00", "date"), ("2024/1/5 7:08", "2024-01-05 07:08:00", "datetime"), ("2024-01-05T10:00:00+09:00", "2024-01-05 01:00:00", "datetime"), ("20240229", "2024-02-29 00:00:00", "date"), ("20230229", None, None), ("13/02/2024", "2024-02-13 00:00:00", "date"), ("2024년 3월 1일", "2024-03-01 00:00:00", "date"), ("14:30", "1970-01-01 14:30:00", "time"), ("2024-01", "2024-01-01 00:00:00", "date"), ("hello 12345", None, None), ("99999999", None, None))


def _values(rows: tuple, names: str) -> str:
    quote = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") t({names})"


@register(_values(_NUMBERS, "raw, value"))
def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(r,) for r, _ in _NUMBERS], "raw string").select("raw", numbers.any_number(F.col("raw")).alias("value"))


@register(_values(_MOMENTS, "raw, moment, kind"))
def parse_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.parse(F.col("raw"))
    return spark.createDataFrame([(r,) for r, *_ in _MOMENTS], "raw string").select("raw", F.date_format(found["at"], "yyyy-MM-dd HH:mm:ss").alias("moment"), found["kind"].alias("kind"))


@register("SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def date_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", temporal.label(F.col("o_orderdate"), "week").alias("week"), temporal.label(F.col("o_orderdate"), "month").alias("month"))


@register("SELECT p_partkey, '$' || format('{:,.2f}', p_retailprice) AS shown FROM part WHERE CAST(round(p_retailprice * 100) AS BIGINT) % 10 <> 0")
def currency_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").filter("cast(round(p_retailprice * 100) as bigint) % 10 <> 0")
    return rows.select("p_partkey", numbers.show_currency(F.col("p_retailprice").cast("string"), "$").alias("shown"))


@register("SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) || '%' AS shown FROM lineitem WHERE l_orderkey <= 500")
def percent_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_orderkey <= 500").select("l_orderkey", "l_linenumber", numbers.show_percent(F.round("l_discount", 2).cast("string"), True).alias("shown"))


@register("SELECT p_partkey, '$' || regexp_replace(format('{:,.2f}', p_retailprice), '\\.?0+$', '') AS shown FROM part")
def currency_display_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", numbers.show_currency(F.col("p_retailprice").cast("string"), "$").alias("shown"))


@register("SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) || '%' AS shown FROM lineitem")
def percent_display_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", numbers.show_percent(F.round("l_discount", 2).cast("string"), True).alias("shown"))


@register("SELECT page_id, CASE WHEN length(html) > 1000 THEN left(html, 1000) || ' …' ELSE html END AS shown FROM pages")
def cell_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", texts.preview(F.col("html")).alias("shown"))


# -- exports -------------------------------------------------------------------------------------

_Q = "CASE WHEN regexp_matches({0}, '[,\"\\n\\r]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@register(f"SELECT doc_id, {_Q.format('text')} || ',' || {_Q.format('lang')} AS line FROM documents")
def export_csv_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", export.csv_row([F.col("text"), F.col("lang")]).alias("line"))


@register("SELECT doc_id, '| ' || replace(replace(replace(text, '\\', '\\\\'), '|', '\\|'), chr(10), ' ') || ' | ' || source || ' |' AS line FROM documents")
def export_md_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", export.markdown_row([F.col("text"), F.col("source")]).alias("line"))


@register("SELECT c_custkey, '{\"value\":\"' || c_name || '\",\"value (2)\":\"' || c_mktsegment || '\"}' AS line FROM customer")
def export_json_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", export.json_row(["", "value"], [F.col("c_name"), F.col("c_mktsegment")]).alias("line"))


@register("SELECT page_id, '<tr><td>' || replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(10), '<br>') || '</td></tr>' AS line FROM pages")
def export_html_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", export.html_row([F.col("html")]).alias("line"))


@register("SELECT conv_id, turn, role || chr(9) || replace(replace(text, chr(10), ' '), chr(9), ' ') AS line FROM conversations")
def tsv_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", export.tsv_row([F.col("role"), F.col("text")]).alias("line"))


def _shared_file(spark: SparkSession) -> str:
    """A place for a file that the executors' ``open`` reaches: below the checkpoint folder if that is local, else a temporary one."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()).removeprefix("file://")
    os.makedirs(root, exist_ok=True)
    return f"{root}/{uuid.uuid4().hex}.csv"


def _roundtrip(spark: SparkSession, rows: DataFrame, range_bytes: int) -> DataFrame:
    path = _shared_file(spark)
    export.export(rows, path)
    back, names = delimited.read(spark, path, range_bytes=range_bytes)
    return back.select("_row", *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


@register("SELECT row_number() OVER (ORDER BY c_custkey) AS _row, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment").orderBy("c_custkey"), 1 << 14)


@register("SELECT row_number() OVER (ORDER BY page_id) AS _row, CAST(page_id AS VARCHAR) AS page_id, html, url FROM pages")
def csv_roundtrip_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html", "url").orderBy("page_id"), 1 << 16)


# -- streaming -----------------------------------------------------------------------------------


@register("SELECT event_type, count(*) AS n, round(sum(value), 4) AS sum FROM events WHERE value >= 10 GROUP BY 1")
def events_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    like = spark.read.parquet(path)
    name = f"live_{uuid.uuid4().hex[:8]}"
    stream = live.arriving(spark, sf_dir, like, "events.parquet")
    live.run_available(live.running_counts(stream, ["event_type"], F.col("value"), F.col("value") >= 10), name)
    return rounded(spark.table(name))


@register("SELECT l_returnflag, l_linestatus, CAST(count(*) AS DOUBLE) AS count, round(sum(l_extendedprice), 4) AS sum, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, min(l_extendedprice) AS min, max(l_extendedprice) AS max, CAST(count(DISTINCT l_extendedprice) AS DOUBLE) AS \"unique\", round(stddev_pop(l_extendedprice), 4) AS std FROM lineitem WHERE l_quantity BETWEEN 10 AND 40 GROUP BY ALL")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numeric range, then all aggregates by two keys."""
    return rounded(view(spark, sf_dir, "lineitem").range("l_quantity", "number", 10, 40).group_by(["l_returnflag", "l_linestatus"], "l_extendedprice", ALL))

