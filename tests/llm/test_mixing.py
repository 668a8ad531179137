"""op4 against the SQL restatement, and the splitting tree against what it must keep."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from gridlark.llm import mixing, queries

from .conftest import SCHEMA, odd_rows, rows_of

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Shares by weight, capped at three times the size, what exceeds shared anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        left, open_ = total - sum(done.values()), [s for s in names if s not in done]
        over = [s for s in open_ if weight[s] * left / max(1, sum(weight[x] for x in open_)) > 3 * sizes[s]]
        if not over:
            return done | {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        done |= {s: float(3 * sizes[s]) for s in over}


def plan(df, **kw):
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["words"])
    return mixing.mix(df, **kw).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def test_odd_tables(odd, odd_wide, none):
    rows = [tuple(r) for r in plan(odd).collect()]
    sizes = Counter()
    for _, t, _, s, _ in odd_rows():
        sizes[s] += len(SPACED.findall(t or ""))
    targets = plain_targets(sizes)
    assert sorted(((i, len(SPACED.findall(t or ""))) for i, t, *_ in odd_rows()), key=repr) == sorted(((r[0], r[2]) for r in rows), key=repr)
    taken = Counter()
    for _, s, size, source_size, target, n in rows:
        assert source_size == sizes[s] and target == pytest.approx(targets[s]) and 0 <= n <= 3 * size
        taken[s] += n
    assert all(abs(taken[s] - targets[s]) <= 1 for s in targets)
    assert rows_of(plan(odd_wide)) == rows_of(plan(odd)) == sorted(rows, key=repr)
    assert plan(none).count() == 0


def test_query_is_its_sql(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (i * 7 % 50)), "en", [None, "a", "b", "é", "Z", "tiny"][i % 6] if i < 300 else "hot", 0) for i in range(500)]
    rows = [r if r[3] != "tiny" or r[0] < 20 else (*r[:3], "hot", 0) for r in rows]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = rows_of(queries.op4_mixing(spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = sorted(con.execute(queries.ORACLE_SQL["op4_mixing"]).fetchall(), key=repr)
    assert [r[:3] + (round(r[3], 6), r[4]) for r in found] == [tuple(r[:3]) + (round(r[3], 6), r[4]) for r in expected]


def test_quotas_of_the_tree_are_exact(spark):
    quotas = {0: 1000, 1: 3, 2: 0, 3: 417, 4: 1}
    for shards in (1, 2, 5, 16):
        found = mixing.shard_quotas(spark.createDataFrame(list(quotas.items()), "idx int, quota long"), shards).collect()
        by_source, by_shard = Counter(), Counter()
        for idx, shard, quota in found:
            assert quota >= 0
            by_source[idx] += quota
            by_shard[shard] += quota
        assert by_source == Counter(quotas) and sorted(by_shard) == list(range(shards))
        assert max(by_shard.values()) - min(by_shard.values()) <= shards.bit_length() + 1


def test_hypergeometric_inversion(spark):
    """Evenly spaced u give the distribution's counts."""
    from math import comb

    n = 4000
    for pop, marked, drawn in ((50, 20, 10), (10, 10, 4), (10, 0, 4), (7, 3, 7), (1, 1, 0)):
        sql = mixing._hypergeometric(f"{pop}L", f"{marked}L", f"{drawn}L", f"((id + 0.5D) / {n}D)")
        seen = Counter(r[0] for r in spark.range(n).select(F.expr(sql)).collect())
        for x in range(drawn + 1):
            p = comb(marked, x) * comb(pop - marked, drawn - x) / comb(pop, drawn) if drawn - x <= pop - marked else 0
            assert abs(seen[x] - n * p) <= 1.01
    large = spark.range(1).select(F.expr(mixing._hypergeometric("1000000000L", "300000000L", "100000000L", "0.5D"))).first()[0]
    assert abs(large - 30_000_000) < 10


def test_shards_are_disjoint_and_whole(spark, odd_wide):
    draws = mixing.mix(odd_wide.filter("doc_id >= 100"), shards=4, docs_per_block=3).select("doc_id", "size", F.inline("draws")).collect()
    assert len({(r.doc_id, r["pass"]) for r in draws}) == len(draws)
    assert {r.shard for r in draws} == {0, 1, 2, 3}


def test_mixed_documents(odd_wide):
    made = mixing.mixed_documents(odd_wide)
    assert made.columns == odd_wide.columns
    texts, counts = {}, Counter()
    for i, t, *_ in odd_rows():
        texts.setdefault(i, []).append(t or "")
    for r in made.collect():
        assert any(t.startswith(r.text) for t in texts[r.doc_id]) and SPACED.search(r.text)
        counts[r.source] += len(SPACED.findall(r.text))
    words = Counter({r.source: r.taken for r in plan(odd_wide).groupBy("source").agg(F.sum("taken").alias("taken")).collect()})
    assert +counts == +words
