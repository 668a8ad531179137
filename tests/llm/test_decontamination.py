"""op5 against brute force on whole words."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gridlark.llm import decontamination as dc

from .conftest import odd_rows, prose, rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    out = []
    tests = [(str(i) if i is not None else "", words(t)) for i, t in items]
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in tests:
            k = min(window, len(x))
            for a in range(len(x) - k + 1 if k else 0):
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == x[a : a + k]:
                        hit |= set(range(b, b + k))
                        found.add(item)
        out.append((i, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(out, key=repr)


def run(docs, items, window=10):
    return rows_of(dc.decontaminate(docs, items, window).select("doc_id", "n_words", "n_hit", "n_items", F.array_join("item_list", ","), "contaminated"))


@pytest.fixture(scope="module")
def tests():
    rng = random.Random(4)
    long = prose(rng, 40)
    return [(1, long), (2, long[: len(long) // 2]), (2, "Quick, brown FOX!"), (3, "quick"), (4, None), (5, " --- "), (None, "the same row"), (6, "a a a a a a a a a a a a a"), (7, prose(rng, 10)), (1, long), (8, "straße 東京")]


def test_against_brute_force(spark, tests):
    rng = random.Random(8)
    docs = [r[:2] for r in odd_rows() if len(r[1] or "") < 10_000]
    pieces = [t for _, t in tests if t]
    for i in range(40):
        a = rng.choice(pieces).split()
        s = rng.randrange(len(a))
        docs.append((500 + i, f"{prose(rng, rng.randint(0, 9))} {' '.join(a[s : s + rng.randint(1, 25)]).upper()}. {prose(rng, 5)} {' '.join(rng.choice(pieces).split()[:12])}"))
    docs += [(700, " ".join(["a"] * 30)), (701, "a " * 9), (702, None), (700, " ".join(["a"] * 30))]
    items = spark.createDataFrame(tests, "item_id long, text string")
    found = run(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert found == brute(docs, tests)
    assert any(r[5] for r in found) and not all(r[5] for r in found)


def test_odd_tables(spark, odd, odd_wide, none, tests):
    items = spark.createDataFrame(tests, "item_id long, text string")
    docs = [r[:2] for r in odd_rows()]
    assert run(odd_wide, items) == brute(docs, tests)
    assert run(none, items) == []
    assert [r[2:] for r in run(odd, items.limit(0))] == [(0, 0, "", False)] * len(docs)
    kept = dc.clean_documents(odd_wide, items)
    assert kept.columns == odd_wide.columns
    bad = {r[0] for r in brute(docs, tests) if r[5]}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in docs if i not in bad), key=repr)


def test_empty_list_has_the_digest_of_nothing(odd, spark):
    r = dc.decontaminate(odd, spark.createDataFrame([], "item_id long, text string")).select(F.sha2(F.array_join("item_list", ","), 256)).first()[0]
    assert r == hashlib.sha256(b"").hexdigest()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x red y fox z"), (2, "fox a b c d e f g red"), (3, "red"), (4, "fox red fox")], "doc_id long, text string")
    items = dc.test_items(spark.createDataFrame([(1, "red fox")], "item_id long, text string"))
    items, _ = dc.written(items, "t")
    vocabulary, _ = dc.written(items.select(F.explode("words").alias("term")).distinct().select("term", F.monotonically_increasing_id().alias("tid")), "v")
    postings, _ = dc.build_index(docs, vocabulary)
    hits = dc.proximity_matches(items, vocabulary, postings, 3).select("d").distinct()
    assert sorted(r.d for r in hits.collect()) == [1, 4]
    assert sorted(r.d for r in dc.proximity_matches(items, vocabulary, postings, 8).select("d").distinct().collect()) == [1, 2, 4]
