"""op7 and op8 against brute force."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from gridlark.llm import components, exact_dedup, simhash

from .conftest import odd_rows, rows_of


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in pairs:
        at[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {}
    for r, (i, _) in zip(root, rows, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, root, strict=True)), key=repr)


def test_fingerprint_is_the_majority_of_the_shingles(spark):
    for _, t, *_ in odd_rows():
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    one = spark.createDataFrame([("some words here",)], "t string").select(F.xxhash64("t")).first()[0]
    assert one % 2**64 == simhash.fingerprint("Some words HERE")


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks, rng = simhash.covering_masks(radius), random.Random(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        apart = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(apart & m % 2**64 == 0 for m in masks)


@pytest.mark.parametrize("in_place", [0, 3, 1000])
def test_links_connect_what_all_pairs_connect(spark, in_place):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:8]:
        for _ in range(25):
            fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(3)))
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    expected = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) % 2**64).bit_count() <= 2])
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = [tuple(r) for r in simhash.links(nodes, in_place=in_place).select("a", "b").collect()]
    assert all(((a ^ b) % 2**64).bit_count() <= 2 for a, b in links)
    place = {f: i for i, f in enumerate(fps)}
    assert roots(len(fps), [(place[a], place[b]) for a, b in links]) == expected


def test_components_with_busy_nodes_and_no_room_to_broadcast(spark, monkeypatch):
    """Nodes with many links go back by broadcast and the others by a shuffle, with equal results."""
    hub = [(1000, k) for k in range(300)] + [(k, k + 1) for k in range(2000, 2040)] + [(3000, 3001), (5, 4000)]
    links = spark.createDataFrame(hub, "a long, b long")
    expected = sorted(map(tuple, components.components(links).collect()))
    monkeypatch.setattr(components, "BROADCAST_BYTES", 640)
    assert sorted(map(tuple, components.components(links).collect())) == expected
    assert {r for n, r in expected if n < 2000 or n == 4000} == {0}


def test_components_of_chains_stars_and_cycles(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 40)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    rng = random.Random(3)
    rng.shuffle(pairs)
    found = dict(map(tuple, components.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(61)} | {200 + i: 200 for i in range(40)} | {300: 300, 301: 300, 302: 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_tables(spark, odd, odd_wide, none):
    expected = plain_components([r[:2] for r in odd_rows()])
    shown = lambda df: rows_of(simhash.near_duplicates(df).select("doc_id", simhash.hex16(F.col("fp")), "component_id"))
    assert shown(odd) == expected == shown(odd_wide)
    assert shown(none) == []
    kept = simhash.one_of_each(odd_wide)
    assert kept.columns == odd_wide.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted(i for i, _, c in expected if i is not None and i == c)


def test_large_groups_of_near_copies(spark):
    """Copies with small changes, more than are compared in place."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(4000)]
    texts = [" ".join(base)] * 30
    for i in range(60):
        words = list(base)
        words[rng.randrange(len(words))] = f"x{i}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(found.select("doc_id", simhash.hex16(F.col("fp")), "component_id")) == plain_components(rows)


def plain_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""]), i == best[t or ""]) for i, t in rows), key=repr)


def test_exact_duplicates_of_odd_tables(spark, odd, odd_wide, none):
    rows = [r[:2] for r in odd_rows()]
    assert rows_of(exact_dedup.exact_duplicates(odd)) == plain_exact(rows)
    carried = exact_dedup.exact_duplicates(odd_wide, carry=("_len", "lang"))
    assert carried.columns == ["doc_id", "keep_id", "group_size", "kept", "_len", "lang"]
    assert rows_of(carried.drop("_len", "lang")) == plain_exact(rows)
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With every hash equal, length and content alone decide."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    rows = [(i, t) for i, t in enumerate(["ab", "cd", "ab", "ef", "abc", "", None, "cd", "cd"])]
    assert rows_of(exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_exact(rows)
