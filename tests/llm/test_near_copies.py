"""Near copies by exact similarity of five-word shingles, against all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
from gridlark.llm import near_copies
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_duplicates import roots


def plain_sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    """Ids that stay, from all pairs."""
    found = [plain_sets(t) for _, t in rows]
    near = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y)
    of = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if near(found[i], found[j])])
    best = {}
    for k, (i, _) in enumerate(rows):
        best[of[k]] = min(i, best.get(of[k], i))
    return sorted(best.values())


def edited(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_the_stage_finds_what_all_pairs_find(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(60)]
    texts += [edited(rng, t, n) for t in texts[:20] for n in (1, 2, 4, 8)] + [texts[0].upper(), "", None, " ", "three words here", "Three  words here"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == plain_kept(rows)


def test_close_fingerprints_are_candidates(spark):
    """Whatever bits differ, up to the radius, and without any MinHash band."""
    rng = random.Random(10)
    for _ in range(300):
        fp = rng.getrandbits(64)
        other = fp ^ sum(1 << i for i in rng.sample(range(64), near_copies.RADIUS))
        assert set(near_copies.fingerprint_keys(fp)) & set(near_copies.fingerprint_keys(other))
    base = prose(rng, 400)
    rows = [(0, base), (1, f"{base} one"), (2, f"two {base}"), (3, prose(rng, 400))]
    known = near_copies.sketches(spark.createDataFrame(rows, "doc_id long, text string"))
    only = known.selectExpr("node", "fp", f"slice(keys, 1, {2 ** (near_copies.RADIUS + 1) - 1}) AS keys").cache()
    of = {r.doc_id: (r.node, r.fp) for r in known.collect()}
    close = {(min(of[i][0], of[j][0]), max(of[i][0], of[j][0])) for i in of for j in range(i) if (of[i][1] ^ of[j][1]).bit_count() <= near_copies.RADIUS}
    assert close and close <= {tuple(r) for r in near_copies.candidates(only).collect()}
    only.unpersist()


def test_a_large_group(spark):
    """More copies than are compared with each other in a bucket."""
    rng = random.Random(5)
    base = prose(rng, 300)
    rows = list(enumerate([edited(rng, base, 3) for _ in range(150)] + [prose(rng, 100) for _ in range(10)]))
    found = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == plain_kept(rows) == [0, *range(150, 160)]


def test_large_buckets_are_joined_exactly(spark):
    """Groups about one passage, similar within but not between groups: buckets hold many components."""
    rng = random.Random(8)
    passage, texts = prose(rng, 160), []
    for _ in range(12):
        own = f"{passage} {prose(rng, 34)}"
        texts += [edited(rng, own, k) for k in (0, 1, 1, 2, 3)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = near_copies.sketches(docs).select("node", "fp", "keys").distinct().cache()
    alone = known.selectExpr("node", "node AS root")
    assert near_copies.undecided(known, alone).count() > 20
    wanted = plain_kept(rows)
    assert 1 < len(wanted) < len(texts)
    for neighbours in (0, 1, near_copies.NEIGHBOURS):
        found = near_copies.near_copies(docs, neighbours=neighbours).filter("doc_id = component_id").collect()
        assert sorted(r.doc_id for r in found) == wanted
    known.unpersist()


def test_the_exact_join_finds_all_pairs(spark):
    rng = random.Random(9)
    base = [prose(rng, rng.randint(6, 60)) for _ in range(8)]
    texts = list(dict.fromkeys([*base, *[edited(rng, t, k) for t in base for k in (1, 1, 2, 3)]]))
    read = near_copies.sets(spark.createDataFrame([(t,) for t in texts], "text string")).cache()
    nodes = {near_copies.node_of(near_copies.shingles(t)): plain_sets(t) for t in texts}
    signed = {k - (1 << 64) if k >> 63 else k: v for k, v in nodes.items()}
    wanted = {(x, y) for x in signed for y in signed if x < y and 5 * len(signed[x] & signed[y]) >= 4 * len(signed[x] | signed[y])}
    for listed in (1, 3, near_copies.LISTED):
        found = near_copies.links_between(read.selectExpr("node", "node AS root"), read, listed).collect()
        assert {(min(r), max(r)) for r in found} == wanted and wanted
    read.unpersist()


def test_pairs_that_are_not_close_make_no_rows(spark):
    """A dense group just below the similarity: pairs share rare shingles, but only those that may be links become rows."""
    rng = random.Random(11)
    base = prose(rng, 150)
    texts = [edited(rng, base, 5) for _ in range(120)]
    texts += [edited(rng, t, 1) for t in texts[:10]]
    read = near_copies.sets(spark.createDataFrame([(t,) for t in texts], "text string")).cache()
    found = {near_copies.node_of(near_copies.shingles(t)): plain_sets(t) for t in texts}
    signed = {k - (1 << 64) if k >> 63 else k: v for k, v in found.items()}
    wanted = {(x, y) for x in signed for y in signed if x < y and 5 * len(signed[x] & signed[y]) >= 4 * len(signed[x] | signed[y])}
    pairs = {(r.node_a, r.node_b) for r in near_copies.possible(read.selectExpr("node", "node AS root"), read).collect()}
    assert wanted and wanted <= pairs
    assert len(pairs) < 3 * len(wanted) + 120
    for x, y in zip(texts, texts[1:]):
        a, b = near_copies.shingles(x), near_copies.shingles(y)
        differ = sum(int(v).bit_count() for v in near_copies.bitmap(a) ^ near_copies.bitmap(b))
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))
    read.unpersist()


def test_rows_without_ids(spark, none):
    rng = random.Random(6)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(None, a), (3, edited(rng, a, 1)), (None, b), (7, a), (7, prose(rng, 50))]
    found = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in found if r.doc_id is not None) == [3, 7, 7]
    assert b in [r.text for r in found]
    assert near_copies.one_of_each(none).count() == 0
