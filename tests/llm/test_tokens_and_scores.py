"""op9 by round trips, op10 against brute force and as a probability, op2 by held-out accuracy, op3 against plain Python."""

from __future__ import annotations

import math
import os
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridlark.llm import common, licenses, lm_scoring, quality, token_files

from .conftest import odd_rows, prose, rows_of

# -- op9 ---------------------------------------------------------------------------------------


_LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
SPECIAL = ["<|endoftext|> hello", "a <|startoftext|> b", "x<|endoftext|>y", "<|EndOfText|> <| endoftext|>", "<|startoftext|><|endoftext|>"]


def ids_of(text):
    """What the library returns, by an object that nothing else touches."""
    return _LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


def test_words_encode_like_whole_texts():
    texts = ["Hello, World! it's I'll don't", "a\x1cb\x85c\xa0d é é ́x", "Straße ÀÉÎ façade. 東京 \U0001f600 12345 3.14!!", "<|endoftext|> <|startoftext|> x", "  \n\t ", "", None, "ΑΣ ΑΣΑ İI ǅ ﬁ ½", "x" * 5000, "a'b 'a'' ''s '"]
    texts += [t for _, t, *_ in odd_rows()] + SPECIAL
    known = token_files.Words()
    for t, numbers in zip(texts, known.encode(texts), strict=True):
        assert known.ids_of(numbers).tolist() == ids_of(t), t


def test_columns_of_texts_encode_like_lists():
    """Arrow columns, also parts of one; new words come many at a time, and later texts use those met before."""
    texts = [" Cat cat CAT cat! CAT?! dog\t\n", None, "", "   ", "É é É!! ''s it's x1 1x", *SPECIAL, "cat! dog?! \x0b\x0cend\r", "K \u212b \u0130stanbul stra\u00dfe!", "CAT cat! newer dog?!"]
    known = token_files.Words()
    for column in (pa.array(texts).slice(2, 4), pa.array(texts), pa.array(texts).slice(5), pa.array([], pa.string())):
        found = known.encode(column)
        assert [known.ids_of(x).tolist() for x in found] == [ids_of(t) for t in column.to_pylist()]


def test_many_new_words_are_learned_in_parts(monkeypatch):
    asked, learn = [], token_files.Words.learn
    monkeypatch.setattr(token_files.Words, "learn", lambda self, new: asked.append(len(new)) or learn(self, new))
    monkeypatch.setattr(token_files, "LEARNED_WORDS", 7)
    known, text = token_files.Words(), prose(random.Random(4), 60)
    assert known.direct and known.ids_of(known.encode([text])[0]).tolist() == ids_of(text)
    assert max(asked) == 7 and sum(asked) == len(set(text.split()))


def test_shards_of_texts_with_special_strings(spark):
    texts = SPECIAL + ["plain words", None, *SPECIAL]
    found = token_files.read_documents(token_files.write_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in found] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in map(ids_of, texts)]


def test_no_pair_is_left_that_pays():
    rng = random.Random(3)
    known = token_files.Words()
    texts = [" ".join(rng.choice(["the cat", "sat on", "a mat", "unthinkableness", "x", prose(rng, 2)]) for _ in range(300)) for _ in range(6)]
    docs = known.encode(texts)
    shard = token_files.Shard(token_files.pack(list(range(6)), docs, known))
    assert all((shard.document(k) == known.ids_of(d)).all() for k, d in enumerate(docs)) and max(shard.lengths) > 4
    pairs = Counter()
    for k in range(6):
        seq = shard.sequence[shard.ends[k] - shard.symbols[k] : shard.ends[k]].tolist()
        pairs.update(zip(seq, seq[1:-1]))
    # overlapping occurrences, as in "a a a", count once in two
    assert max(n for (a, b), n in pairs.items() if a != b) < 2 * token_files.LEAST_USES


def test_grammar_round_trips_and_random_access():
    rng = np.random.default_rng(0)
    for _ in range(150):
        docs = [np.append(rng.integers(0, 3, rng.integers(0, 80)), 1).astype(np.uint32) for _ in range(rng.integers(1, 40))]
        shard = token_files.Shard(token_files.pack([None, *range(len(docs) - 1)], docs))
        everything = np.concatenate(docs)
        assert (shard.all() == everything).all() and shard.doc_ids[0] is None
        assert all((shard.document(k) == d).all() for k, d in enumerate(docs))
        assert all(shard.id_at(i) == everything[i] for i in rng.integers(0, len(everything), 5))
    many = np.tile(np.arange(7, dtype=np.uint32), 3000)
    packed = token_files.Shard(token_files.pack([1], [np.append(many, 1).astype(np.uint32)]))
    assert len(packed.left) and len(packed.sequence) < len(many) / 3


def test_packing_takes_little_memory_for_each_id():
    rng = np.random.default_rng(5)
    docs = [np.append(rng.zipf(1.3, 400) % 20_000 + 2, 1).astype(np.uint32) for _ in range(1000)]
    tracemalloc.start()
    packed = token_files.pack(list(range(len(docs))), docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (token_files.Shard(packed).all() == np.concatenate(docs)).all()
    # 143 bytes an id with 64-bit places and all slots of the hash, 107 since
    assert most < 125 * 401_000, most / 401_000


def test_lean_shards_are_handed_bounded_batches(spark):
    """A batch has bytes, not rows, for its limit meanwhile; the session's setting is as before after that."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('ab ', 700) AS text")
    name, held = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name, None)
    with common.arrow_batches(spark, 1 << 20):
        found = docs.mapInArrow(run, "n long, size long").collect()
    assert sum(r.n for r in found) == 3000 and max(r.size for r in found) < 1.1 * (1 << 20) and spark.conf.get(name, None) == before
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_files, "written", lambda df, _: (df, held.append(spark.conf.get(name, None))))
        token_files.write_shards(docs, lean=True)
    assert held == [str(token_files.ENCODED_BYTES)] and spark.conf.get(name, None) == before


def test_lean_shards_hold_the_same(odd):
    found = [rows_of(token_files.read_documents(token_files.write_shards(odd, shard_ids=5000, remembered=50, lean=x))) for x in (False, True)]
    assert found[0] == found[1] and len(found[0]) == odd.count()


def test_files_hold_every_document(odd, odd_wide, none):
    for df in (odd, odd_wide):
        found = [tuple(r) for r in token_files.read_documents(token_files.write_shards(df, shard_ids=5000)).collect()]
        expected = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ((i, ids_of(t)) for i, t, *_ in odd_rows()))
        assert Counter((i, n, c) for i, _, n, c in found) == expected
        at = 0
        for i, start, n, _ in sorted(found, key=lambda r: r[1]):
            assert start == at
            at += n
        order = [i for i, *_ in sorted(found, key=lambda r: r[1])]
        assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert token_files.read_documents(token_files.write_shards(none)).count() == 0


# -- op10 --------------------------------------------------------------------------------------


def tokens(t):
    return lm_scoring.tokens(t) + [b"\n"]


def test_base_score_and_counts(odd, odd_wide, none):
    rows = odd_rows()
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    seen = Counter(w for i, t, *_ in rows if not out(i) for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    expected = sorted(((i, out(i), len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n, round(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 5)) for i, t, *_ in rows), key=repr)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5)]
    first = lm_scoring.score_documents(odd)
    assert rows_of(first.select(*columns)) == expected
    again = lm_scoring.score_documents(odd_wide)
    assert rows_of(again.select(*columns)) == expected
    assert rows_of(first.select("doc_id", F.round("score", 6))) == rows_of(again.select("doc_id", F.round("score", 6)))
    assert lm_scoring.score_documents(none).count() == 0


def test_few_head_words_give_the_same_base(odd, monkeypatch):
    whole = rows_of(lm_scoring.score_documents(odd).select("doc_id", "n_known", F.round("base_score", 5)))
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 3)
    assert rows_of(lm_scoring.score_documents(odd).select("doc_id", "n_known", F.round("base_score", 5))) == whole


def learned(lines, bits):
    code = lm_scoring.Code.of(lines)
    tables = [lm_scoring.Table(b) for b in bits]
    for some in lm_scoring.batches_of(iter(lines)):
        d = lm_scoring.Decisions(some, code, stretches=False)
        for table, context in zip(tables, d.contexts, strict=True):
            table.learn(context, d)
    return lm_scoring.Model(code, [lm_scoring.Odds.of(t) for t in tables])


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return learned([lm_scoring.line(lm_scoring.tokens(prose(rng, 120))) for _ in range(200)], [16, 18, 18, 18])


def plain_contexts(x, at):
    """The contexts of the byte at a place of a line, spelled out."""
    before = b"\n" * 8 + x[:at]
    pair = lm_scoring_tree(before)
    beyond = [b for b in x[:at] if 0x80 <= b < 0xC0]
    script = ("byte", beyond[-1]) if beyond else ("none", (at >= 7) + (at >= 63) + (at >= 511))
    words = x[:at].split(b" ")
    so_far, last = words[-1][-8:], words[-2][-8:] if len(words) > 1 else None
    return pair, [(before[-3:], script, pair), (so_far, script, pair), (so_far, script, pair, last), before[-5:]]


def lm_scoring_tree(before):
    return before[-1], before[-2]


def plain_scores(train, lines, code):
    """The model bit by bit, with a dictionary for each context and no table."""
    c = lm_scoring
    counts = [{} for _ in range(4)]

    def bits(x):
        for at, byte in enumerate(x):
            (one, two), contexts = plain_contexts(x, at)
            path = int(code.tree_of[one << 8 | two]) * 256 + byte
            steps = code.places[code.begin[path] : int(code.begin[path]) + int(code.length[path])].tolist()
            tree = int(code.tree_of[one << 8 | two])
            yield at, [(*k[:2], tree, *k[3:]) if isinstance(k, tuple) else k for k in contexts], steps

    for x in train:
        for _, contexts, steps in bits(x):
            for table, k in zip(counts, contexts, strict=True):
                slots = table.setdefault(k, {})
                for s in steps:
                    slots[s] = slots.get(s, 0) + 1

    def odds(table, k, place):
        slots = table.get(k, {})
        n, m = slots.get(2 * place + 1, 0), slots.get(2 * place, 0)
        return max(-127, min(127, round(math.log((n + c.PRIOR) / (m + c.PRIOR)) * c.STEPS))) / c.STEPS

    out = []
    for x in lines:
        weights, shift, total = np.full((4, c.GATES), c.FIRST_WEIGHT), np.zeros(c.LEVELS), 0.0
        held, last = [], int(c.stretch_of(np.array([len(x) - 1]))[0])
        number = c.stretch_of(np.arange(len(x))).tolist()
        for at, contexts, steps in bits(x):
            met = [k in t for t, k in zip(counts, contexts, strict=True)]
            rows = [[odds(t, k, s >> 1) for t, k in zip(counts, contexts, strict=True)] for s in steps]
            gate = met[2] + 2 * met[1] + 4 * (abs(sum(rows[0])) > 4)
            for row, s in zip(rows, steps, strict=True):
                mixed = max(-c.LIMIT, min(c.LIMIT, float(weights[:, gate] @ row)))
                level = int(max(-c.LEVELS // 2, min(c.LEVELS // 2 - 1, mixed))) + c.LEVELS // 2
                mixed = max(-c.LIMIT, min(c.LIMIT, mixed + shift[level]))
                sign = -1 if s & 1 else 1
                total -= math.log1p(math.exp(sign * mixed))
                wrong = 1 / (1 + math.exp(-sign * mixed))
                held.append((gate, level, row, wrong * sign, wrong * (1 - wrong)))
            if number[at] < last and number[at + 1] != number[at]:
                for g in range(c.GATES):
                    mine = [h for h in held if h[0] == g]
                    curve = sum(h[4] * sum(v * v for v in h[2]) for h in mine) + c.CURB
                    weights[:, g] -= [c.RATE * sum(h[3] * h[2][i] for h in mine) / curve for i in range(4)]
                for v in range(c.LEVELS):
                    mine = [h for h in held if h[1] == v]
                    shift[v] -= sum(h[3] for h in mine) / (sum(h[4] for h in mine) + c.CURB)
                held = []
        out.append(total / math.log(10))
    return out


def test_scores_equal_a_plain_model():
    rng = random.Random(7)
    train = [lm_scoring.line(lm_scoring.tokens(t)) for t in [prose(rng, 15) for _ in range(4)] + ["été à la plage où naïve été", "x"]]
    lines = [train[0], b"\n", lm_scoring.line(lm_scoring.tokens(prose(rng, 150) + " été où")), lm_scoring.line([b"new", b"words", b"\xc3\xa9t\xc3\xa9s"])]
    # so many lines that hardly two contexts want the same
    model = learned(train, [22, 22, 22, 22])
    assert model.score(lines) == pytest.approx(plain_scores(train, lines, model.code), rel=2e-3)


def test_parts_of_tables_add_up():
    """Tables of some lines each, merged, give what one table of all lines does where no contexts compete."""
    rng = random.Random(8)
    lines = [lm_scoring.line(lm_scoring.tokens(prose(rng, 40))) for _ in range(20)]
    code = lm_scoring.Code.of(lines)

    def table(some):
        t, d = lm_scoring.Table(20), lm_scoring.Decisions(some, code, stretches=False)
        t.learn(d.contexts[1], d)
        return dict(t.chunks())

    whole, parts = table(lines), [table(lines[:9]), table(lines[9:])]
    for k, part in whole.items():
        found = [lm_scoring.Part.of(p[k].bytes()) for p in parts if k in p]
        both = found[0].plus(found[1]) if len(found) == 2 else found[0]
        same = both.owner == part.owner
        assert same.mean() > 0.99 and (both.counts[same] == part.counts[same]).mean() > 0.999


def test_frequent_contexts_keep_their_line():
    """Two contexts of one line: the one met more often owns it, the other counts as unseen."""
    often, seldom = b"the cat sat\n", b"q\n"
    code = lm_scoring.Code.of([often, seldom])
    t = lm_scoring.Table(5)
    for x in [often] * 6 + [seldom] + [often] * 3:
        d = lm_scoring.Decisions([x], code, stretches=False)
        t.learn(np.full(len(x), 1 << 60 if x == often else 3 << 30, np.uint64), d)
    line, check = lm_scoring.line_of(np.array([1 << 60, 3 << 30], np.uint64), t.lines)
    assert line.tolist() == [1, 1] and t.owner[1] == check[0] != check[1]


def test_all_contexts_are_counted(spark, monkeypatch):
    """Every context of the training documents has its counts, in whatever ranges: scores are those of dictionaries."""
    rng = random.Random(12)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(60)] + [None, "été à la plage"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = [lm_scoring.line(lm_scoring.tokens(t)) for t in texts]
    learns = [x for i, x in enumerate(lines) if zlib.crc32(str(i).encode()) % 5 != 1]
    wanted = plain_scores(learns, lines, lm_scoring.Code.of(learns))
    for span in (1 << 23, 1000):
        monkeypatch.setattr(lm_scoring, "RANGE_BYTES", span)
        found = {r.doc_id: r.score for r in lm_scoring.score_documents(docs).collect()}
        assert [found[i] for i in range(len(texts))] == pytest.approx(wanted, rel=1e-4)


def test_requests_are_small():
    """What a block asks for comes back as it was, in order of contexts, and packs into less than rows of a hash, a path and a number do."""
    zstandard = pytest.importorskip("zstandard")
    rng = random.Random(13)
    lines = [lm_scoring.line(lm_scoring.tokens(prose(rng, 200))) for _ in range(150)]
    d = lm_scoring.Decisions(lines, lm_scoring.Code.of(lines))
    pack, size, plain = zstandard.ZstdCompressor(level=1).compress, 0, 0
    for context in d.contexts:
        asked = lm_scoring.Asked(context, d.path, 3)
        assert (asked.context[1:] >= asked.context[:-1]).all() and (asked.context[asked.of] == context).all() and (asked.path[asked.of] == d.path).all()
        at = 0
        for k, end in enumerate(asked.ends.tolist()):
            mine = asked.context[at:end], asked.path[at:end], np.bincount(asked.of, minlength=len(asked.path))[at:end]
            assert all((a == b).all() for a, b in zip(lm_scoring.requested(lm_scoring.request(*mine)), mine, strict=True))
            assert ((mine[0] >> np.uint64(32)) * np.uint64(3) >> np.uint64(32) == k).all()
            size += len(pack(lm_scoring.request(*mine)))
            plain += len(pack(mine[0].astype("<u8").tobytes() + mine[1].astype("<u4").tobytes() + mine[2].astype("<u4").tobytes()))
            at = end
    assert size < 0.9 * plain


def test_waves_and_turns_leave_nothing_out(spark, monkeypatch):
    """Small blocks, parts, ranges and waves give the scores of dictionaries, and of the files between only those of the words and results stay."""
    rng = random.Random(14)
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(50)] + [None, "été à la plage", prose(rng, 600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = [lm_scoring.line(lm_scoring.tokens(t)) for t in texts]
    learns = [x for i, x in enumerate(lines) if zlib.crc32(str(i).encode()) % 5 != 1]
    wanted = plain_scores(learns, lines, lm_scoring.Code.of(learns))
    for name, value in (("RANGE_BYTES", 700), ("BLOCK_BYTES", 1500), ("WAVES", 3), ("TURNS", 4)):
        monkeypatch.setattr(lm_scoring, name, value)
    kept = {}
    real = lm_scoring.written
    monkeypatch.setattr(lm_scoring, "written", lambda df, name, *more: kept.setdefault(real(df, name, *more), name) and list(kept)[-1])
    found = {r.doc_id: r.score for r in lm_scoring.score_documents(docs).collect()}
    assert [found[i] for i in range(len(texts))] == pytest.approx(wanted, rel=1e-4)
    left = [name for (_, path), name in kept.items() if os.path.exists(path.removeprefix("file://"))]
    assert sorted(kept.values()) == ["answers"] * 4 + ["blocks"] + ["scored"] * 4 + ["survey"] and sorted(left) == ["scored"] * 4 + ["survey"]


def test_disk_of_a_wave_is_bounded():
    """What a wave asks for and what all are answered pack into few bytes for each byte of text, and come back as they were."""
    zstandard = pytest.importorskip("zstandard")
    rng = random.Random(15)
    lines = [lm_scoring.line(lm_scoring.tokens(prose(rng, 200))) for _ in range(150)] + [lm_scoring.line("été à la plage où".encode().split())]
    size, code, bits, ranges = sum(map(len, lines)), lm_scoring.Code.of(lines), lm_scoring.hash_bits(0), 4
    pack, waves, answers = zstandard.ZstdCompressor(level=1).compress, [], 0
    for predictors, low, high in lm_scoring.waves_of(ranges):
        waves.append(0)
        contexts, path = lm_scoring.bytes_of(lines, code, predictors, bits)
        plain, _ = lm_scoring.Decisions.contexts_of(lines, code, predictors)
        for context, whole in zip(contexts, plain, strict=True):
            # as many contexts as with all bits of the hash
            assert len(np.unique(context)) == len(np.unique(whole)) and (lm_scoring.tree_within(context, bits) == path >> 8).all()
            of = lm_scoring.range_of(context, ranges)
            mine = (of >= low) & (of < high)
            context, byte = context[mine], path[mine] & 255
            learns = np.arange(len(context)) % 3 > 0
            asked = lm_scoring.Asked(context, byte, ranges)
            found = lm_scoring.learned_times(context, byte, learns)
            for a, b in zip(found, (asked.context, asked.path, np.bincount(asked.of, learns, len(asked.path))), strict=True):
                assert (a == b).all()
            paths = lm_scoring.tree_within(asked.context, bits) * 256 + asked.path
            seen, odds = lm_scoring.added(asked.context, paths, found[2], code)
            answer = lm_scoring.told(seen, odds, asked.context, paths, code)
            for a, b in zip(lm_scoring.heard(answer, asked.context, paths, code), (seen, odds), strict=True):
                assert (a == b).all()
            waves[-1] += len(pack(lm_scoring.request(*found)))
            answers += len(pack(answer))
    assert max(waves) < 1.5 * size and answers < size


def test_long_texts_are_scored_in_pieces(model, monkeypatch):
    rng = random.Random(9)
    words = lm_scoring.tokens(prose(rng, 500))
    whole = lm_scoring.line(words)
    monkeypatch.setattr(lm_scoring, "PIECE_BYTES", 1000)
    expected = sum(model.score([whole[i : i + 1000]])[0] for i in range(0, len(whole), 1000))
    assert model.score_texts([[b"a"], words]) == pytest.approx([model.score([b"a\n"])[0], expected])


def test_scores_are_probabilities(model):
    """The probabilities of all bytes that may follow a beginning add up to that of the beginning, so to 1."""
    for start in (b"", b"alp", b"gamma12 d"):
        following = [start + bytes([b]) for b in range(256)]
        total = sum(10.0 ** (model.score([x])[0]) for x in following)
        before = 10.0 ** model.score([start])[0] if start else 1.0
        assert total == pytest.approx(before, rel=1e-4)


def test_scores_do_not_depend_on_the_batch(model):
    rng = random.Random(2)
    lines = [lm_scoring.line(lm_scoring.tokens(prose(rng, rng.choice([0, 1, 30, 400, 3000])))) for _ in range(25)]
    alone = np.array([model.score([x])[0] for x in lines])
    assert np.allclose(alone, model.score(lines), rtol=1e-9)
    assert np.allclose(alone[::-1], model.score(lines[::-1]), rtol=1e-9)


def test_seen_prose_beats_noise(model):
    rng = random.Random(3)
    good = lm_scoring.line(lm_scoring.tokens(prose(rng, 100)))
    noise = bytes(rng.choice(b"abcdefghijklmnop ") for _ in range(len(good) - 1)) + b"\n"
    bits = [-model.score([x])[0] / math.log10(2) / len(x) for x in (good, noise)]
    assert bits[0] < 2.2 < 4 < bits[1]


# -- op2 ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        good = rng.random() < 0.7
        t = prose(rng, rng.randint(3, 80))
        rows.append((i, t if good else rng.choice([t.upper() + "!!", " | ".join(t.split()), "$$ ".join(t.split()), "buy " * 40]), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 5], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_held_out_accuracy(graded):
    rows, docs, labels = graded
    truth = {i: q for i, _, q in rows}
    found = quality.score_documents(docs, quality.train(docs, labels)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_never_read(graded):
    _, docs, labels = graded
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows_of(quality.score_documents(docs, quality.train(docs, labels))) == rows_of(quality.score_documents(docs, quality.train(docs, flipped)))


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95


def test_quality_of_odd_tables(spark, odd, odd_wide, none):
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (4, 0, 1), (None, 1, 0), (100, None, None), (101, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    first = rows_of(quality.score_documents(odd, quality.train(odd, labels)))
    assert first == rows_of(quality.score_documents(odd_wide, quality.train(odd_wide, labels))) and len(first) == len(odd_rows())
    assert {r[2] for r in rows_of(quality.score_documents(odd, quality.train(odd, labels.limit(0))))} == {0.5}
    assert quality.score_documents(none, quality.train(none, labels)).count() == 0


# -- op3 ---------------------------------------------------------------------------------------

NOTICES = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Released under the MIT License.": "mit", "GNU Lesser General Public License": "lgpl", "Redistribution and use in source and binary forms, with or without modification, are permitted provided": "bsd", "All rights reserved.": "proprietary"}
OTHERS = ("the driver showed his license", "A gnu in general is public", "an apache of the plains", "version 3 of the 4.0 story", "licensed to drive", "2.0")


def test_families():
    for t, family in NOTICES.items():
        found = licenses.classify(t)
        assert found[0] == family and found[2] >= licenses.CONFIRMED
    for t in OTHERS:
        assert licenses.classify(t)[0] == licenses.UNKNOWN or licenses.classify(t)[2] < licenses.CONFIRMED


def test_columns_compute_what_plain_python_does(spark, odd_wide, none):
    rng = random.Random(7)
    lines = [*NOTICES, *OTHERS, "", "  "]
    docs = [(i, "\n".join(rng.choice([*lines, prose(rng, 8)]) for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(None, None), (1, "Released under the MIT License.\n" + prose(rng, 4000))]
    expected = []
    for i, t in docs:
        paragraphs = [p for p in (t or "").split("\n") if p.strip(" ")]
        found = [(k, *licenses.classify(p)) for k, p in enumerate(paragraphs)]
        expected.append((i, len(paragraphs), [(k, f, round(p, 6), round(s, 6), s >= licenses.CONFIRMED) for k, f, p, s in found if f != licenses.UNKNOWN]))
    made = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    shown = [(r.doc_id, r.n_paragraphs, [(f.paragraph, f.family, round(f.probability, 6), round(f.similarity, 6), f.confirmed) for f in r.findings]) for r in made]
    assert sorted(shown, key=repr) == sorted(expected, key=repr)
    assert licenses.scan_licenses(odd_wide).count() == len(odd_rows()) and licenses.scan_licenses(none).count() == 0
