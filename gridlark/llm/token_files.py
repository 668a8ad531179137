"""Token ids in binary shards, compressed by Re-Pair grammars with random access.

Documents are range-partitioned and sorted by id, tokenized, and written as
shards. In each shard frequent adjacent id pairs are replaced by nonterminals,
round after round, until no pair is left whose rule would pay: first within
words, where each distinct word stands for all its occurrences, then across
them. A round replaces many pairs at once, an occurrence giving way to an
overlapping one of a more frequent pair. No rule crosses a document's end, so
that a document is a stretch of the compressed sequence; expansion lengths of
the rules make any position addressable.

Shard layout, little-endian: magic "RPR1"; counts of documents, rules,
sequence symbols and ids, and the first nonterminal (5 x uint32); then arrays:
ids of the documents (int64), 1 where such an id is null (uint8), ids per
document (uint32), symbols per document (uint32), left and right of each rule
(uint32), expansion length of each rule (uint32), the sequence (uint32).
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from contextlib import nullcontext
from functools import cache
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, keep_memory, release_memory, written

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Stands for the end of a text among its words; no word is white space.
_END = b"\n"
#: Ids per shard, about; a longer document is a shard of its own.
SHARD_IDS = 1 << 20
#: A rule takes three numbers and saves one for each use, so that it pays from four uses on.
LEAST_USES = 4
#: Bits of the table that counts pairs by a hash; pairs that share a slot are told apart in a later round.
PAIR_BITS, EXACT_PAIRS = 20, 1 << 16
#: Words whose ids are remembered per process; at this number the memory starts anew with the next shard.
CACHED_WORDS = 800_000
#: Texts that are encoded together, in bytes; each of their distinct words is looked up once.
ENCODED_BYTES = 1 << 22
#: Freed memory that a process keeps for its next arrays, and that a lean one keeps.
KEPT_BYTES, LEAN_BYTES = 64 << 20, 1 << 18
#: New words that are encoded at a time.
LEARNED_WORDS = 1 << 14

MAGIC = b"RPR1"
SHARD_SCHEMA = "part int, shard int, docs long, ids long, payload binary"


# -- tokenizing --------------------------------------------------------------------------------


@cache
def tokenizer(path: str | None = None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))


#: Steps of the vocabulary's file for which plain words may go straight to its merges (fixed values).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: In a line, Latin letters that normalise to their lower case only, then signs without the apostrophe; nothing of any other line.
_PLAIN = re.compile(r"^(?:([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]++)([!-&(-/:-@\[-`{-~]*+)$|.*$)", re.MULTILINE)
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
_BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


class Words(dict):
    """Numbers of the words met so far, whose ids lie one after the other; new words are encoded when a text has them.

    Letters and the signs that end a word are different pieces for the pre-tokenizer, so that a word with signs is put
    together from the word without and the signs. New words are taken apart and put together many at a time. Plain words go straight to the vocabulary's merges, all others through the whole tokenizer. Number 0 is the end.
    """

    def __init__(self, path: str | None = None) -> None:
        super().__init__()
        self.tokenizer = tokenizer(path)
        self.merges = self.tokenizer.model
        # the steps by themselves; with the vocabulary they would take tens of megabytes
        normal, before = (json.loads(x.__getstate__()) if x is not None else {} for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        split = before["pretokenizers"][0].get("pattern", {}).get("Regex") if before.get("type") == "Sequence" else None
        self.direct = normal == _NORMALIZER and split == _SPLIT
        #: Strings that the tokenizer takes out of a text before anything else, white space around them or not.
        self.special = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        firsts = {x[0] for x in self.special}
        #: A sign that a text with any of them has.
        self.sign = firsts.pop() if len(firsts) == 1 and not next(iter(firsts)).isalpha() else ""
        self.start_anew()

    def start_anew(self) -> None:
        self.clear()
        # white space at either end of a text leaves an empty word, which has no number
        self[_END], self[b""] = 0, -2
        self.signs: dict[str, int] = {"": -1}
        self.ids, self.begin = array("I", [END_ID]), array("q", [0, 1])

    def pieces(self, found: list[str]) -> range:
        chars = [s if s.isascii() else "".join([_BYTE_CHARS[b] for b in s.encode()]) for s in found]
        made = list(map(self.merges.tokenize, chars))
        return self.add([t.id for x in made for t in x], made)

    def whole(self, texts: list[str]) -> range:
        found = [self.tokenizer.encode(s, add_special_tokens=False).ids for s in texts]
        return self.add(list(chain.from_iterable(found)), found)

    def add(self, ids: list[int], lists: list[list]) -> range:
        """Numbers for lists with these ids."""
        self.ids.extend(ids)
        return self.number(np.fromiter(map(len, lists), np.int64, len(lists)))

    def number(self, sizes: np.ndarray) -> range:
        first = len(self.begin) - 1
        self.begin.frombytes((self.begin[-1] + np.cumsum(sizes)).tobytes())
        return range(first, first + len(sizes))

    def learn(self, new: list[bytes]) -> np.ndarray:
        """Numbers for words that have none, all at once."""
        letters, signs = zip(*(_PLAIN.findall(b"\n".join(new).decode()) if self.direct else [("", "")] * len(new)), strict=True)
        low = "\n".join(letters).lower()
        keys = low.encode().split(b"\n")
        numbers = np.fromiter(map(self.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(numbers == -1).tolist()
        if missing:
            lines = low.split("\n")
            fresh = {keys[k]: lines[k] for k in missing}
            self.update(zip(fresh, self.pieces(list(fresh.values())), strict=True))
            numbers[missing] = [self[keys[k]] for k in missing]
        others = np.flatnonzero(numbers < 0).tolist()
        numbers[others] = self.whole([new[k].decode() for k in others])
        distinct = [x for x in dict.fromkeys(signs) if x not in self.signs]
        self.signs.update(zip(distinct, self.pieces(distinct), strict=True))
        ending = np.fromiter(map(self.signs.__getitem__, signs), np.int64, len(signs))
        both = np.flatnonzero(ending >= 0)
        pairs = np.stack([numbers[both], ending[both]], 1).ravel()
        ids, sizes = self.ids_of(pairs).tobytes(), self.sizes(pairs).reshape(-1, 2).sum(1)
        self.ids.frombytes(ids)
        numbers[both] = self.number(sizes)
        self.update(zip(new, numbers.tolist(), strict=True))
        return numbers

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Numbers of the words of whole texts and the end. No token spans two words, as the pre-tokenizer drops white space.

        A text with a special string is encoded as a whole and counts as one word.
        """
        if not isinstance(texts, pa.Array):
            texts = pa.array([(t or "").encode("utf-8", "replace").decode() for t in texts], pa.string())
        if not len(texts):
            return []
        texts = pc.fill_null(texts, "")
        marked = np.flatnonzero(pc.match_substring(texts, self.sign)) if self.special else np.zeros(0, np.int64)
        held = {k: t for k in marked.tolist() if any(x in (t := texts[k].as_py()).lower() for x in self.special)}
        if held:
            texts = pc.if_else(pa.array(np.isin(np.arange(len(texts)), list(held))), "", texts)
        # each distinct word is looked up once
        split = pc.ascii_split_whitespace(texts)
        found = split.flatten().dictionary_encode()
        distinct = _parts(found.dictionary)
        number = np.fromiter(map(self.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number == -1)
        for k in range(0, len(new), LEARNED_WORDS):
            some = new[k : k + LEARNED_WORDS]
            number[some] = self.learn([distinct[i] for i in some.tolist()])
        numbers = number[found.indices.to_numpy()]
        docs = []
        for k, x in enumerate(np.split(numbers, split.offsets.to_numpy()[1:-1])):
            if k in held:
                # under a key that no word has, so that it is looked up like one
                key = b" " + held[k].encode()
                if key not in self:
                    self[key] = self.whole([held[k]])[0]
                x = np.array([self[key]], np.int64)
            docs.append(np.append(x[x >= 0], 0))
        return docs

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        """How many ids words have."""
        begin = np.frombuffer(self.begin, np.int64)
        return begin[numbers + 1] - begin[numbers]

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of words, one after the other."""
        first = np.frombuffer(self.begin, np.int64)[numbers]
        return np.frombuffer(self.ids, np.uint32)[_runs(first, self.sizes(numbers))]


def _parts(words: pa.Array) -> list[bytes]:
    """The bytes of words, none of which has white space; quicker than ``to_pylist``."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary()))
    return pc.binary_join(whole, b"\n")[0].as_py().split(b"\n") if len(words) else []


def _runs(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for lengths[0] numbers, then from first[1], and so on."""
    upto = np.cumsum(lengths)
    out = np.repeat(first - upto + lengths, lengths)
    out += np.arange(len(out))
    return out


@cache
def words(path: str | None = None) -> Words:
    """The words of this process, which its later tasks go on using."""
    return Words(path)


# -- grammar -----------------------------------------------------------------------------------


class Grammar(NamedTuple):
    base: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray
    #: Symbols of the sequence per document.
    symbols: np.ndarray


class _Rules:
    """Rules so far; symbols from ``base`` on are nonterminals."""

    def __init__(self, base: int) -> None:
        self.base, self.left, self.right = base, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.following = base

    def add(self, pairs: np.ndarray) -> int:
        first = self.following
        self.left.append(pairs // first)
        self.right.append(pairs % first)
        self.following += len(pairs)
        return first

    def lengths(self) -> np.ndarray:
        out, at = np.ones(self.following, np.int64), self.base
        for left, right in zip(self.left, self.right, strict=True):
            out[at : at + len(left)] = out[left] + out[right]
            at += len(left)
        return out[self.base :]


def _classes(keys: np.ndarray, weight: np.ndarray | None, salt: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs that occur often, their class, per such class the pair and its uses, and places of pairs that have to wait.

    A hash of the pairs finds those that can be frequent. If these are few, or on demand, they are counted exactly;
    otherwise of the pairs that share a slot of the hash one is counted and the others have to wait.
    """
    bits = max(10, min(PAIR_BITS, len(keys).bit_length()))
    slot = keys.view(np.uint64) * np.uint64(salt)
    slot >>= np.uint64(64 - bits)
    slot = slot.view(np.intp)
    can = np.flatnonzero((np.bincount(slot, weight, 1 << bits) >= LEAST_USES).take(slot))
    slot, keys = slot.take(can), keys.take(can)
    weight = None if weight is None else weight.take(can)
    if exact or len(can) <= EXACT_PAIRS:
        pairs, of = np.unique(keys, return_inverse=True)
        uses, waiting = np.bincount(of, weight, len(pairs)), can[:0]
    else:
        pairs, of = np.zeros(1 << bits, np.int64), slot
        pairs[slot] = keys
        mine = pairs.take(slot) == keys
        uses = np.bincount(slot, mine if weight is None else mine * weight, 1 << bits)
        can, of, waiting = can[mine], of[mine], can[~mine]
    # only the classes that count are handed on, in their order; slots are many more
    often = uses >= LEAST_USES
    number, mine = np.cumsum(often, dtype=np.int32), often.take(of)
    return can[mine], number.take(of[mine]) - 1, pairs[often], uses[often], waiting


def _keys(seq: np.ndarray, at: np.ndarray, follow: np.ndarray, following: int) -> np.ndarray:
    keys = seq.take(at).astype(np.int64)
    keys *= following
    keys += seq.take(follow)
    return keys


def _settled(at: np.ndarray, follow: np.ndarray, of: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """Which of the pairs at ascending places are replaced, so that none overlap: of neighbours the more frequent one."""
    weight = uses.take(of).astype(np.float64) * len(uses) + of
    beside = follow[:-1] == at[1:]
    before, after = np.full(len(at), -1.0), np.full(len(at), -1.0)
    np.copyto(before[1:], weight[:-1], where=beside)
    np.copyto(after[:-1], weight[1:], where=beside)
    # within a run of one pair, as in "a a a", every second occurrence
    index = np.arange(len(at))
    even = (index - np.maximum.accumulate(np.where(before != weight, index, 0))) % 2 == 0
    take = np.where(before == weight, even, weight > before) & (weight >= after)
    take[1:] &= ~(beside & take[:-1])
    return take


_SALTS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _replace(seq: np.ndarray, ends: np.ndarray, weight: np.ndarray | None, rules: _Rules) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and its ends after all rules that pay; symbols at ``ends`` are in no pair, ``weight`` is how often each place counts.

    After the first round it looks at pairs with a new symbol, and at those that had to wait or lost to a neighbour;
    where that finds nothing, at all pairs, and if these have none to replace it ends.
    """
    n = len(seq)
    # places and symbols mostly fit 32 bits, products of symbols don't
    kind = np.int32 if rules.following + n < 1 << 31 else np.int64
    seq, ends = seq.astype(kind), np.append(ends, True)
    after, before, alive, look = np.arange(1, n + 2, dtype=kind), np.arange(-1, n, dtype=kind), np.ones(n, bool), np.zeros(n, bool)
    at, turn, exact = None, 0, False
    while True:
        whole = at is None
        if whole:
            at = np.flatnonzero(alive)
        follow = after.take(at)
        free = ~(ends.take(at) | ends.take(follow))
        at, follow = at[free], follow[free]
        # no names for the arguments, so that they are freed on the way
        found, of, pairs, uses, waiting = _classes(_keys(seq, at, follow, rules.following), None if weight is None else weight.take(at), _SALTS[turn % 2], exact)
        look[:] = False
        look[at.take(waiting)] = True
        at, follow, turn = at.take(found), follow.take(found), turn + 1
        taken = _settled(at, follow, of, uses)
        look[at[~taken]] = True
        at, follow, of = at[taken], follow[taken], of[taken]
        # overlaps may leave a pair with too few uses
        used = np.bincount(of, None if weight is None else weight.take(at), len(pairs))
        made = np.flatnonzero(used >= LEAST_USES)
        if not len(made):
            if whole and not len(waiting):
                return seq[alive], ends[:n][alive]
            at, exact = None, whole
            continue
        number = np.full(len(pairs), -1)
        number[made] = np.arange(len(made))
        symbol = number.take(of)
        if len(made) < np.count_nonzero(used):
            pays = symbol >= 0
            at, follow, symbol = at[pays], follow[pays], symbol[pays]
        seq[at] = symbol + rules.add(pairs[made])
        alive[follow] = False
        following = after.take(follow)
        after[at], before[following] = following, at
        look[at] = look[np.maximum(before.take(at), 0)] = True
        look &= alive
        at, exact = np.flatnonzero(look), False


def compress(order: np.ndarray, counts: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Grammar:
    """Re-Pair over documents of ``counts`` words each (all positive), given as numbers of words with ``sizes`` ids each."""
    rules = _Rules(int(ids.max()) + 1 if len(ids) else 0)
    # words, each followed by a sign that is in no pair
    seq, ends, weight = np.zeros(len(ids) + len(sizes), ids.dtype), np.zeros(len(ids) + len(sizes), bool), np.zeros(len(ids) + len(sizes))
    ends[np.cumsum(sizes + 1) - 1] = True
    seq[~ends] = ids
    weight[~ends] = np.repeat(np.bincount(order, minlength=len(sizes)), sizes)
    seq, ends = _replace(seq, ends, weight, rules)
    del weight
    sizes = np.diff(np.flatnonzero(ends), prepend=-1) - 1
    short, begin = seq[~ends], np.cumsum(sizes) - sizes
    width = sizes[order]
    seq = short[_runs(begin[order], width)]
    ends = np.zeros(len(seq), bool)
    ends[np.cumsum(width)[np.cumsum(counts) - 1] - 1] = True
    del begin, short, width
    seq, ends = _replace(seq, ends, None, rules)
    return Grammar(rules.base, np.concatenate(rules.left), np.concatenate(rules.right), rules.lengths(), seq, np.diff(np.flatnonzero(ends), prepend=-1))


def expand(sequence: np.ndarray, base: int, left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids of a stretch of the sequence: every symbol is given its room at once, and halves move to their place level by level."""
    sequence = sequence.astype(np.int64)
    rule = sequence >= base
    room = np.ones(len(sequence), np.int64)
    room[rule] = lengths[sequence[rule] - base]
    start = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint32)
    out[start[~rule]] = sequence[~rule]
    at, which = start[rule], sequence[rule] - base
    while len(at):
        first, second = left[which].astype(np.int64), right[which].astype(np.int64)
        one = first >= base
        step = np.ones(len(at), np.int64)
        step[one] = lengths[first[one] - base]
        two, behind = second >= base, at + step
        out[at[~one]], out[behind[~two]] = first[~one], second[~two]
        at, which = np.concatenate([at[one], behind[two]]), np.concatenate([first[one], second[two]]) - base
    return out


# -- shards ------------------------------------------------------------------------------------


def pack(doc_ids: list[int | None], docs: list[np.ndarray], known: Words | None = None) -> bytes:
    """A shard of documents: arrays of ids, or of the numbers of ``known`` words; each has an id at its end."""
    order, counts = np.concatenate(docs).astype(np.int64), np.array([len(d) for d in docs], np.int64)
    seen = np.zeros(int(order.max()) + 1, bool)
    seen[order] = True
    distinct = np.flatnonzero(seen)
    number = np.cumsum(seen) - 1
    if known is None:
        ids, sizes = distinct, np.ones(len(distinct), np.int64)
    else:
        ids, sizes = known.ids_of(distinct), known.sizes(distinct)
    order = number[order]
    lengths = np.add.reduceat(sizes[order], np.cumsum(counts) - counts)
    del seen, distinct, number
    g = compress(order, counts, ids, sizes)
    head = struct.pack("<4s5I", MAGIC, len(docs), len(g.left), len(g.sequence), int(lengths.sum()), g.base)
    arrays = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8), lengths.astype("<u4"), g.symbols.astype("<u4"), g.left.astype("<u4"), g.right.astype("<u4"), g.lengths.astype("<u4"), g.sequence.astype("<u4")]
    return head + b"".join(a.tobytes() for a in arrays)


class Shard:
    """A shard's bytes, readable as a whole, by document and by position."""

    def __init__(self, payload: bytes | pa.Buffer) -> None:
        magic, docs, rules, symbols, self.ids, self.base = struct.unpack_from("<4s5I", payload)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at, out = 24, []
        for n, kind in ((docs, "<i8"), (docs, "u1"), (docs, "<u4"), (docs, "<u4"), (rules, "<u4"), (rules, "<u4"), (rules, "<u4"), (symbols, "<u4")):
            out.append(np.frombuffer(payload, kind, n, at))
            at += out[-1].nbytes
        doc_ids, none, self.counts, self.symbols, self.left, self.right, self.lengths, self.sequence = out
        self.doc_ids = [None if x else int(d) for d, x in zip(doc_ids, none, strict=True)]
        self.ends = np.cumsum(self.symbols, dtype=np.int64)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, without expanding the others."""
        return expand(self.sequence[self.ends[k] - self.symbols[k] : self.ends[k]], self.base, self.left, self.right, self.lengths)

    def all(self) -> np.ndarray:
        return expand(self.sequence, self.base, self.left, self.right, self.lengths)

    def id_at(self, position: int) -> int:
        """The id at a position of the shard: one symbol is found by expansion lengths and followed down its rules."""
        size = np.ones(len(self.sequence), np.int64)
        rule = self.sequence >= self.base
        size[rule] = self.lengths[self.sequence[rule] - self.base]
        upto = np.cumsum(size)
        k = int(np.searchsorted(upto, position, "right"))
        rest, symbol = position - int(upto[k] - size[k]), int(self.sequence[k])
        while symbol >= self.base:
            one = int(self.left[symbol - self.base])
            width = int(self.lengths[one - self.base]) if one >= self.base else 1
            symbol, rest = (one, rest) if rest < width else (int(self.right[symbol - self.base]), rest - width)
        return symbol


def write_shards(docs: DataFrame, vocabulary: str | None = None, shard_ids: int = SHARD_IDS, remembered: int = CACHED_WORDS, lean: bool = False) -> DataFrame:
    """(part, shard, docs, ids, payload): the shards of all documents, in ascending order of id by part and shard.

    They are written in the shared folder and read from there. Null texts count as empty (the end id alone); null
    ids come first; rows that repeat an id follow each other, in order of a hash of the text. Only doc_id and text are
    read, whatever other columns are called. An empty table gives no shards. ``remembered`` words are held by a process,
    about 200 bytes each; fewer take less memory and more time. A ``lean`` process gives freed memory back at once,
    which takes more time too, and is handed no more text at a time than it encodes; neither has an influence on the documents' ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory(LEAN_BYTES if lean else KEPT_BYTES)
        # unlike Arrow's own, the system's pool hands freed memory on to words and arrays
        pa.set_memory_pool(pa.system_memory_pool())
        encoder, part = words(vocabulary), TaskContext.get().partitionId()
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = shard = 0

        def full() -> pa.RecordBatch:
            payload = pack(ids, held, encoder)
            if lean:
                release_memory()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], names=["part", "shard", "docs", "ids", "payload"])

        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64)
            for k in np.split(np.arange(batch.num_rows), 1 + np.flatnonzero(np.diff(upto // ENCODED_BYTES))):
                some = batch.slice(k[0] if len(k) else 0, len(k))
                encoded = encoder.encode(some.column(1))
                for doc_id, numbers in zip(some.column(0).to_pylist(), encoded, strict=True):
                    n = int(encoder.sizes(numbers).sum())
                    if held and size + n > shard_ids:
                        yield full()
                        ids, held, size, shard = [], [], 0, shard + 1
                    ids.append(doc_id)
                    held.append(numbers)
                    size += n
                if len(encoder.begin) > remembered:
                    yield full()
                    ids, held, size, shard = [], [], 0, shard + 1
                    encoder.start_anew()
        if held:
            yield full()
        ids, held = [], []
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie).select("doc_id", "text")
    with arrow_batches(docs.sparkSession, ENCODED_BYTES) if lean else nullcontext():
        return written(ordered.mapInArrow(run, SHARD_SCHEMA), "token-shards")[0]


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the shards' bytes; start counts all ids before the document.

    Shard offsets come from the sums of the parts before, and within a part from the shards before; only counts
    take part in that, and the first window has a row for each part.
    """
    sizes = shards.select("part", "shard", "ids")
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("shard_start", F.coalesce(F.sum("ids").over(inside), F.lit(0).cast("long"))).join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                # the batch's own bytes, not copies of all shards at once
                shard = Shard(payload.as_buffer())
                ids, counts = shard.all().astype("<u4"), shard.counts.astype(np.int64)
                ends = np.cumsum(counts)
                view = memoryview(ids).cast("B")
                crcs = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = shards.select("part", "shard", "payload").mapInArrow(run, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
