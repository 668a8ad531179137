"""Personal data in texts, found also behind disguises, with spans in source characters.

A text passes through transducers, each of which rewrites stretches of it and
remembers for every output character which source characters it stands for:
folding of look-alike, full-width and invisible characters; digits written as
letters; at/dot disguises; spelled digits. Identifiers are detected in the
source (base spans) and in the normalised text; what the latter adds is mapped
back to source characters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_all long"


class Span(NamedTuple):
    kind: str
    start: int
    end: int


# -- detectors ---------------------------------------------------------------------------------

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits with what follows, if anything does: linear also where a run is very long.
_IP = re.compile(r"[0-9]++(?:((?:\.[0-9]++){3})|)")
_DIGIT = re.compile(r"[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, in time linear in the text: each @ is extended to both sides once."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            floor = domain.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def detect(text: str) -> list[Span]:
    """Spans of the plain patterns, leftmost and non-overlapping within each kind."""
    found = [Span("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [Span("ip", *m.span()) for m in _IP.finditer(text) if m[1] and all(map(_octet, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(Span("card", *m.span()))
    if "+" in text:
        found += [Span("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15]
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x.start, KINDS.index(x.kind), x.end)))


# -- transducers -------------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones (fixed values).
_LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХԚԜаеѕіјорсухԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιναγρυѵ",
        "ABESIJKMHOPCTYXQWaesijopcyxdqwhABEZHIKMNOPTYXoivaypuv",
        strict=True,
    )
)
_INVISIBLE = "­​‌‍‎‏⁠⁡⁢⁣⁤﻿"
_DASHES = "‐‑‒–—―−﹘﹣"
_DOTS = "․。﹒｡"


def _fold_char(c: str) -> str | None:
    """What a non-ASCII character stands for: an ASCII string, "" for none, or None to leave it alone."""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if c in _INVISIBLE:
        return ""
    if c in _DASHES:
        return "-"
    if c in _DOTS:
        return "."
    category = unicodedata.category(c)
    if category == "Nd":
        return str(unicodedata.digit(c))
    if category == "Zs":
        return " "
    if category[0] in "LNPS":
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain != c and plain.isascii() and c not in "ªº¹²³":
            return plain
    return None


_folds: dict[str, str | None] = {}


class Mapped:
    """A text with, for each of its characters, the source characters [start, end) behind it and whether it was rewritten."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end, self.new = text, list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces each [s, e) of the ascending, disjoint edits; every new character stands for the whole stretch."""
        if not edits:
            return
        parts, start, end, new, at = [], [], [], bytearray(), 0
        for s, e, put in edits:
            parts += [self.text[at:s], put]
            start += self.start[at:s] + [self.start[s]] * len(put)
            end += self.end[at:s] + [self.end[e - 1]] * len(put)
            new += self.new[at:s] + b"\1" * len(put)
            at = e
            if not put and new:
                new[-1] = 1
        self.text = "".join([*parts, self.text[at:]])
        self.start, self.end, self.new = start + self.start[at:], end + self.end[at:], new + self.new[at:]


def fold(m: Mapped) -> None:
    """Look-alikes, full-width forms, other scripts' digits, invisible characters."""
    if m.text.isascii():
        return
    odd = {c for c in set(m.text) if ord(c) > 127}
    for c in odd - _folds.keys():
        _folds[c] = _fold_char(c)
    if mine := "".join(c for c in odd if _folds[c] is not None):
        m.rewrite([(*x.span(), _folds[x.group()]) for x in re.finditer(f"[{re.escape(mine)}]", m.text)])


_LETTER_DIGITS = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OolI](?:[\x20-]?[0-9OolI]){8,}(?![A-Za-z0-9])")
_AS_DIGIT = {"O": "0", "o": "0", "l": "1", "I": "1"}


def letter_digits(m: Mapped) -> None:
    """O, o, l, I within long numbers, where digits prevail."""
    edits = []
    for x in _LETTER_DIGITS.finditer(m.text):
        odd = [i for i in range(*x.span()) if m.text[i] in _AS_DIGIT]
        if odd and 3 * len(odd) <= len(_NOT_DIGITS.sub("", x.group())):
            edits += [(i, i + 1, _AS_DIGIT[m.text[i]]) for i in odd]
    m.rewrite(edits)


_BRACKETED = re.compile(r"\s{0,3}[\[({<]\s{0,3}(at|@|dot|\.)\s{0,3}[\])}>]\s{0,3}", re.I)
_UNDERLINED = re.compile(r"(?<=[A-Za-z0-9])[_-](at|dot)[_-](?=[A-Za-z0-9])", re.I)
_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])(?:\s{1,3}at\s{1,3}|@)(?=[A-Za-z0-9-])", re.I)
_DOT_BEFORE = re.compile(r"(?<=[A-Za-z0-9._%+-])\s{1,3}dot\s{1,3}\Z", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\s{1,3}dot\s{1,3}|\.)[A-Za-z0-9-]+)++", re.I)
_BARE_WORD = re.compile(r"\s{1,3}(at|dot)\s{1,3}", re.I)
_ENTITY = re.compile(r"&(?:#0*64|#x0*40|commat);|%40|&(?:#0*46|#x0*2e|period);", re.I)
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])(?:\s{1,2}@\s{0,2}|@\s{1,2})(?=[A-Za-z0-9-]+\.[A-Za-z])")


def _bare(text: str) -> Iterator[tuple[int, int]]:
    """Stretches like "x dot y at z dot org", in time linear in the text: each "at" is extended to both sides once."""
    floor = 0
    for x in _AT.finditer(text):
        if x.start() < floor:
            continue
        start = x.start()
        while True:
            while start > floor and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            dot = _DOT_BEFORE.search(text, max(floor, start - 9), start)
            if not dot or dot.start() <= floor:
                break
            start = dot.start()
        host = _HOST.match(text, x.end())
        if host and start < x.start():
            yield start, host.end()
            floor = host.end()
        else:
            floor = x.end()


_AT_OR_DOT = {"at": "@", "@": "@", "dot": ".", ".": "."}


def at_dot(m: Mapped) -> None:
    """Character references, spaces around @; [at], (dot), _at_ anywhere; plain words "at" and "dot" only together, as in "x at y dot z"."""
    low = m.text.lower()
    if "&" in low or "%40" in low:
        m.rewrite([(*x.span(), "@" if re.search("64|40|commat", x.group().lower()) else ".") for x in _ENTITY.finditer(m.text)])
    if "@" in low:
        m.rewrite([(*x.span(), "@") for x in _SPACED_AT.finditer(m.text)])
    if "at" not in low and "dot" not in low and "." not in low:
        return
    edits = [(*x.span(), _AT_OR_DOT[x[1].lower()]) for x in _BRACKETED.finditer(m.text)]
    m.rewrite(edits)
    if "_" in low or "-at-" in low:
        words = list(_UNDERLINED.finditer(m.text))
        if {x[1].lower() for x in words} == {"at", "dot"}:
            m.rewrite([(*x.span(), _AT_OR_DOT[x[1].lower()]) for x in words])
    if "dot" in low:
        edits = []
        for x in _bare(m.text):
            words = list(_BARE_WORD.finditer(m.text, *x))
            if any(w[1].lower() == "dot" for w in words):
                edits += [(*w.span(), _AT_OR_DOT[w[1].lower()]) for w in words]
        m.rewrite(edits)


_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_SPELLED = re.compile(r"(?<![A-Za-z])(?:(zero|oh|one|two|three|four|five|six|seven|eight|nine)|(double|triple)|(plus)|(dot|point))(?![A-Za-z])|\+|[0-9]++|\.", re.I)
_GAP = re.compile(r"[\s,()-]{0,3}")
_TIMES = {"double": 2, "triple": 3}
#: A run of tokens counts as a spelled number from so many spelled digits, or worded dots between figures.
LEAST_SPELLED, LEAST_DOTS = 3, 3
_WORDED_DOT = re.compile(r"[0-9]\s{1,3}(?:dot|point)\s{1,3}[0-9]")


def spelled_digits(m: Mapped) -> None:
    """Runs such as "plus one four one five", "one two seven dot zero dot zero dot one" or "10 dot 0 dot 0 dot 1" become figures."""
    low = m.text.lower()
    if not any(w in low for w in ("three", "seven", "eight", "four", "five", "nine", "zero", "two", "six", "one")) and not _WORDED_DOT.search(low):
        return
    edits, run, words, dots, at = [], [], 0, 0, -9

    def close() -> None:
        while run and run[-1][2] == ".":
            run.pop()
        if (words >= LEAST_SPELLED or dots >= LEAST_DOTS) and run:
            edits.extend((s, e, put) for s, e, put in run)

    for x in _SPELLED.finditer(m.text):
        word, times, plus, dot = x[1], x[2], x[3], x[4]
        if not run or not _GAP.fullmatch(m.text, at, x.start()) or plus or x.group() == "+":
            close()
            run, words, dots = [], 0, 0
        if not run and (dot or times or x.group() == "."):
            if not times:
                continue
        put = _DIGIT_WORDS[word.lower()] if word else "" if times else "+" if plus else "." if dot else x.group()
        words += bool(word)
        dots += bool(dot)
        if word and run and run[-1][2] == "" and run[-1][3]:
            put *= run[-1][3]
        run.append(_Token(x.start(), x.end(), put, _TIMES[times.lower()] if times else 0))
        at = x.end()
    close()
    # the gaps inside a run go as well: each token takes the gap before it
    edits.sort()
    wide, last = [], None
    for s, e, put in edits:
        s = last if last is not None and last <= s and _GAP.fullmatch(m.text, last, s) else s
        wide.append((s, e, put))
        last = e
    m.rewrite(wide)


class _Token(tuple):
    """(start, end, output, how often the next digit counts), unpacking as the first three."""

    def __new__(cls, s: int, e: int, put: str, times: int):
        return super().__new__(cls, (s, e, put, times))

    def __iter__(self):
        return iter(self[:3])


TRANSDUCERS = (fold, letter_digits, at_dot, spelled_digits)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans of a text and the spans that only its normalised form shows, both in source characters."""
    text = text or ""
    base = detect(text)
    added: dict[Span, None] = {}
    if _rewritable(text):
        m = Mapped(text)
        for step in TRANSDUCERS:
            step(m)
        if m.text != text:
            known = set(base)
            for kind, s, e in detect(m.text):
                if any(m.new[s:e]) and (span := Span(kind, m.start[s], m.end[e - 1])) not in known:
                    added[span] = None
    return base, list(added)


_BRACKETS = re.compile(r"[\[({<]\s{0,3}(?:at|@|dot|\.)\s{0,3}[\])}>]")
_LETTER_BY_DIGIT = re.compile(r"[0-9](?:[oli]|[\x20-][oli])|[oli](?:[0-9]|[\x20-][0-9])")


def _has_word(low: str, word: str) -> bool:
    at = low.find(word)
    while at >= 0:
        if not low[at - 1 : at].isalpha() and not low[at + len(word) : at + len(word) + 1].isalpha():
            return True
        at = low.find(word, at + len(word))
    return False


def _rewritable(text: str) -> bool:
    """Whether a transducer might change the text."""
    if not text.isascii():
        odd = {c for c in set(text) if ord(c) > 127}
        for c in odd - _folds.keys():
            _folds[c] = _fold_char(c)
        if any(_folds[c] is not None for c in odd):
            return True
    low = text.lower()
    if any(c in low for c in "[({<") and _BRACKETS.search(low):
        return True
    if "_at_" in low or "-at-" in low or "%40" in low or " @" in low or "@ " in low or _has_word(low, "dot"):
        return True
    if "&" in low and _ENTITY.search(low):
        return True
    return any(_has_word(low, w) for w in _DIGIT_WORDS) or _WORDED_DOT.search(low) is not None or bool(_DIGIT.search(low)) and _LETTER_BY_DIGIT.search(low) is not None


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts per kind, digest of the base spans, all spans, number of added spans and of all.

    Null texts count as empty (no spans, digest of the empty string); a null id stays null; repeated rows
    give repeated results; other columns are ignored whatever they are called. Texts are read whole. An empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [find(t) for t in batch.column(1).to_pylist()]
            counts = [[sum(s.kind == k for s in base) for base, _ in rows] for k in KINDS]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([joined(b + a) for b, a in rows], pa.string()), pa.array([len(a) for _, a in rows], pa.int64()), pa.array([len(b) + len(a) for b, a in rows], pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_all"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
