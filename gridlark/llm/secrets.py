"""Secrets in texts: known forms, and random strings that a tokenizer compresses badly.

A byte-pair vocabulary learned from prose and code needs few tokens for words
and identifiers and many for random strings. A candidate whose characters per
token fall below a threshold counts as a secret, unless it is a known digest
(named as one, UUIDs, integrity hashes) or reads as an identifier. Words of one
case pass by their ratio alone: of random strings of 20 to 40 letters 95 in 100
have less than 2 characters a token, long words have more. Tokens hold up to
four figures, so numbers have a ratio of their own.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long, n_all long"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fewer characters per token than this, from so many characters on, mean a random string; the second ratio is that of plain numbers.
MAX_RATIO, NUMBER_RATIO, LEAST_CHARS = 2.0, 2.7, 20
#: Shorter strings, from so many characters on, count if they have letters and figures.
LEAST_MIXED = 16

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Digests and identifiers that are no secrets (fixed values): hex of usual digest lengths (in capitals only where named as such; of lower-case hex there is a base kind), UUIDs, integrity values.
_HEX_DIGEST = re.compile(r"[0-9a-fA-F]+")
_DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
_DIGEST_NAME = re.compile(r"(?:md5|sha-?[0-9]{1,3}|digest|checksum|fingerprint|etag|commit|revision)[\"']?[\x20:=\"']{1,4}\Z", re.I)
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_INTEGRITY = re.compile(r"(?:md5|sha1|sha224|sha256|sha384|sha512)[-=/][A-Za-z0-9+/=_-]+", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])|[0-9]{1,4}")


@cache
def encoding(path: str | None = None):
    """tiktoken encoding of a ranks file; loaded once per process."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def excluded(s: str, before: str = "") -> bool:
    """Known digests, also by the name ``before`` them, and identifiers: repetitions, figures in a row, and names put together from words."""
    if len(set(s)) < 6 or s.isdigit() and len({(int(b) - int(a)) % 10 for a, b in zip(s, s[1:], strict=False)}) == 1:
        return True
    if _HEX_DIGEST.fullmatch(s) and len(s) in _DIGEST_LENGTHS and (s == s.lower() or _DIGEST_NAME.search(before)) or _UUID.fullmatch(s) or _INTEGRITY.fullmatch(s):
        return True
    parts = [p for p in re.split(r"[_/+=-]+", s) if p]
    if len(parts) == 1 and (s.isalpha() and (s.islower() or s.isupper()) or s.isdigit()):
        return False
    return bool(parts) and sum(len(w) for p in parts for w in _WORDS.findall(p) if len(w) > 3 or w.isdigit()) >= 0.8 * sum(map(len, parts)) and max(map(len, parts)) < 20


def random_strings(text: str, path: str | None = None, max_ratio: float = MAX_RATIO) -> list[tuple[int, int]]:
    found = []
    for m in _CANDIDATE.finditer(text):
        s = m.group()
        core = s.strip("=-_/+")
        if len(core) < LEAST_CHARS and (len(core) < LEAST_MIXED or core.isalpha() or core.isdigit()):
            continue
        at = m.start() + s.index(core)
        ratio = NUMBER_RATIO if core.isdigit() else max_ratio
        if not excluded(core, text[max(0, at - 24) : at]) and len(core) < ratio * len(encoding(path).encode_ordinary(core)):
            found.append((at, at + len(core)))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def find(text: str | None, path: str | None = None) -> tuple[list, list]:
    """Base spans of a text, and the random strings outside of them."""
    text = text or ""
    base = base_spans(text)
    covered = [(s, e) for _, s, e in base]
    return base, [("random", s, e) for s, e in random_strings(text, path) if not any(a < e and s < b for a, b in covered)]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: counts per kind, digest of the base spans, all spans, number of random strings and of all spans.

    ``vocabulary`` is the path of a ranks file that every executor has. Null texts count as empty; null ids stay
    null; repeated rows give repeated results; other columns are ignored. Texts are read whole. An empty table gives
    an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [find(t, vocabulary) for t in batch.column(1).to_pylist()]
            count = lambda k: pa.array([sum(x[0] == k for x in b) for b, _ in rows], pa.int64())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *map(count, KINDS[:3]), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in rows], pa.string()), pa.array([joined(b + a) for b, a in rows], pa.string()), pa.array([len(a) for _, a in rows], pa.int64()), pa.array([len(b) + len(a) for b, a in rows], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random", "n_all"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
