"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins. Cyclic boosting visits the
features in turn and adds a shallow tree over the bins of one feature to that
feature's lookup table; the pairs of features whose cells explain most of what
is left get two-dimensional tables in the same way. A score is the logistic
function of the intercept plus one table entry per feature and pair, so that
scoring is a few vectorised additions and the tables can be read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, crc32_mod

#: The model is fitted on about so many labelled rows at most, chosen by a hash of the id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, SMOOTH = 120, 60, 0.15, 2.0

FEATURES = ("bytes", "upper", "lower", "digit", "space", "stop", "symbol", "pipe", "beyond_ascii", "newline", "words", "word_len", "unique_words", "top_word", "unique_lines", "line_words", "odd_ends", "capital_words")
_STOPS, _SYMBOLS = [ord(c) for c in ".,;:?"], [ord(c) for c in "!#$%&*@^~<>=+_\\/{}[]"]
_ODD_ENDS = frozenset(b"!#$%&*@^~<>=+_\\|")


def features(text: str | None) -> list[float]:
    """Numbers about the characters, words and lines of a whole text; a null or empty text gives zeros."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(FEATURES)
    n, seen = len(raw), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    w, counts = max(1, len(words)), Counter(words)
    filled = [x for x in lines if x]
    return [
        float(np.log1p(n)),
        seen[65:91].sum() / n,
        seen[97:123].sum() / n,
        seen[48:58].sum() / n,
        (seen[32] + seen[9:14].sum()) / n,
        seen[_STOPS].sum() / w,
        seen[_SYMBOLS].sum() / n,
        seen[124] / w,
        seen[128:].sum() / n,
        seen[10] / w,
        float(np.log1p(len(words))),
        sum(map(len, words)) / w,
        len(counts) / w,
        max(counts.values(), default=0) / w,
        len(set(filled)) / max(1, len(filled)),
        w / max(1, len(filled)),
        sum(c for x, c in counts.items() if x[-1] in _ODD_ENDS) / w,
        sum(c for x, c in counts.items() if 65 <= x[0] <= 90) / w,
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


# -- model -------------------------------------------------------------------------------------


@dataclass
class Additive:
    """Intercept; per feature bin edges and a table; per pair the two features, coarse edges and a table."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        if self.pairs:
            at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.coarse)]
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[at[a], at[b]]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values per bin of a tree of the given depth, grown on sums of gradients and curvatures over ordered bins."""
    out = np.full(len(g), g.sum() / (h.sum() + SMOOTH))
    if depth == 0 or len(g) < 2:
        return out
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + SMOOTH) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + SMOOTH)
    k = int(gain.argmax()) + 1
    if gain[k - 1] <= g.sum() ** 2 / (h.sum() + SMOOTH) + 1e-9:
        return out
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _cross(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The two-dimensional shallow tree: the best cut of the rows, and in each half a tree over the columns."""
    best, out = -1.0, np.zeros_like(g)
    for k in range(1, len(g)):
        halves = [_tree(g[s].sum(0), h[s].sum(0), 1) for s in (slice(None, k), slice(k, None))]
        gain = sum(float((t * g[s].sum(0)).sum()) for t, s in zip(halves, (slice(None, k), slice(k, None)), strict=True))
        if gain > best:
            best, out = gain, np.vstack([np.repeat(halves[0][None], k, 0), np.repeat(halves[1][None], len(g) - k, 0)])
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Boosts the tables on rows x with labels y (0/1). Without rows the score is 0.5; with one class, near that class."""
    width = x.shape[1]
    prior = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(float(np.log(prior / (1 - prior))), [np.zeros(0)] * width, [np.zeros(1)] * width, [], [np.zeros(0)] * width, [])
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges = [_edges(x[:, j], BINS) for j in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [_edges(x[:, j], PAIR_BINS) for j in range(width)]
    fine = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(fine[j], g, len(table)), np.bincount(fine[j], h, len(table)))
            table += step
            total += step[fine[j]]

    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    sizes = [len(e) + 1 for e in model.coarse]

    def cells(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        at, n = rough[a] * sizes[b] + rough[b], sizes[a] * sizes[b]
        return np.bincount(at, g, n).reshape(sizes[a], sizes[b]), np.bincount(at, h, n).reshape(sizes[a], sizes[b])

    def left_over(pair: tuple[int, int]) -> float:
        g, h = cells(*pair)
        return float((g**2 / (h + SMOOTH)).sum())

    model.pairs = sorted(((a, b) for a in range(width) for b in range(a + 1, width)), key=left_over, reverse=True)[:PAIRS]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            step = RATE * _cross(*cells(a, b))
            table += step
            total += step[rough[a], rough[b]]
    return model


# -- Spark -------------------------------------------------------------------------------------


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return crc32_mod(id_col, 4) == 2


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Additive:
    """Fits the model on a bounded sample of the labelled rows that aren't held out.

    Labels without an id or a quality are left out; of several labels of one id the larger counts, and of several
    texts the one with the largest features. The sample, of about ``sample_rows`` ids at most, taken by a hash of the id,
    is the only thing that is broadcast or sent to the driver. Without labels or documents every score is 0.5.
    """
    assert sample_rows * 80 <= BROADCAST_BYTES
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").alias("_quality")).dropna().filter(crc32_mod("_id", 4) != 2)
    known = known.groupBy("_id").agg(F.max("_quality").alias("_quality"))
    # a share of the ids by their hash, a little less than fits, so that no task has to order or gather them
    share = 0.97 * sample_rows / max(1, known.count())
    if share < 0.97:
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 32)) < int(share * (1 << 32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(1).to_pylist()).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.float64()), pa.array(rows, pa.list_(pa.float64()))], names=["id", "y", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(known), "_id").select("_id", "_text", "_quality")
    rows = texts.mapInArrow(run, "id long, y double, x array<double>").groupBy("id").agg(F.max(F.struct("y", "x")).alias("r"))
    rows = [r.r for r in rows.orderBy("id").collect()]
    return fit(np.array([r.x for r in rows], float).reshape(-1, len(FEATURES)), np.array([r.y for r in rows], float))


def score_udf(model: Additive):
    """Column function from a text to its score, for use beside other columns."""

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(matrix(texts.tolist())), dtype="float64")

    return F.pandas_udf(score, "double")


def score_documents(docs: DataFrame, model: Additive, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted per input row.

    Null and empty texts are scored as texts without words. Repeated rows get equal scores, null ids are kept,
    other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_udf(model)(F.col("text")).alias("score"))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
