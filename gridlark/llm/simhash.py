"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Fingerprints have 64 bits, a majority vote over the XXH64 of all word shingles.
For a radius r every bit position gets a nonzero vector of r + 1 bits; for each
of the 2^(r+1) - 1 nonzero vectors v, a table keeps the bits whose vector isn't
orthogonal to v (Pagh, "CoveringLSH"). Any r differing positions have a common
orthogonal v, so every pair within the radius collides in some table: nothing
within the radius is missed.

A bucket of few fingerprints is compared in place. Members of a larger bucket
are linked through centres instead: two fingerprints at distance 2 or less have
a common fingerprint within one flipped bit of both, and all that share such a
centre are within 2 of each other. That takes 65 rows for each member, is exact
and never lists the pairs of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Buckets with more distinct fingerprints than this are linked through centres.
COMPARED_IN_PLACE = 24

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 majority bits over the shingles of a whole text; no words: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    raw = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
    ones = np.zeros(64, np.int64)
    rows = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    for k in range(0, len(rows), 1 << 14):
        ones += np.add.reduce(np.unpackbits(rows[k : k + (1 << 14)], axis=1), axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per input row, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed longs. Positions take the nonzero vectors in turn, so tables are balanced."""
    vectors = range(1, 2 ** (radius + 1))
    of = [vectors[i % len(vectors)] for i in range(bits)]
    masks = [sum(1 << i for i in range(bits) if (of[i] & v).bit_count() % 2) for v in vectors]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, radius: int = RADIUS, in_place: int = COMPARED_IN_PLACE) -> DataFrame:
    """Links (a, b), a < b, that connect distinct fingerprints ``fp`` as all pairs within the radius would.

    Small buckets give every pair within the radius; large ones a star around each centre, which needs radius 2.
    """
    if radius != 2:
        raise ValueError("centres of one flipped bit serve a radius of 2")
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(covering_masks(radius))])
    placed, _ = written(nodes.select("fp", F.inline(keys)), "buckets")
    sizes = placed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    near = placed.join(sizes.filter(F.col("n") <= in_place), ["t", "key"]).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    near = near.select("fps", F.explode("fps").alias("a")).select("a", F.explode(F.filter("fps", lambda y: (y > F.col("a")) & (apart(F.col("a"), y) <= radius))).alias("b"))
    dense = placed.join(sizes.filter(F.col("n") > in_place), ["t", "key"]).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    # a centre has at most 65 members, so the gathered lists are bounded
    stars = dense.select("fp", F.explode(flips).alias("centre")).groupBy("centre").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    return near.unionAll(stars.select("a", F.explode("fps").alias("b")).filter("a != b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id per input row; component_id is the smallest doc_id reachable over links.

    Null texts count as empty; texts without words share fingerprint 0, which is linked like any other. Null ids
    never become a component_id unless a component has no other. Equal fingerprints are one node however many
    rows have them. Other columns are ignored. An empty table gives an empty result.
    """
    known, _ = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = known.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = nodes.join(components(links(nodes.select("fp"), radius)), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted, _ = written(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of, _ = written(rooted.select("fp", "root").join(ids, "root").select("fp", "component_id"), "of")
    return known.join(small(of, 24), "fp", "left").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose id is the smallest of its component.

    Rows that repeat such an id stay with it; rows with a null id stay only where no row with an id is near.
    """
    stays = near_duplicates(docs, shingle, radius).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stays")).distinct()
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["_stays"]), "left_semi")
