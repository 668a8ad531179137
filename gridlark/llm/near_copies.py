"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash fingerprints: the covering masks of ``simhash``
give two that differ in RADIUS bits or fewer a key in common, without
exception. At similarity 0.8 fingerprints of 64 bits differ in about 10 bits,
and masks for such a radius are too many to be looked up, so that MinHash bands
give more keys: at similarity s a pair shares one of them with probability
1 - (1 - s^ROWS)^BANDS, 0.9996 at 0.8 and more above. Every candidate is then
decided by its exact similarity.

Texts with equal sets are one node. The members of a bucket are ordered by
SimHash fingerprint; each is compared with the first and with those next to it,
so that a bucket of any size takes a number of pairs in proportion to it.
Buckets of up to NEIGHBOURS + 1 nodes are thereby compared in full. A larger
bucket whose nodes are all in one component needs no more comparisons. The
nodes of the others are joined exactly, without regard to buckets: ordered from
the rarest shingle, similar sets have one in common within their first fifth
(Bayardo et al., "Scaling Up All Pairs Similarity Search"), and its places bound
how many more they can share (Xiao et al., "PPJoin"). A bitmap of each set, a
bit for the parity of the values that fall on it, bounds that from the other
side: every bit that differs is a value that only one of two sets has (Sandes
et al., "Bitmap filter"). Only pairs of different components that pass these
bounds become rows, whose number follows that of the links, not the square of
a list; the bounds themselves are tested for all pairs of a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release_memory, small, written
from .components import components
from .simhash import _LOWER, SEED, covering_masks

SHINGLE = 5
#: Least similarity, as a fraction.
SIMILARITY = (4, 5)
BANDS, ROWS = 20, 5
#: Fingerprints that differ in so many bits or fewer always have a key in common.
RADIUS = 4
NEIGHBOURS = 6
#: A list of nodes with a common rare shingle is dealt to tasks in parts of about this size.
LISTED = 1 << 12
#: Longs of a set's bitmap.
BITMAP = 16
CHUNK = 1 << 12

_rng = np.random.Generator(np.random.PCG64(SEED))
_FLIPS, _FACTORS = (_rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text; a shorter text is one shingle, one without words none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64))


def node_of(found: np.ndarray) -> int:
    """The same number for equal sets."""
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


_MASKS = [m % (1 << 64) for m in covering_masks(RADIUS)]


def fingerprint_keys(fp: int) -> list[int]:
    """A key for each covering mask, of the bits that it keeps."""
    import xxhash

    return [xxhash.xxh64_intdigest(bytes([BANDS + i]) + (fp & m).to_bytes(8, "big"), SEED) for i, m in enumerate(_MASKS)]


def sketch(found: np.ndarray) -> tuple[int, list[int]]:
    """Fingerprint, and its keys and the band keys, of a set of shingles; without shingles no keys."""
    import xxhash

    if not len(found):
        return 0, []
    least, ones = np.full(BANDS * ROWS, ~np.uint64(0)), np.zeros(64, np.int64)
    for k in range(0, len(found), CHUNK):
        part = found[k : k + CHUNK]
        least = np.minimum(least, ((part[:, None] ^ _FLIPS) * _FACTORS).min(0))
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    fp = int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big")
    return fp, fingerprint_keys(fp) + [xxhash.xxh64_intdigest(bytes([b]) + least[b * ROWS : (b + 1) * ROWS].tobytes(), SEED) for b in range(BANDS)]


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def _lists(values: list) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate([np.zeros(0, np.uint64), *[np.array(v, np.uint64) for v in values]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, fp, keys) per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, keys = [], [], []
            for t in batch.column(1):
                found = shingles(t.as_py())
                fp, of = sketch(found)
                nodes.append(node_of(found))
                fps.append(fp)
                keys.append(of)
            yield pa.RecordBatch.from_arrays([batch.column(0), _longs(nodes), _longs(fps), _lists(keys)], names=["doc_id", "node", "fp", "keys"])
        release_memory()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, node long, fp long, keys array<long>")


def bitmap(found: np.ndarray) -> np.ndarray:
    """Parities of the values by their lowest bits, as longs. Bitmaps of two sets differ in no more bits than the sets in values."""
    odd = np.bincount((found % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def sets(docs: DataFrame) -> DataFrame:
    """(node, shingles, bits) per input row (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                found = shingles(t.as_py())
                yield pa.RecordBatch.from_arrays([_longs([node_of(found)]), _lists([found]), _lists([bitmap(found)])], names=["node", "shingles", "bits"])
        release_memory()

    return docs.mapInArrow(run, "node long, shingles array<long>, bits array<long>")


def placed(nodes: DataFrame) -> DataFrame:
    """(node, fp, key) for each bucket that a node (node, fp, keys) is in."""
    return nodes.select("node", "fp", F.explode("keys").alias("key"))


def candidates(nodes: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (node, fp, keys) that share a key and are next to each other in its bucket."""
    ordered = Window.partitionBy("key").orderBy("fp", "node")
    near = F.array(F.first("node").over(ordered), *[F.lead("node", i).over(ordered) for i in range(1, neighbours + 1)])
    pairs = placed(nodes).select("node", near.alias("near")).select("node", F.explode(F.filter("near", lambda x: x.isNotNull() & (x != F.col("node")))).alias("other"))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def similar(x: Column, y: Column) -> Column:
    """Whether two arrays of distinct values have the least similarity, in whole numbers."""
    both = F.size(F.array_intersect(x, y))
    return both * SIMILARITY[1] >= (F.size(x) + F.size(y) - both) * SIMILARITY[0]


def links(docs: DataFrame, nodes: DataFrame, least: DataFrame, neighbours: int = NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """The candidates (a, b) that are similar, and the sets (node, shingles, bits) of all candidates.

    Texts of docs (doc_id, text) are read again only for candidates, one for each node (least).
    """
    pairs, _ = written(candidates(nodes, neighbours), "candidates")
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    ids = least.join(wanted, "node", "left_semi").select(F.col("least").alias("_of")).distinct()
    read = sets(docs.join(small(ids, 16), F.col("doc_id").eqNullSafe(F.col("_of")), "left_semi").select("text"))
    read, _ = written(read.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "shingles")
    x, y = (read.select(F.col("node").alias(n), F.col("shingles").alias(f"of_{n}")) for n in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").filter(similar(F.col("of_a"), F.col("of_b"))).select("a", "b"), read


def undecided(nodes: DataFrame, rooted: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(node, root) of the nodes in buckets too large to be compared in full whose nodes (rooted: node, root) aren't all in one component."""
    large = placed(nodes).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > neighbours + 1).select("key")
    members, _ = written(placed(nodes).join(large, "key", "left_semi").join(rooted.select("node", "root"), "node").select("key", "node", "root"), "large")
    mixed = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key")
    return members.join(mixed, "key", "left_semi").select("node", "root").distinct()


def possible(open_nodes: DataFrame, read: DataFrame, listed: int = LISTED) -> DataFrame:
    """(node_a, root_a, node_b, root_b), a superset of the similar pairs of different roots, of the nodes (node, root) with the sets ``read``."""
    held = read.join(open_nodes, "node").select("node", "root", "bits", "shingles")
    each = held.select("node", "root", "bits", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("often"), F.min("root").alias("low"), F.max("root").alias("high"))
    order = Window.partitionBy("node").orderBy("often", "s")
    # a shingle of a single component still has its place in the order, but joins nothing
    first, _ = written(
        each.join(often, "s").withColumn("at", F.row_number().over(order) - 1)
        .filter((F.col("at") * SIMILARITY[1] <= F.col("n") * (SIMILARITY[1] - SIMILARITY[0])) & (F.col("low") != F.col("high")))
        .select("s", "node", "root", "bits", "n", "at"),
        "first",
    )
    # parts follow the list that is joined, which the places shorten
    long = first.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / listed).cast("int").alias("parts")).filter("parts > 1")
    dealt = first.join(small(long, 16), "s", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    x, y = (dealt.select("s", *[F.col(c).alias(f"{c}_{t}") for c in ("node", "root", "bits", "n", "at", "parts")]) for t in ("a", "b"))
    x = x.withColumn("part", F.pmod(F.xxhash64("node_a"), F.col("parts_a")).cast("int"))
    y = y.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
    both = F.col("n_a") + F.col("n_b")
    # sets of n and m values have to share 4 of 9 of n + m: at most the fewer before this one, and the shorter rest
    shared = F.least("at_a", "at_b") + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    enough = shared * sum(SIMILARITY) >= both * SIMILARITY[0]
    # and differ in 1 of 9 of n + m at most
    apart = sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(BITMAP)), F.lit(0))
    close = apart * sum(SIMILARITY) <= both * (SIMILARITY[1] - SIMILARITY[0])
    return x.join(y, ["s", "part"]).filter((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & enough & close).select("node_a", "root_a", "node_b", "root_b").distinct()


def links_between(open_nodes: DataFrame, read: DataFrame, listed: int = LISTED) -> DataFrame:
    """(a, b) for all pairs of roots that have similar nodes, of the nodes (node, root) with the sets ``read`` (node, shingles, bits)."""
    met, _ = written(possible(open_nodes, read, listed), "met")
    held = read.join(open_nodes, "node")
    of_a, of_b = (held.select(F.col("node").alias(f"node_{t}"), F.col("shingles").alias(f"of_{t}")) for t in ("a", "b"))
    both = met.join(of_a, "node_a").join(of_b, "node_b").filter(similar(F.col("of_a"), F.col("of_b")))
    return both.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, component_id per input row; component_id is the smallest doc_id reachable over links.

    Null texts count as empty; texts without words are copies of each other. Null ids never become a component_id
    unless a component has no other. Other columns are ignored. ``neighbours`` moves work between the two ways of
    comparing and has no influence on the result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known, _ = written(sketches(docs), "sketches")
    # copies are one node from here on, however many there are
    least, _ = written(known.groupBy("node").agg(F.min("doc_id").alias("least")), "least")
    nodes, _ = written(known.select("node", "fp", "keys").dropDuplicates(["node"]), "nodes")
    found, read = links(docs, nodes, least, neighbours)
    of = components(found).withColumnRenamed("node", "linked")
    rooted, _ = written(least.join(of, F.col("node") == F.col("linked"), "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    rest, _ = written(undecided(nodes, rooted, neighbours), "undecided")
    if not rest.isEmpty():
        joined = components(links_between(rest, read)).select(F.col("node").alias("linked"), F.col("root").alias("over"))
        rooted, _ = written(rooted.join(joined, F.col("root") == F.col("linked"), "left").select("node", "least", F.coalesce("over", "root").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of, _ = written(rooted.join(ids, "root").select("node", "component_id"), "of")
    return known.select("doc_id", "node").join(small(of, 24), "node", "left").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose id is the smallest of its component.

    Rows that repeat such an id stay with it; rows with a null id stay together, if one of them has no row with an id near.
    """
    stays = near_copies(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stays")).distinct()
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["_stays"]), "left_semi")
