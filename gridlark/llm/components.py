"""Connected components of a graph given as a DataFrame of links, without ever gathering the graph.

Alternates the large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond"): every node hands its neighbours to the
smallest of them, until each component is a star around its smallest node.
Rounds grow with the logarithm of the component size; each is written to the
shared folder.

A star's centre has as many links as its component has nodes. Smallest
neighbours are found by a minimum that is pre-aggregated, and go back to the
links by broadcast if a count shows that they are few; otherwise those of nodes
with many links do, whose number is bounded by that of the links, and only the
links of the other nodes are shuffled by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, delete, written

#: Bytes of a node and its smallest neighbour in a broadcast.
_ROW = 32


def with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """(a, b, m) for links (a, b): m from least (n, m, degree) of node a, however many links a has."""
    least, _ = written(least, "least")
    sums = least.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("degree"), F.lit(0)).alias("links")).first()
    pairs = least.select("n", "m")
    if sums.nodes * _ROW <= BROADCAST_BYTES:
        return links.join(F.broadcast(pairs), F.col("a") == F.col("n")).select("a", "b", "m")
    # at most BROADCAST_BYTES / _ROW nodes can have more links than this
    many = max(1, sums.links * _ROW // BROADCAST_BYTES)
    busy = F.broadcast(least.filter(F.col("degree") > many).select("n", "m"))
    marked = links.join(busy, F.col("a") == F.col("n"), "left")
    rest = marked.filter("n IS NULL").select("a", "b").join(pairs, F.col("a") == F.col("n")).select("a", "b", "m")
    return marked.filter("n IS NOT NULL").select("a", "b", "m").unionAll(rest)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")).select("n", F.least("n", "m").alias("m"), "degree")
    return with_least(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
    least = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
    moved = with_least(down, least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.unionAll(least.select(F.col("n").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable. Nodes without links are absent."""
    spark = links.sparkSession
    now, path = written(links.select("a", "b").filter("a != b").distinct(), "links")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    state = None
    while True:
        large, large_path = written(_large_star(now), "links")
        following, next_path = written(_small_star(large).distinct(), "links")
        delete(spark, path)
        delete(spark, large_path)
        now, path = following, next_path
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))
