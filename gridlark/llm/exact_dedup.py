"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then of the whole, then the content.

Each step looks only at rows whose group has more than one row so far, and
reads more of the text than the step before: the prefix is hashed where another
row has the length, the whole text where another has length and prefix hash,
and content is compared where another has the full hash. Content is compared in
a grouping that is pre-aggregated before the shuffle, so a group of copies
travels once per task, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, small, written

#: Characters whose hash stands for the beginning of a text.
PREFIX_CHARS = 128


def _marked(rows: DataFrame, groups: DataFrame, by: list[str], name: str, hashed: Column) -> DataFrame:
    """``rows`` with column ``name``: ``hashed`` where the groups (by) have the row's values, else null.

    A conditional, so that nothing is hashed for rows whose group is done.
    """
    found = rows.join(small(groups.withColumn("_more", F.lit(True)), 24 * len(by)), by, "left")
    return found.withColumn(name, F.when(F.col("_more"), hashed)).drop("_more")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the ``carry`` columns per input row.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id stays; rows
    that repeat this id with the same text can't be told apart and are all marked kept. Null ids lose against any
    other, and a group of null ids only keeps them all. Columns that aren't named are ignored. An empty table gives
    an empty result.
    """
    extra = [f"_carry_{c}" for c in carry]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c).alias(x) for c, x in zip(carry, extra, strict=True)])
    rows = rows.withColumn("_len", F.octet_length("_text"))
    prefix, full = F.xxhash64(F.substring("_text", 1, prefix_chars)), F.xxhash64("_text")
    key, paths = ["_len", "_prefix", "_full"], []

    def often(df: DataFrame, *by: str) -> DataFrame:
        """Keys that more than one row has; broadcast if a count shows that they are few, else joined by shuffle."""
        found, path = written(df.dropna(subset=list(by)).groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*by), "groups")
        paths.append(path)
        return found

    lengths = often(rows.select("_len"), "_len")
    prefixed = _marked(rows, lengths, key[:1], "_prefix", prefix)
    prefixes = often(prefixed.select(*key[:2]), *key[:2])
    # the last step that reads whole texts of rows that are still undecided; the hashes are written for what follows
    hashed = _marked(prefixed, prefixes, key[:2], "_full", full)
    slim, _ = written(hashed.select("doc_id", *extra, *key), "hashes")
    hashes = often(slim.select(*key), *key)
    content = hashed.join(small(hashes, 48), key, "left_semi").groupBy(*key, "_text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # almost always one text has a hash; where several share it, the text itself decides below
    found, _ = written(content.groupBy(*key).agg(F.count(F.lit(1)).alias("_texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")), "found")

    one = found.filter("_texts = 1").select(*key, F.lit(True).alias("_one"), F.col("keep_id"), F.col("group_size"))
    shared, out = found.filter("_texts > 1").select(*key), ["doc_id", *extra, "keep_id", "group_size"]
    alone = F.when(F.col("_one"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size")
    if shared.isEmpty():
        result = slim.join(small(one, 48), key, "left").select("doc_id", *extra, *alone)
        for path in paths:
            delete(docs.sparkSession, path)
    else:
        several = hashed.join(small(shared, 48), key, "left_semi")
        by_text = several.groupBy("_text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        result = slim.join(small(shared, 48), key, "left_anti").join(small(one, 48), key, "left").select("doc_id", *extra, *alone)
        result = result.unionAll(several.join(by_text, "_text").select(*out))
    return result.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), *[F.col(x).alias(c) for c, x in zip(carry, extra, strict=True)])
