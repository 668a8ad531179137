"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks by a hash of their id: random,
disjoint sets of whole documents. A target of t words takes every block
floor(t / size) times and, for the rest, the blocks in order of the hash up to
the word where the rest is reached (the document there is cut). That fixes the
number of block draws of each source exactly.

The draws are dealt to output shards by a binary tree over the shards. At each
node the draws of the left half are split off among the sources as a draw
without replacement from all draws of the node would be: one hypergeometric
count after the other, by inversion of the distribution around its mode. The
leaves hold exact quotas of each source and shard; a shard then takes that many
of the source's draws, in an order permuted by another hash, so that shards
are disjoint. Within a shard rows are ordered by a third hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, small, written

DOCS_PER_BLOCK, SHARDS, SEED = 512, 16, "mix"
#: No document is taken more often than this.
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def targets(sized: DataFrame) -> DataFrame:
    """idx, source, source_size, docs, target, whole, rest for each source of (source, size).

    Sources by code point, null last, weigh 1, 2, 3 in turn and share all words; a target stops at three times the
    source's size and what exceeds that is shared anew. The window has one row for each source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_source = by_source.withColumn("idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    by_source = by_source.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("idx") % len(WEIGHTS) + 1).cast("long")).withColumn("cap", F.col("source_size") * MOST_REPEATS)
    full = Window.orderBy(F.col("cap") / F.col("w"), "idx")
    before, after, whole = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing), full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = by_source.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("of", F.sum("w").over(after))
    left = left.withColumn("k", F.row_number().over(full)).withColumn("open", F.col("cap") / F.col("w") > F.col("left") / F.col("of"))
    first = F.min(F.when(F.col("open"), F.struct("k", "left", "of"))).over(whole)
    left = left.withColumn("first", first)
    share = F.when(F.col("first").isNull() | (F.col("k") < F.col("first.k")), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("first.left")) / F.col("first.of"))
    found = left.select("idx", "source", "source_size", "docs", share.alias("target")).withColumn("_t", F.round("target").cast("long"))
    repeats = F.when(F.col("source_size") > 0, F.expr("_t div source_size")).otherwise(F.lit(0).cast("long"))
    return found.withColumn("whole", F.least(repeats, F.lit(MOST_REPEATS).cast("long"))).withColumn("rest", F.col("_t") - F.col("whole") * F.col("source_size")).drop("_t")


def _hypergeometric(pop: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the number of marked ones among ``drawn`` of ``pop``, by inversion of ``u``.

    Probabilities relative to the first considered value follow from their ratios; 12 standard deviations to both
    sides of the mode are considered, beyond which less than 1e-30 remains.
    """
    ratio = f"(({marked} - x) * 1D * ({drawn} - x)) / ((x + 1D) * ({pop} - {marked} - {drawn} + x + 1D))"
    spread = f"sqrt({drawn} * 1D * {marked} / greatest({pop}, 1) * ({pop} - {marked}) / greatest({pop}, 1) * ({pop} - {drawn}) / greatest({pop} - 1, 1))"
    step = f"CASE WHEN x >= r.hi THEN 0D ELSE acc.w * ({ratio}) END"
    return f"""
    transform(array(named_struct(
        'mode', cast(floor(({drawn} + 1D) * ({marked} + 1D) / ({pop} + 2D)) as bigint), 'near', cast(ceil(12 * {spread}) as bigint) + 20)),
      p -> transform(array(named_struct(
        'lo', greatest(0L, {drawn} - ({pop} - {marked}), p.mode - p.near), 'hi', least({drawn}, {marked}, p.mode + p.near))),
      r -> transform(array(aggregate(sequence(r.lo, r.hi), named_struct('w', 1D, 'sum', 0D),
          (acc, x) -> named_struct('w', {step}, 'sum', acc.sum + acc.w), acc -> acc.sum)),
      total -> aggregate(sequence(r.lo, r.hi), named_struct('w', 1D, 'sum', 0D, 'at', -1L),
          (acc, x) -> named_struct('w', {step}, 'sum', acc.sum + acc.w, 'at', CASE WHEN acc.at < 0 AND acc.sum + acc.w >= {u} * total THEN x ELSE acc.at END),
          acc -> CASE WHEN acc.at < 0 THEN r.hi ELSE acc.at END))[0])[0])[0]"""


def shard_quotas(quotas: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(idx, shard, quota) from the exact (idx, quota) of each source; quotas of a source add up to its own.

    Sources of a node are folded over in one row, so they are assumed to fit one (a mixture's sources, not documents).
    """
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("idx", "quota"))).alias("all")).select(F.lit(0).alias("first"), F.lit(shards).alias("n"), F.col("all.idx").alias("idx"), F.col("all.quota").alias("quota"))
    u = f"(pmod(xxhash64('{seed}', first, n, s.i), 9007199254740992) / 9007199254740992D)"
    draw = f"""
    aggregate(quota, named_struct('pop', total, 'draw', total * (n div 2) div n, 'i', 0, 'out', cast(array() as array<bigint>)),
      (s, k) -> transform(array({_hypergeometric("s.pop", "k", "s.draw", u)}), d -> named_struct('pop', s.pop - k, 'draw', s.draw - d, 'i', s.i + 1, 'out', concat(s.out, array(d))))[0],
      s -> s.out)"""
    for _ in range(max(0, (shards - 1).bit_length())):
        node = node.withColumn("total", F.expr("aggregate(quota, 0L, (a, b) -> a + b)")).withColumn("taken", F.expr(f"CASE WHEN n > 1 THEN {draw} END"))
        halves = F.expr("""CASE WHEN n = 1 THEN array(named_struct('first', first, 'n', n, 'quota', quota)) ELSE array(
            named_struct('first', first, 'n', cast(n div 2 as int), 'quota', taken),
            named_struct('first', cast(first + n div 2 as int), 'n', cast(n - n div 2 as int), 'quota', zip_with(quota, taken, (a, b) -> a - b))) END""")
        node = node.select("idx", F.inline(halves)).select("first", "n", "idx", "quota")
    return node.select(F.col("first").alias("shard"), F.inline(F.arrays_zip("idx", "quota"))).select("idx", "shard", "quota")


def mix(docs: DataFrame, carry: tuple[str, ...] = (), shards: int = SHARDS, docs_per_block: int = DOCS_PER_BLOCK, seed: str = SEED) -> DataFrame:
    """Per input row: doc_id, source, size, source_size, target, the ``carry`` columns and ``draws``.

    ``draws`` lists (pass, shard, words): the passes of the mix that take the document, the output shard of each and
    how many words it takes, all but the cut document of a source taking all. Null texts have no words; documents
    without words are never drawn; a null source is a source; sources without words have target 0. The order behind
    everything is md5 of the id, then size and text, so reruns agree; rows that repeat id and text are
    interchangeable. Columns that aren't named are ignored. An empty table gives an empty result.
    """
    named = [F.col(c).alias(f"_carry_{c}") for c in carry]
    extra = [f"_carry_{c}" for c in carry]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), words(F.col("text")).alias("size"), _hash(F.lit(seed), F.col("doc_id")).alias("key"), F.xxhash64("text").alias("tie"), *named)
    slim, _ = written(rows.drop(*extra), "sized")
    rows = rows if extra else slim
    goal, _ = written(targets(slim), "targets")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / docs_per_block)).cast("long")
    goal = goal.withColumn("blocks", blocks)
    # a handful of rows, one for each source
    goal = small(goal, 200)
    block = F.expr("cast(conv(substr(key, 1, 8), 16, 10) as bigint) * blocks div 4294967296")

    def placed(df: DataFrame) -> DataFrame:
        return df.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("block", block).drop("_source")

    sums = placed(slim).groupBy("idx", "block", "whole", "rest").agg(F.sum("size").alias("words"))
    in_order = Window.partitionBy("idx").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts, _ = written(sums.withColumn("start", F.coalesce(F.sum("words").over(in_order), F.lit(0).cast("long"))), "blocks")
    drawn = starts.filter("words > 0").select("idx", "block", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))).alias("pass"), "whole", "rest").filter("pass < whole or start < rest")
    permuted = drawn.select("idx", "block", "pass", F.row_number().over(Window.partitionBy("idx").orderBy(_hash(F.lit(seed), F.lit("draw"), F.col("idx"), F.col("pass"), F.col("block")), "pass", "block")).alias("j"))
    ends = shard_quotas(drawn.groupBy("idx").agg(F.count(F.lit(1)).alias("quota")), shards, seed)
    ends = ends.withColumn("end", F.sum("quota").over(Window.partitionBy("idx").orderBy("shard"))).groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    shard = F.size(F.filter("ends", lambda e: e < F.col("j")))
    draws = permuted.join(ends, "idx").groupBy("idx", "block").agg(F.array_sort(F.collect_list(F.struct("pass", shard.alias("shard")))).alias("of_block"))
    plan, _ = written(starts.select("idx", "block", "start").join(draws, ["idx", "block"], "left"), "draws")

    inside = Window.partitionBy("idx", "block").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    found = placed(rows).withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long"))).join(small(plan, 120), ["idx", "block"])
    cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("_before")))
    each = F.transform(F.coalesce("of_block", F.array().cast("array<struct<pass:bigint,shard:int>>")), lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.when(d["pass"] < F.col("whole"), F.col("size")).otherwise(cut).alias("words")))
    return found.select("doc_id", "source", "size", "source_size", "target", F.filter(each, lambda d: d["words"] > 0).alias("draws"), *[F.col(x).alias(c) for c, x in zip(carry, extra, strict=True)])


def first_words(text: Column, n: Column) -> Column:
    """The beginning of a text up to the end of its n-th word, n at least 1."""
    spaced = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{SPACED_WORD}"), F.lit(0))
    return F.when(n >= words(text), text).otherwise(F.array_join(F.slice(spaced, F.lit(1), n.cast("int")), ""))


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """The mix itself: rows of ``docs`` (its columns), one for each draw, in shards and shuffled within each.

    A row that is cut has the beginning of its text and the n_chars of that, if there is such a column.
    """
    columns = docs.columns
    place = {c: f"_c_{i}" for i, c in enumerate(columns)}
    carried = docs.select("doc_id", "source", "text", *[F.col(f"`{c}`").alias(x) for c, x in place.items()])
    rows = mix(carried, tuple(place.values()), shards, seed=seed).withColumn("_draw", F.explode("draws"))
    cut = F.col("_draw.words") < F.col("size")
    text = F.col(place["text"])
    rows = rows.withColumn("_cut", F.when(cut, first_words(text, F.col("_draw.words"))).otherwise(text))
    # shards have equal numbers of draws and the hash is even, so ranges of both need no sampling of the rows
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_order", _hash(F.lit(seed), F.lit("row"), F.col("doc_id"), F.col("_draw.pass")))
    share = F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / (1 << 32)
    part = F.floor((F.col("_draw.shard") + share) * partitions / shards).cast("int")
    rows = rows.repartitionById(partitions, part).sortWithinPartitions(F.col("_draw.shard"), F.col("_order"))
    value = {c: F.col(x) for c, x in place.items()} | {"text": F.col("_cut")}
    if "n_chars" in place:
        value["n_chars"] = F.when(cut, F.char_length("_cut").cast("long")).otherwise(F.col(place["n_chars"]))
    return rows.select(*[value[c].alias(c) for c in columns])
