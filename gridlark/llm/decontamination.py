"""Benchmark passages in documents, found with a distributed positional inverted index.

The index is partitioned by document, as search engines do it: each partition
stores the postings (term, document, position) of its documents, ordered by
term, and nothing is shuffled to build it. A document's entry (term LENGTH)
holds its number of words. Terms that no test item has can't be part of any
match, so only the others are stored where the vocabulary is given.

A search works from the rarest terms. Of each window of a test item the rarest
term's postings are read and intersected with those of the second rarest at the
offset between the two; only where both agree are the item's remaining terms
intersected at their offsets. Runs of agreeing positions as long as the window
are exact phrase matches. Every step is an equality join on term or position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small, written

WINDOW = 10
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands in the index for a document's length, at the position after its last word; the second for rows without id.
LENGTH, LENGTH_NULL = -1, -2


def word_list(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def test_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(it, item, words) of the items that have words; item is the id as a string, "" for none."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), word_list(F.col(text_col)).alias("words")).distinct()
    return rows.filter(F.size("words") > 0).select(F.monotonically_increasing_id().alias("it"), "item", "words")


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Postings (d, h, pos, tid) of the documents' terms in ``vocabulary`` (term, tid), and where they are written.

    d is the id (0 for none) and h a hash of the text, which together stand for a row; rows that repeat both
    are one document.
    """
    text, none = F.col(text_col), F.col(id_col).isNull()
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("d"), F.xxhash64(F.coalesce(text, F.lit("")), none).alias("h"), none.alias("none"), word_list(text).alias("words"))
    # the empty string, which is no word, ends each document and gets the entry for its length
    tokens = rows.select("d", "h", "none", F.posexplode(F.array_append("words", "")).alias("pos", "term"))
    ends = docs.sparkSession.createDataFrame([("", LENGTH)], "term string, tid long")
    known = small(vocabulary.select("term", "tid").unionAll(ends), 64)
    postings = tokens.join(known, "term").select("d", "h", "pos", F.when((F.col("tid") == LENGTH) & F.col("none"), LENGTH_NULL).otherwise(F.col("tid")).alias("tid"))
    return written(postings.sortWithinPartitions("tid"), "postings")


def rarest_pairs(items: DataFrame, vocabulary: DataFrame, postings: DataFrame, window: int = WINDOW) -> DataFrame:
    """(it, a, a_tid, b, b_tid): item positions of the two rarest terms of each window; windows with unseen terms drop out."""
    seen = postings.groupBy("tid").agg(F.count(F.lit(1)).alias("f")).join(vocabulary, "tid", "right").select("term", "tid", F.coalesce("f", F.lit(0)).alias("f"))
    placed = items.select("it", F.posexplode("words").alias("pos", "term")).join(small(seen, 72), "term")
    terms = placed.groupBy("it").agg(F.array_sort(F.collect_list(F.struct("pos", "tid", "f"))).alias("terms"))
    size = F.size("terms")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), size - window))
    ranked = F.transform(starts, lambda w: F.array_sort(F.transform(F.slice(F.col("terms"), w + 1, F.lit(window)), lambda t: F.struct(t["f"].alias("f"), t["pos"].alias("pos"), t["tid"].alias("tid")))))
    pair = terms.select("it", F.explode(ranked).alias("w")).filter("w[0].f > 0")
    second = F.coalesce(F.get("w", F.lit(1)), F.col("w")[0])
    return pair.select("it", F.col("w")[0]["pos"].alias("a"), F.col("w")[0]["tid"].alias("a_tid"), second["pos"].alias("b"), second["tid"].alias("b_tid")).distinct()


def phrase_matches(items: DataFrame, vocabulary: DataFrame, postings: DataFrame, window: int = WINDOW) -> DataFrame:
    """(d, h, it, first, last): stretches of document positions covered by windows of an item that occur there.

    A window is ``window`` consecutive words of an item, or a whole item that has fewer.
    """
    pairs, _ = written(rarest_pairs(items, vocabulary, postings, window), "pairs")
    hits = postings.join(small(pairs, 40), F.col("tid") == F.col("a_tid"))
    hits = hits.select("d", "h", "it", (F.col("pos") - F.col("a")).alias("diagonal"), (F.col("pos") - F.col("a") + F.col("b")).cast("int").alias("pos"), F.col("b_tid").alias("tid")).distinct()
    others = small(pairs.select(F.col("b_tid").alias("tid")).distinct(), 24)
    # rows that repeat id and text have the same postings, of which one is enough
    seconds = postings.join(others, "tid", "left_semi").distinct()
    met, _ = written(hits.join(seconds, ["d", "h", "pos", "tid"]).select("d", "h", "it", "diagonal").distinct(), "met")

    whole = items.select("it", F.size("words").alias("n"), F.posexplode("words").alias("ipos", "term")).join(small(vocabulary, 64), "term").select("it", "n", "ipos", "tid")
    asked = met.join(small(whole, 40), "it").select("d", "h", "it", "diagonal", "n", "ipos", (F.col("diagonal") + F.col("ipos")).alias("pos"), "tid")
    within = postings.join(small(met.select("d", "h").distinct(), 32), ["d", "h"], "left_semi").distinct()
    agreed = asked.join(within, ["d", "h", "pos", "tid"]).groupBy("d", "h", "it", "diagonal").agg(F.first("n").alias("n"), F.array_sort(F.collect_set("ipos")).alias("at"))
    # a position starts a run where the one before is missing; a run is as long as the item at most
    run = F.transform("at", lambda p, i: F.struct((p - i).alias("run"), p.alias("p")))
    runs = agreed.select("d", "h", "it", "diagonal", "n", F.explode(run).alias("r")).groupBy("d", "h", "it", "diagonal", "n", "r.run").agg(F.min("r.p").alias("lo"), F.max("r.p").alias("hi"))
    long_enough = runs.filter(F.col("hi") - F.col("lo") + 1 >= F.least(F.col("n"), F.lit(window)))
    return long_enough.select("d", "h", "it", (F.col("diagonal") + F.col("lo")).alias("first"), (F.col("diagonal") + F.col("hi")).alias("last"))


def proximity_matches(items: DataFrame, vocabulary: DataFrame, postings: DataFrame, within: int) -> DataFrame:
    """(d, h, it, pos): occurrences of an item's rarest term with all its other terms at most ``within`` words away, in any order."""
    freq = postings.groupBy("tid").agg(F.count(F.lit(1)).alias("f"))
    terms = items.select("it", F.explode("words").alias("term")).distinct().join(small(vocabulary, 64), "term")
    terms = terms.select("it", "tid").join(small(freq, 24), "tid", "left")
    per = terms.groupBy("it").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "tid")).alias("rarest"), F.count(F.lit(1)).alias("n")).filter("rarest.f > 0")
    centres = postings.join(small(per, 40), F.col("tid") == F.col("rarest.tid")).select("d", "h", "it", "n", F.col("pos").alias("centre"))
    asked = centres.join(small(terms.select("it", "tid"), 24), "it")
    # positions are cut into stretches of 2 * within + 1 words, so that near ones are in the same or the next stretch
    wide = 2 * within + 1
    near = asked.select("*", F.explode(F.array_distinct(F.array(F.floor((F.col("centre") - within) / wide), F.floor((F.col("centre") + within) / wide)))).alias("s"))
    found = near.join(postings.withColumn("s", F.floor(F.col("pos") / wide)), ["d", "h", "tid", "s"]).filter(F.abs(F.col("pos") - F.col("centre")) <= within)
    return found.groupBy("d", "h", "it", "centre").agg(F.countDistinct("tid").alias("m"), F.first("n").alias("n")).filter("m = n").select("d", "h", "it", F.col("centre").alias("pos"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_list, contaminated per input row.

    item_list is a sorted array of the ids, as strings, of items with a window in the document. Null texts have no
    words; null ids are kept; an item without an id counts as the item ""; items without words match nothing;
    repeated items count once and repeated documents give repeated rows. Other columns are ignored.
    """
    tests, _ = written(test_items(items), "items")
    words = tests.select(F.explode("words").alias("term")).distinct()
    vocabulary, _ = written(words.select("term", F.monotonically_increasing_id().alias("tid")), "vocabulary")
    postings, _ = build_index(docs, vocabulary)
    found, _ = written(phrase_matches(tests, vocabulary, postings, window), "matches")
    covered = found.select("d", "h", F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy("d", "h").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("d", "h", "it").distinct().join(small(tests.select("it", "item"), 64), "it").groupBy("d", "h").agg(F.array_sort(F.collect_set("item")).alias("item_list"))
    hits = covered.join(named, ["d", "h"])
    lengths = postings.filter(F.col("tid") < 0).select("d", "h", "pos", "tid")
    rows = lengths.join(hits, ["d", "h"], "left")
    none = F.array().cast("array<string>")
    return rows.select(F.when(F.col("tid") == LENGTH, F.col("d")).alias("doc_id"), F.col("pos").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(F.coalesce("item_list", none)).cast("long").alias("n_items"), F.coalesce("item_list", none).alias("item_list"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns kept, that have no window of any item.

    Where rows of different text share an id, all of them go if one is contaminated.
    """
    bad = decontaminate(docs, items, window).filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad"]), "left_anti")
