"""One registered query per corpus operator, with production parameters, and DuckDB SQL where that can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, licenses, lm_scoring, mixing, pii, quality, secrets, simhash, token_files
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect_pii(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    confirmed = F.filter("findings", lambda f: f["confirmed"])
    of = lambda fs, name: F.transform(fs, lambda f: f[name])
    found = found.select("doc_id", "n_paragraphs", F.size("findings").alias("n"), confirmed.alias("confirmed"), "wrapped")
    # a block counts for a family that no line of the document has by itself
    found = found.withColumn("wrapped", F.filter("wrapped", lambda f: ~F.array_contains(of("confirmed", "family"), f["family"])))
    families = F.array_join(F.array_sort(F.array_union(of("confirmed", "family"), of("wrapped", "family"))), ",")
    best = F.coalesce(F.array_max(F.concat(of("confirmed", "probability"), of("wrapped", "probability"))), F.lit(0.0))
    more = F.size("wrapped")
    return found.select("doc_id", "n_paragraphs", (F.col("n") + more).cast("long").alias("n_found"), (F.size("confirmed") + more).cast("long").alias("n_confirmed"), families.alias("families"), best.alias("best_probability"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(table(spark, sf_dir, "documents"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["words"])
    return drawn.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


#: The plan of the mix restated: targets by water-filling, then every document's words before it in md5 order.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS idx FROM s),
k AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, idx) AS k FROM w),
l AS (SELECT a.source, a.source_size, a.cap, a.weight, a.k,
             (SELECT sum(source_size) FROM k) - coalesce((SELECT sum(b.cap) FROM k b WHERE b.k < a.k), 0) AS remaining,
             (SELECT sum(b.weight) FROM k b WHERE b.k >= a.k) AS parts FROM k a),
f AS (SELECT k, remaining, parts FROM l
      WHERE k = (SELECT min(k) FROM l WHERE CAST(cap AS DOUBLE) / weight > CAST(remaining AS DOUBLE) / parts)),
t AS (SELECT l.source, l.source_size,
             CASE WHEN f.k IS NULL OR l.k < f.k THEN CAST(l.cap AS DOUBLE)
                  ELSE CAST(l.weight * f.remaining AS DOUBLE) / f.parts END AS target
      FROM l LEFT JOIN f ON true),
g AS (SELECT *, CAST(round(target) AS BIGINT) AS goal FROM t),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(goal // source_size, 3) ELSE 0 END AS passes FROM g),
o AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.goal - p.passes * p.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM o
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_list", ","), 256).alias("items_sha256"), "contaminated")


#: Every window of every item against every run of document words of that length.
OP5_SQL = r"""
WITH upper_case AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, upper_case),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, upper_case),
bi AS (SELECT item, w, least(10, len(w)) AS k, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i + 1 : i + k], ' ') AS s FROM bi),
ks AS (SELECT DISTINCT k FROM win),
di AS (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k),
hit AS (SELECT doc_id, i, di.k, item FROM di JOIN win ON di.k = win.k AND array_to_string(w[i + 1 : i + di.k], ' ') = win.s),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return exact_dedup.exact_duplicates(docs, carry=("text_sha256",))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_documents(token_files.write_shards(table(spark, sf_dir, "documents")))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_quality, op3_licenses, op4_mixing, op5_decontamination, op6_secrets, op7_simhash, op8_exact_dedup, op9_token_files, op10_lm_scoring)}
ORACLE_SQL: dict[str, str] = {"op4_mixing": OP4_SQL, "op5_decontamination": OP5_SQL, "op8_exact_dedup": OP8_SQL}
