"""The corpus pipeline: stages that read documents and hand on what they keep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm import decontamination, mixing, near_copies, quality, token_files
from gridlark.llm.common import table, written

#: Words that a process of the last stage remembers: executors still hold memory of the stages before.
REMEMBERED_WORDS = 200_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on those at hand, doesn't reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.score_udf(model)(F.col("text")) >= quality.THRESHOLD)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8), that with the smallest id.

    SimHash fingerprints and MinHash bands give the candidates, which their exact similarity decides.
    """
    return near_copies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time that the mix takes a document; the document at a source's target is cut there."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the documents' token ids as compressed shards, and returns what these hold for each document."""
    return token_files.read_documents(token_files.write_shards(docs, remembered=REMEMBERED_WORDS, lean=True))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: The classifier is fitted with floating-point boosting, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = written(docs, "stage")
    return docs
