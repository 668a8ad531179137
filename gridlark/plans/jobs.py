"""Work that can be called off: everything a block starts carries a tag, by which it can be interrupted."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started in this block carry the tag."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Interrupts all running jobs with the tag, whichever thread started them."""
    spark.sparkContext.cancelJobsWithTag(tag)


def progress(spark: SparkSession) -> dict[int, tuple[int, int]]:
    """Tasks done and in all, of each stage that runs."""
    tracker = spark.sparkContext.statusTracker()
    found = {s: tracker.getStageInfo(s) for s in tracker.getActiveStageIds()}
    return {s: (i.numCompletedTasks, i.numTasks) for s, i in found.items() if i}
