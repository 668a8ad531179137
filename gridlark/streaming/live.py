"""Progressive loading: a folder that grows, under the same filters and aggregates as a table.

Rows show up as files arrive, like rows of a file that is still being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import numbers


def arriving(spark: SparkSession, folder: str, like: DataFrame, pattern: str = "*.parquet") -> DataFrame:
    """Stream of the Parquet files of a folder, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).parquet(folder)


def running_counts(stream: DataFrame, keys: list[str], value: Column | None = None, condition: Column | None = None) -> DataFrame:
    """n and sum by keys over all rows so far that fulfil the condition."""
    rows = stream if condition is None else stream.filter(condition)
    x = F.lit(0.0) if value is None else F.coalesce(value.cast("double"), F.lit(0.0))
    return rows.groupBy(*[numbers.text(F.col(k)).alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sum"))


def run_available(counts: DataFrame, name: str) -> StreamingQuery:
    """Processes what has arrived into the in-memory table ``name`` and ends."""
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
