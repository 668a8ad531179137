"""Helpers that the corpus operators share: inputs, scratch tables, word rules, bounded broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when a count has shown that it has no more bytes than this.
BROADCAST_BYTES = 32 << 20

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Complement of the white space 0x20 and 0x09-0x0D.
SPACED_WORD = r"[^\x20\x09-\x0D]+"

_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """Folder for written intermediates: below ``spark.checkpoint.dir``, which driver and executors share.

    A folder of this machine is used only where that setting is absent (local tests).
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = f"{shared.rstrip('/')}/gridlark-{uuid.uuid4().hex[:12]}" if shared else f"file://{tempfile.mkdtemp(prefix='gridlark-')}"
        atexit.register(_forget, spark, _scratch[app])
    return _scratch[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session may already be gone when the interpreter ends
        return


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, codec: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def arrow_batches(spark: SparkSession, size: int) -> AbstractContextManager[None]:
    """What runs meanwhile hands rows to Python in batches of about so many bytes, whatever their number; a longer row is a batch of its own."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def dropped_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """What runs meanwhile leaves no shuffle files when it is over; Spark otherwise deletes them when the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows fit BROADCAST_BYTES; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def crc32_mod(column: str, by: int) -> Column:
    """crc32 of an id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def keep_memory(size: int = 64 << 20) -> None:
    """Lets this process keep freed memory of some size for the next arrays, instead of giving it back each time.

    Short-lived arrays of a few megabytes otherwise cost page faults that take as long as the arithmetic. Without
    the C library's ``mallopt`` nothing changes but the time.
    """
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):
        return
    mallopt(-1, size)  # M_TRIM_THRESHOLD
    mallopt(-3, size)  # M_MMAP_THRESHOLD


def release_memory() -> None:
    """Gives freed memory back after a task, so that idle workers don't hold it; without ``malloc_trim`` only that of Arrow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return
