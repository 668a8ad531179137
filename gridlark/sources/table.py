"""Tables: opened files and DataFrames with a row key, names and declared types."""

from __future__ import annotations

import os
import tempfile
import time
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

from ..operators.profile import SAMPLE_ROWS, Hint, Profile, profiles
from ..plans.view import View, view_of
from . import delimited, workbook

LONGEST_PATH = 260


@dataclass(frozen=True)
class Table:
    df: DataFrame
    names: list[str]
    key: list[str]
    hints: list[Hint | None] | None = None
    source: dict[str, object] = field(default_factory=dict)

    @staticmethod
    def from_df(df: DataFrame, key: list[str], names: list[str] | None = None) -> Table:
        """A DataFrame whose key columns tell rows apart and give their order."""
        return Table(df, names or df.columns, key)

    def view(self) -> View:
        columns = [c for c in self.df.columns if c not in ("_row", "_extra")] if "_row" in self.df.columns else self.df.columns
        return view_of(self.df, self.key, self.names, columns)

    def profile(self, sample: int | None = SAMPLE_ROWS) -> list[Profile]:
        return profiles(self.df.select(*[c for c in self.df.columns if c not in ("_row", "_extra")]), self.names, self.hints, sample)

    def row(self, number: int) -> DataFrame:
        return self.df.filter(self.df[self.key[0]] == number)

    def describe_source(self) -> dict[str, object]:
        """Columns, and for files also size, encoding, delimiter and seconds taken to open."""
        return {"columns": len(self.names), **self.source}


def open_table(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None, sheet: str | None = None, labels: bool = False, cache: str | None = None) -> Table:
    """Opens a file by its extension: workbook (a sheet, the first by default), SAS, SPSS, Parquet or delimited text.

    ``labels`` takes variable labels as names where the format has them; ``cache`` is a folder for what is known of
    large text files.
    """
    began = time.time()
    low = path.lower()
    if low.endswith((".xlsx", ".xlsm", ".xls")):
        book = workbook.read_workbook(spark, path)
        name = sheet or next(iter(book))
        df, names = book[name]
        return Table(df, names, ["_row"], None, {"sheet": name, "sheets": list(book), "bytes": os.path.getsize(path)})
    if low.endswith(workbook.LABELLED):
        df, names, hints = (workbook.read_sas if low.endswith(".sas7bdat") else workbook.read_spss)(spark, path, labels)
        return Table(df, names, ["_row"], hints, {"bytes": os.path.getsize(path), "labels": labels})
    if low.endswith(".parquet"):
        df = spark.read.parquet(path)
        return Table(df, df.columns, [df.columns[0]])
    found = delimited.inspect(path, encoding, delimiter)
    df, names = delimited.read(spark, path, found.encoding, found.delimiter, cache=cache)
    seconds = time.time() - began
    return Table(df, names, ["_row"], None, {"bytes": found.size, "encoding": found.encoding, "delimiter": found.delimiter, "seconds": seconds, "gb_per_s": found.size / 1e9 / max(seconds, 1e-9)})


def open_text(spark: SparkSession, text: str) -> Table:
    """Clipboard text: a file address or path if it names a file, otherwise the delimited text itself."""
    line = text.strip().strip('"')
    if line.lower().startswith("file://"):
        line = unquote(urlparse(line).path)
    if "\n" not in line and 0 < len(line) < LONGEST_PATH and os.path.isfile(line):
        return open_table(spark, line)
    # a few cells typed or copied by hand: parsed here, not on executors
    from . import detect

    raw = text.encode()
    sep = detect.delimiter(raw)
    df, names = workbook.frame(spark, list(delimited.rows(text, sep)) or [[""]])
    return Table(df, names, ["_row"], None, {"bytes": len(raw), "delimiter": sep})


def temporary_csv(text: str) -> str:
    """Path of a new temporary file with the text, for tools that need one."""
    with tempfile.NamedTemporaryFile("w", suffix=".csv", delete=False, encoding="utf-8", newline="") as f:
        f.write(text)
    return f.name
