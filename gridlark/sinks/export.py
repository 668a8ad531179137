"""Rows as lines of CSV, Markdown, JSON, HTML or TSV, made by expressions; and files of such lines in view order."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.texts import stable_keys

_COPIED = 1 << 22
FORMATS = {".md": "markdown", ".json": "json", ".html": "html", ".htm": "html"}


def format_of(path: str) -> str:
    """Format by the file's extension; CSV if it is no other."""
    return next((f for e, f in FORMATS.items() if path.lower().endswith(e)), "csv")


def csv_row(cells: list[Column]) -> Column:
    """Commas; quotes around cells with a comma, quote or line break."""
    quoted = [F.when(t.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in map(numbers.text, cells)]
    return F.concat_ws(",", *quoted)


def markdown_row(cells: list[Column]) -> Column:
    escaped = [F.regexp_replace(F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), "\r\n|\r|\n", " ") for t in map(numbers.text, cells)]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *escaped), F.lit(" |"))


def json_row(names: list[str], cells: list[Column], pretty: bool = False) -> Column:
    """An object of texts with the keys in order; repeated and empty headers get keys of their own."""
    return F.to_json(F.struct(*[numbers.text(c).alias(k) for k, c in zip(stable_keys(names), cells, strict=True)]), {"pretty": str(pretty).lower()})


def html_cell(c: Column) -> Column:
    t = numbers.text(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, "\r\n|\r|\n", "<br>")


def html_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), html_cell(c), F.lit("</td>")) for c in cells], F.lit("</tr>"))


def tsv_row(cells: list[Column]) -> Column:
    return F.concat_ws("\t", *[F.regexp_replace(F.regexp_replace(numbers.text(c), "\r\n|\r|\n", " "), "\t", " ") for c in cells])


def rectangle_tsv(rows: list[list[str]], chosen: set[tuple[int, int]]) -> str:
    """The bounding box of chosen (row, column) cells of a small grid, others blank."""
    if not chosen:
        return ""
    rs, cs = [r for r, _ in chosen], [c for _, c in chosen]
    clean = lambda s: s.replace("\r\n", " ").replace("\n", " ").replace("\r", " ").replace("\t", " ")
    return "\n".join("\t".join(clean(rows[r][c]) if (r, c) in chosen else "" for c in range(min(cs), max(cs) + 1)) for r in range(min(rs), max(rs) + 1))


def column_tsv(df: DataFrame, name: str, cell: Column) -> Iterator[str]:
    """Header, then a column's cells, a line each."""
    yield name
    for r in df.select(tsv_row([cell]).alias("line")).toLocalIterator():
        yield r.line


def _plain_row(names: list[str], kind: str) -> str:
    if kind == "csv":
        return ",".join('"' + n.replace('"', '""') + '"' if any(x in n for x in ',"\n\r') else n for n in names)
    if kind == "markdown":
        return "| " + " | ".join(n.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ") for n in names) + " |\n|" + " --- |" * len(names)
    escaped = [n.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;") for n in names]
    return "".join(f"<th>{n}</th>" for n in escaped)


def _put_together(spark: SparkSession, path: str, head: bytes, parts: list[tuple[str, int]], tail: bytes) -> None:
    """One file of a head, parts of files with the bytes to take of each, and a tail; executors copy the parts to their places."""
    at, plan = len(head), []
    for k, (part, size) in enumerate(parts):
        plan.append((k, part, at, size))
        at += size
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(at)
        f.seek(at)
        f.write(tail)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open(r["part"], "rb") as source, open(path, "r+b") as target:
                    target.seek(r["at"])
                    left = r["size"]
                    while left and (some := source.read(min(left, _COPIED))):
                        target.write(some)
                        left -= len(some)
                yield pa.RecordBatch.from_arrays([pa.array([r["size"] - left], pa.int64())], names=["copied"])

    if plan:
        copied = spark.createDataFrame(plan, "k int, part string, at long, size long").repartitionById(len(plan), F.col("k")).mapInArrow(copy, "copied long")
        if copied.agg(F.sum("copied")).first()[0] != at - len(head):
            raise OSError(f"{path} lacks bytes of its parts")


def export(df: DataFrame, path: str, names: list[str] | None = None, columns: list[str] | None = None, kind: str | None = None) -> None:
    """One file of the DataFrame's rows in their order.

    Executors write a part for each partition beside the file and copy the parts to their places in it. Only where they
    don't share the file's folder with the driver are rows streamed through it, partition by partition. CSV is UTF-8
    with a byte order mark.
    """
    kind, columns = kind or format_of(path), columns or df.columns
    names = names or columns
    cells = [F.col(f"`{c}`") for c in columns]
    line = {"csv": csv_row, "markdown": markdown_row, "html": html_row}.get(kind, lambda c: json_row(names, c))(cells)
    end = {"csv": "\r\n", "json": ","}.get(kind, "\n")
    if kind == "json":
        head, tail, line = "[", "\n]\n", F.concat(F.lit("\n  "), line)
    else:
        shown = _plain_row(names, kind)
        head, tail = (f"<table>\n<thead><tr>{shown}</tr></thead>\n<tbody>\n", "</tbody>\n</table>\n") if kind == "html" else (shown + end, "")
    head, tail, lines = head.encode("utf-8-sig" if kind == "csv" else "utf-8"), tail.encode(), df.select(line.alias("line"))
    path = os.path.abspath(path)
    folder = f"{path}.{uuid.uuid4().hex}.parts"
    written = Observation()
    try:
        lines.observe(written, F.coalesce(F.sum(F.octet_length("line").cast("long") + len(end)), F.lit(0).cast("long")).alias("bytes")).write.text("file://" + folder, compression="none", lineSep=end)
        parts = [(f"{folder}/{n}", os.path.getsize(f"{folder}/{n}")) for n in sorted(os.listdir(folder)) if n.startswith("part-")]
        parts = [(part, size) for part, size in parts if size]
        if sum(size for _, size in parts) == written.get["bytes"]:
            if kind == "json" and parts:  # no comma after the last row
                parts[-1] = (parts[-1][0], parts[-1][1] - len(end))
            _put_together(df.sparkSession, path, head, parts, tail)
            return
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    with open(path, "wb") as f:
        f.write(head)
        for i, r in enumerate(lines.toLocalIterator()):
            f.write(((end if i else "") + r.line if kind == "json" else r.line + end).encode())
        f.write(tail)


def export_parts(df: DataFrame, path: str, names: list[str] | None = None) -> None:
    """CSV without header in as many files as the rows have partitions, written by the executors."""
    df.select(csv_row([F.col(f"`{c}`") for c in df.columns]).alias("value")).write.text(path)


def record_json(record: dict[str, str]) -> str:
    """One row, indented."""
    return json.dumps(record, ensure_ascii=False, indent=2)
