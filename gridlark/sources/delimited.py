"""Delimited text read in parallel, quoted line breaks, ragged rows and blank lines included.

Where a record ends depends on all quotes before it, so a file can't be cut
blindly. Two jobs read it in byte ranges. The first finds out, for each state
that a range may begin in, the state it ends in and how many records end in
it; composing these few numbers on the driver gives each range's true state
and first row number. The second job parses the records that begin in each
range. Neither job needs the ranges in order, and nothing is shuffled.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import detect, index_cache

RANGE_BYTES = 32 << 20
_READ = 1 << 20

#: States between two bytes: a field begins, within an unquoted field, within quotes, after a quote within quotes,
#: and after a carriage return that ended a record.
FIELD, PLAIN, QUOTED, QUOTE, RETURN = range(5)


class Outcome(NamedTuple):
    state: int
    records: int


def scan(data: bytes, state: int, delimiter: bytes, opened: dict[int, int] | None = None, known: tuple[dict[int, int], Outcome] | None = None) -> tuple[Outcome, int]:
    """Runs over bytes from a state: the outcome, and the place after the first record's end (-1: none ends).

    It goes from quote to quote and only counts line ends between them. ``opened`` gets the places of quotes that
    open a field, with the records ended before; from such a place on, a run from another state is ``known``.
    """
    n, at, records, first, openers = len(data), 0, 0, -1, b"\r\n" + delimiter
    if n and state == RETURN:
        at = first = int(data[0] == 10)
        state = FIELD
    elif n and state == QUOTE:
        at, state = (1, QUOTED) if data[0] == 34 else (0, PLAIN)
    while at < n:
        if state == QUOTED:
            at = data.find(b'"', at) + 1
            if not at:
                return Outcome(QUOTED, records), first
            if at == n:
                return Outcome(QUOTE, records), first
            if data[at] == 34:
                at += 1
            else:
                state = PLAIN
            continue
        quote = data.find(b'"', at)
        while quote >= 0 and not (data[quote - 1] in openers if quote > at else state == FIELD):
            quote = data.find(b'"', quote + 1)
        end = quote if quote >= 0 else n
        ended = data.count(b"\n", at, end) + data.count(b"\r", at, end) - data.count(b"\r\n", at, end)
        if ended and first < 0:
            first = min(x for x in (data.find(b"\n", at, end), data.find(b"\r", at, end)) if x >= 0) + 1
            first += data[first - 1] == 13 and data[first : first + 1] == b"\n"
        records += ended
        if quote < 0:
            last = data[n - 1]
            return Outcome(RETURN if last == 13 else FIELD if last in openers else PLAIN, records), first
        if opened is not None:
            opened[quote] = records
        if known and quote in known[0]:
            return Outcome(known[1].state, records + known[1].records - known[0][quote]), first
        at, state = quote + 1, QUOTED
    return Outcome(state, records), first


def outcomes_of(data: bytes, delimiter: bytes) -> list[Outcome]:
    """What comes of the bytes from each state."""
    opened: dict[int, int] = {}
    found, _ = scan(data, FIELD, delimiter, opened)
    return [found, *[scan(data, s, delimiter, known=(opened, found))[0] for s in range(1, 5)]]


def rows(text: str, delimiter: str) -> Iterator[list[str]]:
    """Cells of the records of a text that begins with one; the last may lack its line end."""
    d = re.escape(delimiter)
    field = re.compile(rf'(?:"((?:[^"]++|"")*+)"?+([^{d}\r\n]*+)|([^{d}\r\n]*+))({d}|\r\n|\r|\n|\Z)')
    row: list[str] = []
    for m in field.finditer(text):
        inside, rest, plain, end = m.groups()
        if inside is not None:
            if '"' in inside:
                inside = inside.replace('""', '"')
            if "\r" in inside:
                inside = inside.replace("\r\n", "\n").replace("\r", "\n")
            plain = inside + rest
        if end == delimiter:
            row.append(plain)
            continue
        if not end and not row and m.start() == m.end():
            return
        row.append(plain)
        yield row
        if not end:
            return
        row = []


#: Bytes of records that are parsed one by one where they can't be parsed at once.
_FEW = 1 << 16


def _split(body: bytes, delimiter: bytes) -> int:
    """The end of the record that the middle of some records is in; 0 if there is none before their end."""
    middle = len(body) // 2
    state = scan(body[:middle], FIELD, delimiter)[0].state
    if state == RETURN and body[middle] != 10:
        return middle
    end = scan(body[middle:], state, delimiter)[1]
    return middle + end if 0 < end < len(body) - middle else 0


def tables(body: bytes, delimiter: str, width: int) -> Iterator[tuple[list[pa.Array], pa.Array]]:
    """Columns of UTF-8 records, as texts, and the cells beyond ``width`` of each.

    Arrow parses all records at once if they have ``width`` cells; otherwise the halves are tried, and few records go
    through ``rows``, which also takes short, long and blank ones and what isn't UTF-8.
    """
    names = [f"c{i}" for i in range(width)]
    try:
        if b"\0" in body:
            raise pa.ArrowInvalid("a zero byte")
        found = csv.read_csv(
            pa.BufferReader(body),
            csv.ReadOptions(use_threads=False, block_size=max(len(body) + 1, 1 << 16), column_names=names),
            csv.ParseOptions(delimiter=delimiter, newlines_in_values=True, ignore_empty_lines=False),
            csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False),
        ).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in found.columns]
        columns = [c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in columns]
        if b"\r" in body:
            columns = [pc.replace_substring(pc.replace_substring(c, "\r\n", "\n"), "\r", "\n") if pc.any(pc.match_substring(c, "\r")).as_py() else c for c in columns]
        none = pa.ListArray.from_arrays(pa.array([0] * (len(found) + 1), pa.int32()), pa.array([], pa.string()))
        yield columns, none
    except pa.ArrowInvalid:
        cut = _split(body, delimiter.encode()) if len(body) > _FEW else 0
        if cut:
            yield from tables(body[:cut], delimiter, width)
            yield from tables(body[cut:], delimiter, width)
            return
        some = list(rows(body.decode("utf-8", "replace"), delimiter))
        yield [pa.array([c[j] if j < len(c) else "" for c in some], pa.string()) for j in range(width)], pa.array([c[width:] for c in some], pa.list_(pa.string()))


@dataclass(frozen=True)
class Delimited:
    """What is known of a file: its place, encoding, delimiter, header and size."""

    path: str
    encoding: str
    skip: int
    delimiter: str
    header: list[str]
    size: int


def _local(path: str) -> str:
    return path.removeprefix("file://")


def inspect(path: str, encoding: str | None = None, delimiter: str | None = None) -> Delimited:
    """Detects what isn't given, from samples of the file. Texts of two or four bytes a character are refused."""
    path = _local(path)
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        parts = []
        for at in dict.fromkeys((0, max(0, size // 2 - detect.SAMPLE // 2), max(0, size - detect.SAMPLE))):
            f.seek(at)
            parts.append(f.read(detect.SAMPLE))
        found, skip = detect.encoding(parts)
        if found.startswith(("utf-16", "utf-32")):
            raise ValueError(f"{found} text isn't supported")
        encoding = encoding or found
        delimiter = delimiter or detect.delimiter(parts[0][skip:])
        f.seek(skip)
        head = f.read(detect.SAMPLE)
        while scan(head, FIELD, delimiter.encode())[1] < 0 and (more := f.read(detect.SAMPLE)):
            head += more
    first = next(rows(head.decode(encoding, "replace"), delimiter), [""])
    return Delimited(path, encoding, skip, delimiter, first, size)


def _ranges(source: Delimited, range_bytes: int) -> list[tuple[int, int, int]]:
    return [(k, s, min(s + range_bytes, source.size)) for k, s in enumerate(range(source.skip, source.size, range_bytes))]


def read(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None, header: bool = True, range_bytes: int = RANGE_BYTES, cache: str | None = None) -> tuple[DataFrame, list[str]]:
    """``_row`` (1-based), c0 … cN as text and ``_extra`` (cells beyond the header), and the header's names.

    The file must be readable under ``path`` by every executor. With a ``cache`` folder, the first job is left out
    where an unchanged file has been read before. Cells that a row lacks are empty texts; an empty
    file has one column without a name and no rows.
    """
    source = inspect(path, encoding, delimiter)
    names = source.header or [""]
    names = names if header else [f"Column{i + 1}" for i in range(len(names))]
    schema = "_row long, " + ", ".join(f"c{i} string" for i in range(len(names))) + ", _extra array<string>"
    ranges = _ranges(source, range_bytes)
    if not ranges:
        return spark.createDataFrame([], schema), names
    sep = source.delimiter.encode()
    # small ranges that follow each other share a task
    tasks = min(len(ranges), max(spark.sparkContext.defaultParallelism, -(-source.size // RANGE_BYTES)))
    task = F.expr(f"cast(k * {tasks}L div {len(ranges)} as int)")

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, s, e in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with open(source.path, "rb") as f:
                    f.seek(s)
                    data = f.read(e - s)
                found = outcomes_of(data, sep)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([[x.state for x in found]], pa.list_(pa.int32())), pa.array([[x.records for x in found]], pa.list_(pa.int64()))], names=["k", "states", "records"])

    outcomes = index_cache.load(cache, source.path, source.delimiter, range_bytes) if cache else None
    if outcomes is None:
        plan = spark.createDataFrame(ranges, "k int, s long, e long").repartitionById(tasks, task)
        # a handful of numbers for each range
        outcomes = [(list(x.states), list(x.records)) for x in sorted(plan.mapInArrow(survey, "k int, states array<int>, records array<long>").collect())]
        if cache:
            index_cache.save(cache, source.path, source.delimiter, range_bytes, outcomes)
    state, row, begins = FIELD, 0, []
    for (k, s, e), (states, ended) in zip(ranges, outcomes, strict=True):
        begins.append((k, s, e, state, row, k == 0, states[state]))
        row += ended[state]
        state = states[state]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, s, e, state, row, first_range, left in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                with open(source.path, "rb") as f:
                    f.seek(max(s - 1, 0))
                    before = f.read(1) if s > source.skip else b""
                    f.seek(s)
                    data = f.read(e - s)
                    # a record that begins here may end in a later range
                    fresh = first_range or state == RETURN or state == FIELD and before in (b"\r", b"\n")
                    at = (1 if state == RETURN and data[:1] == b"\n" else 0) if fresh else scan(data, state, sep)[1]
                    if at < 0 or at >= len(data):
                        continue
                    body = data[at:]
                    while left not in (FIELD, RETURN) or body[-1:] not in (b"\r", b"\n"):
                        more = f.read(_READ)
                        outcome, end = scan(more, left, sep)
                        body += more if end < 0 else more[:end]
                        if end >= 0 or not more:
                            break
                        left = outcome.state
                number = row if fresh else row + 1
                if source.encoding not in ("utf-8", "ascii"):
                    body = body.decode(source.encoding, "replace").encode()
                width = len(names)
                for columns, extra in tables(body, source.delimiter, width):
                    n = len(extra)
                    numbers = pa.array(range(number + (not header), number + n + (not header)), pa.int64())
                    batch_of = pa.RecordBatch.from_arrays([numbers, *columns, extra], names=["_row", *[f"c{j}" for j in range(width)], "_extra"])
                    if header and number <= 0:
                        batch_of = batch_of.slice(1 - number)
                    number += n
                    for k in range(0, batch_of.num_rows, 10_000):
                        yield batch_of.slice(k, 10_000)

    work = spark.createDataFrame(begins, "k int, s long, e long, state int, row long, first boolean, left int").repartitionById(tasks, task)
    return work.mapInArrow(parse, schema), names
