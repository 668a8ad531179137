"""Delimited text, workbooks, exports and streams."""

from __future__ import annotations

import csv
import io
import json
import os
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlark.operators.profile import Hint
from gridlark.plans import jobs
from gridlark.sinks import export
from gridlark.sources import delimited, detect, index_cache, workbook
from gridlark.sources.table import Table, open_table, open_text
from gridlark.streaming import live


def plain(data: bytes, sep: int = 44) -> list[list[str]]:
    """One byte after the other, as the format is described."""
    rows, row, cell, state, i = [], [], bytearray(), "field", 0
    pending = False
    while i < len(data):
        b, i, pending = data[i], i + 1, True
        if state == "quoted":
            if b == 34 and data[i : i + 1] == b'"':
                cell.append(34)
                i += 1
            elif b == 34:
                state = "plain"
            elif b == 13:
                cell.append(10)
                i += data[i : i + 1] == b"\n"
            else:
                cell.append(b)
        elif b == 34 and state == "field":
            state = "quoted"
        elif b == sep:
            row.append(cell.decode("utf-8", "replace"))
            cell, state = bytearray(), "field"
        elif b in (10, 13):
            i += b == 13 and data[i : i + 1] == b"\n"
            rows.append([*row, cell.decode("utf-8", "replace")])
            row, cell, state, pending = [], bytearray(), "field", False
        else:
            cell.append(b)
            state = "plain"
    return rows + ([[*row, cell.decode("utf-8", "replace")]] if pending else [])


PIECES = st.lists(st.sampled_from(['"', '""', ",", "\n", "\r", "\r\n", "a", "b c", "é", '"x,y"', '"p\r\nq"']), max_size=30).map("".join)


@settings(max_examples=600, deadline=None)
@given(PIECES)
def test_records_and_fields(text):
    data = text.encode()
    assert list(delimited.rows(text, ",")) == plain(data)


@settings(max_examples=400, deadline=None)
@given(PIECES, st.integers(0, 40))
def test_a_scan_in_two_parts_is_a_scan(text, cut):
    data = text.encode()
    whole, _ = delimited.scan(data, delimited.FIELD, b",")
    a, _ = delimited.scan(data[:cut], delimited.FIELD, b",")
    b, _ = delimited.scan(data[cut:], a.state, b",")
    assert (b.state, a.records + b.records) == (whole.state, whole.records)
    assert delimited.outcomes_of(data, b",") == [delimited.scan(data, s, b",")[0] for s in range(5)]
    assert whole.records + (bool(data) and whole.state not in (delimited.FIELD, delimited.RETURN) or data.endswith(b",")) == len(plain(data))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab,"\n é', max_size=6), min_size=2, max_size=4), min_size=1, max_size=6))
def test_agrees_with_the_csv_module(rows):
    f = io.StringIO()
    csv.writer(f).writerows(rows)
    assert list(delimited.rows(f.getvalue(), ",")) == rows


@pytest.mark.parametrize("range_bytes", [7, 64, 1 << 20])
def test_ranges_do_not_show(spark, tmp_path, range_bytes):
    rng = random.Random(range_bytes)
    cells = ["", "a", "b c", '"x, y"', '"two\r\nlines"', '"say ""hi"""', 'mid"quote', '"ab"c', "서울"]
    text = "n,x,y\r\n" + "".join(f"{i},{rng.choice(cells)},{rng.choice(cells)}{rng.choice([chr(13) + chr(10), chr(10), chr(13)])}" for i in range(60)) + "\n61,short\n62,a,b,more,cells\nlast,1,2"
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    df, names = delimited.read(spark, str(path), range_bytes=range_bytes)
    expected = plain(text.encode())
    assert names == expected[0] == ["n", "x", "y"]
    found = [(r._row, [r.c0, r.c1, r.c2], r._extra) for r in df.orderBy("_row").collect()]
    assert found == [(i, (r + ["", ""])[:3], r[3:]) for i, r in enumerate(expected[1:], 1)]


def test_encodings_and_delimiters(spark, tmp_path):
    path = tmp_path / "k.csv"
    path.write_bytes("이름;값\n가나;1\n".encode("cp949"))
    t = open_table(spark, str(path))
    assert t.names == ["이름", "값"] and t.df.first().c0 == "가나" and t.source["encoding"] == "cp949" and t.source["delimiter"] == ";"
    path.write_bytes("﻿a\tb\n1\t2".encode())
    t = open_table(spark, f"file://{path}")
    assert t.names == ["a", "b"] and [tuple(r)[:3] for r in t.df.collect()] == [(1, "1", "2")] and t.row(1).count() == 1
    path.write_bytes(b"")
    t = open_table(spark, str(path))
    assert t.names == [""] and t.df.count() == 0
    path.write_bytes("a,b".encode("utf-16"))
    with pytest.raises(ValueError):
        open_table(spark, str(path))
    assert [detect.delimiter(x) for x in (b"a|b|c,d", b'"a,b";c', b"abc", b"a,b;c")] == ["|", ";", ",", ","]
    assert detect.is_utf8("é".encode()[:1]) and not detect.is_utf8("é".encode()[:1], cut=False) and not detect.is_utf8(b"\xc0\xaf") and not detect.is_utf8(b"\xed\xa0\x80") and detect.encoding([b"a", "é".encode()[1:]]) == ("utf-8", 0)


def test_cached_index(spark, tmp_path, monkeypatch):
    path, folder = tmp_path / "i.csv", str(tmp_path / "cache")
    path.write_text("a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(50)))
    read = lambda: sorted((r._row, r.c0, r.c1) for r in delimited.read(spark, str(path), range_bytes=64, cache=folder)[0].collect())
    first = read()
    assert len(first) == 50 and read() == first and index_cache.load(folder, str(path), ",", 64) is not None
    path.write_text("a,b\n1,2\n")
    assert read() == [(1, "1", "2")] and index_cache.clear(folder, str(path)) == 2 and index_cache.clear(folder) == 0
    monkeypatch.setattr(index_cache, "MOST_RECORDS", 0)
    assert read() == [(1, "1", "2")] and index_cache.load(folder, str(path), ",", 64) is None


def test_cancelled_jobs(spark):
    import threading
    import time

    outcome = []

    def work():
        with jobs.tagged(spark, "slow"):
            try:
                spark.range(0, 4, 1, 4).select(F.java_method(F.lit("java.lang.Thread"), F.lit("sleep"), F.lit(60_000).cast("long"))).collect()
                outcome.append("done")
            except Exception as e:  # noqa: BLE001
                outcome.append(str(e))

    t = threading.Thread(target=work)
    t.start()
    time.sleep(4)
    jobs.progress(spark)
    jobs.cancel(spark, "slow")
    t.join(50)
    assert outcome and outcome[0] != "done"


def test_clipboard(spark, tmp_path):
    t = open_text(spark, "a\tb\n1\t2\n3")
    assert t.names == ["a", "b"] and [tuple(r) for r in t.df.collect()] == [(1, "1", "2", []), (2, "3", "", [])]
    path = tmp_path / "x y.csv"
    path.write_text("n\n5\n")
    assert open_text(spark, f"file://{tmp_path}/x%20y.csv").df.first().c0 == "5" and open_text(spark, str(path)).view().distribution("n").first().max == 5


XLSX = {
    "[Content_Types].xml": "<Types/>",
    "xl/workbook.xml": '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="Alpha" sheetId="1" r:id="a"/><sheet name="Beta" sheetId="2" r:id="b"/><sheet name="Empty" sheetId="3" r:id="c"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/><Relationship Id="c" Target="worksheets/s3.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>Le</t></r><r><t>e</t></r></si></sst>",
    "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
    "xl/worksheets/s1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>age</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>25.50</v></c></row><row r="4"><c r="B4" t="b"><v>1</v></c><c r="C4" s="1"><v>45292</v></c><c r="D4" s="2"><v>45292.5</v></c></row></sheetData></worksheet>',
    "xl/worksheets/s2.xml": '<worksheet><sheetData><row><c t="inlineStr"><is><t>city</t></is></c></row><row><c t="inlineStr"><is><t>Seoul</t></is></c></row></sheetData></worksheet>',
    "xl/worksheets/s3.xml": "<worksheet><sheetData/></worksheet>",
}


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        for name, text in XLSX.items():
            z.writestr(name, text)
    t = open_table(spark, path)
    assert t.names == ["name", "age"] and t.source["sheets"] == ["Alpha", "Beta", "Empty"]
    assert [tuple(r) for r in t.df.orderBy("_row").collect()] == [(1, "Lee", "25.5", []), (2, "", "", []), (3, "", "true", ["2024-01-01", "2024-01-01 12:00:00"])]
    assert open_table(spark, path, sheet="Beta").df.first().c0 == "Seoul" and open_table(spark, path, sheet="Empty").df.count() == 0
    with pytest.raises(NotImplementedError):
        open_table(spark, "old.xls")


def test_declared_types():
    sas, spss = workbook.sas_hint, workbook.spss_hint
    assert [sas(False, f) for f in ("WONX", "YEN", "EURO", "DOLLAR", "NLMNY")] == [Hint("currency", s) for s in "₩¥€$$"]
    assert (sas(False, "PERCENT"), sas(False, "E"), sas(False, "E8"), sas(False, "BEST"), sas(False, "", 2), sas(False, "YYMMDDS"), sas(False, "EURDFDD"), sas(True, "DOLLAR")) == (Hint("percent"), Hint("scientific"), Hint("scientific"), Hint("integer"), Hint("float"), None, None, None)
    assert (spss(False, False, False, "DOLLAR"), spss(False, True, False, "CCA"), spss(False, False, False, "PCT"), spss(False, False, False, "WKDAY"), spss(False, False, False, "ADATE")) == (Hint("currency", "$"), Hint("currency"), Hint("percent"), Hint("categorical"), Hint("date"))
    assert (spss(True, False, True, "A"), spss(True, True, True, "A"), spss(False, True, False, "F"), spss(False, False, False, "F", 2), spss(False, False, False, "F"), spss(False, False, True, "F")) == (None, Hint("ordinal"), Hint("categorical"), Hint("float"), Hint("integer"), Hint("ordinal"))
    assert workbook.spss_name("@1st") == "1st" and workbook.is_importable("A.XLSM") and not workbook.is_importable("a.csv") and workbook.has_labels("x.sav")
    assert [workbook.cell_text(v) for v in (None, float("nan"), True, 2.50, 3.0, 1e-7, "x")] == ["", "", "true", "2.5", "3", "0.0000001", "x"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', "x\r\ny|z"), (2, "<b>&", None)], "id long, value string, other string").coalesce(1)
    names = ["id", "", ""]
    files = {}
    for end in ("csv", "md", "json", "html"):
        export.export(df, str(tmp_path / f"o.{end}"), names)
        files[end] = (tmp_path / f"o.{end}").read_bytes().decode()
    assert files["csv"] == '﻿id,,\r\n1,"a,""b""","x\r\ny|z"\r\n2,<b>&,\r\n'
    assert files["md"].splitlines()[2] == '| 1 | a,"b" | x y\\|z |'
    assert json.loads(files["json"]) == [{"id": "1", "value": 'a,"b"', "value (2)": "x\r\ny|z"}, {"id": "2", "value": "<b>&", "value (2)": ""}]
    assert "<td>&lt;b&gt;&amp;</td>" in files["html"] and "<td>x<br>y|z</td>" in files["html"]
    assert [export.format_of(p) for p in ("a.MD", "a.htm", "a.json", "a.txt")] == ["markdown", "html", "json", "csv"]
    back, _ = delimited.read(spark, str(tmp_path / "o.csv"))
    assert [r.c1 for r in back.orderBy("_row").collect()] == ['a,"b"', "<b>&"]
    assert list(export.column_tsv(df, "other", F.col("other"))) == ["other", "x y|z", ""]
    grid = [["A1", "B\t1", "C1"], ["A2", "B2", "C\n2"]]
    assert export.rectangle_tsv(grid, {(0, 1), (1, 2)}) == "B 1\t\n\tC 2" and export.rectangle_tsv(grid, set()) == ""
    assert json.loads(export.record_json({"a": "1"})) == {"a": "1"}
    export.export_parts(df, str(tmp_path / "parts"))
    assert spark.read.text(str(tmp_path / "parts")).count() == 3  # a quoted line break


def test_tables_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", 7.0), (3, "a", 1.0)], "id long, k string, x double")
    t = Table.from_df(df, ["id"])
    assert [p.type for p in t.profile()] == ["identifier", "categorical", "integer"] and t.describe_source()["columns"] == 3
    df.write.parquet(str(tmp_path / "in"))
    stream = live.arriving(spark, str(tmp_path / "in"), df)
    live.run_available(live.running_counts(stream, ["k"], F.col("x"), F.col("x") > 2), "seen")
    assert sorted(map(tuple, spark.table("seen").collect())) == [("a", 1, 5.0), ("b", 1, 7.0)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", ",", ",", '"', '""', "\n", "\r\n", "\r", "x,y,z\n", '"q\r\nr",s,t\n', "é", " "]), max_size=40).map("".join))
def test_records_parsed_at_once_equal_those_parsed_one_by_one(t):
    """Ragged, blank and quoted records included; pieces are made small, so that records are cut apart as well."""
    few, delimited._FEW = delimited._FEW, 4
    try:
        found = []
        for columns, extra in delimited.tables(t.encode(), ",", 3):
            found += [list(r) for r in zip(*[c.to_pylist() for c in columns], extra.to_pylist(), strict=True)]
    finally:
        delimited._FEW = few
    assert found == [[*(r[j] if j < len(r) else "" for j in range(3)), r[3:]] for r in delimited.rows(t, ",")]


@pytest.mark.parametrize("kind", ["csv", "markdown", "json", "html"])
def test_exports_are_put_together_by_executors(spark, tmp_path, monkeypatch, kind):
    from pyspark.sql import DataFrame

    rows = [(i, f'a "{i}",\r\nb' if i % 3 else "é" * (i % 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, t string").repartition(7).orderBy("k")
    paths = [str(tmp_path / f"{n} %20.{kind}") for n in ("whole", "streamed", "none")]
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "toLocalIterator", lambda *_: pytest.fail("rows went through the driver"))
        export.export(df, paths[0], kind=kind)
        export.export(df.limit(0), paths[2], kind=kind)
    assert os.listdir(tmp_path) and not [n for n in os.listdir(tmp_path) if n.endswith(".parts")]
    with monkeypatch.context() as m:  # a folder whose parts the driver doesn't see
        m.setattr(export.os, "listdir", lambda _: [])
        export.export(df, paths[1], kind=kind)
    whole, streamed, none = (open(p, "rb").read() for p in paths)
    assert whole == streamed and len(whole) > len(none) > 0
    if kind == "json":
        assert [tuple(r.values()) for r in json.loads(whole)] == [(str(k), t) for k, t in rows] and json.loads(none) == []


def test_small_ranges_share_tasks(spark, tmp_path):
    path = tmp_path / "many.csv"
    path.write_text("a\n" + "".join(f"{i}\n" for i in range(5000)))
    df, _ = delimited.read(spark, str(path), range_bytes=64)
    assert df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert [(r._row, r.c0) for r in df.collect()] == [(i + 1, str(i)) for i in range(5000)]
