"""Sheets taken apart in blocks hold what they hold row by row."""

from __future__ import annotations

import time
import zipfile
from datetime import datetime
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from salesmart.sources import cells, workbooks

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
FIRST = '<row r="1"><c r="A1" t="inlineStr"><is><t>a</t></is></c><c r="B1" t="inlineStr"><is><t>b</t></is></c></row>'
PLAIN = '<row r="2"><c r="A2" ><v>1</v></c><c r="B2" s="2"><v>45000.5</v></c></row><row r="3"><c r="B3" t="n"><v>7</v></c></row><row r="4"></row>'
TEXT = '<row r="5"><c r="A5" ><v>5</v></c><c r="B5" t="inlineStr"><is><t xml:space="preserve"> _x0041_ </t></is></c></row>'


def sheet(tmp_path, rows, head=HEAD + ">", begin="<sheetData>", end="</sheetData></worksheet>"):
    schema = T.StructType([T.StructField("a", T.LongType())])
    files, path = workbooks._opened(str(tmp_path))
    workbooks.SheetFile(files, f"{path}/parts.xlsx", "s", schema).close()
    with zipfile.ZipFile(tmp_path / "parts.xlsx") as old, zipfile.ZipFile(tmp_path / "made.xlsx", "w") as new:
        for name in old.namelist():
            new.writestr(name, head + begin + rows + end if name.endswith("sheet1.xml") else old.read(name))
    return zipfile.ZipFile(tmp_path / "made.xlsx")


def by_rows(book):
    header, *rest = book.rows(None)
    return [[row.get(p) for p in sorted(header)] for row in rest]


def by_blocks(book):
    _, *blocks = book.blocks(None)
    return [list(row) for block in blocks for row in zip(*block, strict=True)]


ODD = {
    "plain": PLAIN + TEXT,
    "entities": PLAIN + TEXT.replace("_x0041_", "&lt;&#65;&amp;"),
    "returns": PLAIN + TEXT.replace("_x0041_", "x\r\ny\rz"),
    "runs": PLAIN + '<row r="5"><c r="A5" t="inlineStr"><is><r><t>x</t></r><r><t>y</t></r></is></c></row>' + PLAIN,
    "formula": '<row r="2"><c r="A2"><f>1+1</f><v>2</v></c><c r="B2" t="str"><f>x</f><v>_x0042_</v></c></row>' + PLAIN,
    "errors": '<row r="2"><c r="A2" t="e"><v>#N/A</v></c><c r="B2" t="b"><v>1</v></c></row>' + PLAIN,
    "empty cells": '<row r="2"><c r="A2"/><c r="B2" s="1"></c></row><row r="3"><c r="A3"><v></v></c><c r="B3" t="inlineStr"><is><t></t></is></c></row>',
    "no places": "<row><c><v>1</v></c><c><v>2</v></c></row>" + PLAIN,
    "out of order": '<row r="2"><c r="B2"><v>1</v></c><c r="A2"><v>2</v></c></row>' + PLAIN,
    "more columns": '<row r="2"><c r="A2"><v>1</v></c><c r="C2"><v>2</v></c></row>' + PLAIN,
    "short rows": '<row r="2"/><row r="3" spans="1:2"/>' + PLAIN,
    "comment": PLAIN + "<!-- <row r='9'></row> -->" + PLAIN,
    "cdata": PLAIN + '<row r="5"><c r="A5" t="inlineStr"><is><t><![CDATA[</row><row>]]></t></is></c></row>',
    "prefixed attribute": '<row r="2" x14ac:dyDescent="0.25"><c r="A2"><v>1</v></c></row>' + PLAIN,
    "unbound in a block": PLAIN + '<row r="5"><c r="A5"><f x14ac:q="1">1</f><v>1</v></c></row>',
    "spaces": "\n " + PLAIN.replace("<row", "\n  <row"),
    "kinds in one column": PLAIN + TEXT + '<row r="6"><c r="A6"><is><t>x</t></is></c><c r="B6" t="inlineStr"><v>8</v></c></row>',
    "none": "",
}


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
@pytest.mark.parametrize("kind", ODD)
def test_blocks_hold_the_rows(tmp_path, monkeypatch, kind, block):
    monkeypatch.setattr(workbooks, "BLOCK", max(block, len(HEAD) + 250) if block > 1 else 400)
    with sheet(tmp_path, FIRST + ODD[kind] * 3, HEAD + ' xmlns:x14ac="u"><cols><col min="1"/></cols>') as archive:
        book = workbooks.Book(archive)
        assert by_blocks(book) == by_rows(book) and len(by_rows(book)) == 3 * (ODD[kind].count("<row") - (kind == "comment") - (kind == "cdata"))


def test_sheets_of_another_form_are_read_whole(tmp_path):
    text = FIRST + PLAIN
    for kind in ("prefix", "empty", "plain", "encoding"):
        rows, head = text, HEAD + ">"
        begin, end = "<sheetData>", "</sheetData></worksheet>"
        if kind == "prefix":
            rows, head = text.replace("<", "<x:").replace("<x:/", "</x:"), HEAD.replace("xmlns", "xmlns:x").replace("<work", "<x:work") + ">"
            begin, end = "<x:sheetData>", "</x:sheetData></x:worksheet>"
        elif kind == "encoding":
            head = head.replace("UTF-8", "us-ascii")
        elif kind == "empty":
            rows, begin, end = "", "<sheetData/>", "</worksheet>"
        with sheet(tmp_path, rows, head, begin, end) as archive:
            book = workbooks.Book(archive)
            assert [*book.blocks(None)] == [] if kind == "empty" else by_blocks(book) == by_rows(book) and len(by_rows(book)) == 3


def test_rows_are_written_as_cell_by_cell():
    kinds = [T.LongType(), T.DecimalType(12, 2), T.TimestampNTZType(), T.StringType(), T.DoubleType()]
    at = [datetime(2024, 1, 2, 3), None, datetime(1850, 1, 1), datetime(2024, 1, 2, 3)]
    columns = [
        pa.array([1, None, 10**15, 4]), pa.array([Decimal("1.50"), None, None, Decimal("-0.01")], pa.decimal128(12, 2)),
        pa.array(at, pa.timestamp("us")), pa.array(["<&>", None, "", "é"]), pa.array([0.1, None, float("nan"), -0.0]),
    ]
    for part in (slice(0, 4), slice(1, 3), slice(1, 2), slice(0, 0)):
        some = [c[part] for c in columns]
        texts = [cells.cell_texts(k, cells.writer_of(k), c) for k, c in zip(kinds, some)]
        expected = ""
        for i, row in enumerate(zip(*(c.to_pylist() for c in some)), 7):
            told = [f'<c r="{x}{i}" {cells.writer_of(k)(v)}' for x, k, v in zip("ABCDE", kinds, row) if v is not None]
            expected += f'<row r="{i}">{"".join(told)}</row>'
        assert bytes(cells.sheet_rows([*"ABCDE"], texts, 7, len(some[0]))).decode() == expected
    assert bytes(cells.sheet_rows([], [], 1, 2)) == b'<row r="1"></row><row r="2"></row>'


def test_plain_sheets_are_read_in_a_fraction_of_the_time(tmp_path):
    schema = T.StructType([T.StructField(c, T.LongType()) for c in "abcdef"])
    files, path = workbooks._opened(str(tmp_path))
    book = workbooks.SheetFile(files, f"{path}/n.xlsx", "s", schema)
    book.add(pa.record_batch([pa.array(range(30_000))] * 6, [*"abcdef"]))
    book.close()
    with zipfile.ZipFile(tmp_path / "n.xlsx") as archive:
        opened, taken = workbooks.Book(archive), []
        for read in (by_rows, by_blocks):
            begun = time.process_time()
            assert len(read(opened)) == 30_000
            taken.append(time.process_time() - begun)
    assert taken[1] < 0.6 * taken[0]
