"""Spreadsheets as source and sink: values, foreign files, faults and commits."""

from __future__ import annotations

import zipfile
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from salesmart.model import RawTables
from salesmart.operators import quality
from salesmart.sources import cells, sinks, workbooks
from salesmart.sources.tables import read_raw

SCHEMA = (
    "id bigint, n int, flag boolean, share double, price decimal(12,2), wide decimal(38,4), text string, day date, at timestamp_ntz"
)
ROWS = [
    (1, -5, True, 0.1, Decimal("12.30"), Decimal("12345678901234567890.1234"), "שלום <&> \"x\"", date(2024, 2, 29), datetime(2024, 2, 29, 23, 59, 59)),
    (2**63 - 1, 2**31 - 1, False, 1e300, Decimal("-0.01"), Decimal("0.0001"), "  two\r\nlines\t ", date(1899, 12, 31), datetime(1900, 2, 28, 1, 2, 3)),
    (-(2**63), 0, None, -0.0, Decimal("9999999999.99"), None, "", date(1900, 3, 1), datetime(2024, 1, 1, 0, 0, 0, 1)),
    (4, None, None, float("inf"), None, None, "_x0041_ \x01 ￾ 😀", date(9999, 12, 31), datetime(2024, 1, 1, 10, 20, 30, 123000)),
    (5, None, None, None, None, None, None, None, None),
    (10**15, None, None, 123456789.123456789, Decimal("0.00"), Decimal("-99999999999.9999"), "1", date(1, 1, 1), datetime(1, 1, 1)),
]


def write(df, path, mode="overwrite", **options):
    workbooks.register(df.sparkSession)
    df.write.format("workbooks").mode(mode).options(**options).save(str(path))


def read(spark, path, schema=SCHEMA, **options):
    workbooks.register(spark)
    return spark.read.format("workbooks").schema(schema).options(**options).load(str(path))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_values_come_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    write(df.coalesce(1), tmp_path / "all")
    assert rows(read(spark, tmp_path / "all")) == ROWS


def test_moments_with_a_zone_come_back(spark, tmp_path):
    df = spark.sql("select timestamp'2024-07-01 12:34:56.789' as at, timestamp'1850-01-01 00:00:00' as old")
    write(df, tmp_path / "t")
    assert rows(read(spark, tmp_path / "t", "at timestamp, old timestamp")) == rows(df)


def test_blank_rows_are_kept_on_demand(spark, tmp_path):
    df = spark.createDataFrame([(1,), (None,), (3,)], "n int").coalesce(1)
    write(df, tmp_path / "b")
    assert rows(read(spark, tmp_path / "b", "n int")) == [(1,), (3,)]
    assert rows(read(spark, tmp_path / "b", "n int", blankRows=True)) == [(1,), (None,), (3,)]


def test_order_is_kept_over_files(spark, tmp_path):
    df = spark.range(25_000, numPartitions=3).withColumn("t", F.concat(F.lit("r"), "id"))
    write(df.orderBy(F.desc("id")), tmp_path / "o", maxRowsPerFile=4_000)
    assert len(list((tmp_path / "o").glob("*.xlsx"))) >= 7
    assert all(len(list(_sheet(p))) <= 4_001 for p in (tmp_path / "o").glob("*.xlsx"))
    found = [r.id for r in read(spark, tmp_path / "o", "id bigint, t string").collect()]
    assert found == list(range(24_999, -1, -1))


def _sheet(path):
    with zipfile.ZipFile(path) as archive:
        yield from workbooks.Book(archive).rows(None)


def test_overwrite_and_append(spark, tmp_path):
    write(spark.range(10), tmp_path / "w")
    write(spark.range(5), tmp_path / "w")
    assert sorted(rows(read(spark, tmp_path / "w", "id bigint"))) == [(i,) for i in range(5)]
    write(spark.range(5, 7), tmp_path / "w", "append")
    assert read(spark, tmp_path / "w", "id bigint").count() == 7
    write(spark.range(0), tmp_path / "w")
    assert rows(read(spark, tmp_path / "w", "id bigint")) == []
    assert len(list((tmp_path / "w").iterdir())) == 1  # the header alone, nothing staged


def test_a_failed_write_leaves_the_old_files(spark, tmp_path):
    write(spark.range(10), tmp_path / "f")
    before = sorted(p.name for p in (tmp_path / "f").iterdir())
    bad = spark.range(100, numPartitions=4).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        write(bad.select("id"), tmp_path / "f")
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == before


def test_long_texts_are_an_error_not_a_cut(spark, tmp_path):
    assert cells.encode_text("😀" * 16_383)
    with pytest.raises(ValueError):
        cells.encode_text("😀" * 16_384)
    with pytest.raises(Exception, match="32767"):
        write(spark.range(1).select(F.repeat(F.lit("a"), 32_768).alias("t")), tmp_path / "l")


def test_what_cannot_be_written(spark, tmp_path):
    with pytest.raises(Exception, match="array"):
        write(spark.sql("select array(1) as a"), tmp_path / "x")
    with pytest.raises(ValueError, match="no rows"):
        sinks.write_workbooks(spark.range(0), str(tmp_path / "none"))


# ---- a file as office programs write them

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SHARED = (
    f'<sst {MAIN}><si><t>id</t></si><si><t>day</t></si><si><t> price </t></si><si><r><t>ri</t></r><r><rPr><b/></rPr><t>ch</t></r>'
    "<rPh><t>aid</t></rPh></si><si><t>note</t></si><si><t>n/a</t></si></sst>"
)
STYLES = (
    f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="[$-40D]dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.00&quot; days&quot;"/>'
    '</numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="22"/></cellXfs></styleSheet>'
)
SHEET = (
    f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="s"><v>2</v></c>'
    '<c r="AB1" t="s"><v>4</v></c></row>'
    '<row r="2"><c r="A2"><v>1</v></c><c r="C2" s="1"><v>45351</v></c><c r="D2"><v>10.300000000000001</v></c><c r="AB2" t="s"><v>3</v></c></row>'
    '<row r="4"><c r="A4"><v>2.0</v></c><c r="C4" t="s"><v>5</v></c><c r="D4" t="e"><v>#DIV/0!</v></c><c r="AB4" s="2"><v>3</v></c></row>'
    '<row r="5"><c r="A5" t="str"><v>3</v></c><c r="C5" t="d"><v>2024-03-01T00:00:00</v></c><c r="D5"><f>1+1</f><v>1.005</v></c><c r="AB5" s="3"><v>45351.4166666667</v></c></row>'
    '<row r="6"><c r="A6" s="1"/></row>'
    '<row><c><v>4.5</v></c><c/><c><v>60</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>'
)


def office_file(path: Path, sheet=SHEET, book_props="", shared=SHARED) -> str:
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("_rels/.rels", f'<Relationships xmlns="p"><Relationship Id="r1" Type="{REL}/officeDocument" Target="/xl/workbook.xml"/></Relationships>')
        z.writestr(
            "xl/workbook.xml",
            f'<workbook {MAIN} xmlns:r="{REL}">{book_props}<sheets><sheet name="First" sheetId="1" r:id="rId3"/><sheet name="Other" sheetId="2" r:id="rId4"/></sheets></workbook>',
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="p"><Relationship Id="rId3" Type="{REL}/worksheet" Target="worksheets/a.xml"/><Relationship Id="rId4" Type="{REL}/worksheet" Target="/xl/b.xml"/>'
            f'<Relationship Id="rId5" Type="{REL}/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="rId6" Type="{REL}/styles" Target="styles.xml"/></Relationships>',
        )
        z.writestr("xl/worksheets/a.xml", sheet)
        z.writestr("xl/b.xml", f'<worksheet {MAIN}><sheetData/></worksheet>')
        z.writestr("xl/sharedStrings.xml", shared)
        z.writestr("xl/styles.xml", STYLES)
    return str(path)


def test_office_file(spark, tmp_path):
    path = office_file(tmp_path / "office.xlsx")
    found = rows(read(spark, path, "note string, id int, day date, price decimal(6,2)"))
    assert found == [
        ("rich", 1, date(2024, 2, 29), Decimal("10.30")),
        ("3", 2, None, None),
        ("2024-02-29 10:00:00", 3, date(2024, 3, 1), Decimal("1.01")),
        (None, None, None, Decimal("1.00")),  # 4.5 is no whole number, day 60 never was, a truth value counts 1
    ]
    assert rows(read(spark, path[:-5], "day string").limit(3)) == [("2024-02-29",), ("n/a",), ("2024-03-01T00:00:00",)]
    with pytest.raises(Exception, match="whole number"):
        read(spark, path, "id int", mode="FAILFAST").collect()


def test_epoch_of_1904(spark, tmp_path):
    path = office_file(tmp_path / "mac.xlsx", book_props='<workbookPr date1904="1"/>')
    assert rows(read(spark, path, "day date"))[0] == (date(2028, 3, 1),)


def test_sheets_and_headers(spark, tmp_path):
    path = office_file(tmp_path / "s.xlsx")
    assert rows(read(spark, path, "id int", sheet="Other")) == []
    for schema, options, message in (("id int", {"sheet": "Third"}, "no sheet"), ("id int, gone int", {}, "has no column 'gone'")):
        with pytest.raises(Exception, match=message):
            read(spark, path, schema, **options).collect()
    twice = office_file(tmp_path / "twice.xlsx", shared=SHARED.replace("note", "id"))
    assert rows(read(spark, twice, "day string").limit(1)) == [("2024-02-29",)]
    with pytest.raises(Exception, match="repeats the column 'id'"):
        read(spark, twice, "id int").collect()
    with pytest.raises(Exception, match="FileNotFound"):
        read(spark, tmp_path / "absent", "id int").collect()


@pytest.mark.parametrize("number,code,dated", [(14, "", True), (9, "", False), (164, "#,##0.00", False), (164, '0 "days"', False), (164, "[Red]0", False), (164, "mmm yy", True)])
def test_date_formats(number, code, dated):
    assert cells.is_date_format(number, {164: code}) is dated


def test_an_extract_of_files_is_cleaned(spark, tmp_path):
    """One file a table; a bad date reaches the cleaning step as text."""
    tables = {
        "stores": "select 1L store_id, 'א' store_name, 'c' city, 'r' region, 'mall' store_type, date'2001-01-01' opening_date",
        "products": "select 1L product_id, 'p' product_name, 'k' category, 'b' brand, 2.50 price, 1.25 cost",
        "customers": "select 1L customer_id, 'n' customer_name, 'F' gender, 30 age, '26-35' age_group, 'e' email, 'c' city",
        "sales": "select id + 1 sale_id, if(id = 2, 'soon', '2024-02-0' || (id + 1)) sale_date, 1L store_id, 1L product_id, 1L customer_id, "
        "2 quantity, 5.00 revenue, 2.50 cost, 2.50 profit from range(3)",
    }
    for name, sql in tables.items():
        write(spark.sql(sql).coalesce(1), tmp_path / "parts" / name)
        (part,) = (tmp_path / "parts" / name).glob("*.xlsx")
        (tmp_path / f"{name}.xlsx").write_bytes(part.read_bytes())
    raw = read_raw(spark, str(tmp_path), "workbooks")
    assert isinstance(raw, RawTables) and raw.stores.first().store_name == "א"
    assert [r.sale_date for r in raw.sales.orderBy("sale_id").collect()] == ["2024-02-01", "2024-02-02", "soon"]
    assert [r.sale_id for r in quality.clean(raw).sales.orderBy("sale_id").collect()] == [1, 2]
