"""Spreadsheet workbooks (``.xlsx``) as a Spark data source.

``register(spark)`` makes the format known to a session, then ``spark.read.format("workbooks")`` reads a
file or a folder of files, and ``df.write.format("workbooks")`` writes a folder of them. Each file is one
partition: its sheet's XML is streamed, so a task holds the shared texts of one workbook (a sheet has
1,048,576 rows at most) and one batch of rows. A task writes as many workbooks as its rows need; they
become visible when all tasks have ended. Paths are whatever Arrow's file systems open: local or mounted
folders, ``hdfs://``, ``s3://``, ``gs://``.
"""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import batched, islice
from uuid import uuid4
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from salesmart.sources import cells

FORMAT = "workbooks"
BATCH = 10_000  # rows handed to Spark at once
SHEET_ROWS = 1_048_576  # fixed by the file format, the header included
SUFFIX = ".xlsx"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbooks)


class Workbooks(DataSource):
    """Reading needs a schema; nothing is inferred. Columns are found by the names in the first row.

    Reading options: ``sheet`` (a name; else the first one), ``mode`` (``PERMISSIVE``: a cell that is no
    value of its column becomes null; ``FAILFAST``: it is an error), ``blankRows`` (``true`` keeps rows
    without any value). An empty sheet has no rows; a missing or repeated column is an error, others are
    left out. Text columns get dates in ISO form and numbers in their shortest form; errors in cells are
    null, formulas give their stored result. Moments are read as UTC, to the millisecond.

    Writing options: ``sheet``, the sheet's name, and ``maxRowsPerFile``, which defaults to what a sheet
    holds. Numbers of more than 15 digits, dates before March 1900 and moments with parts of a millisecond
    are written as text, which reads back as the same value. Null and empty cells differ: a null has no
    cell. A text over 32,767 characters is an error, as a cell can't hold it.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        raise ValueError("workbooks are read with a schema of one's own")

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, self.options, overwrite)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; Hadoop's short ``file:/`` form is a plain path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        path = posixpath.abspath(path)
    files, inner = fs.FileSystem.from_uri(path)
    return files, inner.rstrip("/")


def _workbooks(files: fs.FileSystem, path: str) -> list[str]:
    """The workbooks of a folder in the order of their names; those being written don't count."""
    found = files.get_file_info(fs.FileSelector(path, recursive=False))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(SUFFIX) and not f.base_name.startswith((".", "_", "~")))


def _path(options: dict) -> str:
    if not options.get("path"):
        raise ValueError("a path is needed")
    return options["path"]


# ---- reading


@dataclass
class WorkbookFile(InputPartition):
    path: str


def _local(element) -> str:
    return element.tag.rpartition("}")[2]


def _children(element, name: str):
    return (e for e in element if _local(e) == name)


def _plain_text(element) -> str:
    """The text of a string item: its own or that of its runs, without reading aids."""
    parts = []
    for e in element:
        if _local(e) == "t":
            parts.append(e.text or "")
        elif _local(e) == "r":
            parts.extend(t.text or "" for t in _children(e, "t"))
    return cells.decode_text("".join(parts))


@lru_cache(maxsize=None)
def _column_number(letters: str) -> int:
    number = 0
    for letter in letters.upper():
        number = number * 26 + ord(letter) - 64
    return number - 1


class _Other(Exception):
    """A sheet that isn't plain."""


BLOCK = 1 << 21  # bytes of a sheet taken apart at once
_BEGIN = re.compile(rb'(?:\xef\xbb\xbf)?<\?xml[^>]*encoding="(?:UTF|utf)-8"[^>]*\?>\s*<worksheet[^<>]*[^<>/]>(?:<(?!sheetData|!|\?)[^<>]*>)*<sheetData>')
_TOLD = re.compile('(?: s="([0-9]+)")?(?: t="([A-Za-z]+)")? ?')  # of a cell beside its place


@lru_cache(64)
def _row_pattern(places: tuple[int, ...]) -> re.Pattern:
    """A plain row with cells in these columns at most; of each what is told of it, its number and its text."""
    one = '(?:<c r="{}[0-9]+"([^<>]*)>(?:<v>([^<]*)</v>|<is><t(?: xml:space="preserve")?>([^<]*)</t></is>)</c>)?'
    return re.compile("<row(?: [^<>]*)?>" + "".join(one.format(_letters(p)) for p in places) + "</row>")


class Book:
    """An open workbook: its sheets, shared texts and date styles."""

    def __init__(self, archive: zipfile.ZipFile):
        self.archive = archive
        self.names = set(archive.namelist())
        links = self._links("_rels/.rels", "")
        main = next((target for kind, target in links.values() if kind == "officeDocument"), "xl/workbook.xml")
        folder, name = posixpath.split(main)
        self.links = self._links(f"{folder}/_rels/{name}.rels", folder)
        root = self._parsed(main)
        self.since_1904 = any(e.get("date1904") in ("1", "true") for e in _children(root, "workbookPr"))
        self.sheets = {}
        for sheets in _children(root, "sheets"):
            for sheet in sheets:
                link = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
                self.sheets[sheet.get("name")] = self.links[link][1]
        self.dated = self._date_styles()
        self.shared = self._shared_texts()

    def _parsed(self, name: str):
        with self.archive.open(name) as part:
            return ElementTree.parse(part).getroot()

    def _links(self, name: str, folder: str) -> dict[str, tuple[str, str]]:
        if name not in self.names:
            return {}
        return {
            e.get("Id"): (
                e.get("Type", "").rpartition("/")[2],
                posixpath.normpath(posixpath.join(folder, e.get("Target"))) if not e.get("Target").startswith("/") else e.get("Target")[1:],
            )
            for e in self._parsed(name)
        }

    def _part(self, kind: str) -> str | None:
        return next((target for k, target in self.links.values() if k == kind and target in self.names), None)

    def _date_styles(self) -> set[str]:
        """The numbers of the cell styles that show a date."""
        part = self._part("styles")
        if part is None:
            return set()
        root = self._parsed(part)
        codes = {int(f.get("numFmtId")): f.get("formatCode", "") for group in _children(root, "numFmts") for f in group}
        styles = [int(x.get("numFmtId", 0)) for group in _children(root, "cellXfs") for x in group]
        return {str(i) for i, number in enumerate(styles) if cells.is_date_format(number, codes)}

    def _shared_texts(self) -> list[str]:
        part = self._part("sharedStrings")
        if part is None:
            return []
        texts = []
        with self.archive.open(part) as stream:
            table = None
            for event, e in ElementTree.iterparse(stream, ("start", "end")):
                if table is None:
                    table = e
                elif event == "end" and _local(e) == "si":
                    texts.append(_plain_text(e))
                    table.clear()
        return texts

    def rows(self, sheet: str | None) -> Iterator[dict[int, tuple[str, str, bool]]]:
        """Each row as column number -> (kind, raw text, whether it shows a date); cells without a value are left out."""
        with self.archive.open(self._sheet(sheet)) as stream:
            tag = None
            for _, e in ElementTree.iterparse(stream):  # what stays of a row is an empty element
                if e.tag == tag or e.tag.endswith("}row"):
                    tag = e.tag
                    yield self._row(e)
                    e.clear()

    def blocks(self, sheet: str | None) -> Iterator[dict[int, tuple[str, str, bool]] | list[list]]:
        """The same rows, the first as in ``rows`` and then many at a time as columns of cells, one for each of the first's.

        A block is taken apart by a pattern if all its rows are plain: cells in order, each with a number or a text in
        one piece. Others are parsed. From where that can't be told of a block by itself, the sheet is read again as a whole.
        """
        rows = self.rows(sheet)
        header = next(rows, None)
        if header is None:
            return
        yield header
        rows.close()
        seen, places = 0, sorted(header)
        try:
            for block in self._plain_blocks(sheet):
                found = self._columns(block, places)
                if found is None:
                    lines = list(map(self._row, ElementTree.fromstring(f'<x xmlns="{_MAIN}">{block}</x>')))
                    found = [[line.get(place) for place in places] for line in lines] if all(line.keys() <= header.keys() for line in lines) else None
                    if found is None:
                        raise _Other
                    found = [*map(list, zip(*found))] or [[] for _ in places]
                yield found if seen else [column[1:] for column in found]
                seen += len(found[0])
        except (_Other, ElementTree.ParseError, UnicodeDecodeError):
            for some in batched(islice(self.rows(sheet), max(seen, 1), None), BATCH):
                yield [[line.get(place) for line in some] for place in places]

    def _sheet(self, sheet: str | None) -> str:
        if sheet is not None and sheet not in self.sheets:
            raise ValueError(f"there is no sheet {sheet!r} among {sorted(self.sheets)}")
        return self.sheets[sheet] if sheet is not None else next(iter(self.sheets.values()))

    def _plain_blocks(self, sheet: str | None) -> Iterator[str]:
        """Whole rows as text, some megabytes at a time, from the first row on."""
        with self.archive.open(self._sheet(sheet)) as stream:
            rest = stream.read(BLOCK)
            begin = _BEGIN.match(rest)
            if not begin:
                raise _Other
            rest = rest[begin.end() :]
            while True:
                end = rest.rfind(b"</row>") + 6
                if end > 5:
                    block, rest = rest[:end], rest[end:]
                    if not block.startswith(b"<row") or b"<!" in block or b"<?" in block:
                        raise _Other
                    yield block.decode()
                more = stream.read(BLOCK)
                if not more:
                    break
                rest += more
            if not rest.startswith(b"</sheetData>"):
                raise _Other

    def _columns(self, block: str, places: list[int]) -> list[list] | None:
        """Cells by column, if all rows of the block are plain."""
        found = _row_pattern(tuple(places)).findall(block)
        if len(found) != block.count("<row") or "&" in block or "\r" in block:
            return None
        columns = [*zip(*found)]
        out = []
        for told, numbers, texts in zip(columns[::3], columns[1::3], columns[2::3]):
            kinds = {t: _TOLD.fullmatch(t) for t in set(told)}
            if None in kinds.values():
                return None
            of = {t: (m[2] or "n", m[1] in self.dated) for t, m in kinds.items()}
            if any(k not in ("n", "inlineStr") or (k == "inlineStr") != ("inlineStr" in t) for t, (k, _) in of.items()):
                return None
            if all(k == "n" for k, _ in of.values()):
                if any(texts):
                    return None
                dated = {d for _, d in of.values()}
                if len(dated) == 1:
                    (shown,) = dated
                    out.append([("n", v, shown) if v else None for v in numbers])
                else:
                    out.append([("n", v, of[t][1]) if v else None for t, v in zip(told, numbers)])
            elif any(v if of[t][0] == "inlineStr" else x for t, v, x in zip(told, numbers, texts)):
                return None  # a text where a number is told, or a number where a text is
            else:
                out.append([
                    ("inlineStr", cells.decode_text(x), False) if of[t][0] == "inlineStr" else ("n", v, of[t][1]) if v else None
                    for t, v, x in zip(told, numbers, texts)
                ])
        return out

    def _row(self, row) -> dict[int, tuple[str, str, bool]]:
        found, at = {}, -1
        for c in row:
            told = c.attrib
            reference = told.get("r")
            at = _column_number(reference.rstrip("0123456789")) if reference else at + 1
            kind, value = told.get("t", "n"), None
            for e in c:
                tag = e.tag
                if tag.endswith("}v"):
                    value = e.text
                elif tag.endswith("}is"):
                    value = _plain_text(e)
            if value is None or kind == "e":
                continue
            if kind == "n":
                found[at] = (kind, value, told.get("s") in self.dated)
                continue
            if kind == "s":
                value = self.shared[int(value)]
            elif kind == "str":
                value = cells.decode_text(value)
            found[at] = (kind, value, False)
        return found


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema = schema
        self.path = _path(options)
        self.sheet = options.get("sheet")
        self.failfast = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.blank = options.get("blankRows", "false").lower() == "true"

    def partitions(self) -> list[WorkbookFile]:
        files, path = _opened(self.path)
        (info,) = files.get_file_info([path])
        if info.type == fs.FileType.NotFound:
            path += SUFFIX
            (info,) = files.get_file_info([path])
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [path] if info.type == fs.FileType.File else _workbooks(files, path)
        return [WorkbookFile(p) for p in found] or [WorkbookFile("")]

    def read(self, partition: WorkbookFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = _opened(self.path)
        with files.open_input_file(partition.path) as file, zipfile.ZipFile(file) as archive:
            book = Book(archive)
            blocks = book.blocks(self.sheet)
            header = next(blocks, None)
            if not header:
                return
            places = self._places(header, partition.path)
            order = sorted(header)
            readers = [cells.reader_of(f.dataType, book.since_1904) for f in self.schema]
            schema = to_arrow_schema(self.schema)
            for block in blocks:
                if not self.blank:
                    block = _without_blank_rows(block)
                for at in range(0, len(block[0]), BATCH):
                    some = [block[order.index(place)][at : at + BATCH] for place in places]
                    yield _batch(self._values(some, readers), schema, min(BATCH, len(block[0]) - at))

    def _values(self, columns: list[list], readers: list) -> list:
        """Columns of cells as columns of values."""
        return [
            plain if (plain := cells.read_plain(f.dataType, found)) is not None else [None if c is None else self._value(read, c) for c in found]
            for f, found, read in zip(self.schema, columns, readers, strict=True)
        ]

    def _places(self, header: dict, path: str) -> list[int]:
        names: dict[str, list[int]] = {}
        for place, (_, text, _) in header.items():
            names.setdefault(text.strip(), []).append(place)
        for field in self.schema:
            if len(names.get(field.name, ())) != 1:
                problem = "has no" if field.name not in names else "repeats the"
                raise ValueError(f"{path} {problem} column {field.name!r}")
        return [names[f.name][0] for f in self.schema]

    def _value(self, read, cell):
        try:
            return read(*cell)
        except cells.UNREADABLE:
            if self.failfast:
                raise
            return None


def _without_blank_rows(columns: list[list]) -> list[list]:
    if any(None not in column for column in columns):
        return columns
    kept = [any(c is not None for c in row) for row in zip(*columns)]
    return columns if all(kept) else [[c for c, keep in zip(column, kept) if keep] for column in columns]


def _batch(columns: list[list], schema: pa.Schema, rows: int) -> pa.RecordBatch:
    if not columns:
        return pa.RecordBatch.from_struct_array(pa.array([{}] * rows, pa.struct([])))
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)


# ---- writing

# Fixed values of the file format: the parts around the sheet.
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" '
    'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>'
    f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPE}.worksheet+xml"/>'
    f'<Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" '
    f'Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">'
    f'<Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/>'
    f'<Relationship Id="rId2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm:ss"/></numFmts>'
    '<fonts count="1"><font/></fonts><fills count="2"><fill/><fill><patternFill patternType="gray125"/></fill></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf xfId="0"/>'
    '<xf numFmtId="14" xfId="0" applyNumberFormat="1"/><xf numFmtId="164" xfId="0" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


def _letters(place: int) -> str:
    letters = ""
    place += 1
    while place:
        place, rest = divmod(place - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


class SheetFile:
    """A workbook of one sheet, written row by row; texts stand in their cells, so nothing is held."""

    def __init__(self, files: fs.FileSystem, path: str, sheet: str, schema: T.StructType):
        self.file = files.open_output_stream(path, compression=None)
        self.archive = zipfile.ZipFile(self.file, "w", zipfile.ZIP_DEFLATED, compresslevel=3)
        for name, text in _PARTS.items():
            self.archive.writestr(name, _HEAD + text)
        self.archive.writestr(
            "xl/workbook.xml",
            f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        self.letters = [_letters(i) for i in range(len(schema))]
        self.kinds = [f.dataType for f in schema]
        self.writers = [cells.writer_of(kind) for kind in self.kinds]
        self.part = self.archive.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.part.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        self.rows = 0
        text = cells.writer_of(T.StringType())
        self._write([pa.array([text(f.name)], pa.large_string()) for f in schema], 1)

    def add(self, batch: pa.RecordBatch) -> None:
        columns = [cells.cell_texts(kind, write, column) for column, kind, write in zip(batch.columns, self.kinds, self.writers, strict=True)]
        self._write(columns, batch.num_rows)

    def _write(self, columns: list[pa.Array], rows: int) -> None:
        self.part.write(cells.sheet_rows(self.letters, columns, self.rows + 1, rows))
        self.rows += rows

    def close(self) -> None:
        self.part.write(b"</sheetData></worksheet>")
        self.part.close()
        self.archive.close()
        self.file.close()


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WorkbookWriter(DataSourceArrowWriter):
    """Tasks write below ``_writing-…``; the driver moves what the committed tasks name, then removes the old.

    A task that fails, or runs twice, leaves nothing behind in the result. Names carry the partition's number, so
    that their order is the order of the rows. New files stand beside the old ones for the moment of the exchange.
    """

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        for field in schema:
            cells.writer_of(field.dataType)
        if len(set(schema.names)) < len(schema.names):
            raise ValueError("columns need different names")
        self.schema, self.overwrite = schema, overwrite
        self.path = _path(options)
        self.sheet = options.get("sheet", "Sheet1")
        self.rows_per_file = min(int(options.get("maxRowsPerFile", SHEET_ROWS)), SHEET_ROWS - 1)
        self.job = uuid4().hex

    def _staging(self, path: str) -> str:
        return f"{path}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, path = _opened(self.path)
        files.create_dir(self._staging(path), recursive=True)
        partition, attempt = TaskContext.get().partitionId(), uuid4().hex[:12]
        names: list[str] = []
        book = None
        for batch in iterator:
            while batch.num_rows:
                room = 0 if book is None else self.rows_per_file + 1 - book.rows  # beside the header
                if not room:
                    if book is not None:
                        book.close()
                    names.append(f"part-{partition:05d}-{len(names):05d}-{attempt}{SUFFIX}")
                    book, room = SheetFile(files, f"{self._staging(path)}/{names[-1]}", self.sheet, self.schema), self.rows_per_file
                head = batch.slice(0, min(BATCH, room))
                book.add(head)
                batch = batch.slice(head.num_rows)
        if book is not None:
            book.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        """An empty table becomes one workbook with the header alone."""
        files, path = _opened(self.path)
        files.create_dir(self._staging(path), recursive=True)
        old = _workbooks(files, path) if self.overwrite else []
        names = [name for m in messages if m is not None for name in m.names]
        if not names:
            names = [f"part-00000-00000-{self.job[:12]}{SUFFIX}"]
            SheetFile(files, f"{self._staging(path)}/{names[0]}", self.sheet, self.schema).close()
        for name in names:
            files.move(f"{self._staging(path)}/{name}", f"{path}/{name}")
        for book in old:
            files.delete_file(book)
        files.delete_dir(self._staging(path))

    def abort(self, messages: list[Written | None]) -> None:
        files, path = _opened(self.path)
        (staged,) = files.get_file_info([self._staging(path)])
        if staged.type == fs.FileType.Directory:
            files.delete_dir(staged.path)
