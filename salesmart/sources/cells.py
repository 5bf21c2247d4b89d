"""Values of spreadsheet cells, to and from typed columns.

A spreadsheet keeps numbers as doubles of 15 digits, dates as days since an epoch with a date
format, and text with characters that XML lacks written as ``_xHHHH_``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from functools import lru_cache
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

# Fixed values of the file format.
MAX_TEXT = 32_767  # UTF-16 units in a cell
DIGITS = 15  # of a number
EPOCH = datetime(1899, 12, 30)
EPOCH_1904 = datetime(1904, 1, 1)
FIRST_EXACT = datetime(1900, 3, 1)  # serial 60 is a 29 February 1900 that never was
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}  # built-in formats of dates and times
DATE_STYLE, MOMENT_STYLE = 1, 2  # of the workbooks written here

_CODED = re.compile("_x([0-9A-Fa-f]{4})_")
_UNWRITABLE = re.compile("[\x00-\x08\x0b-\x1f\ud800-\udfff￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_QUOTED = re.compile(r'"[^"]*"|\\.|_.|\[[^\]]*\]')
_WHOLE_MILLISECOND = 1000


def is_date_format(number: int, codes: dict[int, str]) -> bool:
    """Whether a number format shows a date or time; quoted text and colours in brackets don't count."""
    if number in codes:
        return bool(re.search("[dmyhs]", _QUOTED.sub("", codes[number]).lower()))
    return number in DATE_FORMATS


def decode_text(text: str) -> str:
    return _CODED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def encode_text(text: str) -> str:
    units = len(text) if len(text) <= MAX_TEXT // 2 else len(text.encode("utf-16-le", "surrogatepass")) // 2
    if units > MAX_TEXT:
        raise ValueError(f"a cell holds {MAX_TEXT} characters at most; a text has {units}")
    if _UNWRITABLE.search(text):
        text = _UNWRITABLE.sub(lambda m: f"_x{ord(m[0]):04X}_", text)
    return escape(text)


def moment(serial: Decimal, since_1904: bool) -> datetime | None:
    """The moment of a serial number, to the millisecond, which is what a spreadsheet keeps."""
    if not since_1904 and 60 <= serial < 61:
        return None
    epoch = EPOCH_1904 if since_1904 else EPOCH if serial >= 61 else EPOCH + timedelta(days=1)
    try:
        whole = int(serial // 1)
        thousandths = int(((serial - whole) * 86_400_000).to_integral_value(ROUND_HALF_UP))
        return epoch + timedelta(days=whole, milliseconds=thousandths)
    except OverflowError:
        return None


# ---- reading


def _text(kind: str, raw: str, dated: bool, since_1904: bool) -> str:
    """What a text column gets: dates in ISO form, numbers in their shortest form."""
    if kind == "b":
        return "true" if raw == "1" else "false"
    if kind != "n":
        return raw
    if dated and (at := moment(Decimal(raw), since_1904)) is not None:
        return at.date().isoformat() if at == datetime(at.year, at.month, at.day) else at.isoformat(" ")
    number = float(raw)
    return str(int(number)) if number.is_integer() and abs(number) < 10**DIGITS else repr(number)


def _number(kind: str, raw: str) -> Decimal:
    return Decimal(raw.strip())


def _whole(kind: str, raw: str, bits: int) -> int:
    exact = int(raw) if raw.isdecimal() else _number(kind, raw)
    number = int(exact)
    if number != exact or not -(2 ** (bits - 1)) <= number < 2 ** (bits - 1):
        raise ValueError(f"{raw} is no whole number of {bits} bits")
    return number


def _decimal(kind: str, raw: str, precision: int, scale: int) -> Decimal:
    """The number as written if it fits the scale, else its shortest form, rounded half up."""
    unit = Decimal(1).scaleb(-scale)
    number = _number(kind, raw)
    if number != number.quantize(unit):
        number = Decimal(repr(float(raw)))
    number = number.quantize(unit, ROUND_HALF_UP)
    if number.adjusted() >= precision - scale and number:
        raise ValueError(f"{raw} has more than {precision} digits")
    return number


def _moment(kind: str, raw: str, since_1904: bool) -> datetime:
    if kind == "n":
        at = moment(Decimal(raw), since_1904)
        if at is None:
            raise ValueError(f"{raw} is no date")
        return at
    at = datetime.fromisoformat(raw.strip())
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def _boolean(kind: str, raw: str) -> bool:
    told = {"1": True, "0": False, "true": True, "false": False}.get(raw.strip().lower())
    if told is None:
        raise ValueError(f"{raw} is no truth value")
    return told


def reader_of(kind: T.DataType, since_1904: bool) -> Callable:
    """A function from a cell (kind, raw text, whether its format is a date's) to a value of the column."""
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}.get(type(kind))
    if bits:
        return lambda k, raw, dated: _whole(k, raw, bits)
    if isinstance(kind, T.DecimalType):
        return lambda k, raw, dated: _decimal(k, raw, kind.precision, kind.scale)
    if isinstance(kind, T.StringType):
        moments = lru_cache(REMEMBERED)(lambda raw: _text("n", raw, True, since_1904))
        return lambda k, raw, dated: moments(raw) if dated else _text(k, raw, dated, since_1904)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return lambda k, raw, dated: float(raw)
    if isinstance(kind, T.BooleanType):
        return lambda k, raw, dated: _boolean(k, raw)
    if isinstance(kind, T.DateType):
        return lambda k, raw, dated: _moment(k, raw, since_1904).date()
    if isinstance(kind, T.TimestampNTZType):
        return lambda k, raw, dated: _moment(k, raw, since_1904)
    if isinstance(kind, T.TimestampType):
        return lambda k, raw, dated: _moment(k, raw, since_1904).replace(tzinfo=timezone.utc)
    raise TypeError(f"spreadsheets hold no {kind.simpleString()}")


_DIGITS_AND_SIGNS = str.maketrans("", "", "0123456789.-")
REMEMBERED = 1 << 16  # moments, of which a column repeats many


def read_plain(kind: T.DataType, cells: list) -> pa.Array | None:
    """A column of cells whose numbers are all written plainly and fit; None where each has to be read by itself."""
    return read_texts(kind, [None if c is None else c[1] for c in cells]) if isinstance(kind, PLAIN) else None


PLAIN = (T.IntegerType, T.LongType, T.DecimalType)


def read_texts(kind: T.DataType, raw: list[str | None]) -> pa.Array | None:
    """The same for the texts of cells."""
    told = "".join(filter(None, raw))
    try:
        if isinstance(kind, T.DecimalType):
            return pa.array(raw, pa.string()).cast(pa.decimal128(kind.precision, kind.scale)) if not told.translate(_DIGITS_AND_SIGNS) else None
        if told.isascii() and told.isdecimal():
            return pa.array(raw, pa.string()).cast(pa.int64() if isinstance(kind, T.LongType) else pa.int32())
    except pa.ArrowInvalid:
        pass
    return None


#: What a reader raises for a cell that is no value of its column.
UNREADABLE = (ValueError, InvalidOperation, OverflowError)


# ---- writing


def _as_text(text: str) -> str:
    return f't="inlineStr"><is><t xml:space="preserve">{encode_text(text)}</t></is></c>'


def _as_number(number: str, style: int = 0) -> str:
    return f's="{style}"><v>{number}</v></c>' if style else f"><v>{number}</v></c>"


def _write_decimal(number: Decimal) -> str:
    text = f"{number:f}"
    exact = len(text) <= DIGITS or len(number.as_tuple().digits) <= DIGITS
    return _as_number(text) if exact else _as_text(text)


@lru_cache(REMEMBERED)
def _write_moment(at: datetime) -> str:
    """A serial number; as ISO text where a serial number can't tell the moment exactly."""
    at = at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at
    if at < FIRST_EXACT or at.microsecond % _WHOLE_MILLISECOND:
        return _as_text(at.isoformat(" "))
    since = at - EPOCH
    part = Decimal(since.seconds * 1000 + since.microseconds // 1000) / 86_400_000
    return _as_number(f"{since.days + part.quantize(Decimal('1e-12')):f}", MOMENT_STYLE)


def _write_date(day: date) -> str:
    if day < FIRST_EXACT.date():
        return _as_text(day.isoformat())
    return _as_number(str((day - EPOCH.date()).days), DATE_STYLE)


def writer_of(kind: T.DataType) -> Callable:
    """A function from a value, not null, to its cell's XML after the reference."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return lambda v: _as_number(str(v)) if abs(v) < 10**DIGITS else _as_text(str(v))
    if isinstance(kind, T.DecimalType):
        return _write_decimal
    if isinstance(kind, T.StringType):
        return _as_text
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return lambda v: _as_number(repr(v)) if v - v == 0 else _as_text(repr(v))
    if isinstance(kind, T.BooleanType):
        return lambda v: f't="b"><v>{int(v)}</v></c>'
    if isinstance(kind, T.DateType):
        return _write_date
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return _write_moment
    raise TypeError(f"spreadsheets hold no {kind.simpleString()}")


def write_column(kind: T.DataType, write: Callable, column: pa.Array) -> list[str | None]:
    """A column's cells by ``write``."""
    return cell_texts(kind, write, column).to_pylist()


def cell_texts(kind: T.DataType, write: Callable, column: pa.Array) -> pa.Array:
    """The same as an array: numbers that are all short enough are told at once, of repeated values each is told once."""
    short = isinstance(kind, T.DecimalType) and kind.precision <= DIGITS and kind.scale <= 6
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and column.null_count < len(column):
        ends = pc.min_max(column).as_py()
        short = -(10**DIGITS) < ends["min"] and ends["max"] < 10**DIGITS
    if short:
        return pc.binary_join_element_wise(_shared("><v>"), column.cast(pa.string()).cast(pa.large_string()), _shared("</v></c>"), _shared(""))
    if isinstance(kind, (T.DateType, T.TimestampNTZType, T.TimestampType)):
        told = column.dictionary_encode()
        return pa.array([write(v) for v in told.dictionary.to_pylist()], pa.large_string()).take(told.indices)
    return pa.array([None if v is None else write(v) for v in column.to_pylist()], pa.large_string())


@lru_cache(None)
def _shared(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def sheet_rows(letters: list[str], columns: list[pa.Array], first: int, rows: int) -> pa.Buffer | bytes:
    """The XML of rows numbered from ``first``; a null has no cell."""
    if not rows:
        return b""
    at = pa.array(range(first, first + rows), pa.int64()).cast(pa.string()).cast(pa.large_string())
    parts = [_shared('<row r="'), at, _shared('">')]
    for letter, column in zip(letters, columns, strict=True):
        cells = pc.binary_join_element_wise(_shared(f'<c r="{letter}'), at, _shared('" '), column, _shared(""))
        parts.append(pc.fill_null(cells, _shared("")) if cells.null_count else cells)
    whole = pc.binary_join_element_wise(*parts, _shared("</row>"), _shared(""))
    offsets = np.frombuffer(whole.buffers()[1], np.int64, rows + 1, whole.offset * 8)
    return whole.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
