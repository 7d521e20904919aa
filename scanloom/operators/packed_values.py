"""Several values packed in one field, split into one value per row.

The splitter works on the raw bytes of a whole Arrow string column at a time:
quote parity is a running sum over the buffer, delimiters are boolean masks,
and the positions where both agree become the offsets of the values. There is
no loop over rows, so cost follows the bytes of the column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# UTF-8 bytes of delimiters, bullets and quotes that the splitter knows.
SINGLE_DELIMITERS = b";|\n\t\r"
ARABIC_DELIMITERS = ("،", "؛")
INLINE_BULLET = "•"
LINE_BULLETS = b"*-"
OPENING_QUOTES = ("“", "«")
CLOSING_QUOTES = ("”", "»")

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ASCII_DIGIT = np.zeros(256, bool)
_ASCII_DIGIT[48:58] = True


def _mask(data: np.ndarray, text: str) -> np.ndarray:
    """True at the first byte of each occurrence of ``text``."""
    raw = text.encode()
    n = len(data)
    hit = np.zeros(n, bool)
    if n >= len(raw):
        m = data[: n - len(raw) + 1] == raw[0]
        for k, byte in enumerate(raw[1:], 1):
            m &= data[k : n - len(raw) + 1 + k] == byte
        hit[: n - len(raw) + 1] = m
    return hit


def _prev(mask: np.ndarray, k: int = 1) -> np.ndarray:
    out = np.zeros(len(mask), bool)
    out[k:] = mask[:-k]
    return out


def _next(mask: np.ndarray, k: int = 1) -> np.ndarray:
    out = np.zeros(len(mask), bool)
    out[:-k] = mask[k:]
    return out


def _row_running(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Running sum of ``values`` before each byte, counted anew in each row."""
    before = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return before[:-1] - np.repeat(before[starts], lengths)


def split_packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(parent row, position from 1, value) of every non-blank value of a string array.

    Delimiters are ``; | ، ؛ •`` and line feeds or tabs; a comma not between two
    digits; a slash with white space on both sides; numbering such as ``2)`` or
    ``2.`` after white space and before a space, in a field that starts with
    numbering. None of them counts inside quotes (straight, curly or angle).
    Where a row's quotes don't pair up, its quotes are ordinary characters.
    A value loses bullets, numbering, outer spaces and enclosing quotes, and a
    doubled straight quote inside enclosing ones becomes one.
    """
    column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    empty = np.zeros(0, np.int64)
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else empty
    if not n or data_buffer is None or offsets[-1] == offsets[0]:
        return empty, empty, pa.array([], pa.string())
    data = np.frombuffer(data_buffer, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    starts, lengths = offsets[:-1], np.diff(offsets)
    size = len(data)
    row_first = np.zeros(size + 1, bool)
    row_first[starts] = True
    row_first = row_first[:size]
    row_last = np.zeros(size, bool)
    row_last[offsets[1:][lengths > 0] - 1] = True

    straight = data == 34
    opening = np.zeros(size, bool)
    closing = np.zeros(size, bool)
    for q in OPENING_QUOTES:
        opening |= _mask(data, q)
    for q in CLOSING_QUOTES:
        closing |= _mask(data, q)
    row_of = np.repeat(np.arange(n), lengths)
    odd = np.bincount(row_of, straight, n).astype(np.int64) % 2 == 1
    uneven = np.bincount(row_of, opening, n) != np.bincount(row_of, closing, n)
    parity = _row_running(straight, starts, lengths) % 2 == 1
    depth = _row_running(opening.astype(np.int8) - closing.astype(np.int8), starts, lengths) > 0
    quoted = (parity & ~odd[row_of]) | (depth & ~uneven[row_of])

    arabic_digit = _mask(data, "٠")
    for code in range(0x661, 0x66A):
        arabic_digit |= _mask(data, chr(code))
    digit = _ASCII_DIGIT[data]
    digit_ends = digit | _prev(arabic_digit)
    digit_starts = digit | arabic_digit
    space = _SPACE[data]

    one = np.isin(data, np.frombuffer(SINGLE_DELIMITERS, np.uint8))
    comma = data == 44
    one |= comma & ~(_prev(digit_ends) & ~row_first & _next(digit_starts) & ~row_last)
    one |= (data == 47) & _prev(space) & ~row_first & _next(space) & ~row_last
    wide = np.zeros(size, np.int8)
    for text in (*ARABIC_DELIMITERS, INLINE_BULLET):
        wide[_mask(data, text)] = len(text.encode())
    wide[one] = 1

    # Numbering: one or two digits, then ) or . and a space, after white space or at the start of the row.
    mark = ((data == 41) | (data == 46)) & (_next(space) & ~row_last)
    left = row_first | _prev(space)
    number_1 = left & digit & _next(mark)
    number_2 = left & digit & _next(digit) & _next(mark, 2)
    begins = number_1 | number_2
    lead = row_first | (_row_running(~space, starts, lengths) == 0)
    numbered = np.bincount(row_of, begins & lead & ~space, n) > 0
    begins &= numbered[row_of]
    wide[number_1 & begins] = 2
    wide[number_2 & begins] = 3

    # Bullets * and - stand at the start of a line, after any number of spaces and before one.
    at = np.arange(len(data))
    begun = np.maximum.accumulate(np.where(row_first | _prev(data == 10), at, -1))
    solid = np.maximum.accumulate(np.where(data != 32, at, -1))
    line_start = np.concatenate(([-1], solid[:-1])) < begun
    bullet = np.isin(data, np.frombuffer(LINE_BULLETS, np.uint8)) & line_start & _next(data == 32) & ~row_last
    wide[bullet] = 1
    wide[quoted] = 0

    cut = np.flatnonzero(wide)
    # Value spans: from each row start or end of a delimiter to the next delimiter or row end.
    begin = np.concatenate([starts[lengths > 0], cut + wide[cut]])
    end = np.concatenate([cut, offsets[1:][lengths > 0]])
    begin.sort()
    end.sort()
    begin, end = _strip(data, begin, end)
    keep = end > begin
    begin, end = begin[keep], end[keep]

    # Enclosing quotes.
    width = end - begin
    wrapped = (width >= 2) & (data[begin] == 34) & (data[end - 1] == 34)
    inner = np.concatenate([[0], np.cumsum(straight)])
    begin2, end2 = begin + wrapped, end - wrapped
    for a, b in zip(OPENING_QUOTES, CLOSING_QUOTES):
        la, lb = len(a.encode()), len(b.encode())
        hit = (width >= la + lb) & _mask(data, a)[begin] & _mask(data, b)[np.maximum(end - lb, 0)]
        begin2, end2 = begin2 + hit * la, end2 - hit * lb
    begin, end = _strip(data, begin2, end2)
    keep = end > begin
    begin, end, wrapped = begin[keep], end[keep], wrapped[keep]

    parent = row_of[begin]
    first = np.concatenate([[True], parent[1:] != parent[:-1]]) if len(parent) else np.zeros(0, bool)
    index = np.arange(len(parent))
    position = index - np.maximum.accumulate(np.where(first, index, 0)) + 1 if len(parent) else empty

    doubled = wrapped & (inner[end] - inner[begin] > 0)
    values = _gather(data, begin, end)
    if doubled.any():
        import pyarrow.compute as pc

        values = pc.if_else(pa.array(doubled), pc.replace_substring(values, '""', '"'), values)
    return parent, position, values


def _strip(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without white space at either end."""
    solid = np.flatnonzero(~_SPACE[data])
    if not len(solid):
        return begin, begin.copy()
    at = np.searchsorted(solid, begin)
    first = np.where(at < len(solid), solid[np.minimum(at, len(solid) - 1)], len(data))
    back = np.searchsorted(solid, end) - 1
    last = np.where(back >= 0, solid[np.maximum(back, 0)] + 1, 0)
    return np.minimum(first, end), np.maximum(np.minimum(last, end), np.minimum(first, end))


def _gather(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """A string array of the spans, built from new offsets over copied bytes."""
    width = end - begin
    offsets = np.concatenate([[0], np.cumsum(width)])
    source = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], width)
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[source])))


def split_values(df: DataFrame, key: str, field: str, label: str | None = None, only_packed: bool = False) -> DataFrame:
    """One row per value of ``field``: (``key``, ``fld``, ``pos`` from 1, ``item``).

    ``key`` keeps its type. ``label`` is written to ``fld``, by default the
    field's name. Null, empty and blank fields give no rows; with
    ``only_packed`` so do fields that hold a single value. Rows are taken as
    they come: exact repeats of (key, field) should be removed before. Other
    columns of ``df``, whatever their names, are not read. No shuffle.
    """
    label = label or field
    source = df.select(F.col(key).alias("k"), F.col(field).cast("string").alias("v")).where("v is not null and v != ''")
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, position, values = split_packed(batch.column(1))
            if only_packed and len(parent):
                keep = np.bincount(parent, minlength=batch.num_rows)[parent] > 1
                parent, position, values = parent[keep], position[keep], values.filter(pa.array(keep))
            if len(parent):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(parent)), pa.array(position, pa.int32()), values], names=[key, "pos", "item"]
                )

    out = source.mapInArrow(run, f"`{key}` {key_type}, pos int, item string")
    return out.select(F.col(key), F.lit(label).alias("fld"), "pos", "item")
