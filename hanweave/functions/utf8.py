"""UTF-8 of whole batches as arrays, broken encodings included.

A column of texts may hold any bytes, as when files in another encoding are read. Here every
byte that is no part of a well-formed character is given a place: a lead byte with those
followers that fit it is one broken character, a follower that fits nothing is another, as in
the incremental decoders of the Unicode standard. No broken byte shifts the rows after it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

REPLACEMENT = 0xFFFD
# Lead bytes (first, last), their followers, and the range of the first follower.
_LEADS = (
    (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F),
)
_NEED, _LOW, _HIGH = (np.zeros(256, dtype=np.uint8) for _ in range(3))
for _first, _last, _n, _lo, _hi in _LEADS:
    _NEED[_first : _last + 1], _LOW[_first : _last + 1], _HIGH[_first : _last + 1] = _n, _lo, _hi


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; nulls are empty."""
    if column.null_count:
        column = pc.if_else(column.is_valid(), column, pa.scalar("", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where characters begin, and which of these are broken, both as masks over the bytes of rows."""
    size = len(data)
    need = _NEED[data]
    follower = (data & 0xC0) == 0x80
    starts = np.ones(size, dtype=bool)
    (lead,) = np.nonzero(need)
    broken = (data >= 0x80) & (need == 0)
    if len(lead):
        row_begin = np.zeros(size + 4, dtype=bool)
        row_begin[offsets] = True
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        follows = np.concatenate([follower, np.zeros(3, bool)])
        fits = (padded[lead + 1] >= _LOW[data[lead]]) & (padded[lead + 1] <= _HIGH[data[lead]]) & ~row_begin[lead + 1]
        count = fits.astype(np.uint8)
        for k in (2, 3):
            fits = fits & (need[lead] >= k) & follows[lead + k] & ~row_begin[lead + k]
            count += fits
        for k in (1, 2, 3):
            taken = lead[count >= k] + k
            starts[taken] = False
            broken[taken] = False
        broken[lead] = count < need[lead]
    return starts, broken


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, U+FFFD for each broken character, and the number of each text."""
    data, offsets = raw_bytes(column)
    starts, broken = characters(data, offsets)
    at = np.concatenate([[0], np.cumsum(starts)])
    lengths = np.diff(at[offsets])
    if not broken.any():
        return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4"), lengths
    (first,) = np.nonzero(starts)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    need = _NEED[data[first]]
    points = np.where(need == 0, padded[first], padded[first] & (0x3F >> need))
    for k in (1, 2, 3):
        points = np.where(need >= k, points << 6 | (padded[first + k] & 0x3F), points)
    return np.where(broken[first], REPLACEMENT, points).astype(np.uint32), lengths


def texts(column: pa.Array, errors: str = "replace") -> list[str | None]:
    """The texts of a column; broken characters become U+FFFD, or nothing with `errors="ignore"`."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if t is None else t.decode("utf-8", errors) for t in column.view(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def sound(text: Column) -> Column:
    """`text`; of one with broken encodings what is left without them (and without U+FFFD)."""
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))
