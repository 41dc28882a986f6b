"""Lines of count files: valid rows as typed columns, every other row with its reason.

Structural indexing over the bytes of a whole Arrow batch: masks of quotes and white space,
runs of quotes, and the parity of quotes before each run tell where a quoted field opens and
closes; what lies outside is cut at white space. Field counts, lengths, forbidden bytes and
counts are then checked on arrays of offsets, for all rows at once.

Reasons, the first that holds: `quoting` (a quoted field is not closed, or not followed by
white space or the end), `columns` (not the wanted number of fields; null and blank lines),
`value` (a word is empty, too long, or holds a control character, U+FFFD or bytes that are no
UTF-8; or the count is none). Valid rows have the reason null. Rejected lines keep their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanweave.functions.utf8 import characters, raw_bytes
from hanweave.operators.combine import slices
from hanweave.session import map_arrow

QUOTE = ord('"')
MAX_WORD_BYTES = 99
#: Bytes indexed at once; the masks and offsets take some dozen times as much.
INDEXED_BYTES = 1 << 21
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0D, 0x0A]] = True


@dataclass(frozen=True)
class LineFormat:
    """`words` word columns and one count; `whole`: the count is 1 to 2147483647, else a positive finite number."""

    words: tuple[str, ...]
    whole: bool

    @property
    def fields(self) -> int:
        return len(self.words) + 1


UNIGRAM = LineFormat(("word",), whole=False)
BIGRAM = LineFormat(("left", "right"), whole=True)


def index_fields(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows with broken quoting (a mask), and of each field its row, first byte and the byte after its last."""
    n_rows, size = len(offsets) - 1, len(data)
    broken = np.zeros(n_rows, dtype=bool)
    row = np.repeat(np.arange(n_rows), np.diff(offsets))
    space, quote = _SPACE[data], data == QUOTE
    begins = np.zeros(size + 1, dtype=bool)  # where a row begins; also the end of all
    begins[offsets] = True
    after_gap = begins[:-1].copy()  # the byte before is white space or of another row
    after_gap[1:] |= space[:-1]
    before_gap = begins[1:].copy()
    before_gap[:-1] |= space[1:]

    # Runs of quotes within a row.
    starts = np.nonzero(quote & (begins[:-1] | ~np.concatenate([[False], quote[:-1]])))[0] if size else np.zeros(0, np.int64)
    ends = np.nonzero(quote & (begins[1:] | ~np.concatenate([quote[1:], [False]])))[0] if size else starts
    quoted = np.zeros(size, dtype=bool)
    if len(starts):
        odd = (ends - starts) % 2 == 0
        opens = after_gap[starts]  # as a field may start here
        run_row = row[starts]
        # Outside, an odd run opens where a field may start and else is plain text; inside, an odd run closes.
        # So odd runs after a gap flip the state and other odd runs leave it outside: the state before a run
        # is the parity of flips since the row's start or the last such run.
        flips = np.cumsum(odd & opens)
        row_first = np.concatenate([[True], run_row[1:] != run_row[:-1]])
        flips_before = flips - (odd & opens)
        zero = np.maximum.accumulate(np.where(row_first, flips_before, 0))  # flips only grow, so the last mark is the largest
        reset = np.concatenate([[0], np.where(odd & ~opens, flips, 0)[:-1]])
        zero = np.maximum(zero, np.maximum.accumulate(reset))
        inside = (flips_before - zero) % 2 == 1
        closes = (inside & odd) | (~inside & ~odd & opens)
        broken[run_row[closes & ~before_gap[ends]]] = True
        still = np.where(odd, ~inside & opens, inside)  # inside after the run
        row_last = np.concatenate([row_first[1:], [True]])
        broken[run_row[still & row_last]] = True
        # Bytes from an opening quote to its closing one are content.
        edge = np.zeros(size + 1, dtype=np.int8)
        opening, closing = starts[~inside & odd & opens], ends[inside & odd] + 1
        np.add.at(edge, opening, 1)
        np.add.at(edge, closing, -1)
        unclosed = still & row_last
        np.add.at(edge, offsets[1:][run_row[unclosed]], -1)
        quoted = np.cumsum(edge[:-1]) > 0

    content = ~space | quoted
    field_start = content.copy()
    field_start[1:] &= ~content[:-1] | begins[1:-1]
    field_end = content.copy()
    if size:
        field_end[:-1] &= ~content[1:] | begins[1:-1]
    first, last = np.nonzero(field_start)[0], np.nonzero(field_end)[0] + 1
    return broken, row[first], first, last


def _forbidden(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Running number of control characters, U+FFFD and broken encodings before each byte; one more entry than bytes."""
    bad = (data < 0x20) | (data == 0x7F)
    if len(data) > 1:
        bad[:-1] |= (data[:-1] == 0xC2) & (data[1:] >= 0x80) & (data[1:] < 0xA0)
    if len(data) > 2:
        bad[:-2] |= (data[:-2] == 0xEF) & (data[1:-1] == 0xBF) & (data[2:] == 0xBD)
    bad |= characters(data, offsets)[1]  # which show as U+FFFD
    return np.concatenate([[0], np.cumsum(bad)])


def _take(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The byte ranges as one text column."""
    n = last - first
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1] - first, n)
    return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[at].tobytes())]).cast(pa.string())


def _whole(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    digits = pc.ascii_ltrim(text, "0")
    ok = pc.and_(pc.match_substring_regex(text, "^[0-9]+$"), pc.match_substring_regex(digits, "^[0-9]{1,10}$"))
    value = pc.cast(pc.if_else(ok, digits, "0"), pa.int64()).to_numpy(zero_copy_only=False)
    ok = ok.to_numpy(zero_copy_only=False) & (value >= 1) & (value <= 2147483647)
    return pa.array(np.where(ok, value, 0).astype(np.int32), mask=~ok), ok


def _number(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    ok = pc.match_substring_regex(text, r"^[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")
    value = pc.cast(pc.if_else(ok, text, "0"), pa.float64()).to_numpy(zero_copy_only=False)
    ok = ok.to_numpy(zero_copy_only=False) & np.isfinite(value) & (value > 0)
    return pa.array(np.where(ok, value, 0.0), mask=~ok), ok


def parse_lines(column: pa.Array, form: LineFormat) -> tuple[pa.Array, list[pa.Array]]:
    """Reasons (null where valid), then the word columns and the count (null where invalid)."""
    data, offsets = raw_bytes(column)
    n_rows = len(offsets) - 1
    broken, row, first, last = index_fields(data, offsets)
    n_fields = np.bincount(row, minlength=n_rows)
    right = ~broken & (n_fields == form.fields)
    (rows,) = np.nonzero(right)
    at = np.searchsorted(row, rows)
    quotes, bad = np.concatenate([[0], np.cumsum(data == QUOTE)]), _forbidden(data, offsets)
    wrong, columns = np.zeros(len(rows), dtype=bool), []
    for k in range(form.fields):
        a, b = first[at + k], last[at + k]
        held = (data[a] == QUOTE) if len(a) else np.zeros(0, bool)  # a quoted field of a sound row ends in its closing quote
        a, b = a + held, b - held
        text = _take(data, a, b)
        inner = np.where(held, (quotes[b] - quotes[a]) // 2, 0)
        if inner.any():
            text = pc.if_else(pa.array(inner > 0), pc.replace_substring(text, '""', '"'), text)
        if k < len(form.words):
            size = b - a - inner
            wrong |= (size == 0) | (size > MAX_WORD_BYTES) | (bad[b] > bad[a])
            columns.append(text)
        else:
            count, ok = _whole(text) if form.whole else _number(text)
            wrong |= ~ok
            columns.append(count)
    reason = np.full(n_rows, "columns", dtype=object)
    reason[broken] = "quoting"
    reason[rows] = np.where(wrong, "value", None)
    (good,) = np.nonzero(~wrong)
    back = np.full(n_rows, -1)
    back[rows[good]] = good
    index = pa.array(back, mask=back < 0)
    return pa.array(reason, pa.string()), [c.take(index) for c in columns]


def parse_counts(df: DataFrame, form: LineFormat, raw_col: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep`, the words and `count` of `form`, `raw` and `reason`; every row of `df` once, no shuffle.

    Rows with a reason have null words and count and keep their line in `raw`; valid rows have a
    null `raw`. Columns of `df` outside `keep` are not read, so their names cannot clash.
    """
    count = T.IntegerType() if form.whole else T.DoubleType()
    schema = T.StructType(
        [df.schema[c] for c in keep]
        + [T.StructField(w, T.StringType()) for w in form.words]
        + [T.StructField("count", count), T.StructField("raw", T.StringType()), T.StructField("reason", T.StringType())]
    )
    if len(set(schema.names)) < len(schema.names):
        raise ValueError(f"clashing names: {schema.names}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(len(keep)), INDEXED_BYTES):
                part = batch.slice(a, b - a)
                raw = part.column(len(keep))
                reason, columns = parse_lines(raw, form)
                raw = pc.if_else(reason.is_valid(), raw, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns, raw, reason], names=schema.names)

    return map_arrow(df.select(*keep, F.col(raw_col).alias("__raw")), run, schema)


def valid_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NULL").drop("raw", "reason")


def rejected_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NOT NULL")


def read_counts(spark: SparkSession, path: str, form: LineFormat) -> DataFrame:
    """`parse_counts` of the lines of text files, with `file_name` of each line."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("file_name"), F.col("value").alias("raw"))
    return parse_counts(lines, form, keep=("file_name",))
