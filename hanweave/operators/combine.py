"""Aggregation before a shuffle, within the task that reads the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanweave.session import map_arrow

#: Rows held by a task before their sums are passed on.
HELD_ROWS = 1 << 18


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of some `size` bytes of text together, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right"))
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def combine(df: DataFrame, keys: list[str], weight: str | None = None, held_rows: int = HELD_ROWS) -> DataFrame:
    """`keys`, `n` (rows) and, with `weight`, `w` (its sum as a double): one row per key and block of input, no shuffle.

    A key with a third of all rows leaves each block as one row, so no later shuffle is skewed
    by repeated rows. Null keys form groups of their own; a null weight counts as 0.
    """
    columns = [F.col(k) for k in keys] + ([F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w")] if weight else [])
    fields = [df.schema[k] for k in keys] + [T.StructField("n", T.LongType())] + ([T.StructField("w", T.DoubleType())] if weight else [])
    names = [f.name for f in fields]

    def merged(tables: list[pa.Table]) -> pa.Table:
        sums = [("n", "sum")] + ([("w", "sum")] if weight else [])
        out = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate(sums)
        return out.rename_columns([c.removesuffix("_sum") if c not in keys else c for c in out.column_names]).select(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held.append(t.append_column("n", pa.array([1] * len(t), pa.int64())).select(names))
            rows += len(t)
            if rows >= held_rows:
                held = [merged(held)]
                rows = len(held[0])
                if rows > held_rows // 2:
                    yield from held[0].to_batches(max_chunksize=1 << 16)
                    held, rows = [], 0
        if held:
            yield from merged(held).to_batches(max_chunksize=1 << 16)

    return map_arrow(df.select(*columns), run, T.StructType(fields))
