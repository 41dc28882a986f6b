"""The most frequent values of a column in bounded memory.

Values are hashed to tasks, so each task sees all of a value. A task keeps a count-min sketch
with conservative update and a bounded set of the values with the largest estimates; as no
value is in two tasks, the sets are disjoint and merging them is taking the largest. Estimates
never fall below the true counts, so the smallest kept estimate bounds every value left out:
the exact count of the few candidates proves the result. Where it does not, the sketch and the
sets are made larger and the pass repeated, and if very many values are about equally frequent,
all are counted exactly.

Null values are left out. Ties go to the smaller value. Fewer than k distinct values give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanweave.operators.combine import combine
from hanweave.session import map_arrow, task_count

DEPTH = 4
WIDTH = 1 << 17
CANDIDATES = 1024
#: Passes of growing sketches before all values are counted exactly.
ATTEMPTS = 3


def sketch_candidates(df: DataFrame, value: str, width: int = WIDTH, depth: int = DEPTH, candidates: int = CANDIDATES, n_tasks: int | None = None) -> DataFrame:
    """`value`, `estimate`, `left_out` (no value left out of its task's set has a higher count): up to `candidates` rows a task.

    A task holds depth * width counters and at most a few times `candidates` values.
    """
    column, value = value, "__value"  # a name that clashes with none of the others here
    values = df.select(F.col(column).alias(value)).where(F.col(value).isNotNull())
    hashed = combine(values, [value]).repartition(n_tasks or task_count(df), value).select(value, "n", F.xxhash64(F.lit(1), value).alias("a"), F.xxhash64(F.lit(2), value).alias("b"))
    schema = T.StructType([values.schema[value], T.StructField("estimate", T.LongType()), T.StructField("left_out", T.LongType())])
    rows = np.arange(depth, dtype=np.uint64)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((depth, width), dtype=np.int64)
        held, left_out = None, 0
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by([value, "a", "b"], use_threads=False).aggregate([("n", "sum")])
            if not len(t):
                continue
            a, b = (t[c].to_numpy().view(np.uint64) for c in ("a", "b"))
            cells = ((a + rows * (b | np.uint64(1))) % np.uint64(width)).astype(np.int64)
            new = np.min(np.take_along_axis(sketch, cells, axis=1), axis=0) + t["n_sum"].to_numpy()
            for k in range(depth):  # conservative: a cell only rises to the estimate
                np.maximum.at(sketch[k], cells[k], new)
            high = new > left_out
            if not high.any():
                continue
            risen = pa.table({value: t[value].filter(pa.array(high)), "estimate": pa.array(new[high])})
            if held is not None:
                risen = pa.concat_tables([held, risen]).group_by(value, use_threads=False).aggregate([("estimate", "max")])
                risen = pa.table({value: risen[value], "estimate": risen["estimate_max"]})
            held = risen
            if len(held) > candidates:
                estimates = held["estimate"].to_numpy()
                order = np.argpartition(-estimates, candidates - 1)
                left_out = max(left_out, int(estimates[order[candidates:]].max()))
                held = held.take(pa.array(order[:candidates]))
        if held is not None:
            yield from held.append_column("left_out", pa.array([left_out] * len(held), pa.int64())).to_batches()

    return map_arrow(hashed, run, schema).withColumnRenamed(value, column)


def most_frequent(df: DataFrame, value: str, k: int, width: int = WIDTH, candidates: int = CANDIDATES, n_tasks: int | None = None) -> DataFrame:
    """`value`, `estimate` (count-min), `n_rows` (exact) of the k most frequent values, most frequent first.

    The sets of all tasks merge into one of max(`candidates`, 8k) rows, up to 16 times that in a
    repeated pass, which is what reaches the driver and is broadcast for the exact check.
    """
    keep = max(candidates, 8 * k)
    spark, field = df.sparkSession, df.schema[value]
    out = T.StructType([field, T.StructField("estimate", T.LongType()), T.StructField("n_rows", T.LongType())])
    first = [F.col("n_rows").desc(), F.col(value)]
    for _ in range(ATTEMPTS):
        merged = sketch_candidates(df, value, width, candidates=keep, n_tasks=n_tasks).orderBy(F.col("estimate").desc(), F.col(value)).limit(keep + 1).collect()
        bound = max([r["left_out"] for r in merged], default=0)
        if len(merged) > keep:
            bound = max(bound, merged.pop()["estimate"])
        chosen = spark.createDataFrame([(r[value], r["estimate"]) for r in merged], T.StructType(out.fields[:2]))
        exact = df.select(value).join(F.broadcast(chosen), value).groupBy(value).agg(F.first("estimate").alias("estimate"), F.count("*").alias("n_rows"))
        rows = exact.orderBy(*first).limit(k).collect()
        # A value in no merged set has at most `bound` rows.
        if bound == 0 or len(rows) == k and rows[-1]["n_rows"] > bound:
            return spark.createDataFrame([tuple(r) for r in rows], out)
        width, keep = width * 4, keep * 4
    # Where so many values are about equally frequent that no small set holds the k first, all are counted.
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n_rows"))
    return counts.orderBy(*first).limit(k).select(value, F.col("n_rows").alias("estimate"), "n_rows")
