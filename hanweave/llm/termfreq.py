"""How often every distinct term occurs, and in how many records.

Range-partitioned external sort of (term, record) pairs: the ranges are over the pair, so a
term with a third of all rows spreads over many tasks and yet no pair is in two of them. Each
task scans its sorted pairs once, run by run. A term that lies wholly inside one task is
finished there; only the first and last term of each task meet again.

Null terms are left out; a null record counts as an occurrence but not as a record. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanweave.operators.combine import combine
from hanweave.session import map_arrow, task_count, written


def _changes(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Where a value differs from the one above; nulls count as equal."""
    out = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False)
        out[1:] = pc.or_(differs, pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    if before is not None and len(column):
        out[0] = column[0] != before
    return out


def _scan(term: str, weighted: bool):
    """Run-length scan of sorted (term, record, n[, w]); yields (term, occurrences, records, weight, edge)."""
    names = [term, "occurrences", "records", "weight", "edge"]

    def one(run_: tuple, edge: bool) -> pa.RecordBatch:
        arrays = [pa.array([run_[0].as_py()], run_[0].type), *(pa.array([x]) for x in run_[1:]), pa.array([edge])]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, last_record, first_out = None, None, True  # open_: the run that the next batch may continue
        for batch in batches:
            if not len(batch):
                continue
            terms, records = batch.column(0), batch.column(1)
            n = batch.column(2).to_numpy()
            w = batch.column(3).to_numpy() if weighted else np.zeros(len(batch))
            new_term = _changes(terms, open_[0] if open_ else None)
            new_record = (_changes(records, last_record) | new_term) & records.is_valid().to_numpy(zero_copy_only=False)
            starts = np.nonzero(new_term | (np.arange(len(batch)) == 0))[0]
            sums = [np.add.reduceat(x, starts) for x in (n, new_record.astype(np.int64), w)]
            if open_ and not new_term[0]:
                for s, held in zip(sums, open_[1:]):
                    s[0] += held
            elif open_:
                yield one(open_, first_out)
                first_out = False
            done = len(starts) - 1
            if done:
                edge = np.zeros(done, dtype=bool)
                edge[0], first_out = first_out, False
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(starts[:-1])), *(pa.array(s[:-1]) for s in sums), pa.array(edge)], names=names)
            open_ = (terms[int(starts[-1])], *(s[-1] for s in sums))
            last_record = records[len(records) - 1]
        if open_:
            yield one(open_, True)

    return run


def counted_pairs(df: DataFrame, term: str, record: str, weight: str | None = None) -> DataFrame:
    """`__term`, `__record`, `n` (rows) and, with `weight`, `w` (its sum): rows added up by the tasks that read them, and written once.

    The ranges of the sort are found in what is written, and so are counts of records.
    """
    columns = {"__term": term, "__record": record} | ({"__weight": weight} if weight else {})
    return written(combine(df.select(*[F.col(c).alias(a) for a, c in columns.items()]), ["__term", "__record"], "__weight" if weight else None))


def frequencies(pairs: DataFrame, term: str, n_tasks: int | None = None) -> DataFrame:
    """`term`, `occurrences`, `records`, `weight` of each term of `counted_pairs` that is not null."""
    weighted = "w" in pairs.columns
    ordered = pairs.where("__term IS NOT NULL").repartitionByRange(n_tasks or task_count(pairs), "__term", "__record").sortWithinPartitions("__term", "__record")
    schema = T.StructType(
        [T.StructField(term, pairs.schema["__term"].dataType), T.StructField("occurrences", T.LongType()), T.StructField("records", T.LongType()), T.StructField("weight", T.DoubleType()), T.StructField("edge", T.BooleanType())]
    )
    runs = written(map_arrow(ordered, _scan(term, weighted), schema))
    sums = [F.sum(c).alias(c) for c in ("occurrences", "records", "weight")]
    return runs.where("NOT edge").drop("edge").unionByName(runs.where("edge").groupBy(term).agg(*sums))


def term_frequencies(df: DataFrame, term: str, record: str, weight: str | None = None, n_tasks: int | None = None) -> DataFrame:
    """`term`, `occurrences` (rows), `records` (distinct), `weight` (its sum, else 0.0), one row a term."""
    return frequencies(counted_pairs(df.where(F.col(term).isNotNull()), term, record, weight), term, n_tasks)


def mark(frequencies: DataFrame, rare, common) -> DataFrame:
    """One row per term and mark (`rare`, `common`) whose condition holds; a term may have both."""
    marks = F.array_compact(F.array(F.when(rare, F.lit("rare")), F.when(common, F.lit("common"))))
    return frequencies.withColumn("mark", F.explode(marks))
