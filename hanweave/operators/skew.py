"""Per-key results and joins where a few keys hold most rows.

Fragment and replicate by estimated load: one pass estimates the load of the heavy keys in
bounded memory; keys (and hashed buckets of all light keys) are packed into tasks of even
load, heavy keys being cut into shards in proportion to their load; rows go straight to
their task, and rows of a matching side are copied only to the shards of their key.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanweave.operators.combine import combine
from hanweave.session import map_arrow, task_count, written

#: Counters of a task's summary. A key counts as heavy from 1 / (2 * COUNTERS) of all rows on, so at most twice as many do.
COUNTERS = 1024
#: Shards of a key that had all rows, and hashed buckets of the light keys, for each task.
SHARDS_PER_TASK = 4
BUCKETS_PER_TASK = 8


@dataclass
class Plan:
    """Tasks of each heavy key's shards, task of each bucket of light keys, the rows each task expects, and the rows that have a key."""

    heavy: dict
    buckets: list[int]
    loads: list[float]
    total: int = 0


def estimate_heavy(df: DataFrame, key: str, counters: int = COUNTERS, weight: str | None = None) -> tuple[dict, int]:
    """Rows of the heavy keys, too low by at most rows / `counters`, and the number of all rows; null keys are left out.

    Every task keeps `counters` counters and lowers all alike when they overflow; the
    summaries add up. At most 2 * `counters` keys reach the driver, whatever the data.
    `weight`: a column that says how many rows a row stands for.
    """
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("total", T.LongType())])

    def summed(t: pa.Table) -> pa.Table:
        return t.group_by("key", use_threads=False).aggregate([("n", "sum")]).select(["key", "n_sum"]).rename_columns(["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, 0
        for batch in batches:
            n = batch.column(1) if weight else pa.array(np.ones(len(batch), dtype=np.int64))
            t = pa.table({"key": batch.column(0), "n": n}).filter(batch.column(0).is_valid())
            total += pc.sum(t["n"]).as_py() or 0
            t = summed(t)
            if held is not None:
                t = summed(pa.concat_tables([held, t]))
            if len(t) > counters:
                n = t["n"].to_numpy()
                t = t.set_column(1, "n", pa.array(n - np.partition(n, -counters - 1)[-counters - 1]))
                t = t.filter(pc.greater(t["n"], 0))
            held = t
        if total:
            held = held.append_column("total", pa.array([0] * len(held), pa.int64()))
            mark = pa.table({"key": pa.nulls(1, held["key"].type), "n": pa.array([0], pa.int64()), "total": pa.array([total], pa.int64())})
            yield from pa.concat_tables([held, mark]).to_batches()

    sums = map_arrow(df.select(key, *([weight] if weight else [])), run, schema).groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    # The null key carries the number of rows.
    top = sums.orderBy(F.col("total").desc(), F.col("n").desc()).limit(2 * counters + 1).collect()
    total = sum(r["total"] for r in top)
    return {r["key"]: r["n"] for r in top if r["key"] is not None and r["n"] * 2 * counters >= total}, total


def pack(heavy: dict, total: int, n_tasks: int) -> Plan:
    """Cuts heavy keys into shards and packs shards and buckets, largest first, each into the task with the least load."""
    unit = max(1.0, total / (n_tasks * SHARDS_PER_TASK))
    light = max(0, total - sum(heavy.values()))
    items = [(light / (n_tasks * BUCKETS_PER_TASK), 0, None, b) for b in range(n_tasks * BUCKETS_PER_TASK)]
    for rank, (key, load) in enumerate(sorted(heavy.items(), key=lambda x: -x[1])):
        shards = max(1, math.ceil(load / unit))
        items += [(load / shards, rank + 1, key, s) for s in range(shards)]
    items.sort(key=lambda x: (-x[0], x[1], x[3]))
    open_ = [(0.0, t) for t in range(n_tasks)]
    plan = Plan({}, [0] * (n_tasks * BUCKETS_PER_TASK), [0.0] * n_tasks, total)
    for load, rank, key, s in items:
        held, t = heapq.heappop(open_)
        heapq.heappush(open_, (held + load, t))
        plan.loads[t] += load
        if rank:
            plan.heavy.setdefault(key, []).append(t)
        else:
            plan.buckets[s] = t
    return plan


def plan_for(df: DataFrame, key: str, n_tasks: int | None = None, counters: int = COUNTERS, weight: str | None = None) -> Plan:
    return pack(*estimate_heavy(df, key, counters, weight), n_tasks or task_count(df))


def _routes(df: DataFrame, key: str, plan: Plan) -> DataFrame:
    """`df` with `__tasks`, the tasks of the key's shards; null for light keys. The joined table has at most 2 * COUNTERS rows."""
    schema = T.StructType([T.StructField("__routed", df.schema[key].dataType), T.StructField("__tasks", T.ArrayType(T.IntegerType()))])
    table = df.sparkSession.createDataFrame(list(plan.heavy.items()), schema)
    return df.join(F.broadcast(table), F.col(key) == F.col("__routed"), "left").drop("__routed")


def _bucket_task(key: str, plan: Plan):
    tasks = F.lit(plan.buckets)
    return F.element_at(tasks, F.pmod(F.xxhash64(key), F.lit(len(plan.buckets))).cast("int") + 1)


def spread(df: DataFrame, key: str, by: str, plan: Plan) -> DataFrame:
    """Moves rows to their tasks: `__task` and `__heavy` are added; rows of a heavy key with one value of `by` stay together."""
    routed = _routes(df.where(F.col(key).isNotNull()), key, plan)
    shard = F.pmod(F.xxhash64(by), F.size("__tasks")).cast("int") + 1
    task = F.when(F.col("__tasks").isNull(), _bucket_task(key, plan)).otherwise(F.element_at("__tasks", shard))
    routed = routed.withColumns({"__heavy": F.col("__tasks").isNotNull(), "__task": task}).drop("__tasks")
    return routed.repartitionById(len(plan.loads), F.col("__task"))


def per_key(df: DataFrame, key: str, by: str, n_tasks: int | None = None) -> DataFrame:
    """`key`, `n_rows`, `n_distinct` (different non-null values of `by`) of every key that is not null.

    Repeated rows are added up before the shuffle, tasks get even loads, and only the few
    partial results of heavy keys meet again at the end. The table is read once: loads are
    estimated from the sums that are then spread.
    """
    return _per_key(df, key, by, n_tasks)[0]


def hot_keys(df: DataFrame, key: str, by: str, one_of: int, n_tasks: int | None = None) -> DataFrame:
    """The rows of `per_key` whose key has at least one of `one_of` rows that have a key."""
    found, total = _per_key(df, key, by, n_tasks)
    return found.where(F.col("n_rows") * one_of >= total)


def _per_key(df: DataFrame, key: str, by: str, n_tasks: int | None) -> tuple[DataFrame, int]:
    rows = df.select(F.col(key).alias("__key"), F.col(by).alias("__by")).where("__key IS NOT NULL")
    sums = written(combine(rows, ["__key", "__by"]))
    plan = plan_for(sums, "__key", n_tasks, weight="n")
    moved = spread(sums, "__key", "__by", plan)
    pairs = moved.groupBy("__task", "__key", "__by").agg(F.sum("n").alias("n"), F.max("__heavy").alias("__heavy"))
    parts = pairs.groupBy("__task", "__key").agg(F.sum("n").alias("n_rows"), F.count("__by").alias("n_distinct"), F.max("__heavy").alias("__heavy"))
    parts = written(parts)  # used twice: a light key is complete, of a heavy one there is a row a task
    light = parts.where("NOT __heavy").select("__key", "n_rows", "n_distinct")
    heavy = parts.where("__heavy").groupBy("__key").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_distinct").alias("n_distinct"))
    return light.unionByName(heavy).select(F.col("__key").alias(key), "n_rows", "n_distinct"), plan.total


def balanced_join(left: DataFrame, right: DataFrame, key: str, n_tasks: int | None = None, plan: Plan | None = None) -> DataFrame:
    """Inner join on `key` with the rows of heavy keys of `left` spread over their shards and `right` copied only there.

    Rows are spread by a hash of all their columns, so a lost task comes out the same when
    run again; only rows equal in every column share a shard. Other columns of `right` that
    `left` has too come out with the suffix `_right`. Null keys match nothing.
    """
    plan = plan or plan_for(left, key, n_tasks)
    clash = set(left.columns) - {key}
    right = right.select(*[F.col(c).alias(f"{c}_right" if c in clash else c) for c in right.columns])
    routed = _routes(left.where(F.col(key).isNotNull()), key, plan)
    shard = F.pmod(F.xxhash64(*left.columns), F.size("__tasks")).cast("int") + 1
    a = routed.withColumn("__task", F.when(F.col("__tasks").isNull(), _bucket_task(key, plan)).otherwise(F.element_at("__tasks", shard))).drop("__tasks")
    tasks = F.array_distinct(F.coalesce("__tasks", F.array(_bucket_task(key, plan))))
    b = _routes(right.where(F.col(key).isNotNull()), key, plan).withColumn("__task", F.explode(tasks)).drop("__tasks")
    n = len(plan.loads)
    return a.repartitionById(n, F.col("__task")).join(b.repartitionById(n, F.col("__task")), ["__task", key]).drop("__task")
