"""Pairs of items that occur in the same record, against chance.

Blocked Gram matrix: records are rows of a binary sparse matrix X over items. A task takes
blocks of records; of each it numbers the items, cuts them into item blocks and holds X_I as
compressed sparse rows for each item block I. For every pair of item blocks I <= J it takes the
transpose-product X_I^T X_J into a tile and adds the tile's entries to its sums; the sums of all
tasks are added by key. The diagonal of the Gram matrix holds how many records have each item,
and an entry without items how many records there are, so counts, marginals and the number of
records come from one pass.

A record of any size is handled: one with more than `tile_items` items is cut into
fragments, and every pair of fragments is one tile with a task of its own choosing, so
neither a task nor a list ever holds more than two fragments of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanweave.session import checkpointed, map_arrow

#: Items of a fragment of a large record; products of a block of records, and entries held before they are passed on.
TILE_ITEMS = 512
HELD = 1 << 20
#: Items of an item block, and item blocks of a block of records at most.
ITEM_BLOCK, MOST_BLOCKS = 1024, 32

_GRAM = "item_x long, item_y long, n long"


class SparseRows:
    """X_I of one item block: compressed sparse rows over the records, item numbers within the block, and their sides."""

    def __init__(self, record: np.ndarray, column: np.ndarray, side: np.ndarray | None, n_records: int):
        self.record, self.column, self.side = record, column, side
        self.size = np.bincount(record, minlength=n_records)
        self.start = np.cumsum(self.size) - self.size

    def transpose_product(self, other: SparseRows) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the entries of X_I^T X_J, from each of I's entries to all of J's in the same record.

        Items whose sides are both 1 or both 2 make no entry, as in a tile of two fragments.
        """
        n = other.size[self.record]
        left = np.repeat(np.arange(len(self.record)), n)
        right = np.arange(len(left)) + np.repeat(other.start[self.record] - (np.cumsum(n) - n), n)
        if self.side is not None:
            across = (self.side[left] == 0) | (self.side[left] != other.side[right])
            left, right = left[across], right[across]
        return self.column[left], other.column[right]


def _item_blocks(at: np.ndarray, n_items: int, lengths: np.ndarray, side: np.ndarray | None, block: int) -> list[SparseRows]:
    """X_I for each run of `block` of the items, which `at` numbers, of a block of records."""
    record = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(at // block, kind="stable")  # by item block, then by record
    bounds = np.searchsorted((at // block)[order], np.arange(-(-n_items // block) + 1))
    parts = [order[lo:hi] for lo, hi in zip(bounds, bounds[1:])]
    return [SparseRows(record[p], at[p] % block, None if side is None else side[p], len(lengths)) for p in parts]


def _block_product(items: np.ndarray, lengths: np.ndarray, side: np.ndarray | None, block: int = ITEM_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(x, y), x <= y, and value of the entries of X^T X over a block of records; the items of a record are distinct.

    Item blocks are larger where there are very many items, so that there are never many pairs of
    blocks. A tile is a dense array where it has about as many entries as cells, else they are sorted.
    """
    own, at = np.unique(items, return_inverse=True)
    block = max(block, -(-len(own) // MOST_BLOCKS))
    blocks = _item_blocks(at, len(own), lengths, side, block)
    xs, ys, counts = [], [], []
    for i, a in enumerate(blocks):
        for j in range(i, len(blocks)):
            x, y = a.transpose_product(blocks[j])
            if i == j:
                upper = x <= y
                x, y = x[upper], y[upper]
            if not len(x):
                continue
            cell = x * block + y
            if len(cell) * 8 >= block * block:
                tile = np.bincount(cell, minlength=block * block)
                (entry,) = np.nonzero(tile)
                count = tile[entry]
            else:
                entry, count = np.unique(cell, return_counts=True)
            xs.append(own[i * block + entry // block])
            ys.append(own[j * block + entry % block])
            counts.append(count)
    if not xs:
        return np.zeros((2, 0), dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.stack([np.concatenate(xs), np.concatenate(ys)]), np.concatenate(counts)


def _sum_blocks(entries: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Adds up entries of equal (x, y) of several blocks."""
    if len(entries) == 1:
        return entries[0]
    own, at = np.unique(np.concatenate([e for e, _ in entries], axis=1), return_inverse=True)
    at = at.reshape(2, -1)
    code = at[0] * len(own) + at[1]
    order = np.argsort(code, kind="stable")
    code, n = code[order], np.concatenate([c for _, c in entries])[order]
    first = np.nonzero(np.concatenate([[True], code[1:] != code[:-1]]))[0]
    return np.stack([own[code[first] // len(own)], own[code[first] % len(own)]]), np.add.reduceat(n, first)


def _gram_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(xy, n):
        return pa.RecordBatch.from_arrays([pa.array(xy[0]), pa.array(xy[1]), pa.array(n)], names=["item_x", "item_y", "n"])

    held, size, n_records = [], 0, 0
    for batch in batches:
        lists = batch.column(0)
        n_records += len(batch)
        lengths = np.diff(lists.offsets.to_numpy())
        items = lists.values.slice(lists.offsets[0].as_py(), int(lengths.sum())).to_numpy(zero_copy_only=False).astype(np.int64)
        side = None
        if batch.num_columns == 2:
            s = batch.column(1)
            side = s.values.slice(s.offsets[0].as_py(), int(lengths.sum())).to_numpy(zero_copy_only=False)
        at, done = 0, 0
        squares = np.cumsum(lengths.astype(np.int64) ** 2)
        while at < len(lengths):  # record blocks of bounded product size
            to = max(at + 1, int(np.searchsorted(squares, (squares[at - 1] if at else 0) + HELD, side="right")))
            upto = done + int(lengths[at:to].sum())
            if upto > done:
                held.append(_block_product(items[done:upto], lengths[at:to], None if side is None else side[done:upto]))
                size += len(held[-1][1])
            at, done = to, upto
            if size > HELD:
                held = [_sum_blocks(held)]
                size = len(held[0][1])
                if size > HELD // 2:
                    yield out(*held[0])
                    held, size = [], 0
    if held:
        yield out(*_sum_blocks(held))
    if n_records:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([n_records], pa.int64())], names=["item_x", "item_y", "n"])


def gram(lists: DataFrame, items_col: str, side_col: str | None = None) -> DataFrame:
    """`item_x <= item_y`, `n`: records with both, from one list of distinct items a record (bigint); null items: all lists."""
    cols = [F.col(items_col)] + ([F.col(side_col)] if side_col else [])
    return map_arrow(lists.select(*cols), _gram_of, _GRAM).groupBy("item_x", "item_y").agg(F.sum("n").alias("n"))


def gram_of_pairs(df: DataFrame, record_cols: list[str], left: str, right: str) -> DataFrame:
    """Gram entries, with the number of records under null items, for records of two items held in two columns.

    Rows with a null item or a null record key are left out; a record stored repeatedly counts
    once. Stored copies of one record that disagree count by the smallest pair.
    """
    known = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    for c in record_cols:
        known = known.where(F.col(c).isNotNull())
    if all(isinstance(df.schema[c].dataType, T.IntegerType) for c in (left, right)):
        # Two integers as one number in the same order, which is aggregated by hash instead of by sort.
        pair = F.shiftleft(F.col(left).cast("long"), 32).bitwiseOR(F.col(right).cast("long") + (1 << 31))
        sides = [F.shiftright("__p", 32), F.col("__p").bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)]
    else:
        pair, sides = F.struct(F.col(left).cast("long").alias("l"), F.col(right).cast("long").alias("r")), [F.col("__p.l"), F.col("__p.r")]
    records = known.groupBy(*record_cols).agg(F.min(pair).alias("__p"))
    lists = records.select(F.array_distinct(F.array(*sides)).alias("__items"))
    return gram(lists, "__items")


def gram_of_baskets(df: DataFrame, record_cols: list[str], item: str, tile_items: int = TILE_ITEMS) -> DataFrame:
    """Gram entries for records of any number of rows, one item a row; null items and keys are left out."""
    rows = df.select(*record_cols, F.col(item).cast("long").alias("__item")).dropna().distinct()
    sizes = rows.groupBy(*record_cols).agg(F.ceil(F.count("*") / tile_items).cast("int").alias("__frags"))
    rows = rows.join(sizes, record_cols).withColumn("__frag", F.pmod(F.xxhash64("__item"), F.col("__frags")).cast("int"))
    mates = F.sequence(F.lit(0), F.col("__frags") - 1)
    tiles = rows.withColumn("__mate", F.explode(mates)).select(
        *record_cols, "__item", "__frag",
        F.least("__frag", "__mate").alias("__lo"), F.greatest("__frag", "__mate").alias("__hi"),
    )
    side = F.when(F.col("__lo") == F.col("__hi"), 0).when(F.col("__frag") == F.col("__lo"), 1).otherwise(2)
    lists = tiles.groupBy(*record_cols, "__lo", "__hi").agg(F.collect_list(F.struct(F.col("__item").alias("i"), side.alias("s"))).alias("__l"))
    return gram(lists.select(F.col("__l.i").alias("__i"), F.col("__l.s").alias("__s")), "__i", "__s").where("item_x IS NOT NULL")


def lift(entries: DataFrame, n_records: int, least: int = 1, share: float = 0.0, times: float = 0.0) -> DataFrame:
    """`item_x < item_y`, `n`, `n_x`, `n_y`, `lift` = n * N / (n_x * n_y), normalised by the expected marginals.

    Keeps pairs with n >= `least`, n / N >= `share`, lift >= `times`. Pairs too rare go before
    the marginals are joined. Comparisons are of whole numbers where `share` and `times` are
    reciprocals or whole. `entries` should be checkpointed: it is used three times.
    """
    marginals = entries.where("item_x = item_y").select(F.col("item_x").alias("item"), F.col("n").alias("m"))
    n, big = F.col("n"), F.lit(n_records).cast("decimal(20,0)")
    pairs = entries.where("item_x < item_y").where(n >= least)
    if share:
        pairs = pairs.where(n * F.lit(round(1 / share)) >= n_records)
    x = marginals.select(F.col("item").alias("item_x"), F.col("m").alias("n_x"))
    y = marginals.select(F.col("item").alias("item_y"), F.col("m").alias("n_y"))
    pairs = pairs.join(x, "item_x").join(y, "item_y")
    if times:
        dec = lambda c: F.col(c).cast("decimal(18,0)")
        pairs = pairs.where(dec("n") * big >= dec("n_x") * dec("n_y") * F.lit(times))
    ratio = n.cast("double") * n_records / (F.col("n_x").cast("double") * F.col("n_y"))
    return pairs.select("item_x", "item_y", "n", "n_x", "n_y", ratio.alias("lift"))


def pair_lifts(df: DataFrame, record_cols: list[str], left: str, right: str, least: int = 1, share: float = 0.0, times: float = 0.0) -> DataFrame:
    """`lift` over the records of `gram_of_pairs`, in one pass over them. The number of records is the only value that reaches the driver."""
    entries = checkpointed(gram_of_pairs(df, record_cols, left, right))
    n_records = entries.where("item_x IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return lift(entries, n_records, least, share, times)
