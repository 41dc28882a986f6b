"""Mixing sources to target shares of the total size.

Every record of a source gets the same wanted number of copies, whole part plus fraction. The
fractions become 0 or 1 by pivotal dependent rounding: two fractional records meet, size is
moved from one to the other at random until one of them is integral, the other goes on. What
is moved is size, not count, so the total of a source changes by nothing but its very last
record. Blocks of records are rounded in parallel; what each block leaves, at most one record
a source, meets again in the next level of a reduction tree.

So that this last record is small, the largest records of a source, up to `BLOCK` of them, are
decided one by one before, from the largest down, each by its fraction; all smaller records
together give or take its size, so they keep one common fraction. A record larger than what the
others can give or take moves them as far as its chance allows, and the share is missed by what
is left, which `shares` reports. The expected copies of every record are exactly its wanted
number at any size of a source. All draws are hashes of the record's id and a seed, so a lost
task comes out the same when run again.

The result has every record with its copies, 0 for those not drawn, of a source that is null
or without a target, or of null size or size 0, as these add nothing to any share. Targets of
absent sources are reported with an actual share of 0 and the others are scaled up.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanweave.session import checkpointed, ship_package

#: Records of a block, and blocks that meet in one group of the next level.
BLOCK = 4096
FAN_IN = 256
_EPS = 1e-9


@dataclass
class Need:
    """What a source is to contribute: whole copies and a fraction of a copy of all records. Those of 2**`large` and more are decided first."""

    whole: int
    fraction: float
    large: int
    size: int
    blocks: int


def wanted_copies(sizes: dict[str, dict[int, tuple[int, int]]], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, Need]:
    """Per source that is present what reaches its share. `sizes`: source -> {k: (size, number)} of its records below 2**(k + 1).

    Without `total` the mix is the largest that meets all shares; with it, sources that
    cannot fill their share are repeated as often as allowed and fall short.
    """
    size = {s: sum(x for x, _ in parts.values()) for s, parts in sizes.items()}
    present = {s: (share, cap) for s, (share, cap) in targets.items() if share > 0 and cap > 0 and size.get(s)}
    shared = sum(share for share, _ in present.values())
    if total is None:
        total = min((cap * size[s] / (share / shared) for s, (share, cap) in present.items()), default=0.0)
    needs = {}
    for s, (share, cap) in present.items():
        copies = min(float(cap), total * share / shared / size[s])
        whole = int(copies + _EPS)
        fraction = max(0.0, copies - whole)
        large, n_large = max(sizes[s]) + 1, 0
        while large > min(sizes[s]) and n_large + sizes[s].get(large - 1, (0, 0))[1] <= BLOCK:
            large -= 1
            n_large += sizes[s].get(large, (0, 0))[1]
        n = sum(n for _, n in sizes[s].values()) - n_large
        needs[s] = Need(whole, fraction if fraction > _EPS else 0.0, large, size[s], max(1, -(-n // BLOCK)))
    return needs


def _draw(seed: int):
    """A uniform number in [0, 1) from the id alone."""
    return F.pmod(F.xxhash64(F.lit(seed), "__id"), F.lit(1 << 53)) / F.lit(float(1 << 53))


def round_block(sizes: np.ndarray, fractions: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Fractions after pivotal rounding: all 0 or 1 but for at most one. sum(size * fraction) stays as it is.

    Records meet from the largest to the smallest, so what is left over tends to be small.
    """
    out = fractions.astype(float).tolist()
    order = np.argsort(-sizes, kind="stable").tolist()
    sizes, draws, held = sizes.tolist(), draws.tolist(), -1
    for k in order:
        if out[k] <= _EPS or out[k] >= 1 - _EPS:
            out[k] = round(out[k])
            continue
        if held < 0:
            held = k
            continue
        a, b, sa, sb = out[held], out[k], float(sizes[held]), float(sizes[k])
        up = min((1 - a) * sa, b * sb)  # size that can move from k to the held record
        down = min(a * sa, (1 - b) * sb)  # and back
        move = up if draws[k] * (up + down) < down else -down  # so that the expected move is 0
        out[held], out[k] = a + move / sa, b - move / sb
        for x in (held, k):
            if out[x] <= _EPS or out[x] >= 1 - _EPS:
                out[x] = round(out[x])
        held = next((x for x in (held, k) if _EPS < out[x] < 1 - _EPS), -1)
    return np.array(out, dtype=float)


def decide_largest(sizes: np.ndarray, fraction: float, total: float, draws: np.ndarray) -> tuple[np.ndarray, float]:
    """0 or 1 for each of the largest records, largest first, and the fraction that all others have then.

    `total` is the size of all records of the source, each of which has `fraction`.
    """
    out, q, rest = [], fraction, float(total)
    for s, draw in zip(sizes.tolist(), draws.tolist()):
        rest -= s
        taken = draw < q
        out.append(float(taken))
        if 0 < q < 1 and rest > 0:
            d = min(s / rest, q / (1 - q), (1 - q) / q)  # the others stay within 0 and 1 and their expected move is 0
            q = q - (1 - q) * d if taken else q + q * d
            q = round(q) if q <= _EPS or q >= 1 - _EPS else q
    return np.array(out, dtype=float), float(q)


def _decider(needs: dict[str, Need]):
    def decided(largest: pd.DataFrame) -> pd.DataFrame:
        largest = largest.sort_values(["__size", "__id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        need = needs[largest["source"].iloc[0]]
        x, left = decide_largest(largest["__size"].to_numpy(), need.fraction, need.size, largest["__draw"].to_numpy())
        return largest.assign(__fraction=x, __left=left)

    return decided


def _rounder(last: bool):
    def rounded(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["__size", "__id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        x = round_block(block["__size"].to_numpy(), block["__fraction"].to_numpy(), block["__draw"].to_numpy())
        if last:  # the one record left of the source
            over = (x > 0) & (x < 1)
            x[over] = block["__last"].to_numpy()[over] < x[over]
        return block.assign(__fraction=x)

    return rounded


def mix(records: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_tokens", total: float | None = None, seed: int = 7) -> DataFrame:
    """`id_col`, `source`, `size_col`, `copies` of every record; it is in the mix if `copies` is over 0.

    `targets`: source, target_share, max_repeats; one row a source, some dozens at most, as is
    what reaches the driver: its rows and the sizes of its sources by powers of two.
    """
    want = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.collect() if r["source"] is not None}
    rows = records.select(F.col(id_col).alias("__id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("__size"))
    all_rows = rows
    rows = rows.where((F.col("__size") > 0) & F.col("source").isin(list(want)))
    size_class = F.floor(F.log2("__size")).cast("int")
    by_size = rows.groupBy("source", size_class.alias("k")).agg(F.sum("__size").alias("size"), F.count("*").alias("n"))
    found: dict = {}
    for r in by_size.collect():  # a source times some dozen sizes
        found.setdefault(r["source"], {})[r["k"]] = (r["size"], r["n"])
    needs = wanted_copies(found, want, total)
    named = [F.col("__id").alias(id_col), "source", F.col("__size").alias(size_col)]
    # Records that take no part; a comparison with null counts as no.
    others = all_rows.where(~F.coalesce((F.col("__size") > 0) & F.col("source").isin(list(needs)), F.lit(False)))
    others = others.select(*named, F.lit(0).cast("long").alias("copies"))
    if not needs:
        return others

    per_source = lambda f: F.create_map(*[F.lit(x) for s, need in needs.items() for x in (s, f(need))])[F.col("source")]
    rows = rows.where(F.col("source").isin(list(needs))).select(
        "__id", "source", "__size",
        per_source(lambda x: x.whole).cast("long").alias("__base"),
        per_source(lambda x: x.fraction).cast("double").alias("__fraction"),
        F.pmod(F.xxhash64("__id"), per_source(lambda x: x.blocks)).cast("long").alias("__block"),
        (size_class >= per_source(lambda x: x.large)).alias("__large"),
    )
    rows = rows.withColumn("__last", _draw(seed - 1))
    drawn = lambda df, level: df.withColumn("__draw", _draw(seed + level))
    largest = drawn(rows.where("__large").drop("__large"), -2)
    ship_package(records.sparkSession)
    first = checkpointed(largest.groupBy("source").applyInPandas(_decider(needs), T.StructType([*largest.schema.fields, T.StructField("__left", T.DoubleType())])))
    for r in first.groupBy("source").agg(F.first("__left").alias("left")).collect():  # a row a source
        needs[r["source"]] = replace(needs[r["source"]], fraction=r["left"])
    result = first.drop("__left", "__draw")
    rows = rows.where("NOT __large").drop("__large").withColumn("__fraction", per_source(lambda x: x.fraction).cast("double"))
    most, level = max(x.blocks for x in needs.values()), 0
    while True:
        rows = drawn(rows, level)
        done = checkpointed(rows.groupBy("source", "__block").applyInPandas(_rounder(most == 1), rows.schema)).drop("__draw")
        integral = done.where("__fraction IN (0, 1)")
        result = result.unionByName(integral)
        if most == 1:
            break
        rows = done.where("__fraction NOT IN (0, 1)").withColumn("__block", F.expr(f"__block DIV {FAN_IN}"))
        most, level = -(-most // FAN_IN), level + 1
    copies = (F.col("__base") + F.col("__fraction")).cast("long")
    return result.select(*named, copies.alias("copies")).unionByName(others)


def shares(mixed: DataFrame, targets: DataFrame, size_col: str = "n_tokens") -> DataFrame:
    """`source`, `target_share`, `max_repeats`, `size`, `actual_share`, `most_copies` of every target, also of those without records."""
    sums = mixed.where("copies > 0").groupBy("source").agg(F.sum(F.col(size_col) * F.col("copies")).alias("size"), F.max("copies").alias("most_copies"))
    joined = targets.join(F.broadcast(sums), "source", "left").na.fill(0, ["size", "most_copies"])  # sums: a row a target at most
    total = sums.agg(F.sum("size")).scalar()
    share = F.coalesce(F.col("size") / total, F.lit(0.0))
    return joined.select("source", "target_share", "max_repeats", "size", share.alias("actual_share"), "most_copies")
