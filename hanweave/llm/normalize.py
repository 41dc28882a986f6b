"""One consistent text for all texts that look the same.

Arrow text goes to one numpy array of code points per batch; tables indexed by code point
give each character's replacement (gather plus expansion offsets), marks are put in
canonical order by one stable sort and composed in rounds over all texts at once. No
string function is called per row.

What is unified: canonical equivalents, width forms, compatibility ideographs and
radicals, presentation forms, ligatures and digraphs of letters, every kind of blank,
characters that show nothing, and letters of other scripts drawn like a Latin letter of
the same case. What stays apart: case, accents, number and place of blanks, raised,
lowered, ringed, squared, rotated and styled forms, figures for letters, simplified and
traditional or merely similar Han characters.

Letters of the Latin script itself that resemble others, as the open a, the dotless i or the g of
phonetic writing, are no letters of another script and stay apart too.

Null stays null, empty stays empty; a text of nothing but invisible characters becomes empty.
Bytes that are no UTF-8 count as U+FFFD, one for each broken character.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanweave.functions.utf8 import code_points
from hanweave.session import checkpointed, map_arrow

# Letters of other scripts drawn like a Latin letter of the same case.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ӏ": "I", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y",
    "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J", "ν": "v", "ο": "o", "ϳ": "j",
    # Armenian
    "Օ": "O", "Ս": "U", "հ": "h", "ո": "n", "օ": "o", "ս": "u",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G",
    "Ꮓ": "Z", "Ꮢ": "R", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Lisu, whose letters are drawn as capitals
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
# Characters that show nothing besides the format characters (Cf), as ranges.
INVISIBLE = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))
# Format characters that do show.
SHOWN_FORMAT = ((0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1345F))
# Blanks besides the space separators (Zs).
BLANKS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029, 0x2800)
#: Kinds of compatibility mapping whose two sides look the same.
SAME_LOOK_KINDS = {"<wide>", "<narrow>", "<small>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
# Fixed values: <compat> letters whose mapping is another shape (long s, symbol variants of Greek and Hebrew letters, lone Hangul letters).
OTHER_SHAPE = ((0x17F, 0x17F), (0x3D0, 0x3D6), (0x3F0, 0x3F2), (0x3F4, 0x3F5), (0x3F9, 0x3F9), (0x1E9A, 0x1E9A), (0x2100, 0x214F), (0x3131, 0x318E), (0x3200, 0x33FF))

#: Pairs of a look that one task may make.
TASK_PAIRS = 1 << 22
#: Code points unified at once.
PORTION = 1 << 20


def _within(cp: int, ranges) -> bool:
    return any(a <= cp <= b for a, b in ranges)


def _expand(cp: int, cache: dict[int, list[int]]) -> list[int]:
    """All code points that a code point is replaced by, fully decomposed."""
    if cp in cache:
        return cache[cp]
    ch, kind = chr(cp), unicodedata.category(chr(cp))
    if cp in BLANKS or kind == "Zs":
        out = [0x20]
    elif _within(cp, INVISIBLE) or kind == "Cf" and not _within(cp, SHOWN_FORMAT) or kind == "Cc":
        out = []
    else:
        out, parts = [cp], unicodedata.decomposition(ch).split()
        if parts:
            tag = parts.pop(0) if parts[0][0] == "<" else ""
            target = [int(x, 16) for x in parts]
            letters = all(unicodedata.category(chr(x))[0] == "L" for x in target)
            if not tag or tag in SAME_LOOK_KINDS or tag == "<compat>" and letters and not _within(cp, OTHER_SHAPE):
                out = [y for x in target for y in _expand(x, cache)]
        if out == [cp] and ch in LOOK_ALIKES:
            out = [ord(LOOK_ALIKES[ch])]
    cache[cp] = out
    return out


class Tables:
    """Lookup tables over all of Unicode, derived from Python's character database."""

    def __init__(self):
        n, cache = 0x110000, {}
        self.length = np.ones(n, dtype=np.uint8)
        self.offset = np.arange(n, dtype=np.int32)
        self.klass = np.zeros(n, dtype=np.uint8)
        data, pairs = [], {}
        for cp in range(n):
            if 0xAC00 <= cp < 0xD7A4 or 0xD800 <= cp < 0xE000 or 0x4E00 <= cp < 0xA000 or 0x30000 <= cp < 0xE0000 or cp >= 0xE1000:
                continue
            ch = chr(cp)
            if k := unicodedata.combining(ch):
                self.klass[cp] = k
            out = _expand(cp, cache)
            if out != [cp]:
                self.length[cp], self.offset[cp] = len(out), n + len(data)
                data += out
            parts = unicodedata.decomposition(ch).split()
            if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(x, 16) for x in parts)
                # The parts as they are after the replacement of look-alikes.
                left, right = _expand(a, cache), _expand(b, cache)
                if left == [a] and right == [b] or len(left) > 1:
                    pairs[a << 21 | b] = cp
        self.data = np.concatenate([np.arange(n, dtype=np.uint32), np.array(data, dtype=np.uint32)])
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], dtype=np.uint32)
        self.second = np.zeros(n, dtype=bool)  # starters that may join what precedes them
        seconds = np.unique(self.pair_keys & 0x1FFFFF)
        self.second[seconds[self.klass[seconds] == 0]] = True

    def compose(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The composite of each pair, 0 where there is none."""
        keys = a.astype(np.int64) << 21 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_to[at], 0)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def _join_starters(t: Tables, cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composes adjacent starters: Hangul letters by rule, the few others by table."""
    while len(cps) > 1:
        a, b = cps[:-1].astype(np.int64), cps[1:].astype(np.int64)
        lead = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        tail = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        to = np.where(lead, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, np.where(tail, a + b - 0x11A7, 0))
        other = t.second[b] & (to == 0)
        if other.any():
            to[other] = t.compose(a[other], b[other])
        hit = (to > 0) & (row[:-1] == row[1:])
        hit[1:] &= ~hit[:-1]  # of a chain, the first pair now, the rest in the next round
        if not hit.any():
            break
        cps = cps.copy()
        cps[:-1][hit] = to[hit]
        keep = np.concatenate([[True], ~hit])
        cps, row = cps[keep], row[keep]
    return cps, row


def unify(points: np.ndarray, lengths: np.ndarray, portion: int = PORTION) -> tuple[np.ndarray, np.ndarray]:
    """Replaces, orders and composes; both arrays as from `code_points`. Memory is bounded by cutting at characters that join nothing before them."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    done, start = [], 0
    while start < len(points):
        stop = start + portion
        while stop < len(points):
            ahead = points[stop : stop + 4096]
            (free,) = np.nonzero(((ahead >= 0x20) & (ahead < 0x7F)) | ((ahead >= 0x4E00) & (ahead < 0xA000)) | (row[stop : stop + len(ahead)] != row[stop - 1 : stop - 1 + len(ahead)]))
            if len(free):
                stop += int(free[0])
                break
            stop += len(ahead)
        done.append(_unify(points[start:stop], row[start:stop]))
        start = stop
    if not done:
        return points, lengths
    cps, row = (np.concatenate(x) for x in zip(*done))
    return cps, np.bincount(row, minlength=len(lengths)).astype(np.int64)


def _unify(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points and row of each that some code points of ascending rows become."""
    t = tables()
    n = t.length[points].astype(np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    within = np.arange(total) - np.repeat(ends - n, n)
    cps = t.data[np.repeat(t.offset[points], n) + within]
    row = np.repeat(row, n)
    klass = t.klass[cps]
    if klass.any():
        base = klass == 0
        first = np.concatenate([[True], row[1:] != row[:-1]])
        segment = np.cumsum(base | first)  # a base with its marks; marks that open a text stand alone
        order = np.lexsort((klass, segment))  # stable: equal classes keep their order
        cps, klass = cps[order], klass[order]
        keep, (at,) = np.ones(len(cps), dtype=bool), np.nonzero(klass)
        begins = np.nonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))[0]
        start = begins[segment[at] - 1]
        rank = at - start  # place of the mark after its base
        at, start, rank = (x[klass[start] == 0] for x in (at, start, rank))
        held = np.zeros(len(cps), dtype=np.uint8)  # by base: class of the last mark that stayed
        by_rank = np.argsort(rank, kind="stable")
        at, start, rank = at[by_rank], start[by_rank], rank[by_rank]
        bounds = np.nonzero(np.concatenate([[True], rank[1:] != rank[:-1], [True]]))[0] if len(rank) else []
        for lo, hi in zip(bounds, bounds[1:]):  # the first mark of all bases, then the second, ...
            m, b = at[lo:hi], start[lo:hi]
            to = t.compose(cps[b], cps[m])
            hit = (to > 0) & (held[b] < klass[m])
            cps[b[hit]] = to[hit]
            keep[m[hit]] = False
            held[b[~hit]] = klass[m[~hit]]
        cps, row = cps[keep], row[keep]
    return _join_starters(t, cps, row)


def unify_array(column: pa.Array) -> pa.Array:
    """The Arrow text column with each text in its consistent form."""
    points, lengths = code_points(column)
    cps, lengths = unify(points, lengths)
    raw = cps.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    size = np.where(cps < 0x80, 1, np.where(cps < 0x800, 2, np.where(cps < 0x10000, 3, 4)))
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(lengths)])]
    valid = pa.array(np.asarray(column.is_valid())).buffers()[1] if column.null_count else None
    return pa.Array.from_buffers(pa.large_string(), len(column), [valid, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.string())


def with_unified(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """`df` with the consistent form of `text_col` in `name` (replaced if it exists); no shuffle."""
    kept = [f for f in df.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T.StringType())])
    at = [f.name for f in kept].index(text_col) if text_col != name else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], unify_array(batch.column(at))], names=schema.names)

    chosen = df.select(*[f"`{f.name}`" for f in kept], *([F.col(f"`{name}`")] if text_col == name else []))
    return map_arrow(chosen, run, schema)


def same_look_pairs(rows: DataFrame, group_cols: list[str], id_col: str = "id", text_col: str = "text", task_pairs: int = TASK_PAIRS) -> DataFrame:
    """`group_cols`, `id_lo`, `id_hi`: pairs of rows of a group that look the same but differ in their characters.

    Null and empty texts, null ids and null group values pair with nothing. Rows of one spelling are
    held as lists of ids, so spellings of a look meet once, not row by row. The rows of a look that
    makes more than `task_pairs` pairs are dealt out to shards: one side of the join has each list in
    its own shard only, the other in all of them, and there are never so many shards that the copies
    outnumber the pairs. So no task holds more than its share of a look with a third of all rows.
    """
    kept = rows.select(*group_cols, F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.col("__text") != "")
    for c in group_cols:
        kept = kept.where(F.col(c).isNotNull())
    look = [*group_cols, "__look"]
    digest = lambda c: F.unhex(F.md5(c))
    looks = with_unified(kept, "__text", "__look").select(*group_cols, "__id", digest("__look").alias("__look"), digest("__text").alias("__raw"))
    looks = checkpointed(looks)  # some 50 bytes a row, used twice, so that texts are unified once
    # Spellings differ if either of two hashes does; numbers, unlike digests, are aggregated without a sort.
    hashes = [F.xxhash64(F.lit(k), "__raw") for k in range(2)]
    several = looks.groupBy(*look).agg(*[f(h).alias(f"__{n}{k}") for k, h in enumerate(hashes) for n, f in (("a", F.min), ("b", F.max))])
    several = several.where("__a0 < __b0 OR __a1 < __b1")
    looks = checkpointed(looks.join(several.select(*look), look, "left_semi"))
    sizes = looks.groupBy(*look, "__raw").agg(F.count("*").alias("n"))
    total = sizes.groupBy(*look).agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("own"))
    pairs = (F.col("n").cast("double") * F.col("n") - F.col("own")) / 2
    shards = total.select(*look, F.greatest(F.lit(1), F.floor(F.least(pairs / task_pairs, pairs / F.col("n")))).cast("int").alias("__shards"))
    dealt = looks.join(shards, look).withColumn("__shard", F.pmod(F.xxhash64("__id"), F.col("__shards")).cast("int"))
    lists = dealt.groupBy(*look, "__shards", "__raw", "__shard").agg(F.collect_list("__id").alias("__ids"))
    copies = lists.select(*look, F.col("__raw").alias("__raw2"), F.col("__ids").alias("__ids2"), F.explode(F.sequence(F.lit(0), F.col("__shards") - 1)).alias("__shard"))
    return (
        lists.join(copies, [*look, "__shard"])
        .where("__raw < __raw2")
        .select(*group_cols, F.explode("__ids").alias("__x"), "__ids2")
        .select(*group_cols, "__x", F.explode("__ids2").alias("__y"))
        .select(*group_cols, F.least("__x", "__y").alias("id_lo"), F.greatest("__x", "__y").alias("id_hi"))
    )
