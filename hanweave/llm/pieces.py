"""Cutting oversized texts into pieces under a limit of tokens, at natural boundaries, with overlap.

A piece is a run of consecutive tokens of its text's encoding that begins and ends between
characters. As neighbouring tokens of an encoding are also the encoding of what they spell,
such a piece has just that many tokens by itself, so cutting needs one encoding pass for any
number of limits. Only a run of blanks at a piece's end may have fewer, which is noted at
the places after such runs; an apostrophe that would begin a piece as a contraction, but is
none in the text, is no place to cut.

A giant text is processed by ranges. A worker sees its range with a halo on both sides and
detects boundaries in it: at every `section_chars` characters an anchor, the strongest natural
boundary of the next `ANCHOR_CHARS` characters at which a word certainly ends, whatever comes
before. What is known of an anchor is in the characters around it alone, so workers of any
ranges find the same ones. The tables of boundaries are stitched: where no anchor was found the
sections on both sides are one. A section is encoded by itself, as no token crosses an anchor;
of the section before it needs only the last tokens, for the overlap. Lengths and numbers of
pieces are summed up over sections, and pieces are emitted by offset. So results do not depend
on the ranges, and a task never holds more than a section of a text, of which there are longer
ones only where a text has no boundary at all for as long. Texts of one range, which is most,
go through the same steps inside one task without a shuffle.

Null, empty and small texts give no pieces. Pieces cover the text without gaps; consecutive
ones share at least the wanted tokens, and no more than a character beyond. A cut falls on the
strongest boundary of the second half of what the limit allows (blank line, line, sentence,
clause, blank), the last of equals; where there is none, on the last boundary before it after
which the next piece still starts later; where there is none either, before the last character
that fits. Anchors are cuts too. Broken encodings count as U+FFFD.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanweave.functions import utf8
from hanweave.llm import bpe
from hanweave.session import checkpointed, map_arrow, task_count, written

#: Characters of a range, of a halo, of the window in which an anchor is looked for, and of the context that tells its strength.
RANGE_CHARS = 1 << 15
ANCHOR_CHARS = 1 << 9
_CONTEXT = 8
HALO_CHARS = ANCHOR_CHARS + _CONTEXT
#: Characters of a section at least; sections have more tokens than any limit, whatever the text.
SECTION_CHARS = 1 << 16
#: Rows of missing anchors and of giant texts, and tails of sections, that are sent to all workers, of some 100 bytes and some kilobytes.
BROADCAST_ROWS, BROADCAST_TAILS = 1 << 18, 1 << 12
_BATCH_CHARS = 1 << 20
#: Places of a text that are held as a list.
LISTED = 1 << 16

BLANK_LINE, LINE, SENTENCE, CLAUSE, BLANK, NONE = 5, 4, 3, 2, 1, 0

# Marks by which natural boundaries are told.
_BREAKS = [0x0A, 0x0D, 0x85, 0x2028, 0x2029]
_SPACES = [0x20, 0x09, 0x0B, 0x0C, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, *_BREAKS]
_FINAL_WIDE = [ord(c) for c in "。！？…｡"]
_FINAL_ASCII = [ord(c) for c in ".!?"]
_CLAUSE_WIDE = [ord(c) for c in "，、；："]
_CLAUSE_ASCII = [ord(c) for c in ",;:"]
_CLOSERS = [ord(c) for c in "”’」』）》】\"')]"]
_OPENERS = frozenset(_BREAKS + _CLOSERS)

# A word certainly ends between these, whatever comes before: the split pattern never joins them.
_CERTAIN = regex.compile(
    r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])|(?<=[^\s\p{L}\p{N}])(?=[\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=\p{L})|(?<=[^\S ])(?=\S)"
)
# What an apostrophe after it is no part of, and the letters with which one begins a contraction.
_ENDS_WORD = regex.compile(r"[\p{L}\p{N}]|[^\S ]")
_APOSTROPHE, _CONTRACTED = 0x27, [ord(c) for c in "stmdrvl"]


@dataclass(frozen=True)
class Limit:
    """A row of the table of limits."""

    limit_id: int
    most: int
    overlap: int

    def __post_init__(self):
        if not 0 <= self.overlap * 2 < self.most:
            raise ValueError(f"the overlap of {self.overlap} tokens must be under half of {self.most}")


# The marks of each character of the basic plane as bits; the last place stands for all others.
_KINDS = (_BREAKS, _SPACES, _FINAL_WIDE, _FINAL_ASCII, _CLAUSE_WIDE, _CLAUSE_ASCII, _CLOSERS)
_IS_BREAK, _IS_SPACE, _IS_FINAL_WIDE, _IS_FINAL_ASCII, _IS_CLAUSE_WIDE, _IS_CLAUSE_ASCII, _IS_CLOSER = (1 << k for k in range(len(_KINDS)))
_MARKS = np.zeros(0x10000, dtype=np.uint8)
for _bit, _points in enumerate(_KINDS):
    _MARKS[_points] |= 1 << _bit


def _marks(points: np.ndarray) -> np.ndarray:
    return _MARKS[np.minimum(points, 0xFFFF)]


def strengths(points: np.ndarray, marks: np.ndarray | None = None) -> np.ndarray:
    """Strength of a cut before each character."""
    out = np.zeros(len(points), dtype=np.int8)
    if len(points) < 2:
        return out
    marks = _marks(points) if marks is None else marks
    brk, space, closer = (marks & x > 0 for x in (_IS_BREAK, _IS_SPACE, _IS_CLOSER))
    final_w, final_a = marks & _IS_FINAL_WIDE > 0, marks & _IS_FINAL_ASCII > 0
    gap_after = np.append(space[1:], True)
    final = final_w | (final_a & gap_after)
    # A closing mark ends the sentence that ended before it.
    after_final = closer & np.append(False, (final_w | final_a)[:-1]) & (gap_after | (points > 0x7F))
    ends_sentence, ends_clause = final | after_final, (marks & _IS_CLAUSE_WIDE > 0) | ((marks & _IS_CLAUSE_ASCII > 0) & gap_after)
    stays = closer | final_w | final_a  # marks that stay with what they close
    prev, here = slice(None, -1), slice(1, None)
    at = out[here]
    at[space[here] != space[prev]] = BLANK
    at[ends_clause[prev] & ~stays[here]] = CLAUSE
    at[ends_sentence[prev] & ~stays[here]] = SENTENCE
    at[brk[prev] & ~brk[here]] = LINE
    if not brk.any():
        return out
    lf, cr = points == 0x0A, points == 0x0D
    line_end = brk & ~(cr & np.append(lf[1:], False))  # of CR LF, the LF
    seen = np.cumsum(line_end)
    # Line ends in the run of breaks before each place.
    base = np.maximum.accumulate(np.where(brk, 0, seen))
    at[(brk[prev] & ~brk[here]) & (seen[prev] - base[prev] >= 2)] = BLANK_LINE
    return out



def section_size(limits: list[Limit], longest: int, least: int = SECTION_CHARS) -> int:
    """Characters between anchors: so many that each section has more tokens than any limit, when a token has up to `longest` characters."""
    return max(least, ANCHOR_CHARS + longest * max(x.most for x in limits))


def anchors(text: str, start: int, lo: int, hi: int, section: int) -> list[int]:
    """Anchors in [lo, hi) of a whole text of which `text` is what begins at `start`, with a halo around [lo, hi)."""
    found = []
    for grid in range(max(1, (lo - ANCHOR_CHARS) // section) * section, hi, section):
        a = grid - start
        if a < 0 or grid + ANCHOR_CHARS <= lo:
            continue
        if a + ANCHOR_CHARS > len(text):  # only at the text's end
            break
        before = min(a, _CONTEXT)
        part = text[a - before : a + ANCHOR_CHARS + _CONTEXT]
        level = strengths(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4"))
        best, at = NONE, -1
        for m in _CERTAIN.finditer(part):
            k = m.start()
            if before <= k < before + ANCHOR_CHARS and level[k] > best:
                best, at = level[k], k
        if at >= 0 and lo <= grid + at - before < hi:
            found.append(grid + at - before)
    return found


def choose(tok: list[int], marks: list[list[int]], off: list[int], limit: Limit, start: int = 0, end: int = 0) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, tokens shared with the piece before) of the pieces up to the last place, by index into `tok`.

    `tok`: tokens before each place; `start`: where the first piece begins, `end`: where the piece before it ended.
    """
    out, a, top, most, overlap = [], start, len(tok) - 1, limit.most, limit.overlap
    while tok[top] - tok[a] > most:
        first = tok[a]
        hi = max(bisect_right(tok, first + most) - 1, end + 1)  # the latter only if one character has more tokens than the limit leaves
        lo = max(end + 1, bisect_left(tok, first + most // 2))
        b = hi
        for mark in marks:
            k = bisect_right(mark, hi) - 1
            if k >= 0 and mark[k] >= lo:
                b = mark[k]
                break
        else:  # no boundary in the second half: the last one before it from which the next piece starts later
            k = bisect_right(marks[-1], hi) - 1
            if k >= 0 and marks[-1][k] > end and tok[marks[-1][k]] - overlap >= tok[a + 1]:
                b = marks[-1][k]
        out.append((a, b, tok[b] + off[b] - first, tok[end] - first))
        end = b
        a = max(a + 1, bisect_right(tok, tok[b] - overlap) - 1)
    if top > end:
        out.append((a, top, tok[top] + off[top] - tok[a], tok[end] - tok[a]))
    return out


def _sequence(x: np.ndarray) -> list[int] | array:
    """Numbers to look up one by one: a list, which is faster, of few, and eight bytes each of many."""
    return x.tolist() if len(x) < LISTED else array("q", x.astype(np.int64).tobytes())


def marks_of(lev: np.ndarray) -> list[list[int] | array]:
    """Indices of the places of each strength or more, the strongest first."""
    (some,) = np.nonzero(lev)
    return [_sequence(some[lev[some] >= k]) for k in range(BLANK_LINE, NONE, -1)]


@dataclass
class Section:
    """A section's characters, the character after it, and where in its text it begins."""

    text: str
    after: str
    start: int


@dataclass
class Places:
    """Where a section may be cut: characters and tokens since its start, strengths, and tokens that a piece ending there has more by itself (0 or less). The first place is its start."""

    pos: np.ndarray
    tok: np.ndarray
    lev: np.ndarray
    off: np.ndarray


@dataclass
class Tail:
    """The end of a section as the next one needs it: its last characters, and the places in them, counted from the tail's start."""

    text: str
    pos: np.ndarray
    tok: np.ndarray


def places_of(encoder: bpe.Transducer, lengths: np.ndarray, sections: list[Section]) -> Iterator[Places]:
    """The places of each section; `lengths`: bytes of each token."""
    texts = [s.text + s.after for s in sections]
    packed = [encoder.encode_packed(t) for t in texts]
    whole = "".join(texts)
    raw = np.frombuffer(whole.encode("utf-8"), np.uint8)
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    kinds = _marks(points)
    level = np.append(strengths(points, kinds), np.int8(0))
    at = np.cumsum([0] + [len(t) for t in texts])
    for a, b in zip(at.tolist(), at[1:].tolist()):  # a text that begins so that what stands before it would count
        if 0 < a < b and points[a] in _OPENERS:
            level[a:b] = strengths(points[a:b])
    begins = np.append((raw & 0xC0) != 0x80, True)
    ends = np.cumsum(lengths[np.frombuffer(b"".join(packed), "<i4")])
    (kept,) = np.nonzero(begins[ends])  # tokens after which a character begins
    chars = ends[kept] if len(points) == len(raw) else (np.cumsum(begins, dtype=np.int32) - 1)[ends[kept]]
    quotes = np.setdiff1d(_contractions(whole, points), at)
    if len(quotes):
        kept, chars = (x[~np.isin(chars, quotes)] for x in (kept, chars))
    tokens = np.cumsum([0] + [len(p) // 4 for p in packed])
    off = np.zeros(len(kept), dtype=np.int64)
    # Of a run of blanks before a word, the last is split off in the text but not where a piece ends after the run.
    space = kinds & _IS_SPACE > 0
    (stops,) = np.nonzero(space[:-2] & space[1:-1] & ~space[2:]) if len(points) > 2 else (np.zeros(0, np.int64),)
    if len(stops):
        stops = stops + 2
        (solid,) = np.nonzero(~space)
        before = np.searchsorted(solid, stops) - 1
        first_of = at[np.searchsorted(at, stops, side="right") - 1]
        starts = np.maximum(np.where(before >= 0, solid[np.maximum(before, 0)] + 1, 0), first_of)
        to, since = np.searchsorted(chars, stops), np.searchsorted(chars, starts)
        for stop, start, text_start, j, k in zip(stops.tolist(), starts.tolist(), first_of.tolist(), to.tolist(), since.tolist()):
            if start < stop and j < len(kept) and chars[j] == stop:
                # A run that opens a text begins with the text's first token.
                first = kept[k] + 1 if start > text_start and k < len(kept) and chars[k] == start else tokens[np.searchsorted(at, start)]
                off[j] = min(0, encoder.count(whole[start:stop]) - int(kept[j] + 1 - first))
    where = np.searchsorted(kept, tokens)
    zero = np.zeros(1, dtype=np.int64)
    for k, s in enumerate(sections):
        a, b = where[k], where[k + 1]
        pos = chars[a:b] - at[k]
        if s.after:
            b = a + np.searchsorted(pos, len(s.text), side="right")
            pos = pos[: b - a]
        yield Places(*(np.concatenate([zero, x]) for x in (pos, kept[a:b] + 1 - tokens[k], level[chars[a:b]], off[a:b])))


def _contractions(whole: str, points: np.ndarray) -> np.ndarray:
    """Apostrophes inside a word that a piece beginning there would take for a contraction."""
    (at,) = np.nonzero((points[1:-1] == _APOSTROPHE) & np.isin(points[2:], _CONTRACTED)) if len(points) > 2 else (np.zeros(0, np.int64),)
    return np.array([k + 1 for k in at.tolist() if not _ENDS_WORD.match(whole, k)], dtype=np.int64)


def tail_of(section: Section, places: Places, overlap: int) -> Tail:
    """The places of the last `overlap` tokens, and the one before."""
    k = int(np.searchsorted(places.tok, places.tok[-1] - overlap, side="right")) - 1
    k = max(k, 0)
    return Tail(section.text[int(places.pos[k]) :], places.pos[k:] - places.pos[k], places.tok[k:] - places.tok[k])


class Pieces:
    """Columns of pieces: which text, limit, number, first and last character, tokens, shared tokens, text."""

    KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())

    def __init__(self):
        self.columns: list[list] = [[] for _ in self.KINDS]

    def add(self, row: int, section: Section, places: Places, tail: Tail | None, alone: bool, limits: list[Limit], numbers: dict[Limit, int]) -> None:
        """The pieces of a section for each limit. `alone`: it is the whole text; `numbers`: pieces so far of each limit, which are raised."""
        total = int(places.tok[-1])
        limits = [x for x in limits if total > x.most or not alone]
        if not limits:
            return
        text, pos, tok, lev, off, end, begin = section.text, places.pos, places.tok, places.lev, places.off, 0, section.start
        if tail is not None:
            end, begin = len(tail.pos) - 1, section.start - len(tail.text)
            text = tail.text + text
            none = np.zeros(end, dtype=np.int64)
            pos, tok = (np.concatenate([x[:-1], y + x[-1]]) for x, y in ((tail.pos, pos), (tail.tok, tok)))
            lev, off = np.concatenate([none, lev]), np.concatenate([none, off])
        at, sums, offs, marks = _sequence(pos), _sequence(tok), _sequence(off), marks_of(lev)
        for x in limits:
            start = max(0, bisect_right(sums, sums[end] - x.overlap) - 1) if tail is not None else 0
            found = choose(sums, marks, offs, x, start, end)
            if not found:
                continue
            number = numbers.get(x, 0)
            first, last, n, shared = zip(*found)
            starts, stops = [at[k] for k in first], [at[k] for k in last]
            numbers[x] = number + len(found)
            new = (
                [row] * len(found), [x.limit_id] * len(found), range(number, number + len(found)), [k + begin for k in starts] if begin else starts,
                [k + begin for k in stops] if begin else stops, n, shared, [text[a:b] for a, b in zip(starts, stops)],
            )
            for column, values in zip(self.columns, new):
                column += values

    def arrays(self) -> list[pa.Array]:
        return [pa.array(c, kind) for c, kind in zip(self.columns, self.KINDS)]


def _piece_fields() -> list[T.StructField]:
    numbers = [("limit_id", T.IntegerType()), ("piece_no", T.IntegerType()), ("char_start", T.LongType()), ("char_end", T.LongType()), ("n_tokens", T.IntegerType()), ("n_shared", T.IntegerType()), ("piece", T.StringType())]
    return [T.StructField(n, t) for n, t in numbers]


def _token_lengths(tokens: list[bytes]) -> np.ndarray:
    return np.array([len(t) for t in tokens], dtype=np.int64)


def _short_pieces(df: DataFrame, limits: list[Limit], section: int, vocabulary: str | None) -> DataFrame:
    """Pieces of (id, text) by the tasks that read them: no shuffle."""
    path = bpe.vocabulary_path(vocabulary)
    shared = bpe.share_vocabulary(df.sparkSession, path)
    schema = T.StructType([df.schema[0], *_piece_fields()])
    overlap = max(x.overlap for x in limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.worker_encoder(path, shared)
        lengths = _token_lengths(encoder.tokens)
        for batch in batches:
            texts = utf8.texts(batch.column(1))
            for a, b in bpe._sub_batches(texts, 4096, _BATCH_CHARS):
                sections, rows = [], []
                for k in range(a, b):
                    text = texts[k]
                    cuts = [0, *(anchors(text, 0, 0, len(text), section) if len(text) > section else ()), len(text)]
                    rows += [k] * (len(cuts) - 1)
                    sections += [Section(text[x:y], text[y : y + 1], x) for x, y in zip(cuts, cuts[1:])]
                out, tail, numbers = Pieces(), None, {}
                for k, s, places in zip(rows, sections, places_of(encoder, lengths, sections)):
                    if not s.start:
                        tail, numbers = None, {}
                    out.add(k, s, places, tail, not s.start and not s.after, limits, numbers)
                    if s.after:
                        tail = tail_of(s, places, overlap)
                encoder.trim()
                index, *columns = out.arrays()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(index), *columns], names=schema.names)

    return map_arrow(df, run, schema)


_RANGE = ("row", "range_no", "char_start", "before", "body", "after")


def _has_anchor(lo: int, hi: int, section: int) -> bool:
    """Whether an anchor may be in [lo, hi), or its context."""
    return hi + _CONTEXT > section and (hi + _CONTEXT) // section > (lo - HALO_CHARS - 1) // section


def ranges_of(df: DataFrame, range_chars: int, section: int) -> DataFrame:
    """`row`, `range_no`, `char_start`, `before`, `body`, `after` of each text of (id, text), in ranges of `range_chars` characters, and the id.

    `row` tells rows apart, so ids may be null or repeat. The ranges are written once, so that
    `row` stays what it is, and dealt out to tasks. Halos are kept where an anchor may be.
    """
    numbered = df.select(F.monotonically_increasing_id().alias("row"), F.col(df.columns[0]).alias("__id"), F.col(df.columns[1]).alias("__text"))
    texts = [T.StructField(n, T.StringType()) for n in _RANGE[3:]]
    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in _RANGE[:3]), *texts, numbered.schema["__id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(utf8.texts(batch.column(2))):
                at = range(0, len(text), range_chars)
                for lo in range(0, len(at), 64):  # some ranges a batch
                    part, same = at[lo : lo + 64], pa.array([k] * len(at[lo : lo + 64]))
                    halo = [HALO_CHARS if _has_anchor(s, s + range_chars, section) else 0 for s in part]
                    columns = [
                        batch.column(0).take(same), pa.array(range(lo, lo + len(part)), pa.int64()), pa.array(part, pa.int64()),
                        pa.array([text[max(0, s - h) : s] for s, h in zip(part, halo)], pa.string()), pa.array([text[s : s + range_chars] for s in part], pa.string()),
                        pa.array([text[s + range_chars : s + range_chars + max(1, h)] for s, h in zip(part, halo)], pa.string()), batch.column(1).take(same),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    ranges = written(map_arrow(numbered, run, schema))
    return ranges.repartition(task_count(ranges), "row", "range_no")


def file_ranges(spark: SparkSession, path: str, section: int, range_bytes: int = 1 << 20) -> DataFrame:
    """The ranges of UTF-8 text files, as of `ranges_of`, of which no worker reads more than its range and halos.

    `path` may hold a pattern; row and id are the file's path. A range begins with the first
    character that starts in it; empty ranges are left out. Files are listed by name and length,
    their ranges' characters are counted by one pass and summed up, and read by another.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) DIV {range_bytes}"))).alias("range_no"))
    margin = 4 * HALO_CHARS + 4

    def parts(name: str, length: int, no: int, around: int) -> tuple[str, str, str]:
        fs, inner = pafs.FileSystem.from_uri(name)
        start, end = no * range_bytes, min(length, (no + 1) * range_bytes)
        low = max(0, start - around)
        with fs.open_input_file(inner) as f:
            f.seek(low)
            raw = f.read(min(length, end + around) - low)
        edges = []
        for edge in (start - low, end - low):
            while 0 < edge < len(raw) and raw[edge] & 0xC0 == 0x80:
                edge += 1
            edges.append(edge)
        head = 0
        while head < edges[0] and raw[head] & 0xC0 == 0x80:
            head += 1
        before = raw[head : edges[0]].decode("utf-8", "replace")[-HALO_CHARS:]
        after = raw[edges[1] :].decode("utf-8", "ignore" if end + around < length else "replace")[:HALO_CHARS]
        return before, raw[edges[0] : edges[1]].decode("utf-8", "replace"), after

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [len(parts(*r, 4)[1]) for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=["path", "length", "range_no", "n_chars"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, no, char_start in zip(*(c.to_pylist() for c in batch.columns)):
                before, body, after = parts(name, length, no, margin)
                if not body:
                    continue
                if not _has_anchor(char_start, char_start + len(body), section):
                    before, after = "", after[:1]
                yield pa.RecordBatch.from_pydict({"row": [name], "range_no": pa.array([no], pa.int64()), "char_start": pa.array([char_start], pa.int64()), "before": [before], "body": [body], "after": [after], "id": [name]})

    counted = checkpointed(map_arrow(ranges.repartition("path", "range_no"), count, "path string, length long, range_no long, n_chars long"))
    earlier = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    placed = counted.select("path", "length", "range_no", F.coalesce(F.sum("n_chars").over(earlier), F.lit(0)).alias("char_start"))
    schema = "row string, range_no long, char_start long, before string, body string, after string, id string"
    # The rows that tell where ranges are go to the tasks that read them.
    return map_arrow(placed.repartition(task_count(counted), "path", "range_no"), read, schema)


def _portions(ranges: DataFrame, section: int) -> DataFrame:
    """The ranges cut at the anchors in them: `grid` is the number of the anchor that a portion begins with or, if it begins with none, of the last anchor before it, should that exist."""
    row, id_ = ranges.schema[0], ranges.schema[-1]
    fields = [T.StructField("row", row.dataType), *(T.StructField(n, T.LongType()) for n in ("grid", "char_start")), T.StructField("anchored", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("next", T.StringType()), T.StructField("__id", id_.dataType)]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            starts, befores, bodies, afters = (utf8.texts(batch.column(k)) for k in (2, 3, 4, 5))
            for k, (start, before, body, after) in enumerate(zip(starts, befores, bodies, afters)):
                text, end = before + body + after, start + len(body)
                cuts = anchors(text, start - len(before), start, end, section)
                begin = [start, *(c for c in cuts if c > start)]
                for x, y in zip(begin, [*begin[1:], end]):
                    # The anchor of a grid point lies less than a window behind it, so it tells its grid point.
                    anchored = x == 0 or x in cuts
                    grid = x // section if anchored else _last_grid(x, section, text, start - len(before))
                    new = (k, grid, x, anchored, text[x - start + len(before) : y - start + len(before)], text[y - start + len(before) : y - start + len(before) + 1])
                    for column, value in zip(columns, new):
                        column.append(value)
            rows, *rest = columns
            index = pa.array(rows, pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), *(pa.array(c, t) for c, t in zip(rest, kinds)), batch.column(batch.num_columns - 1).take(index)], names=schema.names)

    return map_arrow(ranges, run, schema)


def _last_grid(x: int, section: int, text: str, start: int) -> int:
    """The last grid point whose anchor, if there is one, is not behind `x`."""
    grid = x // section
    if grid and x - grid * section < ANCHOR_CHARS:  # its anchor may lie ahead
        return grid if anchors(text, start, grid * section, x + 1, section) else grid - 1
    return grid


def _few(df: DataFrame, most: int) -> DataFrame:
    """A written table, sent to all workers if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def _stitched(portions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`portions` with `section`, the last grid point that has an anchor: where one is missing, the section before goes on; and the rows of several sections.

    One row a grid point is looked at in order; only missing anchors make a difference.
    """
    grid = portions.groupBy("row", "grid").agg(F.max("anchored").alias("anchored"))
    before = Window.partitionBy("row").orderBy("grid")
    grid = checkpointed(grid.withColumn("section", F.max(F.when(F.col("anchored"), F.col("grid"))).over(before)))
    missing = _few(checkpointed(grid.where("NOT anchored").select("row", "grid", "section")), BROADCAST_ROWS)
    placed = portions.join(missing, ["row", "grid"], "left").withColumn("section", F.coalesce("section", "grid")).drop("grid", "anchored")
    return placed, checkpointed(grid.where("section > 0").select("row").distinct())


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, Section]]:
    """Puts sections together from (row, section, id, char_start, text, next) in order; yields row and id, one each, and the section."""
    key, held = None, None
    for batch in batches:
        for k in range(len(batch)):
            now = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
            if key != now:
                if held is not None:
                    yield held[0], held[1], Section("".join(held[3]), held[4], held[2])
                key, held = now, [batch.column(0).slice(k, 1), batch.column(2).slice(k, 1), batch.column(3)[k].as_py(), [], ""]
            held[3].append(batch.column(4)[k].as_py())
            held[4] = batch.column(5)[k].as_py()
    if held is not None:
        yield held[0], held[1], Section("".join(held[3]), held[4], held[2])


def _in_order(portions: DataFrame) -> DataFrame:
    chosen = portions.select("row", "section", "__id", "char_start", "text", "next")
    return chosen.repartition(task_count(portions), "row", "section").sortWithinPartitions("row", "section", "char_start")


def _pieces_of_whole(portions: DataFrame, limits: list[Limit], vocabulary: str | None) -> DataFrame:
    """Pieces of texts that are one section."""
    path = bpe.vocabulary_path(vocabulary)
    shared = bpe.share_vocabulary(portions.sparkSession, path)
    schema = T.StructType([portions.schema["__id"], *_piece_fields()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.worker_encoder(path, shared)
        lengths = _token_lengths(encoder.tokens)
        for _, id_, s in _whole(batches):
            (p,) = places_of(encoder, lengths, [s])
            encoder.trim()
            out = Pieces()
            out.add(0, s, p, None, True, limits, {})
            index, *columns = out.arrays()
            yield pa.RecordBatch.from_arrays([id_.take(index), *columns], names=schema.names)

    return map_arrow(_in_order(portions), run, schema)


_WIDTHS = (np.dtype("u1"), np.dtype("<u2"), np.dtype("<u4"))


def packed(places: Places) -> bytes:
    """Places as steps from one to the next, each column with the fewest bytes that hold it."""
    out = []
    for column in (np.diff(places.pos, prepend=0), np.diff(places.tok, prepend=0), places.lev, -places.off):
        width = next(k for k, dtype in enumerate(_WIDTHS) if int(column.max()) <= np.iinfo(dtype).max)
        out.append(bytes([width]) + column.astype(_WIDTHS[width]).tobytes())
    return len(places.pos).to_bytes(4, "little") + b"".join(out)


def unpacked(raw: bytes) -> Places:
    n, at, columns = int.from_bytes(raw[:4], "little"), 4, []
    for _ in range(4):
        dtype = _WIDTHS[raw[at]]
        columns.append(np.frombuffer(raw, dtype, n, at + 1).astype(np.int64))
        at += 1 + n * dtype.itemsize
    return Places(np.cumsum(columns[0]), np.cumsum(columns[1]), columns[2], -columns[3])


def _encoded(portions: DataFrame, limits: list[Limit], vocabulary: str | None) -> DataFrame:
    """Each section with its places, and the tail that the section after it needs."""
    path = bpe.vocabulary_path(vocabulary)
    shared = bpe.share_vocabulary(portions.sparkSession, path)
    overlap = max(x.overlap for x in limits)
    numbers = T.ArrayType(T.IntegerType())
    columns = [("text", T.StringType()), ("after", T.StringType()), ("places", T.BinaryType()), ("tail_text", T.StringType()), ("tail_pos", numbers), ("tail_tok", numbers)]
    schema = T.StructType([portions.schema["row"], portions.schema["__id"], T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), *(T.StructField(n, t) for n, t in columns)])

    def ints(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.worker_encoder(path, shared)
        lengths = _token_lengths(encoder.tokens)
        for row, id_, s in _whole(batches):
            (p,) = places_of(encoder, lengths, [s])
            encoder.trim()
            t = tail_of(s, p, overlap)
            place = [pa.array([s.start], pa.int64()), pa.array([s.start + len(s.text)], pa.int64()), pa.array([s.text]), pa.array([s.after])]
            yield pa.RecordBatch.from_arrays([row, id_, *place, pa.array([packed(p)], pa.binary()), pa.array([t.text]), ints(t.pos), ints(t.tok)], names=schema.names)

    return map_arrow(_in_order(portions), run, schema)


def _section_pieces(encoded: DataFrame, limits: list[Limit]) -> DataFrame:
    """Pieces of texts of several sections: counted first by section, then numbered and emitted."""
    tails = encoded.where("after <> ''").select("row", F.col("stop").alias("start"), F.col("tail_text").alias("t_text"), F.col("tail_pos").alias("t_pos"), F.col("tail_tok").alias("t_tok"))
    tails = _few(tails, BROADCAST_TAILS)
    both = encoded.drop("tail_text", "tail_pos", "tail_tok", "stop").join(tails, ["row", "start"], "left")

    def found(batch: pa.RecordBatch, k: int, text: str, numbers: dict) -> Pieces:
        numbers_of = lambda name: batch.column(name)[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
        tail = Tail(batch.column("t_text")[k].as_py(), numbers_of("t_pos"), numbers_of("t_tok")) if batch.column("t_tok")[k].is_valid else None
        out = Pieces()
        out.add(k, Section(text, "", batch.column("start")[k].as_py()), unpacked(batch.column("places")[k].as_py()), tail, False, limits, numbers)
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for k in range(len(batch)):
                numbers: dict[Limit, int] = {}
                found(batch, k, "", numbers)
                lists.append([numbers.get(x, 0) for x in limits])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("start"), pa.array(lists, pa.list_(pa.int64()))], names=["row", "start", "n"])

    row = both.schema["row"]
    counts = map_arrow(both.select("row", "start", "places", F.lit("").alias("t_text"), "t_pos", "t_tok"), count, T.StructType([row, T.StructField("start", T.LongType()), T.StructField("n", T.ArrayType(T.LongType()))]))
    earlier = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a section
    base = F.array(*[F.coalesce(F.sum(F.col("n")[k]).over(earlier), F.lit(0)) for k in range(len(limits))])
    bases = _few(checkpointed(counts.select("row", "start", base.alias("base"))), BROADCAST_TAILS)
    schema = T.StructType([both.schema["__id"], *_piece_fields()])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                out = found(batch, k, batch.column("text")[k].as_py(), dict(zip(limits, batch.column("base")[k].as_py())))
                index, *columns = out.arrays()
                yield pa.RecordBatch.from_arrays([batch.column("__id").take(index), *columns], names=schema.names)

    return map_arrow(both.join(bases, ["row", "start"]), emit, schema)


def pieces_of_ranges(ranges: DataFrame, limits: list[Limit] | list[tuple[int, int, int]], vocabulary: str | None = None, section: int | None = None) -> DataFrame:
    """Pieces of texts given as ranges (of `ranges_of` or `file_ranges`) with the same `section`, under the name `id`."""
    limits = limits_of(limits)
    portions, several = _stitched(written(_portions(ranges, section or section_of(limits, vocabulary))))
    n = several.count()
    several = F.broadcast(several) if n <= BROADCAST_ROWS else several
    pieces = _pieces_of_whole(portions.join(several, "row", "left_anti") if n else portions, limits, vocabulary)
    if n:
        pieces = pieces.unionByName(_section_pieces(written(_encoded(portions.join(several, "row", "left_semi"), limits, vocabulary)), limits))
    return pieces.withColumnRenamed("__id", "id")


def section_of(limits: list[Limit], vocabulary: str | None = None) -> int:
    """The size of sections for some limits and a vocabulary."""
    return section_size(limits, max(map(len, bpe.load_vocabulary(bpe.vocabulary_path(vocabulary)).tokens)))


def limits_of(limits: DataFrame | list) -> list[Limit]:
    """The rows of a table of limits, which is a setting of some rows. Repeated rows count once, a null overlap is 0; one id for two limits is an error."""
    rows = limits if isinstance(limits, list) else limits.select("limit_id", "max_tokens", "overlap_tokens").collect()
    found = list(dict.fromkeys(x if isinstance(x, Limit) else Limit(x[0], x[1], x[2] or 0) for x in rows if isinstance(x, Limit) or x[1] is not None))
    if len({x.limit_id for x in found}) < len(found):
        raise ValueError("two limits have one id")
    return found


def split_texts(df: DataFrame, limits: DataFrame | list[tuple[int, int, int]], id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, range_chars: int = RANGE_CHARS, section: int | None = None) -> DataFrame:
    """`id_col`, `limit_id`, `piece_no`, `char_start`, `char_end`, `n_tokens`, `n_shared`, `piece` of every text above a limit.

    Ids may be null or repeat: every row is cut for itself. `range_chars` only says which texts are
    spread over tasks; the pieces are the same for any.
    """
    limits = limits_of(limits)
    texts = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([df.schema[id_col], *_piece_fields()])
    if not limits:
        return df.sparkSession.createDataFrame([], schema)
    section = section or section_of(limits, vocabulary)
    # A text has no more tokens than bytes, where its bytes are sound.
    texts = texts.where((F.octet_length("__text") > min(x.most for x in limits)) | ~F.is_valid_utf8("__text"))
    short = _short_pieces(texts.where(F.length("__text") <= range_chars), limits, section, vocabulary)
    long = ranges_of(texts.where(F.length("__text") > range_chars), range_chars, section)
    if long.isEmpty():
        return short
    return short.unionByName(pieces_of_ranges(long, limits, vocabulary, section).withColumnRenamed("id", id_col))
