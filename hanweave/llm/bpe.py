"""Byte-level BPE encoding of a corpus by a lazily determinised transducer.

How it works
------------
A sequence of tokens is the BPE encoding of a text exactly when each token encodes to
itself and no merge crosses the border of two neighbours. So reading a text left to
right is a nondeterministic transducer: a branch is (what the last whole token can still
merge with, bytes of the token under way), and where several branches are alive the
tokens on which they differ are held back. `_State` is a *set* of such branches: the
determinised state. Its transitions are built when a character is first met there and
kept, so the common case is one dictionary lookup a character. A branch dies when its
bytes start no token, so output lags by at most the longest token.

Tokens leave the transducer packed as little-endian int32, so a document is one
``bytes.join`` and its ids reach Arrow without a Python integer being made.

Defined results: a null and an empty text both give an empty list of ids, never null. Bytes that
are no UTF-8 are encoded as U+FFFD, one for each broken character.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanweave.functions import utf8
from hanweave.session import map_arrow

# The split pattern published with the byte-level vocabularies.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bounds of a worker's memory: kept transitions, kept short words, characters of a kept word.
MAX_TRANSITIONS = 400_000
MAX_WORDS = 200_000
MAX_WORD_CHARS = 24
#: Rows and bytes of text turned into one outgoing Arrow batch.
ROWS_OUT = 1024
BYTES_OUT = 1 << 22


def vocabulary_path(path: str | None = None) -> str:
    """`path`, or the default vocabulary of HANWEAVE_TOKENIZERS or /opt/tokenizers."""
    return path or os.path.join(os.environ.get("HANWEAVE_TOKENIZERS", "/opt/tokenizers"), DEFAULT_VOCABULARY)


class Vocabulary:
    """Token bytes by id, and the merge table derived from them. Its size is the vocabulary's, whatever the corpus."""

    def __init__(self, tokens: list[bytes], pairs: np.ndarray):
        self.tokens, self.pairs = tokens, pairs

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            tokens[i] = token
        # A token's two halves are what is left when its own bytes are merged by lower ranks only.
        pairs = np.full((len(tokens), 2), -1, dtype=np.int32)
        for token, i in ids.items():
            if len(token) > 1:
                parts = [ids[token[k : k + 1]] for k in range(len(token))]
                while len(parts) > 2:
                    ranks = [ids.get(tokens[a] + tokens[b], i) for a, b in zip(parts, parts[1:])]
                    low = min(ranks)
                    if low >= i:
                        break
                    k = ranks.index(low)
                    parts[k : k + 2] = [low]
                if len(parts) == 2:
                    pairs[i] = parts
        return cls(tokens, pairs)


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)


class _State(dict):
    """Determinised state: character -> (packed tokens that are now certain, next state)."""

    __slots__ = ("branches", "final", "machine")

    def __missing__(self, ch: str):
        return self.machine.expand(self, ch)


class _Words(dict):
    """Pre-token -> packed ids, as the transducer gives them; short ones are kept."""

    __slots__ = ("machine",)

    def __missing__(self, word: str) -> bytes:
        state, out = self.machine.start, []
        for ch in word:
            emitted, state = state[ch]
            if emitted:
                out.append(emitted)
        out.append(state.final)
        packed = b"".join(out)
        if len(word) <= MAX_WORD_CHARS:
            self[word] = packed
        return packed


class Transducer:
    """Encoder for one vocabulary; lives in a worker and grows by what it meets, up to MAX_TRANSITIONS."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = SPLIT_PATTERN):
        self.tokens = vocabulary.tokens
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        self.pairs = vocabulary.pairs.tolist()
        self.merged, self.first_merge = {}, {}
        whole = set()
        for i, (a, b) in enumerate(self.pairs):
            if a >= 0:
                self.merged[a, b] = i
                self.first_merge[a] = min(i, self.first_merge.get(a, i))
                whole.add(i)
            elif len(self.tokens[i]) == 1:
                whole.add(i)
        self.whole = whole  # tokens that encode to themselves
        self.starts = {t[:k] for t in self.ids for k in range(1, len(t))}
        self.right, self.left, self.fits, self.states = {}, {}, {}, {}
        self.split = regex.compile(pattern).findall
        self.words = _Words()
        self.words.machine = self
        self.reset()

    def reset(self) -> None:
        for state in self.states.values():
            state.clear()
        self.states.clear()
        self.fits.clear()
        self.words.clear()
        self.kept = 0
        self.start = self._intern(((), (), b""))

    # Edges of a token: its outermost parts from byte to whole, each with the rank at which a merge inside the token takes it.
    def _right_edge(self, token: int) -> tuple:
        if token not in self.right:
            chain_, t, taken = [], token, 1 << 30
            while t >= 0:
                if self.first_merge.get(t, 1 << 30) < taken:
                    chain_.append((t, taken))
                t, taken = self.pairs[t][1], t
            self.right[token] = tuple(chain_)
        return self.right[token]

    def _left_edge(self, token: int) -> list:
        if token not in self.left:
            chain_, t, taken = [], token, 1 << 30
            while t >= 0:
                chain_.append((t, taken))
                t, taken = self.pairs[t][0], t
            self.left[token] = chain_
        return self.left[token]

    def _fit(self, edge: tuple, token: int) -> bool:
        """No merge crosses the border between a token with this right edge and `token`. Equal ranks go to the left pair."""
        key = edge, token
        if key not in self.fits:
            merged = self.merged
            self.fits[key] = not any(
                (rank := merged.get((a, b))) is not None and rank < a_taken and rank <= b_taken
                for a, a_taken in edge
                for b, b_taken in self._left_edge(token)
            )
        return self.fits[key]

    def _intern(self, *branches: tuple) -> _State:
        state = self.states.get(branches)
        if state is None:
            state = self.states[branches] = _State()
            state.machine, state.branches = self, branches
            # The branch with nothing under way holds the encoding of the text so far.
            state.final = b"".join(i.to_bytes(4, "little") for held, _, under in branches if not under for i in held)
        return state

    def expand(self, state: _State, ch: str) -> tuple[bytes, _State]:
        branches = state.branches
        for byte in ch.encode("utf-8", "surrogatepass"):
            new = []
            for held, edge, under in branches:
                grown = under + bytes((byte,))
                if grown in self.starts:
                    new.append((held, edge, grown))
                token = self.ids.get(grown)
                if token is not None and token in self.whole and self._fit(edge, token):
                    new.append(((*held, token), self._right_edge(token), b""))
            branches = new
        if len(branches) == 1:
            common = len(branches[0][0])
        else:
            low, high = min(b[0] for b in branches), max(b[0] for b in branches)
            common = next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        emitted = b"".join(i.to_bytes(4, "little") for i in branches[0][0][:common])
        result = emitted, self._intern(*((held[common:], edge, under) for held, edge, under in branches))
        state[ch] = result
        self.kept += 1
        return result

    def trim(self) -> None:
        """Keeps the worker's memory bounded; to be called between batches or long texts."""
        if self.kept > MAX_TRANSITIONS:
            self.reset()
        elif len(self.words) > MAX_WORDS:
            self.words.clear()

    def encode_packed(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<i4").tolist()

    def count(self, text: str) -> int:
        return sum(map(len, map(self.words.__getitem__, self.split(text)))) // 4

    def prefix_counts(self, word: str) -> list[int]:
        """Tokens of each prefix of one pre-token, had it ended there; by character."""
        state, n, out = self.start, 0, []
        for ch in word:
            emitted, state = state[ch]
            n += len(emitted) // 4
            out.append(n + len(state.final) // 4)
        return out


_ENCODERS: dict[str, Transducer] = {}


def worker_encoder(path: str, shared) -> Transducer:
    """The encoder of this Python worker; `shared` is the broadcast (tokens, pairs) of the vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Transducer(Vocabulary(*shared.value))
    return _ENCODERS[path]


def share_vocabulary(spark: SparkSession, path: str):
    """Broadcasts a vocabulary (some 1 MB, fixed by its file)."""
    v = load_vocabulary(path)
    return spark.sparkContext.broadcast((v.tokens, v.pairs))


class Utf8Machine:
    """Incremental UTF-8 decoder: keeps an unfinished character between calls; broken bytes become U+FFFD."""

    # Lead bytes with their number of followers and the range of the first follower.
    LEADS = (
        (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F),
        (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F),
    )
    NEXT = {b: (n, lo, hi) for first, last, n, lo, hi in LEADS for b in range(first, last + 1)}

    def __init__(self):
        self.kept, self.need, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out, k = [], 0
        if not self.need:
            try:
                return data.decode("utf-8")
            except UnicodeDecodeError as error:  # all before the place is sound
                out.append(data[: error.start].decode("utf-8"))
                k = error.start
        while k < len(data):
            byte = data[k]
            if self.need:
                if self.low <= byte <= self.high:
                    self.kept.append(byte)
                    self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                    k += 1
                    if not self.need:
                        out.append(self.kept.decode("utf-8"))
                        self.kept.clear()
                else:
                    out.append(self.end())
            else:
                k += 1
                if byte < 0x80:
                    out.append(chr(byte))
                elif byte in self.NEXT:
                    self.need, self.low, self.high = self.NEXT[byte]
                    self.kept.append(byte)
                else:
                    out.append("�")
        return "".join(out)

    def end(self) -> str:
        open_, self.need, self.low, self.high = bool(self.kept), 0, 0x80, 0xBF
        self.kept.clear()
        return "�" if open_ else ""


def decode_stream(tokens: list[bytes], ids: Iterator[int], block: int = 4096) -> Iterator[str]:
    """Text of a stream of ids, block by block; characters split over tokens or blocks stay whole."""
    machine, ids = Utf8Machine(), iter(ids)
    while part := list(islice(ids, block)):
        yield machine.feed(b"".join(map(tokens.__getitem__, part)))
    yield machine.end()


def _sub_batches(texts: list, rows: int = ROWS_OUT, size: int = BYTES_OUT):
    start, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if k - start + 1 >= rows or held >= size:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """`id_col`, `ids array<int>` of every row: no shuffle, other columns of `df` are neither read nor returned.

    Null and empty texts give an empty list; repeated ids and a null id stay as they are.
    """
    path = vocabulary_path(vocabulary)
    shared = share_vocabulary(df.sparkSession, path)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, shared)
        for batch in batches:
            texts = utf8.texts(batch.column(1))
            for a, b in _sub_batches(texts):
                packed = [encoder.encode_packed(t) if t else b"" for t in texts[a:b]]
                offsets = np.zeros(b - a + 1, dtype=np.int32)
                np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
                ids = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=[id_col, "ids"])
                encoder.trim()

    return map_arrow(df.select(F.col(id_col), F.col(text_col)), run, schema)


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str | None = None, name: str = "n_tokens") -> DataFrame:
    """The columns `keep` and the number of tokens of `text_col` (0 for null and empty)."""
    path = vocabulary_path(vocabulary)
    shared = share_vocabulary(df.sparkSession, path)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, shared)
        for batch in batches:
            texts = utf8.texts(batch.column(batch.num_columns - 1))
            counts = []
            for t in texts:
                counts.append(encoder.count(t) if t else 0)
                encoder.trim()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int32())], names=[*keep, name])

    return map_arrow(df.select(*keep, F.col(text_col).alias("__text")), run, schema)


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """`id_col`, `text`: the inverse of `encode_corpus`; null and empty lists give the empty text."""
    path = vocabulary_path(vocabulary)
    shared = share_vocabulary(df.sparkSession, path)
    schema = T.StructType([df.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value[0]
        for batch in batches:
            column = batch.column(1)
            texts = ["".join(decode_stream(tokens, column[k].as_py() or ())) for k in range(len(column))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return map_arrow(df.select(id_col, ids_col), run, schema)
