"""Readers and writers of the binary model files besides the CRF's: tag model, classifier, pair table, trie and array.

All numbers are little-endian. A file's size is its model's, so it is parsed as a whole; what is
malformed raises ValueError. Tables have the columns of a model folder.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from hanweave.sources.crf_binary import trie_items, trie_units

# First numbers of the files, bytes of a tag's and of a class's name.
TAG_MODEL, CLASSIFIER, PAIRS = 0x3322, 0x2233, 0x3321
TAG_BYTES, CLASS_BYTES = 16, 64
_EMISSION = np.dtype([("term_id", "<i4"), ("tag", "<i4"), ("cost", "<f4")])
_PAIR = np.dtype([("position", "<i4"), ("key", "<i8"), ("cost", "<f4")])


class _Reader:
    """Takes bytes in order and tells if there are too few or too many."""

    def __init__(self, raw: bytes, magic: int):
        self.raw, self.at = raw, 0
        if self.number() != magic:
            raise ValueError("another kind of file")

    def take(self, size: int) -> bytes:
        if size < 0 or self.at + size > len(self.raw):
            raise ValueError("the file ends too early")
        self.at += size
        return self.raw[self.at - size : self.at]

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]

    def array(self, dtype, n: int) -> np.ndarray:
        return np.frombuffer(self.take(np.dtype(dtype).itemsize * n), dtype)

    def names(self, n: int, size: int) -> list[str]:
        return [self.take(size).split(b"\0")[0].decode() for _ in range(n)]

    def end(self) -> None:
        if self.at != len(self.raw):
            raise ValueError("bytes after the end")


def _name(text: str, size: int) -> bytes:
    raw = text.encode()
    if len(raw) >= size:
        raise ValueError(f"{text!r} is longer than {size - 1} bytes")
    return raw.ljust(size, b"\0")


def parse_tag_model(raw: bytes) -> tuple[list, list, list]:
    """Rows of tags (tag, cost), transitions (tag1, tag2, tag3, cost) and emissions (tag, term_id, cost)."""
    r = _Reader(raw, TAG_MODEL)
    n, _, n_emits = r.number(), r.number(), r.number()
    names = r.names(n, TAG_BYTES)
    costs, moves, emits = r.array("<f4", n).tolist(), r.array("<f4", n**3), r.array(_EMISSION, n_emits)
    r.end()
    if len(emits) and not 0 <= emits["tag"].min() <= emits["tag"].max() < n:
        raise ValueError("an emission of an unknown tag")
    trans = [(names[k // n // n], names[k // n % n], names[k % n], c) for k, c in enumerate(moves.tolist())]
    return list(zip(names, costs)), trans, [(names[t], i, c) for i, t, c in emits.tolist()]


def tag_model_bytes(tags: Iterable, transitions: Iterable, emissions: Iterable, unseen: float = 1e6) -> bytes:
    """The inverse of `parse_tag_model`; triples that are not given cost `unseen`."""
    tags = [tuple(t) for t in tags]
    at, n = {t: k for k, (t, _) in enumerate(tags)}, len(tags)
    moves = np.full(n**3, unseen, dtype="<f4")
    for a, b, c, cost in transitions:
        moves[(at[a] * n + at[b]) * n + at[c]] = cost
    emits = np.array([(i, at[t], c) for t, i, c in emissions], dtype=_EMISSION)
    head = struct.pack("<4i", TAG_MODEL, n, int(emits["term_id"].max()) if len(emits) else 0, len(emits))
    return head + b"".join(_name(t, TAG_BYTES) for t, _ in tags) + np.array([c for _, c in tags], dtype="<f4").tobytes() + moves.tobytes() + emits.tobytes()


def parse_classifier(raw: bytes) -> list[tuple[str, str, float]]:
    """Rows (y, feature, weight) of all classes and features."""
    r = _Reader(raw, CLASSIFIER)
    n_features, n_classes = r.number(), r.number()
    classes = r.names(n_classes, CLASS_BYTES)
    features = trie_items(r.take(r.number()))
    weights = r.array("<f4", n_features * n_classes).reshape(n_features, n_classes)
    r.end()
    return [(y, f.decode(), w) for f, k in features.items() for y, w in zip(classes, weights[k].tolist())]


def classifier_bytes(rows: Iterable) -> bytes:
    """The inverse of `parse_classifier`; weights that are not given are 0."""
    rows = [tuple(r) for r in rows]
    classes, features = sorted({r[0] for r in rows}), {f: k for k, f in enumerate(sorted({r[1] for r in rows}))}
    weights = np.zeros((len(features), len(classes)), dtype="<f4")
    for y, f, w in rows:
        weights[features[f], classes.index(y)] = w
    units = trie_units({f.encode(): k for f, k in features.items()}) if features else b""
    return struct.pack("<3i", CLASSIFIER, len(features), len(classes)) + b"".join(_name(y, CLASS_BYTES) for y in classes) + struct.pack("<i", len(units)) + units + weights.tobytes()


def parse_pairs(raw: bytes) -> list[tuple[int, int, float]]:
    """Rows (left_id, right_id, cost) of a stored hash table; where a row was in it does not matter here."""
    r = _Reader(raw, PAIRS)
    _, n, size = r.number(), r.number(), r.number()
    if size != _PAIR.itemsize:
        raise ValueError(f"rows of {size} bytes")
    rows = r.array(_PAIR, n)
    r.end()
    return list(zip((rows["key"] >> 32).tolist(), (rows["key"] & 0xFFFFFFFF).tolist(), rows["cost"].tolist()))


def parse_trie(raw: bytes) -> list[tuple[str, int]]:
    """Rows (word, number) of a stored trie."""
    if len(raw) % 8:
        raise ValueError("no whole number of units")
    return [(w.decode(), k) for w, k in trie_items(raw).items()]


def parse_costs(raw: bytes) -> list[tuple[int, float]]:
    """Rows (term_id, cost) of a stored array, whose first place is the id 0."""
    if len(raw) % 4:
        raise ValueError("no whole number of costs")
    return list(enumerate(np.frombuffer(raw, "<f4").tolist()))


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """One file from any file system that Spark reads."""
    rows = spark.read.format("binaryFile").load(path).select("content").limit(1).collect()
    if not rows:
        raise FileNotFoundError(path)
    return bytes(rows[0][0])


def read_dictionary(spark: SparkSession, trie: str, costs: str) -> DataFrame:
    """`word`, `term_id`, `cost` of a trie of words and the array of their costs."""
    by_id = dict(parse_costs(read_bytes(spark, costs)))
    rows = [(w, k, by_id[k]) for w, k in parse_trie(read_bytes(spark, trie)) if k in by_id]
    return spark.createDataFrame(rows, "word string, term_id int, cost float")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(parse_pairs(read_bytes(spark, path)), "left_id int, right_id int, cost float")


def read_tag_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    schemas = "tag string, cost float", "tag1 string, tag2 string, tag3 string, cost float", "tag string, term_id int, cost float"
    return tuple(spark.createDataFrame(rows, s) for rows, s in zip(parse_tag_model(read_bytes(spark, path)), schemas))


def read_classifier(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(parse_classifier(read_bytes(spark, path)), "y string, feature string, weight float")
