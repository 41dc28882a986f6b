"""Reader and writer of binary CRF model files (version 100), as tables that the engine uses."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from hanweave.operators.analyze import bounded_rows

VERSION = 100


@dataclass
class CrfFile:
    tags: list[str]
    templates: list[str]
    features: dict[str, int]
    weights: np.ndarray

    def rows(self):
        """(feature, left_tag, tag, weight): left_tag is None for features of unigram templates."""
        n = len(self.tags)
        for feature, at in self.features.items():
            if feature[0] == "B":
                for k, w in enumerate(self.weights[at : at + n * n].tolist()):
                    yield feature, self.tags[k // n], self.tags[k % n], w
            else:
                for k, w in enumerate(self.weights[at : at + n].tolist()):
                    yield feature, None, self.tags[k], w

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "feature string, left_tag string, tag string, weight double")


def trie_items(raw: bytes) -> dict[bytes, int]:
    """Keys and values of a double-array trie of (base, check) units.

    A unit belongs to the node whose base is its check; its distance from there is the next
    byte plus one, or nothing for the node's own value, kept as -1 - value.
    """
    units = np.frombuffer(raw, dtype=[("base", "<i4"), ("check", "<u4")])
    base, check = units["base"].astype(np.int64), units["check"].astype(np.int64)
    places = np.arange(len(units))
    step = places - check
    kept = (places > 0) & (check > 0) & (step >= 0) & (step <= 256)
    children: dict[int, list[int]] = {}
    for p in places[kept].tolist():
        children.setdefault(int(check[p]), []).append(p)
    out, stack = {}, [(int(base[0]), b"")] if len(units) else []
    while stack:
        node, key = stack.pop()
        for p in children.get(node, ()):
            if p == node:
                if base[p] < 0:
                    out[key] = int(-base[p] - 1)
            else:
                stack.append((int(base[p]), key + bytes([p - node - 1])))
    return out


def trie_units(items: dict[bytes, int]) -> bytes:
    """The double-array trie of some keys, none empty and without zero bytes, as `trie_items` reads it."""
    base, check, bases, free = {0: 0}, {0: 0}, set(), 1
    waiting = [(0, sorted(items.items()), 0)]  # a unit, its keys and how much of them is spelled there
    while waiting:
        unit, keys, depth = waiting.pop()
        groups: dict[int, list] = {}
        for key in keys:
            groups.setdefault(key[0][depth] + 1 if len(key[0]) > depth else 0, []).append(key)
        least = min(groups)
        while free in check:
            free += 1
        at = max(1, free - least)
        while at in bases or any(at + step in check for step in groups):
            at += 1
        bases.add(at)
        base[unit] = at
        for step, group in groups.items():
            check[at + step] = at
            if step:
                waiting.append((at + step, group, depth + 1))
            else:
                base[at] = -1 - group[0][1]
    units = np.zeros(max(check) + 1, dtype=[("base", "<i4"), ("check", "<u4")])
    for p, c in check.items():
        units[p] = (base[p], c)
    return units.tobytes()


def crf_bytes(tags: list[str], templates: list[str], rows: list[tuple[str, str | None, str, float]]) -> bytes:
    """The model file of rows (feature, left_tag, tag, weight); weights not given are 0. Its size is the model's."""
    n, at = len(tags), {t: k for k, t in enumerate(tags)}
    first, size = {}, 0
    for name in sorted({r[0] for r in rows}):
        first[name] = size
        size += n * n if name[0] == "B" else n
    weights = np.zeros(size, dtype="<f4")
    for name, left, tag, weight in rows:
        weights[first[name] + (at[tag] if left is None else at[left] * n + at[tag])] = weight
    units = trie_units({k.encode(): v for k, v in first.items()}) if first else b""
    texts = [b"".join(t.encode() + b"\0" for t in part) for part in (tags, templates)]
    head = struct.pack("<iidiii", VERSION, 0, 1.0, size, 1, len(units))
    return head + b"".join(struct.pack("<i", len(t)) + t for t in texts) + units + weights.tobytes()


def write_crf(spark: SparkSession, path: str, tags: list[str], templates: list[str], features: DataFrame) -> None:
    """A table (feature, left_tag, tag, weight) as one model file, on any file system that Spark writes."""
    rows = list(bounded_rows(features.select("feature", "left_tag", "tag", "weight")))
    write_bytes(spark, path, crf_bytes(tags, templates, rows))


def write_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    """One new file on any file system that Spark writes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    try:
        out.write(raw)
    finally:
        out.close()


def parse_crf(raw: bytes) -> CrfFile:
    """Raises ValueError if the bytes are no whole model of the known version."""
    try:
        version, _, _, n_weights, _, trie_size = struct.unpack_from("<iidiii", raw, 0)
        if version != VERSION:
            raise ValueError(f"version {version} instead of {VERSION}")
        at, texts = struct.calcsize("<iidiii"), []
        for _ in range(2):
            (size,) = struct.unpack_from("<i", raw, at)
            texts.append([t.decode() for t in raw[at + 4 : at + 4 + size].split(b"\0") if t])
            at += 4 + size
        features = {k.decode("utf-8", "replace"): v for k, v in trie_items(raw[at : at + trie_size]).items()}
        at += trie_size
        weights = np.frombuffer(raw, "<f4", n_weights, at)
        if at + 4 * n_weights != len(raw):
            raise ValueError("bytes after the weights")
    except (struct.error, UnicodeDecodeError) as error:
        raise ValueError(f"not a CRF model: {error}") from error
    if any(t[0] not in "UB" for t in texts[1]):
        raise ValueError("a template that begins with neither U nor B")
    return CrfFile(texts[0], texts[1], features, weights)


def read_crf(spark: SparkSession, path: str) -> CrfFile:
    """One model file from any file system that Spark reads."""
    rows = spark.read.format("binaryFile").load(path).select("content").limit(1).collect()
    if not rows:
        raise FileNotFoundError(path)
    return parse_crf(bytes(rows[0][0]))
