import struct

import numpy as np
import pytest

from hanweave.sources import binary_models as bm
from hanweave.sources.crf_binary import trie_units, write_bytes

TAGS = [("BOS", 1.0), ("NN", 0.5)]
EMITS = [("NN", 3, 2.5), ("BOS", 1, 0.25)]


def test_tag_model():
    raw = bm.tag_model_bytes(TAGS, [("BOS", "BOS", "NN", 0.75)], EMITS)
    tags, trans, emits = bm.parse_tag_model(raw)
    assert tags == TAGS and emits == EMITS and len(trans) == 8
    assert dict((t[:3], t[3]) for t in trans)["BOS", "BOS", "NN"] == 0.75
    assert bm.parse_tag_model(bm.tag_model_bytes([], [], [])) == ([], [], [])
    # Field by field: kind, tags, largest id, emissions, names, costs, moves, records.
    assert raw == struct.pack("<4i", 0x3322, 2, 3, 2) + b"BOS".ljust(16, b"\0") + b"NN".ljust(16, b"\0") + struct.pack("<2f", 1, 0.5) + struct.pack("<8f", 1e6, 0.75, *[1e6] * 6) + struct.pack("<iifiif", 3, 1, 2.5, 1, 0, 0.25)
    for bad in (raw[:-1], raw + b"x", b"\0" + raw[1:], b""):
        with pytest.raises(ValueError):
            bm.parse_tag_model(bad)
    with pytest.raises(ValueError):
        bm.tag_model_bytes([("x" * 16, 1.0)], [], [])


def test_classifier():
    rows = [("F", "B:张", 1.5), ("T", "B:张", -2.0), ("T", "E:三", 0.25)]
    raw = bm.classifier_bytes(rows)
    assert sorted(bm.parse_classifier(raw)) == sorted([*rows, ("F", "E:三", 0.0)])
    assert bm.parse_classifier(bm.classifier_bytes([])) == []
    with pytest.raises(ValueError):
        bm.parse_classifier(raw[:-4])


def test_pairs_trie_and_costs(spark, tmp_path):
    record = struct.pack("<iqf", 5, (7 << 32) + 9, 1.25)
    pairs = struct.pack("<4i", 0x3321, 11, 1, 16) + record
    assert bm.parse_pairs(pairs) == [(7, 9, 1.25)]
    for bad in (pairs + record, struct.pack("<4i", 0x3321, 11, 1, 12) + record, record):
        with pytest.raises(ValueError):
            bm.parse_pairs(bad)
    trie = trie_units({"词".encode(): 1, "词组".encode(): 2, b"ab": 4})
    assert dict(bm.parse_trie(trie)) == {"词": 1, "词组": 2, "ab": 4} and bm.parse_trie(b"") == []
    costs = np.array([0, 1.5, 2.5], dtype="<f4").tobytes()
    for name, raw in (("trie", trie), ("costs", costs), ("pairs", pairs), ("tags", bm.tag_model_bytes(TAGS, [], EMITS))):
        write_bytes(spark, str(tmp_path / name), raw)
    assert sorted(map(tuple, bm.read_dictionary(spark, str(tmp_path / "trie"), str(tmp_path / "costs")).collect())) == [("词", 1, 1.5), ("词组", 2, 2.5)]
    assert [tuple(r) for r in bm.read_pairs(spark, str(tmp_path / "pairs")).collect()] == [(7, 9, 1.25)]
    assert bm.read_tag_model(spark, str(tmp_path / "tags"))[2].count() == 2
