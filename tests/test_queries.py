import hashlib
import os
import re
import struct
from collections import Counter

import pytest

import __spark_entry__ as entry
from hanweave.plans.discovery import information
from hanweave.plans.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, data, name):
    compare(spark, con, name, QUERIES[name], ORACLES[name], data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_bigram_analyze(spark, data):
    """Entropies of all candidates and counts of all words."""
    rows = QUERIES["bigram_analyze"](spark, data).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    assert any(r["entropy"] is None and r["count"] > 0 for r in rows) and any(r["entropy"] is not None for r in rows)


def test_scan_userdict_lines(spark, data):
    """Also words that hold blanks, which are cut at the first one."""
    want, blanks = Counter(), 0
    for r in spark.read.parquet(f"{data}/vocab_entries.parquet").where("word <> ''").collect():
        for line in (r.word if r.cnt is None else f"{r.word} {r.cnt}").split("\n"):
            word, blank, rest = line.partition(" ")
            number = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", rest, re.ASCII)
            want[word.strip(" \t\r\n"), struct.unpack("f", struct.pack("f", (float(number[1]) if number else 0.0) if blank else 16.0))[0]] += 1
            blanks += " " in r.word
    assert Counter(map(tuple, QUERIES["scan_userdict_lines"](spark, data).collect())) == want and blanks


def test_candidate_files(spark, data):
    """The mutual information of each candidate is a line too."""
    rows = QUERIES["candidate_files"](spark, data).collect()
    lines = {r.line for r in rows if r.part == "mutual information"}
    assert lines == {f"{r.word} {r.value:.3f}" for r in information(spark, data).collect()} and lines


def test_scan_binary(spark, data):
    """Contents are read."""
    with open(f"{data}/lexicon.parquet", "rb") as f:
        content = f.read()
    (row,) = QUERIES["scan_binary"](spark, data).collect()
    assert (row["length"], row["n_read"], row["sha256"]) == (len(content), len(content), hashlib.sha256(content).hexdigest())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
