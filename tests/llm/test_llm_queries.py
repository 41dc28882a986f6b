import os
from collections import defaultdict

import pytest

from hanweave.llm.queries import ORACLES, QUERIES
from tests.llm.looks import look
from tests.oracle import compare, connect

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, name):
    compare(spark, connect(data), name, QUERIES[name], ORACLES[name], data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_p1_found(spark, data):
    groups = defaultdict(list)
    for name, table, key in (("buf", "corpus_lines", "line_id"), ("word", "vocab_entries", "entry_id")):
        for r in spark.read.parquet(f"{data}/{table}.parquet").select("corpus_id", key, name).collect():
            if r[2] and r[0] is not None:
                groups[name, r[0], look(r[2])].append((r[1], r[2]))
    want = {(n, min(i, j), max(i, j)) for (n, _, _), rows in groups.items() for i, a in rows for j, b in rows if a != b}
    assert {tuple(r) for r in QUERIES["p1_found"](spark, data).collect()} == want


def test_p3_found(spark, data):
    """Marks counted by SQL, the words of the valid lines by the line parser."""
    terms = spark.sql(f"SELECT word, count(DISTINCT doc_id) n FROM parquet.`{data}/terms.parquet` WHERE word <> '' GROUP BY word").collect()
    docs = spark.sql(f"SELECT count(DISTINCT doc_id) FROM parquet.`{data}/terms.parquet`").first()[0]
    want = {("terms", r.word, m) for r in terms for m, ok in (("rare", r.n < 3), ("common", r.n * 6 >= docs)) if ok}
    lines = QUERIES["p3_unigram"](spark, data).collect()
    files = spark.sql(f"SELECT count(DISTINCT file_name) FROM parquet.`{data}/unigram_raw.parquet`").first()[0]
    want |= {("unigram", r.word, m) for r in lines for m, ok in (("rare", r.weight < 3), ("common", r.records * 5 >= 3 * files)) if ok}
    rows = QUERIES["p3_found"](spark, data).collect()
    assert {(r["tab"], r["word"], r["mark"]) for r in rows} == want and len(rows) == len(want)
