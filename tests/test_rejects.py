import math
import random
import re
import unicodedata

import pyarrow as pa
import pytest

from hanweave.operators.combine import slices
from hanweave.operators.rejects import BIGRAM, UNIGRAM, parse_counts, parse_lines, read_counts, rejected_rows, valid_rows

WS = " \t\r\n"


def brute(raw, form):
    """Character by character, straight from the rule."""
    if raw is None:
        return "columns", None
    k, fields = 0, []
    while k < len(raw):
        if raw[k] in WS:
            k += 1
            continue
        if raw[k] == '"':
            k += 1
            text = ""
            while True:
                if k >= len(raw):
                    return "quoting", None
                if raw[k] == '"':
                    if raw[k + 1 : k + 2] == '"':
                        text += '"'
                        k += 2
                        continue
                    k += 1
                    break
                text += raw[k]
                k += 1
            if k < len(raw) and raw[k] not in WS:
                return "quoting", None
        else:
            start = k
            while k < len(raw) and raw[k] not in WS:
                k += 1
            text = raw[start:k]
        fields.append(text)
    if len(fields) != form.fields:
        return "columns", None
    for w in fields[:-1]:
        if not w or len(w.encode()) > 99 or any(unicodedata.category(c) == "Cc" or c == "�" for c in w):
            return "value", None
    c = fields[-1]
    if form.whole:
        if not re.fullmatch("[0-9]+", c) or not 1 <= int(c) <= 2147483647:
            return "value", None
        return None, (*fields[:-1], int(c))
    if not re.fullmatch(r"[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?", c) or not 0 < float(c) < math.inf:
        return "value", None
    return None, (*fields[:-1], float(c))


CASES = [
    None, "", "  \t", "a 1", '"a b" 1', '"a" "1"', '"" 1', '"""" 1', '""" 1', '"""a" 1', 'o"clock 3', 'a" 1', '"a"b 1', '"a" 1 2', '"a 1', 'a "1',
    'x"y" 2', 'x"y z" 2', '"x"" y" 2', '"x" "', "a\t1\r\n", 'a 1 "', "a 0", "a 1e400", "a 1e-400", "a 1.", "a .5", "a +1", "a 2e+3", "a 2147483648",
    "a b 2147483647", "a b 0000000000000000012", "a b 2147483648", "a b 99999999999999999999", "a b ٣", "é" * 50 + " 1", "é" * 49 + " 1", "a\x07b 1", "a\x85b 1", "a� 1",
    '"a\tb" 1', '" " 1', "a 1", 'a"" 1', '""a 1', '"""""" 410', "a Infinity", "a nan", "a 0077", 'a b " 5"', '"a""b" c 4', 'a "b"" c" 4',
]


def check(lines, form):
    reason, columns = parse_lines(pa.array(lines, pa.string()), form)
    got = list(zip(reason.to_pylist(), zip(*(c.to_pylist() for c in columns))))
    for line, (r, values) in zip(lines, got):
        want, row = brute(line, form)
        assert (r, values if r is None else None) == (want, row), repr(line)


@pytest.mark.parametrize("form", [UNIGRAM, BIGRAM])
def test_cases_and_random_lines(form):
    check(CASES, form)
    rng = random.Random(4)
    for _ in range(4):
        check([None if rng.random() < 0.02 else "".join(rng.choice('""" \t  aé1") 5\r') for _ in range(rng.randint(0, 14))) for _ in range(5000)], form)
    check([], form)
    check([None, None], form)
    check(["a 1", "b 2", '"c c" 3'], form)


def test_sliced_column():
    lines = pa.array(["junk", *CASES, "junk"], pa.string()).slice(1, len(CASES))
    reason, _ = parse_lines(lines, UNIGRAM)
    assert reason.to_pylist() == [brute(c, UNIGRAM)[0] for c in CASES]


def test_operator(spark):
    df = spark.createDataFrame([(i, c, "x") for i, c in enumerate(CASES)], "raw_id long, raw string, word string")
    parsed = parse_counts(df, UNIGRAM, keep=("raw_id",))
    rows = {r.raw_id: r for r in parsed.collect()}
    assert len(rows) == len(CASES)
    for i, c in enumerate(CASES):
        reason, values = brute(c, UNIGRAM)
        assert rows[i].reason == reason and rows[i].raw == (c if reason else None)
        assert reason or (rows[i].word, rows[i]["count"]) == values
    assert valid_rows(parsed).count() + rejected_rows(parsed).count() == len(CASES)
    assert parse_counts(df.limit(0), BIGRAM).count() == 0
    with pytest.raises(ValueError):
        parse_counts(df, UNIGRAM, keep=("word",))


def test_files(spark, tmp_path):
    (tmp_path / "u.txt").write_text('a 1\n"b c" 2\n"x 1\n\nd 0\n')
    rows = sorted((r.word or "", r["count"], r.reason) for r in read_counts(spark, str(tmp_path / "u.txt"), UNIGRAM).collect())
    assert rows == [("", None, "columns"), ("", None, "quoting"), ("", None, "value"), ("a", 1.0, None), ("b c", 2.0, None)]


def test_portions(spark):
    assert list(slices(pa.array(["aa", None, "b" * 50, "", "c"]), 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(slices(pa.array([], pa.string()), 10)) == []
    df = spark.createDataFrame([(i, "a " + "1" * (i % 5)) for i in range(200)], "raw_id long, raw string")
    assert parse_counts(df, UNIGRAM, keep=("raw_id",)).where("reason IS NULL").count() == 160
