import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hanweave.functions import tokens as tk
from hanweave.functions import utf8
from hanweave.operators.rejects import BIGRAM, UNIGRAM, parse_counts, parse_lines

# Every malformed kind: lone followers, leads without followers, overlong forms, surrogates, too large, cut short.
BROKEN = [b"\x80", b"\xbf\xbf", b"\xc2", b"\xe4\xbd", b"\xf0\x9f\x98", b"\xc0\xaf", b"\xc1\x81", b"\xe0\x80\xaf", b"\xed\xa0\x80", b"\xf0\x80\x80\xaf", b"\xf4\x90\x80\x80", b"\xf5\x80\x80\x80", b"\xfe", b"\xff", b"\xe4a", b"\xf0\x9fa", b"\xe4\xbd\xc2"]
SOUND = [b"", b"a", "é".encode(), "你好".encode(), "😀".encode(), b"x\xef\xbf\xbd"]


def column(values):
    """A text column of any bytes."""
    return pa.array(values, pa.binary()).view(pa.string())


def mixed(rng, n):
    parts = [*BROKEN, *SOUND, *SOUND]
    return [None if rng.random() < 0.05 else b"".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(n)]


def test_code_points():
    rng = random.Random(1)
    for values in ([b"a\x80b"], BROKEN, [b"\xe4", b"\xbd\xa0"], mixed(rng, 5000), [bytes(rng.randrange(256) for _ in range(rng.randint(0, 9))) for _ in range(20000)], [], [None], SOUND):
        points, lengths = utf8.code_points(column(values))
        want = [(v or b"").decode("utf-8", "replace") for v in values]
        assert lengths.tolist() == [len(w) for w in want]
        assert points.astype("<u4").tobytes().decode("utf-32-le") == "".join(want)
        assert utf8.texts(column(values)) == [None if v is None else v.decode("utf-8", "replace") for v in values]
        assert utf8.texts(column(values), "ignore") == [None if v is None else v.decode("utf-8", "ignore") for v in values]
    points, lengths = utf8.code_points(column([b"junk", b"a\xff", b"b"]).slice(1, 2))
    assert points.tolist() == [97, 0xFFFD, 98] and lengths.tolist() == [2, 1]


def test_broken_words_are_rejected():
    """Alone and within sound batches, and no row is shifted."""
    for bad in BROKEN:
        for form, line in ((UNIGRAM, b"a%s 3"), (UNIGRAM, b'"%s" 3'), (BIGRAM, b"a b%s 3"), (UNIGRAM, b"a 3%s"), (BIGRAM, b"a b 3%s")):
            rows = [line % bad, b"x y 5" if form is BIGRAM else b"x 5"]
            reason, columns = parse_lines(column(rows), form)
            assert reason.to_pylist() == ["value", None], rows
            assert columns[0].to_pylist() == [None, "x"]
            assert parse_lines(column([rows[0]]), form)[0].to_pylist() == ["value"]
    assert parse_lines(column([b"a\x80b", b"\xff"]), UNIGRAM)[0].to_pylist() == ["columns", "columns"]


def test_broken_bytes_through_spark(spark):
    rows = [(i, (b"w" + b + b" 3").hex()) for i, b in enumerate([*BROKEN, b""])]
    df = spark.createDataFrame(rows, "raw_id long, h string").select("raw_id", F.unhex("h").cast("string").alias("raw"))
    got = {r.raw_id: r.reason for r in parse_counts(df, UNIGRAM, keep=("raw_id",)).select("raw_id", "reason").collect()}
    assert got == {i: "value" for i in range(len(BROKEN))} | {len(BROKEN): None}


def test_tokens_leave_out_broken_bytes(spark):
    """As the scanner's rule for bytes that start nothing: no token, and the text goes on."""
    rows = [("你好", b"\xe4\xbd\xa0\x80\xe5\xa5\xbd".hex()), ("ab", b"a\xffb".hex()), ("a�b", "a�b".encode().hex())]
    df = spark.createDataFrame(rows, "want string, h string").select("want", F.unhex("h").cast("string").alias("text"))
    got = df.select("want", tk.tokens(F.col("text")).alias("t")).collect()
    assert ["".join(r.t) for r in got] == [r.want for r in got] and [len(r.t) for r in got] == [2, 1, 3]
    assert np.all([r.t == tk.split_tokens(r.want) for r in got])
