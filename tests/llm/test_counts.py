import random
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from hanweave.llm import cooccur, heavy, termfreq


def test_pairs_of_records(spark):
    rng = random.Random(1)
    rows = []
    for line in range(400):
        pair = (rng.choice([1, 1, 1, 2, 3, 4, None]), rng.choice([1, 2, 3, 5, None]))
        rows += [(line % 7, line, *pair, "x")] * rng.choice([1, 1, 5])
    df = spark.createDataFrame(rows, "corpus_id int, line_no int, l int, r int, n string")
    records = {(c, k): (a, b) for c, k, a, b, _ in rows if a is not None and b is not None}
    one, two = Counter(), Counter()
    for a, b in records.values():
        one.update({a, b})
        if a != b:
            two[min(a, b), max(a, b)] += 1
    got = {(r.item_x, r.item_y): r for r in cooccur.pair_lifts(df, ["corpus_id", "line_no"], "l", "r").collect()}
    assert {k: r.n for k, r in got.items()} == two
    for (x, y), r in got.items():
        assert (r.n_x, r.n_y) == (one[x], one[y]) and abs(r.lift - r.n * len(records) / (one[x] * one[y])) < 1e-9
    few = cooccur.pair_lifts(df, ["corpus_id", "line_no"], "l", "r", least=5, times=1.0).collect()
    assert {(r.item_x, r.item_y) for r in few} == {(x, y) for (x, y), n in two.items() if n >= 5 and n * len(records) >= one[x] * one[y]}
    assert cooccur.pair_lifts(df.limit(0), ["corpus_id", "line_no"], "l", "r").count() == 0
    mixed = spark.createDataFrame([(1, 5, -7), (1, 5, -9), (2, -3, 2**31 - 1), (3, -(2**31), -3)], "k int, l int, r int")
    for kind in ("int", "long"):
        rows_ = mixed.select("k", F.col("l").cast(kind), F.col("r").cast(kind))
        assert sorted((r.item_x, r.item_y) for r in cooccur.pair_lifts(rows_, ["k"], "l", "r").collect()) == [(-(2**31), -3), (-9, 5), (-3, 2**31 - 1)]


def test_products_of_item_blocks():
    """Tiles of few and of many entries, one and many item blocks, with and without sides."""
    rng = np.random.default_rng(5)
    for n_items, sizes in ((9, rng.integers(0, 9, 50)), (500, rng.integers(0, 40, 80)), (3, np.zeros(4, dtype=int))):
        baskets = [rng.choice(np.arange(-5, n_items - 5), n, replace=False) for n in sizes]
        items = np.concatenate([*baskets, np.zeros(0, dtype=int)]).astype(np.int64)
        for side in (None, rng.integers(0, 3, len(items))):
            want, at = Counter(), 0
            for b in baskets:
                s = [0] * len(b) if side is None else side[at : at + len(b)]
                at += len(b)
                want.update((x, y) for x, p in zip(b, s) for y, q in zip(b, s) if x <= y and (p == 0 or p != q))
            for block in (2, 16, 1024):
                xy, n = cooccur._block_product(items, sizes, side, block)
                assert dict(zip(zip(*xy.tolist()), n.tolist())) == want and len(n) == len(want)


def test_baskets_of_any_size(spark):
    rng = random.Random(2)
    rows = [(b, rng.randrange(60), "x") for b in range(30) for _ in range(rng.choice([1, 3, 80]))] + [(99, i, "x") for i in range(200)] + [(None, 1, "x"), (1, None, "x")]
    df = spark.createDataFrame(rows, "basket int, item int, n string")
    baskets = {}
    for b, i, _ in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    want = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    want.update((i, i) for s in baskets.values() for i in s)
    for tile in (7, 512):
        assert {(r.item_x, r.item_y): r.n for r in cooccur.gram_of_baskets(df, ["basket"], "item", tile).collect()} == want


def skewed(rng, n):
    return [(rng.choice(["hot", "hot", "", None, f"w{rng.randrange(40)}", f"w{rng.randrange(2000)}"]), rng.choice([None, 1, 2, rng.randrange(900)]), rng.choice([0.5, 1.0, None]), "x") for _ in range(n)]


def test_term_frequencies(spark):
    rows = skewed(random.Random(3), 5000)
    df = spark.createDataFrame(rows, "word string, doc int, weight double, occurrences string").repartition(4)
    got = {r.word: (r.occurrences, r.records, r.weight) for r in termfreq.term_frequencies(df, "word", "doc", "weight", 5).collect()}
    want = {}
    for w, d, x, _ in rows:
        if w is not None:
            c = want.setdefault(w, [0, set(), 0.0])
            c[0] += 1
            c[1] |= {d} - {None}
            c[2] += x or 0.0
    assert got == {w: (n, len(s), x) for w, (n, s, x) in want.items()}
    assert termfreq.term_frequencies(df.limit(0), "word", "doc").count() == 0
    one = termfreq.term_frequencies(df.where("word = 'hot'"), "word", "doc", n_tasks=3)
    assert [tuple(r) for r in one.collect()] == [("hot", want["hot"][0], len(want["hot"][1]), 0.0)]
    marks = termfreq.mark(one, F.col("records") < 10**6, F.col("records") > 3)
    assert sorted(r.mark for r in marks.collect()) == ["common", "rare"]


def test_most_frequent(spark):
    rows = skewed(random.Random(4), 8000)
    df = spark.createDataFrame(rows, "word string, doc int, weight double, n string").repartition(4)
    counts = Counter(w for w, *_ in rows if w is not None)
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    for width, kept in ((1 << 14, 1024), (16, 8)):  # the second is too small and has to grow
        got = [(r.word, r.n_rows) for r in heavy.most_frequent(df, "word", 20, width, kept).collect()]
        assert got == want[:20]
    for r in heavy.sketch_candidates(df, "word", 64, candidates=50).collect():
        assert r.estimate >= counts[r.word]
    flat = spark.range(3000).selectExpr("cast(id AS string) word")  # as frequent all, so that no set can hold the first
    assert [r.word for r in heavy.most_frequent(flat, "word", 3, 16, 8).collect()] == ["0", "1", "10"]
    few = heavy.most_frequent(df.where("word IN ('hot', 'w1')"), "word", 20).collect()
    assert [r.word for r in few] == ["hot", "w1"]
    assert heavy.most_frequent(df.limit(0), "word", 3).count() == 0
