import numpy as np
import pandas as pd

from hanweave.llm import mix


def test_round_block_keeps_size_and_is_unbiased():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 500, 60)
    fractions = rng.random(60)
    total = np.zeros(60)
    for k in range(4000):
        x = mix.round_block(sizes, fractions, rng.random(60))
        assert ((x == 0) | (x == 1)).sum() >= 59
        assert abs((x * sizes).sum() - (fractions * sizes).sum()) < 1e-6
        total += x
    assert np.abs(total / 4000 - fractions).max() < 0.05
    assert mix.round_block(np.array([3]), np.array([0.0]), np.array([0.5])).tolist() == [0]


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mix, "BLOCK", 50)
    monkeypatch.setattr(mix, "FAN_IN", 2)
    rng = np.random.default_rng(1)
    rows = [(i, ["big", "mid", "small", "other", None][min(4, int(rng.exponential(1)))], int(rng.integers(1, 200)), "x") for i in range(5000)]
    rows += [(9000, "small", 0, "x"), (9001, "small", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int, copies string")
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.2, 2), ("small", 0.4, 3), ("gone", 0.1, 5)], "source string, target_share double, max_repeats int")
    got = mix.mix(df, targets)
    out = got.collect()
    assert len({r.doc_id for r in out}) == len(out)
    caps = {"big": 1, "mid": 2, "small": 3}
    assert len(out) == len(rows) and all(0 <= r.copies <= caps.get(r.source, 0) for r in out)
    assert all(r.copies == 0 for r in out if r.doc_id >= 9000)
    report = {r.source: r for r in mix.shares(got, targets).collect()}
    assert report["gone"].actual_share == 0 and report["gone"].most_copies == 0
    for s, share in (("big", 0.3), ("mid", 0.2), ("small", 0.4)):
        assert abs(report[s].actual_share - share / 0.9) < 0.002, report
    assert sorted(map(str, out)) == sorted(map(str, mix.mix(df, targets).collect()))
    assert mix.mix(df.limit(0), targets).count() == 0
    assert {r.copies for r in mix.mix(df, targets.limit(0)).collect()} == {0}
    short = {r.source: r.size for r in mix.shares(mix.mix(df, targets, total=1e9), targets).collect()}
    sizes = {r[0]: r[1] for r in df.groupBy("source").sum("n_tokens").collect()}
    assert all(short[s] == sizes[s] * caps[s] for s in caps)


def test_largest_records_have_their_chance():
    """A record of half the source's text, and long-tailed sizes: chances exact, the size kept as far as the largest allow."""
    rng = np.random.default_rng(3)
    tail = np.sort((2000 / (1 - rng.random(300)) ** 0.9).astype(int).clip(1, 60000))[::-1]
    for sizes, p in ((np.array([50, *[1] * 50]), 0.5), (np.array([50, *[1] * 50]), 0.3), (tail, 0.15), (tail, 0.8)):
        runs = [mix.decide_largest(sizes, p, sizes.sum(), rng.random(len(sizes)))[0] for _ in range(4000)]
        assert np.abs(np.mean(runs, axis=0) - p).max() < 0.05
        if sizes is tail:
            assert np.abs(np.array(runs) @ sizes / (p * sizes.sum()) - 1).mean() < 0.01
    x, left = mix.decide_largest(np.array([4, 2]), 0.5, 20, np.array([0.1, 0.9]))
    assert x.tolist() == [1, 0] and abs(4 + left * 14 - 10) < 1e-9


def test_long_records_of_a_scarce_source_enter(spark):
    rows = [(0, "scarce", 300)] + [(i, "scarce", 10) for i in range(1, 71)] + [(i, "full", 10) for i in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int").coalesce(1)
    targets = spark.createDataFrame([("scarce", 0.5, 1), ("full", 0.5, 1)], "source string, target_share double, max_repeats int")
    drawn = [mix.mix(df, targets, seed=s).where("doc_id = 0").first().copies for s in range(0, 60, 10)]
    assert set(drawn) == {0, 1}


def test_every_record_has_its_chance_over_all_steps():
    """The steps of a source one after the other, with 600 seeds: mean copies are the wanted number, also of the largest records."""
    rng = np.random.default_rng(9)
    sizes = np.concatenate([[4000, 2500, 900], rng.integers(5, 400, 157)])
    records = pd.DataFrame({"__id": np.arange(160), "source": "s", "__size": sizes, "__block": np.arange(160) % 4})
    need = mix.Need(1, 0.37, 9, int(sizes.sum()), 4)
    total, reached = np.zeros(160), []
    for _ in range(600):
        draws = rng.random((4, 160))
        of = lambda df, level: df.assign(__draw=draws[level][df["__id"]], __last=draws[3][df["__id"]])  # noqa: B023, E731
        large = records["__size"] >= 512
        first = mix._decider({"s": need})(of(records[large], 0))
        rest = of(records[~large].assign(__fraction=first["__left"].iloc[0]), 1)
        done = pd.concat([mix._rounder(False)(b) for _, b in rest.groupby("__block")])
        over = ~done["__fraction"].isin([0, 1])
        assert over.sum() <= 4
        last = mix._rounder(True)(of(done[over], 2)) if over.any() else done[over]
        out = pd.concat([first, done[~over], last])
        assert out["__fraction"].isin([0, 1]).all() and len(out) == 160
        copies = 1 + out.set_index("__id")["__fraction"].sort_index().to_numpy()
        total += copies
        reached.append((copies * sizes).sum() / (1.37 * sizes.sum()))
    assert np.abs(total / 600 - 1.37).max() < 0.09  # 4.5 times the standard error
    assert abs(np.mean(reached) - 1) < 0.003


def test_drawn(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(40)], "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.75, 1), ("b", 0.25, 1)], "source string, target_share double, max_repeats int")
    got = {r.source: r.actual_share for r in mix.shares(mix.mix(df, targets), targets).collect()}
    assert abs(got["a"] - 0.75) < 0.02
