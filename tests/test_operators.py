import math
import random
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hanweave import api
from hanweave.__main__ import main
from hanweave.operators import analyze as an
from hanweave.operators import combine as cb
from hanweave.operators import dictionary as dc
from hanweave.operators import models as md
from hanweave.operators import newwords as nw
from hanweave.operators import skew
from hanweave.sources import crf_binary
from hanweave.sources import text as src
from hanweave.streaming import stream as st


def skewed(rng, n=4000):
    """One key with a third of the rows, some repeated rows, nulls, many single keys."""
    keys = [rng.choice(["hot", "hot", None, "warm", f"k{rng.randrange(3000)}", f"k{rng.randrange(3000)}"]) for _ in range(n)]
    return [(k, rng.choice([None, 1, 1, rng.randrange(500)]), "extra") for k in keys]


def test_combine(spark):
    rows = skewed(random.Random(1))
    df = spark.createDataFrame(rows, "key string, by int, n string")
    got = cb.combine(df, ["key", "by"], held_rows=100).groupBy("key", "by").agg(F.sum("n")).collect()
    assert {(r[0], r[1]): r[2] for r in got} == Counter((k, b) for k, b, _ in rows)
    assert cb.combine(df.limit(0), ["key"]).count() == 0


def test_per_key(spark):
    rows = skewed(random.Random(2))
    df = spark.createDataFrame(rows, "key string, by int, n_rows string").repartition(5)
    got = {r.key: (r.n_rows, r.n_distinct) for r in skew.per_key(df, "key", "by", 6).collect()}
    want = {}
    for k, b, _ in rows:
        if k is not None:
            c = want.setdefault(k, [0, set()])
            c[0] += 1
            c[1] |= {b} - {None}
    assert got == {k: (n, len(s)) for k, (n, s) in want.items()}
    assert skew.per_key(df.limit(0), "key", "by").count() == 0


def test_estimates_and_packing(spark):
    rows = skewed(random.Random(3), 9000)
    df = spark.createDataFrame(rows, "key string, by int, x string").repartition(4)
    counts = Counter(k for k, _, _ in rows if k is not None)
    heavy, total = skew.estimate_heavy(df, "key", counters=32)
    assert total == sum(counts.values())
    for k, n in counts.items():
        assert heavy.get(k, 0) <= n
        if n > total / 16:
            assert heavy[k] >= n - total / 32
    plan = skew.pack(heavy, total, 8)
    assert max(plan.loads) < 1.35 * sum(plan.loads) / 8
    assert len(plan.heavy["hot"]) > 4


def test_balanced_join(spark):
    rng = random.Random(4)
    rows = skewed(rng, 2000)
    left = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, key string, by int, name string")
    right = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k5", "c"), (None, "d"), ("none", "e")], "key string, name string")
    got = sorted((r.id, r.key, r.name_right) for r in skew.balanced_join(left, right, "key", 6).collect())
    want = sorted((r.id, r.key, r.other) for r in left.join(right.withColumnRenamed("name", "other"), "key").collect())
    assert got == want
    assert skew.balanced_join(left.limit(0), right, "key").count() == 0


def test_rank_rows(spark):
    rng = random.Random(5)
    values = [(rng.randrange(100), i) for i in range(1000)]
    df = spark.createDataFrame(values, "v int, i int").repartition(5)
    got = {r.i: r["rank"] for r in dc.rank_rows(df, F.col("v").desc(), F.col("i")).collect()}
    assert got == {i: k + 1 for k, (v, i) in enumerate(sorted(values, key=lambda x: (-x[0], x[1])))}
    assert dc.rank_rows(df.limit(0), F.col("v")).count() == 0


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_text_sources(spark, tmp_path):
    user = src.parse_user_dictionary(lines(spark, "例子 4.5", "简单", " x ", "a  7e1z", "b bad")).collect()
    assert [(r.word, r.cost) for r in user] == [("例子", 4.5), ("简单", 16.0), ("", 0.0), ("a", 70.0), ("b", 0.0)]
    with pytest.raises(ValueError):
        src.parse_user_dictionary(lines(spark, "x").limit(0))
    assert src.parse_dictionary(lines(spark, "王 1", " 的\t2\r")).collect() == [("王", 1), ("的", 2)]
    assert src.parse_transitions(lines(spark, "BOS BOS NN 0.5")).collect() == [("BOS", "BOS", "NN", 0.5)]
    assert src.parse_weights(lines(spark, "F B:简 0.5")).collect() == [("F", "B:简", 0.5)]
    for bad in ("NN", "NN 1 2", ""):
        with pytest.raises(Exception, match="not a tag and a cost"):
            src.parse_tag_set(lines(spark, bad)).collect()
    tags, words = src.parse_tag_set(lines(spark, "NN 1")), spark.createDataFrame([("例子", 3)], "word string, term_id int")
    emits = src.parse_emissions(lines(spark, "NN 例子 2", "NN 无 1"))
    assert src.resolve_emissions(emits, tags, words).collect() == [("NN", 3, 2.0)]
    with pytest.raises(Exception, match="unknown tag"):
        src.resolve_emissions(src.parse_emissions(lines(spark, "XX 例子 2")), tags, words).collect()
    (tmp_path / "c.txt").write_bytes("一\r\n\n二".encode())
    assert [r.value for r in src.read_lines(spark, str(tmp_path / "c.txt")).collect()] == ["一\r", "", "二"]
    assert src.read_binary(spark, str(tmp_path / "c.txt")).first()["length"] == 9
    src.write_lines(spark.createDataFrame([("a",), (None,), ("b",)], "line string").coalesce(1), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part*")) == "a\nb\n"
    assert [r.value for r in src.lines_of(spark.createDataFrame([(1, "a\nb"), (2, None)], "i int, t string"), "t", "i").collect()] == ["a\n", "b\n"]


def trie(items):
    """A double-array trie built greedily, as a fixture for the reader."""
    base, check, used = {0: 1}, {}, set()

    def place(keys, at, depth):
        codes = sorted({k[depth] + 1 if len(k) > depth else 0 for k, _ in keys})
        b = 1
        while b in used or any(b + c in check for c in codes):
            b += 1
        used.add(b)
        base[at] = b
        for c in codes:
            check[b + c] = b
        for c in codes:
            part = [(k, v) for k, v in keys if (k[depth] + 1 if len(k) > depth else 0) == c]
            if c == 0:
                base[b] = -part[0][1] - 1
            else:
                place(part, b + c, depth + 1)

    place(items, 0, 0)
    size = max(check) + 1
    return b"".join(struct.pack("<iI", base.get(k, 0), check.get(k, 0)) for k in range(size))


def test_crf_file(spark, tmp_path):
    tags, templates = ["S", "E"], ["U0:%x[0,0]", "B"]
    features = {"U0:中": 0, "U0:文": 2, "U0:中文": 8, "B": 4}
    weights = [float(k) for k in range(10)]
    units = trie([(k.encode(), v) for k, v in features.items()])
    text = [b"".join(t.encode() + b"\0" for t in x) for x in (tags, templates)]
    raw = struct.pack("<iidiii", 100, 0, 1.0, 10, 1, len(units))
    raw += b"".join(struct.pack("<i", len(t)) + t for t in text) + units + struct.pack("<10f", *weights)
    (tmp_path / "m.crf").write_bytes(raw)
    model = crf_binary.read_crf(spark, str(tmp_path / "m.crf"))
    assert (model.tags, model.templates, model.features) == (tags, templates, features)
    rows = {(r.feature, r.left_tag, r.tag): r.weight for r in model.table(spark).collect()}
    assert rows["U0:文", None, "E"] == 3.0 and rows["B", "E", "S"] == 6.0 and len(rows) == 10
    crf = an.load_crf(tags, templates, model.table(spark))
    assert crf.scores([("中",)], 0) == [0.0, 1.0]
    again = crf_binary.parse_crf(crf_binary.crf_bytes(tags, templates, list(model.rows())))
    assert set(again.rows()) == set(model.rows()) and (again.tags, again.templates) == (tags, templates)
    rng = random.Random(7)
    keys = {bytes(rng.randrange(1, 256) for _ in range(rng.randint(1, 5))): k for k in range(3000)}
    assert crf_binary.trie_items(crf_binary.trie_units(keys)) == keys
    for bad in (raw + b"x", raw[:20], b"\x01" + raw[1:]):
        with pytest.raises(ValueError):
            crf_binary.parse_crf(bad)


def test_user_words(spark):
    system = spark.createDataFrame([("a", 1, 5.0), ("b", 2, 6.0)], "word string, term_id int, cost float")
    user = spark.createDataFrame([("a", 16.0), ("b", 1.5), ("z", 3.0), ("c", 2.0), ("c", 9.0)], "word string, cost float")
    got = {r.word: (r.term_id, r.cost) for r in dc.merge_user(system, user).collect()}
    assert got == {"a": (1, 5.0), "b": (2, 1.5), "c": (0x40000000, 2.0), "z": (0x40000001, 3.0)}


def test_built_models_match_loaded_ones(spark):
    counts = spark.createDataFrame([("b", 2.0), ("a", 1.0), ("b", 1.0), (None, 5.0)], "word string, count double")
    got = {r.word: (r.term_id, round(r.cost, 5)) for r in dc.build_unigram(counts).collect()}
    assert got == {"a": (1, round(-math.log(1 / 4), 5)), "b": (2, round(-math.log(3 / 4), 5))}
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "x", 3)], "left string, right string, count int")
    words = spark.createDataFrame([("a", 1), ("b", 2)], "word string, term_id int")
    assert [(r.left_id, r.right_id, round(r.cost, 5)) for r in dc.build_bigram(pairs, words).collect()] == [(1, 2, round(-math.log(1 / 4), 5))]


def test_classify_ties_and_unknown_words(spark):
    weights = spark.createDataFrame([("F", "B:张", 1.0), ("T", "E:三", 1.0), ("T", "M:小", 0.5)], "y string, feature string, weight float")
    words = spark.createDataFrame([("张三",), ("张小三",), ("李四",), ("张",), (None,)], "word string")
    assert {r.word: r.y for r in md.classify(words, weights).collect()} == {"张三": "F", "张小三": "T", "李四": "F"}


def test_entropy_and_neighbours(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"],), (["a"],), ([],), (None,)], "words array<string>")
    got = Counter((r.word, r.side, r.neighbour) for r in nw.neighbours(df).collect())
    assert got == Counter([("a", "right", "b"), ("b", "left", "a"), ("b", "right", "a"), ("a", "left", "b"), ("a", "right", "c"), ("c", "left", "a")])
    h = {r.word: r.entropy for r in nw.adjacency_entropy(nw.adjacency_counts(nw.neighbours(df))).collect()}
    assert h == {"a": 0.0, "b": 0.0, "c": 0.0}
    counts = spark.createDataFrame([("w", "left", 1, 1), ("w", "left", 2, 3), ("w", "right", 1, 2), ("w", "right", 5, 2)], "word string, side string, neighbour int, n int")
    assert nw.adjacency_entropy(counts).first().entropy == pytest.approx(0.25 * math.log(4) + 0.75 * math.log(4 / 3))


def test_bigram_analyze(spark):
    """Unknown words are one neighbour, a candidate never seen has 0, and the vocabulary comes out too."""
    dictionary = spark.createDataFrame([("我们", 1, 5.0), ("学校", 2, 5.0)], "word string, term_id int, cost float")
    found = spark.createDataFrame([("计算机", 1.0), ("量子力", 1.0)], "word string, cost float")
    texts = ["我们计算机学校", "猫计算机狗", "鸟计算机鱼", "a计算机b", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    vocab, entropy = nw.bigram_analyze(df, found, dictionary)
    assert {r["word"]: r["count"] for r in vocab.collect()} == {"我们": 1, "计算机": 4, "学校": 1, "猫": 1, "狗": 1, "鸟": 1, "鱼": 1, "-NOT-CJK-": 2}
    got = {r.word: r.entropy for r in entropy.collect()}
    assert got == {"计算机": pytest.approx(0.25 * math.log(4) + 0.75 * math.log(4 / 3)), "量子力": 0}


def test_threshold_and_candidates(spark):
    assert [spark.range(1).select(nw.threshold(F.lit(n))).first()[0] for n in (0, 10**5, 10**6, 10**9)] == [int(math.atan(1e-7 * n) * 50) + 2 for n in (0, 10**5, 10**6, 10**9)]
    vocab = spark.createDataFrame([("新词", 9), ("旧词", 9), ("的", 90), ("-NOT-CJK-", 99), ("少见", 2)], "word string, count long")
    got = nw.candidates(vocab, spark.createDataFrame([("旧词",)], "word string")).collect()
    assert [(r.word, round(r.cost, 5)) for r in got] == [("新词", round(-math.log(9 / 209), 5))]


def test_mutual_information(spark):
    dictionary = spark.createDataFrame([("新", 1, 5.0), ("词", 2, 6.0)], "word string, term_id int, cost float")
    vocab = spark.createDataFrame([("新词", 4), ("新", 10), ("其他", 86), ("词语", 1)], "word string, count long")
    words = spark.createDataFrame([("新词",), ("没有",), ("词语",)], "word string")
    got = {r.word: r.value for r in nw.mutual_information(vocab, words, dictionary).collect()}
    cost = lambda n: round(-math.log(n / 101), 5)
    # The vocabulary's cost replaces the dictionary's; an unknown character costs 20.
    assert got == pytest.approx({"新词": cost(10) + 6.0 - -math.log(4 / 101), "词语": 6.0 + 20 - -math.log(1 / 101)}, abs=1e-4)


@pytest.mark.parametrize("parity", [False, True])
def test_final_rank(spark, parity):
    entropy = spark.createDataFrame([(f"w{k}", 2.5 * k / 20) for k in range(1, 21)], "word string, entropy double")
    info = spark.createDataFrame([(f"w{k}", float(21 - k)) for k in range(1, 21)], "word string, value double")
    got = {r.word: r.value for r in nw.final_rank(entropy, info, parity=parity).collect()}
    assert set(got) == {f"w{k}" for k in range(3, 19)}  # two of twenty drop from each list
    assert got["w10"] == pytest.approx(0.6 * 1.25 / (2 if parity else 2.5) + 0.4 * 11 / 20)
    none = entropy.withColumn("entropy", F.lit(0.0))
    assert {r.value for r in nw.final_rank(none, info).collect()} == {None}
    assert nw.final_rank(entropy.limit(0), info).count() == 0


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("这个 例子\n。\n")
    words = an.Models(an.load_dictionary(spark.createDataFrame([("这个", 1, 1.0), ("例子", 2, 1.0)], "word string, term_id int, cost double")))
    found = st.run_once(st.analyze_stream(st.read_line_stream(spark, str(tmp_path / "in")), words, "bigram_seg"))
    assert sorted(r.word for r in found.collect()) == sorted(["这个", " ", "例子", "。"])


def test_model_folder_and_command_line(spark, data, tmp_path):
    read = lambda t: spark.read.parquet(f"{data}/{t}.parquet")
    tables = api.train(read("terms"), read("lexicon"))
    tables.save(str(tmp_path / "model"))
    loaded = api.ModelTables.load(spark, str(tmp_path / "model"))
    text = "这个房东考证了陶罐。"
    for method in an.METHODS:
        assert an.analyze_text(loaded.models(method), text, method) == an.analyze_text(tables.models(method), text, method)
    with pytest.raises(an.ModelError):
        api.ModelTables.load(spark, str(tmp_path / "none"))
    with pytest.raises(NotImplementedError):
        loaded.models("none")
    (tmp_path / "corpus.txt").write_text("\n".join([text, "", "新词组在这里，新词组在那里。新词组好，新词组坏"]) + "\n")
    (tmp_path / "user.txt").write_text("新词组 1.0\n")
    main(["segment", str(tmp_path / "model"), str(tmp_path / "corpus.txt"), str(tmp_path / "out"), "-m", "bigram_seg", "-d", str(tmp_path / "user.txt"), "-t"], spark)
    out = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    assert "新词组_ZH  在_ZH" in out
    main(["vocab", str(tmp_path / "model"), str(tmp_path / "corpus.txt"), str(tmp_path / "vocab"), "-m", "bigram_seg"], spark)
    assert "-NOT-CJK- " in "".join(p.read_text() for p in (tmp_path / "vocab").glob("part*"))
    with pytest.raises(SystemExit):
        main(["vocab", str(tmp_path / "model"), str(tmp_path / "corpus.txt"), str(tmp_path / "v2"), "-m", "hmm_crf"], spark)
    with pytest.raises(SystemExit):
        main(["segment", str(tmp_path / "model")], spark)
    main(["discover", str(tmp_path / "model"), str(tmp_path / "corpus.txt"), str(tmp_path / "found")], spark)
    assert (tmp_path / "found" / "_SUCCESS").exists()


def test_commands_that_make_models(spark, tmp_path, monkeypatch, capsys):
    files = {"u": '新词 6\n组 3\n"好的 1\n', "b": "新词 组 2\n组 新词 x\n", "d": "组 2\n", "t": "NN 1\nBOS 2\nPU 1\nCD 1\nVV 1\nVA 1\nAD 1\nNR 1\n", "tr": "BOS BOS NN 0.5\n", "e": "NN 新词 1.5\nNN 外 2\n", "w": "T B:张 1\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    model, at = str(tmp_path / "model"), lambda n: str(tmp_path / n)
    main(["gram", model, at("u"), at("b")], spark)
    assert "quoting" in capsys.readouterr().err
    for args in (["dict", model, at("d")], ["hmm", model, at("t"), at("tr"), at("e")], ["maxent", model, at("w")]):
        main(args, spark)
    tables = api.ModelTables.load(spark, model)
    assert [(r.word, r.term_id, round(r.cost, 4)) for r in tables.dictionary.orderBy("term_id").collect()] == [("新词", 1, 0.4055), ("组", 2, 1.0986)]
    assert [tuple(r) for r in tables.bigrams.collect()] == [(1, 2, 0.0)]
    assert [tuple(r) for r in tables.properties.collect()] == [("组", 2)] and [tuple(r) for r in tables.emissions.collect()] == [("NN", 1, 1.5)]
    assert tables.transitions.count() == 1 and tables.names.count() == 1
    monkeypatch.setattr("sys.stdin", ["新词组好\n", "\n"])
    main(["segment", model, "-i", "-m", "bigram_seg", "-t"], spark)
    assert capsys.readouterr().out.split("\n")[:2] == ["新词_ZH  组_ZH  好_ZH  ", ""]


def test_random_text_through_all_methods(spark, data):
    tables = api.train(spark.read.parquet(f"{data}/terms.parquet"), spark.read.parquet(f"{data}/lexicon.parquet"))
    rng = np.random.default_rng(3)
    for method in an.METHODS:
        m = tables.models(method)
        for _ in range(5):
            text = "".join(chr(c) for c in rng.choice([0x4E00, 0x7684, 0x4E2D, 0x20, 0x61, 0x31, 0x0A, 0x3002, 0xFF0C, 0x1F600, 0xE9], 300))
            assert "".join(r[2] for r in an.analyze_text(m, text, method)) == text


def test_second_pass_with_any_number_of_candidates(spark, data):
    """Candidates sent to all workers, or joined to the texts they occur in."""
    read = lambda t: spark.read.parquet(f"{data}/{t}.parquet")
    lines = read("corpus_lines").select("line_id", "buf")
    words = read("lexicon").select("word", "term_id", F.coalesce("cost", F.lit(16.0)).alias("cost"))
    bigrams = spark.createDataFrame([(1, 2, 3.0)], "left_id int, right_id int, cost float")
    found = spark.createDataFrame([("的人", 4.0), ("了一", 5.0), ("在这里", 3.0), ("房东", 2.0), ("水", 1.0), ("没有的词", 1.0)], "word string, cost double")
    results = [nw.bigram_analyze(lines, found, words, bigrams, "line_id", "buf", most=m) for m in (100, 0)]
    for a, b in zip(*results):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count()
    empty = nw.bigram_analyze(lines.limit(0), found, words, bigrams, "line_id", "buf", most=0)
    assert empty[0].count() == 0 and {r.entropy for r in empty[1].collect()} == {0.0}
