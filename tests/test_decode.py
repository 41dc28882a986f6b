import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from hanweave.functions import tokens as tk
from hanweave.functions.tokens import split_sentences, split_tokens, type_of
from hanweave.operators import decode
from hanweave.operators.analyze import Models, analyze, analyze_text, analyze_lines, bounded_rows, load_dictionary, path_costs, seg, segment, words_of
from hanweave.operators.decode import OOV_COST, UNSEEN_TRANSITION, Crf, Dictionary, Hmm


def paths(n):
    for cuts in itertools.product([0, 1], repeat=max(0, n - 1)):
        ends = [k + 1 for k, c in enumerate(cuts) if c] + [n]
        yield list(zip([0, *ends[:-1]], ends))


def test_unigram_is_the_cheapest_split():
    rng = random.Random(2)
    for _ in range(300):
        words = {"".join(rng.choice("甲乙丙") for _ in range(rng.randint(1, 3))): (k + 1, rng.choice([1.0, 3.0, 7.5, 30.0])) for k in range(rng.randint(0, 8))}
        tokens = [rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 7))]
        got, cost = Dictionary(words).segment(tokens, bigram=False)
        # An unknown token counts only where no dictionary word ends, as the place is then reached by nothing else.
        ends = {b for a in range(len(tokens)) for b in range(a + 1, len(tokens) + 1) if "".join(tokens[a:b]) in words}
        best = math.inf
        for path in paths(len(tokens)):
            total = 0.0
            for a, b in path:
                known = words.get("".join(tokens[a:b]))
                total += known[1] if known else OOV_COST if b == a + 1 and b not in ends else math.inf
            best = min(best, total)
        nodes = Dictionary(words).beams(tokens, bigram=False)
        assert all(len(x) <= 1 for x in nodes) and nodes[-1][0][0] == cost and nodes[-1][0][1] == got[-1][0]
        # Words that end where only an unknown token leads on are still found, so the brute force holds.
        assert cost == pytest.approx(best)
        assert [a for a, _, _ in got] == [0] + [b for _, b, _ in got][:-1] and got[-1][1] == len(tokens)


def test_bigrams_user_words_and_disabled_words():
    words = {"甲": (1, 5.0), "乙": (2, 5.0), "甲乙": (3, 9.0), "丙": (4, 4.0)}
    d = Dictionary(words, None, {1 << 32 | 2: 6.0})
    # 甲 then 乙 costs 5 + (6 - 5): cheaper than the word.
    assert d.segment(["甲", "乙"], True) == ([(0, 1, 1), (1, 2, 2)], 6.0)
    assert d.segment(["甲", "乙"], False) == ([(0, 2, 3)], 9.0)
    assert d.segment(["甲", "乙"], False, disabled="甲乙") == ([(0, 1, 1), (1, 2, 2)], 10.0)
    u = Dictionary(words, {"甲乙": 2.0, "丁丁": 1.0, "丙": 16.0})
    assert u.words["甲乙"] == (3, 2.0) and u.words["丙"] == (4, 4.0) and u.words["丁丁"][0] >= decode.USER_ID_START
    assert u.segment(list("丁丁甲"), True)[0] == [(0, 2, u.words["丁丁"][0]), (2, 3, 1)]
    assert Dictionary({}).segment(["x"], True) == ([(0, 1, -1)], 20.0)


def random_crf(rng, tags):
    n = len(tags)
    unigram = {f"U0:{c}": [rng.uniform(-2, 2) for _ in tags] for c in "ab"} | {f"U1:{c}/{e}": [rng.uniform(-2, 2) for _ in tags] for c in ["a", "b", "_B-1"] for e in "ab"}
    bigram = {"B": [rng.uniform(-2, 2) for _ in range(n * n)]} | {f"B1:{c}": [rng.uniform(-1, 1) for _ in range(n * n)] for c in ["a", "b", "_B+1"]}
    return Crf(tags, ["U0:%x[0,0]", "U1:%x[-1,0]/%x[0,0]", "B", "B1:%x[1,0]"], unigram, bigram)


def test_crf_against_all_tag_sequences():
    rng = random.Random(8)
    for _ in range(60):
        crf = random_crf(rng, ["S", "B", "E"])
        rows = [(rng.choice("abc"),) for _ in range(rng.randint(1, 5))]
        begin = rng.randint(0, len(rows) - 1)
        end = rng.randint(begin + 1, len(rows))
        for first, last in ((-1, -1), (0, 0), (1, -1)):
            best, top = None, -math.inf
            for tags in itertools.product(range(3), repeat=end - begin):
                total = sum(crf.scores(rows, begin + k)[t] for k, t in enumerate(tags))
                total += sum(crf.transitions(rows, begin + k)[t][tags[k - 1]] for k, t in enumerate(tags) if k)
                if first >= 0:
                    total += crf.transitions(rows, begin)[tags[0]][first]
                if last >= 0:
                    total += crf.transitions(rows, end)[last][tags[-1]]
                if total > top + 1e-9:
                    best, top = list(tags), total
            assert crf.tag(rows, begin, end, first, last) == best
        assert sum(crf.probabilities(rows, 0)) == pytest.approx(1)
    # With parity a begin tag has no effect inside a sentence.
    assert crf.tag(rows * 2, len(rows), None, 1, -1, parity=True) == crf.tag(rows * 2, len(rows), None, -1, -1)


def test_crf_marks_beyond_the_ends():
    assert [Crf.feature(["U:", d, 0, ""], [("a",), ("b",)], 0) for d in (-2, -1, 0, 1, 2, 3)] == ["U:_B-2", "U:_B-1", "U:a", "U:b", "U:_B+1", "U:_B+2"]


def hmm(trans, emits):
    return Hmm({t: 1.0 for t in ("BOS", "PU", "CD", "NN", "VV", "VA", "AD", "NR")}, trans, emits)


def test_hmm_small_cases():
    t = {("BOS", "BOS", "NN"): 1.9, ("BOS", "BOS", "VV"): 1.2, ("BOS", "VV", "NN"): 5.0, ("BOS", "NN", "VV"): 1.0, ("BOS", "VV", "VV"): 0.1, ("BOS", "NN", "NN"): 9.0}
    h = hmm(t, {1: [("NN", 0.5), ("VV", 0.0)], 2: [("VV", 0.0), ("NN", 0.0)]})
    # Costs are cut to whole numbers: 2.4 -> 2 and 1.2 -> 1, then 1.1 -> 1 after VV.
    assert h.tag([("x", 0, 1), ("y", 0, 2)]) == ["VV", "VV"]
    assert h.tag([("5", 2, -1)]) == ["CD"] and h.tag([("a", 1, -1)]) == ["NN"] and h.tag([("。", 4, -1)]) == ["PU"]
    assert h.tag([]) == []
    assert h.tag([("?", 0, -1)]) == ["VV"]  # of the tags of unknown words the one that can begin
    with pytest.raises(ValueError):
        Hmm({"NN": 1.0}, {}, {})


def test_hmm_against_exhaustive_beam():
    """With at most three tags a word the beam over last tags is compared with a plain rewrite of the rule."""
    rng = random.Random(6)
    tags = ["NN", "VV", "NR"]
    for _ in range(100):
        trans = {(a, b, c): rng.uniform(0, 9) for a in ["BOS", *tags] for b in ["BOS", *tags] for c in tags if rng.random() < 0.9}
        emits = {k: [(t, rng.uniform(0, 5)) for t in rng.sample(tags, rng.randint(1, 3))] for k in range(4)}
        words = [("w", 0, rng.randrange(4)) for _ in range(rng.randint(1, 6))]
        states = [(0, ["BOS", "BOS"])]
        for _, _, term in words:
            new = []
            for tag, emit in emits[term]:
                costs = [c + trans.get((p[-2], p[-1], tag), UNSEEN_TRANSITION) + emit for c, p in states]
                k = costs.index(min(costs))
                new.append((int(costs[k]), [*states[k][1], tag]))
            states = sorted(new, key=lambda x: x[0])[:3]
        assert hmm(trans, emits).tag(words) == states[0][1][2:]


def segmenter():
    weights = {"S": 0.0, "B": 0.0, "B1": 0.0, "B2": 0.0, "M": 0.0, "E": 0.0}
    tags = list(weights)
    follows = {("B", "B1"), ("B", "E"), ("B1", "B2"), ("B1", "E"), ("B2", "M"), ("B2", "E"), ("M", "M"), ("M", "E"), ("E", "B"), ("E", "S"), ("S", "B"), ("S", "S")}
    bigram = {"B": [0.0 if (a, b) in follows else -50.0 for a in tags for b in tags]}
    unigram = {f"U01:{c}": [0.0] * 6 for c in "张三丰说的"} | {"U01:张": [0, 9, 0, 0, 0, 0], "U01:三": [0, 0, 8, 0, 0, 1], "U01:丰": [0, 0, 0, 0, 0, 9], "U01:说": [9, 0, 0, 0, 0, 0]}
    return Crf(tags, ["U01:%x[0,0]", "B"], unigram, bigram)


def models():
    words = {"这个": (1, 3.0), "是": (2, 2.0), "一个": (3, 3.0), "简单": (4, 4.0), "的": (5, 1.0), "例子": (6, 5.0), "说": (7, 3.0), "张": (8, 9.0), "三": (9, 6.0), "丰": (10, 9.0)}
    return Models(Dictionary(words), {"的": 2, "是": 2, "说": 2}, segmenter())


def test_golden_sentence_and_recognition():
    m = models()
    assert seg(m, "这个是一个简单的例子", "bigram_seg") == ["这个", "是", "一个", "简单", "的", "例子"]
    assert seg(m, "张三丰说", "bigram_seg") == ["张", "三", "丰", "说"]
    assert seg(m, "张三丰说") == ["张三丰", "说"]  # three suspicious characters, cut anew
    assert seg(m, "张说") == ["张", "说"]  # one alone is kept
    found = analyze_text(m, "张三丰说", "seg")
    assert found[0] == (0, 0, "张三丰", 0, -2, "NONE") and found[1][4] == 7
    assert analyze_text(m, "ab 1。", "bigram_seg") == [(0, 0, "ab", 1, -1, "NONE"), (0, 1, " ", 5, -1, "NONE"), (0, 2, "1", 2, -1, "NONE"), (0, 3, "。", 4, -1, "NONE")]
    with pytest.raises(NotImplementedError):
        analyze_text(m, "x", "other")
    with pytest.raises(Exception, match="needs"):
        analyze_text(m, "x", "hmm_crf")


def test_suspicious_words():
    words = [(0, 1, 1), (1, 3, 2), (3, 4, 3), (4, 5, 3), (5, 7, 4), (7, 8, 5)]
    tokens, types = list("王小明的a中国好"), [2, 2, 2, 2, 6, 2, 2, 2]
    assert decode.suspicious(words, tokens, types, {"王": 1, "的": 2}) == [True, True, False, False, False, True]


CASES = {
    "hello.": [("hello.", 8)], "3.14": [("3.14", 5)], "3.14.": [("3.14.", 8)], "1,000": [("1", 5), (",", 7), ("000", 5)], "!": [("!", 7)], "！": [("！", 4)],
    "(a)": [("(", 9), ("a", 6), (")", 9)], "ＷＸＷ": [("ＷＸ", 6), ("Ｗ", 9)], "中文 A1\r\n\r\n好": [("中", 2), ("文", 2), (" ", 1), ("A1", 8), ("\r\n\r\n", 3), ("好", 2)],
    "éau": [("é", 9), ("au", 6)], "；": [("；", 9)], "·": [("·", 7)], "𠀀": [("𠀀", 9)], "x-1": [("x-1", 8)], "...": [("...", 8)], "１２": [("１２", 5)], "": [],
}


@pytest.mark.parametrize("text", CASES)
def test_tokens(text):
    assert [(t, type_of[t]) for t in split_tokens(text)] == CASES[text]


def test_sentences_end_after_marks_line_ends_and_999_tokens():
    assert ["".join(t) for t, _ in split_sentences("好。a! b\n\n？c")] == ["好。", "a! b\n\n", "？", "c"]
    assert [len(t) for t, _ in split_sentences("中" * 2000)] == [999, 999, 2]


def test_dataframes(spark):
    df = spark.createDataFrame([(1, "张三丰说这个。的", "x"), (2, None, "x"), (3, "", "x"), (1, "例子\n", "x"), (None, "的", "x")], "doc_id long, text string, word string")
    m = models()
    rows = analyze(df, m, "seg").collect()
    assert sum(r.doc_id == 1 for r in rows) == 7 and not any(r.doc_id in (2, 3) for r in rows)
    assert analyze(df.limit(0), m, "seg").count() == 0
    lists = [r.words for r in segment(df, m).orderBy("doc_id").collect()]
    assert lists.count(None) == 1 and [] in lists and ["例子", "-NOT-CJK-"] in lists
    costs = {r.doc_id: r.cost for r in path_costs(df.where("doc_id > 1 OR text = '的'"), m).collect()}
    assert costs == {2: None, 3: None, None: 1.0}
    lines = {r.doc_id: r.line for r in analyze_lines(df.where("text LIKE '张%' OR text IS NULL OR text = ''"), m, "seg", types=True, tags=True).collect()}
    assert lines == {1: "张三丰_ZH/NONE  说_ZH/NONE  这个_ZH/NONE  。_PU/NONE  的_ZH/NONE  "}
    one = 7  # a method of one's own, whose functions come from here
    m.add_method("chars", lambda tokens, types: [(k, k + 1) for k in range(len(tokens))], lambda words: [f"T{len(w) + one}" for w, _, _ in words])
    m.add_method("bigrams", "bigram")
    assert [(r.word, r.tag) for r in analyze(df.where("text = '例子\n'"), m, "chars").orderBy("pos").collect()] == [("例", "T8"), ("子", "T8"), ("\n", "T8")]
    assert analyze(df, m, "bigrams").count() == analyze(df, m, "bigram_seg").count()
    with pytest.raises(NotImplementedError):
        analyze(df, m, "none")
    with pytest.raises(Exception, match="more than"):
        bounded_rows(spark.range(3), 2)
    assert len(load_dictionary(spark.range(3).selectExpr("cast(id as string) word", "int(id) term_id", "1.0 cost")).words) == 3


def test_words_cover_tokens():
    m = models()
    sentences = list(split_sentences("这个张三丰，说ab 12的例子。张三。丰三说"))
    for method in ("unigram", "bigram", "mixed", "crf"):
        for (tokens, _), words in zip(sentences, words_of(m, method, sentences)):
            assert "".join(w for w, _, _, _ in words) == "".join(tokens) and sum(n for *_, n in words) == len(tokens)


def test_many_sequences_at_once_are_tagged_as_one_by_one():
    rng = random.Random(11)
    for fixed in (True, False):
        crf = random_crf(rng, ["S", "B", "E"])
        if fixed:
            crf = Crf(crf.tags, ["U0:%x[0,0]", "U1:%x[-1,0]/%x[0,0]", "U2:%x[2,0]", "B"], crf.unigram | {"U2:_B+2": [0.5, 0.0, 0.0]}, crf.bigram)
        jobs = []
        for _ in range(200):
            rows = [(rng.choice("abc"),) for _ in range(rng.randint(1, 9))]
            begin = rng.randint(0, len(rows) - 1)
            jobs.append((rows, begin, rng.randint(begin + 1, len(rows))))
        for args in ((-1, -1), (0, 0), (1, -1), (0, 2)):
            for parity in (False, True):
                assert crf.tag_many(jobs, *args, parity) == [crf.tag(*job, *args, parity) for job in jobs]
    assert crf.tag_many([]) == []


def test_column_expressions_agree_with_workers(spark):
    texts = [*CASES, "a" * 200_000, "ＷＸ" * 100_000, "a1" * 50_000, " " * 100_000, "\n" * 100_000, "1" * 100_000 + ".5", "中" * 3000, "好。a! b\n\n？c", "Ｗ" * 1000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    made = df.select("k", F.transform(tk.typed_tokens(F.col("text")), lambda x: F.struct(x["text"], x["type"])).alias("t"), tk.sentences(F.col("text")).alias("s"))
    for r in made.collect():
        assert [tuple(x) for x in r.t] == [(t, type_of[t]) for t in split_tokens(texts[r.k])]
        assert [list(x) for x in r.s] == [t for t, _ in split_sentences(texts[r.k])]
