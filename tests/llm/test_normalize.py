import random
import unicodedata
from itertools import combinations

import pyarrow as pa
import pytest

from hanweave.functions.utf8 import code_points
from hanweave.llm import normalize as nm
from tests.llm.looks import look

CACHE: dict = {}


def plain(text):
    """The rule character by character."""
    return unicodedata.normalize("NFC", "".join(chr(p) for c in text for p in nm._expand(ord(c), CACHE)))


SAME = [
    ("Ａｂ１", "Ab1"), ("é", "é"), ("a\xa0b", "a b"), ("a　b", "a b"), ("ﬁn", "fin"), ("a​b", "ab"), ("раy", "pay"), ("ΑΒΕ", "ABE"),
    ("⼀", "一"), ("豈", "豈"), ("ｶﾞ", "ガ"), ("각", "각"), ("ё", "ë"), ("q̣̇", "q̣̇"), ("a͏̈", "ä"), ("e︀", "e"), ("so\xadft", "soft"), ("ⲂⲞⲤ", "BOC"), ("ⲣⲟ", "po"), ("ꓡꓲꓢꓴ", "LISU"), ("Å", "Å"), ("ǆ", "dž"),
]
APART = ["a", "A", "á", "à", "ab", "a b", "a  b", "²", "2", "①", "1", "l", "0", "O", "国", "國", "未", "末", "ſ", "s", "", "𝐚", "㎏", "kg", "ɑ", "ı", "i", "ɡ", "g", "…", "...", "½", "1/2"]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert len(set(nm.unify_array(pa.array([a, b])).to_pylist())) == 1


def test_other_looks():
    assert len(set(nm.unify_array(pa.array(APART)).to_pylist())) == len(APART)


def test_against_the_plain_rule():
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(0x20, 0x250), *list(range(0x300, 0x370)) * 3, *range(0x1100, 0x1200), *list(range(0x11A8, 0x11C3)) * 3, *range(0xF900, 0xFB10), *range(0x390, 0x460)]]
    pool += [chr(c) for c in (0xAC00, 0xAC01, 0xAC1C, 0x9C7, 0x9BE, 0x9D7, 0x1B05, 0x1B35, 0x344, 0x34F, 0x200D, 0xFF76, 0xFF9E, 0x3099, 0x20000, 0x2F800)] * 5
    texts = [None if rng.random() < 0.01 else "".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(20000)] + ["a" + "́" * 500]
    got = nm.unify_array(pa.array(texts)).to_pylist()
    assert got == [None if t is None else plain(t) for t in texts]
    assert nm.unify_array(pa.array(got)).to_pylist() == got
    points, lengths = code_points(pa.array(texts))
    for portion in (1, 7, 1000):
        cps, sizes = nm.unify(points, lengths, portion)
        assert cps.astype("<u4").tobytes().decode("utf-32-le") == "".join(t or "" for t in got) and sizes.tolist() == [len(t or "") for t in got]
    part = pa.array(texts, pa.string())
    assert nm.unify_array(part.slice(7, 90)).to_pylist() == got[7:97]
    assert nm.unify_array(pa.array([], pa.string())).to_pylist() == [] and nm.unify_array(pa.array([None, ""], pa.string())).to_pylist() == [None, ""]


def test_pairs(spark):
    rng = random.Random(2)
    forms = ["pay", "раy", "ｐａｙ", "p​ay", "Pay", "é", "é", "", None, "只"]
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice(forms[:1] * 30 + forms), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, corpus_id int, text string, id_lo string")
    got = sorted((r.corpus_id, r.id_lo, r.id_hi) for r in nm.same_look_pairs(df, ["corpus_id"], task_pairs=50).collect())
    want = sorted(
        (c, min(i, j), max(i, j)) for (i, c, s, _), (j, e, t, _) in combinations(rows, 2) if c == e and c is not None and s and t and s != t and look(s) == look(t)
    )
    assert got == want
    assert nm.same_look_pairs(df.limit(0), ["corpus_id"]).count() == 0


def test_column(spark):
    df = spark.createDataFrame([(1, "Ａ", "k"), (2, None, "k")], "id long, text string, look string")
    assert [tuple(r) for r in nm.with_unified(df, "text", "look").orderBy("id").collect()] == [(1, "Ａ", "A"), (2, None, None)]
    assert [tuple(r) for r in nm.with_unified(df, "text", "text").select("id", "text").orderBy("id").collect()] == [(1, "A"), (2, None)]


def test_tables_against_another_rule():
    """Every character that the rule written down in the tests knows, alone and between letters."""
    known = [chr(c) for c in [*range(0x20, 0x370), *range(0x2000, 0x2070), *range(0x2E80, 0x3040), *range(0xF900, 0xFB07), *range(0xFE00, 0xFE10), *range(0xFF00, 0xFFA0), *range(0x2F800, 0x2FA1E)] if unicodedata.category(chr(c)) not in ("Cn", "Cc") and c != 0xFB05]  # a long s in it
    texts = [t for c in known for t in (c, f"a{c}b")]
    assert nm.unify_array(pa.array(texts)).to_pylist() == [look(t) for t in texts]


BROKEN = [b"\x80", b"a\x80b", b"\xe4\xbd", b"\xf0\x9f\x98", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xff", b"\xe4a", b"\xef\xbc\xa1\xef"]


def test_broken_bytes():
    """Each kind alone and among sound rows, which are not shifted."""
    for rows in ([b] for b in BROKEN), [[b"\xef\xbc\xa1", *BROKEN, b"x"]]:
        for values in rows:
            got = nm.unify_array(pa.array(values, pa.binary()).view(pa.string())).to_pylist()
            assert got == [look(v.decode("utf-8", "replace")) for v in values]


def test_broken_bytes_through_spark(spark):
    rows = [(i, 1, v.hex()) for i, v in enumerate([b"a\x80b", b"a\xffb", b"a\xff\xe2\x80\x8bb", b"Ab", "Ａb".encode()])]
    df = spark.createDataFrame(rows, "id long, corpus_id int, h string").selectExpr("id", "corpus_id", "cast(unhex(h) AS string) AS text")
    got = {(r.id_lo, r.id_hi) for r in nm.same_look_pairs(df, ["corpus_id"]).collect()}
    assert got == {(0, 1), (0, 2), (1, 2), (3, 4)}


def test_hot_look_is_sharded(spark):
    """One look with most rows, in two frequent spellings and a rare one."""
    rows = [(i, 1, "ab" if i % 2 else "ａb") for i in range(600)] + [(600, 1, "a\u200bb")] + [(700 + i, 1, "cd") for i in range(400)] + [(1200, 1, "ｃd")]
    df = spark.createDataFrame(rows, "id long, corpus_id int, text string")
    found = nm.same_look_pairs(df, ["corpus_id"], task_pairs=1000)
    got = found.collect()
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if (i + j) % 2} | {(i, 600) for i in range(600)} | {(700 + i, 1200) for i in range(400)}
    assert len(got) == len(want) and {(r.id_lo, r.id_hi) for r in got} == want
