import random

import numpy as np
import pytest

from hanweave.llm import bpe, pieces

LIMITS = [(1, 64, 0), (2, 100, 16), (3, 300, 32)]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Transducer(bpe.load_vocabulary(bpe.vocabulary_path()))


def texts():
    rng = random.Random(3)
    words = ["水", "展厅真热闹！", "房东：“反复没有”", "，", "。", "\r\n", "\n\n", " the", " model's", " 12,345", "  ", "don't", "𠀀", "é", "👩‍🌾", "http://a.example/x?y=1", "\t", "?!", "...\n"]
    made = ["".join(rng.choice(words) for _ in range(rng.randint(1, 900))) for _ in range(40)]
    return [*made, "的" * 3000, "字词" * 1500 + "。" + "a" * 2500, " " * 2000 + "x", "x\n" * 900, "", None, "short"]


def check(rows, source, encoder):
    """Whole texts, in order, within limits, with the wanted overlap, and each piece's tokens as of a fresh count."""
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.limit_id), []).append(r)
    for limit, most, overlap in LIMITS:
        for i, text in enumerate(source):
            total = encoder.count(text or "")
            got = sorted(by.get((i, limit), []), key=lambda r: r.piece_no)
            assert bool(got) == (total > most), (i, limit, total)
            end = 0
            for k, r in enumerate(got):
                assert r.piece_no == k and r.piece == text[r.char_start : r.char_end] and r.char_end > end
                assert encoder.count(r.piece) == r.n_tokens <= most, r
                assert r.char_start <= end
                if k:
                    shared = encoder.count(text[r.char_start : end])
                    assert r.n_shared >= overlap and shared <= r.n_shared
                    assert r.n_shared <= overlap + (16 if overlap else 0)
                end = r.char_end
            assert not got or end == len(text)


def key(rows):
    return sorted((r.doc_id, r.limit_id, r.piece_no, r.char_start, r.char_end, r.n_tokens, r.n_shared, r.piece) for r in rows)


def test_the_same_pieces_by_any_ranges(spark, encoder):
    """Sections of 2,500 characters, so that most texts have several, in one task and through ranges of two sizes."""
    source = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(source)], "doc_id long, text string, piece string")
    whole = pieces.split_texts(df, LIMITS, section=2500).collect()
    check(whole, source, encoder)
    for size in (257, 1000):
        assert key(pieces.split_texts(df, LIMITS, range_chars=size, section=2500).collect()) == key(whole)
    check(pieces.split_texts(df, LIMITS).collect(), source, encoder)


def test_giant_texts_without_boundaries(spark, encoder):
    """70,000 characters of one kind, where no word ends within a range, and ordinary text of that size, by the sizes of sections in use."""
    rng = random.Random(6)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(70_000))
    plain = "".join(rng.choice(["展厅真热闹！", "房东，", "the model's ", "x\n", "\n\n", "12 "]) for _ in range(20_000))
    source = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(70_000)), letters, "a" * 70_000, plain, " " * 70_000, "x" + "'s" * 35_000, "\"'s" * 24_000]
    df = spark.createDataFrame(list(enumerate(source)), "doc_id long, text string").repartition(4)
    whole = pieces.split_texts(df, LIMITS, range_chars=1 << 20).collect()
    check(whole, source, encoder)
    for size in (257, pieces.RANGE_CHARS):
        assert key(pieces.split_texts(df, LIMITS, range_chars=size).collect()) == key(whole)


def test_anchors_do_not_depend_on_ranges():
    text = "".join(random.Random(8).choice(["字。", "word, ", "\n", "\n\n", "长" * 40, "b" * 700]) for _ in range(900))
    want = pieces.anchors(text, 0, 0, len(text), 3000)
    assert len(want) > len(text) // 3000 - 12
    for size in (257, 1000, 4096):
        found = []
        for lo in range(0, len(text), size):
            near = pieces._has_anchor(lo, lo + size, 3000)
            begin, stop = (max(0, lo - pieces.HALO_CHARS), lo + size + pieces.HALO_CHARS) if near else (lo, lo + size + 1)
            new = pieces.anchors(text[begin:stop], begin, lo, min(lo + size, len(text)), 3000)
            assert near or not new
            found += new
        assert found == want


def test_null_and_repeated_ids(spark):
    texts_ = ["的。" * 400, "的。" * 400, "好，" * 300, "好，" * 40, "好，" * 40]
    df = spark.createDataFrame(list(zip([None, None, 1, 1, None], texts_)), "doc_id long, text string")
    for size in (100, 10_000):
        got = pieces.split_texts(df, [(1, 64, 8)], range_chars=size, section=700)
        whole = {}
        for r in got.collect():
            whole.setdefault((r.doc_id, r.piece_no, r.piece), []).append(r)
        first = [r for rs in whole.values() for r in rs if r.piece_no == 0]
        assert len(first) == 5 and sum(r.doc_id is None for r in first) == 3
        assert max(r.char_end for rs in whole.values() for r in rs if r.doc_id == 1) == 600
        assert sorted(len(rs) for rs in whole.values() if rs[0].doc_id is None and rs[0].char_start > 200) == [2] * (len({k for k in whole if k[0] is None and whole[k][0].char_start > 200}))


def test_empty_table_and_limits(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.split_texts(df, LIMITS).count() == 0
    assert pieces.split_texts(df, []).count() == 0
    with pytest.raises(ValueError):
        pieces.Limit(1, 10, 5)
    with pytest.raises(ValueError):
        pieces.split_texts(df, [(1, 64, 0), (1, 65, 0)])


def test_file_ranges(spark, tmp_path, encoder):
    source = [t for t in texts() if t][:6]
    for i, t in enumerate(source):
        (tmp_path / f"{i}.txt").write_bytes(t.encode())
    ranges = pieces.file_ranges(spark, str(tmp_path / "*.txt"), 2500, 1500)
    rows = {}
    for r in ranges.collect():
        rows.setdefault(int(r.id.split("/")[-1][:-4]), []).append((r.range_no, r.char_start, r.body))
    for i, t in enumerate(source):
        parts = sorted(rows[i])
        assert "".join(b for _, _, b in parts) == t
        assert [s for _, s, _ in parts] == [sum(len(b) for _, _, b in parts[:k]) for k in range(len(parts))]
    got = [r.asDict() | {"doc_id": int(r.id.split("/")[-1][:-4])} for r in pieces.pieces_of_ranges(ranges, LIMITS, section=2500).collect()]
    df = spark.createDataFrame(list(enumerate(source)), "doc_id long, text string")
    names = ("doc_id", "limit_id", "piece_no", "char_start", "char_end", "n_tokens", "n_shared", "piece")
    assert sorted(tuple(r[n] for n in names) for r in got) == key(pieces.split_texts(df, LIMITS, section=2500).collect())


def test_strengths():
    def at(text):
        return pieces.strengths(np.frombuffer(text.encode("utf-32-le"), "<u4")).tolist()

    assert at("好。”他") == [0, 0, 0, 3]
    assert at("a. b, c") == [0, 0, 3, 1, 0, 2, 1]
    assert at("a\r\n\r\nb\nc") == [0, 1, 0, 0, 0, 5, 1, 4]
    assert at("3.14") == [0, 0, 0, 0]
    assert at("甲，乙") == [0, 0, 2]


def test_boundary_in_the_first_half(spark, encoder):
    """The only boundary is before a long run: the cut falls there if the next piece then starts later."""
    text = "字词好，" + "的" * 300
    at = text.index("，") + 1
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = sorted(pieces.split_texts(df, [(1, 64, 0), (2, 64, 30)]).collect(), key=lambda r: (r.limit_id, r.piece_no))
    first = {r.limit_id: r for r in rows if r.piece_no == 0}
    assert first[1].char_end == at
    assert first[2].char_end > at and first[2].n_tokens > 60
    for limit, overlap in ((1, 0), (2, 30)):
        got = [r for r in rows if r.limit_id == limit]
        assert "".join(r.piece[max(0, e - r.char_start):] for r, e in zip(got, [0, *[r.char_end for r in got]])) == text
        assert all(r.n_tokens <= 64 and r.n_shared >= (overlap if r.piece_no else 0) for r in got)


def test_packed_places():
    rng = np.random.default_rng(2)
    for most in (3, 300, 70_000):
        p = pieces.Places(np.cumsum(rng.integers(0, most, 500)), np.cumsum(rng.integers(0, 9, 500)), rng.integers(0, 6, 500), -rng.integers(0, most, 500))
        assert all((a == b).all() for a, b in zip(vars(p).values(), vars(pieces.unpacked(pieces.packed(p))).values()))
