import base64
import random

import pytest
import tiktoken

from hanweave.llm import bpe

PATHS = ["/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"]


def texts():
    rng = random.Random(9)
    parts = ["水", "展厅", "，", "。\n", " the", "The", "n't", "'s", "'", " 1", "234", "  ", "\r\n", "\t", "é", "ё", "👍🏽", "\x00", "�", "<|endoftext|>", "aaaa", "==", "　", "ｖ１"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    noise = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2000), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(80)) for _ in range(150)]
    return [*made, *noise, "a" * 5000, "的" * 5000, " " * 3000 + "x", "ab" * 3000, "\n" * 999, ""]


@pytest.mark.parametrize("path", PATHS)
def test_same_ids_as_the_public_library(path, monkeypatch):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=bpe.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Transducer(bpe.load_vocabulary(path))
    monkeypatch.setattr(bpe, "MAX_TRANSITIONS", 5000)  # so that it is emptied many times
    for text in texts():
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert encoder.count(text) == len(ids)
        assert "".join(bpe.decode_stream(encoder.tokens, iter(ids), 3)) == text
        encoder.trim()
    for word in ("中文分词器", "hello", " 房东"):
        assert encoder.prefix_counts(word) == [encoder.count(word[: k + 1]) for k in range(len(word))]


def test_decoder_of_broken_bytes():
    rng = random.Random(1)
    for _ in range(3000):
        raw = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF]) for _ in range(rng.randint(0, 12)))
        machine, out, at = bpe.Utf8Machine(), "", 0
        while at < len(raw):
            n = rng.randint(1, 4)
            out, at = out + machine.feed(raw[at : at + n]), at + n
        assert out + machine.end() == raw.decode("utf-8", "replace")


def test_corpus(spark, monkeypatch):
    source = [*texts()[:300], None, ""]
    df = spark.createDataFrame([(i % 290, t, "x") for i, t in enumerate(source)], "doc_id long, text string, ids string")
    encoder = bpe.Transducer(bpe.load_vocabulary(PATHS[0]))
    rows = bpe.encode_corpus(df).collect()
    assert sorted((r.doc_id, r.ids) for r in rows) == sorted((i % 290, encoder.encode(t or "")) for i, t in enumerate(source))
    counts = bpe.count_tokens(df, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in counts) == sorted((i % 290, encoder.count(t or "")) for i, t in enumerate(source))
    back = bpe.decode_corpus(bpe.encode_corpus(df)).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i % 290, t or "") for i, t in enumerate(source))
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_broken_bytes(spark):
    """Each broken character as U+FFFD, and the rows after it as they are."""
    rows = [(i, v.hex()) for i, v in enumerate([b"a\x80b", b"\xe4\xbd", "你".encode(), b""])]
    df = spark.createDataFrame(rows, "doc_id long, h string").selectExpr("doc_id", "cast(unhex(h) AS string) AS text")
    back = {r.doc_id: r.text for r in bpe.decode_corpus(bpe.encode_corpus(df)).collect()}
    assert back == {0: "a�b", 1: "�", 2: "你", 3: ""}
    assert {r.doc_id for r in bpe.count_tokens(df, ["doc_id"]).where("n_tokens = 0").collect()} == {3}
