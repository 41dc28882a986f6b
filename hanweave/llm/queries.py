"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanweave.llm import bpe, cooccur, heavy, mix, normalize, pieces, termfreq
from hanweave.operators.dictionary import rank_rows
from hanweave.operators.rejects import UNIGRAM, parse_counts, valid_rows
from hanweave.plans.problems import UNIGRAM_SQL
from hanweave.session import checkpointed, shared_folder, table, wide_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _texts(spark, d):
    """Both text columns of problem 1 in one form: corpus_id, field_name, id, text."""
    lines = table(spark, d, "corpus_lines").select("corpus_id", F.lit("buf").alias("field_name"), F.col("line_id").alias("id"), F.col("buf").alias("text"))
    words = table(spark, d, "vocab_entries").select("corpus_id", F.lit("word").alias("field_name"), F.col("entry_id").alias("id"), F.col("word").alias("text"))
    return lines.unionByName(words)


@query()
def p1_found(spark, d):
    """Pairs of rows of a corpus that look the same and differ in their characters."""
    return normalize.same_look_pairs(_texts(spark, d), ["field_name", "corpus_id"]).select("field_name", "id_lo", "id_hi")


@query()
def p1_unified(spark, d):
    """Every row's text in its consistent form."""
    return normalize.with_unified(_texts(spark, d), "text", "text").select("field_name", "id", "text")


_RECORD = ["corpus_id", "line_no", "pos"]


def _pair_tables(spark, d):
    yield "bigram", table(spark, d, "bigram_records"), "word_left", "word_right"
    yield "adjacent", table(spark, d, "adjacents"), "left_id", "right_id"


def _lift_sql(tab, name, left, right, least, where):
    return f"""
      SELECT '{tab}' AS tab, x AS item_x, y AS item_y, n, n_x, n_y, round(n::DOUBLE * big / (n_x::DOUBLE * n_y), 6) AS lift
      FROM (SELECT least(l, r) AS x, greatest(l, r) AS y, count(*) AS n FROM {tab}_r WHERE l <> r GROUP BY ALL HAVING count(*) >= {least})
      JOIN (SELECT i AS x, count(*) AS n_x FROM {tab}_i GROUP BY i) USING (x)
      JOIN (SELECT i AS y, count(*) AS n_y FROM {tab}_i GROUP BY i) USING (y), (SELECT count(*) AS big FROM {tab}_r) {where}"""


def _records_sql(tab, name, left, right):
    return f"""{tab}_r AS (SELECT corpus_id, line_no, pos, min({left})::BIGINT AS l, min({right})::BIGINT AS r FROM {name}
        WHERE {left} IS NOT NULL AND {right} IS NOT NULL GROUP BY ALL),
      {tab}_i AS (SELECT l AS i FROM {tab}_r UNION ALL SELECT r FROM {tab}_r WHERE l <> r)"""


_PAIR_NAMES = [("bigram", "bigram_records", "word_left", "word_right"), ("adjacent", "adjacents", "left_id", "right_id")]
_PAIR_RECORDS = "WITH " + ",".join(_records_sql(*x) for x in _PAIR_NAMES)


@query(
    _PAIR_RECORDS
    + "SELECT tab, item_x AS id_lo, item_y AS id_hi FROM ("
    + " UNION ALL ".join(_lift_sql(*x, 5, "WHERE n * 20000 >= big AND n::HUGEINT * big >= 6 * n_x::HUGEINT * n_y") for x in _PAIR_NAMES)
    + ")"
)
def p2_found(spark, d):
    """Pairs of neighbours at least six times as frequent as by chance."""
    found = [
        cooccur.pair_lifts(df, _RECORD, a, b, least=5, share=1 / 20000, times=6).select(F.lit(tab).alias("tab"), F.col("item_x").alias("id_lo"), F.col("item_y").alias("id_hi"))
        for tab, df, a, b in _pair_tables(spark, d)
    ]
    return found[0].unionByName(found[1])


@query(_PAIR_RECORDS + " UNION ALL ".join(_lift_sql(*x, 1, "") for x in _PAIR_NAMES))
def p2_lifts(spark, d):
    """All pairs of different neighbours with their counts and lift."""
    found = [cooccur.pair_lifts(df, _RECORD, a, b).withColumn("tab", F.lit(tab)) for tab, df, a, b in _pair_tables(spark, d)]
    return found[0].unionByName(found[1]).select("tab", "item_x", "item_y", "n", "n_x", "n_y", F.round("lift", 6).alias("lift"))


def _word_ids(spark, d):
    """`word`, `item`: the words of all terms numbered from 1 in byte order."""
    return rank_rows(table(spark, d, "terms").where("word <> ''").select("word").distinct(), F.col("word"), name="item")


_WORD_IDS = "SELECT word, row_number() OVER (ORDER BY encode(word)) AS item FROM (SELECT DISTINCT word FROM terms WHERE word <> '')"


@query(_WORD_IDS)
def p2_word_ids(spark, d):
    """The ids that words have in `p2_word_baskets`."""
    return _word_ids(spark, d)


@query(
    f"""WITH i AS ({_WORD_IDS}), b AS (SELECT DISTINCT doc_id, item FROM terms JOIN i USING (word) WHERE doc_id IS NOT NULL)
    SELECT x.item AS item_x, y.item AS item_y, count(*) AS n FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.item < y.item GROUP BY ALL"""
)
def p2_word_baskets(spark, d):
    """All words, by their ids of `p2_word_ids`, that occur in the same document, with the number of documents."""
    words = table(spark, d, "terms").where("word <> ''").select("doc_id", "word").distinct()
    return cooccur.gram_of_baskets(words.join(_word_ids(spark, d), "word"), ["doc_id"], "item").where("item_x < item_y")


def _unigram_rows(spark, d):
    return valid_rows(parse_counts(table(spark, d, "unigram_raw"), UNIGRAM, keep=("raw_id", "file_name")))


_TERMS_SQL = "t AS (SELECT word, count(DISTINCT doc_id) AS n FROM terms WHERE word <> '' GROUP BY word), d AS (SELECT count(DISTINCT doc_id) AS d FROM terms)"
_LINES_SQL = f"u AS (SELECT w[1] AS word, count(*) AS c, count(DISTINCT file_name) AS n, sum(w[2]::DOUBLE) AS s FROM {UNIGRAM_SQL} WHERE reason IS NULL GROUP BY w[1]), f AS (SELECT count(DISTINCT file_name) AS f FROM unigram_raw)"


@query(
    f"""WITH {_TERMS_SQL}, {_LINES_SQL} SELECT 'terms' AS tab, word, 'rare' AS mark FROM t WHERE n < 3 UNION ALL SELECT 'terms', word, 'common' FROM t, d WHERE n * 6 >= d
    UNION ALL SELECT 'unigram', word, 'rare' FROM u WHERE s < 3 UNION ALL SELECT 'unigram', word, 'common' FROM u, f WHERE n * 5 >= 3 * f"""
)
def p3_found(spark, d):
    """Words too rare or too common."""
    words = termfreq.counted_pairs(table(spark, d, "terms").withColumn("word", F.nullif("word", F.lit(""))), "word", "doc_id")
    counts = termfreq.counted_pairs(parse_counts(table(spark, d, "unigram_raw"), UNIGRAM, keep=("raw_id", "file_name")), "word", "file_name", "count")  # a rejected line has no word
    docs, files = (x.agg(F.count_distinct("__record")).first()[0] for x in (words, counts))
    terms, lines = termfreq.frequencies(words, "word"), termfreq.frequencies(counts, "word")
    n, w = F.col("records"), F.col("weight")
    terms = termfreq.mark(terms, n < 3, n * 6 >= docs).withColumn("tab", F.lit("terms"))
    lines = termfreq.mark(lines, w < 3, n * 5 >= 3 * files).withColumn("tab", F.lit("unigram"))
    return terms.unionByName(lines).select("tab", "word", "mark")


@query("SELECT word, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM terms WHERE word <> '' GROUP BY word")
def p3_terms(spark, d):
    """Occurrences and documents of every word."""
    return termfreq.term_frequencies(table(spark, d, "terms").where("word <> ''"), "word", "doc_id").drop("weight")


@query(f"WITH {_LINES_SQL} SELECT word, c AS occurrences, n AS records, round(s, 4) AS weight FROM u")
def p3_unigram(spark, d):
    """Rows, files and total count of every word of the valid unigram lines."""
    return termfreq.term_frequencies(_unigram_rows(spark, d), "word", "file_name", "count").withColumn("weight", F.round("weight", 4))


@query("SELECT word FROM terms WHERE word <> '' GROUP BY word ORDER BY count(*) DESC, word LIMIT 20")
def p6_found(spark, d):
    """The 20 words with the most rows."""
    return heavy.most_frequent(table(spark, d, "terms").where("word <> ''"), "word", 20).select("word")


@query("SELECT word, count(*) AS n_rows FROM terms WHERE word <> '' GROUP BY word ORDER BY count(*) DESC, word LIMIT 200")
def p6_counts(spark, d):
    """The 200 most frequent words with their exact numbers of rows."""
    return heavy.most_frequent(table(spark, d, "terms").where("word <> ''"), "word", 200).select("word", "n_rows")


@query()
def p7_ids(spark, d):
    """Ids of every document by byte_bpe_50k."""
    return bpe.encode_corpus(wide_table(spark, d, "documents", "doc_id", "text"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p7_decoded(spark, d):
    """Every document encoded and decoded again: the texts must come back unchanged, null as empty."""
    return bpe.decode_corpus(bpe.encode_corpus(wide_table(spark, d, "documents", "doc_id", "text")))


def _mixed(spark, d):
    sizes = checkpointed(bpe.count_tokens(wide_table(spark, d, "documents", "doc_id", "source", "text"), ["doc_id", "source"]))
    return mix.mix(sizes, table(spark, d, "mix_targets"))


@query()
def p8_mix(spark, d):
    """Every document with its copies in the largest mix that meets the target shares."""
    return _mixed(spark, d)


@query()
def p8_drawn(spark, d):
    """Only the documents that are in the mix, with their copies."""
    return _mixed(spark, d).where("copies > 0")


@query()
def p8_shares(spark, d):
    """The shares reached."""
    return mix.shares(_mixed(spark, d), table(spark, d, "mix_targets"))


@query()
def p9_pieces(spark, d):
    """Pieces of every document above each limit."""
    return pieces.split_texts(wide_table(spark, d, "documents", "doc_id", "text"), table(spark, d, "piece_limits"))


@query()
def p9_ranged(spark, d):
    """The same pieces with every document of over 2,048 characters cut into ranges and stitched."""
    return pieces.split_texts(wide_table(spark, d, "documents", "doc_id", "text"), table(spark, d, "piece_limits"), range_chars=2048)


@query()
def p9_files(spark, d):
    """Pieces of text files of all documents, by language and the task that writes them, read by byte ranges."""
    folder = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    texts = table(spark, d, "documents").where("text IS NOT NULL").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.col("text").alias("value"))
    texts.write.partitionBy("lang").text(folder)
    limits = pieces.limits_of(table(spark, d, "piece_limits"))
    found = pieces.pieces_of_ranges(pieces.file_ranges(spark, f"{folder}/*/*.txt", pieces.section_of(limits)), limits)
    return found.withColumn("id", F.regexp_extract("id", "lang=(.*/part-[0-9]*)", 1))
