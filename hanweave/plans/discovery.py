"""Queries of corpus statistics and new-word discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanweave.functions import tokens as tk
from hanweave.functions.tokens import NOT_CJK
from hanweave.operators import analyze as an
from hanweave.operators import decode
from hanweave.operators import models as md
from hanweave.operators import newwords as nw
from hanweave.plans import decoder_sql as ds
from hanweave.plans.decoding import trained_models
from hanweave.plans.dictionaries import bigram_costs, lexicon, places, unigram_costs
from hanweave.plans.queries import ORACLES, query
from hanweave.session import checkpointed, table, wide_table
from hanweave.sources import text as src

_WORDS = f"(SELECT doc_id, pos, CASE WHEN word_type = 0 THEN word ELSE '{NOT_CJK}' END AS word FROM terms WHERE word <> '')"
_VOCAB = f"v AS (SELECT word, count(*) AS n FROM {_WORDS} GROUP BY word)"


def _vocab(spark, d):
    word = F.when(F.col("word_type") == 0, F.col("word")).otherwise(NOT_CJK)
    return nw.vocabulary(table(spark, d, "terms").where("word <> ''").select(word.alias("word")))


@query(f'WITH {_VOCAB} SELECT word, n AS "count" FROM v')
def vocab_count(spark, d):
    """Vocabulary of the analyzed words, those not Chinese as one mark."""
    return _vocab(spark, d)


@query(f"WITH {_VOCAB} SELECT word || ' ' || n AS line FROM v")
def sink_vocab(spark, d):
    """The vocabulary as lines of a count file."""
    return _vocab(spark, d).select(F.concat_ws(" ", "word", F.col("count").cast("string")).alias("line"))


def _segmented_sql(segmenter: str) -> str:
    word = ds.marked("word", "word_type")
    return ds.parts(ds.sentences("documents", "doc_id", "text"), ds.segmenter(segmenter)) + f'SELECT word, count(*) AS "count" FROM (SELECT {word} AS word FROM ({ds.analyzed("doc_id")})) GROUP BY word'


@query(_segmented_sql("crf"))
def crf_vocab(spark, d):
    """Vocabulary of all texts segmented by the CRF."""
    words = an.segment(wide_table(spark, d, "documents", "doc_id", "text"), trained_models(spark, d, "crf_seg"), "crf_seg")
    return nw.vocabulary(words.select(F.explode("words").alias("word")))


@query(_segmented_sql("bigram"))
def vocab(spark, d):
    """Vocabulary of all texts segmented by the lattice."""
    words = an.segment(wide_table(spark, d, "documents", "doc_id", "text"), trained_models(spark, d, "bigram_seg"), "bigram_seg")
    return nw.vocabulary(words.select(F.explode("words").alias("word")))


_LIMIT = "(floor(atan(1e-7 * (SELECT sum(n) FROM v)) * 50) + 2)"


@query(f"WITH {_VOCAB} SELECT sum(n)::BIGINT AS total, {_LIMIT}::INT AS threshold FROM v")
def cand_threshold(spark, d):
    """Count that candidates must exceed."""
    total = _vocab(spark, d).agg(F.sum("count").alias("total"))
    return total.select("total", nw.threshold(F.col("total")).alias("threshold"))


_NAMES = ORACLES["maxent_classify"]
_FOUND = f"SELECT word, n FROM v WHERE n > {_LIMIT} AND length(word) >= 2 AND word <> '{NOT_CJK}' AND word NOT IN (SELECT word FROM lexicon) AND word IN (SELECT word FROM ({_NAMES}) WHERE y = 'F')"


@query(f'WITH {_VOCAB} {_FOUND.replace("SELECT word, n", "SELECT word, n AS " + chr(34) + "count" + chr(34), 1)}')
def cand_filter(spark, d):
    """Words above the threshold that are not in the dictionary and no names."""
    return nw.candidates(_vocab(spark, d), lexicon(spark, d), md.name_weights(places(spark, d))).select("word", "count")


@query(f"WITH {_VOCAB} SELECT word, round((-ln(n::FLOAT::DOUBLE / (SELECT sum(n) FROM v)))::FLOAT::DOUBLE, 4) AS cost FROM ({_FOUND})")
def cand_cost(spark, d):
    """Costs of the candidates."""
    found = nw.candidates(_vocab(spark, d), lexicon(spark, d), md.name_weights(places(spark, d)))
    return found.select("word", F.round(F.col("cost").cast("double"), 4).alias("cost"))


@query(
    f"""SELECT row_id, coalesce(c.term_id, l.term_id + {nw.SYSTEM_ID_START}, {nw.OTHER_ID})::INT AS id FROM terms
    LEFT JOIN (SELECT word, min(entry_id) AS term_id FROM vocab_entries WHERE word <> '' AND word NOT IN (SELECT word FROM lexicon) GROUP BY word) c USING (word) LEFT JOIN lexicon l USING (word)"""
)
def word_id_map(spark, d):
    """Ids of words: candidates (here the vocabulary's unknown words), dictionary words, all others."""
    own = table(spark, d, "vocab_entries").where("word <> ''").join(lexicon(spark, d), "word", "left_anti").groupBy("word").agg(F.min("entry_id").alias("id"))
    return nw.word_ids(table(spark, d, "terms").select("row_id", "word"), own, lexicon(spark, d)).select("row_id", F.col("id").cast("int").alias("id"))


_PLACES = "a AS (SELECT corpus_id, line_no, pos, min({'w': word, 'l': left_id, 'r': right_id}) AS x FROM adjacents WHERE word IS NOT NULL GROUP BY ALL), s AS (SELECT x.w AS word, 'left' AS side, x.l AS neighbour FROM a UNION ALL SELECT x.w, 'right', x.r FROM a)"
_ADJACENT = f"{_PLACES}, n AS (SELECT word, side, neighbour, count(*) AS n FROM s WHERE neighbour IS NOT NULL GROUP BY ALL)"
_ENTROPY = f"{_ADJACENT}, h AS (SELECT word, side, -sum(n / t * ln(n / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY word, side) AS t FROM n) GROUP BY ALL), e AS (SELECT word, least(coalesce(max(h) FILTER (side = 'left'), 0), coalesce(max(h) FILTER (side = 'right'), 0)) AS entropy FROM h GROUP BY word)"


def _adjacent(spark, d):
    """Neighbour counts of the stored places, each once."""
    x = F.struct(F.col("word").alias("w"), F.col("left_id").alias("l"), F.col("right_id").alias("r"))
    once = table(spark, d, "adjacents").where("word IS NOT NULL").groupBy("corpus_id", "line_no", "pos").agg(F.min(x).alias("x"))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"x.{s[0]}").alias("neighbour")) for s in ("left", "right")])
    return nw.adjacency_counts(once.select(F.col("x.w").alias("word"), F.inline(sides)).where("neighbour IS NOT NULL"))


@query(f"WITH {_ADJACENT} SELECT word, side, neighbour, n FROM n")
def adjacency_count(spark, d):
    """How often each neighbour stands on each side of each candidate."""
    return _adjacent(spark, d)


@query(f"WITH {_ENTROPY} SELECT word, round(entropy, 6) + 0.0 AS entropy FROM e")
def adjacency_entropy(spark, d):
    """The smaller of the entropies of left and right neighbours."""
    return nw.adjacency_entropy(_adjacent(spark, d)).select("word", F.round("entropy", 6).alias("entropy"))


@query(
    f"""WITH w AS (SELECT word, lag(word) OVER o AS l, lead(word) OVER o AS r FROM (SELECT line_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (SELECT line_id, {tk.tokens_sql('buf')} AS t FROM corpus_lines))
      WINDOW o AS (PARTITION BY line_id ORDER BY pos)), s AS (SELECT word, 'left' AS side, l AS neighbour FROM w UNION ALL SELECT word, 'right', r FROM w)
    SELECT word, side, neighbour, count(*) AS n FROM s WHERE neighbour IS NOT NULL GROUP BY ALL"""
)
def line_neighbours(spark, d):
    """Neighbour counts of lines held as lists, here of tokens."""
    lines = table(spark, d, "corpus_lines").select(tk.tokens(F.col("buf")).alias("words"))
    return nw.adjacency_counts(nw.neighbours(lines))


def _discovery_sql(names: bool) -> str:
    """Both passes over the corpus lines: `k1` the first vocabulary, `f` the candidates, `k2` the second vocabulary, `en` their entropies."""
    unnamed = "SELECT word FROM k1 WHERE length(word) >= 2"
    no_name = f"AND word IN (SELECT word FROM ({_NAMES.replace('SELECT DISTINCT word FROM terms WHERE length(word) >= 2', unnamed)}) WHERE y = 'F')" if names else ""
    limit = "(floor(atan(1e-7 * (SELECT sum(n) FROM k1)) * 50) + 2)"
    counted = lambda name, words: f"{name} AS MATERIALIZED (SELECT {ds.marked('word', 'word_type')} AS word, count(*) AS n FROM ({ds.analyzed('line_id', words)}) GROUP BY ALL)"
    found = f"""f AS MATERIALIZED (SELECT word, (-ln(n::FLOAT::DOUBLE / (SELECT sum(n) FROM k1)))::FLOAT AS cost FROM k1
      WHERE n > {limit} AND length(word) >= 2 AND word <> '{NOT_CJK}' AND word NOT IN (SELECT word FROM lexicon) {no_name}),
    dw AS MATERIALIZED (FROM {ds._SYSTEM} UNION ALL SELECT word, {decode.USER_ID_START}, round(cost, 5)::FLOAT::DOUBLE FROM f)"""
    sides = f"""o AS (SELECT word, lag(word) OVER z AS l, lead(word) OVER z AS r FROM (SELECT line_id, sent_id, pos, {ds.marked('word', 'word_type')} AS word FROM ({ds.analyzed('line_id', 'w2')})) WINDOW z AS (PARTITION BY line_id ORDER BY sent_id, pos)),
    nb AS (SELECT word, side, CASE WHEN neighbour IN (SELECT word FROM dw) THEN neighbour ELSE '{NOT_CJK}' END AS neighbour, count(*) AS n FROM (SELECT word, 'l' AS side, l AS neighbour FROM o UNION ALL SELECT word, 'r', r FROM o)
      WHERE neighbour IS NOT NULL AND word IN (SELECT word FROM f) GROUP BY ALL),
    en AS MATERIALIZED (SELECT word, round(coalesce(h, 0), {nw.DECIMALS}) + 0.0 AS entropy FROM f LEFT JOIN (SELECT word, least(coalesce(max(h) FILTER (side = 'l'), 0), coalesce(max(h) FILTER (side = 'r'), 0)) AS h
      FROM (SELECT word, side, -sum(n / t * ln(n / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY word, side) AS t FROM nb) GROUP BY ALL) GROUP BY word) USING (word))"""
    lines = ds.sentences("corpus_lines", "line_id", "buf")
    return ds.parts(lines, ds.crf_words(), counted("k1", "w"), found, ds.lattice("dw", True), ds.words_of_lattice("w2"), counted("k2", "w2"), sides)


@query(_discovery_sql(False) + ' SELECT word, coalesce(n, 0) AS "count", round(entropy, 6) AS entropy FROM k2 FULL JOIN en USING (word)')
def bigram_analyze(spark, d):
    """Corpus lines segmented with candidates as user words: every word with its count, candidates (also those not found again, count 0) with the entropy of their neighbours."""
    df = wide_table(spark, d, "corpus_lines", "line_id", "buf")
    first = an.segment(df, trained_models(spark, d, "crf_seg"), "crf_seg", "line_id", "buf")
    found = checkpointed(nw.candidates(checkpointed(nw.vocabulary(first.select(F.explode("words").alias("word")))), lexicon(spark, d)))
    words, entropy = nw.bigram_analyze(df, found, lexicon(spark, d), bigram_costs(spark, d), "line_id", "buf")
    return words.join(entropy, "word", "full").na.fill(0, ["count"]).withColumn("entropy", F.round("entropy", 6))


def _information_sql() -> str:
    """The lattice of each candidate over dictionary and vocabulary without the candidate itself."""
    found = f"SELECT word, n FROM v WHERE n > {_LIMIT} AND length(word) >= 2 AND word <> '{NOT_CJK}' AND word NOT IN (SELECT word FROM lexicon)"
    own = f"""own AS MATERIALIZED (SELECT word, coalesce(l.t, {decode.USER_ID_START}) AS t, CASE WHEN l.word IS NULL THEN u.c WHEN u.word IS NULL OR u.c = {decode.DEFAULT_COST} THEN l.c ELSE u.c END AS c
      FROM {ds._SYSTEM} l FULL JOIN (SELECT word, round(-ln(n / (SELECT sum(n) FROM v)), 5)::FLOAT::DOUBLE AS c FROM v) u USING (word))"""
    s = f"s AS MATERIALIZED (SELECT row_number() OVER () AS sid, word AS whole, n AS times, {tk.tokens_sql('word')} AS toks FROM ({found}))"
    return f"WITH {_VOCAB}, {own}, {s}, {ds.lattice('own', True, where='WHERE word <> whole')} SELECT whole AS word, round(beams[-1][1].c + ln(times / (SELECT sum(n) FROM v)), {nw.DECIMALS}) AS value FROM s JOIN m USING (sid)"


def information(spark, d):
    vocab_ = _vocab(spark, d)
    return nw.mutual_information(vocab_, nw.candidates(vocab_, lexicon(spark, d)), lexicon(spark, d), bigram_costs(spark, d))


@query(f"SELECT word, round(value, 4) AS value FROM ({_information_sql()})")
def mutual_information(spark, d):
    """Mutual information of the candidates in the vocabulary of analyzed words."""
    return information(spark, d).withColumn("value", F.round("value", 4))


def _split_gain(spark, d):
    """Cost of each candidate's unigram split minus its own cost: a list to rank by."""
    counts = table(spark, d, "adjacents").where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    costs = unigram_costs(counts.select("word"), lexicon(spark, d))
    return costs.join(counts, "word").select("word", F.round(F.round("cost", 4) + F.log(F.col("n") / total), 4).alias("value"))


_SEG = ORACLES["seg_cost"].replace("FROM terms", "FROM adjacents")
_RANK = f"""i AS (SELECT word, round(cost + ln(n / (SELECT count(*) FROM adjacents WHERE word <> '')), 4) AS value FROM ({_SEG}) JOIN (SELECT word, count(*) AS n FROM adjacents WHERE word <> '' GROUP BY word) USING (word)),
    e2 AS (SELECT word, entropy / (max(entropy) OVER ()) AS entropy FROM (SELECT word, round(entropy, 6) + 0.0 AS entropy FROM e) QUALIFY row_number() OVER (ORDER BY entropy DESC, encode(word)) <= count(*) OVER () - floor(count(*) OVER () * 0.1)),
    i2 AS (SELECT word, value / (max(value) OVER ()) AS value FROM i QUALIFY row_number() OVER (ORDER BY value DESC, encode(word)) <= count(*) OVER () - floor(count(*) OVER () * 0.1))"""


@query(f"WITH {_ENTROPY}, {_RANK} SELECT word, round(0.6 * entropy + 0.4 * value, 6) AS value FROM e2 JOIN i2 USING (word)")
def final_rank(spark, d):
    """Two lists trimmed, scaled, joined and weighed."""
    return nw.final_rank(adjacency_entropy(spark, d), _split_gain(spark, d)).withColumn("value", F.round("value", 6))


def _new_words_sql() -> str:
    own = f"""own AS MATERIALIZED (SELECT word, coalesce(l.t, {decode.USER_ID_START}) AS t, CASE WHEN l.word IS NULL THEN u.c WHEN u.word IS NULL OR u.c = {decode.DEFAULT_COST} THEN l.c ELSE u.c END AS c
      FROM {ds._SYSTEM} l FULL JOIN (SELECT word, round(-ln(n / (SELECT sum(n) FROM k2)), 5)::FLOAT::DOUBLE AS c FROM k2) u USING (word)),
    s3 AS MATERIALIZED (SELECT row_number() OVER () AS sid, word AS whole, n AS times, {tk.tokens_sql('word')} AS toks FROM k2 WHERE word IN (SELECT word FROM f))"""
    kept = lambda value, of: f"SELECT word, {value} / nullif(max({value}) OVER (), 0) AS {value} FROM {of} QUALIFY row_number() OVER (ORDER BY {value} DESC, encode(word)) <= count(*) OVER () - floor(count(*) OVER () * {nw.REMOVE_RATIO})"
    mi = f"mi AS MATERIALIZED (SELECT whole AS word, round(beams[-1][1].c + ln(times / (SELECT sum(n) FROM k2)), {nw.DECIMALS}) AS value FROM s3 JOIN m3 USING (sid))"
    ranks = f"ra AS ({kept('entropy', 'en')}), rb AS ({kept('value', 'mi')})"
    return f"{_discovery_sql(True)}, {own}, {ds.lattice('own', True, '3', 'WHERE word <> whole')}, {mi}, {ranks} SELECT word, {nw.ALPHA} * entropy + {1 - nw.ALPHA} * value AS value FROM ra JOIN rb USING (word)"


@query(f"SELECT word, round(value, 6) AS value FROM ({_new_words_sql()})")
def new_words(spark, d):
    """The whole pipeline over the corpus lines."""
    return _new_words(spark, d).withColumn("value", F.round("value", 6))


def _new_words(spark, d):
    models = trained_models(spark, d, "crf_seg")
    return nw.new_words(wide_table(spark, d, "corpus_lines", "line_id", "buf"), models, lexicon(spark, d), bigram_costs(spark, d), md.name_weights(places(spark, d)), id_col="line_id", text_col="buf")


@query(f"SELECT word || ' ' || printf('%.3f', value) AS line FROM ({_new_words_sql()})")
def sink_new_words(spark, d):
    """The found words as lines with three decimals."""
    return _new_words(spark, d).select(F.format_string("%s %.3f", "word", "value").alias("line"))


def _files_sql() -> str:
    line = lambda part, value, decimals, source: f"SELECT '{part}' AS part, word || ' ' || printf('%.{decimals}f', ({value})::DOUBLE) AS line FROM ({source})"
    found = f"WITH {_VOCAB} SELECT word, (-ln(n::FLOAT::DOUBLE / (SELECT sum(n) FROM v)))::FLOAT AS cost FROM v WHERE n > {_LIMIT} AND length(word) >= 2 AND word <> '{NOT_CJK}' AND word NOT IN (SELECT word FROM lexicon)"
    costs = f"WITH {_VOCAB} SELECT word, round(-ln(n / (SELECT sum(n) FROM v)), 5)::FLOAT AS cost FROM v"
    parts = [line("candidate", "cost", 5, found), line("entropy", "entropy + 0.0", 3, f"WITH {_ENTROPY} SELECT word, entropy FROM e"), line("vocabulary", "cost", 5, costs), line("mutual information", "value", 3, _information_sql())]
    return " UNION ALL ".join(parts)


@query(_files_sql())
def candidate_files(spark, d):
    """Candidates, entropies, vocabulary costs and mutual information as the lines that a discovery run leaves."""
    v = _vocab(spark, d)
    parts = [
        ("candidate", src.cost_lines(nw.candidates(v, lexicon(spark, d)))),
        ("entropy", src.cost_lines(nw.adjacency_entropy(_adjacent(spark, d)), "entropy", 3)),
        ("vocabulary", src.cost_lines(nw.vocabulary_costs(v))),
        ("mutual information", src.cost_lines(information(spark, d), "value", 3)),
    ]
    return reduce(DataFrame.unionByName, [lines.select(F.lit(name).alias("part"), "line") for name, lines in parts])
