"""Queries of dictionaries, count files and trained model tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from hanweave.functions import tokens as tk
from hanweave.functions import utf8
from hanweave.operators import analyze as an
from hanweave.operators import dictionary as dc
from hanweave.operators import models as md
from hanweave.operators.decode import DEFAULT_COST, OOV_COST, USER_ID_START
from hanweave.operators.newwords import SYSTEM_ID_START
from hanweave.operators.rejects import valid_rows
from hanweave.plans import decoder_sql as ds
from hanweave.plans.problems import BIGRAM_SQL, UNIGRAM_SQL, bigram_lines, unigram_lines
from hanweave.plans.queries import query
from hanweave.session import map_arrow, table

LEXICON_SQL = f"(SELECT word, term_id, coalesce(cost, {DEFAULT_COST})::FLOAT AS cost FROM lexicon)"
#: User words: the corpora's vocabulary with the least cost of each word.
USER_SQL = "(SELECT word, min(cost) AS cost FROM (SELECT word, CASE WHEN cnt IS NULL THEN 16.0 ELSE round(10 - ln(cnt), 5) END::FLOAT AS cost FROM vocab_entries WHERE word <> '') GROUP BY word)"


def lexicon(spark, d):
    return table(spark, d, "lexicon").select("word", "term_id", F.coalesce("cost", F.lit(DEFAULT_COST).cast("float")).alias("cost"))


def user_words(spark, d):
    cost = F.when(F.col("cnt").isNull(), F.lit(DEFAULT_COST)).otherwise(F.round(10 - F.log("cnt"), 5)).cast("float")
    return table(spark, d, "vocab_entries").where("word <> ''").select("word", cost.alias("cost"))


def pair_counts(spark, d):
    """Counts of neighbouring dictionary words by id, of records with both."""
    return table(spark, d, "bigram_records").where("word_left IS NOT NULL AND word_right IS NOT NULL").groupBy(F.col("word_left").alias("left"), F.col("word_right").alias("right")).agg(F.count("*").alias("count"))


def bigram_costs(spark, d):
    ids = lexicon(spark, d).select(F.col("term_id").alias("word"), "term_id")
    return dc.build_bigram(pair_counts(spark, d), ids)


@query("SELECT row_id, word, term_id FROM terms LEFT JOIN lexicon USING (word)")
def dict_lookup(spark, d):
    """Each word's term id, null if unknown."""
    return dc.lookup(table(spark, d, "terms").select("row_id", "word"), lexicon(spark, d))


@query("SELECT row_id, CASE WHEN word IS NULL THEN -2 ELSE coalesce(term_id, -1) END AS term_id FROM terms LEFT JOIN lexicon USING (word)")
def term_id(spark, d):
    """Term ids with the marks of the API: -1 unknown, -2 none."""
    found = dc.lookup(table(spark, d, "terms").select("row_id", "word"), lexicon(spark, d))
    return found.select("row_id", F.when(F.col("word").isNull(), -2).otherwise(F.coalesce("term_id", F.lit(-1))).alias("term_id"))


_WALK_SQL = "(SELECT DISTINCT word FROM terms WHERE word <> '')"


@query(
    f"""WITH p AS (SELECT DISTINCT unnest(list_transform(range(1, length(word) + 1), lambda k: word[1:k])) AS prefix FROM lexicon),
    s AS (SELECT prefix, coalesce(term_id, -1) AS state FROM p LEFT JOIN lexicon ON word = prefix)
    SELECT word, prefix, coalesce(state, -2) AS state FROM (SELECT word, unnest(list_transform(range(1, length(word) + 1), lambda k: word[1:k])) AS prefix FROM {_WALK_SQL}) LEFT JOIN s USING (prefix)"""
)
def dict_prefix_walk(spark, d):
    """State after each character of each distinct word: term id, -1 inside a word, -2 dead."""
    words = dc.prefixes(table(spark, d, "terms").where("word <> ''").select("word").distinct(), "word")
    return words.join(dc.prefix_states(lexicon(spark, d)), "prefix", "left").select("word", "prefix", F.coalesce("state", F.lit(-2)).alias("state"))


@query(f"SELECT x.word, prefix, l.term_id FROM (SELECT word, unnest(list_transform(range(1, length(word) + 1), lambda k: word[1:k])) AS prefix FROM {_WALK_SQL}) x JOIN lexicon l ON l.word = prefix")
def dict_common_prefix(spark, d):
    """All dictionary words that each distinct word begins with."""
    words = dc.prefixes(table(spark, d, "terms").where("word <> ''").select("word").distinct(), "word")
    return words.join(lexicon(spark, d).select(F.col("word").alias("prefix"), "term_id"), "prefix").select("word", "prefix", "term_id")


_COUNTS_SQL = f"(SELECT w[1] AS word, w[2]::DOUBLE AS n FROM {UNIGRAM_SQL} WHERE reason IS NULL)"
_BUILT_SQL = f"(SELECT word, (row_number() OVER (ORDER BY encode(word)))::INT AS term_id, round((-ln(n / (sum(n) OVER ())))::FLOAT::DOUBLE, 4) AS cost FROM (SELECT word, sum(n) AS n FROM {_COUNTS_SQL} GROUP BY word))"


def _built(spark, d):
    return dc.build_unigram(valid_rows(unigram_lines(spark, d)).select("word", "count"))


@query(f"SELECT word, term_id, cost FROM {_BUILT_SQL}")
def build_unigram(spark, d):
    """Dictionary with costs from count files; ids in byte order."""
    return _built(spark, d).withColumn("cost", F.round(F.col("cost").cast("double"), 4))


@query("SELECT word_left AS left_id, word_right AS right_id, round((-ln(count(*) / (SELECT count(*) FROM bigram_records WHERE word_left IS NOT NULL AND word_right IS NOT NULL)))::FLOAT::DOUBLE, 4) AS cost FROM bigram_records WHERE word_left IN (SELECT term_id FROM lexicon) AND word_right IN (SELECT term_id FROM lexicon) GROUP BY ALL")
def build_bigram(spark, d):
    """Costs of pairs of dictionary words."""
    return bigram_costs(spark, d).withColumn("cost", F.round(F.col("cost").cast("double"), 4))


@query(
    f"""WITH u AS {_BUILT_SQL}, b AS (SELECT w[1] AS l, w[2] AS r, sum(w[3]::BIGINT) AS n FROM {BIGRAM_SQL} WHERE reason IS NULL GROUP BY ALL)
    SELECT x.term_id AS left_id, y.term_id AS right_id, round((-ln(n / (SELECT sum(n) FROM b)))::FLOAT::DOUBLE, 4) AS cost FROM b JOIN u x ON x.word = l JOIN u y ON y.word = r"""
)
def gram(spark, d):
    """Both count files together: pair costs over the dictionary built from the words."""
    return dc.build_bigram(valid_rows(bigram_lines(spark, d)), _built(spark, d)).withColumn("cost", F.round(F.col("cost").cast("double"), 4))


@query(f"SELECT word, sum(n) AS n FROM {_COUNTS_SQL} GROUP BY word")
def scan_unigram(spark, d):
    """Words of unigram files with their summed counts."""
    return valid_rows(unigram_lines(spark, d)).groupBy("word").agg(F.sum("count").alias("n"))


@query(f'SELECT w[1] AS "left", w[2] AS "right", sum(w[3]::BIGINT)::BIGINT AS n FROM {BIGRAM_SQL} WHERE reason IS NULL GROUP BY ALL')
def scan_bigram(spark, d):
    """Pairs of bigram files with their summed counts."""
    return valid_rows(bigram_lines(spark, d)).groupBy("left", "right").agg(F.sum("count").alias("n"))


@query(
    f"""SELECT word, coalesce(l.term_id, ({USER_ID_START} - 1 + row_number() OVER (PARTITION BY l.term_id IS NULL ORDER BY encode(word)))::INT) AS term_id,
    CASE WHEN l.word IS NULL THEN u.cost WHEN u.word IS NULL OR u.cost = {DEFAULT_COST} THEN l.cost ELSE u.cost END AS cost FROM {LEXICON_SQL} l FULL JOIN {USER_SQL} u USING (word)"""
)
def dict_merge_user(spark, d):
    """Dictionary and user words merged."""
    return dc.merge_user(lexicon(spark, d), user_words(spark, d))


@query("SELECT DISTINCT t.word, l.term_id FROM terms t JOIN lexicon l USING (word) WHERE l.oov_value IS DISTINCT FROM 2")
def dict_disable(spark, d):
    """Known words of the corpus, those with a disabled id hidden."""
    disabled = table(spark, d, "lexicon").where("oov_value = 2").select("term_id")
    words = table(spark, d, "terms").select("word").distinct()
    return words.join(lexicon(spark, d), "word").join(disabled, "term_id", "left_anti").select("word", "term_id")


@query(f"SELECT row_id, cost FROM terms JOIN {LEXICON_SQL} USING (word)")
def array_get(spark, d):
    """Cost by id: a column of the dictionary."""
    ids = dc.lookup(table(spark, d, "terms").select("row_id", "word"), lexicon(spark, d)).where("term_id IS NOT NULL")
    return ids.join(lexicon(spark, d).select("term_id", "cost"), "term_id").select("row_id", "cost")


_PAIR_COST = "(SELECT word_left, word_right, (-ln(count(*) / (SELECT count(*) FROM bigram_records WHERE word_left IS NOT NULL AND word_right IS NOT NULL)))::FLOAT::DOUBLE AS cost FROM bigram_records GROUP BY ALL)"


@query(f"SELECT rec_id, round(cost, 4) AS cost FROM bigram_records LEFT JOIN {_PAIR_COST} USING (word_left, word_right)")
def hash_find(spark, d):
    """Cost of each record's pair by its key, null if a side is null."""
    records = table(spark, d, "bigram_records").select("rec_id", F.col("word_left").alias("left_id"), F.col("word_right").alias("right_id"))
    return records.join(bigram_costs(spark, d), ["left_id", "right_id"], "left").select("rec_id", F.round(F.col("cost").cast("double"), 4).alias("cost"))


@query("SELECT word_left, word_right, max_by(weight, rec_id) AS weight FROM bigram_records WHERE word_left IS NOT NULL AND word_right IS NOT NULL AND weight IS NOT NULL GROUP BY ALL")
def hash_build(spark, d):
    """Table of pairs in which the last record of a key wins."""
    known = table(spark, d, "bigram_records").dropna(subset=["word_left", "word_right", "weight"])
    return dc.last_by(known, ["word_left", "word_right"], "weight", "rec_id")


@query(
    f"""SELECT adj_id, round(CASE WHEN b.cost IS NOT NULL THEN b.cost - l.cost ELSE r.cost END, 4) AS cost FROM adjacents
    JOIN {LEXICON_SQL} l ON l.term_id = left_id - {SYSTEM_ID_START} JOIN {LEXICON_SQL} r ON r.term_id = right_id - {SYSTEM_ID_START}
    LEFT JOIN {_PAIR_COST} b ON word_left = l.term_id AND word_right = r.term_id"""
)
def bigram_cost(spark, d):
    """Cost of going from each occurrence's left neighbour to its right one: by the pair where it is stored, else by the right word."""
    pairs = bigram_costs(spark, d)
    costs = lexicon(spark, d)
    records = table(spark, d, "adjacents").select("adj_id", (F.col("left_id") - SYSTEM_ID_START).alias("left_id"), (F.col("right_id") - SYSTEM_ID_START).alias("right_id"))
    joined = records.join(costs.select(F.col("term_id").alias("left_id"), F.col("cost").alias("left_cost")), "left_id").join(costs.select(F.col("term_id").alias("right_id"), F.col("cost").alias("right_cost")), "right_id")
    cost = F.coalesce(F.col("cost").cast("double") - F.col("left_cost"), F.col("right_cost").cast("double"))
    return joined.join(pairs, ["left_id", "right_id"], "left").select("adj_id", F.round(cost, 4).alias("cost"))


@query("SELECT word, oov_value FROM lexicon WHERE oov_value IS NOT NULL")
def dict(spark, d):  # noqa: A001
    """The word to number dictionary of out-of-vocabulary properties."""
    return table(spark, d, "lexicon").where("oov_value IS NOT NULL").select("word", "oov_value")


@query("SELECT row_id, oov_value FROM terms LEFT JOIN lexicon USING (word)")
def oov_property(spark, d):
    """Each word's property: 1 begins words, 2 is filtered, null none."""
    return table(spark, d, "terms").select("row_id", "word").join(table(spark, d, "lexicon").select("word", "oov_value"), "word", "left").select("row_id", "oov_value")


_LATTICE = f"""WITH RECURSIVE c AS (SELECT DISTINCT word FROM terms WHERE word <> ''), e AS (
    SELECT c.word, i AS b, i + k AS e, l.term_id, l.cost FROM c, unnest(range(0, length(c.word))) AS t(i), unnest(range(1, length(c.word) - i + 1)) AS u(k)
    JOIN {LEXICON_SQL} l ON l.word = c.word[i + 1 : i + k])"""


@query(f"{_LATTICE} SELECT word, b::INT AS begin_char, e::INT AS end_char, term_id, cost FROM e")
def lattice_build(spark, d):
    """Every dictionary word inside every distinct word, by an equi-join on its parts."""
    return lattice(table(spark, d, "terms").where("word <> ''").select("word").distinct(), lexicon(spark, d))


def lattice(words, dictionary):
    n, longest = F.length("word"), dictionary.agg(F.max(F.length("word"))).first()[0] or 1
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(n - i + 1, F.lit(longest))), lambda k: F.struct(i.alias("i"), k.alias("k")))))
    parts = words.select("word", F.explode(spans).alias("s")).select("word", "s.*", F.substring(F.col("word"), F.col("s.i"), F.col("s.k")).alias("part"))
    found = parts.join(dictionary.select(F.col("word").alias("part"), "term_id", "cost"), "part")
    return found.select("word", (F.col("i") - 1).alias("begin_char"), (F.col("i") + F.col("k") - 1).alias("end_char"), "term_id", "cost")


def _beams_sql(bigram: bool) -> str:
    words = f"s AS MATERIALIZED (SELECT row_number() OVER () AS sid, word, {tk.tokens_sql('word')} AS toks FROM (SELECT DISTINCT word FROM terms WHERE word <> ''))"
    return ds.parts(words, ds.lattice(ds._SYSTEM, bigram)) + """SELECT word, k::INT AS place, n.b::INT AS begin, n.t::INT AS term_id, round(n.c, 4) AS cost
      FROM (SELECT word, k, unnest(beams[k + 1]) AS n FROM (SELECT word, beams, unnest(range(1, len(beams))) AS k FROM m JOIN s USING (sid)))"""


def _beams(spark, d, bigram):
    """`word`, `place`, `begin`, `term_id`, `cost`: the nodes that the beam keeps at each place of every distinct word, by the cost of their paths."""
    shared = spark.sparkContext.broadcast(an.load_dictionary(lexicon(spark, d), bigram_costs(spark, d) if bigram else None))

    def run(batches):
        for batch in batches:
            rows = [
                (word, place, begin, term, cost)
                for word in utf8.texts(batch.column(0))
                for place, nodes in enumerate(shared.value.beams(tk.split_tokens(word), bigram)) if place
                for cost, begin, term, _ in nodes
            ]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=["word", "place", "begin", "term_id", "cost"])

    words = table(spark, d, "terms").where("word <> ''").select("word").distinct()
    return map_arrow(words, run, "word string, place int, begin int, term_id int, cost double").withColumn("cost", F.round("cost", 4))


@query(_beams_sql(True))
def beam_topk(spark, d):
    """The three nodes with the cheapest paths at each place, by bigrams; equal costs put the longer word first."""
    return _beams(spark, d, True)


@query(_beams_sql(False))
def beam_min(spark, d):
    """The node with the cheapest path at each place, by unigrams."""
    return _beams(spark, d, False)


def unigram_costs(words, dictionary):
    """`word`, `cost` of the cheapest split of each word of Chinese characters, by built-in expressions over its lattice.

    The cost of each place is the least over the words that end there, or the place before plus
    the cost of an unknown token if none does.
    """
    edges = lattice(words, dictionary).groupBy("word").agg(F.collect_list(F.struct("end_char", "begin_char", F.col("cost").cast("double").alias("cost"))).alias("edges"))
    all_ = words.join(edges, "word", "left").withColumn("edges", F.coalesce("edges", F.expr("cast(array() as array<struct<end_char:int,begin_char:int,cost:double>>)")))

    def step(costs, at):
        into = F.filter("edges", lambda e: e["end_char"] == at)
        best = F.array_min(F.transform(into, lambda e: F.element_at(costs, e["begin_char"] + 1) + e["cost"]))
        return F.concat(costs, F.array(F.coalesce(best, F.element_at(costs, at) + OOV_COST)))

    costs = F.aggregate(F.sequence(F.lit(1), F.length("word")), F.array(F.lit(0.0)), step)
    return all_.select("word", F.element_at(costs, -1).alias("cost"))


@query(
    f"""{_LATTICE}, p(word, k, costs) AS (SELECT word, 0, [0.0::DOUBLE] FROM c UNION ALL
    SELECT p.word, k + 1, list_append(costs, coalesce((SELECT min(costs[e.b + 1] + e.cost::DOUBLE) FROM e WHERE e.word = p.word AND e.e = p.k + 1), costs[k + 1] + {OOV_COST})) FROM p WHERE k < length(p.word))
    SELECT word, round(costs[-1], 4) AS cost FROM p WHERE k = length(word)"""
)
def seg_cost(spark, d):
    """Cost of the best unigram split of every distinct Chinese word."""
    words = table(spark, d, "terms").where("word <> ''").select("word").distinct()
    return unigram_costs(words, lexicon(spark, d)).select("word", F.round("cost", 4).alias("cost"))


# Trained tables.
_PLACES = "p AS (SELECT doc_id, pos, x.sent_no, x.word, x.tag FROM (SELECT doc_id, pos, arg_max({'sent_no': sent_no, 'word': word, 'tag': part_of_speech_tag}, (analyzed_at, row_id)) AS x FROM terms WHERE doc_id IS NOT NULL AND pos IS NOT NULL GROUP BY ALL) WHERE regexp_full_match(x.tag, '[A-Z]{2}'))"
_TAGS = f"{_PLACES}, t AS (SELECT tag, sum(n) + 1 AS n FROM (SELECT tag, 1 AS n FROM p UNION ALL SELECT unnest({list(md.REQUIRED_TAGS)}), 0) GROUP BY tag)"


def places(spark, d):
    return md.tagged_places(table(spark, d, "terms"))


@query(f"WITH {_TAGS} SELECT tag, round((-ln(n / (SELECT sum(n) FROM t)))::FLOAT::DOUBLE, 4) AS cost FROM t")
def scan_hmm_tags(spark, d):
    """Tag set of the tagger with costs."""
    return md.tag_set(places(spark, d)).withColumn("cost", F.round(F.col("cost").cast("double"), 4))


@query(
    f"""WITH {_TAGS}, s AS (SELECT coalesce(c.tag, 'BOS') AS tag1, coalesce(b.tag, 'BOS') AS tag2, a.tag AS tag3, count(*) AS n FROM p a
      LEFT JOIN p b ON b.doc_id = a.doc_id AND b.sent_no = a.sent_no AND b.pos = a.pos - 1 LEFT JOIN p c ON c.doc_id = a.doc_id AND c.sent_no = a.sent_no AND c.pos = a.pos - 2 GROUP BY ALL),
    f AS (SELECT x.tag AS tag1, y.tag AS tag2, z.tag AS tag3, coalesce(s.n, 0) + 1 AS n FROM t x, t y, t z LEFT JOIN s ON s.tag1 = x.tag AND s.tag2 = y.tag AND s.tag3 = z.tag WHERE z.tag <> 'BOS')
    SELECT tag1, tag2, tag3, round((-ln(n / (sum(n) OVER (PARTITION BY tag1, tag2))))::FLOAT::DOUBLE, 4) AS cost FROM f"""
)
def hmm(spark, d):
    """Tag trigram costs trained from tagged words."""
    p = places(spark, d)
    return md.tag_trigrams(p, md.tag_set(p)).withColumn("cost", F.round(F.col("cost").cast("double"), 4))


@query(
    f"""WITH {_PLACES}, c AS (SELECT tag, word, count(*) AS n FROM p GROUP BY ALL)
    SELECT tag, term_id, round((-ln(n / m))::FLOAT::DOUBLE, 4) AS cost FROM c JOIN (SELECT tag, sum(n) AS m FROM c GROUP BY tag) USING (tag) JOIN lexicon USING (word)"""
)
def scan_hmm_emits(spark, d):
    """Emission costs of dictionary words."""
    return md.emissions(places(spark, d), lexicon(spark, d)).withColumn("cost", F.round(F.col("cost").cast("double"), 4))


_FEATURES = """list_concat(['B:' || word[1:1], 'E:' || word[-1:]], list_transform(range(2, length(word)), lambda k: 'M:' || word[k:k]))"""


@query(f"SELECT word, unnest({_FEATURES}) AS feature FROM (SELECT DISTINCT word FROM terms WHERE length(word) >= 2)")
def name_features(spark, d):
    """Features of every distinct word: first, last and middle characters."""
    return md.name_features(table(spark, d, "terms").select("word").distinct()).select("word", "feature")


_WEIGHTS = f"""{_PLACES}, f AS (SELECT y, unnest({_FEATURES}) AS feature FROM (SELECT DISTINCT word, CASE WHEN tag = 'NR' THEN 'T' ELSE 'F' END AS y FROM p WHERE length(word) >= 2)),
    w AS (SELECT y, feature, ln((n + 1) / ((sum(n) OVER (PARTITION BY feature)) + 2))::FLOAT AS weight FROM (SELECT y, feature, count(*) AS n FROM f GROUP BY ALL))"""


@query(f"WITH {_WEIGHTS} SELECT y, feature, round(weight::DOUBLE, 4) AS weight FROM w")
def maxent(spark, d):
    """Weights of the person-name classifier."""
    return md.name_weights(places(spark, d)).withColumn("weight", F.round(F.col("weight").cast("double"), 4))


@query(
    f"""WITH {_WEIGHTS}, s AS (SELECT word, y, sum(weight::DOUBLE) AS s FROM (SELECT word, unnest({_FEATURES}) AS feature FROM (SELECT DISTINCT word FROM terms WHERE length(word) >= 2)) JOIN w USING (feature) GROUP BY ALL),
    a AS (SELECT word, y, coalesce(s, 0) AS s FROM (SELECT word, y FROM (SELECT DISTINCT word FROM terms WHERE length(word) >= 2), (SELECT DISTINCT y FROM w)) LEFT JOIN s USING (word, y))
    SELECT word, arg_min(y, (-round(s, 9), y)) AS y FROM a GROUP BY word"""
)
def maxent_classify(spark, d):
    """Class of every distinct word."""
    return md.classify(table(spark, d, "terms").select("word"), md.name_weights(places(spark, d)))
