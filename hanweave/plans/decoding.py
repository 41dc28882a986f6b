"""Queries of segmentation, CRF and part-of-speech tagging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from hanweave.functions import tokens as tk
from hanweave.functions.utf8 import texts
from hanweave.operators import analyze as an
from hanweave.operators import crf as cf
from hanweave.operators import decode, models as md
from hanweave.plans import decoder_sql as ds
from hanweave.plans.dictionaries import _PLACES, _TAGS, USER_SQL, bigram_costs, lexicon, places, user_words
from hanweave.plans.queries import query
from hanweave.session import checkpointed, map_arrow, table, wide_table


#: Models that a session has trained, by folder and method; a few at most.
_TRAINED: dict[tuple, an.Models] = {}
MOST_TRAINED = 8


def trained_models(spark, d, method="seg", user=None):
    """Models trained from the tables, as far as the method needs them: once a session for each folder and method, unless there are user words."""
    if user is not None:
        return train_models(spark, d, method, user)
    key = (spark.sparkContext.applicationId, d, method)
    if key not in _TRAINED:
        while len(_TRAINED) >= MOST_TRAINED:
            _TRAINED.pop(next(iter(_TRAINED)))
        _TRAINED[key] = train_models(spark, d, method)
    return _TRAINED[key]


def train_models(spark, d, method="seg", user=None):
    segmenter, tagger = an.METHODS[method]
    words = lexicon(spark, d)
    models = an.Models(an.load_dictionary(words, bigram_costs(spark, d), user))
    if segmenter in ("mixed", "crf"):
        models.crf_seg = an.load_crf(list(decode.SEGMENT_TAGS), md.SEGMENT_TEMPLATES, md.segment_features(words))
        models.properties = dict(an.bounded_rows(table(spark, d, "lexicon").where("oov_value IS NOT NULL").select("word", "oov_value")))
    if tagger:
        p = checkpointed(places(spark, d))  # each table is trained from it
        tags = checkpointed(md.tag_set(p))
        names = sorted(r["tag"] for r in tags.select("tag").collect() if r["tag"] != "BOS")
        if tagger != "hmm":
            models.crf_pos = an.load_crf(names, md.POS_TEMPLATES, md.pos_features(p, words))
        if tagger != "crf":
            models.hmm = an.load_hmm(tags, md.tag_trigrams(p, tags), md.emissions(p, words), models.crf_pos)
    return models


def _analyzed(method):
    def run(spark, d):
        return an.analyze(wide_table(spark, d, "documents", "doc_id", "text"), trained_models(spark, d, method), method)

    return run


_TEXTS, _LINES = ds.sentences("documents", "doc_id", "text"), ds.sentences("corpus_lines", "line_id", "buf")


def _method_sql(method: str, of: str = _TEXTS, key: str = "doc_id") -> str:
    segmenter, tagger = an.METHODS[method]
    if tagger is None:
        return ds.parts(of, ds.segmenter(segmenter)) + ds.analyzed(key)
    return ds.parts(of, ds.segmenter(segmenter), ds.tagger(tagger, _PLACES, _TAGS)) + ds.tagged(key)


for _name, _method in (("seg_unigram", "unigram_seg"), ("seg_bigram", "bigram_seg"), ("seg_crf", "crf_seg"), ("seg_mixed", "seg"), ("pos_crf", "crf"), ("pos_hmm", "hmm"), ("pos_mixed", "hmm_crf")):
    query(_method_sql(_method), name=_name)(_analyzed(_method))


@query(_method_sql("hmm_crf"))
def analyze(spark, d):
    """Every word of every text with type and tag, by the default method."""
    return _analyzed("hmm_crf")(spark, d)


@query(ds.parts(_LINES, ds.segmenter("bigram")) + f"SELECT line_id, sent_id, pos, word, term_id FROM ({ds.analyzed('line_id')})")
def backtrace(spark, d):
    """Words of every corpus line by the lattice, in order."""
    return an.analyze(wide_table(spark, d, "corpus_lines", "line_id", "buf"), trained_models(spark, d, "bigram_seg"), "bigram_seg", "line_id", "buf").select("line_id", "sent_id", "pos", "word", "term_id")


@query(ds.parts(_LINES, ds.lattice(ds._SYSTEM, True)) + "SELECT line_id, round(arg_max(beams[-1][1].c, sent_id), 4) AS cost FROM corpus_lines LEFT JOIN (d JOIN s USING (toks) JOIN m USING (sid)) USING (line_id) GROUP BY line_id")
def path_cost(spark, d):
    """Cost of the last sentence of every corpus line."""
    costs = an.path_costs(wide_table(spark, d, "corpus_lines", "line_id", "buf"), trained_models(spark, d, "bigram_seg"), True, "line_id", "buf")
    return costs.withColumn("cost", F.round("cost", 4))


def _lists_sql(segmenter: str) -> str:
    """Of each corpus line the list of its words; null for null, empty for empty text."""
    word = ds.marked("word", "word_type")
    return f"""SELECT line_id, CASE WHEN buf IS NOT NULL THEN coalesce(l, []) END AS words FROM corpus_lines
      LEFT JOIN (SELECT line_id, list({word} ORDER BY sent_id, pos) AS l FROM ({ds.analyzed('line_id')}) GROUP BY line_id) USING (line_id)"""


_MERGED = f"(SELECT word, coalesce(l.t, {decode.USER_ID_START}) AS t, CASE WHEN l.word IS NULL THEN u.cost WHEN u.word IS NULL OR u.cost = {decode.DEFAULT_COST} THEN l.c ELSE u.cost END::DOUBLE AS c FROM {ds._SYSTEM} l FULL JOIN {USER_SQL} u USING (word))"


@query(ds.parts(_LINES, ds.segmenter("bigram", "dw").replace("e AS MATERIALIZED", f"dw AS MATERIALIZED {_MERGED}, e AS MATERIALIZED", 1)) + _lists_sql("bigram"))
def set_userdict(spark, d):
    """Corpus lines segmented with the vocabulary as user words."""
    return an.segment(wide_table(spark, d, "corpus_lines", "line_id", "buf"), trained_models(spark, d, "bigram_seg", user_words(spark, d)), "bigram_seg", "line_id", "buf")


@query(ds.parts(_LINES, ds.segmenter("mixed")) + _lists_sql("mixed"))
def segment_text(spark, d):
    """Words of every corpus line, those not Chinese as one mark."""
    return an.segment(wide_table(spark, d, "corpus_lines", "line_id", "buf"), trained_models(spark, d), "seg", "line_id", "buf")


_TYPES = " ".join(f"WHEN {k} THEN '{n}'" for k, n in tk.TYPE_NAMES.items())


@query(
    ds.parts(_LINES, ds.segmenter("mixed"), ds.tagger("hmm_crf", _PLACES, _TAGS))
    + f"""SELECT line_id, string_agg(CASE WHEN regexp_matches(word, '^[\\r\\n ]') THEN '' ELSE word || '_' || CASE word_type {_TYPES} END || '/' || tag || '  ' END, '' ORDER BY sent_id, pos) AS line
    FROM ({ds.tagged('line_id')}) GROUP BY line_id"""
)
def sink_segmented(spark, d):
    """Lines of words with types and tags, as the command line prints them."""
    lines = wide_table(spark, d, "corpus_lines", "line_id", "buf")
    return an.analyze_lines(lines, trained_models(spark, d, "hmm_crf"), "hmm_crf", "line_id", "buf", types=True, tags=True)


@query(
    ds.parts(_LINES, ds.lattice(ds._SYSTEM, True), ds.words_of_lattice(), ds.suspicious("w"))
    + """SELECT line_id, words FROM d JOIN s USING (toks) JOIN (SELECT sid, run, list(array_to_string(toks[b + 1 : e], '') ORDER BY pos) AS words
      FROM z JOIN s USING (sid) WHERE flag GROUP BY sid, run HAVING count(*) > 1) USING (sid)"""
)
def oov_recognize(spark, d):
    """Runs of suspicious words of every corpus line that the CRF cuts anew."""
    shared = spark.sparkContext.broadcast(trained_models(spark, d))

    def run(batches):
        for batch in batches:
            ids, runs = [], []
            for k, text in enumerate(texts(batch.column(1), "ignore")):
                for tokens, types in tk.split_sentences(text or ""):
                    words, _ = shared.value.dictionary.segment(tokens, True)
                    held = []
                    for (a, b, _), flag in zip([*words, (0, 0, 0)], [*decode.suspicious(words, tokens, types, shared.value.properties), False]):
                        if flag:
                            held.append("".join(tokens[a:b]))
                        else:
                            if len(held) > 1:
                                ids.append(k)
                                runs.append(held)
                            held = []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(runs, pa.list_(pa.string()))], names=["line_id", "words"])

    return map_arrow(table(spark, d, "corpus_lines").select("line_id", "buf"), run, "line_id long, words array<string>")


@query(f"SELECT doc_id, pos - 1 AS pos, CASE WHEN regexp_full_match(token, '[一-龥]') THEN token ELSE '，' END AS feature FROM (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {tk.tokens_sql('text')} AS t FROM documents))")
def crf_seg_features(spark, d):
    """Feature of each token for the segmenting CRF."""
    df = table(spark, d, "documents").select("doc_id", F.posexplode(tk.tokens(F.col("text"))).alias("pos", "token"))
    return df.select("doc_id", F.col("pos").cast("long").alias("pos"), F.when(F.col("token").rlike("^[一-龥]$"), F.col("token")).otherwise("，").alias("feature"))


_MARKS = "WHEN 1 THEN 'A' WHEN 3 THEN 'A' WHEN 2 THEN '1' ELSE '.' END"


@query(f"SELECT row_id, CASE WHEN word_type = 0 THEN word ELSE CASE word_type {_MARKS} END AS f0, CASE WHEN word_type = 0 THEN word[1:1] ELSE CASE word_type {_MARKS} END AS f1, CASE WHEN word_type = 0 THEN word[-1:] ELSE CASE word_type {_MARKS} END AS f2 FROM terms WHERE word <> ''")
def crf_pos_features(spark, d):
    """Three features of each word for the tagging CRF."""
    mark = F.when(F.col("word_type").isin(1, 3), "A").when(F.col("word_type") == 2, "1").otherwise(".")
    chinese = F.col("word_type") == 0
    pick = lambda x: F.when(chinese, x).otherwise(mark)
    words = table(spark, d, "terms").where("word <> ''")
    return words.select("row_id", pick(F.col("word")).alias("f0"), pick(F.substring("word", 1, 1)).alias("f1"), pick(F.substring("word", -1, 1)).alias("f2"))


# The characters of every distinct word as sequences for the segmenting CRF.
_CHARS = "c AS (SELECT word, k - 1 AS place, word[k:k] AS ch, CASE WHEN k = 1 THEN '_B-1' ELSE word[k - 1 : k - 1] END AS before FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM (SELECT DISTINCT word FROM terms WHERE word <> '')))"
_MADE = f"{_CHARS}, m AS (SELECT word, place, 'U00:' || before || '/' || ch AS feature FROM c UNION ALL SELECT word, place, 'U01:' || ch FROM c)"
_TAG = "CASE WHEN n = 1 THEN 'S' WHEN k = 1 THEN 'B' WHEN k = n THEN 'E' WHEN k = 2 THEN 'B1' WHEN k = 3 THEN 'B2' ELSE 'M' END"
_WEIGHTS = f"""l AS (SELECT word, k, n, {_TAG} AS tag FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k, length(word) AS n FROM lexicon)),
    w AS (SELECT feature, tag, ln(1 + count(*))::FLOAT::DOUBLE AS weight FROM (SELECT 'U01:' || word[k:k] AS feature, tag FROM l UNION ALL SELECT 'U00:' || word[k - 1 : k - 1] || '/' || word[k:k], tag FROM l WHERE k > 1) GROUP BY ALL)"""
_SCORES = f"{_MADE}, {_WEIGHTS}, t AS (SELECT unnest({list(decode.SEGMENT_TAGS)}) AS tag), s AS (SELECT word, place, t.tag, coalesce(sum(weight), 0) AS score FROM m CROSS JOIN t LEFT JOIN w ON w.feature = m.feature AND w.tag = t.tag GROUP BY ALL)"


def _made(spark, d):
    words = table(spark, d, "terms").where("word <> ''").select("word").distinct()
    return cf.features(words.withColumn("chars", F.split("word", "")), "word", "chars")


def _scores(spark, d):
    return cf.unigram_scores(_made(spark, d), "word", md.segment_features(lexicon(spark, d)), list(decode.SEGMENT_TAGS))


@query(f"WITH {_MADE} SELECT word, place::INT AS place, feature FROM m")
def crf_template(spark, d):
    """Features of every character of every distinct word."""
    return _made(spark, d)


@query(f"WITH {_WEIGHTS} SELECT feature, tag, round(weight, 6) AS weight FROM w")
def crf_model_access(spark, d):
    """The segmenting CRF's weights of features."""
    return md.segment_features(lexicon(spark, d)).where("left_tag IS NULL").select("feature", "tag", F.round("weight", 6).alias("weight"))


@query(f"WITH {_MADE}, {_WEIGHTS} SELECT word, place::INT AS place, feature FROM m WHERE feature IN (SELECT feature FROM w)")
def crf_features(spark, d):
    """Those features that the model knows."""
    return _made(spark, d).join(md.segment_features(lexicon(spark, d)).select("feature"), "feature", "left_semi").select("word", "place", "feature")


@query(f"WITH {_SCORES} SELECT word, place::INT AS place, tag, round(score, 6) AS score FROM s")
def crf_unigram_score(spark, d):
    """Score of each tag at each place."""
    return _scores(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH {_SCORES} SELECT word, place::INT AS place, tag, round(exp(score) / (sum(exp(score)) OVER (PARTITION BY word, place)), 6) AS p FROM s")
def crf_position_prob(spark, d):
    """Probability of each tag at each place."""
    return cf.probabilities(_scores(spark, d), "word").withColumn("p", F.round("p", 6))


@query(f"WITH {_SCORES} SELECT word, place::INT AS place, tag, round(score + CASE WHEN tag IN ('B', 'S') THEN 0 ELSE -30 END, 6) AS score FROM s WHERE place = 0 OR place = length(word) // 2")
def crf_begin_tag(spark, d):
    """Scores after the begin tag S at the first place of every distinct word and of its second half."""
    first = md.segment_features(lexicon(spark, d)).where("left_tag = 'S'").select("tag", "weight")
    begins = _scores(spark, d).where("place = 0 OR place = length(word) DIV 2")
    return begins.join(F.broadcast(first), "tag").select("word", "place", "tag", F.round(F.col("score") + F.col("weight"), 6).alias("score"))  # six rows


def _crf_tags(begin_tag, end_tag, whole=True):
    def run(spark, d):
        shared = spark.sparkContext.broadcast(trained_models(spark, d, "crf_seg").crf_seg)

        def tag(batches):
            for batch in batches:
                tagged, crf = [], shared.value
                for word in texts(batch.column(0)):
                    rows = [(c,) for c in word]
                    tagged.append([crf.tags[t] for t in crf.tag(rows, 0 if whole else len(rows) // 2, None, begin_tag, end_tag)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tagged, pa.list_(pa.string()))], names=["word", "tags"])

        return map_arrow(table(spark, d, "terms").where("word <> ''").select("word").distinct(), tag, "word string, tags array<string>")

    return run


_CHARACTERS = """j AS MATERIALIZED (SELECT row_number() OVER () AS jid, word, f, 0 AS b, len(f) AS e
  FROM (SELECT word, regexp_extract_all(word, '(?s:.)') AS f FROM (SELECT DISTINCT word FROM terms WHERE word <> '')))"""


def _tags_sql(begin_tag: int | None, end_tag: int | None, whole: bool = True) -> str:
    jobs = _CHARACTERS if whole else _CHARACTERS.replace("0 AS b", "len(f) // 2 AS b")
    return ds.parts(ds.segment_weights(), jobs, ds.best_tags("j", begin_tag, end_tag)) + f"SELECT word, list_transform(tags, lambda t: ({list(decode.SEGMENT_TAGS)})[t]) AS tags FROM g JOIN j USING (jid)"


query(_tags_sql(None, None), name="crf_viterbi")(_crf_tags(-1, -1))
query(_tags_sql(0, 0), name="crf_tag")(_crf_tags(0, 0))
query(_tags_sql(0, 0, False), name="crf_tag_range")(_crf_tags(0, 0, whole=False))


def _reached_sql() -> str:
    """Forward scores by a fold over the places of each word."""
    return ds.parts(ds.segment_weights(), _CHARACTERS, ds.best_tags("j", None, None)) + f"""SELECT word, k::INT AS place, ({list(decode.SEGMENT_TAGS)})[i] AS tag, round(score, 6) AS score
      FROM (SELECT word, k, unnest(r) AS score, generate_subscripts(r, 1) AS i FROM (SELECT word, unnest(rs) AS r, generate_subscripts(rs, 1) AS k FROM ({ds.reached('g_v')}) JOIN j USING (jid)))"""


@query(_reached_sql())
def crf_transition(spark, d):
    """Best score of reaching each tag at every place after the first of every distinct word."""
    shared = spark.sparkContext.broadcast(trained_models(spark, d, "crf_seg").crf_seg)

    def run(batches):
        for batch in batches:
            out, crf = [], shared.value
            for word in texts(batch.column(0)):
                rows = [(c,) for c in word]
                cost = crf.begin(rows)
                for at in range(1, len(rows)):
                    best, _ = crf.reached(cost, rows, at)
                    out += [(word, at, tag, score) for tag, score in zip(crf.tags, best)]
                    cost = [a + b for a, b in zip(best, crf.scores(rows, at))]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], names=["word", "place", "tag", "score"])

    words = table(spark, d, "terms").where("word <> ''").select("word").distinct()
    return map_arrow(words, run, "word string, place int, tag string, score double").withColumn("score", F.round("score", 6))


_KNOWN_EMITS = f"WITH {_PLACES}, e AS (SELECT DISTINCT tag, word FROM p JOIN lexicon USING (word))"
_DEFAULTS = "(SELECT unnest(['PU', 'PU', 'PU', 'CD', 'NN', 'NR', 'VA', 'VV', 'NN']) AS tag, unnest([4, 3, 5, 2, 1, 0, 0, 0, 0]) AS word_type)"


@query(f"SELECT tag, word_type FROM {_DEFAULTS}")
def pos_default_emit(spark, d):
    """Tags of words without an emission, by word type."""
    rows = [(t, k) for k, t in decode.TYPE_TAGS.items()] + [(t, 0) for t in decode.OOV_TAGS]
    return spark.createDataFrame(rows, "tag string, word_type int")


@query(f"{_KNOWN_EMITS} SELECT row_id, tag FROM terms JOIN e USING (word) UNION ALL SELECT row_id, tag FROM terms JOIN {_DEFAULTS} USING (word_type) WHERE coalesce(word, '') NOT IN (SELECT word FROM e)")
def pos_emit(spark, d):
    """Tags that each word may have: by the dictionary, else by word type."""
    known = md.emissions(places(spark, d), lexicon(spark, d)).join(lexicon(spark, d).select("term_id", "word"), "term_id").groupBy("word").agg(F.collect_set("tag").alias("known"))
    kinds = pos_default_emit(spark, d).groupBy("word_type").agg(F.collect_list("tag").alias("usual"))
    words = table(spark, d, "terms").select("row_id", "word", "word_type").join(known, "word", "left").join(F.broadcast(kinds), "word_type", "left")  # six rows
    return words.select("row_id", F.explode(F.coalesce("known", "usual")).alias("tag"))


@query(f"WITH {_PLACES} SELECT 'BOS' AS tag1, 'BOS' AS tag2, tag AS tag3, count(*) AS n FROM p WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.doc_id = p.doc_id AND b.sent_no = p.sent_no AND b.pos = p.pos - 1) AND NOT EXISTS (SELECT 1 FROM p b WHERE b.doc_id = p.doc_id AND b.sent_no = p.sent_no AND b.pos = p.pos - 2) GROUP BY tag")
def pos_bos(spark, d):
    """Tags that begin: how often each follows two begin marks."""
    here = places(spark, d).select("doc_id", "sent_no", "pos", "tag")
    keys = ["doc_id", "sent_no", "pos"]
    for k in (1, 2):
        here = here.join(here.select("doc_id", "sent_no", (F.col("pos") + k).alias("pos")) if k == 1 else places(spark, d).select("doc_id", "sent_no", (F.col("pos") + k).alias("pos")), keys, "left_anti")
    return here.groupBy(F.col("tag").alias("tag3")).agg(F.count("*").alias("n")).select(F.lit("BOS").alias("tag1"), F.lit("BOS").alias("tag2"), "tag3", "n")


@query(ds.parts(_LINES, ds.segmenter("mixed"), ds.tagger("hmm", _PLACES, _TAGS)) + f"SELECT line_id, sent_id, list(tag ORDER BY pos) AS tags FROM ({ds.tagged('line_id')}) GROUP BY ALL")
def pos_backtrace(spark, d):
    """Tag sequence of each sentence of every corpus line."""
    found = an.analyze(wide_table(spark, d, "corpus_lines", "line_id", "buf"), trained_models(spark, d, "hmm"), "hmm", "line_id", "buf")
    tags = F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"])
    return found.groupBy("line_id", "sent_id").agg(tags.alias("tags"))
