"""Queries of sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hanweave.api import ModelTables
from hanweave.functions import tokens as tk
from hanweave.operators import decode
from hanweave.operators import models as md
from hanweave.operators.analyze import bounded_rows
from hanweave.operators.dictionary import prefix_states
from hanweave.plans import decoder_sql as ds
from hanweave.plans.dictionaries import lexicon, places
from hanweave.plans.queries import ORACLES, query
from hanweave.session import shared_folder, table
from hanweave.sources import binary_models, crf_binary
from hanweave.sources import text as src
from hanweave.streaming import stream as st


@query("SELECT trim(word) AS word, CASE WHEN cnt IS NULL THEN 16.0 ELSE cnt END::FLOAT AS cost FROM vocab_entries WHERE word <> '' AND NOT regexp_matches(word, '[ \\t\\r\\n]')")
def scan_userdict(spark, d):
    """Lines `word[ cost]` parsed as a user dictionary, of words without white space only; `scan_userdict_lines` has all."""
    rows = table(spark, d, "vocab_entries").where("word <> ''").where(~F.col("word").rlike("[ \\t\\r\\n]"))
    return src.parse_user_dictionary(rows.select(F.concat_ws(" ", "word", F.col("cnt").cast("string")).alias("value")))


@query(
    r"""SELECT trim(CASE WHEN k > 0 THEN line[1 : k - 1] ELSE line END, e' \t\r\n') AS word, (CASE WHEN k > 0 THEN coalesce(try_cast(regexp_extract(line[k:], '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1) AS DOUBLE), 0) ELSE 16 END)::FLOAT AS cost
    FROM (SELECT line, instr(line, ' ') AS k FROM (SELECT unnest(string_split(concat_ws(' ', word, cnt::VARCHAR), chr(10))) AS line FROM vocab_entries WHERE word <> ''))"""
)
def scan_userdict_lines(spark, d):
    """All vocabulary lines parsed as a user dictionary: cut at the first blank, the rest is the cost, 0 where it begins with no number."""
    rows = table(spark, d, "vocab_entries").where("word <> ''").select(F.concat_ws(" ", "word", F.col("cnt").cast("string")).alias("value"))
    return src.parse_user_dictionary(rows.select(F.explode(F.split("value", "\n")).alias("value")))


@query("SELECT word, oov_value AS value FROM lexicon WHERE oov_value IS NOT NULL")
def scan_dict(spark, d):
    """Lines `word int`."""
    rows = table(spark, d, "lexicon").where("oov_value IS NOT NULL")
    return src.parse_dictionary(rows.select(F.concat_ws("\t", "word", F.col("oov_value").cast("string")).alias("value")))


@query(
    f"""SELECT 'trans' AS part, concat_ws(' ', tag1, tag2, tag3) AS name, cost FROM ({ORACLES['hmm']})
    UNION ALL SELECT 'emit', concat_ws(' ', tag, term_id::VARCHAR), cost FROM ({ORACLES['scan_hmm_emits']})"""
)
def scan_hmm_text(spark, d):
    """Trained tables written as lines and parsed again: tag set, transitions and emissions."""
    p = places(spark, d)
    tags = md.tag_set(p)
    line = lambda df, *c: df.select(F.concat_ws(" ", *[F.col(x).cast("string") for x in c]).alias("value"))
    parsed_tags = src.parse_tag_set(line(tags, "tag", "cost"))
    trans = src.parse_transitions(line(md.tag_trigrams(p, tags), "tag1", "tag2", "tag3", "cost"))
    emits = line(md.emissions(p, lexicon(spark, d)).join(lexicon(spark, d).select("term_id", "word"), "term_id"), "tag", "word", "cost")
    emits = src.resolve_emissions(src.parse_emissions(emits), parsed_tags, lexicon(spark, d))
    both = trans.select(F.lit("trans").alias("part"), F.concat_ws(" ", "tag1", "tag2", "tag3").alias("name"), "cost").unionByName(emits.select(F.lit("emit").alias("part"), F.concat_ws(" ", "tag", F.col("term_id").cast("string")).alias("name"), "cost"))
    return both.withColumn("cost", F.round(F.col("cost").cast("double"), 4))


@query(
    ds.parts(ds.segment_weights(), f"t AS (SELECT unnest({list(decode.SEGMENT_TAGS)}) AS tag, unnest(range(1, 7)) AS k)")
    + f"""SELECT feature, NULL::VARCHAR AS left_tag, tag, round(v[k], 4) AS weight FROM fv, t
    UNION ALL SELECT 'B', l.tag, r.tag, {ds._MOVES}[r.k][l.k]::DOUBLE FROM t l, t r"""
)
def scan_crf(spark, d):
    """The segmenting CRF written as a binary model file and read again."""
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}.crf"
    crf_binary.write_crf(spark, path, list(decode.SEGMENT_TAGS), md.SEGMENT_TEMPLATES, md.segment_features(lexicon(spark, d)))
    return crf_binary.read_crf(spark, path).table(spark).withColumn("weight", F.round("weight", 4))


@query(ORACLES["scan_hmm_text"])
def scan_hmm(spark, d):
    """The trained tag tables written as a binary model file and read again."""
    p, path = places(spark, d), f"{shared_folder(spark)}/model-{uuid.uuid4().hex}.hmm"
    tags = md.tag_set(p)
    tables = tags, md.tag_trigrams(p, tags), md.emissions(p, lexicon(spark, d)).select("tag", "term_id", "cost")
    crf_binary.write_bytes(spark, path, binary_models.tag_model_bytes(*map(bounded_rows, tables)))
    _, trans, emits = binary_models.read_tag_model(spark, path)
    trans = trans.where("tag3 <> 'BOS'").select(F.lit("trans").alias("part"), F.concat_ws(" ", "tag1", "tag2", "tag3").alias("name"), "cost")
    both = trans.unionByName(emits.select(F.lit("emit").alias("part"), F.concat_ws(" ", "tag", F.col("term_id").cast("string")).alias("name"), "cost"))
    return both.withColumn("cost", F.round(F.col("cost").cast("double"), 4))


@query(f"SELECT y, feature, coalesce(weight, 0) AS weight FROM (SELECT y, feature FROM (SELECT DISTINCT y FROM ({ORACLES['maxent']})), (SELECT DISTINCT feature FROM ({ORACLES['maxent']}))) LEFT JOIN ({ORACLES['maxent']}) USING (y, feature)")
def scan_maxent(spark, d):
    """The classifier's weights written as a binary model file and read again: all features of all classes."""
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}.maxent"
    rows = list(bounded_rows(md.name_weights(places(spark, d)).select("y", "feature", "weight")))
    crf_binary.write_bytes(spark, path, binary_models.classifier_bytes(rows))
    return binary_models.read_classifier(spark, path).withColumn("weight", F.round(F.col("weight").cast("double"), 4))


@query(ORACLES["maxent"])
def scan_maxent_text(spark, d):
    """Classifier weights written as lines and parsed again."""
    w = md.name_weights(places(spark, d))
    parsed = src.parse_weights(w.select(F.concat_ws(" ", "y", "feature", F.col("weight").cast("string")).alias("value")))
    return parsed.withColumn("weight", F.round(F.col("weight").cast("double"), 4))


@query("SELECT line_id, buf || chr(10) AS value FROM corpus_lines")
def sink_lines(spark, d):
    """Lines with their LF."""
    return table(spark, d, "corpus_lines").select("line_id", F.concat("buf", F.lit("\n")).alias("value"))


@query("SELECT word || ' ' || printf('%.5f', coalesce(cost, 16.0)::DOUBLE) AS line FROM lexicon")
def sink_costs(spark, d):
    """The dictionary as lines with costs at five decimals."""
    return src.cost_lines(lexicon(spark, d))


@query(f"SELECT strftime(read_at, '%Y-%m-%d') AS day, token, count(*) AS n FROM (SELECT read_at, unnest({tk.tokens_sql('buf')}) AS token FROM corpus_lines WHERE read_at IS NOT NULL) GROUP BY ALL")
def scan_stdin(spark, d):
    """The corpus lines read as a stream of files: tokens by window of the time they were read."""
    stream = st.read_table_stream(spark, f"{d}/corpus_lines.parquet*", table(spark, d, "corpus_lines").schema)
    counts = st.token_counts(stream, "read_at", "buf", "1 day")
    return st.run_once(counts, "complete").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "token", "n")


@query("SELECT word, term_id, coalesce(cost, 16.0)::FLOAT AS cost FROM lexicon")
def dict_save_open(spark, d):
    """The dictionary written as a model table and opened again."""
    folder = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    ModelTables(lexicon(spark, d)).save(folder)
    return ModelTables.load(spark, folder).dictionary


@query("SELECT prefix, max(term_id) AS state FROM (SELECT word AS prefix, term_id FROM lexicon UNION ALL SELECT unnest(list_transform(range(1, length(word)), lambda k: word[1:k])), -1 FROM lexicon) GROUP BY prefix")
def dict_build(spark, d):
    """All prefixes of the dictionary with the state that a walk has there."""
    return prefix_states(lexicon(spark, d))


@query("SELECT adj_id, corpus_id, line_no, pos, word, left_id, right_id FROM adjacents")
def sink_binary(spark, d):
    """A table written and read back."""
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    src.write_table(table(spark, d, "adjacents").drop("seen_at"), folder)
    return spark.read.parquet(folder)


@query()
def scan_binary(spark, d):
    """Files with their lengths and the SHA-256 of their contents."""
    files = src.read_binary(spark, f"{d}/lexicon.parquet")
    return files.select("path", "length", F.length("content").cast("long").alias("n_read"), F.sha2("content", 256).alias("sha256"))
