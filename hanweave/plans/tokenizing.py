"""Queries of the tokenizer."""

from __future__ import annotations

from pyspark.sql import functions as F

from hanweave.functions import tokens as tk
from hanweave.plans.queries import query
from hanweave.session import table, wide_table

_TOKENS = f"(SELECT doc_id, unnest({tk.tokens_sql('text')}) AS token FROM documents)"


def _rule_query(rule: str):
    @query(f"SELECT token, count(*) AS n FROM {_TOKENS} WHERE ({tk.rule_sql('token')}) = '{rule}' GROUP BY token", name=f"tok_{rule}")
    def run(spark, d):
        tokens = wide_table(spark, d, "documents", "text").select(F.explode(tk.tokens(F.col("text"))).alias("token"))
        return tokens.groupBy("token").agg(F.count("*").alias("n")).where(tk.token_rule(F.col("token")) == rule)


for _rule in [name for name, _, _ in tk.RULES] + ["other2", "other4", "ascii"]:
    _rule_query(_rule)


@query("SELECT doc_id, 0 AS type FROM documents WHERE text IS NOT NULL")
def tok_eof(spark, d):
    """The end token of every text."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.lit(tk.TOKEN_TYPES["end"]).alias("type"))


@query(
    f"""SELECT doc_id, pos - 1 AS pos, token, type, ({tk.word_type_sql('type')}) AS word_type FROM (SELECT doc_id, pos, token, ({tk.type_sql('token')}) AS type
    FROM (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {tk.tokens_sql('text')} AS t FROM documents)))"""
)
def tokenize(spark, d):
    """Every token of every text with its type and the type of word it becomes."""
    df = wide_table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(tk.tokens(F.col("text"))).alias("pos", "token"))
    typed = df.withColumn("type", tk.token_type(F.col("token")))
    return typed.select("doc_id", F.col("pos").cast("long").alias("pos"), "token", "type", tk.word_type_of(F.col("type")).alias("word_type"))


@query(f"SELECT line_id, unnest({tk.tokens_sql('l')}) AS token FROM (SELECT line_id, unnest(list_transform(string_split(buf, chr(10)), lambda x: x || chr(10))) AS l FROM corpus_lines)")
def tokenize_lines(spark, d):
    """Line mode: each line ends with its own LF token."""
    lines = F.explode(F.transform(F.split("buf", "\n"), lambda x: F.concat(x, F.lit("\n"))))
    return table(spark, d, "corpus_lines").select("line_id", lines.alias("line")).select("line_id", F.explode(tk.tokens(F.col("line"))).alias("token"))


@query(
    f"""SELECT doc_id, sent_id - 1 AS sent_id, len(s) AS n_tokens, array_to_string(s, '') AS sentence FROM (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS sent_id
    FROM (SELECT doc_id, {tk.sentences_sql('text')} AS x FROM documents))"""
)
def sentence_split(spark, d):
    """Every sentence of every text."""
    df = wide_table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(tk.sentences(F.col("text"))).alias("sent_id", "s"))
    return df.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.size("s").cast("long").alias("n_tokens"), F.array_join("s", "").alias("sentence"))


@query("SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) || chr(10) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def scan_lines(spark, d):
    """Lines of every text, LF kept."""
    df = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return df.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.concat("line", F.lit("\n")).alias("line"))


@query("SELECT doc_id, list_transform(regexp_extract_all(text, '(?s:.)'), lambda c: unicode(c)) AS code_points FROM documents")
def utf8_decode(spark, d):
    """Code points of every text."""
    chars = F.regexp_extract_all("text", F.lit("(?s:.)"), F.lit(0))
    # The code point of a character: its UTF-32 form read as a number.
    point = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")
    return table(spark, d, "documents").select("doc_id", F.transform(chars, point).alias("code_points"))


@query("SELECT term_id, word AS text FROM lexicon")
def utf8_encode(spark, d):
    """Code points of every dictionary word turned into text again."""
    chars = F.regexp_extract_all("word", F.lit("(?s:.)"), F.lit(0))
    points = F.transform(chars, lambda c: F.hex(F.encode(c, "UTF-32")))
    text = F.array_join(F.transform(points, lambda p: F.decode(F.unhex(p), "UTF-32")), "")
    return table(spark, d, "lexicon").select("term_id", text.alias("text"))
