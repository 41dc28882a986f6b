"""Queries of the general data problems: rows that do not parse, keys that hold most rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from hanweave.operators import rejects, skew
from hanweave.plans.queries import query
from hanweave.session import table

# The line grammar once more as regular expressions, for the SQL.
_FIELD = '"(?:[^"]|"")*"|[^ \\t\\r\\n"][^ \\t\\r\\n]*'
_LINE = f"[ \\t\\r\\n]*(?:(?:{_FIELD})(?:[ \\t\\r\\n]+|$))*"


def _parsed_sql(table_name: str, keep: str, n_fields: int, count_ok: str) -> str:
    words = " OR ".join(f"w[{k}] = '' OR strlen(w[{k}]) > 99 OR regexp_matches(w[{k}], '[\\x00-\\x1f\\x7f-\\x{{9f}}\\x{{fffd}}]')" for k in range(1, n_fields))
    return f"""(SELECT *, CASE WHEN NOT coalesce(regexp_full_match(raw, '{_LINE}'), true) THEN 'quoting'
        WHEN coalesce(len(w), 0) <> {n_fields} THEN 'columns' WHEN {words} OR NOT ({count_ok}) THEN 'value' END AS reason
      FROM (SELECT {keep}, raw, list_transform(regexp_extract_all(raw, '{_FIELD}'), lambda x: CASE WHEN x[1] = '"'
        THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS w FROM {table_name}))"""


_UNIGRAM_OK = "regexp_full_match(w[2], '[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?') AND isfinite(coalesce(try_cast(w[2] AS DOUBLE), 0)) AND coalesce(try_cast(w[2] AS DOUBLE), 0) > 0"
_BIGRAM_OK = "regexp_full_match(w[3], '[0-9]+') AND coalesce(try_cast(w[3] AS HUGEINT), 0) BETWEEN 1 AND 2147483647"
UNIGRAM_SQL = _parsed_sql("unigram_raw", "raw_id, file_name", 2, _UNIGRAM_OK)
BIGRAM_SQL = _parsed_sql("bigram_raw", "raw_id, file_name", 3, _BIGRAM_OK)


def unigram_lines(spark, d):
    return rejects.parse_counts(table(spark, d, "unigram_raw"), rejects.UNIGRAM, keep=("raw_id", "file_name"))


def bigram_lines(spark, d):
    return rejects.parse_counts(table(spark, d, "bigram_raw"), rejects.BIGRAM, keep=("raw_id", "file_name"))


@query(
    f"""SELECT 'unigram' AS tab, raw_id, reason FROM {UNIGRAM_SQL} WHERE reason IS NOT NULL
    UNION ALL SELECT 'bigram', raw_id, reason FROM {BIGRAM_SQL} WHERE reason IS NOT NULL"""
)
def p4_found(spark, d):
    """Every line that does not parse, with the reason."""
    found = [
        rejects.rejected_rows(lines).select(F.lit(tab).alias("tab"), "raw_id", "reason")
        for tab, lines in (("unigram", unigram_lines(spark, d)), ("bigram", bigram_lines(spark, d)))
    ]
    return found[0].unionByName(found[1])


@query(f'SELECT raw_id, file_name, w[1] AS word, w[2]::DOUBLE AS "count" FROM {UNIGRAM_SQL} WHERE reason IS NULL')
def p4_unigram_rows(spark, d):
    """The valid unigram lines as typed columns."""
    return rejects.valid_rows(unigram_lines(spark, d))


@query(f'SELECT raw_id, file_name, w[1] AS "left", w[2] AS "right", w[3]::INT AS "count" FROM {BIGRAM_SQL} WHERE reason IS NULL')
def p4_bigram_rows(spark, d):
    """The valid bigram lines as typed columns."""
    return rejects.valid_rows(bigram_lines(spark, d))


@query(
    """SELECT 'terms' AS tab, word AS hot_key FROM terms WHERE word <> '' GROUP BY word
       HAVING count(*) * 50 >= (SELECT count(*) FROM terms WHERE word <> '')
    UNION ALL SELECT 'adjacents', left_id::VARCHAR FROM adjacents WHERE left_id IS NOT NULL GROUP BY left_id
       HAVING count(*) * 50 >= (SELECT count(left_id) FROM adjacents)"""
)
def p5_found(spark, d):
    """Keys with at least one fiftieth of the rows that have a key."""
    hot_words = skew.hot_keys(table(spark, d, "terms").where("word <> ''"), "word", "doc_id", 50).select(F.lit("terms").alias("tab"), F.col("word").alias("hot_key"))
    hot_lefts = skew.hot_keys(table(spark, d, "adjacents"), "left_id", "right_id", 50).select(F.lit("adjacents").alias("tab"), F.col("left_id").cast("string").alias("hot_key"))
    return hot_words.unionByName(hot_lefts)


@query("SELECT word, count(*) AS n_rows, count(DISTINCT doc_id) AS n_distinct FROM terms WHERE word <> '' GROUP BY word")
def p5_words(spark, d):
    """Rows and documents of every word."""
    return skew.per_key(table(spark, d, "terms").where("word <> ''"), "word", "doc_id")


@query("SELECT left_id, count(*) AS n_rows, count(DISTINCT right_id) AS n_distinct FROM adjacents WHERE left_id IS NOT NULL GROUP BY left_id")
def p5_left_neighbours(spark, d):
    """Rows and right neighbours of every left neighbour."""
    return skew.per_key(table(spark, d, "adjacents"), "left_id", "right_id")


@query(
    """SELECT adj_id, left_id, a.word, l.word AS left_word, cost FROM adjacents a
       JOIN (SELECT term_id + 536870912 AS left_id, word, cost FROM lexicon UNION ALL SELECT 805306368, '-NOT-CJK-', NULL) l USING (left_id)"""
)
def p5_join(spark, d):
    """Each occurrence with its left neighbour's dictionary entry."""
    words = table(spark, d, "lexicon").select((F.col("term_id") + 0x20000000).alias("left_id"), F.col("word").alias("left_word"), "cost")
    other = spark.range(1).select(F.lit(0x30000000).alias("left_id"), F.lit("-NOT-CJK-").alias("left_word"), F.lit(None).cast("float").alias("cost"))
    return skew.balanced_join(table(spark, d, "adjacents").select("adj_id", "left_id", "word"), words.unionByName(other), "left_id")
