"""Text sources and sinks of corpora, dictionaries, count files and model tables.

Parsers take a table of lines (`value`), so they serve files, tables and streams alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hanweave.operators.decode import DEFAULT_COST

_BLANK = "[ \\t\\r\\n]+"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """`value`: lines without their LF; a CR before it stays, as it is a token's part."""
    return spark.read.option("lineSep", "\n").text(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """`path`, `length`, `content` of whole files of up to 2 GB; without `content` in the plan no file is opened."""
    return spark.read.format("binaryFile").load(path)


def lines_of(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """`id_col`, `line_no`, `value`: each text's lines with their LF, as line mode sees them. Null texts give none."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "value"))
    return lines.withColumn("value", F.concat("value", F.lit("\n")))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_BLANK}|{_BLANK}$", "")


def _number(c: Column) -> Column:
    """The number that a text begins with, 0 if it begins with none."""
    head = F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(F.when(head != "", head.cast("double")), F.lit(0.0))


def _fail_if(bad: Column, message: str, value: Column) -> Column:
    """`value`, or the query fails: a malformed model file is an error, not a reject."""
    return F.when(bad, F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(F.col("value"), F.lit("null"))))).otherwise(value)


def _require_rows(lines: DataFrame, what: str) -> DataFrame:
    if not lines.head(1):
        raise ValueError(f"{what} is empty")
    return lines


def parse_user_dictionary(lines: DataFrame) -> DataFrame:
    """`word`, `cost` of lines `word[ cost]`: cut at the first blank, both trimmed, without a cost the default. An empty file is an error."""
    _require_rows(lines, "the user dictionary")
    at = F.instr("value", " ")
    word = F.when(at > 0, F.substring(F.col("value"), F.lit(1), at - 1)).otherwise(F.col("value"))
    cost = F.when(at > 0, _number(F.substring(F.col("value"), at, F.length("value")))).otherwise(F.lit(DEFAULT_COST))
    return lines.where("value IS NOT NULL").select(_trim(word).alias("word"), cost.cast("float").alias("cost"))


def _fields(lines: DataFrame, n: int, what: str) -> DataFrame:
    """Lines of exactly n fields cut at white space; any other fails."""
    parts = F.split(_trim(F.col("value")), _BLANK)
    return lines.select("value", _fail_if(F.coalesce(F.size(parts), F.lit(0)) != n, what, parts).alias("f"))


def parse_dictionary(lines: DataFrame) -> DataFrame:
    """`word`, `value` of lines `word int`."""
    f = _fields(lines, 2, "not a word and a number")
    return f.select(F.col("f")[0].alias("word"), F.col("f")[1].cast("int").alias("value"))


def parse_tag_set(lines: DataFrame) -> DataFrame:
    """`tag`, `cost`."""
    f = _fields(lines, 2, "not a tag and a cost")
    return f.select(F.col("f")[0].alias("tag"), F.col("f")[1].cast("float").alias("cost"))


def parse_transitions(lines: DataFrame) -> DataFrame:
    """`tag1`, `tag2`, `tag3`, `cost`."""
    f = _fields(lines, 4, "not three tags and a cost")
    return f.select(*[F.col("f")[k].alias(f"tag{k + 1}") for k in range(3)], F.col("f")[3].cast("float").alias("cost"))


def parse_emissions(lines: DataFrame) -> DataFrame:
    """`tag`, `word`, `cost`."""
    f = _fields(lines, 3, "not a tag, a word and a cost")
    return f.select(F.col("f")[0].alias("tag"), F.col("f")[1].alias("word"), F.col("f")[2].cast("float").alias("cost"))


def parse_weights(lines: DataFrame) -> DataFrame:
    """`y`, `feature`, `weight`."""
    f = _fields(lines, 3, "not a class, a feature and a weight")
    return f.select(F.col("f")[0].alias("y"), F.col("f")[1].alias("feature"), F.col("f")[2].cast("float").alias("weight"))


def resolve_emissions(emits: DataFrame, tags: DataFrame, dictionary: DataFrame) -> DataFrame:
    """`tag`, `term_id`, `cost`: words that the dictionary lacks are left out, a tag that the tag set lacks is an error."""
    known = emits.join(dictionary.select("word", "term_id"), "word").join(tags.select(F.col("tag").alias("__tag")), F.col("tag") == F.col("__tag"), "left")
    tag = F.when(F.col("__tag").isNull(), F.raise_error(F.concat(F.lit("unknown tag: "), F.col("tag")))).otherwise(F.col("tag"))
    return known.select(tag.alias("tag"), "term_id", "cost")


def write_lines(df: DataFrame, path: str, column: str = "line", mode: str = "error") -> None:
    """One line a row, each ended by LF; null rows are left out."""
    df.select(column).where(F.col(column).isNotNull()).write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def vocabulary_lines(vocab: DataFrame) -> DataFrame:
    """`line`: `word count`."""
    return vocab.select(F.concat_ws(" ", "word", F.col("count").cast("string")).alias("line"))


def cost_lines(df: DataFrame, value: str = "cost", decimals: int = 5) -> DataFrame:
    """`line`: `word value` with fixed decimals, which can be read back as a user dictionary."""
    return df.select(F.format_string(f"%s %.{decimals}f", F.col("word"), F.col(value).cast("double")).alias("line"))
