"""Dictionaries as tables: lookup, prefixes, merging of user words, building from counts.

Joins are plain equi-joins; whether a dictionary is broadcast is left to its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanweave.operators.decode import DEFAULT_COST, USER_ID_START
from hanweave.session import checkpointed, task_count


def prefixes(df: DataFrame, word: str, name: str = "prefix") -> DataFrame:
    """A row for each prefix of each word, the word itself included."""
    return df.withColumn(name, F.explode(F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.substring(F.col(word), F.lit(1), k)))).where(F.length(word) > 0)


def prefix_states(dictionary: DataFrame) -> DataFrame:
    """`prefix`, `state` of a walk: the term id, or -1 for a prefix that is no word."""
    return prefixes(dictionary.select("word", "term_id"), "word").groupBy("prefix").agg(F.coalesce(F.max(F.when(F.col("prefix") == F.col("word"), F.col("term_id"))), F.lit(-1)).alias("state"))


def lookup(df: DataFrame, dictionary: DataFrame, word: str = "word", name: str = "term_id") -> DataFrame:
    """`df` with the term id of its word, null if unknown."""
    return df.join(dictionary.select(F.col("word").alias(word), F.col("term_id").alias(name)), word, "left")


def merge_user(system: DataFrame, user: DataFrame) -> DataFrame:
    """`word`, `term_id`, `cost`: the system's id wins; a user cost overrides unless it is the default; other user words get user ids in byte order.

    Repeated user words keep their least cost. User words beyond some millions belong in a system dictionary.
    """
    own = user.groupBy("word").agg(F.min("cost").alias("user_cost"))
    new = own.join(system, "word", "left_anti")
    ids = rank_rows(new, F.col("word")).select("word", (F.col("rank") + (USER_ID_START - 1)).cast("int").alias("term_id"), F.col("user_cost").alias("cost"))
    cost = F.when(F.col("user_cost").isNull() | (F.col("user_cost") == DEFAULT_COST), F.col("cost")).otherwise(F.col("user_cost"))
    return system.join(own, "word", "left").select("word", "term_id", cost.alias("cost")).unionByName(ids)


def rank_rows(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """`df` with its rank from 1 in a global order, without moving all rows to one task.

    Rows are range-partitioned and sorted; a row's rank is its place in its partition plus the
    sizes of the partitions before, one number each.
    """
    placed = df.repartitionByRange(task_count(df), *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = checkpointed(placed)
    part = F.shiftrightunsigned("__id", 33).cast("int")
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    return placed.withColumn(name, F.element_at(F.lit(before), part + 1) + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__id")


def build_unigram(counts: DataFrame) -> DataFrame:
    """`word`, `term_id` (1.. in byte order), `cost` = -ln(count / sum), from rows (word, count) that may repeat."""
    sums = counts.where("word IS NOT NULL").groupBy("word").agg(F.sum("count").alias("count"))
    total = sums.agg(F.sum("count")).scalar()
    cost = (-F.log(F.col("count") / total)).cast("float")
    return rank_rows(sums.withColumn("cost", cost), F.col("word")).select("word", F.col("rank").cast("int").alias("term_id"), "cost")


def build_bigram(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """`left_id`, `right_id`, `cost` of pairs of known words; the total is of all pairs, (left, right, count) rows may repeat."""
    sums = counts.where("left IS NOT NULL AND right IS NOT NULL").groupBy("left", "right").agg(F.sum("count").alias("count"))
    total = sums.agg(F.sum("count")).scalar()
    ids = dictionary.select("word", "term_id")
    known = sums.join(ids.toDF("left", "left_id"), "left").join(ids.toDF("right", "right_id"), "right")
    return known.select("left_id", "right_id", (-F.log(F.col("count") / total)).cast("float").alias("cost"))


def last_by(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One row a key with the value of its last row, as a table built by repeated insertion ends up."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))
