"""New-word discovery: vocabulary, candidates, neighbour entropy, mutual information, rank."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanweave.functions.tokens import NOT_CJK, split_tokens
from hanweave.operators import models as md
from hanweave.operators.analyze import USER_ROWS, Models, load_dictionary, segment, segment_with_words
from hanweave.operators.decode import Dictionary
from hanweave.operators.dictionary import rank_rows
from hanweave.session import checkpointed, map_arrow

# Where ids of system words begin, the one id of all other words, part dropped from each list, weight of the entropy.
SYSTEM_ID_START, OTHER_ID = 0x20000000, 0x30000000
REMOVE_RATIO, ALPHA = 0.1, 0.6
#: Decimals of the values that words are ranked by, so that what is equal ranks equal in whatever order it was summed up.
DECIMALS = 9


def vocabulary(words: DataFrame, word: str = "word") -> DataFrame:
    """`word`, `count`; null words are left out."""
    return words.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("count"))


def threshold(total) -> Column:
    """Least count a candidate must exceed."""
    return (F.floor(F.atan(F.lit(1e-7) * total) * 50) + 2).cast("int")


def candidates(vocab: DataFrame, known: DataFrame, name_weights: DataFrame | None = None, least: int | None = None) -> DataFrame:
    """`word`, `count`, `cost` = -ln(count / total) of words above the threshold, of two characters or more, not in `known`, not a name."""
    total = vocab.agg(F.sum("count")).scalar()
    limit = F.lit(least) if least is not None else threshold(total)
    kept = vocab.where((F.col("count") > limit) & (F.length("word") >= 2) & (F.col("word") != NOT_CJK)).join(known.select("word"), "word", "left_anti")
    if name_weights is not None:
        kept = kept.join(md.classify(kept, name_weights).where("y = 'F'").select("word"), "word", "left_semi")
    return kept.select("word", "count", (-F.log(F.col("count").cast("float").cast("double") / total)).cast("float").alias("cost"))


def word_ids(words: DataFrame, candidate_ids: DataFrame, dictionary: DataFrame) -> DataFrame:
    """`words` with `id`: the candidate's, else the system's from SYSTEM_ID_START on, else the one id of all others."""
    system = dictionary.select("word", (F.col("term_id") + SYSTEM_ID_START).alias("__system"))
    joined = words.join(candidate_ids.select("word", F.col("id").alias("__own")), "word", "left").join(system, "word", "left")
    return joined.withColumn("id", F.coalesce("__own", "__system", F.lit(OTHER_ID))).drop("__own", "__system")


def neighbours(lines: DataFrame, words: str = "words") -> DataFrame:
    """`word`, `side`, `neighbour` of each place of each line's list of words; no neighbour beyond the ends. No shuffle."""
    placed = lines.select(words, F.posexplode(words).alias("__k", "word"))
    sides = F.array(
        F.struct(F.lit("left").alias("side"), F.when(F.col("__k") > 0, F.get(words, F.col("__k") - 1)).alias("neighbour")),
        F.struct(F.lit("right").alias("side"), F.get(words, F.col("__k") + 1).alias("neighbour")),
    )
    return placed.select("word", F.inline(sides)).where("neighbour IS NOT NULL")


def adjacency_counts(rows: DataFrame) -> DataFrame:
    """`word`, `side`, `neighbour`, `n`."""
    return rows.groupBy("word", "side", "neighbour").agg(F.count("*").alias("n"))


def adjacency_entropy(counts: DataFrame) -> DataFrame:
    """`word`, `entropy`: the smaller of the natural-log entropies of its left and right neighbours; a side never seen has 0.

    -sum(p ln p) over n of total N is ln N - sum(n ln n) / N, so one aggregation with map-side sums does.
    """
    n = F.col("n")
    sides = counts.groupBy("word").agg(
        *[F.sum(F.when(F.col("side") == s, n)).alias(f"{s}_n") for s in ("left", "right")],
        *[F.sum(F.when(F.col("side") == s, n * F.log(n))).alias(f"{s}_s") for s in ("left", "right")],
    )
    entropy = lambda s: F.coalesce(F.greatest(F.log(F.col(f"{s}_n")) - F.col(f"{s}_s") / F.col(f"{s}_n"), F.lit(0.0)), F.lit(0.0))
    return sides.select("word", F.least(entropy("left"), entropy("right")).alias("entropy"))


def bigram_analyze(df: DataFrame, found: DataFrame, dictionary: DataFrame, bigrams: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = USER_ROWS) -> tuple[DataFrame, DataFrame]:
    """The second pass, by bigrams with the candidates `found` (`word`, `cost`) as user words: its vocabulary, and `word`, `entropy` of every candidate.

    Neighbours that are neither candidates nor in the dictionary are one; a candidate never seen has 0.
    `found` should be checkpointed: it is used several times. Up to USER_ROWS candidates are sent to all
    workers, of more each text gets those that occur in it.
    """
    own = found.select("word", F.round("cost", 5).cast("float").alias("cost"))
    if own.count() <= most:
        second = segment(df, Models(load_dictionary(dictionary, bigrams, own)), "bigram_seg", id_col, text_col)
    else:
        second = segment_with_words(df, load_dictionary(dictionary, bigrams), own, id_col, text_col)
    second = checkpointed(second)
    vocab = checkpointed(vocabulary(second.select(F.explode("words").alias("word"))))
    rows = neighbours(second).join(found.select("word"), "word", "left_semi")
    ids = rows.select("side", F.col("word").alias("__word"), F.col("neighbour").alias("word"))
    names = found.select("word").unionByName(dictionary.select("word")).distinct().withColumn("__known", F.lit(True))
    merged = ids.join(names, "word", "left").select(F.col("__word").alias("word"), "side", F.when(F.col("__known"), F.col("word")).otherwise(NOT_CJK).alias("neighbour"))
    entropy = adjacency_entropy(adjacency_counts(merged)).withColumn("entropy", F.round("entropy", DECIMALS))
    return vocab, found.select("word").join(entropy, "word", "left").na.fill(0.0, ["entropy"])


def mutual_information(vocab: DataFrame, candidate_words: DataFrame, dictionary: DataFrame, bigrams: DataFrame | None = None) -> DataFrame:
    """`word`, `value`: cost of the best split of the word without itself, minus -ln(count / total).

    All words of `vocab` are user words here, with costs at five decimals. Only those that are
    part of a candidate matter, and an equi-join on the parts finds them, so the vocabulary may
    be of any size; a worker sees one candidate's parts at a time. Candidates that `vocab` lacks
    have no value.
    """
    total = vocab.agg(F.sum("count")).scalar()
    own = vocab.join(candidate_words.select("word"), "word", "left_semi").select("word", "count")
    n = F.length("word")
    longest = max(df.agg(F.max(F.length("word"))).first()[0] or 1 for df in (dictionary, vocab))  # no part is longer
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(n - i + 1, F.lit(longest))), lambda k: F.substring(F.col("word"), i, k))))
    parts = own.select(F.col("word").alias("whole"), F.explode(F.array_distinct(spans)).alias("word"))
    parts = parts.join(dictionary.select("word", "term_id", "cost"), "word", "left").join(vocabulary_costs(vocab).withColumnRenamed("cost", "user_cost"), "word", "left")
    parts = checkpointed(parts)
    part = F.struct("word", "term_id", F.col("cost").cast("double").alias("cost"), F.col("user_cost").cast("double").alias("user_cost"))
    lists = parts.where("term_id IS NOT NULL OR user_cost IS NOT NULL").groupBy("whole").agg(F.collect_list(part).alias("parts"))
    if bigrams is not None:  # only pairs of words that are parts can meet
        ids = parts.where("term_id IS NOT NULL").select("term_id").distinct()
        for side in ("left_id", "right_id"):
            bigrams = bigrams.join(ids.withColumnRenamed("term_id", side), side, "left_semi")
    pairs = load_dictionary(dictionary.limit(0), bigrams).bigrams
    shared = vocab.sparkSession.sparkContext.broadcast(pairs)

    def run(batches):
        for batch in batches:
            costs = []
            for whole, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system = {e["word"]: (e["term_id"], e["cost"]) for e in entries if e["term_id"] is not None}
                user = {e["word"]: e["user_cost"] for e in entries if e["user_cost"] is not None}
                costs.append(Dictionary(system, user, shared.value).segment(split_tokens(whole), True, whole)[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.float64())], names=["word", "cost"])

    costs = map_arrow(lists, run, "word string, cost double")
    return costs.join(own, "word").select("word", F.round(F.col("cost") + F.log(F.col("count") / total), DECIMALS).alias("value"))


def vocabulary_costs(vocab: DataFrame) -> DataFrame:
    """`word`, `cost` at five decimals as single precision, as written to and read from a user dictionary."""
    total = vocab.agg(F.sum("count")).scalar()
    return vocab.select("word", F.round(-F.log(F.col("count") / total), 5).cast("float").alias("cost"))


def trimmed(values: DataFrame, value: str, ratio: float = REMOVE_RATIO, parity: bool = False) -> DataFrame:
    """The list without its lowest part, scaled by its maximum (cut to a whole number with `parity`); a maximum of 0 leaves nothing to scale."""
    ranked = rank_rows(values, F.col(value).desc(), F.col("word"))
    n, top = ranked.agg(F.count("*"), F.max(value)).first()  # of the written ranks
    top = F.lit(top).cast("double")
    top = F.nullif(F.floor(top).cast("double") if parity else top, F.lit(0.0))
    kept = ranked.where(F.col("rank") <= n - F.floor(n * F.lit(ratio)))
    return kept.select("word", (F.col(value) / top).alias(value))


def final_rank(entropy: DataFrame, information: DataFrame, ratio: float = REMOVE_RATIO, alpha: float = ALPHA, parity: bool = False) -> DataFrame:
    """`word`, `value` of words in both trimmed lists, from (word, entropy) and (word, value)."""
    a, b = trimmed(entropy, "entropy", ratio, parity), trimmed(information, "value", ratio, parity)
    return a.join(b, "word").select("word", (F.lit(alpha) * F.col("entropy") + F.lit(1 - alpha) * F.col("value")).alias("value"))


def new_words(df: DataFrame, models: Models, dictionary: DataFrame, bigrams: DataFrame | None = None, name_weights: DataFrame | None = None, known: DataFrame | None = None,
              least: int | None = None, id_col: str = "doc_id", text_col: str = "text", parity: bool = False) -> DataFrame:
    """`word`, `value` of new words, best first: the whole pipeline.

    Words of a first pass by CRF give candidates; a second pass by bigrams with the candidates
    as user words gives counts, neighbours and mutual information. `known` replaces the
    dictionary as the list of old words.
    """
    first = vocabulary(segment(df, models, "crf_seg", id_col, text_col).select(F.explode("words").alias("word")))
    found = checkpointed(candidates(checkpointed(first), known if known is not None else dictionary, name_weights, least))
    vocab, entropy = bigram_analyze(df, found, dictionary, bigrams, id_col, text_col)
    information = mutual_information(vocab, found, dictionary, bigrams)
    return final_rank(checkpointed(entropy), checkpointed(information), parity=parity).orderBy(F.col("value").desc(), "word")
