"""Model tables trained from tables of words and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags that every tag set has; the first stands for the begin of a sentence.
REQUIRED_TAGS = ("BOS", "PU", "CD", "NN", "VV", "VA", "AD", "NR")
# Templates of the two CRF models.
SEGMENT_TEMPLATES = ["U00:%x[-1,0]/%x[0,0]", "U01:%x[0,0]", "B"]
POS_TEMPLATES = ["U00:%x[0,0]", "U01:%x[0,1]", "U02:%x[0,2]", "B"]


def tagged_places(terms: DataFrame) -> DataFrame:
    """`doc_id`, `sent_no`, `pos`, `word`, `tag`: of rows of one place the last analyzed (then the largest row_id); rows without a usable tag are left out."""
    last = terms.where("pos IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", "pos").agg(F.max_by(F.struct("sent_no", "word", F.col("part_of_speech_tag").alias("tag")), F.struct("analyzed_at", "row_id")).alias("x"))
    return last.select("doc_id", "pos", "x.*").where("rlike(tag, '^[A-Z]{2}$')")


def tag_set(places: DataFrame) -> DataFrame:
    """`tag`, `cost` = -ln p(tag) with one added to each count; the required tags are always there."""
    required = places.sparkSession.createDataFrame([(t,) for t in REQUIRED_TAGS], "tag string")
    counts = places.select("tag", F.lit(1).alias("n")).unionByName(required.withColumn("n", F.lit(0))).groupBy("tag").agg((F.sum("n") + 1).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("tag", (-F.log(F.col("n") / total)).cast("float").alias("cost"))


def tag_trigrams(places: DataFrame, tags: DataFrame) -> DataFrame:
    """`tag1`, `tag2`, `tag3`, `cost` = -ln p(tag3 | tag1, tag2), one added to each count; BOS before the begin of a sentence.

    The places before are found by an equi-join on the place, so a long document is no task of its own.
    """
    here = places.select("doc_id", "sent_no", "pos", "tag")
    before = lambda k: here.select("doc_id", "sent_no", (F.col("pos") + k).alias("pos"), F.col("tag").alias(f"t{k}"))
    keys = ["doc_id", "sent_no", "pos"]
    seen = here.join(before(1), keys, "left").join(before(2), keys, "left")
    seen = seen.select(F.coalesce("t2", F.lit("BOS")).alias("tag1"), F.coalesce("t1", F.lit("BOS")).alias("tag2"), F.col("tag").alias("tag3"))
    counts = seen.groupBy("tag1", "tag2", "tag3").agg(F.count("*").alias("n"))
    # All triples of some ten tags.
    names = tags.agg(F.array_sort(F.collect_set("tag"))).scalar()
    triples = tags.select(F.col("tag").alias("tag1"), F.explode(names).alias("tag2")).select("tag1", "tag2", F.explode(names).alias("tag3")).where("tag3 <> 'BOS'")
    filled = triples.join(counts, ["tag1", "tag2", "tag3"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    sums = filled.groupBy("tag1", "tag2").agg(F.sum("n").alias("m"))
    return filled.join(sums, ["tag1", "tag2"]).select("tag1", "tag2", "tag3", (-F.log(F.col("n") / F.col("m"))).cast("float").alias("cost"))


def emissions(places: DataFrame, dictionary: DataFrame) -> DataFrame:
    """`tag`, `term_id`, `cost` = -ln p(word | tag) of the dictionary's words."""
    counts = places.groupBy("tag", "word").agg(F.count("*").alias("n"))
    sums = counts.groupBy("tag").agg(F.sum("n").alias("m"))
    known = counts.join(dictionary.select("word", "term_id"), "word").join(sums, "tag")
    return known.select("tag", "term_id", (-F.log(F.col("n") / F.col("m"))).cast("float").alias("cost"))


def _weight(n: Column) -> Column:
    """ln(1 + n) in single precision: sums of some hundred such numbers in double precision are exact, so equal scores are equal."""
    return F.log1p(n).cast("float").cast("double")


def segment_features(dictionary: DataFrame) -> DataFrame:
    """CRF weights ln(1 + n) of characters at their places in dictionary words: (feature, left_tag, tag, weight)."""
    size, at = F.size("chars"), F.col("k")
    tag = F.when(size == 1, "S").when(at == 0, "B").when(at == size - 1, "E").when(at == 1, "B1").when(at == 2, "B2").otherwise("M")
    chars = dictionary.where("word IS NOT NULL AND word <> ''").select(F.split("word", "").alias("chars"))
    placed = chars.select("chars", F.posexplode("chars").alias("k", "char")).withColumn("tag", tag)
    left = F.when(at > 0, F.element_at("chars", at))  # the character before
    single = placed.select(F.concat(F.lit("U01:"), "char").alias("feature"), "tag")
    pair = placed.where("k > 0").select(F.concat(F.lit("U00:"), left, F.lit("/"), "char").alias("feature"), "tag")
    unigram = single.unionByName(pair).groupBy("feature", "tag").agg(_weight(F.count("*")).alias("weight")).withColumn("left_tag", F.lit(None).cast("string"))
    # Which tag may follow which, as words are built.
    follows = [("B", "B1"), ("B", "E"), ("B1", "B2"), ("B1", "E"), ("B2", "M"), ("B2", "E"), ("M", "M"), ("M", "E")] + [(a, b) for a in "ES" for b in "BS"]
    rows = [("B", a, b, 0.0 if (a, b) in follows else -30.0) for a in ("S", "B", "B1", "B2", "M", "E") for b in ("S", "B", "B1", "B2", "M", "E")]
    bigram = dictionary.sparkSession.createDataFrame(rows, "feature string, left_tag string, tag string, weight double")
    return unigram.select("feature", "left_tag", "tag", "weight").unionByName(bigram)


def pos_features(places: DataFrame, dictionary: DataFrame) -> DataFrame:
    """CRF weights ln(1 + n) of dictionary words, first and last characters by tag, and of neighbouring tags."""
    known = places.where("word <> ''").join(dictionary.select("word"), "word", "left_semi")
    columns = F.array(F.concat(F.lit("U00:"), "word"), F.concat(F.lit("U01:"), F.substring("word", 1, 1)), F.concat(F.lit("U02:"), F.substring("word", -1, 1)))
    unigram = known.select("tag", F.explode(columns).alias("feature")).groupBy("feature", "tag").agg(_weight(F.count("*")).alias("weight"))
    before = places.select("doc_id", "sent_no", (F.col("pos") + 1).alias("pos"), F.col("tag").alias("left_tag"))
    pairs = places.join(before, ["doc_id", "sent_no", "pos"]).groupBy("left_tag", "tag").agg(_weight(F.count("*")).alias("weight"))
    none = F.lit(None).cast("string").alias("left_tag")
    return unigram.select("feature", none, "tag", "weight").unionByName(pairs.select(F.lit("B").alias("feature"), "left_tag", "tag", "weight"))


def name_features(df: DataFrame, word: str = "word") -> DataFrame:
    """`df` with `feature`, a row each: B: first, E: last, M: each middle character; none for words of one character."""
    chars = F.split(word, "")
    n = F.size(chars)
    ends = F.array(F.concat(F.lit("B:"), F.element_at(chars, 1)), F.concat(F.lit("E:"), F.element_at(chars, -1)))
    middle = F.when(n > 2, F.transform(F.slice(chars, 2, n - 2), lambda c: F.concat(F.lit("M:"), c))).otherwise(F.array().cast("array<string>"))
    return df.where(F.length(word) >= 2).withColumn("feature", F.explode(F.concat(ends, middle)))


def name_weights(places: DataFrame) -> DataFrame:
    """Maximum-entropy style weights (y, feature, weight) = ln((1 + n) / (2 + N)): T for words tagged NR, F for others; each word counts once a class."""
    y = F.when(F.col("tag") == "NR", "T").otherwise("F")
    words = places.where("word <> ''").select("word", y.alias("y")).distinct()
    n = name_features(words).groupBy("y", "feature").agg(F.count("*").alias("n"))
    both = n.groupBy("feature").agg(F.sum("n").alias("all"))
    return n.join(both, "feature").select("y", "feature", F.log((F.col("n") + 1) / (F.col("all") + 2)).cast("float").alias("weight"))


def classify(df: DataFrame, weights: DataFrame, word: str = "word") -> DataFrame:
    """`word`, `y`: the class with the largest sum of weights over known features, the first class on ties.

    Classes that a word has no weight for count as 0, so every word of two characters or more gets a class.
    """
    classes = weights.agg(F.array_sort(F.collect_set("y"))).scalar()
    featured = name_features(df.select(word).distinct(), word)
    sums = featured.join(weights, "feature", "left").groupBy(word, "y").agg(F.sum("weight").alias("s"))
    table = sums.groupBy(word).agg(F.map_from_entries(F.collect_list(F.when(F.col("y").isNotNull(), F.struct("y", "s")))).alias("m")).withColumn("ys", classes)
    scored = F.transform("ys", lambda c: F.struct((-F.round(F.coalesce(F.element_at("m", c), F.lit(0.0)), 9)).alias("s"), c.alias("y")))
    return table.select(word, F.array_min(scored)["y"].alias("y"))
