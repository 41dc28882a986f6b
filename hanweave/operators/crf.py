"""CRF features and scores as column expressions, for sequences held as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanweave.operators.decode import Crf
from hanweave.operators.models import SEGMENT_TEMPLATES


def neighbour(items: Column, at: Column, shift: int) -> Column:
    """The item `shift` places on; beyond the ends the marks _B-1, _B-2, ... and _B+1, _B+2, ..."""
    place = at + shift
    before, after = F.concat(F.lit("_B"), place.cast("string")), F.concat(F.lit("_B+"), (place - F.size(items) + 1).cast("string"))
    return F.when(place < 0, before).when(place >= F.size(items), after).otherwise(F.get(items, place))


def expand(template: str, columns: list[Column], at: Column) -> Column:
    """The feature that a template makes at a place of the columns."""
    parts = Crf._REFERENCE.split(template)
    out = [F.lit(parts[0])]
    for k in range(1, len(parts), 3):
        out += [neighbour(columns[int(parts[k + 1])], at, int(parts[k])), F.lit(parts[k + 2])]
    return F.concat(*out)


def features(df: DataFrame, key: str, items: str, templates: list[str] = SEGMENT_TEMPLATES) -> DataFrame:
    """`key`, `place`, `feature` of the unigram templates at every place of an array of one feature each."""
    placed = df.select(key, items, F.posexplode(items).alias("place", "__item"))
    made = F.array(*[expand(t, [F.col(items)], F.col("place")) for t in templates if t[0] == "U"])
    return placed.select(key, "place", F.explode(made).alias("feature"))


def unigram_scores(made: DataFrame, key: str, weights: DataFrame, tags: list[str]) -> DataFrame:
    """`key`, `place`, `tag`, `score`: the sum of weights of known features for each tag, 0 where none is known."""
    known = made.join(weights.where("left_tag IS NULL").select("feature", "tag", "weight"), "feature", "left")
    sums = known.groupBy(key, "place").agg(*[F.coalesce(F.sum(F.when(F.col("tag") == t, F.col("weight"))), F.lit(0.0)).alias(t) for t in tags])
    return sums.select(key, "place", F.inline(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).alias("score")) for t in tags])))


def probabilities(scores: DataFrame, key: str) -> DataFrame:
    """`key`, `place`, `tag`, `p`: softmax over the tags of a place."""
    top = scores.groupBy(key, "place").agg(F.collect_list(F.struct("tag", "score")).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x["score"]))
    return top.withColumn("total", total).select(key, "place", "total", F.inline("s")).select(key, "place", "tag", (F.exp("score") / F.col("total")).alias("p"))
