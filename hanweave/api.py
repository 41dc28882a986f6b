"""Model directories and the analyzer: what a program needs to open models and analyze texts."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanweave.operators import analyze as an
from hanweave.operators import decode
from hanweave.operators import models as md
from hanweave.session import checkpointed
from hanweave.sources import text as src

#: Tables of a model directory.
TABLES = ("dictionary", "bigrams", "properties", "crf_seg", "crf_pos", "tags", "transitions", "emissions", "names")


@dataclass
class ModelTables:
    """The tables of a model; all but the dictionary may be absent."""

    dictionary: DataFrame
    bigrams: DataFrame | None = None
    properties: DataFrame | None = None
    crf_seg: DataFrame | None = None
    crf_pos: DataFrame | None = None
    tags: DataFrame | None = None
    transitions: DataFrame | None = None
    emissions: DataFrame | None = None
    names: DataFrame | None = None

    def save(self, path: str, mode: str = "error") -> None:
        for name in TABLES:
            if getattr(self, name) is not None:
                src.write_table(getattr(self, name), os.path.join(path, name), mode)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ModelTables:
        found = {}
        hadoop = spark._jvm.org.apache.hadoop.fs
        for name in TABLES:
            place = hadoop.Path(os.path.join(path, name))
            if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
                found[name] = spark.read.parquet(os.path.join(path, name))
        if "dictionary" not in found:
            raise an.ModelError(f"{path} holds no dictionary")
        return cls(**found)

    def models(self, method: str = "hmm_crf", user: DataFrame | None = None) -> an.Models:
        """The decoders that a method needs."""
        if method not in an.METHODS:
            raise NotImplementedError(f"method {method!r}; there are {sorted(an.METHODS)}")
        segmenter, tagger = an.METHODS[method]
        out = an.Models(an.load_dictionary(self.dictionary, self.bigrams, user))
        if segmenter in ("mixed", "crf") and self.crf_seg is not None:
            out.crf_seg = an.load_crf(list(decode.SEGMENT_TAGS), md.SEGMENT_TEMPLATES, self.crf_seg)
        if segmenter == "mixed" and self.properties is not None:
            out.properties = dict(an.bounded_rows(self.properties.select("word", "value")))
        if tagger in ("crf", "hmm_crf") and self.crf_pos is not None:
            names = sorted(r["tag"] for r in self.crf_pos.select("tag").distinct().collect())
            out.crf_pos = an.load_crf(names, md.POS_TEMPLATES, self.crf_pos)
        if tagger in ("hmm", "hmm_crf") and self.tags is not None:
            out.hmm = an.load_hmm(self.tags, self.transitions, self.emissions, out.crf_pos)
        out.need(method)
        return out


def train(terms: DataFrame, lexicon: DataFrame, bigrams: DataFrame | None = None) -> ModelTables:
    """Model tables from tagged words (as `terms`) and a dictionary (word, term_id, cost, oov_value)."""
    words = lexicon.select("word", "term_id", F.coalesce("cost", F.lit(decode.DEFAULT_COST).cast("float")).alias("cost"))
    places = checkpointed(md.tagged_places(terms))  # each table is trained from it
    tags = checkpointed(md.tag_set(places))
    return ModelTables(
        dictionary=words, bigrams=bigrams, properties=lexicon.where("oov_value IS NOT NULL").select("word", F.col("oov_value").alias("value")),
        crf_seg=md.segment_features(words), crf_pos=md.pos_features(places, words), tags=tags, transitions=md.tag_trigrams(places, tags),
        emissions=md.emissions(places, words), names=md.name_weights(places),
    )
