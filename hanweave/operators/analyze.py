"""Text to words, types and tags: tokenizing, segmenting and tagging in one pass without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanweave.functions import utf8
from hanweave.functions.tokens import NOT_CJK, TYPE_NAMES, WORD_TYPE_OF, WORD_TYPES, split_sentences
from hanweave.operators import decode
from hanweave.operators.decode import ID_UNSEARCHED, Crf, Dictionary, Hmm
from hanweave.session import checkpointed, map_arrow

# Methods with their segmenter and tagger.
METHODS = {
    "hmm_crf": ("mixed", "hmm_crf"), "seg": ("mixed", None), "crf": ("crf", "crf"), "crf_seg": ("crf", None),
    "bigram_seg": ("bigram", None), "unigram_seg": ("unigram", None), "hmm": ("mixed", "hmm"),
}
NO_TAG = "NONE"
#: Rows of a model table that may be sent to all workers, some 200 bytes each, and of user words found in a corpus; of more, workers get those that occur in a text.
MODEL_ROWS = 4_000_000
USER_ROWS = 500_000


class ModelError(Exception):
    """A model table is missing, too large or malformed."""


class UnknownMethod(NotImplementedError):
    """No such method."""


class Shipped:
    """A function that workers get with the models, also if it is a local one."""

    def __init__(self, function: Callable):
        self.function = function

    def __call__(self, *args):
        return self.function(*args)

    def __getstate__(self):
        return cloudpickle.dumps(self.function)

    def __setstate__(self, state):
        self.function = cloudpickle.loads(state)


@dataclass
class Models:
    """What the decoders need; absent parts are None."""

    dictionary: Dictionary
    properties: dict[str, int] | None = None
    crf_seg: Crf | None = None
    crf_pos: Crf | None = None
    hmm: Hmm | None = None
    own: dict = field(default_factory=dict)
    _taggers: dict = field(default_factory=dict)

    def add_method(self, name: str, segmenter: Callable | str, tagger: Callable | str | None = None) -> None:
        """A method of one's own for these models. A part may also be named as in METHODS.

        `segmenter(tokens, types)` gives the (begin, end) of each word of a sentence, in order and without gaps;
        `tagger(words)` the tag of each (word, word type, term id) of a sentence. Both run in the workers.
        """
        self.own[name] = tuple(x if x is None or isinstance(x, str) else Shipped(x) for x in (segmenter, tagger))

    def tagger(self, name: str) -> Hmm:
        """The HMM with or without the CRF's emissions for unknown words."""
        if (self.hmm.crf is not None) == (name == "hmm_crf"):
            return self.hmm
        if name not in self._taggers:
            self._taggers[name] = Hmm(self.hmm.tag_cost, self.hmm.trans, self.hmm.emits, self.crf_pos if name == "hmm_crf" else None)
        return self._taggers[name]

    def need(self, method: str) -> tuple[str, str | None]:
        if method not in METHODS and method not in self.own:
            raise UnknownMethod(f"method {method!r}; there are {sorted({*METHODS, *self.own})}")
        segmenter, tagger = self.own.get(method) or METHODS[method]
        needs = {"mixed": ["crf_seg", "properties"], "crf": ["crf_seg"]}, {"crf": ["crf_pos"], "hmm": ["hmm"], "hmm_crf": ["hmm", "crf_pos"]}
        wanted = [x for part, need in zip((segmenter, tagger), needs) if isinstance(part, str) for x in need.get(part, [])]
        lacking = [x for x in wanted if getattr(self, x) is None]
        if lacking:
            raise ModelError(f"method {method!r} needs {lacking}")
        return segmenter, tagger


def bounded_rows(df: DataFrame, limit: int = MODEL_ROWS) -> Iterator[tuple]:
    """The rows of a model table, in its order; an error if it is no model's size. They arrive as columns, which take a fraction of rows' memory."""
    table = df.limit(limit + 1).toArrow()
    if len(table) > limit:
        raise ModelError(f"a model table of more than {limit} rows")

    def rows() -> Iterator[tuple]:
        for batch in table.to_batches(max_chunksize=1 << 16):
            yield from zip(*(c.to_pylist() for c in batch.columns))

    return rows()


def load_dictionary(dictionary: DataFrame, bigrams: DataFrame | None = None, user: DataFrame | None = None) -> Dictionary:
    """From (word, term_id, cost), (left_id, right_id, cost) and the user's (word, cost): of repeated user words the least cost counts."""
    words = {word: (term, cost) for word, term, cost in bounded_rows(dictionary.select("word", "term_id", "cost"))}
    pairs = {left << 32 | right: cost for left, right, cost in bounded_rows(bigrams.select("left_id", "right_id", "cost"))} if bigrams is not None else None
    own: dict[str, float] = {}
    for word, cost in bounded_rows(user.groupBy("word").agg(F.min("cost").alias("cost"))) if user is not None else ():
        own[word] = cost
    return Dictionary(words, own, pairs)


def load_crf(tags: list[str], templates: list[str], features: DataFrame) -> Crf:
    """From (feature, left_tag, tag, weight): left_tag is null for features of one tag. Features not given weigh 0."""
    at, n = {t: k for k, t in enumerate(tags)}, len(tags)
    unigram, bigram = {}, {}
    for feature, left, tag, weight in bounded_rows(features.select("feature", "left_tag", "tag", "weight")):
        if left is None:
            unigram.setdefault(feature, [0.0] * n)[at[tag]] = weight
        else:
            bigram.setdefault(feature, [0.0] * (n * n))[at[left] * n + at[tag]] = weight
    return Crf(tags, templates, unigram, bigram)


def load_hmm(tags: DataFrame, trans: DataFrame, emits: DataFrame, crf: Crf | None = None) -> Hmm:
    """From (tag, cost), (tag1, tag2, tag3, cost), (tag, term_id, cost); emissions are tried by falling tag, the order that is fixed here."""
    by_term: dict = {}
    for tag, term, cost in sorted(bounded_rows(emits.select("tag", "term_id", "cost")), key=lambda r: r[0], reverse=True):
        by_term.setdefault(term, []).append((tag, cost))
    costs = dict(bounded_rows(tags.select("tag", "cost")))
    return Hmm(costs, {moves[:3]: moves[3] for moves in bounded_rows(trans.select("tag1", "tag2", "tag3", "cost"))}, by_term, crf)


def words_of(models: Models, segmenter: str, sentences: list[tuple[list[str], list[int]]], parity: bool = False) -> list[list[tuple[str, int, int, int]]]:
    """Of each sentence (tokens, types) its words: (word, word type, term id, tokens)."""
    if callable(segmenter):
        found = [[(a, b, ID_UNSEARCHED) for a, b in segmenter(t, k)] for t, k in sentences]
    elif segmenter == "crf":
        cut = decode.cut_by_crf(models.crf_seg, [(decode.segment_rows(t, k), 0, len(t)) for t, k in sentences], parity)
        found = [[(a, b, ID_UNSEARCHED) for a, b in ranges] for ranges in cut]
    else:
        # The historical name of the unigram method meant the bigram one.
        found = [models.dictionary.segment(t, bigram=segmenter != "unigram" or parity)[0] for t, _ in sentences]
    if segmenter == "mixed":
        jobs, where = [], []
        for s, ((tokens, types), words) in enumerate(zip(sentences, found)):
            runs = decode.suspicious_runs(words, tokens, types, models.properties)
            rows = decode.segment_rows(tokens, types) if runs else None
            for a, b in runs:
                jobs.append((rows, words[a][0], words[b - 1][1]))
                where.append((s, a, b))
        cut = decode.cut_by_crf(models.crf_seg, jobs, parity)
        for (s, a, b), ranges in zip(reversed(where), reversed(cut)):  # from the end, so that places before stay
            found[s][a:b] = [(x, y, ID_UNSEARCHED) for x, y in ranges]
    chinese = WORD_TYPES["chinese"]
    return [
        [("".join(tokens[a:b]), chinese, t, b - a) if b - a > 1 else (tokens[a], WORD_TYPE_OF[types[a]], t, 1) for a, b, t in words]
        for (tokens, types), words in zip(sentences, found)
    ]


def tag_words(models: Models, tagger: str | None, sentences: list[list]) -> list[list[str]]:
    """Tags of the words of each sentence."""
    if tagger is None:
        return [[NO_TAG] * len(words) for words in sentences]
    if callable(tagger):
        return [tagger([(w, kind, t) for w, kind, t, _ in words]) for words in sentences]
    if tagger == "crf":
        jobs = [([decode.pos_row(w, kind) for w, kind, _, _ in words], 0, len(words)) for words in sentences]
        return [[models.crf_pos.tags[t] for t in tags] for tags in models.crf_pos.tag_many(jobs)]
    known, hmm = models.dictionary.words, models.tagger(tagger)
    return [hmm.tag([(w, kind, known[w][0] if t == ID_UNSEARCHED and w in known else t) for w, kind, t, _ in words]) for words in sentences]


def analyze_texts(models: Models, texts: list[str | None], method: str = "hmm_crf", parity: bool = False) -> list[list[tuple]]:
    """Of each text (sentence, position, word, word type, term id, tag); null and empty texts have none."""
    segmenter, tagger = models.need(method)
    place, sentences = [], []
    for k, text in enumerate(texts):
        for no, sentence in enumerate(split_sentences(text or "")):
            place.append((k, no))
            sentences.append(sentence)
    words = words_of(models, segmenter, sentences, parity)
    out: list[list[tuple]] = [[] for _ in texts]
    for (k, no), found, tags in zip(place, words, tag_words(models, tagger, words)):
        out[k] += [(no, pos, word, kind, term, tag) for pos, ((word, kind, term, _), tag) in enumerate(zip(found, tags))]
    return out


def analyze_text(models: Models, text: str, method: str = "hmm_crf", parity: bool = False) -> list[tuple]:
    return analyze_texts(models, [text], method, parity)[0]


def portions(texts: list, most: int = 200_000):
    """Ranges of texts of some `most` characters together."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= most:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


_RESULT = pa.struct([("sent_id", pa.int32()), ("pos", pa.int32()), ("word", pa.string()), ("word_type", pa.int32()), ("term_id", pa.int32()), ("tag", pa.string())])


def analyze(df: DataFrame, models: Models, method: str = "hmm_crf", id_col: str = "doc_id", text_col: str = "text", parity: bool = False) -> DataFrame:
    """`id_col`, `sent_id`, `pos`, `word`, `word_type`, `term_id`, `tag`: one row a word; null and empty texts give none, broken encodings no token.

    The models go to the workers as one broadcast, whose size `bounded_rows` has checked.
    """
    models.need(method)
    shared = df.sparkSession.sparkContext.broadcast(models)
    fields = [T.StructField(n, T.StringType() if n in ("word", "tag") else T.IntegerType()) for n in ("sent_id", "pos", "word", "word_type", "term_id", "tag")]
    schema = T.StructType([df.schema[id_col], *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8.texts(batch.column(1), "ignore")
            for a, b in portions(texts):
                found = analyze_texts(shared.value, texts[a:b], method, parity)
                rows = [row for part in found for row in part]
                if rows:
                    index = np.repeat(np.arange(a, b), [len(part) for part in found])
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), *columns], names=names)

    return map_arrow(df.select(id_col, text_col), run, schema)


def segment(df: DataFrame, models: Models, method: str = "seg", id_col: str = "doc_id", text_col: str = "text", parity: bool = False) -> DataFrame:
    """`id_col`, `words`: one list of words a text, those that are not Chinese as -NOT-CJK-; null for null text."""
    segmenter, _ = models.need(method)
    shared = df.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType([df.schema[id_col], T.StructField("words", T.ArrayType(T.StringType()))])
    chinese = WORD_TYPES["chinese"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8.texts(batch.column(1), "ignore")
            for a, b in portions(texts):
                place, sentences = [], []
                for k in range(a, b):
                    for sentence in split_sentences(texts[k] or ""):
                        place.append(k - a)
                        sentences.append(sentence)
                lists = [None if t is None else [] for t in texts[a:b]]
                for k, words in zip(place, words_of(shared.value, segmenter, sentences, parity)):
                    lists[k] += [w[0] if w[1] == chinese else NOT_CJK for w in words]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lists, pa.list_(pa.string()))], names=schema.names)

    return map_arrow(df.select(id_col, text_col), run, schema)


def segment_with_words(df: DataFrame, dictionary: Dictionary, user: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `segment` by bigrams with any number of user words (`word`, `cost`): a worker sees those that occur in a text.

    They are found by an equi-join of the texts' parts that are as long as a user word. A text's list is
    no longer than the text has parts. User words of one character count too; a word is not repeated in `user`.
    """
    lengths = sorted(r[0] for r in user.where("word <> ''").select(F.length("word").alias("n")).distinct().collect())  # some dozens
    texts = checkpointed(df.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text")))
    n = F.length("__text")

    def parts_of(k: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(F.col("__text"), i, F.lit(k)))
        return F.when(n >= k, found).otherwise(F.array().cast("array<string>"))

    parts = [parts_of(k) for k in lengths]
    placed = texts.where("__text <> ''").select("__row", F.explode(F.array_distinct(F.concat(*parts))).alias("word")) if parts else texts.limit(0).select("__row", F.col("__text").alias("word"))
    own = placed.join(user.select("word", "cost"), "word").groupBy("__row").agg(F.collect_list(F.struct("word", F.col("cost").cast("double").alias("cost"))).alias("__words"))
    both = texts.join(own, "__row", "left").select(F.col("__id").alias(id_col), "__text", "__words")
    shared = df.sparkSession.sparkContext.broadcast(dictionary)
    schema = T.StructType([both.schema[id_col], T.StructField("words", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for text, words in zip(utf8.texts(batch.column(1), "ignore"), batch.column(2).to_pylist()):
                models = Models(shared.value.with_words({w["word"]: w["cost"] for w in words or ()}))
                found = words_of(models, "bigram", list(split_sentences(text or "")))
                lists.append(None if text is None else [w[0] if w[1] == WORD_TYPES["chinese"] else NOT_CJK for s in found for w in s])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string()))], names=schema.names)

    return map_arrow(both, run, schema)


def path_costs(df: DataFrame, models: Models, bigram: bool = True, id_col: str = "doc_id", text_col: str = "text", without_self: bool = False) -> DataFrame:
    """`id_col`, `cost` of the last sentence of each text; with `without_self` the text itself is no word. Null for null and empty texts."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType([df.schema[id_col], T.StructField("cost", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = []
            for text in utf8.texts(batch.column(1), "ignore"):
                cost = None
                for tokens, _ in split_sentences(text or ""):
                    cost = shared.value.dictionary.segment(tokens, bigram, text if without_self else None)[1]
                costs.append(cost)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.float64())], names=schema.names)

    return map_arrow(df.select(id_col, text_col), run, schema)


def format_words(rows: list[tuple], types: bool = False, tags: bool = False) -> str:
    """`word[_TYPE][/TAG]` and two blanks each of rows of `analyze_texts`; words that begin with CR, LF or a blank are left out."""
    parts = []
    for _, _, word, kind, _, tag in rows:
        if word[0] not in "\r\n ":
            parts.append(word + (f"_{TYPE_NAMES[kind]}" if types else "") + (f"/{tag}" if tags else "") + "  ")
    return "".join(parts)


def analyze_lines(df: DataFrame, models: Models, method: str = "hmm_crf", id_col: str = "doc_id", text_col: str = "text", types: bool = False, tags: bool = False, parity: bool = False) -> DataFrame:
    """`id_col`, `line`: the words of each text as one line, made where the text is read, in the order of the texts; null and empty texts give none."""
    models.need(method)
    shared = df.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType([df.schema[id_col], T.StructField("line", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8.texts(batch.column(1), "ignore")
            for a, b in portions(texts):
                found = analyze_texts(shared.value, texts[a:b], method, parity)
                kept = [k for k, rows in enumerate(found) if rows]
                lines = pa.array([format_words(found[k], types, tags) for k in kept], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([a + k for k in kept], pa.int64())), lines], names=schema.names)

    return map_arrow(df.select(id_col, text_col), run, schema)


def seg(models: Models, text: str, method: str = "seg") -> list[str]:
    """Words of one text, for use without Spark."""
    return [row[2] for row in analyze_text(models, text, method)]


def local_rows(analyzed: DataFrame) -> Iterator:
    """Rows one by one in order, without holding the result."""
    return analyzed.toLocalIterator()
