"""Command line: `python -m hanweave TASK MODEL ...`, also by spark-submit.

segment, vocab and discover read text files, one text a line, and write a folder of lines. With `-i`,
segment reads standard input and prints each line at once, without Spark jobs on the text.
gram, dict, hmm and maxent make tables of a model folder from text files.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hanweave import session
from hanweave.api import ModelTables
from hanweave.operators import analyze as an
from hanweave.operators import dictionary as dc
from hanweave.operators import newwords as nw
from hanweave.operators import rejects
from hanweave.sources import text as src

VOCAB_METHODS = ("bigram_seg", "crf_seg")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="hanweave", description=__doc__)
    tasks = parser.add_subparsers(dest="task", required=True)

    def task(name: str, help_: str, *places: tuple[str, str]) -> argparse.ArgumentParser:
        made = tasks.add_parser(name, help=help_)
        made.add_argument("model", help="folder of model tables")
        for place, what in places:
            made.add_argument(place, help=what)
        return made

    texts, output = ("corpus", "text files, one text a line"), ("output", "folder to write")
    for name, help_, methods, default in (("segment", "words of each line", sorted(an.METHODS), "hmm_crf"), ("vocab", "words with their counts", VOCAB_METHODS, "bigram_seg")):
        made = task(name, help_, *([] if name == "segment" else [texts, output]))
        made.add_argument("-m", "--method", default=default, choices=methods)
        made.add_argument("-d", "--dictionary", help="user dictionary, `word[ cost]` a line")
        if name == "segment":
            for place, what in (texts, output):
                made.add_argument(place, help=what, nargs="?")
            made.add_argument("-i", "--stdin", action="store_true", help="read standard input, print lines")
            made.add_argument("-t", "--types", action="store_true", help="write word types")
    made = task("discover", "new words with their values", texts, output)
    made.add_argument("-u", "--known", help="vocabulary of known words, used instead of the dictionary")
    task("gram", "dictionary and pair costs from count files", ("unigrams", "files of `word count`"), ("bigrams", "files of `left right count`"))
    task("dict", "properties of words", ("lines", "files of `word number`"))
    task("hmm", "tag tables; the folder needs a dictionary", ("tags", "files of `tag cost`"), ("transitions", "files of `tag tag tag cost`"), ("emissions", "files of `tag word cost`"))
    task("maxent", "weights of the name classifier", ("weights", "files of `class feature weight`"))
    return parser


def _count_rows(spark: SparkSession, path: str, form: rejects.LineFormat):
    """The valid rows; how many lines failed, and why, goes to standard error."""
    parsed = session.written(rejects.read_counts(spark, path, form))
    for r in rejects.rejected_rows(parsed).groupBy("reason").count().collect():
        print(f"{path}: {r['count']} lines left out: {r['reason']}", file=sys.stderr)
    return rejects.valid_rows(parsed)


def _build(args: argparse.Namespace, spark: SparkSession) -> None:
    lines = lambda path: src.read_lines(spark, path)
    made = {}
    if args.task == "gram":
        made["dictionary"] = session.written(dc.build_unigram(_count_rows(spark, args.unigrams, rejects.UNIGRAM)))
        made["bigrams"] = dc.build_bigram(_count_rows(spark, args.bigrams, rejects.BIGRAM), made["dictionary"])
    elif args.task == "dict":
        made["properties"] = src.parse_dictionary(lines(args.lines))
    elif args.task == "maxent":
        made["names"] = src.parse_weights(lines(args.weights))
    else:
        made["tags"] = src.parse_tag_set(lines(args.tags))
        made["transitions"] = src.parse_transitions(lines(args.transitions))
        made["emissions"] = src.resolve_emissions(src.parse_emissions(lines(args.emissions)), made["tags"], ModelTables.load(spark, args.model).dictionary)
    for name, table in made.items():
        src.write_table(table, os.path.join(args.model, name))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = _parser()
    args = parser.parse_args(args)
    if args.task == "segment" and bool(args.stdin) == bool(args.corpus and args.output):
        parser.error("segment needs a corpus and an output, or -i")
    if spark is None:
        spark = SparkSession.builder.appName("hanweave").getOrCreate()
        try:
            _run(args, spark)
        finally:
            session.clean(spark)
    else:
        _run(args, spark)


def _run(args: argparse.Namespace, spark: SparkSession) -> None:
    if args.task in ("gram", "dict", "hmm", "maxent"):
        _build(args, spark)
        return
    tables = ModelTables.load(spark, args.model)
    user = src.parse_user_dictionary(src.read_lines(spark, args.dictionary)) if getattr(args, "dictionary", None) else None
    if args.task == "segment" and args.stdin:
        models, tags = tables.models(args.method, user), an.METHODS[args.method][1] is not None
        for line in sys.stdin:
            print(an.format_words(an.analyze_text(models, line, args.method), args.types, tags), flush=True)
        return
    lines = src.read_lines(spark, args.corpus).select(F.monotonically_increasing_id().alias("line_id"), F.concat("value", F.lit("\n")).alias("text"))
    if args.task == "segment":
        found = an.analyze_lines(lines, tables.models(args.method, user), args.method, "line_id", types=args.types, tags=an.METHODS[args.method][1] is not None)
        src.write_lines(found, args.output)
    elif args.task == "vocab":
        words = an.segment(lines, tables.models(args.method, user), args.method, "line_id").select(F.explode("words").alias("word"))
        src.write_lines(src.vocabulary_lines(nw.vocabulary(words)), args.output)
    else:
        known = src.parse_user_dictionary(src.read_lines(spark, args.known)) if args.known else None
        found = nw.new_words(lines, tables.models("crf_seg"), tables.dictionary, tables.bigrams, tables.names, known, id_col="line_id")
        src.write_lines(src.cost_lines(found, "value", 3), args.output)


if __name__ == "__main__":
    main()
