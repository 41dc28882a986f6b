"""Analysis of streams of lines: all of it is per row, so a stream needs no state.

Vocabulary counts over a stream are kept by event-time windows with a watermark, so their
state is bounded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanweave.functions import tokens as tk
from hanweave.operators.analyze import Models, analyze
from hanweave.session import shared_folder


def read_line_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """`value`, `arrived` of lines of files as they appear in a folder, which stands in for standard input."""
    stream = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files).text(path)
    return stream.withColumn("arrived", F.current_timestamp())


def read_table_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def analyze_stream(stream: DataFrame, models: Models, method: str = "hmm_crf", id_col: str = "arrived", text_col: str = "value") -> DataFrame:
    """As `analyze`, of a stream."""
    return analyze(stream, models, method, id_col, text_col)


def token_counts(stream: DataFrame, time_col: str, text_col: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """`window`, `token`, `n`: token counts by window of event time; rows later than `late` are left out."""
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    tokens = timed.withWatermark(time_col, late).select(time_col, F.explode(tk.tokens(F.col(text_col))).alias("token"))
    return tokens.groupBy(F.window(time_col, window).alias("window"), "token").agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, writes its result to the shared folder and returns it.

    In the mode `complete` each batch replaces the table, else each adds to it.
    """
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    how = "overwrite" if mode == "complete" else "append"
    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(f"{folder}/table")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode(how).parquet(f"{folder}/table")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/table")
