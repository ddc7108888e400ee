"""Annotation files as a stream: files are picked up as they arrive, and each batch's output files are published once.

A batch goes through the operators of the batch jobs and the sink of named files, so the output is that of the batch jobs over
all files. What makes it exactly once: Spark gives a batch the same files and the same number after a restart, a file's output
depends on that file alone and replaces what an unfinished attempt left, and a batch that was published whole leaves a marker
by its number, so a second delivery does nothing. An input is read when it arrives and never again; files without a byte are
invisible to Spark's sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from flocktab.plans import jobs
from flocktab.sources.readers import mot_lines, numbered_lines, parse_mot, scanned
from flocktab.sources.writers import write_yolo, yolo_files

from .batches import published_once

def _stream(spark: SparkSession, glob: str, files_a_batch: int | None) -> DataStreamReader:
    stream = spark.readStream.schema("value string").option("pathGlobFilter", glob)
    return stream.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else stream


def stream_texts(spark: SparkSession, folder: str, glob: str = "*.txt", files_a_batch: int | None = None) -> DataFrame:
    """(file_name, value: whole text) of the files of a folder, as they arrive."""
    return _stream(spark, glob, files_a_batch).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")


def stream_mot(spark: SparkSession, folder: str, dialect: str = "filter", on_error: str = "raise", glob: str = "*.txt", files_a_batch: int | None = None) -> DataFrame:
    """read_mot of a stream of files. All of the filters are Column expressions and apply to it as they are."""
    return parse_mot(mot_lines(stream_texts(spark, folder, glob, files_a_batch)), dialect, on_error)


def _start(spark: SparkSession, source: str, target: str, checkpoint: str, glob: str, files_a_batch: int | None, publish: Callable[[DataFrame, int], None], once: bool) -> StreamingQuery:
    out = scanned(_stream(spark, glob, files_a_batch).text(source)).writeStream.foreachBatch(published_once(spark, target, publish)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def filter_stream(spark: SparkSession, source: str, target: str, checkpoint: str, suffix: str = "", glob: str = "*.txt", files_a_batch: int | None = None, once: bool = True, **filters) -> StreamingQuery:
    """jobs.filter_files of the files that arrive; once: those that are there, then it ends."""

    def publish(rows: DataFrame, number: int) -> None:
        det = parse_mot(numbered_lines(rows), "filter").withColumn("seq_id", F.col("file_name"))
        jobs.write_filtered(det, rows.select("file_name"), target, suffix, **filters)

    return _start(spark, source, target, checkpoint, glob, files_a_batch, publish, once)


def label_stream(spark: SparkSession, source: str, target: str, checkpoint: str, img_width: int, img_height: int, properties: list[str], glob: str = "*.txt", files_a_batch: int | None = None, once: bool = True) -> StreamingQuery:
    """jobs.label_files of the files that arrive. Of several files of one sequence the last that arrives counts for a frame."""

    def publish(rows: DataFrame, number: int) -> None:
        write_yolo(yolo_files(parse_mot(numbered_lines(rows), "yolo"), img_width, img_height, properties), target)

    return _start(spark, source, target, checkpoint, glob, files_a_batch, publish, once)
