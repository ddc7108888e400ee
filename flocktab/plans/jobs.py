"""Jobs from annotation files to files: fill gaps, filter, convert to labels. Each returns its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flocktab.functions.scalar import file_id
from flocktab.operators import detections as D
from flocktab.operators.detections import last_wins
from flocktab.operators.frames import kept_ground_truth
from flocktab.operators.tracks import interpolate_tracks
from flocktab.sources.readers import file_names, read_mot
from flocktab.sources.writers import out_name, write_mot, write_yolo, yolo_files


def _rows(spark: SparkSession, source: str, dialect: str, glob: str, only: DataFrame | None = None) -> DataFrame:
    """Detections of the files; each file by itself, also where two have one id."""
    return read_mot(spark, source, dialect, glob=glob, only=only).withColumn("seq_id", F.col("file_name"))


def interpolate_files(spark: SparkSession, source: str, target: str, step: int = 1, suffix: str = "", glob: str = "*.txt") -> DataFrame:
    """Writes each file with its tracks filled, by frame and track; gives rows before, filled and after by file."""
    det = _rows(spark, source, "interp", glob)
    write_mot(interpolate_tracks(det, step), target, suffix, ("frame", "track_id", "line_no"), file_names(spark, source, glob))
    # counted in what was written: tracks are filled once
    written = _rows(spark, target, "interp", "*").select(F.col("file_name").alias("out"), "is_propagated")
    names = det.select("seq_id").distinct().withColumn("out", out_name(F.col("seq_id"), suffix))
    return D.interpolation_stats(det, written.join(names, "out"))


def write_filtered(det: DataFrame, names: DataFrame, target: str, suffix: str = "", gender=(), age=(), strict: bool = False, **filters) -> Column:
    """Writes each file of names with the rows of det that pass, and gives the test. Names of genders and ages stand for their codes too."""
    passes = D.detection_filter(gender=D.expand_aliases(list(gender), D.GENDERS, strict), age=D.expand_aliases(list(age), D.AGES, strict), strict=strict, **filters)
    write_mot(det.where(passes), target, suffix, files=names)
    return passes


def filter_files(spark: SparkSession, source: str, target: str, suffix: str = "", glob: str = "*.txt", **filters) -> DataFrame:
    """Writes each file with the rows that pass (see write_filtered); gives total, kept and percent by file, and for all."""
    det = _rows(spark, source, "filter", glob)
    return D.filter_stats(det, write_filtered(det, file_names(spark, source, glob), target, suffix, **filters))


def ground_truth_files(spark: SparkSession, source: str, target: str, start: int = 0, end: int | None = None, rate: int = 1, glob: str = "*.{txt,csv}", gender=(), age=(), strict: bool = False, **filters) -> DataFrame:
    """Writes <id>_gt.txt for each annotation file with an id (of several of one id the last by name), with the rows that go beside the extracted frames; of a file without such a row an empty one. Names of genders and ages stand for their codes too. Gives rows by file."""
    names = file_names(spark, source, glob).select("file_name", file_id(F.col("file_name")).alias("id")).where("id is not null")
    names = last_wins(names, "id", "file_name").select("file_name", F.concat("id", F.lit("_gt.txt")).alias("out"))
    det = kept_ground_truth(_rows(spark, source, "frames", glob, names), start, end, rate, gender=gender, age=age, strict=strict, **filters)
    det = det.join(names, "file_name").drop("file_name").withColumnsRenamed({"out": "file_name"})
    write_mot(det, target, files=names.select(F.col("out").alias("file_name")), blank=None)
    # counted in what was written, a line a row: the input is parsed once
    written = spark.read.schema("value string").option("pathGlobFilter", "*_gt.txt").text(target).groupBy(F.col("_metadata.file_name").alias("seq_id")).agg(F.count("*").alias("rows"))
    return names.select(F.col("out").alias("seq_id")).join(written, "seq_id", "left").fillna(0, "rows")


def label_files(spark: SparkSession, source: str, target: str, img_width: int, img_height: int, properties: list[str], glob: str = "*.txt") -> DataFrame:
    """Writes a label file for each sequence and frame; gives frames and labels by sequence."""
    det = read_mot(spark, source, "yolo", glob=glob)
    write_yolo(yolo_files(det, img_width, img_height, properties), target)
    return det.groupBy("seq_id").agg(F.count_distinct("frame").alias("frames"), F.count("*").alias("labels"))
