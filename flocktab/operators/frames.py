"""The plan of frames to extract from videos; pixels are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flocktab.functions.scalar import file_id, frame_file, split_halves, stem

from .detections import AGES, GENDERS, detection_filter, expand_aliases, has_filter, last_wins, sample_frames


def pair_videos(videos: DataFrame, mot_files: DataFrame) -> DataFrame:
    """videos (video_id, file_name, …) with mot_file (or null): the annotation file with the same id. Of several videos or files of one id the last by name."""
    mot = mot_files.select(file_id(F.col("file_name")).alias("video_id"), F.col("file_name").alias("mot_file")).where("video_id is not null")
    return last_wins(videos.where("video_id is not null"), "video_id", "file_name").join(last_wins(mot, "video_id", "mot_file"), "video_id", "left")


def pair_single(video: DataFrame, mot_files: DataFrame) -> DataFrame:
    """One video with one annotation file, whatever their ids: the file with the video's id, else the only file there is."""
    paired = pair_videos(video, mot_files)
    only = mot_files.agg(F.when(F.count("*") == 1, F.max("file_name")).alias("__only"))
    return paired.join(only).withColumn("mot_file", F.coalesce("mot_file", "__only")).drop("__only")  # one row each


def with_codes(filters: dict) -> dict:
    """The filters, names of genders and ages standing for their codes too."""
    strict = filters.get("strict", False)
    return filters | {k: expand_aliases(list(filters[k]), names, strict) for k, names in (("gender", GENDERS), ("age", AGES)) if filters.get(k)}


def frames_with_matches(frames: DataFrame, det: DataFrame) -> DataFrame:
    """frames (video_id, mot_file, frame, …) that have a row of det (video_id, frame); videos without an annotation file keep all."""
    free = frames.where("mot_file is null")
    bound = frames.where("mot_file is not null").join(det.select("video_id", "frame"), ["video_id", "frame"], "left_semi")
    return bound.unionByName(free)


def frame_plan(pairs: DataFrame, det: DataFrame, start: int = 0, end: int | None = None, rate: int = 1, thermal: bool = True, rgb: bool = True, use_id: bool = True, **filters) -> DataFrame:
    """(video_id, frame, modality, x0, x1, file_name) for each image to extract; det has video_id in place of seq_id.

    Frames from start to below end (and the video's end), each rate-th; with an active filter, and for videos with an
    annotation file, only frames with a detection that passes it. Names of genders and ages stand for their codes too.
    """
    filters = with_codes(filters)
    if not thermal and not rgb:
        raise ValueError("at least one of thermal and rgb")
    last = F.col("total_frames") - 1 if end is None else F.least(F.col("total_frames") - 1, F.lit(end - 1))
    frames = pairs.where(last >= start).select("*", F.explode(F.sequence(F.lit(start).cast("bigint"), last.cast("bigint"), F.lit(rate).cast("bigint"))).alias("frame"))
    if has_filter(**filters):
        kept = sample_frames(det, start, end, rate).where(detection_filter(**filters))
        frames = frames_with_matches(frames, kept)
    prefix = F.col("video_id") if use_id else stem(F.col("file_name"))
    wanted = F.array(*[F.lit(m) for m, on in (("thermal", thermal), ("rgb", rgb)) if on])
    halves = F.filter(split_halves(F.col("width")), lambda h: F.array_contains(wanted, h["modality"]))
    return frames.select("video_id", "frame", frame_file(prefix, F.col("frame")).alias("file_name"), F.explode(halves).alias("h")).select("video_id", "frame", "h.*", "file_name")


def frame_plan_totals(plan: DataFrame) -> DataFrame:
    """Frames by video, and one row with null for all."""
    return plan.select("video_id", "frame").distinct().rollup("video_id").agg(F.count("*").alias("frames"))


def kept_ground_truth(det: DataFrame, start: int = 0, end: int | None = None, rate: int = 1, **filters) -> DataFrame:
    """The detections that go beside the frames; all of the range if no filter is active. Names of genders and ages stand for their codes too."""
    filters = with_codes(filters)
    rows = sample_frames(det, start, end, rate)
    return rows.where(detection_filter(**filters)) if has_filter(**filters) else rows
