"""Filters, statistics and groupings of detections. Predicates are plain Column expressions; none runs Python."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACK = ["seq_id", "track_id"]


def text_any(col: str, values: list[str]) -> Column:
    """Case-sensitive substring, any of the values."""
    return reduce(or_, [F.coalesce(F.col(col), F.lit("")).contains(v) for v in values])


def class_in(values: list[int]) -> Column:
    return F.col("class_id").isin([int(v) for v in values])


def visibility_in(values: list[float]) -> Column:
    return F.col("visibility").isin([float(v) for v in values])


def size_between(min_width=None, max_width=None, min_height=None, max_height=None) -> Column:
    tests = [F.col("bb_width") >= min_width if min_width is not None else None, F.col("bb_width") <= max_width if max_width is not None else None,
             F.col("bb_height") >= min_height if min_height is not None else None, F.col("bb_height") <= max_height if max_height is not None else None]
    return reduce(and_, [t for t in tests if t is not None], F.lit(True))


def expand_aliases(values: list[str], names: tuple[str, str, str], strict: bool = False) -> list[str]:
    """values with the codes 0, 1, 2 of the names among them; as coded only the first name that matches adds its code."""
    codes = [str(k) for k, name in enumerate(names) if name in values]
    return [*values, *(codes if strict else codes[:1])]


GENDERS, AGES = ("Unknown", "Male", "Female"), ("Unknown", "Juvenile", "Adult")


def detection_filter(class_id=(), species=(), gender=(), age=(), visibility=(), min_width=None, max_width=None, min_height=None, max_height=None, strict: bool = False) -> Column:
    """As coded: the class test; then the first active of species, gender and age alone decides; only without any of them do
    visibility and size count. strict: all active filters hold. An empty list is inactive; no filter keeps every row."""
    head = class_in(list(class_id)) if class_id else F.lit(True)
    texts = [text_any(c, list(v)) for c, v in (("species", species), ("gender", gender), ("age", age)) if v]
    rest = size_between(min_width, max_width, min_height, max_height)
    rest = visibility_in(list(visibility)) & rest if visibility else rest
    if strict:
        return reduce(and_, texts, head) & rest
    return head & (texts[0] if texts else rest)


def filter_detections(det: DataFrame, **filters) -> DataFrame:
    return det.where(detection_filter(**filters))


def has_filter(**filters) -> bool:
    return any(v is not None and v != () and v != [] for k, v in filters.items() if k != "strict")


def sample_frames(det: DataFrame, start: int = 0, end: int | None = None, rate: int = 1) -> DataFrame:
    """start <= frame < end and (frame - start) a multiple of rate."""
    f = F.col("frame")
    test = (f >= start) & ((f - start) % rate == 0)
    return det.where(test if end is None else test & (f < end))


def detections_at(det: DataFrame, frame: int) -> DataFrame:
    return det.where(F.col("frame") == frame)


def frame_window(det: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
    """start <= frame < end; an end of 0 or less is open."""
    return det.where((F.col("frame") >= start) & (F.col("frame") < end) if end > 0 else F.col("frame") >= start)


def filter_stats(det: DataFrame, pred: Column, by: str = "seq_id") -> DataFrame:
    """total, kept and percent (0 if empty) for each file, and one row with null for all."""
    kept = F.count_if(pred)
    n = F.count("*")
    return det.rollup(by).agg(n.alias("total"), kept.alias("kept"), F.when(n > 0, F.round(100.0 * kept / n, 4)).otherwise(0.0).alias("percent"))


def profile(det: DataFrame, file_col: str = "seq_id") -> DataFrame:
    """(name, value, low, high): a row for each distinct class, species, gender, age and visibility, with value; one for width and height each, with their range, [0, 0] without rows; one for files, with their number in low and high.

    Sorting each name's values as text gives the report; no row holds all values."""
    names = ("class_id", "species", "gender", "age", "visibility")
    none = F.lit(None).cast("bigint")
    pairs = det.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in names])).alias("p")).select("p.*").where("value is not null").distinct()
    span = lambda c: F.struct(F.lit(c[3:]).alias("name"), *[F.coalesce(f(c), F.lit(0)).cast("bigint").alias(k) for k, f in (("low", F.min), ("high", F.max))])
    ranges = det.agg(F.array(span("bb_width"), span("bb_height")).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    files = det.select(file_col).where(F.col(file_col).isNotNull()).distinct().agg(F.lit("files").alias("name"), F.count("*").alias("low"), F.count("*").alias("high"))
    return pairs.select("*", none.alias("low"), none.alias("high")).unionByName(ranges.unionByName(files).withColumn("value", F.lit(None).cast("string")))


def by_frame(det: DataFrame, *cols: str) -> DataFrame:
    """One row a frame; its detections in input order."""
    picked = F.transform(F.sort_array(F.collect_list(F.struct("line_no", *[c for c in cols if c != "line_no"]))), lambda x: F.struct(*[x[c].alias(c) for c in cols]))
    return det.groupBy("seq_id", "frame").agg(picked.alias("detections"))


def by_track(det: DataFrame, *cols: str) -> DataFrame:
    """One row a track; its detections by frame, ties in input order."""
    picked = F.transform(F.sort_array(F.collect_list(F.struct("frame", "line_no", *[c for c in cols if c != "frame"]))), lambda x: F.struct(*[x[c].alias(c) for c in cols]))
    return det.groupBy(*TRACK).agg(picked.alias("detections"))


def in_output_order(det: DataFrame) -> DataFrame:
    return det.orderBy("seq_id", "frame", "track_id", "line_no")


def available_frames(det: DataFrame, limit: int = 20) -> DataFrame:
    """One row a file: its first frames that have a detection."""
    return first_frames(det, limit).groupBy("seq_id").agg(F.sort_array(F.collect_list("frame")).alias("frames"))  # of limit rows at most


def first_frames(det: DataFrame, limit: int = 20) -> DataFrame:
    """The first frames that have a detection, for each file."""
    w = Window.partitionBy("seq_id").orderBy("frame")
    return det.select("seq_id", "frame").distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).drop("k")


def distinct_text(det: DataFrame, col: str) -> DataFrame:
    """The distinct values of a column, as text and in the order of text; one row each, sorted by range."""
    return det.select(F.col(col).cast("string").alias(col)).distinct().orderBy(col)


def decode_class(det: DataFrame, classes: DataFrame) -> DataFrame:
    """det with wikidata_id, class_gender, class_age and class_visibility; classes has 75 rows."""
    return det.join(F.broadcast(classes), "class_id", "left")


def species_summary(det: DataFrame) -> DataFrame:
    """Tracks and key frames for each species."""
    return det.groupBy("species").agg(F.count_distinct(*TRACK).alias("tracks"), F.count_if(F.col("is_propagated") == "0").alias("key_frames"))


def survey_overview(det: DataFrame) -> DataFrame:
    """One row: sequences, tracks, key frames, interpolated boxes, classes and frames' span.

    Counted by track and class first, so that what is distinct is counted over those few rows, and no row of det is expanded."""
    marked = lambda v: F.count_if(F.col("is_propagated") == v)
    by_track = det.groupBy(*TRACK, "class_id").agg(marked("0").alias("keys"), marked("1").alias("filled"), F.min("frame").alias("low"), F.max("frame").alias("high"))
    whole = F.when(F.col("seq_id").isNotNull() & F.col("track_id").isNotNull(), F.struct(*TRACK))  # a null is no value
    return by_track.agg(F.count_distinct("seq_id").alias("sequences"), F.count_distinct(whole).alias("tracks"), F.coalesce(F.sum("keys"), F.lit(0)).alias("key_frames"),
                        F.coalesce(F.sum("filled"), F.lit(0)).alias("interpolated"), F.count_distinct("class_id").alias("classes"), F.min("low").alias("first_frame"), F.max("high").alias("last_frame"))


def interpolation_stats(original: DataFrame, filled: DataFrame) -> DataFrame:
    """By file: rows in, rows marked as propagated in the output (those that were so before count too), rows out."""
    a = original.groupBy("seq_id").agg(F.count("*").alias("original"))
    b = filled.groupBy("seq_id").agg(F.count_if(F.col("is_propagated") == "1").alias("interpolated"), F.count("*").alias("total"))
    return a.join(b, "seq_id")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """For each key the row that comes last in order."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("r")).select("r.*")
