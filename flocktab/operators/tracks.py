"""Time-series operators on tracks. A track's rows are shuffled once, by (seq_id, track_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flocktab.functions.scalar import box_center, lerp, round_even

from .levels import keyed_points, keyed_ranges, keys, level_of

TRACK = ["seq_id", "track_id"]
BOX = ["bb_left", "bb_top", "bb_width", "bb_height"]
LINEAR = ["conf", "visibility"]


def key_segments(det: DataFrame) -> DataFrame:
    """det with nxt: frame, box, conf and visibility of the track's next row; null on the last. Ties on frame keep input order."""
    w = Window.partitionBy(*TRACK).orderBy("frame", "line_no")
    return det.withColumn("nxt", F.lead(F.struct("frame", *BOX, *LINEAR)).over(w))


def _between(t):
    """Columns of a filled row at share t of its segment."""
    return [round_even(lerp(F.col(c), F.col(f"nxt.{c}"), t)).cast("int").alias(c) for c in BOX] + [lerp(F.col(c), F.col(f"nxt.{c}"), t).alias(c) for c in LINEAR]


def interpolate_tracks(det: DataFrame, step: int = 1) -> DataFrame:
    """det and, in every gap of more than step frames, rows at start + step, start + 2 step, ... below the next row's frame.

    Boxes are rounded half to even, conf and visibility are linear, the rest comes from the row before the gap;
    is_propagated is 1. One window and one explode: originals are the explode's first element, so det is read once.
    """
    return filled(key_segments(det), det.columns, step)


def filled(seg: DataFrame, columns: list[str], step: int = 1, shown: Column | None = None) -> DataFrame:
    """The given columns of seg (rows with nxt) and of the rows in its gaps; of rows that are not shown the gaps alone."""
    gap = F.col("nxt.frame") - F.col("frame")
    n = F.when(gap > step, F.floor((gap - 1) / step)).otherwise(F.lit(0).cast("bigint"))
    first = F.lit(0).cast("bigint") if shown is None else F.when(shown, 0).otherwise(F.lit(1)).cast("bigint")
    # the row itself is number 0; sequence() raises on an empty range, and a null is no row
    rows = seg.withColumn("__n", n).select("*", F.explode(F.when(F.col("__n") >= first, F.sequence(first, F.col("__n"), F.lit(1).cast("bigint")))).alias("__k"))
    ahead, own = F.col("__k") * step, F.col("__k") == 0
    new = dict(zip(BOX + LINEAR, _between(ahead / gap), strict=True))
    out = {"frame": F.col("frame") + ahead, "is_propagated": F.when(own, F.col("is_propagated")).otherwise(F.lit("1"))}
    out |= {c: F.when(own, F.col(c)).otherwise(new[c]) for c in BOX + LINEAR}
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in columns])


def boxes_at(det: DataFrame, targets: DataFrame) -> DataFrame:
    """Boxes of every track at the target frames (seq_id, frame): rows exactly there, else the linear interpolation between the
    last row before and the first after; none outside a track's span. is_propagated is that of the earlier row.

    A segment lies in bins of about its own length, two at most, and a target has one key for each level of lengths that there
    is, so the range test becomes an equi-join and no segment has more rows for being long. A segment begins with its own row, so
    det is shuffled once, by track, for rows at targets and between them; levels are those of the span of all frames.
    """
    want = targets.select("seq_id", "frame").distinct()
    out = [c for c in det.columns if c not in ("seq_id", "frame")]
    seg = key_segments(det).where("frame is not null").withColumnRenamed("frame", "f0").withColumn("__end", F.greatest("f0", F.col("nxt.frame") - 1))
    ranges = keyed_ranges(seg, [(F.col("f0"), F.col("__end"))], 8.0)
    levels = det.agg(F.sequence(F.lit(0), level_of(F.max("frame") - F.min("frame"), 8.0)).alias("levels")).scalar()
    hit = keyed_points(want, [F.col("frame")], ranges, 8.0, levels).join(ranges, ["seq_id", *keys(1)]).where((F.col("frame") >= F.col("f0")) & (F.col("frame") <= F.col("__end")))
    inside = F.col("frame") > F.col("f0")
    t = (F.col("frame") - F.col("f0")) / F.nullif(F.col("nxt.frame") - F.col("f0"), F.lit(0))
    new = dict(zip(BOX + LINEAR, _between(t), strict=True))
    return hit.select("seq_id", "frame", *[F.when(inside, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in out], inside.alias("_interpolated"),
                      F.when(inside, F.col("f0")).alias("_kf_a_frame"), F.when(inside, F.col("nxt.frame")).alias("_kf_b_frame"))


def track_trails(det: DataFrame, n: int, start: int = 0, apart: tuple[str, ...] = ()) -> DataFrame:
    """det from frame start on, with trail: the track's last n box centres up to this row, and shown (more than one). Rows that differ in the columns `apart` have trails of their own."""
    cx, cy = box_center(*[F.col(c) for c in BOX])
    w = Window.partitionBy(*TRACK, *apart).orderBy("frame", "line_no").rowsBetween(-(n - 1), 0)
    return det.where(F.col("frame") >= start).withColumn("trail", F.collect_list(F.struct(cx.alias("cx"), cy.alias("cy"))).over(w)).withColumn("shown", F.size("trail") > 1)


def neighbourhood(det: DataFrame, before: int = 15, after: int = 15) -> DataFrame:
    """det with the box that encloses the track's boxes of the frames around."""
    w = Window.partitionBy(*TRACK).orderBy("frame").rangeBetween(-before, after)
    right, bottom = F.col("bb_left") + F.col("bb_width"), F.col("bb_top") + F.col("bb_height")
    return det.withColumns({"x_min": F.min("bb_left").over(w), "y_min": F.min("bb_top").over(w), "x_max": F.max(right).over(w), "y_max": F.max(bottom).over(w)})


def first_state(det: DataFrame) -> DataFrame:
    """The first row's class for each track."""
    return det.groupBy(*TRACK).agg(F.min_by("class_id", F.struct("frame", "line_no")).alias("first_class"))


def frame_grid(det: DataFrame, spans: DataFrame) -> DataFrame:
    """Every frame of spans (seq_id, first_frame, last_frame) with its detections; frames without one stay."""
    frames = spans.where("first_frame <= last_frame").select("seq_id", F.explode(F.sequence("first_frame", "last_frame")).alias("frame"))
    return frames.join(det, ["seq_id", "frame"], "left")


def detections_per_frame(det: DataFrame, spans: DataFrame) -> DataFrame:
    """Detections of every frame, zero included. Counted before the join: one row a frame is shuffled, not one a detection."""
    frames = spans.where("first_frame <= last_frame").select("seq_id", F.explode(F.sequence("first_frame", "last_frame")).alias("frame"))
    return frames.join(det.groupBy("seq_id", "frame").agg(F.count("*").alias("n")), ["seq_id", "frame"], "left").select("seq_id", "frame", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_detections"))


def neighbour_labels(det: DataFrame, centres: DataFrame, before: int = 15, after: int = 15) -> DataFrame:
    """Detections of the frames around each centre (seq_id, centre); order: before, centre, after, as frames ascend."""
    around = centres.select("seq_id", "centre", F.explode(F.sequence(F.col("centre") - before, F.col("centre") + after)).alias("frame"))
    return around.join(det, ["seq_id", "frame"])


def merge_track_boxes(labels: DataFrame) -> DataFrame:
    """For each centre and track the box that encloses all its states, and the class of the first state.

    States before the centre come first, then the centre, then those after.
    """
    order = F.struct(F.when(F.col("frame") < F.col("centre"), 0).when(F.col("frame") == F.col("centre"), 1).otherwise(2), F.col("frame"), F.col("line_no"))
    right, bottom = F.col("bb_left") + F.col("bb_width"), F.col("bb_top") + F.col("bb_height")
    return labels.groupBy("seq_id", "centre", "track_id").agg(F.min_by("class_id", order).alias("class_id"), F.min("bb_left").alias("x_min"), F.min("bb_top").alias("y_min"), F.max(right).alias("x_max"), F.max(bottom).alias("y_max"))


def merged_boxes(det: DataFrame, centres: DataFrame, before: int = 15, after: int = 15) -> DataFrame:
    """merge_track_boxes(neighbour_labels(det, centres)), without a row for each centre and state.

    Sliding extremes: frames are cut into blocks as long as the span around a centre, which so lies in two blocks at most. Within a
    block each state has the extremes of all states up to it, and of all from it on; a span's are the latter of its first state in
    the first block and the former of its last in the second. One shuffle of det, then one lookup a centre and track.
    """
    n = before + after + 1
    own = [*TRACK, "block"]
    right, bottom = F.col("bb_left") + F.col("bb_width"), F.col("bb_top") + F.col("bb_height")
    corners = {"x_min": (F.min, F.col("bb_left")), "y_min": (F.min, F.col("bb_top")), "x_max": (F.max, right), "y_max": (F.max, bottom)}
    rows = det.where("track_id is not null").withColumn("block", F.floor(F.col("frame") / n))
    order = ["frame", "line_no"]
    upto = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy(*own).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    extremes = lambda w: F.struct(F.first("class_id").over(w).alias("class_id"), *[f(c).over(w).alias(name) for name, (f, c) in corners.items()])
    states = rows.repartition(*[F.col(c) for c in TRACK]).select(*own, *order, extremes(upto).alias("upto"), extremes(onward).alias("onward"))
    blocks = states.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct(*order, "upto", "onward"))).alias("states"))
    # a span that begins in a block reads its states and the next one's; where a track has only the latter, a block is put before
    w = Window.partitionBy(*TRACK).orderBy("block")
    near = lambda f, d: F.when(f("block").over(w) == F.col("block") + d, f("states").over(w))
    spans = blocks.select(*own, "states", near(F.lead, 1).alias("next"), near(F.lag, -1).isNull().alias("alone"))
    empty = F.array().cast(blocks.schema["states"].dataType)
    pair = lambda block, a, b: F.struct(block.alias("block"), a.alias("a"), F.coalesce(b, empty).alias("b"))
    spans = spans.select(*TRACK, F.explode(F.array_compact(F.array(pair(F.col("block"), F.col("states"), F.col("next")), F.when(F.col("alone"), pair(F.col("block") - 1, empty, F.col("states")))))).alias("s")).select(*TRACK, "s.*")
    low, high = F.col("centre") - before, F.col("centre") + after
    at = centres.select("seq_id", "centre", F.floor(low / n).alias("block"))
    found = at.join(spans, ["seq_id", "block"])
    a = F.get(F.filter("a", lambda x: x["frame"] >= low), F.lit(0))["onward"]
    b = F.try_element_at(F.filter("b", lambda x: x["frame"] <= high), F.lit(-1))["upto"]
    ends = found.select("seq_id", "centre", "track_id", a.alias("a"), b.alias("b")).where("a is not null or b is not null")
    both = {name: (F.least if f is F.min else F.greatest)(F.col(f"a.{name}"), F.col(f"b.{name}")) for name, (f, _) in corners.items()}
    return ends.select("seq_id", "centre", "track_id", F.when(F.col("a").isNotNull(), F.col("a.class_id")).otherwise(F.col("b.class_id")).alias("class_id"), *[c.alias(name) for name, c in both.items()])
