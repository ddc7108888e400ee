"""Queries on detections: filters, tracks, labels, frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from flocktab.functions import scalar as S
from flocktab.operators import detections as D
from flocktab.operators import flights as L
from flocktab.operators import frames as X
from flocktab.operators import tracks as T
from flocktab.sources.readers import class_dictionary
from flocktab.sources.writers import yolo_files

from .registry import query

DET = ("detections",)

#: The filled table in SQL, for a step.
FILL = """, seg AS (SELECT *, lead(frame) OVER w AS f1, lead(bb_left) OVER w AS l1, lead(bb_top) OVER w AS t1, lead(bb_width) OVER w AS w1, lead(bb_height) OVER w AS h1, lead(conf) OVER w AS c1, lead(visibility) OVER w AS v1
 FROM {src} WINDOW w AS (PARTITION BY seq_id, track_id ORDER BY frame, line_no)),
gaps AS (SELECT *, unnest(range(frame + {step}, f1, {step})) AS gf FROM seg WHERE f1 - frame > {step}),
filled AS (SELECT seq_id, line_no, frame, track_id, bb_left, bb_top, bb_width, bb_height, conf, class_id, visibility, species, gender, age, is_propagated FROM {src} UNION ALL
 SELECT seq_id, line_no, gf, track_id, CAST(round_even(bb_left + (l1 - bb_left) * ((gf - frame) / (f1 - frame)), 0) AS INT), CAST(round_even(bb_top + (t1 - bb_top) * ((gf - frame) / (f1 - frame)), 0) AS INT),
  CAST(round_even(bb_width + (w1 - bb_width) * ((gf - frame) / (f1 - frame)), 0) AS INT), CAST(round_even(bb_height + (h1 - bb_height) * ((gf - frame) / (f1 - frame)), 0) AS INT),
  conf + (c1 - conf) * ((gf - frame) / (f1 - frame)), class_id, visibility + (v1 - visibility) * ((gf - frame) / (f1 - frame)), species, gender, age, '1' FROM gaps)
"""
SHOWN = ["seq_id", "line_no", "frame", "track_id", "bb_left", "bb_top", "bb_width", "bb_height", "class_id", "species", "gender", "age", "is_propagated"]
LINEAR = "conf, visibility"


def fill(step: int, src: str = "detections") -> str:
    return FILL.format(step=step, src=src)


def shown(df, *more):
    return df.select(*SHOWN, "conf", "visibility", *more)


@query(", boar AS (SELECT * FROM detections WHERE species LIKE '%Wild boar%')" + fill(1, "boar") + "SELECT species, count(*) FILTER (is_propagated = '0') AS key_boxes, count(*) FILTER (is_propagated = '1') AS filled_boxes, count(DISTINCT (seq_id, track_id)) AS tracks FROM filled GROUP BY species", DET)
def flagship_species_boxes(t):
    filled = T.interpolate_tracks(D.filter_detections(t.detections, species=["Wild boar"]))
    return filled.groupBy("species").agg(F.count_if(F.col("is_propagated") == "0").alias("key_boxes"), F.count_if(F.col("is_propagated") == "1").alias("filled_boxes"), F.count_distinct("seq_id", "track_id").alias("tracks"))


NEXT = ["frame", *T.BOX, *T.LINEAR]


@query("SELECT seq_id, track_id, line_no, frame, " + ", ".join(f"lead({c}) OVER w AS next_{c}" for c in NEXT) + " FROM detections WINDOW w AS (PARTITION BY seq_id, track_id ORDER BY frame, line_no)", DET)
def w1_key_segments(t):
    return T.key_segments(t.detections).select("seq_id", "track_id", "line_no", "frame", *[F.col(f"nxt.{c}").alias(f"next_{c}") for c in NEXT])


@query(fill(1) + f"SELECT {', '.join(SHOWN)}, {LINEAR} FROM filled", DET)
def w2_interpolate_tracks(t):
    return shown(T.interpolate_tracks(t.detections, 1))


@query(fill(5) + f"SELECT {', '.join(SHOWN)}, {LINEAR} FROM filled", DET)
def w2_interpolate_step5(t):
    return shown(T.interpolate_tracks(t.detections, 5))


@query(fill(1) + "SELECT seq_id, original, interpolated, total FROM (SELECT seq_id, count(*) FILTER (is_propagated = '1') AS interpolated, count(*) AS total FROM filled GROUP BY seq_id) JOIN (SELECT seq_id, count(*) AS original FROM detections GROUP BY seq_id) USING (seq_id)", DET)
def a6_interpolation_stats(t):
    return D.interpolation_stats(t.detections, T.interpolate_tracks(t.detections))


@query("SELECT species, count(DISTINCT (seq_id, track_id)) AS tracks, count(*) FILTER (is_propagated = '0') AS key_frames FROM detections GROUP BY species", DET)
def a16_species_summary(t):
    return D.species_summary(t.detections)


@query("SELECT count(DISTINCT seq_id) AS sequences, count(DISTINCT (seq_id, track_id)) AS tracks, count(*) FILTER (is_propagated = '0') AS key_frames, count(*) FILTER (is_propagated = '1') AS interpolated, count(DISTINCT class_id) AS classes, min(frame) AS first_frame, max(frame) AS last_frame, any_value(hours) AS flight_hours, any_value(first_day) AS first_day, any_value(last_day) AS last_day FROM detections, (SELECT round(sum(90.0 * frame_count) / 3600, 6) AS hours, CAST(CAST(min(start_time) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(CAST(start_time AS TIMESTAMP) + to_seconds(90 * frame_count)) AS DATE) AS VARCHAR) AS last_day FROM flights)", ("detections", "flights"))
def a17_survey_overview(t):
    end = (F.col("flight_info.start_time").cast("timestamp") + F.make_dt_interval(secs=90 * F.col("frame_count"))).cast("string")
    flights = L.flight_overview(t.full_flights.withColumn("flight_info", F.col("flight_info").withField("end_time", end)))
    hours = flights.select(F.round("flight_hours", 6).alias("flight_hours"), *[F.col(f"period_{a}").cast("date").cast("string").alias(f"{b}_day") for a, b in (("start", "first"), ("end", "last"))])
    return D.survey_overview(t.detections).crossJoin(hours)  # one row each


@query("SELECT seq_id, line_no, frame, track_id FROM detections ORDER BY seq_id, frame, track_id, line_no", DET)
def o1_output_order(t):
    return D.in_output_order(t.detections).select("seq_id", "line_no", "frame", "track_id")


@query("SELECT line_no, class_id FROM detections WHERE class_id IN (2, 50, 51)", DET)
def f7_class_in(t):
    return t.detections.where(D.class_in([2, 50, 51])).select("line_no", "class_id")


@query("SELECT line_no, visibility FROM detections WHERE visibility IN (0.25, 1.0)", DET)
def f8_visibility_in(t):
    return t.detections.where(D.visibility_in([0.25, 1.0])).select("line_no", "visibility")


@query("SELECT line_no, species FROM detections WHERE contains(species, 'deer') OR contains(species, 'boar')", DET)
def f9_text_any(t):
    return t.detections.where(D.text_any("species", ["deer", "boar"])).select("line_no", "species")


@query("SELECT line_no, bb_width, bb_height FROM detections WHERE bb_width >= 15 AND bb_width <= 40 AND bb_height >= 10 AND bb_height <= 30", DET)
def f10_size_between(t):
    return t.detections.where(D.size_between(15, 40, 10, 30)).select("line_no", "bb_width", "bb_height")


@query("SELECT line_no, gender FROM detections WHERE contains(gender, 'Male') OR contains(gender, 'Female') OR contains(gender, '1')", DET)
def f11_expand_aliases(t):
    return t.detections.where(D.text_any("gender", D.expand_aliases(["Male", "Female"], D.GENDERS))).select("line_no", "gender")


@query("SELECT line_no, species, class_id, gender, bb_width FROM detections WHERE class_id IN (1, 2, 3, 4, 5, 6, 7, 8) AND contains(species, 'deer')", DET)
def f12_filter_coded(t):
    return D.filter_detections(t.detections, class_id=range(1, 9), species=["deer"], gender=["1"], min_width=30).select("line_no", "species", "class_id", "gender", "bb_width")


@query("SELECT line_no, species, class_id, gender, bb_width FROM detections WHERE class_id IN (1, 2, 3, 4, 5, 6, 7, 8) AND contains(species, 'deer') AND contains(gender, '1') AND bb_width >= 30", DET)
def f12_filter_strict(t):
    return D.filter_detections(t.detections, class_id=range(1, 9), species=["deer"], gender=["1"], min_width=30, strict=True).select("line_no", "species", "class_id", "gender", "bb_width")


@query("SELECT line_no, frame FROM detections WHERE frame >= 10 AND frame < 500 AND (frame - 10) % 7 = 0", DET)
def f13_sample_frames(t):
    return D.sample_frames(t.detections, 10, 500, 7).select("line_no", "frame")


@query("SELECT line_no, frame FROM detections WHERE frame = 100", DET)
def f18_detections_at(t):
    return D.detections_at(t.detections, 100).select("line_no", "frame")


@query("SELECT line_no, frame FROM detections WHERE frame >= 50 AND frame < 90", DET)
def f19_frame_window(t):
    return D.frame_window(t.detections, 50, 90).select("line_no", "frame")


@query("SELECT seq_id, count(*) AS total, count(*) FILTER (bb_width >= 30) AS kept, round(100.0 * count(*) FILTER (bb_width >= 30) / count(*), 4) AS \"percent\" FROM detections GROUP BY ROLLUP (seq_id)", DET)
def a2_filter_stats(t):
    return D.filter_stats(t.detections, D.size_between(min_width=30))


@query(
    " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS name, CAST({c} AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS low, CAST(NULL AS BIGINT) AS high FROM detections" for c in ("class_id", "species", "gender", "age", "visibility"))
    + "".join(f" UNION ALL SELECT '{c}', NULL, min(bb_{c}), max(bb_{c}) FROM detections" for c in ("width", "height")) + " UNION ALL SELECT 'files', NULL, count(DISTINCT seq_id), count(DISTINCT seq_id) FROM detections", DET)
def a3_profile(t):
    return D.profile(t.detections)


@query("SELECT seq_id, frame, count(*) AS n, string_agg(CAST(track_id AS VARCHAR), ',' ORDER BY line_no) AS tracks FROM detections GROUP BY seq_id, frame", DET)
def a4_by_frame(t):
    made = D.by_frame(t.detections, "track_id")
    return made.select("seq_id", "frame", F.size("detections").cast("bigint").alias("n"), F.array_join(F.transform("detections", lambda d: d["track_id"].cast("string")), ",").alias("tracks"))


@query("SELECT seq_id, track_id, count(*) AS n, string_agg(CAST(frame AS VARCHAR), ',' ORDER BY frame, line_no) AS frames FROM detections GROUP BY seq_id, track_id", DET)
def a5_by_track(t):
    made = D.by_track(t.detections, "frame", "bb_left")
    return made.select("seq_id", "track_id", F.size("detections").cast("bigint").alias("n"), F.array_join(F.transform("detections", lambda d: d["frame"].cast("string")), ",").alias("frames"))


@query("SELECT DISTINCT CAST(track_id AS VARCHAR) AS track_id FROM detections ORDER BY 1", DET)
def o3_string_order(t):
    return D.distinct_text(t.detections, "track_id")


@query("SELECT file_name FROM mot_files ORDER BY file_name", ("mot_files",))
def o4_file_order(t):
    return L.in_file_order(t.mot_files)


@query("SELECT seq_id, frame FROM (SELECT seq_id, frame, row_number() OVER (PARTITION BY seq_id ORDER BY frame) AS k FROM (SELECT DISTINCT seq_id, frame FROM detections)) WHERE k <= 20", DET)
def o5_first_frames(t):
    return D.first_frames(t.detections)


@query("SELECT seq_id, list(frame ORDER BY frame) AS frames FROM (SELECT seq_id, frame, row_number() OVER (PARTITION BY seq_id ORDER BY frame) AS k FROM (SELECT DISTINCT seq_id, frame FROM detections)) WHERE k <= 20 GROUP BY seq_id", DET)
def o5_available_frames(t):
    return D.available_frames(t.detections)


@query("SELECT seq_id, frame, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS lines FROM detections GROUP BY seq_id, frame", DET)
def o6_per_frame_order(t):
    return D.by_frame(t.detections, "line_no").select("seq_id", "frame", F.array_join(F.transform("detections", lambda d: d["line_no"].cast("string")), ",").alias("lines"))


# Labels

YOLO_SQL = "printf('%.6f', greatest(0.0, least(1.0, (bb_left + bb_width / 2.0) / 640.0))) || ' ' || printf('%.6f', greatest(0.0, least(1.0, (bb_top + bb_height / 2.0) / 512.0))) || ' ' || printf('%.6f', greatest(0.0, least(1.0, bb_width / 640.0))) || ' ' || printf('%.6f', greatest(0.0, least(1.0, bb_height / 512.0)))"
LABEL_SQL = "class_id || '-' || gender || '-' || age || '-' || printf('%.2f', visibility)"


@query(f"SELECT concat(seq_id, '_', frame, '.txt') AS label_file, string_agg({LABEL_SQL} || ' ' || {YOLO_SQL} || chr(10), '' ORDER BY line_no) AS content FROM detections GROUP BY seq_id, frame", DET)
def k2_yolo_files(t):
    return yolo_files(t.detections, 640, 512, ["class_id", "gender", "age", "visibility"])


@query("SELECT line_no, greatest(0.0, least(1.0, (bb_left + bb_width / 2.0) / 640.0)) AS cx, greatest(0.0, least(1.0, (bb_top + bb_height / 2.0) / 512.0)) AS cy, greatest(0.0, least(1.0, bb_width / 640.0)) AS w, greatest(0.0, least(1.0, bb_height / 512.0)) AS h FROM detections", DET)
def t6_yolo_box(t):
    box = S.yolo_box(*[F.col(c) for c in T.BOX], 640.0, 512.0)
    return t.detections.select("line_no", *[c.alias(n) for c, n in zip(box, ("cx", "cy", "w", "h"), strict=True)])


@query("SELECT line_no, (cx - w / 2) * 640 AS x1, (cy - h / 2) * 512 AS y1, (cx + w / 2) * 640 AS x2, (cy + h / 2) * 512 AS y2 FROM (SELECT line_no, greatest(0.0, least(1.0, (bb_left + bb_width / 2.0) / 640.0)) AS cx, greatest(0.0, least(1.0, (bb_top + bb_height / 2.0) / 512.0)) AS cy, greatest(0.0, least(1.0, bb_width / 640.0)) AS w, greatest(0.0, least(1.0, bb_height / 512.0)) AS h FROM detections)", DET)
def t8_yolo_to_pixels(t):
    x = S.yolo_to_pixels(*S.yolo_box(*[F.col(c) for c in T.BOX], 640.0, 512.0), 640.0, 512.0)
    return t.detections.select("line_no", *[c.alias(n) for c, n in zip(x, ("x1", "y1", "x2", "y2"), strict=True)])


@query("SELECT line_no, printf('%.2f', conf) AS conf2, printf('%.2f', visibility / 8) AS vis2 FROM detections", DET)
def t1_fmt_fixed(t):
    return t.detections.select("line_no", S.fmt_fixed(F.col("conf"), 2).alias("conf2"), S.fmt_fixed(F.col("visibility") / 8, 2).alias("vis2"))


@query("SELECT line_no, bb_left + CAST(floor(bb_width / 2.0) AS BIGINT) AS cx, bb_top + CAST(floor(bb_height / 2.0) AS BIGINT) AS cy, [bb_left, bb_top, bb_left + bb_width, bb_top, bb_left + bb_width, bb_top + bb_height, bb_left, bb_top + bb_height]::DOUBLE[] AS corners FROM detections", DET)
def t9_t10_box_geometry(t):
    cx, cy = S.box_center(*[F.col(c) for c in T.BOX])
    return t.detections.select("line_no", cx.alias("cx"), cy.alias("cy"), S.box_corners(*[F.col(c) for c in T.BOX]).alias("corners"))


@query("SELECT line_no, CASE WHEN species = 'Unknown' THEN 'Unknown' ELSE regexp_extract(species, '\\(([^)]*)\\)', 1) END AS short, '#' || track_id || ' ' || CASE WHEN contains(species, '(') THEN rtrim(split_part(species, '(', 2), ')') ELSE species END || ' (' || CASE WHEN visibility = 0 THEN 'Occluded' ELSE 'Visible' END || '/' || CASE age WHEN '0' THEN 'Unknown' WHEN '1' THEN 'Juvenile' ELSE 'Adult' END || '/' || CASE gender WHEN '0' THEN 'Unknown' WHEN '1' THEN 'Juvenile' ELSE 'Adult' END || ')' AS label, CASE gender WHEN '0' THEN 'Unknown' WHEN '1' THEN 'Male' ELSE 'Female' END AS sex FROM detections", DET)
def t20_t22_texts(t):
    return t.detections.select("line_no", S.species_short(F.col("species")).alias("short"), S.track_label().alias("label"), S.sex_text(F.col("gender"), strict=True).alias("sex"))


@query(", classes(class_id, wikidata_id, class_gender, class_age, class_visibility) AS (VALUES {classes}) SELECT line_no, class_id, wikidata_id, class_gender, class_age, class_visibility, wikidata_id || '-' || class_gender || '-' || class_age || '-' || class_visibility AS class_key FROM detections JOIN classes USING (class_id)".replace(
    "{classes}", ", ".join("({}, '{}', {}, {}, {})".format(k, *v.split("-")) for k, v in enumerate(__import__("flocktab.schemas", fromlist=["CLASSES"]).CLASSES))), DET)
def j11_decode_class(t):
    made = D.decode_class(t.detections, class_dictionary(t.spark).drop("class_key"))
    return made.select("line_no", "class_id", "wikidata_id", "class_gender", "class_age", "class_visibility", S.class_key(*[F.col(c) for c in ("wikidata_id", "class_gender", "class_age", "class_visibility")]).alias("class_key"))


# Boxes at frames

AT_SQL = fill(1) + """, targets AS (SELECT seq_id, unnest(range(0, 721)) AS frame FROM (SELECT DISTINCT seq_id FROM detections)),
ft AS (SELECT f.*, s.frame AS a, s.f1 AS b FROM (SELECT * FROM filled WHERE is_propagated = '1') f JOIN targets USING (seq_id, frame) JOIN seg s ON s.seq_id = f.seq_id AND s.track_id = f.track_id AND s.line_no = f.line_no),
boxes AS (SELECT seq_id, frame, track_id, line_no, bb_left, bb_top, bb_width, bb_height, conf, visibility, species, is_propagated, false AS interp, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM detections JOIN targets USING (seq_id, frame)
 UNION ALL SELECT seq_id, frame, track_id, line_no, bb_left, bb_top, bb_width, bb_height, conf, visibility, species, '0', true, a, b FROM ft)
"""


def _at(t, **more):
    """Every frame of every sequence; more: columns of the detections."""
    return T.boxes_at(t.detections.withColumns(more), _spans(t).select("seq_id", F.explode(F.sequence("first_frame", "last_frame")).alias("frame")))


@query(AT_SQL + f"SELECT seq_id, frame, track_id, line_no, bb_left, bb_top, bb_width, bb_height, {LINEAR}, interp, a AS kf_a, b AS kf_b FROM boxes", DET)
def j7_boxes_at(t):
    return _at(t).select("seq_id", "frame", "track_id", "line_no", *T.BOX, "conf", "visibility", F.col("_interpolated").alias("interp"), F.col("_kf_a_frame").alias("kf_a"), F.col("_kf_b_frame").alias("kf_b"))


@query(AT_SQL + "SELECT seq_id, frame, track_id, line_no, 'ID:' || track_id || ' | ' || CASE WHEN species = 'Unknown' THEN 'Unknown' ELSE regexp_extract(species, '\\(([^)]*)\\)', 1) END || ' | c:' || printf('%.2f', conf) || CASE WHEN interp THEN ' | interp [' || a || '-' || b || ']' ELSE '' END AS label FROM boxes", DET)
def p11_boxes_at_frame(t):
    # names are shortened once a detection, not once a box made of it
    return _at(t, short=S.species_short(F.col("species"))).select("seq_id", "frame", "track_id", "line_no", S.point_label(F.col("_interpolated"), F.col("_kf_a_frame"), F.col("_kf_b_frame"), F.col("short")).alias("label"))


SPANS = ", grid AS (SELECT seq_id, unnest(range(0, 721)) AS frame FROM (SELECT DISTINCT seq_id FROM detections))"


def _spans(t):
    return t.detections.select("seq_id").distinct().select("seq_id", F.lit(0).cast("bigint").alias("first_frame"), F.lit(720).cast("bigint").alias("last_frame"))


@query(SPANS + " SELECT g.seq_id, g.frame, d.line_no FROM grid g LEFT JOIN detections d ON d.seq_id = g.seq_id AND d.frame = g.frame", DET)
def j10_frame_grid(t):
    return T.frame_grid(t.detections, _spans(t)).select("seq_id", "frame", "line_no")


@query(SPANS + " SELECT g.seq_id, g.frame, count(d.line_no) AS n_detections FROM grid g LEFT JOIN detections d ON d.seq_id = g.seq_id AND d.frame = g.frame GROUP BY g.seq_id, g.frame", DET)
def a18_detections_per_frame(t):
    return T.detections_per_frame(t.detections, _spans(t))


def trail_sql(lo: str, size: str) -> str:
    return f"array_to_string(list_transform(list(CAST({lo} + CAST(floor({size} / 2.0) AS BIGINT) AS VARCHAR)) OVER w, lambda x: x), ',')"


def trail_text(trail: str = "trail"):
    """Both coordinates of a trail as text."""
    return [F.array_join(F.transform(F.col(f"{trail}.c{c}"), lambda v: v.cast("string")), ",").alias(f"{c}s") for c in "xy"]


TRAIL_SQL = f"{trail_sql('bb_left', 'bb_width')} AS xs, {trail_sql('bb_top', 'bb_height')} AS ys"


@query(f"SELECT line_no, {TRAIL_SQL}, count(*) OVER w > 1 AS shown FROM detections WHERE frame >= 100 WINDOW w AS (PARTITION BY seq_id, track_id ORDER BY frame, line_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", DET)
def w3_track_trails(t):
    return T.track_trails(t.detections, 5, 100).select("line_no", *trail_text(), "shown")


@query(fill(1) + f", shown AS (SELECT * FROM filled WHERE frame >= 100 AND frame < 160), tr AS (SELECT *, row_number() OVER (PARTITION BY seq_id, track_id ORDER BY frame, line_no) AS k FROM shown){SPANS} SELECT g.seq_id, g.frame, count(t.line_no) AS n_detections, count(*) FILTER (t.k > 1) AS n_trails, coalesce(sum(least(t.k, 20)), 0) AS n_points, coalesce(sum(bb_left + bb_width + bb_top + bb_height), 0) AS corners FROM grid g LEFT JOIN tr t ON t.seq_id = g.seq_id AND t.frame = g.frame WHERE g.frame >= 100 AND g.frame < 160 GROUP BY g.seq_id, g.frame", DET)
def p12_annotated_frames(t):
    rows = T.track_trails(D.frame_window(T.interpolate_tracks(t.detections), 100, 160), 20, 100)
    spans = _spans(t).select("seq_id", F.lit(100).cast("bigint").alias("first_frame"), F.lit(159).cast("bigint").alias("last_frame"))
    return T.frame_grid(rows, spans).groupBy("seq_id", "frame").agg(
        F.count("line_no").alias("n_detections"), F.count_if("shown").alias("n_trails"), F.coalesce(F.sum(F.size("trail")), F.lit(0)).alias("n_points"), F.coalesce(F.sum(F.col("bb_left") + F.col("bb_width") + F.col("bb_top") + F.col("bb_height")), F.lit(0)).alias("corners"))


# Neighbouring frames

NEAR = ", centres AS (SELECT DISTINCT seq_id, frame AS centre FROM detections), near AS (SELECT d.*, c.centre FROM centres c JOIN detections d ON d.seq_id = c.seq_id AND d.frame BETWEEN c.centre - 15 AND c.centre + 15)"
MERGED = NEAR + ", merged AS (SELECT seq_id, centre, track_id, arg_min(class_id, (frame, line_no)) AS class_id, min(bb_left) AS x_min, min(bb_top) AS y_min, max(bb_left + bb_width) AS x_max, max(bb_top + bb_height) AS y_max FROM near GROUP BY seq_id, centre, track_id)"


def _centres(t):
    return t.detections.select("seq_id", F.col("frame").alias("centre")).distinct()


def _near(t):
    return T.neighbour_labels(t.detections, _centres(t))


@query(NEAR + " SELECT seq_id, centre, frame, line_no FROM near", DET)
def j16_neighbour_labels(t):
    return _near(t).select("seq_id", "centre", "frame", "line_no")


@query(MERGED + " SELECT * FROM merged", DET)
def a9_merge_track_boxes(t):
    return T.merged_boxes(t.detections, _centres(t))


@query(MERGED + " SELECT seq_id, centre, track_id, class_id, greatest(0.0, least(1.0, (x_min + (x_max - x_min) / 2.0) / 640.0)) AS cx, greatest(0.0, least(1.0, (y_min + (y_max - y_min) / 2.0) / 512.0)) AS cy, greatest(0.0, least(1.0, (x_max - x_min) / 640.0)) AS w, greatest(0.0, least(1.0, (y_max - y_min) / 512.0)) AS h FROM merged", DET)
def p13_merged_neighbour_labels(t):
    m = T.merged_boxes(t.detections, _centres(t))
    box = S.yolo_box(F.col("x_min"), F.col("y_min"), F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"), 640.0, 512.0)
    return m.select("seq_id", "centre", "track_id", "class_id", *[c.alias(n) for c, n in zip(box, ("cx", "cy", "w", "h"), strict=True)])


@query("SELECT line_no, min(bb_left) OVER w AS x_min, max(bb_left + bb_width) OVER w AS x_max, min(bb_top) OVER w AS y_min, max(bb_top + bb_height) OVER w AS y_max FROM detections WINDOW w AS (PARTITION BY seq_id, track_id ORDER BY frame RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING)", DET)
def w4_neighbourhood(t):
    return T.neighbourhood(t.detections).select("line_no", "x_min", "x_max", "y_min", "y_max")


@query("SELECT seq_id, track_id, arg_min(class_id, (frame, line_no)) AS first_class FROM detections GROUP BY seq_id, track_id", DET)
def w5_first_state(t):
    return T.first_state(t.detections)


# Frame plan

PAIRS = ", mot AS (SELECT split_part(file_name, '_', 1) AS video_id, max(file_name) AS mot_file FROM mot_files GROUP BY 1), pairs AS (SELECT v.*, m.mot_file FROM videos v LEFT JOIN mot m USING (video_id))"
VID = ("detections", "videos", "mot_files")


def _by_video(t):
    """Each track as the annotations of the video with its number."""
    return t.detections.withColumn("video_id", F.col("track_id").cast("string"))


@query(PAIRS + " SELECT video_id, CASE WHEN CAST(video_id AS BIGINT) % 4 = 0 THEN video_id || '_second.mp4' ELSE file_name END AS file_name, mot_file FROM pairs", VID)
def j1_pair_videos(t):
    """Some ids have three videos: the last by name counts."""
    of = lambda n, name: t.videos.where(F.col("video_id").cast("bigint") % n == 0).withColumn("file_name", F.concat("video_id", F.lit(name)))
    videos = t.videos.unionByName(of(4, "_second.mp4")).unionByName(of(2, "_a_first.mp4"))
    return X.pair_videos(videos, t.mot_files).select("video_id", "file_name", "mot_file")


PLAN = PAIRS + """, fr AS (SELECT *, unnest(range(10, least(total_frames, 150), 5)) AS frame FROM pairs WHERE total_frames > 10),
plan AS (SELECT * FROM fr WHERE mot_file IS NULL OR EXISTS (SELECT 1 FROM detections d WHERE CAST(d.track_id AS VARCHAR) = fr.video_id AND d.frame = fr.frame AND d.class_id >= 0 AND (contains(d.gender, 'Female') OR contains(d.gender, '2'))))"""


def _plan(t):
    """Frames by the name of a sex; the annotations have codes."""
    return X.frame_plan(X.pair_videos(t.videos, t.mot_files), _by_video(t), 10, 150, 5, gender=["Female"])


@query(PLAN + " SELECT video_id, frame, 'thermal' AS modality, 0 AS x0, 1024 AS x1, printf('%s_%08d.png', video_id, frame) AS file_name FROM plan UNION ALL SELECT video_id, frame, 'rgb', 1024, 2048, printf('%s_%08d.png', video_id, frame) FROM plan", VID)
def p2_frame_plan(t):
    return _plan(t)


@query(PLAN + " SELECT video_id, count(*) AS frames FROM plan GROUP BY ROLLUP (video_id)", VID)
def a15_frame_plan_totals(t):
    return X.frame_plan_totals(_plan(t))


@query(PLAN + " SELECT video_id, frame FROM plan", VID)
def j2_frames_with_matches(t):
    return _plan(t).select("video_id", "frame").distinct()


@query("SELECT track_id, line_no, frame FROM detections WHERE frame >= 10 AND frame < 150 AND (frame - 10) % 5 = 0 AND contains(species, 'deer')", DET)
def k6_kept_ground_truth(t):
    return X.kept_ground_truth(_by_video(t), 10, 150, 5, species=["deer"]).select("track_id", "line_no", "frame")


@query("SELECT file_name, split_part(file_name, '_', 1) AS id, regexp_replace(file_name, '\\.[^.]*$', '') AS stem, printf('%s_%08d.png', split_part(file_name, '_', 1), total_frames) AS frame_name, CAST(total_frames AS BIGINT) AS frame_no, 1024 AS half FROM videos", ("videos",))
def t11_t14_names(t):
    name = S.frame_file(S.file_id(F.col("file_name")), F.col("total_frames"))
    return t.videos.select("file_name", S.seq_id(F.col("file_name")).alias("id"), S.stem(F.col("file_name")).alias("stem"), name.alias("frame_name"), S.frame_index(name).alias("frame_no"), S.split_halves(F.col("width"))[0]["x1"].alias("half"))
