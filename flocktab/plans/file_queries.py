"""Sources and sinks: tables are written in the formats of files, read back, and compared as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flocktab.functions import scalar as S
from flocktab.operators import dem as M
from flocktab.sources import readers as R
from flocktab.sources import writers as W
from flocktab.sources.named_files import write_archives, write_named
from flocktab.sources.writers import write_mot
from flocktab.streaming.annotations import filter_stream

from . import jobs
from .adapters import CELL_H, CELL_W
from .annotation_queries import DET, LABEL_SQL, YOLO_SQL, fill
from .geo_queries import CELLS, NORMALS
from .registry import query, shared_folder


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


def _named(t, rows: DataFrame, folders: bool = False) -> str:
    """A folder with rows (name, value) as files of these names."""
    folder = _folder(t)
    write_named(rows, folder, "name", "value", folders=folders)
    return folder


def _annotations(t) -> str:
    """The detections as annotation files, one a sequence."""
    folder = _folder(t)
    W.write_mot(t.detections.withColumn("file_name", F.concat("seq_id", F.lit("_gt.txt"))), folder)
    return folder


FIELDS = ["frame", "track_id", "bb_left", "bb_top", "bb_width", "bb_height", "conf", "class_id", "visibility", "species", "gender", "age", "is_propagated"]
TEXT_SQL = ", ".join(f"CAST(printf('%.2f', {c}) AS DOUBLE) AS {c}" if c in ("conf", "visibility") else c for c in FIELDS)


@query(f"SELECT seq_id || '_gt.txt' AS file_name, seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY line_no) - 1 AS line_no, {TEXT_SQL} FROM detections", DET)
def s1_k1_mot_files(t):
    return R.read_mot(t.spark, _annotations(t)).select("file_name", "seq_id", "line_no", *FIELDS)


@query(fill(1) + f"SELECT seq_id || '_gt_full.txt' AS file_name, {TEXT_SQL} FROM filled", DET)
def p3_interpolate_files(t):
    target = _folder(t)
    jobs.interpolate_files(t.spark, _annotations(t), target, 1, "_full")
    return R.read_mot(t.spark, target).select("file_name", *FIELDS)


@query(fill(3) + "SELECT seq_id || '_gt.txt' AS seq_id, count(*) FILTER (is_propagated = '0') AS original, count(*) FILTER (is_propagated = '1') AS interpolated, count(*) AS total FROM filled GROUP BY seq_id", DET)
def p3_a6_interpolate_stats(t):
    return jobs.interpolate_files(t.spark, _annotations(t), _folder(t), 3)


@query(f"SELECT seq_id || '_gt_part.txt' AS file_name, {TEXT_SQL} FROM detections WHERE class_id IN (1, 2, 3, 4, 5, 6, 7, 8) AND contains(species, 'deer') AND (contains(gender, 'Male') OR contains(gender, '1')) AND bb_width >= 20", DET)
def p4_filter_files(t):
    target = _folder(t)
    jobs.filter_files(t.spark, _annotations(t), target, "_part", gender=["Male"], strict=True, class_id=range(1, 9), species=["deer"], min_width=20)
    return R.read_mot(t.spark, target).select("file_name", *FIELDS)


@query("SELECT seq_id || '_gt.txt' AS seq_id, count(*) AS total, count(*) FILTER (contains(age, 'Adult') OR contains(age, '2')) AS kept, round(100.0 * count(*) FILTER (contains(age, 'Adult') OR contains(age, '2')) / count(*), 4) AS \"percent\" FROM detections GROUP BY seq_id UNION ALL SELECT NULL, count(*), count(*) FILTER (contains(age, 'Adult') OR contains(age, '2')), round(100.0 * count(*) FILTER (contains(age, 'Adult') OR contains(age, '2')) / count(*), 4) FROM detections", DET)
def p4_a2_filter_stats(t):
    return jobs.filter_files(t.spark, _annotations(t), _folder(t), age=["Adult"])


@query(f"SELECT concat(seq_id, '_', frame, '.txt') AS label_file, string_agg({LABEL_SQL} || ' ' || {YOLO_SQL} || chr(10), '' ORDER BY line_no) AS content FROM detections GROUP BY seq_id, frame", DET)
def p5_label_files(t):
    """From annotation files to label files, one a frame, as they are on disk."""
    target = _folder(t)
    jobs.label_files(t.spark, _annotations(t), target, 640, 512, ["class_id", "gender", "age", "visibility"])
    return t.spark.read.text(target, wholetext=True).select(F.col("_metadata.file_name").alias("label_file"), F.col("value").alias("content"))


@query(f"""SELECT seq_id || '_gt.txt' AS file_name, coalesce(string_agg(concat_ws(',', frame, track_id, bb_left, bb_top, bb_width, bb_height, printf('%.2f', conf), class_id, printf('%.2f', visibility), species, gender, age, is_propagated), chr(10) ORDER BY line_no)
 FILTER (WHERE frame >= 10 AND frame < 400 AND (frame - 10) % 5 = 0 AND class_id < 8 AND (contains(gender, 'Male') OR contains(gender, '1'))) || chr(10), '') AS content FROM detections GROUP BY seq_id""", DET)
def k6_ground_truth_files(t):
    """By the name of a sex where files have codes. Every annotation file has its ground truth, an empty one where no row is kept, and of two of one id the last by name counts."""
    source, target = _folder(t), _folder(t)
    files = t.detections.withColumn("file_name", F.concat("seq_id", F.lit("_marks.csv")))
    write_mot(files, source)
    write_mot(files.where("seq_id < '3'").withColumns({"file_name": F.concat("seq_id", F.lit("_early.txt")), "bb_left": F.lit(1)}), source)
    counts = jobs.ground_truth_files(t.spark, source, target, 10, 400, 5, class_id=list(range(8)), gender=["Male"], strict=True)
    spare = counts.where("rows = 0").select(F.col("seq_id").alias("file_name"), F.lit("").alias("content"))  # Spark reads no file without a byte
    return t.spark.read.text(target, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content")).unionByName(spare)


@query(f"SELECT seq_id || '_gt_part.txt' AS file_name, {TEXT_SQL} FROM detections WHERE bb_width >= 20 AND class_id IN (1, 2, 3, 4, 5, 6, 7, 8)", DET)
def s1_stream_filter_files(t):
    """The filter job on a stream: files arrive in three parts, and each run goes on from the checkpoint of the one before, one file a batch."""
    source, target, state = _folder(t), _folder(t), _folder(t)
    files = t.detections.withColumn("file_name", F.concat("seq_id", F.lit("_gt.txt")))
    for k in range(3):
        write_mot(files.where(F.pmod(F.crc32(F.col("file_name").cast("binary")), F.lit(3)) == k), source)
        filter_stream(t.spark, source, target, state, "_part", files_a_batch=2, class_id=list(range(1, 9)), min_width=20).awaitTermination()
    return R.read_mot(t.spark, target).select("file_name", *FIELDS)


def _texts(t, line) -> DataFrame:
    """(seq_id, value): the annotation lines of each sequence as one text, each as line(text, place) makes it."""
    rows = W.format_mot(t.detections).select("seq_id", "line_no", "line")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x, k: line(x["line"], k))
    return rows.groupBy("seq_id").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value"))


@query(f"SELECT seq_id || '_gt.txt' AS file_name, {TEXT_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY line_no) - 1 AS k FROM detections) WHERE k % 5 <> 0 AND k % 7 <> 1", DET)
def f14_f20_short_and_comment_rows(t):
    """Every fifth line is a comment, every seventh has five fields only, some lines are empty."""
    made = lambda x, k: F.when(k % 5 == 0, F.concat(F.lit("# "), x)).when(k % 7 == 1, F.substring_index(x, ",", 5)).when(k % 11 == 3, F.concat(F.lit("\n"), x)).otherwise(x)
    folder = _named(t, _texts(t, made).withColumn("name", F.concat("seq_id", F.lit("_gt.txt"))))
    return R.read_mot(t.spark, folder, "point").select("file_name", *FIELDS)


@query(f"SELECT 'flight_' || seq_id || '.zip' AS archive, 2 AS members, seq_id || '_gt.txt' AS file_name, seq_id, {TEXT_SQL} FROM detections", DET)
def s11_mot_archives(t):
    """Archives of an annotation file and a video each, of one name in all, as files; members are read from their places."""
    archive = F.concat(F.lit("flight_"), "seq_id", F.lit(".zip")).alias("archive")
    rows = W.format_mot(t.detections).select(archive, F.concat("seq_id", F.lit("/"), "seq_id", F.lit("_gt.txt")).alias("member"), "line_no", "line")
    videos = t.detections.select(archive).distinct().select("archive", F.lit("x.mp4").alias("member"), F.lit(0).cast("bigint").alias("line_no"), F.lit("..").alias("line"))
    folder = _folder(t)
    write_archives(rows.unionByName(videos), folder, "archive", "member", "line", ("line_no",))
    return R.read_mot_archives(t.spark, folder).select("archive", "members", "file_name", "seq_id", *FIELDS)


FLAGS = ["contains_occluded_frames", "contains_unoccluded_frames", "contains_unknown_sex", "contains_male", "contains_female", "contains_unknown_age", "contains_juvenile", "contains_adult"]


@query("SELECT flight_key, split, frame_count, weather, drone_name, wikidata_id, species_name, " + ", ".join(FLAGS) + ", num_labels, CAST(num_label_states AS INT) AS num_label_states FROM flights LEFT JOIN flight_species USING (flight_key)", ("flights", "flight_species"))
def s2_flight_metadata(t):
    """Documents in arrays of some hundreds a file, however many there are."""
    docs = t.full_flights.select("flight_key", F.to_json(F.struct("flight_key", "split", "frame_count", "flight_info", "species_present")).alias("doc"))
    part = F.pmod(F.crc32(F.col("flight_key").cast("binary")), F.lit(max(32, t.flights.count() // 500)))
    files = docs.groupBy(F.concat(part.cast("string"), F.lit("_metadata.json")).alias("name")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("doc"), ","), F.lit("]")).alias("value"))
    files = files.unionByName(t.spark.createDataFrame([("broken_metadata.json", '[{"flight_key": "x"')], "name string, value string"))
    made = R.read_flight_metadata(t.spark, _named(t, files))
    rows = made.select("flight_key", "split", "frame_count", "flight_info.weather", "flight_info.drone_name", F.explode_outer("species_present").alias("wikidata_id", "s"))
    return rows.select("flight_key", "split", "frame_count", "weather", "drone_name", "wikidata_id", "s.species_name", *[f"s.{c}" for c in FLAGS], "s.num_labels", "s.num_label_states")


@query("SELECT CAST(dense_rank() OVER (ORDER BY deposition_id % 10, deposition_id) - 1 AS INT) AS line_no, part, deposition_id, flight_id FROM manifest_flights", ("manifest_flights",))
def s3_manifest(t):
    """One document of 47 parts, which do not stand in the order of their numbers."""
    parts = t.manifest_flights.groupBy("part", "deposition_id").agg(F.collect_list("flight_id").alias("flights"))
    order = F.struct((F.col("deposition_id") % 10).alias("k"), F.col("deposition_id").alias("d"), F.struct("part", "deposition_id", "flights").alias("p"))
    doc = parts.agg(F.to_json(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["p"])).alias("value"))
    made = R.read_manifest(t.spark, _named(t, doc.withColumn("name", F.lit("manifest.json"))))
    return made.select("line_no", "part", "deposition_id", F.explode("flights").alias("flight_id"))


@query("SELECT flight_id, flight_id || '_matched_poses.json' AS file_name, pos, lat, lng, alt, pitch, roll, yaw, CASE WHEN pos % 2 = 0 THEN 'odd' || pos END AS extra, 'v' || flight_id AS version FROM poses", ("poses",))
def s4_k3_pose_files(t):
    """With a key that some images have as null, and one of the document."""
    rows = t.poses.withColumns({"file_name": F.concat("flight_id", F.lit("_matched_poses.json")), "extra": F.when(F.col("pos") % 2 == 0, F.concat(F.lit("odd"), F.col("pos").cast("string"))), "document": F.struct(F.concat(F.lit("v"), "flight_id").alias("version"))})
    folder = _folder(t)
    W.write_poses(rows, folder, folders=True)
    return R.read_poses(t.spark, folder).select("flight_id", "file_name", "pos", "lat", "lng", "alt", "pitch", "roll", "yaw", "extra", "document.version")


@query("SELECT flight_id || '_matched_dem.json' AS file_name, flight_id, crs, origin_x, origin_y, origin_z, CAST(CAST(origin_z AS INT) + 1 AS INT) AS width FROM dem_meta", ("dem_meta",))
def s5_dem_metadata(t):
    doc = F.to_json(F.struct((F.col("origin_z").cast("int") + 1).alias("width"), F.lit(2).alias("height"), "crs", F.array("origin_x", "origin_y", "origin_z").alias("origin")))
    made = R.read_dem_metadata(t.spark, _named(t, t.dem_meta.select(F.concat("flight_id", F.lit("_matched_dem.json")).alias("name"), doc.alias("value")), folders=True), recursive=True)
    return made.select("file_name", "flight_id", "crs", "origin_x", "origin_y", "origin_z", "width")


@query("SELECT DISTINCT seq_id || '_correction.json' AS file_name, CASE WHEN CAST(seq_id AS INT) % 3 = 0 THEN 0.0::DOUBLE ELSE CAST(seq_id AS DOUBLE) END AS shift_x, 0.0::DOUBLE AS shift_y, CASE WHEN CAST(seq_id AS INT) % 2 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS turn_z FROM detections", DET)
def s6_corrections(t):
    """Some without a translation, some without a rotation."""
    n = F.col("seq_id").cast("int")
    doc = F.to_json(F.struct(F.when(n % 3 != 0, F.struct(n.cast("double").alias("x"))).alias("translation"), F.when(n % 2 != 0, F.struct(F.lit(0.5).alias("z"))).alias("rotation")))
    made = R.read_corrections(t.spark, _named(t, t.detections.select("seq_id").distinct().select(F.concat("seq_id", F.lit("_correction.json")).alias("name"), doc.alias("value"))))
    return made.select("file_name", F.col("translation.x").alias("shift_x"), F.col("translation.y").alias("shift_y"), F.col("rotation.z").alias("turn_z"))


@query("SELECT 'flight_' || flight_id || '.zip' AS name, CASE WHEN part % 2 = 0 THEN 'https://self/' ELSE 'https://load/' END || flight_id AS url FROM manifest_flights WHERE part % 5 <> 0", ("manifest_flights",))
def s7_listing(t):
    """By filename or key, with a download link or the self link; entries without a link are left out."""
    name, part = F.concat(F.lit("flight_"), "flight_id", F.lit(".zip")), F.col("part")
    link = lambda kind: F.concat(F.lit(f"https://{kind}/"), "flight_id")
    links = F.when(part % 5 != 0, F.struct(F.when(part % 2 != 0, link("load")).otherwise(F.lit("")).alias("download"), link("self").alias("self")))
    file = F.struct(F.when(part % 3 == 0, name).alias("filename"), F.when(part % 3 != 0, name).alias("key"), links.alias("links"))
    docs = t.manifest_flights.groupBy("part").agg(F.to_json(F.struct(F.collect_list(file).alias("files"))).alias("value"))
    return R.read_deposition_listing(t.spark, _named(t, docs.withColumn("name", F.concat(F.col("part").cast("string"), F.lit(".json")))))


SUFFIX_SQL = "CASE CAST(video_id AS BIGINT) % 5 WHEN 0 THEN 'mp4' WHEN 1 THEN 'TS' WHEN 2 THEN 'webm' WHEN 3 THEN 'Mov' ELSE 'txt' END"


@query(f"SELECT * FROM (SELECT video_id || '_a.' || {SUFFIX_SQL} AS file_name, lower({SUFFIX_SQL}) AS suffix, video_id AS id FROM videos) WHERE suffix IN ('mp4', 'ts', 'mov')", ("videos",))
def s8_list_files(t):
    n = F.col("video_id").cast("bigint") % 5
    suffix = F.when(n == 0, "mp4").when(n == 1, "TS").when(n == 2, "webm").when(n == 3, "Mov").otherwise("txt")
    folder = _named(t, t.videos.select(F.concat("video_id", F.lit("_a."), suffix).alias("name"), F.lit("x").alias("value")), folders=True)
    return R.list_files(t.spark, folder, R.VIDEO_EXTENSIONS, recursive=True).select("file_name", "suffix", "id")


@query("SELECT dem_id, row_i, col_i, x, y, elev FROM dem_cells", CELLS)
def s10_dem_cells(t):
    folder = _folder(t)
    t.dem_cells.write.parquet(folder)
    return R.read_dem_cells(t.spark, folder)


@query(NORMALS + " SELECT 'vertices' AS name, vertex AS id, [vx, round(vz::DOUBLE, 3)]::DOUBLE[] AS numbers FROM verts UNION ALL SELECT 'faces', face, [a, b, c] FROM faces UNION ALL SELECT 'normals', vertex, [round(nx, 3) + 0.0, round(ny, 3) + 0.0, round(nz, 3) + 0.0] FROM normals", CELLS)
def k5_mesh_tables(t):
    """All rows of the three tables, as they are read back."""
    folder = _folder(t)
    W.write_mesh_tables(*M.mesh_tables(M.valid_elevation(t.dem_cells), CELL_W, CELL_H, 2), folder)
    to = lambda c: F.round(F.col(c).cast("double"), 3) + F.lit(0.0)
    table = lambda name, id_, *numbers: t.spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("name"), F.col(id_).alias("id"), F.array(*numbers).alias("numbers"))
    double = lambda c: F.col(c).cast("double")
    return table("vertices", "vertex", double("vx"), to("vz")).unionByName(table("faces", "face", *map(double, "abc"))).unionByName(table("normals", "vertex", *map(to, ("nx", "ny", "nz"))))


@query("SELECT DISTINCT flight_id || '_matched_poses.json' AS file_name, flight_id AS stem, 'flights/' || flight_id || '/DEM/' AS output_dir FROM poses", ("poses",))
def t15_pose_names(t):
    name = F.concat("flight_id", F.lit("_matched_poses.json"))
    rows = t.poses.select("flight_id").distinct().select(name.alias("file_name"), F.regexp_replace(S.pose_stem(name), "_matched$", "").alias("stem"), S.output_dir(F.concat(F.lit("flights/"), "flight_id", F.lit("/poses/"), name)).alias("output_dir"))
    return rows
