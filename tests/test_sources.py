"""Dialects of the annotation format, documents, archives and the text sinks, on hand-made files."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from flocktab.sources import readers as R
from flocktab.sources.named_files import write_archives
from flocktab.sources import writers as W

FILES = {
    "1_gt.txt": '5,1,10,10,5,5,1,60,1,"A, B",0,0,0\n\n# comment\n6,1,10,10,5,5,1,60,0.5,C\n',
    "2_gt.txt": "5,1,1,1,2,2,0.125,1,1,X,0,0,0\r\n5,1,2,2,2,2,1,1,1,Y,0,0,0\r\n1,1,3,3,2,2,1,1,1,Z,0,0,0\r\n",
    "5_gt.txt": "",
}


@pytest.fixture()
def folder(tmp_path):
    for n, x in FILES.items():
        (tmp_path / n).write_text(x, newline="")
    return str(tmp_path)


def test_filter_dialect_fails_on_comment(spark, folder):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        R.read_mot(spark, folder).collect()


def test_null_on_error(spark, folder):
    rows = R.read_mot(spark, folder, on_error="null").where("file_name = '1_gt.txt'").orderBy("line_no").collect()
    assert [r["_corrupt"] for r in rows] == [False, True, False]
    assert rows[0]["species"] == "A, B" and rows[0]["gender"] == "0"
    assert rows[2]["species"] == "C" and rows[2]["gender"] == "" and rows[2]["visibility"] == 0.5


def test_yolo_and_track_dialects_skip_comments(spark, folder):
    for dialect in ("yolo", "track"):
        rows = R.read_mot(spark, folder, dialect).where("file_name = '1_gt.txt'").collect()
        assert len(rows) == 2


def test_point_dialect_drops_short_rows(spark, folder):
    rows = R.read_mot(spark, folder, "point").where("file_name = '1_gt.txt'").collect()
    assert [r["species"] for r in rows] == ["A, B"]


def test_frames_dialect_keeps_ten_fields(spark, tmp_path):
    (tmp_path / "3_gt.txt").write_text("1,2,3\n1,2,3,4,5,6\n1,2,3,4,5,6,,,,,,,\n")
    assert R.read_mot(spark, str(tmp_path), "frames").count() == 2


def test_interp_dialect_splits_in_quotes(spark, tmp_path):
    (tmp_path / "4_gt.txt").write_text('1,1,1,1,1,1,1,1,1,"A B",1,2,1\n')
    r = R.read_mot(spark, str(tmp_path), "interp").first()
    assert r["species"] == '"A B"' and (r["gender"], r["age"], r["is_propagated"]) == ("1", "2", "1")


def test_line_order_and_sequence(spark, folder):
    rows = R.read_mot(spark, folder).where("file_name = '2_gt.txt'").orderBy("line_no").collect()
    assert [r["species"] for r in rows] == ["X", "Y", "Z"] and {r["seq_id"] for r in rows} == {"2"}


def test_write_mot_round_trip(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    det = R.read_mot(spark, folder, glob="2_gt.txt")
    W.write_mot(det, out, "_f")
    lines = [r["value"] for r in spark.read.text(out + "/2_gt_f.txt").collect()]
    assert lines[0] == "5,1,1,1,2,2,0.12,1,1.00,X,0,0,0" and len(lines) == 3


def test_yolo_last_file_wins(spark):
    row = "1 long, 1 long"
    det = spark.createDataFrame([("9", "9_a.txt", 0, 1, 1, 0, 0, 4, 4, 0.5, "S", "0", "0", 7), ("9", "9_b.txt", 0, 1, 1, 2, 2, 4, 4, 1.0, "S", "0", "0", 8)],
                                "seq_id string, file_name string, line_no long, frame long, track_id long, bb_left int, bb_top int, bb_width int, bb_height int, visibility double, species string, gender string, age string, class_id int")
    got = W.yolo_files(det, 8, 8, ["class_id", "visibility"]).collect()
    assert [(r["label_file"], r["content"]) for r in got] == [("9_1.txt", "8-1.00 0.500000 0.500000 0.500000 0.500000\n")], row


def test_flight_metadata_skips_unreadable(spark, tmp_path):
    doc = {"flight_key": "1", "split": "train", "frame_count": 3, "flight_info": {"weather": 2, "drone_name": "Mavic"}, "species_present": {"Q1": {"species_name": "Roe", "contains_male": True}}}
    (tmp_path / "1_metadata.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "7_metadata.json").write_text(json.dumps(doc)[:40])
    (tmp_path / "other.json").write_text("{}")
    rows = R.read_flight_metadata(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["species_present"]["Q1"]["contains_male"] and rows[0]["species_present"]["Q1"]["num_labels"] is None


def test_manifest_empty_raises(spark, tmp_path):
    (tmp_path / "m.json").write_text("[]")
    with pytest.raises(ValueError):
        R.read_manifest(spark, str(tmp_path / "m.json"))


def test_listing(spark, tmp_path):
    files = [{"filename": "a.zip", "links": {"download": "u1", "self": "u2"}}, {"key": "b.zip", "links": {"self": "u3"}}, {"filename": "", "key": "", "links": {"self": "u4"}}, {"key": "c"}]
    (tmp_path / "l.json").write_text(json.dumps({"files": files}))
    assert sorted(map(tuple, R.read_deposition_listing(spark, str(tmp_path / "l.json")).collect())) == [("a.zip", "u1"), ("b.zip", "u3")]


def test_poses_keep_unknown_keys(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    images = [{"lat": 1.0, "lng": 0.0, "lon": 2.5, "alt": 3.0, "odd": "x"}, {"lat": 2.0, "lng": 3.0, "alt": 3.0, "odd": "y"}]
    (tmp_path / "sub/0_matched_poses.json").write_text(json.dumps({"images": images}))
    poses = R.read_poses(spark, str(tmp_path))
    assert [r["odd"] for r in poses.orderBy("pos").collect()] == ["x", "y"]
    doc = json.loads(W.pose_documents(poses).first()["value"])
    assert [i["odd"] for i in doc["images"]] == ["x", "y"]


def test_corrections_default_to_zero(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"translation": {"x": 1.5}}))
    r = R.read_corrections(spark, str(tmp_path / "c.json")).first()
    assert tuple(r["translation"]) == (1.5, 0.0, 0.0) and tuple(r["rotation"]) == (0.0, 0.0, 0.0)


def test_dem_metadata(spark, tmp_path):
    (tmp_path / "0_matched_dem.json").write_text(json.dumps({"width": 2, "height": 3, "crs": "EPSG:32633", "origin": [1.0, 2.0, 3.0]}))
    r = R.read_dem_metadata(spark, str(tmp_path)).first()
    assert (r["flight_id"], r["origin_x"], r["origin_z"]) == ("0", 1.0, 3.0)


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "flight_2.zip", "w") as z:
        z.writestr("2_gt.txt", FILES["2_gt.txt"])
        z.writestr("2.mp4", b"..")
    rows = R.read_mot_archives(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and {(r["archive"], r["members"], r["seq_id"]) for r in rows} == {("flight_2.zip", 2, "2")}


def test_list_files(spark, tmp_path):
    for n in ("1_a.MP4", "2_gt.txt", "x.mp4", "3.json", "4.ts", "5.webm"):
        (tmp_path / n).write_text("x")
    got = {r["file_name"]: r["id"] for r in R.list_files(spark, str(tmp_path), R.VIDEO_EXTENSIONS).collect()}
    assert got == {"1_a.MP4": "1", "x.mp4": None, "4.ts": None}


def test_classes(spark):
    c = R.class_dictionary(spark)
    assert c.count() == 75 and c.where("class_key = 'Q58697-2-2-1'").first()["class_id"] == 69


def test_dem_cells(spark, tmp_path):
    spark.range(3).select(F.lit("d").alias("dem_id"), F.col("id").cast("int").alias("row_i"), F.lit(0).alias("col_i"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("elev")).write.parquet(str(tmp_path / "c"))
    assert R.read_dem_cells(spark, str(tmp_path / "c")).count() == 3


def test_white_space_of_all_kinds(spark, tmp_path):
    """Lines of white space are no rows where lines are stripped, rows of blanks where they are not; fields are stripped of tabs too."""
    (tmp_path / "6_gt.txt").write_text("\t\n5,\t1 ,10,10,5,5,1,60,1,\xa0A B\t,0,0,0\t\r6,1,1,1,1,1,1,1,1,C,0,0,0\n \n", encoding="utf-8", newline="")
    for dialect, n in (("filter", 2), ("frames", 2), ("interp", 2), ("point", 2), ("track", 4), ("yolo", 4)):
        rows = R.read_mot(spark, str(tmp_path), dialect).orderBy("line_no").collect()
        assert len(rows) == n, dialect
        first = next(r for r in rows if r["frame"] == 5)
        assert (first["track_id"], first["species"], first["is_propagated"]) == (1, "A B", "0")
    blank = R.read_mot(spark, str(tmp_path), "track").where("frame = 0").first()
    assert blank["bb_left"] == 0 and blank["conf"] == 0.0 and R.read_mot(spark, str(tmp_path), "yolo").where("frame is null").count() == 2


def test_comments_by_dialect(spark, tmp_path):
    (tmp_path / "7_gt.txt").write_text("#x\n #5,1,1,1,1,1,1,1,1,C,0,0,0\n5,1,1,1,1,1,1,1,1,C,0,0,0\n")
    assert R.read_mot(spark, str(tmp_path), "yolo").count() == 1 and R.read_mot(spark, str(tmp_path), "point").count() == 1
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):  # only a # in the first place is a comment there
        R.read_mot(spark, str(tmp_path), "track").collect()


def test_null_fields_keep_their_place(spark, tmp_path):
    (tmp_path / "8_gt.txt").write_text("5,1,1,1,2,2,x,3,,S,1,2,0\n,,4,,,,,,,,,,\n")
    det = R.read_mot(spark, str(tmp_path), "yolo")
    lines = [r["line"] for r in W.format_mot(det).orderBy("line_no").collect()]
    assert lines == ["5,1,1,1,2,2,,3,,S,1,2,0", ",,4,,,,,,,,,,"]
    labels = {r["label_file"]: r["content"] for r in W.yolo_files(det, 8, 8, ["class_id", "visibility"]).collect()}
    assert labels["8_5.txt"] == "3- 0.250000 0.250000 0.250000 0.250000\n" and all(len(x.split(" ")) == 5 for x in labels.values())


def test_pose_documents_keep_all_keys(spark, tmp_path):
    images = [{"lat": 1.0, "lng": 2.0, "note": None}, {"lat": 3.0, "lng": 4.0, "note": "x"}]
    (tmp_path / "0_matched_poses.json").write_text(json.dumps({"images": images, "version": 3, "camera": {"model": "T", "serial": None}}))
    doc = json.loads(W.pose_documents(R.read_poses(spark, str(tmp_path))).first()["value"])
    assert doc["images"] == images and doc["version"] == 3 and doc["camera"]["model"] == "T"


def test_jobs_write_files(spark, folder, tmp_path):
    """Files in, files out, an empty one too."""
    from flocktab.plans import jobs

    out = tmp_path / "jobs"
    stats = jobs.interpolate_files(spark, folder, str(out / "full"), 1, "_full", glob="[25]_gt.txt").collect()
    assert (out / "full/2_gt_full.txt").read_text().splitlines() == ["1,1,3,3,2,2,1.00,1,1.00,Z,0,0,0"] + [f"{f},1,{x},{x},2,2,{c},1,1.00,Z,0,0,1" for f, x, c in ((2, 2, "0.78"), (3, 2, "0.56"), (4, 2, "0.34"))] + ["5,1,1,1,2,2,0.12,1,1.00,X,0,0,0", "5,1,2,2,2,2,1.00,1,1.00,Y,0,0,0"]
    assert (out / "full/5_gt_full.txt").read_text().strip() == "" and [(r["original"], r["interpolated"], r["total"]) for r in stats] == [(3, 3, 6)]
    kept = jobs.filter_files(spark, folder, str(out / "kept"), "_k", glob="[25]_gt.txt", species=["X", "Z"]).where("seq_id is null").first()
    assert (out / "kept/2_gt_k.txt").read_text().splitlines() == ["5,1,1,1,2,2,0.12,1,1.00,X,0,0,0", "1,1,3,3,2,2,1.00,1,1.00,Z,0,0,0"] and (kept["total"], kept["kept"]) == (3, 2)
    found = jobs.label_files(spark, folder, str(out / "labels"), 10, 10, ["class_id"], glob="[25]_gt.txt").first()
    assert sorted(x.name for x in (out / "labels").iterdir() if not x.name.startswith((".", "_"))) == ["2_1.txt", "2_5.txt"] and (found["frames"], found["labels"]) == (2, 3)
    assert (out / "labels/2_5.txt").read_text() == "1 0.200000 0.200000 0.200000 0.200000\n1 0.300000 0.300000 0.200000 0.200000\n"


def test_members_are_read_from_their_places(spark, tmp_path):
    """Archives with stored and packed members, in folders, of other kinds, empty; a damaged member and an unknown method are errors."""
    import zipfile

    line = "{},1,10,20,30,40,0.5,3,1.00,deer,1,2,0\n"
    for n in (1, 2):
        with zipfile.ZipFile(tmp_path / f"flight_{n}.zip", "w") as z:
            z.writestr(f"a/{n}_gt.txt", "".join(line.format(k) for k in range(50 * n)), zipfile.ZIP_DEFLATED)
            z.writestr("video.mp4", b"x" * 100_000)
            z.writestr(f"{n}_more.TXT", line.format(7), zipfile.ZIP_STORED)
            z.writestr("none.txt", "")
    got = R.read_mot_archives(spark, str(tmp_path))
    assert {(r["archive"], r["members"], r["file_name"]): r["count"] for r in got.groupBy("archive", "members", "file_name").count().collect()} == {
        ("flight_1.zip", 4, "1_gt.txt"): 50, ("flight_1.zip", 4, "1_more.TXT"): 1, ("flight_2.zip", 4, "2_gt.txt"): 100, ("flight_2.zip", 4, "2_more.TXT"): 1}
    whole = R.parse_archives(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content"))
    assert got.exceptAll(whole.select(*got.columns)).isEmpty() and whole.count() == got.count()
    members = R.archive_members(spark.createDataFrame([(f"file:{tmp_path}/flight_2.zip",)], "path string"))
    assert members.count() == 3
    for change in ("crc + 1 AS crc", "99 AS method"):
        name = change.split()[-1]
        with pytest.raises(Exception, match="is damaged|by method 99"):
            R.read_members(members.selectExpr(*[change if c == name else c for c in members.columns])).collect()


def test_lines_of_split_files(spark, tmp_path):
    """A file that is cut into many splits has the lines and places that it has as a whole, with all three line ends and empty lines."""
    lines = [f"{k},{k % 7},1,2,3,4,0.5,1,1.0,x{'y' * (k % 90)},0,0,0" for k in range(900)]
    (tmp_path / "1_gt.txt").write_bytes("".join(x + ["\n", "\r\n", "\r", "\n\n"][k % 4] for k, x in enumerate(lines)).encode())
    (tmp_path / "2_gt.txt").write_text("\n".join(lines[:3]))
    want = R.parse_mot(R.mot_lines(spark.read.text(str(tmp_path), wholetext=True).selectExpr("_metadata.file_name", "value"))).collect()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
        got = R.read_mot(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 1 and sorted(got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_many_small_files_are_dealt_and_listed_by_tasks(spark, tmp_path):
    from flocktab.sources.named_files import tasks, write_named

    names = spark.range(400).selectExpr("concat(id, '_a.', if(id % 2 = 0, 'mp4', 'txt')) AS name", "'x' AS value")
    write_named(names, f"{tmp_path}/out", "name", "value", folders=True)
    assert len(os.listdir(tmp_path / "out")) == tasks(spark)
    (tmp_path / "out" / "_hidden.mp4").write_text("x")
    (tmp_path / "out" / "empty.mp4").write_text("")
    got = R.list_files(spark, f"file:{tmp_path}/out", R.VIDEO_EXTENSIONS, recursive=True).collect()
    assert sorted(int(r["id"]) for r in got) == list(range(0, 400, 2)) and all(r["path"].startswith("file:/") and r["length"] == 2 for r in got)
    assert R.list_files(spark, f"{tmp_path}/out", R.VIDEO_EXTENSIONS).count() == 0


def test_metadata_files_grow_in_number(spark, tmp_path, monkeypatch):
    """s2_flight_metadata writes files of some hundreds of documents, however many flights there are."""
    from flocktab.plans import registry

    file_queries = registry.file_queries

    spark.range(20_000).selectExpr("id AS o_orderkey", "id AS o_custkey", "timestamp'2024-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(10).selectExpr("id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "1.0D AS l_quantity", "'R' AS l_returnflag", "'O' AS l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, plain = [], file_queries._named
    monkeypatch.setattr(file_queries, "_named", lambda t, rows: seen.append(plain(t, rows)) or seen[-1])
    assert registry.QUERIES["s2_flight_metadata"](spark, str(tmp_path)).count() == 20_000
    sizes = [len(json.loads((tmp_path / seen[0] / x).read_text())) for x in os.listdir(seen[0]) if x[0] != "b"]
    assert sum(sizes) == 20_000 and max(sizes) < 600


def test_members_are_read_by_lines(spark, tmp_path):
    """A member's lines come some at a time, wherever it is cut, and are dealt over many tasks."""
    import re

    text = "a,é\r\n\r\nb\rc\n\n\rd,ü\r\n" + "e" * 9
    want = [(k, x) for k, x in enumerate(re.split("\r\n|\r|\n", text)) if x]
    for size in range(1, 12):
        raw = text.encode()
        got = R._numbered(raw[k : k + size] for k in range(0, len(raw), size))
        assert [(first + k, x) for first, lines in got for k, x in enumerate(lines) if x] == want
    made = spark.range(3000).selectExpr("concat('flight_', id % 2, '.zip') AS archive", "concat(id % 2, '/', id % 4, '_gt.txt') AS member", "id AS line_no", "concat(id, ',1,2,3,4,5,0.50,7,1.00,deer') AS line")
    write_archives(made, f"{tmp_path}/zips", "archive", "member", "line", ("line_no",))
    read = R.read_mot_archives(spark, f"{tmp_path}/zips")
    rows = read.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["archive"], r["members"], r["seq_id"], r["line_no"], r["frame"]) for r in rows) == sorted((f"flight_{k % 2}.zip", 2, str(k % 4), k // 4, k) for k in range(3000))
    assert len({r["task"] for r in rows if r["seq_id"] == "3"}) > 1
