"""Properties of the operators, goldens on the shipped metadata, plans, and streams against their batch twins."""

import math

import pytest
from pyspark.sql import functions as F

from flocktab.functions import projection as P
from flocktab.functions import scalar as S
from flocktab.operators import detections as D
from flocktab.operators import flights as L
from flocktab.operators import geo as G
from flocktab.operators import manifest as M
from flocktab.operators import tracks as T
from flocktab.plans import adapters
from flocktab.sources import readers as R


@pytest.fixture(scope="module")
def det(spark, sf_dir):
    return adapters.load(spark, sf_dir, "detections").cache()


def test_fill_keeps_all_rows_and_leaves_no_gap(det):
    filled = T.interpolate_tracks(det, 1)
    assert det.exceptAll(filled.select(det.columns)).isEmpty()
    gaps = T.key_segments(filled).where(F.col("nxt.frame") - F.col("frame") > 1)
    assert gaps.isEmpty()


@pytest.mark.parametrize("step", [2, 3, 7])
def test_fill_counts(det, step):
    seg = T.key_segments(det).withColumn("gap", F.col("nxt.frame") - F.col("frame"))
    want = seg.agg(F.sum(F.when(F.col("gap") > step, F.floor((F.col("gap") - 1) / step)).otherwise(0)).alias("n")).first()["n"]
    assert T.interpolate_tracks(det, step).count() - det.count() == want


def test_half_even_boxes(spark):
    rows = [("s", 0, 0, 1, 0, 0, 1, 1, 1.0, 1, 1.0, "x", "0", "0", "0"), ("s", 1, 2, 1, 1, 3, 4, 6, 1.0, 1, 1.0, "x", "0", "0", "0")]
    d = spark.createDataFrame(rows, "seq_id string, line_no long, frame long, track_id long, bb_left int, bb_top int, bb_width int, bb_height int, conf double, class_id int, visibility double, species string, gender string, age string, is_propagated string")
    r = T.interpolate_tracks(d).where("frame = 1").first()
    assert (r["bb_left"], r["bb_top"], r["bb_width"], r["bb_height"]) == (0, 2, 2, 4)  # of .5, 1.5, 2.5, 3.5


def test_boxes_at_equal_fill(det):
    targets = det.where("frame % 11 = 3").select("seq_id", "frame").distinct()
    at = T.boxes_at(det, targets).select("seq_id", "frame", "track_id", *T.BOX)
    want = T.interpolate_tracks(det, 1).join(targets, ["seq_id", "frame"], "left_semi").select("seq_id", "frame", "track_id", *T.BOX)
    assert at.exceptAll(want).isEmpty() and want.exceptAll(at).isEmpty()


def test_yolo_inverse(spark):
    d = spark.createDataFrame([(10, 20, 30, 40)], "l int, t int, w int, h int")
    box = S.yolo_box(*[F.col(c) for c in "ltwh"], 640.0, 512.0)
    x1, y1, x2, y2 = d.select(*S.yolo_to_pixels(*box, 640.0, 512.0)).first()
    assert [round(v, 9) for v in (x1, y1, x2, y2)] == [10, 20, 40, 60]


def test_strict_filter_is_subset(det):
    args = dict(species=["deer"], gender=["1"], min_width=20)
    strict, coded = D.filter_detections(det, strict=True, **args), D.filter_detections(det, **args)
    assert strict.exceptAll(coded).isEmpty() and strict.count() < coded.count()
    assert D.filter_detections(det).count() == det.count()


def test_aliases():
    assert D.expand_aliases(["Male", "Female"], D.GENDERS) == ["Male", "Female", "1"]
    assert D.expand_aliases(["Male", "Female"], D.GENDERS, strict=True) == ["Male", "Female", "1", "2"]


def test_projection_points(spark):
    x, y = spark.range(1).select(*P.forward(F.lit(5.0), F.lit(50.0), "EPSG:3035")).first()
    assert abs(x - 3962799.45) < 0.01 and abs(y - 2999718.85) < 0.01
    with pytest.raises(ValueError):
        P.forward(F.lit(1.0), F.lit(1.0), "EPSG:4326")


def utm_plain(lon, lat, lon0):
    """UTM by the older series in powers of longitude (Snyder, PP 1395, 8-9 to 8-15), the meridian arc by adding up small steps."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    phi, steps = math.radians(lat), 20_000
    arc = lambda t: a * (1 - e2) / (1 - e2 * math.sin(t) ** 2) ** 1.5
    m = sum(arc((k + 0.5) * phi / steps) for k in range(steps)) * phi / steps
    n, t, c = a / math.sqrt(1 - e2 * math.sin(phi) ** 2), math.tan(phi) ** 2, e2 / (1 - e2) * math.cos(phi) ** 2
    b, ep = math.radians(lon - lon0) * math.cos(phi), e2 / (1 - e2)
    x = k0 * n * (b + (1 - t + c) * b**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * b**5 / 120)
    y = k0 * (m + n * math.tan(phi) * (b * b / 2 + (5 - t + 9 * c + 4 * c * c) * b**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * b**6 / 720))
    return 500000 + x, y


def test_utm_to_a_centimetre(spark):
    points = [(15.0, 48.0), (13.25, 47.8), (12.1, 46.6), (17.9, 49.1), (14.0, 30.0), (16.5, 70.0)]
    x, y = P.forward(F.col("lon"), F.col("lat"), "EPSG:32633")
    rows = spark.createDataFrame(points, "lon double, lat double").select("lon", "lat", x.alias("x"), y.alias("y")).collect()
    for r in rows:
        e, n = utm_plain(r["lon"], r["lat"], 15.0)
        assert abs(r["x"] - e) < 0.01 and abs(r["y"] - n) < 0.01, r
    lon, lat = P.inverse(F.col("x"), F.col("y"), "EPSG:32633")
    back = spark.createDataFrame([utm_plain(*p, 15.0) for p in points], "x double, y double").select(lon.alias("lon"), lat.alias("lat")).collect()
    assert all(abs(r["lon"] - p[0]) < 2e-7 and abs(r["lat"] - p[1]) < 2e-7 for r, p in zip(back, points, strict=True))


def test_projection_round_trip(spark):
    pts = spark.createDataFrame([(9.5 + k / 3, 46 + k / 5) for k in range(20)], "lon double, lat double")
    x, y = P.forward(F.col("lon"), F.col("lat"), "EPSG:32633")
    lon, lat = P.inverse(F.col("x"), F.col("y"), "EPSG:32633")
    for r in pts.withColumns({"x": x, "y": y}).select("lon", "lat", lon.alias("lo"), lat.alias("la")).collect():
        assert math.isclose(r["lon"], r["lo"], abs_tol=1e-9) and math.isclose(r["lat"], r["la"], abs_tol=1e-9)


def test_unknown_crs_raises(spark):
    poses = spark.createDataFrame([("1", 0, 47.0, 15.0, 1.0, 0.0, 0.0, 0.0)], "flight_id string, pos long, lat double, lng double, alt double, pitch double, roll double, yaw double")
    dem = spark.createDataFrame([("1", "EPSG:9999", 0.0, 0.0, 0.0)], "flight_id string, crs string, origin_x double, origin_y double, origin_z double")
    with pytest.raises(Exception, match="no projection"):
        G.relative_poses(poses, dem, ["EPSG:32633"]).collect()


def test_file_names(spark):
    df = spark.createDataFrame([("12_gt.a.txt",), ("plain.txt",)], "n string")
    rows = df.select(S.file_id(F.col("n")), S.seq_id(F.col("n")), S.stem(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("12", "12", "12_gt.a"), (None, "plain", "plain")]
    assert spark.range(1).select(S.output_dir(F.lit("/a/b/c.json")), S.pose_stem(F.lit("3_poses.json")), S.file_pattern(F.lit("3"), F.lit("3_3.txt"))).first() == ("/a/DEM/", "3", "<id>_3.txt")


def test_exact_text(spark):
    assert [r[0] for r in spark.createDataFrame([(0.125,), (0.375,), (None,)], "x double").select(S.fmt_fixed(F.col("x"), 2)).collect()] == ["0.12", "0.38", None]


def test_present_flights(spark):
    files = spark.createDataFrame([("flight_3.zip",), ("5_gt.txt",), ("6.mp4",), ("a_b_c.txt",)], "name string")
    assert {r[0] for r in M.present_flights(files).collect()} == {"3"}
    assert {"3", "5", "6", "a", "a_b"} <= {r[0] for r in M.present_flights(files, unzip=True).collect()}


def test_last_part_wins(spark):
    parts = spark.createDataFrame([(1, 10, ["7", "8"], None), (2, 20, ["8"], {"8": ["8_a.txt"]})], "part int, deposition_id long, flights array<string>, flight_details map<string, array<string>>")
    got = {r["flight_id"]: (r["deposition_id"], r["files"]) for r in M.flight_index(parts).collect()}
    assert got == {"7": (10, []), "8": (20, ["8_a.txt"])}


def test_plans_have_no_nested_loop(spark, sf_dir, capsys):
    from flocktab.plans import registry

    for name in ("j7_boxes_at", "j13_clip_cells", "j16_neighbour_labels", "j8_tile_urls"):
        registry.QUERIES[name](spark, sf_dir).explain()
        plan = capsys.readouterr().out
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
    for name in ("f12_filter_coded", "f6_p1_filter_flights", "w2_interpolate_tracks"):
        registry.QUERIES[name](spark, sf_dir).explain()
        assert "Python" not in capsys.readouterr().out, name


FLIGHTS = [
    ("10", "train", 100, 2, "2023-01-31T10:00:00", "2023-01-31T10:30:00", "Matrice 30T", {"Q1": ("Sus scrofa (Wild boar)", "mo"), "Q2": ("Capreolus capreolus (Roe deer)", "fa")}),
    ("100", "train", 50, 16, "2024-10-05T08:00:00", "2024-10-05T08:45:00", "DJI Mavic 3T", {"Q2": ("Capreolus capreolus (Roe deer)", "mju")}),
    ("11", "val", 20, 0, "not a date", None, "DJI Mavic 3T", {"Q3": ("Cervus elaphus (Red deer)", "xo")}),
    ("2", "test", 30, 18, "2024-11-30T23:59:00", "2024-12-01T00:29:00", None, {}),
    ("9", "test", 0, 1, None, None, "mini", None),
]
LETTERS = {"o": "contains_occluded_frames", "u": "contains_unoccluded_frames", "m": "contains_male", "f": "contains_female", "x": "contains_unknown_sex", "a": "contains_adult", "j": "contains_juvenile"}


@pytest.fixture()
def metadata(spark, tmp_path):
    import json

    for key, split, n, weather, start, end, drone, species in FLIGHTS:
        present = species and {q: {"species_name": name, "wikidata_id": q, "num_labels": 2, "num_label_states": 5} | {LETTERS[x]: True for x in flags} for q, (name, flags) in species.items()}
        doc = {"flight_key": key, "split": split, "frame_count": n, "flight_info": {"weather": weather, "start_time": start, "end_time": end, "drone_name": drone}, "species_present": present}
        (tmp_path / f"{key}_metadata.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "3_metadata.json").write_text("{")
    return R.read_flight_metadata(spark, str(tmp_path))


def test_metadata_filters(metadata):
    """Each filter, alone and together, by reading the documents above."""
    n = lambda **k: sorted(int(r["flight_key"]) for r in L.filter_flights(metadata, **k).collect())
    assert n() == [2, 9, 10, 11, 100]
    assert n(species=["roe deer"]) == [10, 100] and n(species=["Q3", "boar"]) == [10, 11]
    assert n(occlusion=True) == [10, 11] and n(occlusion=False) == [100]
    assert n(sex=["female"]) == [10] and n(sex=["unknown", "male"]) == [10, 11, 100] and n(age=["juvenile", "adult"]) == [10, 100]
    assert n(species=["boar"], sex=["female"]) == []  # one and the same entry passes
    assert n(drone=["MAVIC"]) == [11, 100] and n(min_date="2024-10-01", max_date="2024-11-30") == [100]
    assert n(weather=["cloudy", "windy"]) == [10, 100] and n(weather=["cloudy", "windy"], strict=True) == []  # flight 2 has no species
    assert n(weather=["night"]) == [] and n(weather=["night"], strict=True) == [11]
    assert [r["flight_key"] for r in L.in_file_order(metadata).collect()] == ["100", "10", "11", "2", "9"]  # as text, 100_ stands before 10_
    assert tuple(L.match_count(metadata, species=["deer"]).first()) == (3, 5)
    r = L.match_details(L.filter_flights(metadata, species=["boar"])).first()
    assert (r["flight_key"], r["species"], r["weather"]) == ("10", "Sus scrofa (Wild boar), Capreolus capreolus (Roe deer)", ["cloudy"])
    o = L.flight_overview(metadata).first()
    assert o["flight_hours"] == 1.75 and str(o["period_start"]) == "2023-01-31 10:00:00" and str(o["period_end"]) == "2024-12-01 00:29:00"


def test_manifest_order(spark, tmp_path):
    """Of a flight in two parts the part that stands later in the list counts, though its number is lower."""
    import json

    parts = [{"part": 2, "deposition_id": 20, "flights": ["7", "8"], "flight_details": {"7": ["7_a.txt"]}}, {"part": 1, "deposition_id": 10, "flights": ["8", "9"]}]
    (tmp_path / "m.json").write_text(json.dumps(parts))
    index = M.flight_index(R.read_manifest(spark, str(tmp_path / "m.json")))
    assert {r["flight_id"]: (r["part"], r["files"]) for r in index.collect()} == {"7": (2, ["7_a.txt"]), "8": (1, []), "9": (1, [])}
    other = spark.createDataFrame([("7",), ("7",)], "flight_id string")
    assert sorted(r[0] for r in M.coverage_diff(index, other).collect()) == ["8", "9"]
    assert [r[0] for r in M.unknown(index, ["7", "x", "x"]).collect()] == ["x"]
    assert sorted(r[0] for r in M.requested(index, ["x"]).collect()) == ["x"] and M.requested(index).count() == 3
    assert sorted(r[0] for r in M.requested(index, ["x"], parts=[2]).collect()) == ["7", "x"]


def test_valid_poses(spark):
    rows = [("a", 0.0, 47.0, 5.0, None), ("b", None, 47.0, 5.0, None), ("c", 1.0, 47.0, 0.0, 0.0), ("d", 1.0, None, 0.0, None), ("e", 1.0, None, None, 7.0)]
    got = G.valid_poses(spark.createDataFrame(rows, "flight_id string, lat double, latitude double, lng double, longitude double")).collect()
    assert {r["flight_id"]: r["lon"] for r in got} == {"a": 5.0, "c": 0.0, "e": 7.0}


def test_species_text_as_coded(spark):
    df = spark.createDataFrame([("Sus (Wild boar)",), ("Sus ( Boar",), ("a) b (c)",), ("Unknown",), ("",), (None,), ("Plain",)], "s string")
    assert [r[0] for r in df.select(S.species_short(F.col("s"))).collect()] == ["Wild boar", "Boa", "", "Unknown", "Unknown", "Unknown", "Plain"]


def test_camera_angles_and_corrections(spark):
    det = spark.createDataFrame([("1", 0), ("1", 1), ("2", 0)], "seq_id string, frame long")
    poses = spark.createDataFrame([("1", 0, 44.0), ("1", 1, None), ("2", 0, 60.0)], "flight_id string, pos long, fovy double")
    fixed = spark.createDataFrame([((1.0, 2.0, 3.0), (0.0, 0.0, 0.5))], "translation struct<x: double, y: double, z: double>, rotation struct<x: double, y: double, z: double>")
    rows = G.frame_pose(det, poses, fixed).orderBy("flight_id", "frame").collect()
    assert [r["fovy"] for r in rows] == [44.0, 50.0, 60.0] and all(r["translation"]["z"] == 3.0 and r["rotation"]["z"] == 0.5 for r in rows)
    by_flight = fixed.withColumn("flight_id", F.lit("2"))
    assert [r["translation"]["x"] for r in G.frame_pose(det, poses, by_flight).orderBy("flight_id", "frame").collect()] == [0.0, 0.0, 1.0]
    assert [r["fovy"] for r in G.frame_pose(det, poses.drop("fovy")).collect()] == [50.0] * 3


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_pass_plans(spark, sf_dir):
    """Joins and scans are as few as the work needs."""
    from flocktab.plans import registry

    joins = {"t28_p10_relative_poses": 1, "j12_match_details": 1, "a13_match_count": 1, "j4_resolve_flights": 0, "u1_requested": 0, "p6_download_plan": 2, "j13_clip_cells": 1}
    for name, n in joins.items():
        plan = plan_of(registry.QUERIES[name](spark, sf_dir))
        assert plan.count("Join ") == n, name


def test_clip_bins_are_small(spark):
    """A cell meets few boxes that it does not touch: bins follow the boxes' size."""
    cells = spark.range(10_000).select(F.lit("d").alias("dem_id"), (F.col("id") / 100).cast("int").alias("row_i"), (F.col("id") % 100).cast("int").alias("col_i")).selectExpr("*", "col_i * 10.0D AS x", "row_i * 10.0D AS y", "1.0D AS elev")
    boxes = spark.createDataFrame([(str(k), 35.0 * k, 35.0 * k, 35.0 * k + 20, 35.0 * k + 20) for k in range(20)], "flight_id string, min_x double, min_y double, max_x double, max_y double")
    from flocktab.operators import dem

    got = dem.clip_cells(cells, boxes, 10.0, 10.0)
    want = {(str(k), r, c) for k in range(20) for r in range(100) for c in range(100) if c * 10 <= 35 * k + 20 and c * 10 + 10 >= 35 * k and r * 10 <= 35 * k + 20 and r * 10 + 10 >= 35 * k}
    assert {(r["flight_id"], r["row_i"], r["col_i"]) for r in got.collect()} == want and got.count() == len(want)


def test_flight_index_of_large_parts(spark):
    """A part's details travel once, by flight, and are those of the part that counts."""
    kind = "line_no int, part int, deposition_id long, flights array<string>, flight_details map<string, array<string>>"
    parts = spark.createDataFrame([(0, 1, 10, ["7", "8", "7"], {"8": ["old.txt"], "none": ["x"]}), (1, 2, 20, ["8"], {"7": ["other.txt"]}), (2, 3, 30, ["9"], None)], kind)
    index = M.flight_index(parts)
    assert sorted(tuple(r) for r in index.select("flight_id", "part", "files", "pos").collect()) == [("7", 1, [], 2), ("8", 2, [], 0), ("9", 3, [], 0)]
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at(flight_details" not in plan and "Join" not in plan


def test_exact_text_near_ties(spark):
    """As printf has it, on both sides of a tie, on ties, and with either zero."""
    import math

    base = [k / 200 for k in range(400)] + [k / 8 for k in range(80)] + [1e7 + 0.005, 123456.785, 0.994999, 9.995, 99.995, 0.0, -0.0, -0.001, -1.005, 1e15 + 0.5]
    values = [x for b in base for x in (b, math.nextafter(b, math.inf), math.nextafter(b, -math.inf), -b, b + 1e-7)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", S.fmt_fixed(F.col("x"), 2).alias("two"), S.fmt_fixed(F.col("x"), 6).alias("six")).collect()
    assert [(r["x"], r["two"]) for r in rows if r["two"] != f"{r['x']:.2f}"] == []
    assert [(r["x"], r["six"]) for r in rows if r["six"] != f"{r['x']:.6f}"] == []


def test_no_degrees_off_the_globe(spark):
    """A northing that goes around the globe has no degrees, where it had those of another place; one beyond the pole comes back."""
    from flocktab.functions import projection as P

    rows = spark.createDataFrame([(80000.0, 5.4e6), (80000.0, -12.5e6), (80000.0, -174564000.0)], "x double, y double")
    lon, lat = P.inverse(F.col("x"), F.col("y"), "EPSG:32633")
    at = rows.select("x", "y", lon.alias("lon"), lat.alias("lat"))
    bx, by = P.forward(F.col("lon"), F.col("lat"), "EPSG:32633")
    got = [(r["x"], r["y"], r["bx"], r["by"]) for r in at.select("*", bx.alias("bx"), by.alias("by")).collect()]
    assert all(abs(x - a) < 0.01 and abs(y - b) < 0.01 for x, y, a, b in got[:2]) and got[2][2:] == (None, None)
