"""Range joins by levels, sliding extremes, models on their own grids, exact rounding: against plain Python, and their row counts."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flocktab.functions import scalar as S
from flocktab.operators import dem as M
from flocktab.operators import tracks as T
from flocktab.operators.levels import keyed_points, keyed_ranges

CELL = "dem_id string, row_i int, col_i int, x double, y double, elev double"


def grid(spark, dem_id, x0, top, w, h, nx, ny, elev):
    """A model of nx by ny cells whose first has its lower left corner at (x0, top); elev(cx, cy) of the centres."""
    return spark.createDataFrame([(dem_id, r, c, x0 + c * w, top - r * h, elev(x0 + (c + 0.5) * w, top - (r - 0.5) * h)) for r in range(ny) for c in range(nx)], CELL)


def test_a_plane_is_resampled_exactly_on_two_models_of_unaligned_grids(spark):
    plane = lambda cx, cy: float(2 * cx - 3 * cy + 7)
    cells = grid(spark, "a", 3.0, 1007.0, 10.0, 10.0, 40, 35, plane).unionByName(grid(spark, "b", 51.5, 983.25, 7.5, 4.25, 33, 50, lambda cx, cy: plane(cx, cy) + 100))
    rng = random.Random(1)
    points = [(str(k), rng.uniform(60, 290), rng.uniform(790, 980)) for k in range(300)] + [("far", -5000.0, 3.0), ("edge", 4.0, 1000.0)]
    frame = spark.createDataFrame(points, "point_id string, px double, py double")
    got = {(r["point_id"], r["dem_id"]): r["elev"] for r in M.resample_bilinear(cells, frame).collect()}
    for name, px, py in points[:-2]:
        assert got[name, "a"] == pytest.approx(plane(px, py)) and got[name, "b"] == pytest.approx(plane(px, py) + 100)
    assert not [k for k in got if k[0] == "far"] and got["edge", "a"] is None  # half a cell at the rim has no four centres
    one = M.resample_bilinear(cells, frame.withColumn("dem_id", F.when(F.col("point_id") == "3", "none").otherwise("b"))).collect()
    assert len(one) == len(points) and {r["dem_id"]: r["elev"] for r in one if r["point_id"] == "3"} == {"none": None}


def test_resampling_at_centres_at_holes_and_from_metadata(spark):
    cells = grid(spark, "a", 80.0, 500.0, 20.0, 10.0, 18, 18, lambda cx, cy: cx + cy).withColumn("elev", F.when((F.col("row_i") == 4) & (F.col("col_i") == 4), None).otherwise(F.col("elev")))
    points = spark.createDataFrame([("centre", 80 + 3.5 * 20, 500 - 3 * 10 + 5.0), ("beside the hole", 80 + 4.2 * 20, 500 - 3 * 10 + 4.0), ("seam", 80 + 16.0 * 20, 500 - 15 * 10.0)], "point_id string, px double, py double")
    want = {"centre": 80 + 3.5 * 20 + 500 - 30 + 5, "beside the hole": None, "seam": 80 + 320 + 350.0}
    assert {r["point_id"]: r["elev"] for r in M.resample_bilinear(cells, points).collect()} == want
    meta = spark.createDataFrame([("a", [20.0, 0.0, 80.0, 0.0, -10.0, 510.0, 0.0, 0.0, 1.0], 18, 18)], "flight_id string, transform array<double>, width int, height int")
    assert {r["point_id"]: r["elev"] for r in M.resample_bilinear(cells, points, M.metadata_grids(meta)).collect()} == want
    assert M.metadata_grids(meta).first().asDict() == M.model_grids(cells).first().asDict()
    assert M.resample_bilinear(cells.limit(0), points).isEmpty() and M.resample_bilinear(cells, points.limit(0)).isEmpty()


def test_merged_models_are_one_grid(spark):
    west = grid(spark, "w", 0.0, 90.0, 10.0, 10.0, 5, 10, lambda cx, cy: cx)
    east = grid(spark, "e", 50.0, 70.0, 10.0, 10.0, 5, 8, lambda cx, cy: cx)
    one = M.merged(M.mosaic([west, east]), 10.0, 10.0)
    points = spark.createDataFrame([("seam", M.MERGED, 51.0, 40.0)], "point_id string, dem_id string, px double, py double")
    assert M.resample_bilinear(one, points).first()["elev"] == pytest.approx(51.0)
    with pytest.raises(Exception, match="several grids"):
        M.merged(west.unionByName(grid(spark, "o", 3.0, 90.0, 10.0, 10.0, 2, 2, lambda cx, cy: cx)), 10.0, 10.0).collect()


def test_boxes_of_very_different_sizes(spark):
    rng = random.Random(2)
    boxes = [(f"s{k}", x := rng.uniform(0, 900), y := rng.uniform(0, 900), x + rng.uniform(0, 100), y + rng.uniform(0, 100)) for k in range(60)]
    boxes += [("huge", -250_000.0, -250_000.0, 250_000.0, 250_000.0), ("thin", 0.0, 500.0, 90_000.0, 500.5), ("point", 20.0, 30.0, 20.0, 30.0)]
    frame = spark.createDataFrame(boxes, "flight_id string, min_x double, min_y double, max_x double, max_y double")
    cells = grid(spark, "a", 0.0, 980.0, 20.0, 10.0, 50, 99, lambda cx, cy: 1.0)
    rows = M.clip_cells(cells, frame, 20.0, 10.0).collect()
    got = {(r["flight_id"], r["row_i"], r["col_i"]) for r in rows}
    want = {(b[0], c["row_i"], c["col_i"]) for c in cells.collect() for b in boxes if c["x"] <= b[3] and c["x"] + 20 >= b[1] and c["y"] <= b[4] and c["y"] + 10 >= b[2]}
    assert got == want and len(rows) == len(want)
    keyed = keyed_ranges(frame, [(F.col("min_x"), F.col("max_x")), (F.col("min_y"), F.col("max_y"))], 20.0)
    assert {r["flight_id"]: r["count"] for r in keyed.groupBy("flight_id").count().collect()}["huge"] <= 4
    assert keyed.count() <= 4 * len(boxes)
    assert keyed_points(cells, [F.col("x"), F.col("y")], keyed, 20.0).count() == cells.count() * keyed.select("__level").distinct().count()


DET = "seq_id string, line_no long, frame long, track_id long, bb_left int, bb_top int, bb_width int, bb_height int, conf double, class_id int, visibility double, is_propagated string"


def detections(spark, rows):
    """rows of (sequence, frame, track, class)."""
    return spark.createDataFrame([(s, k, f, t, f % 97, (f * 7) % 89, 10 + f % 5, 20, 0.5, c, 1.0, "0") for k, (s, f, t, c) in enumerate(rows)], DET)


def test_a_long_segment_has_few_rows(spark):
    det = detections(spark, [("a", 0, 1, 3), ("a", 100_001, 1, 3), ("a", 5, 2, 4), ("a", 9, 2, 4), ("b", 3, 1, 1)])
    targets = spark.createDataFrame([("a", f) for f in (0, 1, 6, 9, 50_000, 100_000, 100_001, 200_000)] + [("b", 3), ("c", 3)], "seq_id string, frame long")
    got = {(r["frame"], r["track_id"]): (r["bb_left"], r["_interpolated"]) for r in T.boxes_at(det, targets).where("seq_id = 'a'").collect()}
    assert set(got) == {(0, 1), (1, 1), (6, 1), (6, 2), (9, 1), (9, 2), (50_000, 1), (100_000, 1), (100_001, 1)}
    assert got[0, 1] == (0, False) and got[9, 2] == (9, False) and got[50_000, 1][1]
    seg = T.key_segments(det).where("nxt.frame - frame > 1")
    assert keyed_ranges(seg, [(F.col("frame") + 1, F.col("nxt.frame") - 1)], 8.0).groupBy("seq_id", "track_id").count().agg(F.max("count")).first()[0] <= 2


def test_sliding_extremes_equal_the_labels_around(spark):
    rng = random.Random(3)
    rows = [("a" if k % 3 else "b", rng.randrange(0, 400), rng.randrange(0, 6), rng.randrange(0, 9)) for k in range(500)]
    det = detections(spark, [*rows, *rows[:20]])  # ties on a frame
    centres = spark.createDataFrame([(s, c) for s in "abc" for c in range(-20, 430, 3)], "seq_id string, centre long")
    for before, after in ((15, 15), (0, 0), (3, 40)):
        got = T.merged_boxes(det, centres, before, after)
        want = T.merge_track_boxes(T.neighbour_labels(det, centres, before, after)).select(*got.columns)
        assert want.count() > 100 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_rounding_is_that_of_the_binary_value(spark):
    rng = random.Random(4)
    ties = [(k + 0.5) / 10**6 for k in range(-2000, 2000)] + [k + (j + 0.5) / 10**6 for k in (1, 1000, 123_456) for j in range(300)]
    values = ties + [rng.uniform(-1e6, 1e6) for _ in range(3000)] + [0.0, -0.0, 0.125, 2.5, -1e-9, 4.5e9, 1e15, 0.9999995, 0.99999949999]
    frame = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    got = frame.select("x", S.round_even(F.col("x"), 6).alias("r"), S.fmt_fixed(F.col("x"), 6).alias("t6"), S.fmt_fixed(F.col("x"), 2).alias("t2"), S.fmt_fixed(F.col("x"), 0).alias("t0")).collect()
    assert [r["r"] for r in got] == [round(v, 6) for v in values]
    assert [r["t6"] for r in got] == [f"{v:.6f}" for v in values]
    assert [r["t2"] for r in got] == [f"{v:.2f}" for v in values] and [r["t0"] for r in got] == [f"{v:.0f}" for v in values]
    odd = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,)], "x double").select(S.fmt_fixed(F.col("x"), 2)).collect()
    assert [r[0] for r in odd] == [None, None, "inf", "-inf"]


def test_normals_of_a_stencil_equal_those_of_faces(spark):
    rng = np.random.default_rng(5)
    z = rng.random((70, 45)) * 9 + 1
    cells = spark.createDataFrame([("a", r, c, 10.0 * c, 500.0 - 5 * r, float(z[r, c]) if (r, c) != (9, 9) else None) for r in range(70) for c in range(45)], CELL)
    origin = M.dem_origin(cells)
    vertices, faces = M.grid_vertices(cells, origin, 10.0, 5.0), M.grid_faces(cells)
    want = {r["vertex"]: r for r in M.vertex_normals(faces, vertices).collect()}
    made = M.grid_normals(cells, origin, 10.0, 5.0)
    got = {r["vertex"]: r for r in made.collect()}
    assert set(got) == set(want) and all(abs(got[v][c] - want[v][c]) < 1e-6 for v in want for c in ("nx", "ny", "nz"))
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)", made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1])
    assert len([x for x in shuffles if "tile_r" in x]) == 1 and all("tile_r" in x or re.fullmatch(r"dem_id#\d+, \d+", x) for x in shuffles)  # else of models, one row each


def test_boxes_at_shuffle_detections_once(spark):
    """rows at targets and between them come from one window by track; ties on a frame stay, and a frame that is null is at no target."""
    det = detections(spark, [("a", 5, 1, 3), ("a", 5, 1, 4), ("a", 9, 1, 3), ("a", 7, 2, 3)]).withColumn("frame", F.expr("nullif(frame, 7)"))
    targets = spark.createDataFrame([("a", f) for f in (4, 5, 6, 7, 9, 10)], "seq_id string, frame long")
    made = T.boxes_at(det, targets)
    got = sorted((r["frame"], r["line_no"], r["_interpolated"], r["_kf_a_frame"], r["_kf_b_frame"]) for r in made.collect())
    assert got == [(5, 0, False, None, None), (5, 1, False, None, None), (6, 1, True, 5, 9), (7, 1, True, 5, 9), (9, 2, False, None, None)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Window ", plan)) == 1 and "Union" not in plan
