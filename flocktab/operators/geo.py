"""Bounding areas, map tiles and relative positions of poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flocktab.functions.projection import forward
from flocktab.functions.scalar import TILE, TILE_BASE, TILE_PATTERNS, floor_div, fovy, round_even, tile_name

from .detections import last_wins


def valid_poses(poses: DataFrame) -> DataFrame:
    """Poses with lat, 0 included, and lon: the first of lng and lon that is neither null nor 0, else longitude, 0 included."""
    have = [c for c in ("lng", "lon", "longitude") if c in poses.columns]
    first = [F.col(c) if c == "longitude" else F.nullif(F.col(c), F.lit(0.0)) for c in have]
    return poses.withColumn("lon", F.coalesce(*first)).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def flight_bbox(poses: DataFrame, padding_m: float = 50.0) -> DataFrame:
    """min_lat, min_lon, max_lat, max_lon by flight, padded in metres."""
    box = poses.groupBy("flight_id").agg(F.min("lat").alias("a"), F.min("lon").alias("b"), F.max("lat").alias("c"), F.max("lon").alias("d"))
    pad_lat = F.lit(padding_m / 111320 if padding_m > 0 else 0.0)
    pad_lon = F.lit(float(padding_m)) / (F.cos(F.radians((F.col("a") + F.col("c")) / 2)) * 111320) if padding_m > 0 else F.lit(0.0)
    return box.select("flight_id", (F.col("a") - pad_lat).alias("min_lat"), (F.col("b") - pad_lon).alias("min_lon"), (F.col("c") + pad_lat).alias("max_lat"), (F.col("d") + pad_lon).alias("max_lon"))


def box_to_crs(boxes: DataFrame, crs: str = "EPSG:3035") -> DataFrame:
    """boxes with min_x, min_y, max_x, max_y: the extent of the four projected corners."""
    corners = F.array(*[F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat")) for lon in ("min_lon", "max_lon") for lat in ("min_lat", "max_lat")])

    def projected(c):
        x, y = forward(c["lon"], c["lat"], crs)
        return F.struct(x.alias("x"), y.alias("y"))

    # one lambda for the four corners keeps the plan a quarter as large
    made = boxes.withColumn("__xy", F.transform(corners, projected))
    return made.withColumns({f"{n}_{c}": f(F.col(f"__xy.{c}")) for c in "xy" for n, f in (("min", F.array_min), ("max", F.array_max))}).drop("__xy")


def tiles_for_box(boxes: DataFrame) -> DataFrame:
    """One row for each 50 km tile that a box (min_x … max_y) touches, in north-major order: north, east, tile, pos."""
    at = lambda c: floor_div(F.col(c), TILE) * TILE
    norths = F.sequence(at("min_y"), at("max_y"), F.lit(TILE).cast("bigint"))
    easts = F.sequence(at("min_x"), at("max_x"), F.lit(TILE).cast("bigint"))
    rows = boxes.select("flight_id", F.posexplode(norths).alias("pn", "north"), easts.alias("easts")).select("flight_id", "pn", "north", F.size("easts").alias("width"), F.posexplode("easts").alias("pe", "east"))
    return rows.select("flight_id", "north", "east", tile_name(F.col("north"), F.col("east")).alias("tile"), (F.col("pn") * F.col("width") + F.col("pe")).alias("pos"))


def tile_urls(tiles: DataFrame) -> DataFrame:
    """Three candidate URLs a tile, by priority; none for a malformed name. The patterns are an array in the row: no join."""
    part = lambda g: F.regexp_extract("tile", r"N(\d+)E(\d+)", g)
    urls = [F.concat(F.lit(f"{TILE_BASE}{date}/{p.split('{north}')[0]}"), part(1), F.lit("E"), part(2), F.lit(".tif")) for date, p in TILE_PATTERNS]
    return tiles.where(part(1) != "").select("*", F.posexplode(F.array(*urls)).alias("priority", "url"))


def first_available(candidates: DataFrame, available: DataFrame) -> DataFrame:
    """For each tile the candidate of best priority whose url is in available(url)."""
    w = Window.partitionBy("tile").orderBy("priority")
    found = candidates.select("tile", "priority", "url").distinct().join(available.select("url").distinct(), "url")
    return found.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def dem_tile_plan(poses: DataFrame, available: DataFrame, padding_m: float = 50.0) -> DataFrame:
    """The tiles that each flight needs, with the best of their urls in available(url), or null."""
    tiles = tiles_for_box(box_to_crs(flight_bbox(valid_poses(poses), padding_m)))
    return tiles.join(first_available(tile_urls(tiles), available), "tile", "left")


def counted(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df to be broadcast if it has so many rows at most, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def pair_poses_dem(poses: DataFrame, dem_meta: DataFrame) -> DataFrame:
    """Poses with the elevation model of the same flight, of several documents of one flight the last by file name; broadcast if there are few. Poses without one are left out (see unmatched)."""
    if "file_name" in dem_meta.columns:
        dem_meta = last_wins(dem_meta, "flight_id", "file_name").withColumnRenamed("file_name", "dem_file")
    return poses.join(counted(dem_meta), "flight_id")


def unmatched(poses: DataFrame, dem_meta: DataFrame) -> DataFrame:
    return poses.select("flight_id").distinct().join(dem_meta, "flight_id", "left_anti")


def relative_position(paired: DataFrame, crs: str) -> DataFrame:
    """paired with location [east, north, up] from the model's origin, to 6 digits, and rotation [pitch, roll, yaw]."""
    e, n = forward(F.col("lng"), F.col("lat"), crs)
    location = [round_even(e - F.col("origin_x"), 6), round_even(n - F.col("origin_y"), 6), round_even(F.col("alt") - F.col("origin_z"), 6)]
    return paired.withColumns({"location": F.array(*location), "rotation": F.array("pitch", "roll", "yaw")})


def relative_poses(poses: DataFrame, dem_meta: DataFrame, crs_list: list[str]) -> DataFrame:
    """relative_position by the reference system that dem_meta.crs names: one join, one CASE; a system not listed is an error."""
    paired, known = pair_poses_dem(poses, dem_meta), F.col("crs")
    east = north = F.raise_error(F.concat(F.lit("no projection for "), F.coalesce(known, F.lit("null")))).cast("double")
    for crs in crs_list:
        e, n = forward(F.col("lng"), F.col("lat"), crs)
        east, north = F.when(known == crs, e).otherwise(east), F.when(known == crs, n).otherwise(north)
    location = [round_even(east - F.col("origin_x"), 6), round_even(north - F.col("origin_y"), 6), round_even(F.col("alt") - F.col("origin_z"), 6)]
    return paired.withColumns({"location": F.array(*location), "rotation": F.array("pitch", "roll", "yaw")})


def frame_pose(det: DataFrame, poses: DataFrame, corrections: DataFrame | None = None, default_fovy: float = 50.0) -> DataFrame:
    """The camera of each annotated frame: a frame is its pose's place in the flight. With fovy, and the flight's correction
    (translation, rotation; zero without one) from corrections, by flight_id, or one row for all."""
    frames = det.select(F.col("seq_id").alias("flight_id"), "frame").distinct()
    kind = dict(poses.dtypes).get("fovy")
    angle = fovy(F.col("fovy"), kind, default_fovy) if kind else F.lit(default_fovy)
    made = frames.join(poses.withColumnRenamed("pos", "frame"), ["flight_id", "frame"]).withColumn("fovy", angle)
    zero = F.struct(*[F.lit(0.0).alias(a) for a in "xyz"])
    if corrections is None:
        return made.withColumns({"translation": zero, "rotation": zero})
    keyed = "flight_id" in corrections.columns
    fixed = corrections.select(*(["flight_id"] if keyed else []), F.col("translation").alias("__t"), F.col("rotation").alias("__r"))
    joined = made.join(fixed, "flight_id", "left") if keyed else made.join(F.broadcast(fixed.limit(1)), how="left")  # one row
    return joined.withColumns({"translation": F.coalesce("__t", zero), "rotation": F.coalesce("__r", zero)}).drop("__t", "__r")
