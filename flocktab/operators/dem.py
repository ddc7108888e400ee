"""Elevation models as tables of cells (dem_id, row_i, col_i, x, y, elev): mosaic, clip, resample, mesh.

x, y: a cell's lower left corner; row 0 is the northernmost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import counted
from .levels import keyed_points, keyed_ranges, keys


def valid_elevation(cells: DataFrame, nodata: float | None = None) -> DataFrame:
    """nodata and exactly 0 become null."""
    e = F.nullif(F.col("elev"), F.lit(0.0))
    return cells.withColumn("elev", e if nodata is None else F.nullif(e, F.lit(float(nodata))))


def dem_origin(cells: DataFrame, strict: bool = True) -> DataFrame:
    """Left and bottom bounds, least valid elevation, size in cells, by model; strict: a model without a valid cell is an error."""
    z = F.min("elev")
    origin_z = F.when(z.isNotNull(), z).otherwise(F.raise_error(F.lit("no valid elevation")).cast("double")) if strict else z
    return cells.groupBy("dem_id").agg(F.min("x").alias("origin_x"), F.min("y").alias("origin_y"), origin_z.alias("origin_z"), (F.max("col_i") + 1).alias("width"), (F.max("row_i") + 1).alias("height"))


def decimate_cells(cells: DataFrame, factor: int) -> DataFrame:
    """Every factor-th row and column, numbered anew."""
    n = max(1, factor)
    return cells.where((F.col("row_i") % n == 0) & (F.col("col_i") % n == 0)).withColumns({"row_i": F.floor(F.col("row_i") / n).cast("int"), "col_i": F.floor(F.col("col_i") / n).cast("int")})


def grid_vertices(cells: DataFrame, origin: DataFrame, cell_w: float, cell_h: float, factor: int = 1) -> DataFrame:
    """(dem_id, vertex, vx, vy, vz) in float32 from decimated cells; an invalid cell lies at the least elevation. origin: one row a model."""
    n = max(1, factor)
    size = cells.groupBy("dem_id").agg((F.max("col_i") + 1).alias("mw"), (F.max("row_i") + 1).alias("mh"))
    both = cells.join(size, "dem_id").join(origin.select("dem_id", "origin_z"), "dem_id")
    return both.select("dem_id", (F.col("row_i") * F.col("mw") + F.col("col_i")).cast("bigint").alias("vertex"), (F.col("col_i").cast("float") * F.lit(cell_w * n)).cast("float").alias("vx"),
                       ((F.col("mh") - 1 - F.col("row_i")).cast("float") * F.lit(abs(cell_h) * n)).cast("float").alias("vy"), (F.coalesce("elev", "origin_z") - F.col("origin_z")).cast("float").alias("vz"))


def grid_faces(cells: DataFrame) -> DataFrame:
    """Two triangles a quad: (i00, i01, i10), (i10, i01, i11); face numbers follow rows, then columns."""
    size = cells.groupBy("dem_id").agg((F.max("col_i") + 1).alias("mw"), (F.max("row_i") + 1).alias("mh"))
    quads = cells.join(size, "dem_id").where((F.col("row_i") < F.col("mh") - 1) & (F.col("col_i") < F.col("mw") - 1))
    i00 = (F.col("row_i") * F.col("mw") + F.col("col_i")).cast("bigint")
    i10, i01, i11 = i00 + 1, i00 + F.col("mw"), i00 + F.col("mw") + 1
    tri = lambda k, *v: F.struct(F.lit(k).alias("k"), *[c.alias(n) for c, n in zip(v, ("a", "b", "c"), strict=True)])
    quad = F.col("row_i") * (F.col("mw") - 1) + F.col("col_i")
    return quads.select("dem_id", quad.alias("quad"), F.explode(F.array(tri(0, i00, i01, i10), tri(1, i10, i01, i11))).alias("t")).select("dem_id", (F.col("quad") * 2 + F.col("t.k")).cast("bigint").alias("face"), "t.a", "t.b", "t.c")


def face_corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(dem_id, face, corner 0..2, vertex, vx, vy, vz)."""
    corners = faces.select("dem_id", "face", F.posexplode(F.array("a", "b", "c")).alias("corner", "vertex"))
    return corners.join(vertices, ["dem_id", "vertex"])


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Sum of the unit normals of a vertex's faces, scaled to length 1; 0 stays 0."""
    pick = lambda k: F.max(F.when(F.col("corner") == k, F.struct("vertex", "vx", "vy", "vz"))).alias(f"p{k}")
    tri = face_corners(faces, vertices).groupBy("dem_id", "face").agg(pick(0), pick(1), pick(2))
    d = lambda k, c: (F.col(f"p{k}.{c}") - F.col(f"p0.{c}")).cast("double")
    ux, uy, uz, wx, wy, wz = d(1, "vx"), d(1, "vy"), d(1, "vz"), d(2, "vx"), d(2, "vy"), d(2, "vz")
    crossed = tri.select("dem_id", F.array("p0.vertex", "p1.vertex", "p2.vertex").alias("v"), (uy * wz - uz * wy).alias("x"), (uz * wx - ux * wz).alias("y"), (ux * wy - uy * wx).alias("z"))
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    unit = crossed.withColumn("n", F.when(length > 0, length).otherwise(1.0)).select("dem_id", F.explode("v").alias("vertex"), *[(F.col(c) / F.col("n")).alias(c) for c in "xyz"])
    summed = unit.groupBy("dem_id", "vertex").agg(*[F.sum(c).alias(c) for c in "xyz"])
    return summed.withColumn("n", F.when(length > 0, length).otherwise(1.0)).select("dem_id", "vertex", *[(F.col(c) / F.col("n")).cast("float").alias(f"n{c}") for c in "xyz"])


def mesh_bounds(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Extent by axis, vertices and indices."""
    a = vertices.groupBy("dem_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("vx", "vy", "vz") for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n_vertices"))
    return a.join(faces.groupBy("dem_id").agg((3 * F.count("*")).alias("n_indices")), "dem_id", "left")


def mosaic(tiles: list[DataFrame]) -> DataFrame:
    """Union of tables of cells; of cells at one place the first table's counts."""
    ranked = [t.withColumn("rank", F.lit(k)) for k, t in enumerate(tiles)]
    out = ranked[0]
    for t in ranked[1:]:
        out = out.unionByName(t)
    rest = [c for c in tiles[0].columns if c not in ("x", "y")]
    return out.groupBy("x", "y").agg(F.min_by(F.struct(*rest), "rank").alias("r")).select("x", "y", "r.*")


def clip_cells(cells: DataFrame, boxes: DataFrame, cell_w: float, cell_h: float) -> DataFrame:
    """(flight_id, cell…) for each cell that touches a flight's box (min_x … max_y): a range join made an equi-join on bins of the boxes' own sizes.

    A box, with a cell's width to the left and height below, is looked up by the cells' lower left corners: four keys a box at most, one a cell and level."""
    unit = max(cell_w, cell_h)
    slack = unit * 1e-6  # the test below decides, not how sums are rounded here
    b = boxes.select("flight_id", "min_x", "min_y", "max_x", "max_y")
    b = keyed_ranges(b, [(F.col("min_x") - cell_w - slack, F.col("max_x") + slack), (F.col("min_y") - cell_h - slack, F.col("max_y") + slack)], unit)
    touch = (F.col("x") <= F.col("max_x")) & (F.col("x") + cell_w >= F.col("min_x")) & (F.col("y") <= F.col("max_y")) & (F.col("y") + cell_h >= F.col("min_y"))
    return keyed_points(cells, [F.col("x"), F.col("y")], b, unit).join(counted(b), keys(2)).where(touch).select("flight_id", *cells.columns)


def cells_in_box(cells: DataFrame, boxes: DataFrame, width: float, height: float, grids: DataFrame | None = None) -> DataFrame:
    """(flight_id, row_i, col_i, x, y, elev): each flight's box as a grid of its own cells of width and height, resampled bilinearly; row 0 is the northernmost.

    boxes name the model in dem_id; without that column all take the one model that cells are (see merged)."""
    n = lambda lo, hi, step: F.greatest(F.lit(1), F.ceil((F.col(hi) - F.col(lo)) / step)).cast("int")
    grid = boxes.select("flight_id", "min_x", "min_y", F.col("dem_id") if "dem_id" in boxes.columns else F.lit(MERGED).alias("dem_id"), n("min_x", "max_x", width).alias("nx"), n("min_y", "max_y", height).alias("ny"))
    grid = grid.withColumn("col_i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("row_i", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    x, y = F.col("min_x") + F.col("col_i") * width, F.col("min_y") + (F.col("ny") - 1 - F.col("row_i")) * height
    points = grid.select("dem_id", F.struct("flight_id", "row_i", "col_i", x.alias("x"), y.alias("y")).alias("point_id"), (x + width / 2).alias("px"), (y + height / 2).alias("py"))
    return resample_bilinear(cells, points, grids).select("point_id.*", "elev")


def mesh_tables(cells: DataFrame, cell_w: float, cell_h: float, factor: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, faces and normals of valid cells, every factor-th row and column."""
    origin, small = dem_origin(cells), decimate_cells(cells, factor)
    vertices, faces = grid_vertices(small, origin, cell_w, cell_h, factor), grid_faces(small)
    return vertices, faces, grid_normals(small, origin, cell_w, cell_h, factor)


def model_grids(cells: DataFrame) -> DataFrame:
    """(dem_id, x0, y0, cell_w, cell_h, min_x … max_y): each model's own grid, from where its cells lie: the lower left corner of cell (0, 0), the size of a cell, and the extent.

    The size is what lies between the outermost rows and columns; a model of one row or column has null there (see metadata_grids)."""
    a = cells.groupBy("dem_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y", "row_i", "col_i") for n, f in (("lo", F.min), ("hi", F.max))])
    step = lambda c, k: F.when(F.col(f"hi_{k}") > F.col(f"lo_{k}"), (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / (F.col(f"hi_{k}") - F.col(f"lo_{k}")))
    a = a.withColumns({"cell_w": step("x", "col_i"), "cell_h": step("y", "row_i")})
    return a.select("dem_id", (F.col("lo_x") - F.col("lo_col_i") * F.col("cell_w")).alias("x0"), (F.col("hi_y") + F.col("lo_row_i") * F.col("cell_h")).alias("y0"), "cell_w", "cell_h",
                    F.col("lo_x").alias("min_x"), F.col("lo_y").alias("min_y"), (F.col("hi_x") + F.col("cell_w")).alias("max_x"), (F.col("hi_y") + F.col("cell_h")).alias("max_y"))


def metadata_grids(meta: DataFrame) -> DataFrame:
    """The same from metadata documents: transform [width, 0, left, 0, -height, top, …] and the model's size in cells; dem_id is the flight's id."""
    t = lambda k: F.col("transform")[k]
    left, top, w, h = t(2), t(5), t(0), -t(4)
    return meta.select(F.col("flight_id").alias("dem_id"), left.alias("x0"), (top - h).alias("y0"), w.alias("cell_w"), h.alias("cell_h"),
                       left.alias("min_x"), (top - F.col("height") * h).alias("min_y"), (left + F.col("width") * w).alias("max_x"), top.alias("max_y"))


#: The dem_id of cells of several models that were made one.
MERGED = "merged"


def merged(cells: DataFrame, cell_w: float, cell_h: float) -> DataFrame:
    """Cells of a mosaic, of models on one common grid, numbered anew as one model. Cells that lie off that grid are an error."""
    first = lambda f, c: cells.agg(f(c).alias("v")).scalar()
    col, row = (F.col("x") - first(F.min, "x")) / cell_w, (first(F.max, "y") - F.col("y")) / cell_h
    on = lambda v: F.when(F.abs(v - F.rint(v)) < 1e-6, F.rint(v).cast("int")).otherwise(F.raise_error(F.lit("cells of several grids")).cast("int"))
    return cells.withColumns({"dem_id": F.lit(MERGED), "row_i": on(row), "col_i": on(col)})


def tiled(cells: DataFrame, size: int, before: int, after: int, *values: str) -> DataFrame:
    """(dem_id, tile_r, tile_c, grid): tiles of size x size cells with a halo of rows and columns before and after; grid maps row to column to the values.

    One shuffle, by tile: rows of a tile are put together where they are, then the tile."""
    own = lambda c: F.floor(F.col(c) / size).cast("int")
    tiles = lambda c: F.array_compact(F.array(
        own(c), *([F.when(F.pmod(F.col(c), F.lit(size)) < after, own(c) - 1)] if after else []), *([F.when(F.pmod(F.col(c), F.lit(size)) >= size - before, own(c) + 1)] if before else [])))
    tile = ["dem_id", "tile_r", "tile_c"]
    spread = cells.withColumn("tile_r", F.explode(tiles("row_i"))).withColumn("tile_c", F.explode(tiles("col_i")))
    # of cells that repeat one counts, the least
    once = spread.repartition(*[F.col(c) for c in tile]).groupBy(*tile, "row_i", "col_i").agg(F.min(F.struct(*values)).alias("v"))
    rows = once.groupBy(*tile, "row_i").agg(F.map_from_entries(F.collect_list(F.struct("col_i", "v"))).alias("cols"))
    return rows.groupBy(*tile).agg(F.map_from_entries(F.collect_list(F.struct("row_i", "cols"))).alias("grid"))


def at(row: Column, col: Column) -> Column:
    """A cell of a tile's grid, or null."""
    return F.element_at(F.element_at("grid", row), col)


def points_in_models(points: DataFrame, grids: DataFrame, unit: float = 1000.0) -> DataFrame:
    """points with each model's grid: of the model in dem_id, or, without that column, of every model that the point lies in."""
    if "dem_id" in points.columns:
        return points.join(counted(grids), "dem_id", "left")
    boxes = keyed_ranges(grids, [(F.col("min_x"), F.col("max_x")), (F.col("min_y"), F.col("max_y"))], unit)
    inside = (F.col("px") >= F.col("min_x")) & (F.col("px") <= F.col("max_x")) & (F.col("py") >= F.col("min_y")) & (F.col("py") <= F.col("max_y"))
    return keyed_points(points, [F.col("px"), F.col("py")], boxes, unit).join(counted(boxes), keys(2)).where(inside).drop(*keys(2))


def resample_bilinear(cells: DataFrame, points: DataFrame, grids: DataFrame | None = None, size: int = 16) -> DataFrame:
    """(point_id, dem_id, elev): points (point_id, px, py, and dem_id if each has its model) with the elevation from the centres of the four cells around, on each model's own grid.

    Null if one of the four that has a weight is missing or invalid. A point without dem_id has a row for every model it lies in, so none outside of all.
    Cells go to tiles that carry the next tile's first row and column, so a point meets one tile, by one join, and no group of points is made."""
    placed = points_in_models(points, model_grids(cells) if grids is None else grids)
    gx = (F.col("px") - F.col("x0")) / F.col("cell_w") - 0.5
    gy = (F.col("y0") + F.col("cell_h") - F.col("py")) / F.col("cell_h") - 0.5
    base = placed.select("point_id", "dem_id", F.floor(gx).cast("int").alias("c"), F.floor(gy).cast("int").alias("r"), (gx - F.floor(gx)).alias("fx"), (gy - F.floor(gy)).alias("fy"))
    base = base.withColumns({"tile_r": F.floor(F.col("r") / size).cast("int"), "tile_c": F.floor(F.col("c") / size).cast("int")})
    held = base.join(tiled(cells.where("elev is not null"), size, 0, 1, "elev"), ["dem_id", "tile_r", "tile_c"], "left")
    total = F.lit(0.0)
    for dr, wy in ((0, 1 - F.col("fy")), (1, F.col("fy"))):
        for dc, wx in ((0, 1 - F.col("fx")), (1, F.col("fx"))):
            w = wx * wy
            total = total + F.when(w > 0, w * at(F.col("r") + dr, F.col("c") + dc)["elev"]).otherwise(0.0)
    return held.select("point_id", "dem_id", F.when(F.col("fx").isNotNull(), total).alias("elev"))


def grid_normals(cells: DataFrame, origin: DataFrame, cell_w: float, cell_h: float, factor: int = 1, size: int = 32) -> DataFrame:
    """(dem_id, vertex, nx, ny, nz) of the vertices that grid_vertices gives: each from the six triangles around it, in tiles that carry a row and a column of each neighbour. One shuffle of cells."""
    n = max(1, factor)
    sizes = cells.groupBy("dem_id").agg((F.max("col_i") + 1).alias("mw"))  # one row a model
    z = (F.coalesce("elev", "origin_z") - F.col("origin_z")).cast("float").cast("double")
    flat = cells.join(counted(origin.select("dem_id", "origin_z")), "dem_id").select("dem_id", "row_i", "col_i", z.alias("z"))
    tiles = tiled(flat, size, 1, 1, "z")
    rows = tiles.select("dem_id", "tile_r", "tile_c", "grid", F.explode("grid").alias("r", "cols")).where(F.floor(F.col("r") / size) == F.col("tile_r"))
    own = rows.select("dem_id", "tile_c", "grid", "r", F.explode("cols").alias("c", "v")).where(F.floor(F.col("c") / size) == F.col("tile_c"))
    # columns go east, rows south; y grows to the north. In float32, as the vertices are
    dx, dy = float(np.float32(cell_w * n)), float(np.float32(abs(cell_h) * n))
    height = lambda dr, dc: F.col("v.z") if (dr, dc) == (0, 0) else at(F.col("r") + dr, F.col("c") + dc)["z"]
    made = own.select("dem_id", "r", "c", *[height(dr, dc).alias(f"z{dr + 1}{dc + 1}") for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
    sums = [F.lit(0.0)] * 3
    # a quad's corners: north-west, north-east, south-west, south-east; its triangles (nw, sw, ne) and (ne, sw, se)
    for r, c in ((-1, -1), (-1, 0), (0, -1), (0, 0)):
        nw, ne, sw, se = [F.col(f"z{r + i + 1}{c + j + 1}") for i, j in ((0, 0), (0, 1), (1, 0), (1, 1))]
        first = (dy * (ne - nw) * -1, dx * (sw - nw), F.lit(dx * dy))
        second = (dy * (sw - se), dx * (se - ne), F.lit(dx * dy))
        for side, used in ((first, (r, c) != (-1, -1)), (second, (r, c) != (0, 0))):
            if used:
                length = F.sqrt(side[0] * side[0] + side[1] * side[1] + side[2] * side[2])
                whole = nw.isNotNull() & ne.isNotNull() & sw.isNotNull() & se.isNotNull()
                sums = [s + F.when(whole & (length > 0), x / length).otherwise(0.0) for s, x in zip(sums, side, strict=True)]
    out = made.select("dem_id", "r", "c", *[s.alias(a) for s, a in zip(sums, "xyz", strict=True)]).join(counted(sizes), "dem_id")
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    out = out.withColumn("n", F.when(length > 0, length).otherwise(1.0))
    return out.select("dem_id", (F.col("r") * F.col("mw") + F.col("c")).cast("bigint").alias("vertex"), *[(F.col(a) / F.col("n")).cast("float").alias(f"n{a}") for a in "xyz"])
