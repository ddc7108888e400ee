"""Sinks: the text formats as DataFrames, and writers of files that have their own names."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flocktab.functions.scalar import fmt_fixed, yolo_box, yolo_label
from flocktab.schemas import DETECTION_FIELDS

from .named_files import write_named


def format_mot(det: DataFrame) -> DataFrame:
    """det with line: 13 comma-separated fields, conf and visibility with two decimals, species as it is; a null is an empty field."""
    text = lambda c: fmt_fixed(F.col(c), 2) if c in ("conf", "visibility") else F.col(c).cast("string")
    return det.withColumn("line", F.concat_ws(",", *[F.coalesce(text(c), F.lit("")) for c in DETECTION_FIELDS]))


def out_name(name: Column, suffix: str) -> Column:
    """<stem><suffix><ext>."""
    return name if not suffix else F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(suffix), F.regexp_extract(name, r"(\.[^.]*)$", 1))


def write_mot(det: DataFrame, path: str, suffix: str = "", order: tuple[str, ...] = ("line_no",), files: DataFrame | None = None, blank: str | None = "") -> None:
    """A file <stem><suffix><ext> for each input file, its lines in order; a file of `files` (file_name) without a row has the line `blank`, or none."""
    out_file = out_name(F.col("file_name"), suffix).alias("out_file")
    lines = format_mot(det).select(out_file, "line", *order)
    if files is not None:  # a null for each: det is not asked for its files, which would compute it twice
        none = [F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in ("line", *order)]
        lines = lines.unionByName(files.select("file_name").distinct().select(out_file, *none))
    write_named(lines, path, "out_file", "line", order, blank=blank if files is not None else None)


def zipped(members: Column) -> Column:
    """A zip archive of a map of names and texts."""

    def one(texts: dict[str, str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in texts.items():
                z.writestr(name, text)
        return out.getvalue()

    @F.pandas_udf("binary")
    def made(v: pd.Series) -> pd.Series:
        return v.map(lambda x: one(dict(x)))

    return made(members)


def yolo_files(det: DataFrame, img_width: int, img_height: int, properties: list[str]) -> DataFrame:
    """(label_file, content): the label lines of each sequence and frame, in input order. Of several files of one sequence the last by name counts for a frame. A box without a number has 0 there."""
    made = yolo_box(*[F.col(c) for c in ("bb_left", "bb_top", "bb_width", "bb_height")], float(img_width), float(img_height))
    line = F.concat(F.concat_ws(" ", yolo_label(properties), *[fmt_fixed(F.coalesce(c, F.lit(0.0)), 6) for c in made]), F.lit("\n"))
    file = F.col("file_name") if "file_name" in det.columns else F.lit("")
    rows = det.select("seq_id", "frame", "line_no", file.alias("f"), line.alias("line"))
    by_file = rows.groupBy("seq_id", "frame", "f").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    last = by_file.groupBy("seq_id", "frame").agg(F.max_by("lines", "f").alias("lines"))
    return last.select(F.concat("seq_id", F.lit("_"), F.col("frame").cast("string"), F.lit(".txt")).alias("label_file"), F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("content"))


def write_yolo(files: DataFrame, path: str) -> None:
    """Each label file under its name: opt-in, there are as many as frames."""
    write_named(files.select("label_file", F.rtrim("content", F.lit("\n")).alias("value")), path, "label_file", "value")


def pose_documents(poses: DataFrame, keys: tuple[str, ...] = ("flight_id", "file_name", "pos", "document")) -> DataFrame:
    """(file_name, value): one JSON document a flight with its images in order and all their keys, null ones too, and the keys of document beside them."""
    image = F.struct(*[F.col(f"`{c}`") for c in poses.columns if c not in keys])
    images = F.array_sort(F.collect_list(F.struct("pos", image.alias("image"))), lambda a, b: (a["pos"] - b["pos"]).cast("int"))
    beside = [F.min_by("document", "pos").alias("document")] if "document" in poses.columns else []
    docs = poses.groupBy("file_name").agg(F.transform(images, lambda x: x["image"]).alias("images"), *beside)
    return docs.select("file_name", F.to_json(F.struct(*(["document.*"] if beside else []), "images"), {"ignoreNullFields": "false"}).alias("value"))


def write_poses(poses: DataFrame, path: str, folders: bool = False) -> None:
    """Each flight's document under its name; folders: see write_named."""
    write_named(pose_documents(poses), path, "file_name", "value", folders=folders)


def dem_documents(origin: DataFrame, crs: str, cell_w: float, cell_h: float) -> DataFrame:
    """(dem_id, value): the metadata document of each model, from dem_origin()."""
    from flocktab.functions.projection import inverse

    lon, lat = inverse(F.col("origin_x"), F.col("origin_y"), crs)
    zero, one = F.lit(0.0), F.lit(1.0)
    transform = F.array(F.lit(cell_w), zero, F.col("origin_x"), zero, F.lit(-cell_h), F.col("origin_y") + F.col("height") * cell_h, zero, zero, one)
    doc = F.struct("width", "height", F.lit(crs).alias("crs"), transform.alias("transform"), F.array("origin_x", "origin_y", "origin_z").alias("origin"),
                   F.struct(lat.alias("latitude"), lon.alias("longitude"), F.col("origin_z").alias("altitude")).alias("origin_wgs84"))
    return origin.select("dem_id", F.to_json(doc).alias("value"))


def write_mesh_tables(vertices: DataFrame, faces: DataFrame, normals: DataFrame, path: str) -> None:
    for name, df in (("vertices", vertices), ("faces", faces), ("normals", normals)):
        df.write.partitionBy("dem_id").parquet(f"{path}/{name}")
