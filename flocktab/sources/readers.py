"""Sources. Files are read by Spark, one task for many small files; nothing is listed or opened on the driver."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, _parse_datatype_string

from flocktab import schemas
from flocktab.functions.scalar import file_id, seq_id, split_class_key, strip

from .named_files import file_system, listed, tasks, text, texts

#: dialect -> lines stripped and blank ones skipped, quotes honoured, fewest fields, pattern of # lines skipped, last three fields as int, blanks kept or an error
DIALECTS = {
    "filter": {"strip": True, "quotes": True, "least": 0, "comments": None, "ints": False},
    "frames": {"strip": True, "quotes": True, "least": 6, "comments": None, "ints": False},
    "interp": {"strip": True, "quotes": False, "least": 0, "comments": None, "ints": True},
    "yolo": {"strip": False, "quotes": True, "least": 0, "comments": "stripped", "ints": False, "lenient": True},
    "point": {"strip": False, "quotes": True, "least": 13, "comments": "stripped", "ints": True, "blank_fails": True},
    "track": {"strip": False, "quotes": True, "least": 0, "comments": "as is", "ints": True},
}
_INTS = ["frame", "track_id", "bb_left", "bb_top", "bb_width", "bb_height", "class_id"]
_TEXT = ", ".join(f"{c} string" for c in schemas.DETECTION_FIELDS)


def mot_lines(files: DataFrame) -> DataFrame:
    """files (file_name, value: whole text) -> (file_name, seq_id, line_no, line), empty lines left out."""
    rows = files.select("file_name", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line_no", "line"))
    return rows.where("line != ''").select("file_name", seq_id(F.col("file_name")).alias("seq_id"), F.col("line_no").cast("bigint"), "line")


def numbered_lines(rows: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """mot_lines of a scan of files by lines (file_name, path, block: where the line's split begins, value), so that a file of any size is read by many tasks.

    A split is in one task, in order: a line's place is its place in the split, and the lines of the splits before. only (file_name): other files' splits, so their lines too, are left out."""
    at = rows.withColumn("id", F.monotonically_increasing_id())
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = at.groupBy("path", "block", "file_name").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    if only is not None:
        splits = splits.join(only, "file_name", "left_semi")
    # names are taken apart once a split, not once a line
    splits = splits.select("path", "block", "file_name", seq_id(F.col("file_name")).alias("seq_id"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    made = at.drop("file_name").join(splits, ["path", "block"]).where("value != ''")
    return made.select("file_name", "seq_id", F.coalesce(F.col("id") + F.col("shift"), F.lit(0)).alias("line_no"), F.col("value").alias("line"))


def scanned(files: DataFrame) -> DataFrame:
    """A scan of text files, by lines, as numbered_lines takes it."""
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def parse_mot(lines: DataFrame, dialect: str = "filter", on_error: str = "raise") -> DataFrame:
    """Lines as detections. A number that can't be read raises; with on_error="null" it is null and _corrupt is true.

    A line of white space is a row of blank fields in the dialects that do not strip lines."""
    d = DIALECTS[dialect]
    if d["strip"]:
        lines = lines.withColumn("line", strip(F.col("line"))).where("line != ''")
    if d["comments"]:
        head = strip(F.col("line")) if d["comments"] == "stripped" else F.col("line")
        lines = lines.where(~head.startswith("#"))
    parts, quoted = F.split("line", ","), F.col("line").contains('"') | F.col("line").contains("\0")  # a zero byte begins a comment in from_csv
    if d["quotes"]:
        csv = F.from_csv("line", F.lit(_TEXT), {"mode": "PERMISSIVE", "quote": '"', "escape": '"'})
        parts = F.when(quoted, F.element_at(F.transform(F.array(csv), lambda x: F.array(*[x[c] for c in schemas.DETECTION_FIELDS])), 1)).otherwise(parts)
    if d["least"]:
        # from_csv gives null for a missing field and for an empty one; commas outside quotes tell them apart
        bare = F.when(quoted, F.regexp_replace("line", r'"[^"]*"', "")).otherwise(F.col("line"))
        lines = lines.where(F.size(F.split(bare, ",")) >= d["least"])
    # by explode: filters on fields go down to a plain column's place, and the line would be taken apart anew for each of them
    made = lines.select("file_name", "seq_id", "line_no", F.explode(F.array(parts)).alias("f"))
    field = lambda c: F.get("f", F.lit(schemas.DETECTION_FIELDS.index(c)))
    # what a cast reads as it is needs no more; the rest goes through functions of a bound variable, as their text inlined is too much code to compile
    rest = lambda c, made: F.element_at(F.transform(F.array(field(c)), lambda x: made(F.nullif(strip(x), F.lit("")))), 1)
    soft = on_error == "null" or d.get("lenient", False)
    bad = []

    def number(c: str, kind: str, zero: str):
        quick, needed = field(c).try_cast(kind), d.get("blank_fails") and c in schemas.DETECTION_FIELDS[:9]
        blank = F.lit(None if needed or d.get("lenient") else zero).cast(kind)
        if needed and not soft:
            blank = F.raise_error(F.lit(f"blank {c}")).cast(kind)
        cast = lambda value: value.try_cast(kind) if soft else value.cast(kind)
        if soft:
            bad.append(quick.isNull() & rest(c, lambda value: (value.isNull() & F.lit(bool(needed))) | (value.isNotNull() & cast(value).isNull())))
        return F.coalesce(quick, rest(c, lambda value: F.when(value.isNull(), blank).otherwise(cast(value))))

    out = [number(c, "bigint" if c in ("frame", "track_id") else "int", "0").alias(c) for c in _INTS if c != "class_id"]
    out += [number("conf", "double", "0").alias("conf"), number("class_id", "int", "0").alias("class_id"), number("visibility", "double", "0").alias("visibility"), F.coalesce(strip(field("species")), F.lit("")).alias("species")]
    for c in ("gender", "age", "is_propagated"):
        out.append(number(c, "int", "0").cast("string").alias(c) if d["ints"] else F.coalesce(strip(field(c)), F.lit("")).alias(c))
    if on_error == "null":
        corrupt = F.lit(False)
        for b in bad:
            corrupt = corrupt | b
        out.append(corrupt.alias("_corrupt"))
    return made.select("file_name", "seq_id", "line_no", *out)


def read_mot(spark: SparkSession, path: str, dialect: str = "filter", on_error: str = "raise", glob: str = "*.txt", only: DataFrame | None = None) -> DataFrame:
    """A text file or a folder of them as detections, with file and line order kept. A file is read by lines, a large one by many tasks. An empty folder has none. only (file_name): lines of other files are not parsed."""
    lines = scanned(spark.read.schema("value string").option("pathGlobFilter", glob).text(path))
    return parse_mot(numbered_lines(lines, only), dialect, on_error)


def _flight_documents(spark: SparkSession, folder: str) -> DataFrame:
    made = spark.read.schema(schemas.FLIGHT + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(folder, multiLine=True, pathGlobFilter="*_metadata.json", mode="PERMISSIVE")
    return made.withColumn("file_name", F.col("_metadata.file_name"))


def read_flight_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """*_metadata.json documents; unreadable ones are skipped (see unreadable_flight_metadata). Ordered by file name where order matters: file_name is a column."""
    return _flight_documents(spark, folder).where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def unreadable_flight_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, flight_key, record) of the documents that read_flight_metadata skips: flight_key if that much could be read, and the text."""
    return _flight_documents(spark, folder).where(F.col("_corrupt_record").isNotNull()).select("file_name", "flight_key", F.col("_corrupt_record").alias("record"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The parts of a release manifest with line_no, their place in the list; an empty one is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in schemas.MANIFEST.split(', '))}>>").alias("parts"))
    made = whole.select(F.posexplode("parts").alias("line_no", "part")).select("line_no", "part.*").where("flights is not null")
    if made.isEmpty():
        raise ValueError(f"{path} is no list of parts, or an empty one")
    return made


def read_poses(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """*_poses.json documents, one row an image: flight_id, file_name, pos, the image's own keys (schema inferred, so none is lost), and in document, if there are any, the keys beside images."""
    files = listed(spark, path, "*_poses.json", recursive)
    schema = spark.read.json(files.select("path").repartition(tasks(spark), "path").rdd.map(lambda r: text(r[0]))).schema
    made = texts(files).select("file_name", F.inline(F.from_json("value", ArrayType(schema))))
    beside = [f"`{c}`" for c in schema.names if c != "images"]
    document = [F.struct(*beside).alias("document")] if beside else []
    rows = made.select("file_name", *document, F.posexplode("images").alias("pos", "image"))
    return rows.select(F.split("file_name", "_")[0].alias("flight_id"), "file_name", F.col("pos").cast("bigint").alias("pos"), *(["document"] if beside else []), "image.*")


def read_dem_metadata(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """*_matched_dem.json documents with file_name, flight_id and the origin's coordinates; recursive: of all subfolders too."""
    made = texts(listed(spark, path, "*_matched_dem.json", recursive))
    made = made.select("file_name", F.inline_outer(F.from_json("value", ArrayType(_parse_datatype_string(schemas.DEM_META)))))
    return made.select(F.split("file_name", "_")[0].alias("flight_id"), "*", *[F.col("origin")[k].alias(f"origin_{c}") for k, c in enumerate("xyz")])


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Translation and rotation, each part 0 where it is missing."""
    made = spark.read.schema(schemas.CORRECTION).json(path, multiLine=True)
    whole = lambda c: F.struct(*[F.coalesce(F.col(f"{c}.{a}"), F.lit(0.0)).alias(a) for a in "xyz"]).alias(c)
    return made.select(F.col("_metadata.file_name").alias("file_name"), whole("translation"), whole("rotation"))


def read_deposition_listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, url) of a saved listing: filename else key, download link else self link; both must be there."""
    made = spark.read.schema(schemas.LISTING).json(path, multiLine=True).select(F.explode("files").alias("f"))
    either = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")))
    return made.select(either("f.filename", "f.key").alias("name"), either("f.links.download", "f.links.self").alias("url")).where("name is not null and url is not null")


# Suffixes of videos and of annotation files.
VIDEO_EXTENSIONS = ["mp4", "avi", "mov", "mkv", "ts", "wmv", "flv"]
MOT_EXTENSIONS = ["txt", "csv"]


def list_files(spark: SparkSession, folder: str, extensions: list[str], recursive: bool = False) -> DataFrame:
    """(path, file_name, suffix, length, id) of the files with these suffixes, in any case; contents are not read. Files without a byte are left out, as in all of Spark's sources. recursive: of all subfolders too, which tasks list."""
    made = listed(spark, folder, recursive=recursive)
    suffix = F.lower(F.regexp_extract("file_name", r"\.([^.]*)$", 1))
    return made.select("path", "file_name", suffix.alias("suffix"), "length", file_id(F.col("file_name")).alias("id")).where(F.col("suffix").isin([e.lower().lstrip(".") for e in extensions]))


def file_names(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(file_name) of the files of a folder, or of one file; empty ones too, which Spark's sources leave out. A listing by the driver, as every read begins with one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [fs.getFileStatus(path)] if fs.getFileStatus(path).isFile() else [x for x in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, glob)) or [] if x.isFile()]
    names = [(x.getPath().getName(),) for x in found]
    return spark.createDataFrame(names, "file_name string")


def class_dictionary(spark: SparkSession) -> DataFrame:
    """class_id, class_key and its parts."""
    made = spark.createDataFrame([(k, v) for k, v in enumerate(schemas.CLASSES)], "class_id int, class_key string")
    return made.select("class_id", "class_key", *split_class_key(F.col("class_key")))


def read_dem_cells(spark: SparkSession, path: str) -> DataFrame:
    """Elevation cells from parquet."""
    return spark.read.schema(schemas.DEM_CELL).parquet(path)


def read_mot_archives(spark: SparkSession, path: str, dialect: str = "filter", glob: str = "flight_*.zip") -> DataFrame:
    """Detections straight from archives: archive, members (files in it), and the columns of read_mot.

    Only an archive's directory is read to plan; its members are dealt over tasks, and each is read from its own place. So an
    archive may be of any size, and none goes through one task."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path")  # contents are not read
    return _detections(read_members(archive_members(archives)), dialect)


MEMBER = "path string, members int, name string, offset long, packed long, method int, crc long"


def archive_members(archives: DataFrame) -> DataFrame:
    """archives (path) -> a row for each .txt file in their directories: where it begins, its packed length, its method and its check sum."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                store, at = file_system(path)
                with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    all_ = z.infolist()
                rows = [(path, len(all_), x.filename, x.header_offset, x.compress_size, x.compress_type, x.CRC) for x in all_ if x.filename.lower().endswith(".txt")]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBER.split(", ")])

    return archives.mapInPandas(listed, MEMBER)


CHUNK = 1 << 20
MEMBER_LINES = "archive string, members int, file_name string, line_no long, line string"


def _member_bytes(path: str, name: str, offset: int, packed: int, method: int, crc: int) -> Iterator[bytes]:
    """A member's bytes, some at a time."""
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"{name} of {path} is packed by method {method}")
    store, at = file_system(path)
    unpack, sum_ = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None, 0
    with store.open_input_file(at) as f:
        f.seek(offset)
        head = f.read(30)
        f.seek(offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))  # a name and further fields of their own lengths
        while packed:
            body = f.read(min(CHUNK, packed))
            if not body:
                raise ValueError(f"{name} of {path} is cut off")
            packed -= len(body)
            while body:
                out = unpack.decompress(body, 4 * CHUNK) if unpack else body
                body = unpack.unconsumed_tail if unpack else b""
                sum_ = zlib.crc32(out, sum_)
                yield out
    last = unpack.flush() if unpack else b""
    if (unpack and not unpack.eof) or zlib.crc32(last, sum_) != crc:
        raise ValueError(f"{name} of {path} is damaged")
    yield last


def _numbered(chunks: Iterator[bytes]) -> Iterator[tuple[int, list[str]]]:
    """Lines, some at a time, with the number of the first."""
    first, held = 0, b""
    for chunk in chunks:
        held += chunk
        end = held.rfind(b"\n")
        if end < 0:
            end = held.rfind(b"\r", 0, len(held) - 1)  # a last one may be half of a line's end
        if end < 0:
            continue
        whole, held = held[: end + 1].decode(), held[end + 1 :]
        lines = (re.split("\r\n|\r|\n", whole) if "\r" in whole else whole.split("\n"))[:-1]
        yield first, lines
        first += len(lines)
    yield first, re.split("\r\n|\r|\n", held.decode())


def read_members(members: DataFrame) -> DataFrame:
    """archive_members' rows with their lines: (archive, members, file_name, line_no, line), empty lines left out. A member is read by one task, which holds some lines of it at a time; its lines are then dealt over all."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                path, count, name = r.pop("path"), r.pop("members"), r.pop("name")
                for first, texts in _numbered(_member_bytes(path, name, **r)):
                    rows = pa.table({"line_no": pa.array(range(first, first + len(texts)), "int64"), "line": pa.array(texts, "string")})
                    rows = rows.filter(pc.not_equal(rows["line"], ""))
                    same = {"archive": path.rsplit("/", 1)[1], "members": count, "file_name": name.rsplit("/", 1)[-1]}
                    own = [pa.array([v] * len(rows), "int32" if c == "members" else "string") for c, v in same.items()]
                    yield from pa.table([*own, rows["line_no"], rows["line"]], [*same, "line_no", "line"]).to_batches()

    n = tasks(members.sparkSession)
    return members.repartition(n, "path", "name").mapInArrow(lines, MEMBER_LINES).repartition(n, "line_no")


def parse_archives(files: DataFrame, dialect: str = "filter") -> DataFrame:
    """files (path, content: a zip archive) as detections, of archives that are in a table; one is read whole."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = z.namelist()
                    for n in names:
                        if n.lower().endswith(".txt"):
                            yield pd.DataFrame([(path_.rsplit("/", 1)[1], len(names), n.rsplit("/", 1)[-1], z.read(n).decode())], columns=["archive", "members", "file_name", "value"])

    return _detections(_lines(files.mapInPandas(members, "archive string, members int, file_name string, value string")), dialect)


def _lines(texts: DataFrame) -> DataFrame:
    """texts (archive, members, file_name, value) by lines, as read_members has them."""
    rows = texts.select("archive", "members", "file_name", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line_no", "line"))
    return rows.where("line != ''").withColumn("line_no", F.col("line_no").cast("bigint"))


def _detections(lines: DataFrame, dialect: str) -> DataFrame:
    # the archive travels in the file's name, so that files of one name in two archives stay apart
    lines = lines.select(F.concat_ws("\t", "archive", F.col("members").cast("string"), "file_name").alias("file_name"), seq_id(F.col("file_name")).alias("seq_id"), "line_no", "line")
    det = parse_mot(lines, dialect)
    part = F.split("file_name", "\t")
    return det.select(part[0].alias("archive"), part[1].cast("int").alias("members"), part[2].alias("__name"), "*").drop("file_name").withColumnRenamed("__name", "file_name")
