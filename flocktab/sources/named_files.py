"""A sink for files that have their own names: rows of (name, line), all lines of a file in one partition and in order; bytes are written as they are.

Tasks write: each attempt streams its files into a folder of its own and, once all are whole, moves them into place itself. For a
target that does not exist yet that place is a hidden folder beside it, which one rename publishes when the job commits, so the
target has all files or is not there. In a target that exists, each file appears or is replaced whole as its task ends; a job
that fails there may leave some of them, never half of one, and running it again gives the same files. Attempts that fail, and
attempts that a speculative copy has outrun, leave nothing: the job's hidden folder is deleted when it commits or aborts.
"""

from __future__ import annotations

import fnmatch
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "named_text"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI, and the path there."""
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def exists(store: pafs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != pafs.FileType.NotFound


@dataclass
class Written(WriterCommitMessage):
    files: int


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Buffer | None]]:
    """Names of a batch as they follow each other, and the bytes of each one's lines that are not null, or none."""
    names, lines = batch.column(0), batch.column(1)
    new = pc.indices_nonzero(pc.fill_null(pc.not_equal(names[1:], names[:-1]), True)).to_pylist() if len(names) > 1 else []
    starts = [0, *[k + 1 for k in new], len(names)]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            held = lines[a:b].drop_null().cast("large_binary")
            ends = memoryview(held.buffers()[1]).cast("q")[held.offset : held.offset + len(held) + 1] if len(held) else (0,)
            yield names[a].as_py(), held.buffers()[2].slice(ends[0], ends[-1] - ends[0]) if ends[-1] > ends[0] else None


class _Archive:
    """A zip archive that is written as it comes, a member after another; none is held whole."""

    def __init__(self, out: pa.NativeFile):
        self.out, self.member = out, None
        self.zip = zipfile.ZipFile(self, "w", zipfile.ZIP_DEFLATED)

    def begin(self, member: str) -> None:
        if self.member:
            self.member.close()
        self.member = self.zip.open(member, "w", force_zip64=True)

    def write(self, data: bytes) -> int:  # by the archive itself
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        pass

    def close(self) -> None:
        if self.member:
            self.member.close()
        self.zip.close()


class NamedTextWriter(DataSourceArrowWriter):
    def __init__(self, path: str, folders: bool = False, zipped: bool = False, blank: str | None = None):
        self.path, self.folders, self.zipped, self.blank = path.rstrip("/"), folders, zipped, blank
        store, self.target = file_system(self.path)
        self.new = not exists(store, self.target)
        parent, _, base = self.target.rpartition("/")
        self.hidden = f"{parent}/.{base}-{uuid.uuid4().hex}"
        self.place = f"{self.hidden}/files" if self.new else self.target

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _ = file_system(self.path)
        task = TaskContext.get()
        own = f"{self.hidden}/attempt-{task.partitionId()}-{task.taskAttemptId()}"
        names, name, out, archive, inside, written = [], None, None, None, None, False

        def end() -> None:
            if archive:
                archive.close()
            elif out and not written and self.blank is not None:
                out.write(f"{self.blank}\n".encode())

        try:
            for batch in iterator:
                for new, lines in _runs(batch):
                    new, member = new.split("\t") if self.zipped else (new, None)
                    if new != name:
                        end()
                        if out:
                            out.close()
                        if not new or "/" in new or new in (".", ".."):
                            raise ValueError(f"{new!r} is no file name")
                        if not names:
                            store.create_dir(own, recursive=True)
                        name, out = new, store.open_output_stream(f"{own}/{new}")
                        names.append(new)
                        archive, inside, written = _Archive(out) if self.zipped else None, None, False
                    if member != inside:
                        archive.begin(member)
                        inside = member
                    if lines is not None:
                        (archive.member if archive else out).write(lines)
                        written = True
            end()
        finally:
            if out:
                out.close()
        if len(set(names)) < len(names):
            raise ValueError("lines of a file do not stand together")
        place = f"{self.place}/{task.partitionId():05d}" if self.folders else self.place
        if names:
            store.create_dir(place, recursive=True)
        for x in names:
            store.move(f"{own}/{x}", f"{place}/{x}")
        return Written(len(names))

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = file_system(self.path)
        if self.new:
            store.create_dir(self.place, recursive=True)  # a job without a row makes an empty folder
            store.move(self.place, self.target)
        self._clear(store)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(file_system(self.path)[0])

    def _clear(self, store: pafs.FileSystem) -> None:
        if exists(store, self.hidden):
            store.delete_dir(self.hidden)


class NamedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, line string"

    def writer(self, schema, overwrite: bool) -> NamedTextWriter:
        return NamedTextWriter(self.options["path"], self.options.get("folders") == "true", self.options.get("zipped") == "true", self.options.get("blank"))


def tasks(spark: SparkSession) -> int:
    """Tasks that files are dealt over. Given as a number, as Spark would else join small rows by their bytes, and one task would write or read very many files."""
    return 2 * spark.sparkContext.defaultParallelism


def _ended(rows: DataFrame, line: str) -> Column:
    """Lines with their ends, as they are written; bytes are written as they are."""
    return (F.col(line) if dict(rows.dtypes)[line] == "binary" else F.concat(F.col(line), F.lit("\n"))).alias("line")


def write_named(rows: DataFrame, path: str, name: str, line: str, order: tuple[str, ...] = (), folders: bool = False, blank: str | None = None) -> None:
    """Writes a text file for each name, its lines in order; a null is no line, so a name with nulls alone is an empty file, or one of the line `blank`. A file's lines are one task's; files are spread by name. folders: in a subfolder a task, so that very many files can be listed by many tasks."""
    rows.sparkSession.dataSource.register(NamedText)
    dealt = rows.repartition(tasks(rows.sparkSession), name).sortWithinPartitions(name, *order)
    to = dealt.select(F.col(name).alias("name"), _ended(rows, line)).write.format(FORMAT).mode("append").option("folders", folders)
    (to if blank is None else to.option("blank", blank)).save(path)


def write_archives(rows: DataFrame, path: str, name: str, member: str, line: str, order: tuple[str, ...] = ()) -> None:
    """Writes a zip archive for each name, of text files by the name of a member, their lines in order. An archive is one task's, which holds some lines of it at a time."""
    rows.sparkSession.dataSource.register(NamedText)
    dealt = rows.repartition(tasks(rows.sparkSession), name).sortWithinPartitions(name, member, *order)
    dealt.select(F.concat_ws("\t", name, member).alias("name"), _ended(rows, line)).write.format(FORMAT).mode("append").option("zipped", True).save(path)


LISTED = "path string, length long, folder boolean"


def listed(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """(path, file_name, length) of the files of a folder, or of one file, as Spark's sources see them: none that is hidden or empty. Tasks list, the driver has no name; with recursive subfolders are dealt over tasks."""

    def entries(deep: bool):
        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for root in batch.column(0).to_pylist():
                    store, at = file_system(root)
                    head = root[: -len(at)] if root.endswith(at) else ""
                    info = store.get_file_info(at)
                    found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(at, recursive=deep))
                    for k in range(0, len(found), 10_000):
                        part = [x for x in found[k : k + 10_000] if not any(p[:1] in ("_", ".") for p in x.path[len(at) :].split("/"))]
                        yield pa.RecordBatch.from_arrays([pa.array([head + x.path for x in part], "string"), pa.array([x.size or 0 for x in part], "int64"), pa.array([x.type == pafs.FileType.Directory for x in part], "bool")], ["path", "length", "folder"])

        return made

    top = spark.createDataFrame([(path.rstrip("/"),)], "path string").mapInArrow(entries(False), LISTED)
    files = top.where("not folder")
    if recursive:
        files = files.unionByName(top.where("folder").select("path").repartition(tasks(spark), "path").mapInArrow(entries(True), LISTED).where("not folder"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.where("length > 0").select("path", name.alias("file_name"), "length").where(name.rlike(fnmatch.translate(glob)))


def texts(files: DataFrame) -> DataFrame:
    """(file_name, value): the whole texts of listed files, many small ones a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values, size = [], [], 0
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                values.append(text(path))
                size += len(values[-1])
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(names, "string"), pa.array(values, "string")], ["file_name", "value"])
                    names, values, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, "string"), pa.array(values, "string")], ["file_name", "value"])

    return files.select("path", "file_name").repartition(tasks(files.sparkSession), "path").mapInArrow(read, "file_name string, value string")


def text(path: str) -> str:
    store, at = file_system(path)
    with store.open_input_stream(at, compression=None) as f:
        return f.read().decode(errors="replace")
