"""Sharding: size-tiered compaction of immutable shards under an atomically committed, versioned manifest.

Every arrival is appended as small Parquet shards of at most `shard_rows` rows. A manifest version is a small file that
lists immutable parts, with the commit's own id; a part is a file of JSON lines, one a shard (path, bytes, rows, tier). An
append adds one part for its own shards, and a compaction writes anew only the parts that lose a shard; full lists of short
parts are folded together. The version's file is written under a new name and renamed to v<number> by the rename that fails
if that version exists: readers see the old version or the new one, and of two writers one has to try again; what it has
written goes. When the store reports a failed rename, the version is read back first: if it has this commit's id, the
rename had succeeded and only the answer was lost. This needs a store with an atomic rename. Compaction takes
a tier (shards whose size has the same power of `fanout` over the base size) that has `fanout` shards or more, packs
its files, largest first, into read partitions of about `target_bytes` and writes one shard from each; so rows are
copied without a shuffle, and a tier moves up by a factor. Replaced shards stay, for readers of older versions, until
expire() deletes what only versions beyond a grace period name.

All files go through Hadoop's file systems. A task that fails is
simply run again: Spark's committer publishes a file once, and a shard is part of the table only once a manifest names
it. The driver sees manifests only, one line a shard.

Defined results. Nulls, empty and very long texts, repeated rows and extra columns, whatever their names, are stored as
they are. An empty arrival adds no shard and still a version. An empty shard set reads as an empty table of the given schema.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A part with fewer lines is folded into the next compaction's.
PART_LINES = 1000


class ShardSet:
    """A table kept as shards under `root`."""

    def __init__(self, spark: SparkSession, root: str, shard_rows: int = 2000, base_bytes: int = 1 << 20, fanout: int = 4, target_bytes: int = 64 << 20):
        self.spark, self.root = spark, root.rstrip("/")
        self.shard_rows, self.base_bytes, self.fanout, self.target_bytes = shard_rows, base_bytes, fanout, target_bytes
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(f"{self.root}/manifest"))

    def version(self) -> int:
        """The newest committed version; 0: none."""
        return max([0, *(int(f.getPath().getName()[1:]) for f in self.fs.listStatus(self.path(f"{self.root}/manifest")) if f.getPath().getName().startswith("v"))])

    def _text(self, path: str) -> str:
        return self.jvm.org.apache.commons.io.IOUtils.toString(self.fs.open(self.path(path)), "UTF-8")

    def _write(self, path: str, text: str) -> None:
        out = self.fs.create(self.path(path), False)
        out.write(bytearray(text.encode()))
        out.close()

    def parts(self, version: int | None = None) -> list[str]:
        """Names of the parts that a version lists."""
        version = self.version() if version is None else version
        return json.loads(self._text(f"{self.root}/manifest/v{version}"))["parts"] if version else []

    def _lines(self, part: str) -> list[dict]:
        return [json.loads(x) for x in self._text(f"{self.root}/manifest/{part}").splitlines()]

    def manifest(self, version: int | None = None) -> list[dict]:
        return [x for part in self.parts(version) for x in self._lines(part)]

    def _part(self, shards: list[dict]) -> list[str]:
        """A new part of these shards; none for none."""
        if not shards:
            return []
        name = f"part-{uuid.uuid4().hex}"
        self._write(f"{self.root}/manifest/{name}", "".join(json.dumps(x) + "\n" for x in shards))
        return [name]

    def commit(self, parts: list[str], after: int) -> int:
        """Publishes version after + 1, of these parts; raises if another writer has published it."""
        own = uuid.uuid4().hex
        new, version = f"{self.root}/manifest/.{own}", f"{self.root}/manifest/v{after + 1}"
        self._write(new, json.dumps({"commit": own, "parts": parts, "at": time.time()}))
        try:
            self._rename(new, version)
        except Py4JJavaError as e:
            if self.fs.exists(self.path(version)) and json.loads(self._text(version))["commit"] == own:
                return after + 1  # only the answer was lost
            self.fs.delete(self.path(new), False)
            if self.fs.exists(self.path(version)):
                raise RuntimeError(f"version {after + 1} is committed already") from e
            raise
        return after + 1

    def _rename(self, old: str, new: str) -> None:
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: no overwriting
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(self.path(old), self.path(new), options)

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(1, size) / self.base_bytes, self.fanout)) + (size >= self.base_bytes))

    def _written(self, folder: str) -> list[dict]:
        """The data files of a finished write, with their rows."""
        sizes = {f.getPath().toString(): f.getLen() for f in self.fs.listStatus(self.path(folder)) if f.getPath().getName().endswith(".parquet")}
        if not sizes:
            return []
        rows = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n")).collect()
        count = {r["name"]: r["n"] for r in rows}
        return [{"path": p, "bytes": b, "rows": count[p.rsplit("/", 1)[1]], "tier": self.tier(b)} for p, b in sorted(sizes.items()) if count.get(p.rsplit("/", 1)[1])]

    def _publish(self, kept: list[str], shards: list[dict], folder: str, after: int) -> int:
        """commit() of kept parts and a new one; shards and part that it does not publish are deleted."""
        new = self._part(shards)
        try:
            return self.commit([*kept, *new], after)
        except RuntimeError:  # another writer's version: nothing names this one's files
            for path in [folder, *(f"{self.root}/manifest/{x}" for x in new)]:
                self.fs.delete(self.path(path), True)
            raise

    def append(self, arrivals: DataFrame) -> int:
        before = self.version()
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        arrivals.write.option("maxRecordsPerFile", self.shard_rows).parquet(folder)
        return self._publish(self.parts(before), self._written(folder), folder, before)

    def full_tiers(self, version: int | None = None) -> dict[int, list[dict]]:
        """Shards by tier, of tiers that have fanout or more below half the target size."""
        tiers: dict[int, list[dict]] = {}
        for x in self.manifest(version):
            if x["bytes"] < self.target_bytes // 2:
                tiers.setdefault(x["tier"], []).append(x)
        return {t: xs for t, xs in tiers.items() if len(xs) >= self.fanout}

    def compact(self) -> int:
        """Merges full tiers, lowest first, until none is full; the newest version."""
        while True:
            before = self.version()
            full = self.full_tiers(before)
            if not full:
                return before
            tier, old = min(full.items())
            folder = self._merge([x["path"] for x in old], min(self.target_bytes, max(self.base_bytes * self.fanout ** (tier + 1), self.fanout * max(x["bytes"] for x in old))))
            merged = self._written(folder)
            if len(merged) >= len(old):
                self.fs.delete(self.path(folder), True)
                return before  # nothing to gain, as the session pins small partitions
            gone = {x["path"] for x in old}
            kept, left = [], []
            for part in self.parts(before):
                lines = self._lines(part)
                stay = [x for x in lines if x["path"] not in gone]
                if len(stay) == len(lines) >= PART_LINES:
                    kept.append(part)  # untouched, and no short one
                else:
                    left += stay
            self._publish(kept, left + merged, folder, before)

    def expire(self, grace_seconds: float = 86_400.0) -> int:
        """Deletes the versions that were replaced longer ago than the grace period, and the shards and parts that only they name; how many shards."""
        newest = self.version()
        replaced = {v: json.loads(self._text(f"{self.root}/manifest/v{v + 1}"))["at"] for v in range(newest - 1, 0, -1) if self.fs.exists(self.path(f"{self.root}/manifest/v{v}"))}
        old = [v for v, at in replaced.items() if at <= time.time() - grace_seconds]
        live = [v for v in [newest, *replaced] if v and v not in old]
        paths = lambda versions: {x["path"] for v in versions for x in self.manifest(v)}
        parts = lambda versions: {p for v in versions for p in self.parts(v)}
        shards, lists = paths(old) - paths(live), parts(old) - parts(live)
        for v in sorted(old):
            self.fs.delete(self.path(f"{self.root}/manifest/v{v}"), False)
        for path in [*shards, *(f"{self.root}/manifest/{x}" for x in lists)]:
            self.fs.delete(self.path(path), False)
        return len(shards)

    def _merge(self, paths: list[str], size: int) -> str:
        """Writes the shards anew; Spark packs files, largest first, into partitions of this size, and each becomes one file."""
        folder, own = f"{self.root}/data/{uuid.uuid4().hex}", self.spark.newSession()  # settings of its own
        for k, v in {"maxPartitionBytes": str(size), "openCostInBytes": "0", "minPartitionNum": "1"}.items():
            own.conf.set(f"spark.sql.files.{k}", v)
        own.read.option("mergeSchema", "true").parquet(*paths).write.parquet(folder)
        return folder

    def read(self, schema=None, version: int | None = None) -> DataFrame:
        paths = [x["path"] for x in self.manifest(version)]
        if paths:
            return self.spark.read.option("mergeSchema", "true").parquet(*paths)
        return self.spark.createDataFrame([], schema)
