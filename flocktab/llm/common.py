"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

#: The characters that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a new one under /tmp only where it is unset and the session is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            return jsc.getCheckpointDir().get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor does not bring its lineage back."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written in the shared folder, by name, and read back: they cut lineage as checkpoints do, and can be deleted once what was made of them is written too."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        Path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = Path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for name in names:
            fs.delete(Path(f"{self.folder}/{name}"), True)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has so many rows at most; no more than these are counted."""
    return df.limit(rows + 1).count() <= rows


def join_skewed(left: DataFrame, right: DataFrame, on: str, total: int, n: str = "n") -> DataFrame:
    """Inner join of left with right, which has one row a key and in n how many rows of left have it; total: rows of left, or half of them at least.

    Keys that more than a thousandth of `total` rows have are fewer than two thousand: they are broadcast, so that no task
    gets all rows of one; the others are shuffled.
    """
    heavy = F.broadcast(right.where(F.col(n) > total / 1000))
    light = left.join(heavy.select(on), on, "left_anti").join(right.where(F.col(n) <= total / 1000), on)
    return light.unionByName(left.join(heavy, on)).drop(n)


def row_digest(df: DataFrame) -> Column:
    """128 bits of a row: two rows have the same digest if all their columns are the same."""
    parts = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    parts += [F.col(f"`{c}`").isNull() for c in df.columns]  # a null alone would leave the hash as it is
    return F.struct(F.xxhash64(F.lit(0), *parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most this many rows for the session: texts can be long, and a worker holds a batch several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are. Plain ASCII texts take Spark's byte-wise lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)
