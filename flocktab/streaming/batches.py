"""What the streaming jobs share: a batch's output is published once, and state between batches is a small table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Where a target keeps the numbers of its published batches, and the state after the last ones.
MARKERS, STATE = "_published", "_state"


def _fs(spark: SparkSession, folder: str):
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return Path, Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Whether there was a folder of the old name; it has the new one now."""
    Path, fs = _fs(spark, old)
    there = fs.exists(Path(old))
    if there:
        fs.mkdirs(Path(new).getParent())
        if not fs.rename(Path(old), Path(new)):
            raise OSError(f"{old} could not be renamed to {new}")
    return there


def published(spark: SparkSession, target: str) -> int | None:
    """The highest number of a published batch."""
    Path, fs = _fs(spark, target)
    return max((int(x.getPath().getName()) for x in fs.globStatus(Path(f"{target}/{MARKERS}/*")) or []), default=None)


def published_once(spark: SparkSession, target: str, publish: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: publish(batch, number), unless the target has the marker of the batch's number."""

    def run(batch: DataFrame, number: int) -> None:
        Path, fs = _fs(spark, target)
        marker = Path(f"{target}/{MARKERS}/{number}")
        if fs.exists(marker):
            return
        publish(batch, number)
        fs.mkdirs(marker.getParent())
        fs.create(marker, True).close()

    return run


def state_before(spark: SparkSession, target: str, name: str, schema) -> DataFrame:
    """The table of that name as the last published batch left it."""
    last = published(spark, target)
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{target}/{STATE}/{last}/{name}")


def write_state(target: str, name: str, number: int, table: DataFrame) -> None:
    """The table after batch `number`; an unfinished attempt's is replaced."""
    table.write.mode("overwrite").parquet(f"{target}/{STATE}/{number}/{name}")


def forget_state(spark: SparkSession, target: str, number: int) -> None:
    """Deletes the state that no batch reads any more: all before batch number - 1."""
    Path, fs = _fs(spark, target)
    for x in fs.globStatus(Path(f"{target}/{STATE}/*")) or []:
        if int(x.getPath().getName()) < number - 1:
            fs.delete(x.getPath(), True)
