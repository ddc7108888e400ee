"""All registered queries of the domain's operators, and their SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The adapters' tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return adapters.flights(self.spark, self.sf_dir) if name == "full_flights" else adapters.load(self.spark, self.sf_dir, name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a new one under /tmp only where it is unset and the session is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-")


def query(sql: str | None = None, needs: tuple[str, ...] = (), recursive: bool = False):
    """Registers f(tables) under its name; sql follows a WITH clause of the adapters it needs, and may begin with a comma to add to it."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = (adapters.ctes(*needs) + "\n" if needs else "") + sql
        return f

    return add


from . import annotation_queries, file_queries, geo_queries, release_queries, stream_queries  # noqa: E402, F401  they register themselves
