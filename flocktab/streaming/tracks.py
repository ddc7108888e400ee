"""Incremental twins of track_trails and of gap filling, over a stream of detections.

A batch is computed by the window operators of the batch jobs, in the JVM: its rows together with each track's edge, the last
rows before it, which is all that is kept as state. Time is event time: a sequence's clock is its highest frame so far. A row
that comes after its track has moved on, or more than `idle` frames behind the clock before its batch, is late: it is passed
on, marked, and changes nothing. A track that its sequence's
clock has left more than `idle` frames behind has ended: it goes to the side output and its edge is forgotten, so state holds
live tracks only; if it comes back it begins anew.

Output and state of a batch are written under its number and count once its marker is there, so a batch that is delivered
again after a failure is replaced or skipped, never doubled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flocktab.operators.tracks import BOX, LINEAR, TRACK, filled, track_trails

from .batches import forget_state, published_once, state_before, write_state

ORDER = ["frame", "line_no"]
CLOCKS = "seq_id string, clock bigint"


AFTER_EDGES = ["__new", *ORDER]


def _after_edges() -> WindowSpec:
    """A batch's rows after the edges of their tracks, so what was kept of a track is known at each of its rows."""
    return Window.partitionBy(*TRACK).orderBy(*AFTER_EDGES)


def _last(rows: DataFrame, n: int, newest: list) -> DataFrame:
    """Each track's first n rows in the order `newest`."""
    w = Window.partitionBy(*TRACK).orderBy(*newest)
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def _stream(det: DataFrame, target: str, checkpoint: str, columns: list[str], depth: int, newest: list, idle: int | None, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]], once: bool) -> StreamingQuery:
    """step(rows) -> output rows, and the rows that edges are taken from, a track's first ones in the order `newest`. rows are the batch's and, not __new, the edges; they have
    __last, their track's last frame before the batch, and __behind: too far behind the clock."""
    spark, edge = det.sparkSession, det.select(*columns).schema

    def publish(batch: DataFrame, number: int) -> None:
        edges, clocks = state_before(spark, target, "edges", edge), state_before(spark, target, "clocks", CLOCKS)
        behind = F.lit(False) if idle is None else F.coalesce(F.col("clock") - F.col("frame") > idle, F.lit(False))
        new = (batch if idle is None else batch.join(clocks, "seq_id", "left")).withColumns({"__behind": behind, "__new": F.lit(True)}).drop("clock")
        rows = new.unionByName(edges.withColumns({"__behind": F.lit(False), "__new": F.lit(False)}), allowMissingColumns=True)
        last = F.max(F.when(~F.col("__new"), F.col("frame"))).over(_after_edges().rowsBetween(Window.unboundedPreceding, 0))
        out, rows = step(rows.withColumn("__last", last))
        out.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        if idle is not None:
            clocks = clocks.unionByName(batch.groupBy("seq_id").agg(F.max("frame").alias("clock"))).groupBy("seq_id").agg(F.max("clock").alias("clock"))
            write_state(target, "clocks", number, clocks)
            clocks = state_at(number, "clocks", CLOCKS)
        else:
            write_state(target, "clocks", number, clocks)
        kept = _last(rows.select(*columns, "__new"), depth, newest).drop("__new")
        if idle is not None:
            last = kept.groupBy(*TRACK).agg(F.max("frame").alias("last_frame")).join(clocks, "seq_id")
            ended = last.where(F.col("clock") - F.col("last_frame") > idle).select(*TRACK, "last_frame")
            ended.write.mode("overwrite").parquet(f"{target}/ended/batch={number}")
            kept = kept.join(spark.read.schema(ended.schema).parquet(f"{target}/ended/batch={number}"), TRACK, "left_anti")
        write_state(target, "edges", number, kept)
        forget_state(spark, target, number)

    def state_at(number: int, name: str, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{target}/_state/{number}/{name}")

    made = det.writeStream.foreachBatch(published_once(spark, target, publish)).option("checkpointLocation", checkpoint)
    return (made.trigger(availableNow=True) if once else made).start()


def stream_trails(det: DataFrame, target: str, checkpoint: str, n: int, idle: int | None = None, once: bool = True) -> StreamingQuery:
    """track_trails of a stream, into target/rows: det with trail, shown and late; of a late row the trail is null. Ended tracks go to target/ended."""

    def step(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        late = F.col("__new") & (F.coalesce(F.col("frame") < F.col("__last"), F.lit(False)) | F.col("__behind"))
        marked = rows.withColumn("late", late)
        made = track_trails(marked, n, apart=("late",)).where("__new")
        made = made.withColumns({"trail": F.when(~F.col("late"), F.col("trail")), "shown": F.col("shown") & ~F.col("late")})
        return made.select(*det.columns, "trail", "shown", "late"), marked.where(~F.col("late"))

    return _stream(det, target, checkpoint, [*TRACK, *ORDER, *BOX], n, [F.desc(c) for c in ORDER], idle, step, once)


def stream_gap_fill(det: DataFrame, target: str, checkpoint: str, step: int = 1, idle: int | None = None, once: bool = True) -> StreamingQuery:
    """interpolate_tracks of a stream, into target/rows: det and the rows between key frames, with late. A gap is filled when the next key
    frame arrives; a row at or before its track's last key frame is late, and no gap is filled for it. Ended tracks go to target/ended."""
    columns = det.columns

    def fill(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        before = lambda c, *default: F.lag(c, 1, *default).over(_after_edges())
        again = before("__new", False) & before("frame").eqNullSafe(F.col("frame"))  # of rows of one frame the first is the key frame
        late = F.col("__new") & (F.coalesce(F.col("frame") <= F.col("__last"), F.lit(False)) | F.col("__behind") | again)
        marked = rows.withColumn("late", late).withColumn("__key", F.when(~F.col("late") & F.col("frame").isNotNull(), F.struct("frame", *BOX, *LINEAR)))
        nxt = F.expr(f"lead(__key) IGNORE NULLS OVER (PARTITION BY {', '.join(TRACK)} ORDER BY {', '.join(AFTER_EDGES)})")
        seg = marked.withColumn("nxt", F.when(~F.col("late"), nxt))
        out = filled(seg, [*columns, "late"], step, F.col("__new"))  # an edge has been passed on before
        return out, rows.where(~F.col("__behind"))

    # a track's last key frame is found without knowing which rows are late: the edge, or the first row of a higher frame
    return _stream(det, target, checkpoint, columns, 1, [F.desc("frame"), F.col("__new"), F.col("line_no")], idle, fill, once)
