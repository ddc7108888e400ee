"""The streaming operators over the events table, replayed as a stream until it is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flocktab.operators import tracks as T
from flocktab.streaming import tracks as X
from flocktab.streaming.batches import rename

from .annotation_queries import DET, TRAIL_SQL, trail_text
from .registry import query, shared_folder

#: The frames at which the arrivals of a replay end; the last one has all that follow.
ENDS = (180, 360, 540)

#: Rows a file of a replay: in a table ordered by time few tasks write all of a part, and Spark can't split what they write.
FILE_ROWS = 100_000


def replay(t, run) -> DataFrame:
    """The detections as a stream: they arrive in four parts, by frame, each a run(stream, target, checkpoint) that goes on from the state of the one before; the rows that it writes are read back."""
    spark, folder, det = t.spark, f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}", t.detections
    part = F.coalesce(sum((F.col("frame") >= end).cast("int") for end in ENDS), F.lit(0))
    det.withColumn("part", part).write.partitionBy("part").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/made")
    for k in range(len(ENDS) + 1):
        if not rename(spark, f"{folder}/made/part={k}", f"{folder}/in/{k}"):  # a part without rows has no folder
            spark.createDataFrame([], det.schema).write.parquet(f"{folder}/in/{k}")
        run(spark.readStream.schema(det.schema).parquet(f"{folder}/in/*"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out/rows")


TRAILS = f"SELECT line_no, {TRAIL_SQL}, count(*) OVER w > 1 AS shown, false AS late FROM detections WINDOW w AS (PARTITION BY seq_id, track_id ORDER BY frame, line_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query(TRAILS, DET)
def x1_stream_trails(t):
    made = replay(t, lambda det, target, state: X.stream_trails(det, target, state, 5))
    return made.select("line_no", *trail_text(), "shown", "late")


GAPS = """, k AS (SELECT *, row_number() OVER (PARTITION BY seq_id, track_id, frame ORDER BY line_no) > 1 AS late FROM detections),
s AS (SELECT *, lead(frame) OVER w AS f1, lead(bb_left) OVER w AS l1, lead(bb_top) OVER w AS t1, lead(bb_width) OVER w AS w1, lead(bb_height) OVER w AS h1, lead(conf) OVER w AS c1, lead(visibility) OVER w AS v1 FROM k WHERE NOT late WINDOW w AS (PARTITION BY seq_id, track_id ORDER BY frame)),
g AS (SELECT *, unnest(range(frame + 2, f1, 2)) AS gf FROM s WHERE f1 - frame > 2)
SELECT seq_id, track_id, frame, bb_left, bb_top, bb_width, bb_height, conf, visibility, class_id, species, gender, age, is_propagated, late FROM k
UNION ALL SELECT seq_id, track_id, gf, CAST(round_even(bb_left + (l1 - bb_left) * ((gf - frame) / (f1 - frame)), 0) AS INT), CAST(round_even(bb_top + (t1 - bb_top) * ((gf - frame) / (f1 - frame)), 0) AS INT), CAST(round_even(bb_width + (w1 - bb_width) * ((gf - frame) / (f1 - frame)), 0) AS INT), CAST(round_even(bb_height + (h1 - bb_height) * ((gf - frame) / (f1 - frame)), 0) AS INT),
 conf + (c1 - conf) * ((gf - frame) / (f1 - frame)), visibility + (v1 - visibility) * ((gf - frame) / (f1 - frame)), class_id, species, gender, age, '1', false FROM g"""


@query(GAPS, DET)
def x2_stream_gap_fill(t):
    return replay(t, lambda det, target, state: X.stream_gap_fill(det, target, state, 2)).select("seq_id", "track_id", "frame", *T.BOX, *T.LINEAR, "class_id", "species", "gender", "age", "is_propagated", "late")
