"""Streams of detections against the batch operators: arrivals, restarts, late rows, ended tracks, and how little state is kept."""

import os

import pytest
from pyspark.sql import functions as F

from flocktab.operators import tracks as T
from flocktab.plans import registry, stream_queries
from flocktab.streaming import batches as B
from flocktab.streaming import tracks as X

DET = "seq_id string, line_no long, frame long, track_id long, bb_left int, bb_top int, bb_width int, bb_height int, conf double, class_id int, visibility double, species string, gender string, age string, is_propagated string"


def rows(spark, at):
    """at: (sequence, frame, track) in order of arrival."""
    return spark.createDataFrame([(s, k, f, t, f % 97, (f * 7) % 89, 10 + f % 5, 20, 0.5, 3, 1.0, "deer", "1", "2", "0") for k, (s, f, t) in enumerate(at)], DET).coalesce(1)


def arrive(spark, tmp_path, parts, run):
    """Each part arrives and is run; what the runs wrote."""
    for part in parts:
        part.write.mode("append").parquet(f"{tmp_path}/in")
        run(spark.readStream.schema(DET).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out/rows").drop("batch")


MANY = [("a" if k % 3 else "b", 7 * k // 4, k % 5) for k in range(400)]


def same(a, b):
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_trails_and_gaps_equal_the_batch(spark, tmp_path):
    whole = rows(spark, MANY)
    parts = [whole.where(F.floor(F.col("frame") / 180) == k) for k in range(4)]
    got = arrive(spark, tmp_path / "t", parts, lambda s, o, c: X.stream_trails(s, o, c, 5))
    same(got.where("not late").drop("late"), T.track_trails(whole, 5).select(*got.drop("late").columns))
    assert got.where("late").isEmpty()
    got = arrive(spark, tmp_path / "g", parts, lambda s, o, c: X.stream_gap_fill(s, o, c, 2))
    same(got.drop("late"), T.interpolate_tracks(whole, 2).select(*got.drop("late").columns))


def test_late_rows_are_marked_and_change_nothing(spark, tmp_path):
    first, second = rows(spark, [("a", 10, 1), ("a", 20, 1), ("a", 5, 2)]), rows(spark, [("a", 15, 1), ("a", 26, 1), ("a", 5, 2), ("a", 9, 2)])
    got = {(r["frame"], r["track_id"], r["late"]): r["trail"] for r in arrive(spark, tmp_path / "t", [first, second], lambda s, o, c: X.stream_trails(s, o, c, 3)).collect()}
    assert got[15, 1, True] is None and len(got[26, 1, False]) == 3 and (5, 2, True) not in got  # a row of the same frame is no late one for a trail
    filled = arrive(spark, tmp_path / "g", [first, second], lambda s, o, c: X.stream_gap_fill(s, o, c, 1))
    assert sorted((r["track_id"], r["frame"]) for r in filled.where("late").collect()) == [(1, 15), (2, 5)]
    assert sorted(r["frame"] for r in filled.where("track_id = 1 and not late").collect()) == [*range(10, 27)]
    assert filled.where("track_id = 2 and not late").count() == 5


@pytest.mark.parametrize("stream", [lambda s, o, c: X.stream_trails(s, o, c, 4, idle=50), lambda s, o, c: X.stream_gap_fill(s, o, c, 1, idle=50)])
def test_ended_tracks_are_emitted_and_forgotten(spark, tmp_path, stream):
    parts = [[("a", 0, 1), ("a", 3, 2), ("b", 2, 1)], [("a", 40, 2)], [("a", 80, 2), ("a", 81, 3), ("a", 20, 1)], [("a", 82, 2), ("a", 84, 1)]]
    arrive(spark, tmp_path, [rows(spark, p) for p in parts], stream)
    ended = spark.read.parquet(f"{tmp_path}/out/ended")
    assert [tuple(r) for r in ended.select("seq_id", "track_id", "last_frame", "batch").collect()] in ([("a", 1, 20, 2)], [("a", 1, 0, 2)])
    out = spark.read.parquet(f"{tmp_path}/out/rows")
    back = out.where("seq_id = 'a' and track_id = 1 and frame = 84").collect()
    assert len(back) == 1 and not back[0]["late"]
    assert out.where("seq_id = 'a' and track_id = 1 and frame > 20").count() == 1  # it begins anew: nothing is filled up to it
    state = spark.read.parquet(f"{tmp_path}/out/{B.STATE}/3/edges")
    assert {(r["seq_id"], r["track_id"]) for r in state.collect()} == {("a", 1), ("a", 2), ("a", 3), ("b", 1)}  # b's own clock stands still
    assert sorted(os.listdir(f"{tmp_path}/out/{B.STATE}")) == ["2", "3"]
    before = spark.read.parquet(f"{tmp_path}/out/{B.STATE}/2/edges")
    assert before.where("seq_id = 'a' and track_id = 1").isEmpty()


def test_rows_behind_the_clock_are_late(spark, tmp_path):
    parts = [rows(spark, [("a", 100, 1)]), rows(spark, [("a", 30, 2), ("a", 60, 3)])]
    got = arrive(spark, tmp_path, parts, lambda s, o, c: X.stream_gap_fill(s, o, c, 1, idle=50))
    assert {r["track_id"]: r["late"] for r in got.collect()} == {1: False, 2: True, 3: False}


def test_state_is_edges_only(spark, tmp_path):
    whole = rows(spark, MANY)
    arrive(spark, tmp_path, [whole], lambda s, o, c: X.stream_trails(s, o, c, 5))
    tracks = whole.select("seq_id", "track_id").distinct().count()
    assert spark.read.parquet(f"{tmp_path}/out/{B.STATE}/0/edges").count() == 5 * tracks


def test_a_batch_that_dies_is_computed_again(spark, tmp_path, monkeypatch):
    """Its rows and state were written, its marker was not: the run after it replaces them."""
    whole = rows(spark, MANY)
    parts = [whole.where("frame < 300"), whole.where("frame >= 300")]
    run = lambda s, o, c: X.stream_gap_fill(s, o, c, 2)
    arrive(spark, tmp_path, parts[:1], run)
    once = X.published_once

    def dying(spark, target, publish):
        def f(batch, number):
            publish(batch, number)
            raise RuntimeError("the driver is lost")

        return f

    monkeypatch.setattr(X, "published_once", dying)
    with pytest.raises(Exception, match="lost"):
        arrive(spark, tmp_path, parts[1:], run)
    monkeypatch.setattr(X, "published_once", once)
    got = arrive(spark, tmp_path, [whole.limit(0)], run)
    same(got.drop("late"), T.interpolate_tracks(whole, 2).select(*got.drop("late").columns))


def test_a_batch_is_read_and_shuffled_once(spark, tmp_path, monkeypatch):
    whole, outs, fill = rows(spark, MANY), [], X.filled
    monkeypatch.setattr(X, "filled", lambda *a: outs.append(fill(*a)) or outs[-1])
    arrive(spark, tmp_path, [whole.where("frame < 300"), whole.where("frame >= 300")], lambda s, o, c: X.stream_gap_fill(s, o, c, 2))
    plan = outs[1]._jdf.queryExecution().sparkPlan().toString() + outs[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "Join" not in plan


def test_rows_without_a_frame_or_a_track(spark, tmp_path):
    first, second = rows(spark, [("a", 10, 1), ("a", 10, None)]), rows(spark, [("a", 13, 1), ("a", 4, None), ("a", 12, None)])
    lost = rows(spark, [("a", 11, 1)]).withColumn("frame", F.lit(None).cast("long"))
    got = arrive(spark, tmp_path, [first, second.unionByName(lost)], lambda s, o, c: X.stream_gap_fill(s, o, c, 1))
    assert sorted(r["frame"] for r in got.where("track_id = 1 and frame is not null").collect()) == [10, 11, 12, 13] and got.where("frame is null and not late").count() == 1
    assert sorted((r["frame"], r["late"]) for r in got.where("track_id is null").collect()) == [(4, True), (10, False), (11, False), (12, False)]


def test_a_replay_keeps_events_without_a_time_and_has_small_files(spark, sf_dir, tmp_path, monkeypatch):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.withColumn("ts", F.when(F.col("event_id") != 7, F.col("ts"))).where("ts is null or day(ts) > 8").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")  # the first part has that row alone
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 10)
    monkeypatch.setattr(stream_queries, "shared_folder", lambda spark: str(tmp_path))
    got = registry.QUERIES["x2_stream_gap_fill"](spark, str(tmp_path))
    assert got.where("frame is null").count() == 1 and got.where("is_propagated = '0'").count() == spark.read.parquet(f"{tmp_path}/events.parquet").count()
    assert max(r["count"] for r in spark.read.parquet(f"{tmp_path}/stream-*/in/*").groupBy(F.input_file_name()).count().collect()) == 10
