"""Files under their own names: what a job, a failing job, a second run and a stream leave behind."""

import os

import pytest
from pyspark.sql import functions as F

from flocktab.plans import jobs
from flocktab.sources import readers as R
from flocktab.sources.named_files import write_named
from flocktab.streaming import annotations as X
from flocktab.streaming.batches import MARKERS, published_once


def texts(folder):
    return {n: open(f"{folder}/{n}", newline="").read() for n in sorted(os.listdir(folder)) if not n.startswith((".", "_"))}


def rows(spark, files):
    return spark.createDataFrame([(n, k, line) for n, lines in files.items() for k, line in enumerate(lines)], "name string, k int, line string")


FILES = {f"f{n}.txt": [f"{n} {k} ä" for k in range(n)] for n in range(1, 30)} | {"empty.txt": [None], "blank.txt": [""], "a b=c%.txt": ["x"]}
WANT = {n: "".join(f"{line}\n" for line in lines if line is not None) for n, lines in FILES.items()}


def test_files_have_their_names_and_order(spark, tmp_path):
    write_named(rows(spark, FILES), f"{tmp_path}/out", "name", "line", ("k",))
    assert texts(f"{tmp_path}/out") == dict(sorted(WANT.items())) and sorted(os.listdir(tmp_path)) == ["out"]
    # a second run replaces files whole and leaves others
    write_named(rows(spark, {"f1.txt": ["new"], "more.txt": ["m"]}), f"file://{tmp_path}/out", "name", "line", ("k",))
    assert texts(f"{tmp_path}/out") == dict(sorted((WANT | {"f1.txt": "new\n", "more.txt": "m\n"}).items())) and sorted(os.listdir(tmp_path)) == ["out"]
    write_named(rows(spark, {"x": ["x"]}).limit(0), f"{tmp_path}/none", "name", "line")
    assert texts(f"{tmp_path}/none") == {}


def test_a_failing_job_leaves_no_half_file(spark, tmp_path):
    bad = rows(spark, FILES).withColumn("line", F.when((F.col("name") == "f29.txt") & (F.col("k") == 28), F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        write_named(bad, f"{tmp_path}/out", "name", "line", ("k",))
    assert os.listdir(tmp_path) == []  # neither the target nor what attempts wrote
    write_named(rows(spark, {"old.txt": ["old"], "f29.txt": ["old"]}), f"{tmp_path}/out", "name", "line", ("k",))
    with pytest.raises(Exception, match="lost"):
        write_named(bad, f"{tmp_path}/out", "name", "line", ("k",))
    left = texts(f"{tmp_path}/out")
    assert sorted(os.listdir(tmp_path)) == ["out"] and left["old.txt"] == "old\n" and left["f29.txt"] == "old\n"
    assert all(left[n] in (WANT[n], "old\n") for n in left if n != "old.txt")


@pytest.mark.parametrize("name", ["../out.txt", "a/b", "..", ""])
def test_names_stay_in_the_folder(spark, tmp_path, name):
    with pytest.raises(Exception, match="is no file name"):
        write_named(rows(spark, {name: ["x"]}), f"{tmp_path}/in/out", "name", "line")
    assert os.listdir(tmp_path) in ([], ["in"])


LINE = "{f},{t},10,20,{w},40,0.5,3,1.00,Cervus elaphus (Red deer),{g},2,0"


def annotations(folder, names):
    for n in names:
        with open(f"{folder}/{n}_gt.txt", "w") as f:
            f.writelines(LINE.format(f=k, t=k % 3, w=10 + k, g=k % 3) + "\n" for k in range(n))


def test_a_stream_gives_the_files_of_the_batch_job(spark, tmp_path):
    """Three arrivals, a run for each, and a batch that dies after its files were written."""
    for d in ("in", "all"):
        os.mkdir(f"{tmp_path}/{d}")
    filters = {"gender": ["Male"], "min_width": 15, "strict": True}
    run = lambda: X.filter_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", "_part", files_a_batch=2, **filters).awaitTermination()
    annotations(f"{tmp_path}/in", (1, 2, 30))
    run()
    first = texts(f"{tmp_path}/out")
    annotations(f"{tmp_path}/in", (9, 14))
    died = X.published_once

    def dying(spark, target, publish):
        def run(batch, number):
            publish(batch, number)
            raise RuntimeError("the driver is lost")

        return run

    X.published_once = dying
    try:
        with pytest.raises(Exception, match="lost"):
            run()
    finally:
        X.published_once = died
    run()  # the same batch again
    annotations(f"{tmp_path}/in", (25,))
    run()
    run()  # nothing new
    annotations(f"{tmp_path}/all", (1, 2, 30, 9, 14, 25))
    jobs.filter_files(spark, f"{tmp_path}/all", f"{tmp_path}/want", "_part", **filters)
    assert texts(f"{tmp_path}/out") == texts(f"{tmp_path}/want") and len(first) == 3 and first["1_gt_part.txt"] == "\n"
    assert sorted(n for n in os.listdir(f"{tmp_path}/out/{MARKERS}") if n[0] != ".") == ["0", "1", "2", "3"] and not [n for n in os.listdir(tmp_path) if n.startswith(".out")]


def test_a_published_batch_is_not_published_again(spark, tmp_path):
    made = []
    once = published_once(spark, f"{tmp_path}/out", lambda batch, number: made.append(batch))
    for number in (0, 1, 0, 1, 2):
        once(number, number)
    assert made == [0, 1, 2]


def test_labels_of_a_stream(spark, tmp_path):
    for d in ("in", "all"):
        os.mkdir(f"{tmp_path}/{d}")
        annotations(f"{tmp_path}/{d}", (4, 7))
    X.label_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", 640, 512, ["class_id"], files_a_batch=1).awaitTermination()
    jobs.label_files(spark, f"{tmp_path}/all", f"{tmp_path}/want", 640, 512, ["class_id"])
    assert texts(f"{tmp_path}/out") == texts(f"{tmp_path}/want") and len(texts(f"{tmp_path}/want")) == 11
    det = X.stream_mot(spark, f"{tmp_path}/in")
    assert det.isStreaming and det.schema == R.read_mot(spark, f"{tmp_path}/in").schema


def test_ground_truth_of_every_file(spark, tmp_path):
    """By the name of a sex, of two files of one id the last, empty ones too, .csv and .txt; files without an id are left out."""
    os.mkdir(f"{tmp_path}/in")
    annotations(f"{tmp_path}/in", (1, 7))
    for n, lines in (("7_a.csv", 4), ("8_x.csv", 5), ("plain.txt", 3)):
        with open(f"{tmp_path}/in/{n}", "w") as f:
            f.writelines(LINE.format(f=k, t=1, w=9, g=1) + "\n" for k in range(lines))
    got = jobs.ground_truth_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", gender=["Male"])
    assert {r["seq_id"]: r["rows"] for r in got.collect()} == {"1_gt.txt": 0, "7_gt.txt": 2, "8_gt.txt": 5}
    made = texts(f"{tmp_path}/out")
    assert list(made) == ["1_gt.txt", "7_gt.txt", "8_gt.txt"] and made["1_gt.txt"] == "" and made["7_gt.txt"].count("\n") == 2


def test_skipped_metadata_is_listed(spark, tmp_path):
    with open(f"{tmp_path}/1_metadata.json", "w") as f:
        f.write('{"flight_key": "1", "frame_count": 3}')
    with open(f"{tmp_path}/2_metadata.json", "w") as f:
        f.write('{"flight_key": "2", ')
    assert [r["flight_key"] for r in R.read_flight_metadata(spark, str(tmp_path)).collect()] == ["1"]
    assert [r["file_name"] for r in R.unreadable_flight_metadata(spark, str(tmp_path)).collect()] == ["2_metadata.json"]


def test_a_filter_job_parses_its_input_once(spark, tmp_path, monkeypatch):
    """neither empty files nor counts parse the annotations anew, lines of a file that is not the last of its id are not parsed, and a line is taken apart once."""
    os.mkdir(f"{tmp_path}/in")
    annotations(f"{tmp_path}/in", (3, 7))
    with open(f"{tmp_path}/in/7_early.txt", "w") as f:
        f.write("no number," * 12 + "0\n")
    plans, written = [], jobs.write_mot
    monkeypatch.setattr(jobs, "write_mot", lambda det, *a, **k: (plans.append(det._jdf.queryExecution().optimizedPlan().toString()), written(det, *a, **k)))
    made = jobs.ground_truth_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", gender=["Male"], class_id=[3])
    assert {r["seq_id"]: r["rows"] for r in made.collect()} == {"3_gt.txt": 1, "7_gt.txt": 2}
    assert plans[0].count("from_csv") == 1 and "from_csv" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_quoted_lines_and_plain_ones_are_parsed_alike(spark, tmp_path):
    """lines without quotes do not go through the csv parser."""
    odd = ["1,2,3", ' 5, 6 ,7,8,9,10,"0.5",1,\t1.0,"A, ""B""",x y,2,0,more', "5,6,7,8,9,10,0.5,1,1.0, A ,,,", ",,,,,,,,,,,,"]
    lines = spark.createDataFrame([("a", "a", k, x) for k, x in enumerate(odd)], "file_name string, seq_id string, line_no long, line string")
    for dialect in ("filter", "frames", "yolo"):
        plain, quoted = [[tuple(r) for r in R.parse_mot(lines.withColumn("line", x), dialect).orderBy("line_no").collect()] for x in (F.col("line"), F.concat("line", F.expr("""repeat(',', greatest(0, 13 - size(split(line, ','))))"""), F.lit('"",')))]
        assert len(plain) == (3 if dialect == "frames" else 4) and plain[-3:] == quoted[-3:]
        assert plain[-3][3:12] == (5, 6, 7, 8, 9, 10, 0.5, 1, 1.0) and plain[-3][12:14] == ('A, "B"', "x y")
        assert plain[-1][3] == (None if dialect == "yolo" else 0)


def test_files_of_nulls_have_their_blank(spark, tmp_path):
    write_named(rows(spark, {"a": [None, "x", None, "", "ä"], "b": [None, None]}), f"{tmp_path}/out", "name", "line", ("k",), blank="-")
    assert texts(f"{tmp_path}/out") == {"a": "x\n\nä\n", "b": "-\n"}
