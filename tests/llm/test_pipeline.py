"""The pipeline's stages against brute-force versions on the smallest tables, and the queries that have SQL."""

import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import _decontaminated, brute_lines, reference_encoding

import corpus_pipeline
from flocktab.llm import jaccard, queries
from flocktab.llm.common import table
from flocktab.llm.simhash import fingerprint, shingle_hashes


def brute_near(texts):
    """For each text the place of the first that links of Jaccard similarity 0.8 in five-word shingles reach."""
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return up


def test_stages(spark, sf_dir, tmp_path):
    """Each stage against a brute-force version, on what its predecessor kept."""
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    docs = table(spark, sf_dir, "documents")
    columns, by = docs.columns, {}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        rows = docs.collect()
        assert all(r["n_chars"] == len(r["text"] or "") for r in rows) or name == "quality_rules"
        by[name] = {r["doc_id"]: r["text"] for r in rows}
    judged = con.execute(f"select doc_id from ({queries.ORACLE['op6_quality_rules']}) where kept").fetchall()
    assert by["quality_rules"] == {r[0]: before[r[0]] for r in judged}
    assert by["line_dedup"] == {r[0]: r[1] for r in brute_lines(list(by["quality_rules"].items()))}
    held = sorted(by["line_dedup"].items())
    assert by["simhash_near_dedup"] == {held[k][0]: held[k][1] for k in set(brute_near([t for _, t in held]))}
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    clean = {int(i) for i, _, hit, _ in _decontaminated(list(by["simhash_near_dedup"].items()), items) if not hit}
    assert by["decontamination"] == {i: t for i, t in by["simhash_near_dedup"].items() if i in clean}
    assert len(before) > len(by["quality_rules"]) > len(by["simhash_near_dedup"]) > len(by["decontamination"]) > 100
    last = corpus_pipeline.run(spark, sf_dir).collect()
    enc = reference_encoding()
    assert {r["doc_id"] for r in last} == set(by["decontamination"])
    for r in last:
        ids = np.array(enc.encode_ordinary(by["decontamination"][r["doc_id"]]), "<u4")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()


ROW = "doc_id long, text string, n_chars long, quality string, n_lines string, n_dropped string, node string, component string, size string, value string, h string, ids string, more map<string, int>"


def edge_rows(rows):
    return [(i, t, len(t or ""), "q", "l", "d", "n", "c", "s", "v", "h", "i", {"k": k}) for k, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, sf_dir, name):
    """Nulls, empty and repeated rows, one id with several texts, columns whose names the operators use, and no row."""
    rng = random.Random(11)
    good = [" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(4)]
    rows = [(None, good[0]), (None, good[1]), (5, good[2]), (5, good[3]), (6, ""), (7, None), (None, None)]
    stage = dict(corpus_pipeline.STAGES)[name]
    made = spark.createDataFrame(edge_rows(rows), ROW)
    got = stage(spark, made.unionByName(made.where("text is null or text = ''")), sf_dir)
    assert stage(spark, made.limit(0), sf_dir).count() == 0
    if name == "byte_bpe":
        assert got.count() == len(rows) + 3
        return
    assert got.columns == made.columns
    kept = got.collect()
    left = sorted(((r["doc_id"], r["text"]) for r in kept), key=str)
    if name == "quality_rules":
        assert left == sorted(rows[:4], key=str)
    elif name == "simhash_near_dedup":
        assert left == sorted([*rows[:4], (6, "")], key=str)  # blank texts are one group
    else:
        assert left == sorted([(i, (t or "") if name == "line_dedup" else t) for i, t in [*rows, *rows[4:]]], key=str)
    assert all(r["quality"] == "q" and r["n_lines"] == "l" and r["n_dropped"] == "d" and r["node"] == "n" and len(r["more"]) == 1 for r in kept)


def test_near_dedup_large_groups(spark, monkeypatch):
    """Bands of many nodes, cut into blocks: texts of one template, near the threshold, some linked and some not."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "WIDTH", 32)
    rng = random.Random(12)
    base, texts = [f"w{k}" for k in range(150)], []
    for _ in range(90):
        own = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 5)):
            own[at] = f"x{rng.randrange(9000)}"
        texts.append(" ".join(own))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard.near_groups(frame, keep=("doc_id",)).collect()
    first = {}
    for r in sorted(got, key=lambda r: r["doc_id"]):
        first.setdefault(r["component"], r["doc_id"])
    want = brute_near(texts)
    assert {r["doc_id"]: first[r["component"]] for r in got} == dict(enumerate(want)) and 1 < len(set(want)) < 90


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rel = con.execute(queries.ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=str) == want


def test_guard(tmp_path):
    """Without this subpackage and the pipeline the entry still imports."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/flocktab", tmp_path / "flocktab", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": ""})
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 50


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_finds_all_at_jaccard(spark, sf_dir):
    """Copies with words replaced, also those far apart in SimHash bits, against all pairs."""
    rng, rows = random.Random(3), []
    for k in range(25):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 200))]
        for _ in range(6):
            copy = list(own)
            for at in rng.sample(range(len(own)), rng.randrange(0, 5)):
                copy[at] = f"x{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(copy)))
    up = brute_near([t for _, t in rows])
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert {r["doc_id"] for r in got.collect()} == set(up) and 25 < len(set(up)) < 140


def test_near_dedup_links_by_simhash(spark, monkeypatch):
    """Without a band of MinHash, copies within SimHash's four bits are still found, and none of another similarity."""
    made = jaccard.sketches
    monkeypatch.setattr(jaccard, "sketches", lambda *a: made(*a).withColumn("bands", F.array().cast("array<long>")))
    rng, texts = random.Random(5), []
    for _ in range(12):
        own = [f"w{rng.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(own), " ".join([*own[:-1], "x"])]
    texts.append("")
    got = jaccard.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=("doc_id",)).collect()
    prints = [fingerprint(shingle_hashes(t)) for t in texts]
    close = [k for k in range(0, 24, 2) if bin((prints[k] ^ prints[k + 1]) & (2**64 - 1)).count("1") <= 4]
    of = {r["doc_id"]: r["component"] for r in got}
    assert len(close) > 6 and [k for k in range(0, 24, 2) if of[k] == of[k + 1]] == close
    assert len(set(of.values())) == 25 - len(close)


def test_near_dedup_null_and_repeated_ids(spark, sf_dir):
    """Survivors are rows: different texts stay, whatever their ids."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[2]), (8, texts[3]), (8, texts[4]), (3, texts[4]), (8, texts[5]), (8, texts[5]), (None, None), (9, "")]
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (8, texts[3]), (3, texts[4]), (8, texts[5]), (9, "")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_sharding_keeps_null_ids(spark, tmp_path):
    rows = [(None, "no id"), (None, "none either"), (1, "one"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op5_sharding"](spark, str(tmp_path)).collect()
    assert all(r["manifest_rows"] == 4 and r["full_tiers"] == 0 for r in got)
    assert sorted((str(r["doc_id"]), r["n_bytes"]) for r in got) == sorted((str(i), t and len(t)) for i, t in rows)
