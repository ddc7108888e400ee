"""Columns that have the names of an operator's results, very long texts and ties in the pipeline's stages."""

import random

import public_tokenizers as PT
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flocktab.llm import bpe, jaccard, line_dedup, substring_dedup, toxicity

MODEL = toxicity.Model([0.1] * toxicity.ROWS, -1.0)
OPERATORS = {
    "n_sentences n_removed removed_words": lambda d: substring_dedup.dedup_substrings(d),
    "n_lines n_dropped": lambda d: line_dedup.dedup_lines(d),
    "ids decoded": lambda d: bpe.encode(d, PT.path("byte_bpe_50k.tiktoken"), PT.PATTERN, decoded=True),
    "score": lambda d: toxicity.score(d, MODEL),
}


@pytest.mark.parametrize("names", OPERATORS)
def test_result_columns_replace_columns_of_their_names(spark, names):
    """The results are those of a table without such columns, and other columns stay."""
    rng = random.Random(2)
    rows = [(k, " ".join(f"w{rng.randrange(50)}" for _ in range(60)) + ".\nA line that is shared by all of these texts.") for k in range(5)] + [(7, None), (7, "")]
    plain = spark.createDataFrame(rows, "doc_id long, text string").withColumn("more", F.lit("m"))
    clash = plain.withColumns({c: F.lit("old") for c in names.split()})
    want, got = OPERATORS[names](plain), OPERATORS[names](clash)
    assert sorted(got.columns) == sorted(want.columns) and len(set(got.columns)) == len(got.columns)
    columns = sorted(want.columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert {r["more"] for r in got.collect()} == {"m"}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_very_long_texts_and_ties(spark, sf_dir, name):
    """Texts of 40,000 words, of 30,000 lines and of one word of 300,000 letters; near copies whose ids are the same."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(30_000)}" for _ in range(40_000)]
    long, copy = " ".join(words), " ".join([*words[:20_000], "changed", *words[20_001:]])
    lines = "\n".join(f"line {k} holds number {rng.randrange(10**9)} and some words" for k in range(30_000))
    rows = [(1, long), (1, copy), (2, lines), (3, "x" * 300_000), (4, lines + "\nend")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"], r["text"]) if name != "byte_bpe" else (r["doc_id"], r["n_tokens"]) for r in dict(corpus_pipeline.STAGES)[name](spark, frame, sf_dir).collect())
    if name == "quality_rules":  # one word is no document
        assert got == sorted(r for r in rows if r[0] != 3)
    elif name == "line_dedup":  # lines of two documents only
        assert got == sorted(rows)
    elif name == "simhash_near_dedup":  # one of each pair, of one id by its row's hash
        assert [i for i, _ in got] == [1, 2, 3] and got[0][1] in (long, copy) and got[1][1] == lines
    elif name == "decontamination":
        assert got == sorted(rows)
    else:
        assert [i for i, _ in got] == [1, 1, 2, 3, 4] and all(n > 30_000 for _, n in got)


def test_near_dedup_without_broadcasts(spark, sf_dir, monkeypatch):
    """Beyond the bounds of the counted broadcasts texts and rows are shuffled, and the same rows stay."""
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(12)]
    rows = [(k % 17, base[k % 12] + (f" tail{k}" if k % 3 else "")) for k in range(40)] + [(None, base[0]), (None, base[0]), (99, None), (98, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, corpus_pipeline.near_dedup(spark, frame, sf_dir).collect()))
    monkeypatch.setattr(corpus_pipeline, "MAX_BROADCAST", 0)
    monkeypatch.setattr(jaccard.texts_of, "__defaults__", (0,))
    assert sorted(map(str, corpus_pipeline.near_dedup(spark, frame, sf_dir).collect())) == want and 10 < len(want) < 20
