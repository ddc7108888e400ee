"""Substring dedup: remove sentences that a repeated run of sentences covers, all but the run's first occurrence.

Method: a text is cut into sentences, and a sentence of more than PIECE words into pieces that end at words chosen by
their hash, so that a long sentence is a run as well and its pieces are the same wherever the same words stand. Every run
of `run` consecutive sentences is hashed to 128 bits, with as many sentences that follow as it needs to have `min_words`
words. A text of fewer sentences or words than that is one run as a whole if it has WHOLE words, and meets only texts
that are such runs too. Hashes are joined globally, in one shuffle, and all but a hash's first occurrence, by document
and position, are marked. The task that hashes settles what it can: of the runs of one hash among CHUNK runs only the
first can be the first of all, so the others are marked at once and travel under keys of their own; a hash that a third
of all rows share costs one row a chunk. The marked positions, not texts, go back to the documents, which drop the
sentences they cover.

Texts are cut twice, once to hash and once to drop, over Arrow batches; no text is shuffled but for the final join with
the marks.

Defined results. Null text stays null and has no sentence; an empty text stays empty. A text of fewer than WHOLE words is
never touched. Rows that repeat an id with the same text are one document and are treated alike; with different texts
they are two, ordered by the text's hash. A null id sorts last. A very long text is cut in one piece: its task holds it
and its runs. An empty table gives an empty table. Other columns stay as they are, but for columns of docs named
n_sentences, n_removed or removed_words, which the new ones replace.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?\n]+[\s]*|$)")
PIECE = 16
#: Letters of scripts that are written without spaces: Thai to Myanmar, Khmer, kana, Han.
LETTER = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORDS = re.compile(rf"[{LETTER}]\s*|[^\s{LETTER}]+\s*|\s+")
LETTERS = re.compile(rf"[{LETTER}]")
#: A word of more characters than this counts by its characters.
LONG = 40
#: A piece has so many words at least and at most; between them one word in CUT ends it.
LEAST, MOST, CUT = 2, 8, 3
#: Words from which a text too short for a run is one run as a whole.
WHOLE = 10
#: Runs that a task settles among themselves before it passes them on.
CHUNK = 1 << 19


def plain(s: str) -> bool:
    """Whether the words of s are what stands between blanks."""
    return (s.isascii() or not LETTERS.search(s)) and (len(s) <= LONG or max(map(len, s.split()), default=0) <= LONG)


def units(s: str) -> list[str]:
    """The words of s with the blanks that follow; single characters where there are no blanks."""
    out = []
    for w in WORDS.findall(s):
        if len(w.rstrip()) > LONG:
            out += re.findall(r"\S\s*", w)
        else:
            out.append(w)
    return out


def n_words(key: str) -> float:
    """Words of a normalised text; two characters that stand for words count as one."""
    if plain(key):
        return key.count(" ") + 1 if key else 0
    return sum(0.5 if len(w.rstrip()) == 1 and not (w.isascii() and w.endswith(" ")) else 1 for w in units(key))


def sentences(text: str) -> list[str]:
    """Cuts text without loss: joined, the sentences give the text."""
    out = []
    for s in SENTENCE.findall(text):
        simple = plain(s)
        if simple and s.rstrip().count(" ") < PIECE:
            if s:
                out.append(s)
            continue
        words, begin = units(s), 0
        if len(words) <= PIECE or not s.strip():
            out.append(s)
            continue
        for k, w in enumerate(words, 1):
            if k - begin >= LEAST and (k - begin == MOST or crc32((w if simple else "".join(words[max(0, k - 2) : k])).rstrip().lower().encode()) % CUT == 0):
                out.append("".join(words[begin:k]))
                begin = k
        if begin < len(words):
            out.append("".join(words[begin:]))
    return out


def is_whole(words: list[float], run: int, min_words: int) -> bool:
    """Whether a text of such sentences is too short for a run."""
    return len(words) < run or sum(words) < min_words


def reaches(words: list[float], run: int, min_words: int) -> list[tuple[int, int] | None]:
    """For each start, the sentences (from, to) of its run: `run` of them, and as many that follow as min_words needs; near the end of the text, where they run out, those before. None: no run starts here."""
    n, sums, out, to = len(words), [0, *accumulate(words)], [], 0
    if is_whole(words, run, min_words):
        return [(0, n)] if n and sums[n] >= WHOLE else []
    for i in range(n - run + 1):
        to = max(to, i + run)
        while to < n and sums[to] - sums[i] < min_words:
            to += 1
        if sums[to] - sums[i] >= min_words:
            out.append((i, to))
            continue
        begin, end = i, i + run
        while begin and sums[end] - sums[begin] < min_words:
            begin -= 1
        out.append((begin, end) if sums[end] - sums[begin] >= min_words else None)
    return out


def measured(parts: list[str]) -> tuple[list[str], list[float]]:
    keys = [" ".join(s.lower().split()) for s in parts]
    return keys, [n_words(k) for k in keys]


def run_hashes(text: str | None, run: int, min_words: int) -> list[tuple[int, bytes]]:
    """(first sentence, digest) of each run."""
    keys, words = measured(sentences(text or ""))
    digests = [xxhash.xxh3_128_digest(k.encode()) for k in keys]
    # a run that goes backwards has its own kind of digest: another start of the text may reach over the same sentences
    kind = (b"=", b"=") if is_whole(words, run, min_words) else (b"", b"<")
    return [(i, xxhash.xxh3_128_digest(b"".join([*digests[r[0] : r[1]], kind[r[0] < i]]))) for i, r in enumerate(reaches(words, run, min_words)) if r]


def settle(runs: pa.Table) -> pa.Table:
    """runs(h1, h2, id, text_hash, at) with settled: there is an earlier one of its hash here. Those that are settled get keys of their own; repeats of a row go."""
    h1 = runs["h1"].to_numpy()
    order = np.argsort(h1, kind="stable")
    same = h1[order[1:]] == h1[order[:-1]]
    shared = np.zeros(len(h1), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    alone = runs.filter(pa.array(~shared)).append_column("settled", pa.array(np.zeros(int((~shared).sum()), bool)))
    some = runs.filter(pa.array(shared))
    if not len(some):
        return alone
    some = some.take(pc.sort_indices(some, [(c, "ascending") for c in ("h1", "h2", "id", "text_hash", "at")], null_placement="at_end"))
    ids = pc.dictionary_encode(some["id"].combine_chunks(), null_encoding="encode").indices.to_numpy()
    keys = [some[c].to_numpy() for c in ("h1", "h2", "text_hash", "at")]
    again = [np.concatenate([[False], k[1:] == k[:-1]]) for k in [*keys, ids]]
    settled, repeat = again[0] & again[1], np.logical_and.reduce(again)
    own = (keys[2] ^ (keys[3].astype(np.int64) * -7046029254386353131)).astype(np.int64)
    some = some.set_column(0, "h1", pa.array(np.where(settled, own, keys[0]))).set_column(1, "h2", pa.array(np.where(settled, 0, keys[1])))
    return pa.concat_tables([alone, some.append_column("settled", pa.array(settled)).filter(pa.array(~repeat))])


def repeated_runs(docs: DataFrame, run: int = 3, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, starts): the first sentences, from 0, of the runs that are not the first of their kind."""
    small_batches(docs.sparkSession)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            rows, starts, digests = [], [], []
            for k, x in enumerate(batch.column("text")):
                for at, digest in run_hashes(x.as_py(), run, min_words):
                    rows.append(k)
                    starts.append(at)
                    digests.append(digest)
            both, rows = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2), pa.array(rows, pa.int64())
            held.append(pa.table({"h1": both[:, 0].copy(), "h2": both[:, 1].copy(), "id": batch.column("id").take(rows), "text_hash": batch.column("text_hash").take(rows), "at": pa.array(starts, pa.int32())}))
            n += len(starts)
            if n >= CHUNK:
                yield from settle(pa.concat_tables(held)).to_batches(max_chunksize=1 << 16)
                held, n = [], 0
        if n:
            yield from settle(pa.concat_tables(held)).to_batches(max_chunksize=1 << 16)

    runs = texts.mapInArrow(hashed, f"h1 bigint, h2 bigint, id {kind}, text_hash bigint, at int, settled boolean")
    place = Window.partitionBy("h1", "h2", "settled").orderBy(F.col("id").asc_nulls_last(), "text_hash", "at")
    later = runs.withColumn("k", F.dense_rank().over(place)).where(F.col("settled") | (F.col("k") > 1))  # a repeated row shares its rank
    return later.groupBy("id", "text_hash").agg(F.collect_set("at").alias("starts"))


def dedup_substrings(docs: DataFrame, run: int = 3, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its text less the covered sentences, and n_sentences, n_removed and removed_words."""
    marks = repeated_runs(docs, run, min_words, id_col, text_col).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("starts").alias("__starts"))
    held = docs.withColumn("__hash_of", F.xxhash64(text_col))
    both = held.join(marks.hint("shuffle_hash"), held[id_col].eqNullSafe(marks["__id"]) & (held["__hash_of"] == marks["__hash"]), "left")

    kind = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_sentences", "n_removed", "removed_words")]])

    @F.pandas_udf(kind)
    def less(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts in batches:
            rows = []
            for x, at in zip(texts, starts, strict=True):
                if x is None:
                    rows.append((None, 0, 0, 0))
                    continue
                parts = sentences(x)
                reach = [] if at is None else reaches(measured(parts)[1], run, min_words)
                gone = set() if at is None else {k for i in at for k in range(*reach[int(i)])}
                kept = [s for k, s in enumerate(parts) if k not in gone]
                rows.append((x if not gone else "".join(kept), len(parts), len(gone), sum(len(parts[k].split()) for k in gone)))
            yield pd.DataFrame(rows, columns=["text", "n_sentences", "n_removed", "removed_words"])

    done = both.withColumn("__less", less(F.col(text_col), F.col("__starts"))).drop("__hash_of", "__id", "__hash", "__starts")
    return done.withColumns({text_col: F.col("__less.text"), "n_sentences": F.col("__less.n_sentences"), "n_removed": F.col("__less.n_removed"), "removed_words": F.col("__less.removed_words")}).drop("__less")
