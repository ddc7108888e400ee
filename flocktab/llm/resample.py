"""Importance resampling towards a target: which documents look like the texts of a small target table.

Features are the runs of one to three words, hashed into buckets. A bucket's gain is the log ratio of its share in the
target and in the corpus; a document's weight is the sum of its features' gains, and with Gumbel noise added the highest
scores are a sample without replacement in proportion to exp(weight).

Weights are scored by arrays: a batch's words become arrays of CRC-32 values and lengths, the values of two and three
words follow from those of one by shifts in GF(2), from tables, and gains are looked up by bucket. Counts of the corpus are
of all rows: a task sends one number for each bucket it has met. The cutoff is found by bracketing: a quantile sketch of
the scores gives two bounds around the wanted rank, one pass counts exactly what lies beyond and between them, and the
bracket is widened until the rank lies in it. Only the bracket is sorted to find the cutoff; what lies above it is sorted
for the ranks alone. Both sorts are spread by ranges, with a running count of the partitions before.

Defined results. Null or empty text: no words, weight 0, never drawn. A null id has the noise of an empty id and comes
last in ties. Rows that repeat are scored and drawn as rows of their own. A very long text is scored whole, in chunks of
its task's batch. Empty tables: without documents no row, without a target every count of it is 0. Other columns stay; those named as a
figure are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: After A-Z are lower-cased: a-z, 0-9 and all bytes beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FIGURES = ["n_words", "n_features", "weight", "score", "rank"]
#: Bytes of text that are turned into arrays at a time.
CHUNK = 4 << 20
DIRECT = 64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What a CRC-32's bytes become when 0 to DIRECT - 1 zero bytes follow, and when DIRECT * 2 ** j do."""
    own = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        own = np.where(own & 1, (own >> 1) ^ np.uint32(0xEDB88320), own >> 1)  # the polynomial of CRC-32
    made = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(DIRECT):
        made.append((made[-1] >> np.uint32(8)) ^ own[made[-1] & np.uint32(255)])
    doubled = [made.pop()]
    for _ in range(25):
        doubled.append(_apply(doubled[-1], doubled[-1]))
    return np.stack(made), np.stack(doubled)


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]


_SHORT, _LONG = _tables()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRC-32 values as they go into that of their bytes with n bytes behind."""
    low = n & (DIRECT - 1)
    out = _SHORT[low, 0, crc & 255] ^ _SHORT[low, 1, crc >> 8 & 255] ^ _SHORT[low, 2, crc >> 16 & 255] ^ _SHORT[low, 3, crc >> 24]
    rest = n // DIRECT
    for j in range(int(rest.max(initial=0)).bit_length()):
        some = np.flatnonzero(rest >> j & 1)
        out[some] = _apply(_LONG[j], out[some])
    return out


def buckets_of(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and for each word of all texts, in order, the buckets of the runs of 1, 2 and 3 words that end with it; `buckets` where the text has no such run."""
    words = [WORD.findall(x.lower()) for x in texts]
    size = np.array([len(w) for w in words], np.int64)
    flat = [w for own in words for w in own]
    crc = np.fromiter(map(zlib.crc32, flat), np.uint32, len(flat))
    length = np.fromiter(map(len, flat), np.int64, len(flat))
    spaced = shifted(np.full(len(flat), zlib.crc32(b" "), np.uint32), length) ^ crc
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out = np.full((3, len(flat)), buckets, np.int64)
    out[0] = crc % buckets
    for k in (1, 2):
        crc = np.concatenate([crc[:k], shifted(crc[k - 1 : -1], length[k:] + 1) ^ spaced[k:]])  # of k + 1 words
        out[k] = np.where(place >= k, crc % buckets, buckets)
    return size, out


def _chunks(texts: pd.Series) -> Iterator[list[bytes]]:
    own, size = [], 0
    for x in texts:
        own.append((x or "").encode())
        size += len(own[-1])
        if size >= CHUNK:
            yield own
            own, size = [], 0
    if own:
        yield own


def bucket_counts(texts: DataFrame, buckets: int, text_col: str = "text") -> dict[int, int]:
    """How many features of all texts each bucket has; the driver gets one number a bucket."""
    small_batches(texts.sparkSession)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets + 1, np.int64)
        for batch in batches:
            for chunk in _chunks(batch["text"]):
                total += np.bincount(buckets_of(chunk, buckets)[1].ravel(), minlength=buckets + 1)
        some = np.flatnonzero(total[:buckets])
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    rows = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(counted, "bucket int, n long")
    return {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """Of each bucket the log ratio of its shares, each count plus one, in thousandths."""
    s_all, t_all = float(sum(corpus.values())), float(sum(target.values()))
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (s_all + buckets) / ((corpus.get(b, 0) + 1.0) * (t_all + buckets)))) for b in range(buckets)]


def fit(docs: DataFrame, target: DataFrame, buckets: int = 10_000, text_col: str = "text", target_text_col: str = "text") -> list[int]:
    return gains(bucket_counts(docs, buckets, text_col), bucket_counts(target, buckets, target_text_col), buckets)


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, by hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def score(docs: DataFrame, weights: list[int], seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_features, weight and score; one narrow pass."""
    small_batches(docs.sparkSession)
    buckets, shared = len(weights), docs.sparkSession.sparkContext.broadcast(np.array([*weights, 0], np.int64))  # a number a bucket

    @F.pandas_udf("n_words long, n_features long, weight long")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for chunk in _chunks(batch):
                size, own = buckets_of(chunk, buckets)
                sums = np.concatenate([[0], np.cumsum(shared.value[own].sum(axis=0))])
                ends = np.cumsum(size)
                made.append((size, sums[ends] - sums[ends - size]))
            n, weight = (np.concatenate(x) for x in zip(*made, strict=True))
            yield pd.DataFrame({"n_words": n, "n_features": n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0), "weight": weight})

    held = docs.drop(*[c for c in FIGURES if c not in (id_col, text_col)])
    made = held.withColumn("__f", scored(F.coalesce(F.col(text_col), F.lit(""))))
    return made.select("*", "__f.*").drop("__f").withColumn("score", (F.col("weight") + noise(F.col(id_col), seed)).cast("bigint"))


class Bracket(NamedTuple):
    """Bounds of the scores among which the wanted rank lies (None: no bound), and how many rows lie above."""

    low: int | None
    high: int | None
    above: int


def sketched(rows: DataFrame, shares: list[float], accuracy: int = 10_000) -> list[int]:
    """Scores at about these shares of the rows, from below: Spark's mergeable quantile summary, off by N / accuracy ranks at most."""
    return rows.agg(F.percentile_approx("score", shares, accuracy)).first()[0]


def bracket(rows: DataFrame, wanted: int, n: int, sketch=sketched, margin: float = 2e-4) -> Bracket:
    """The bracket of the wanted rank, 1 being the highest score, among n rows. The sketch only proposes; exact counts accept, or double its reach eightfold."""
    while True:
        at = 1 - wanted / n
        shares = [at - margin, at + margin]
        low, high = sketch(rows, [min(max(s, 0.0), 1.0) for s in shares])
        low, high = (None if shares[0] <= 0 else low), (None if shares[1] >= 1 else high)
        above = F.lit(False) if high is None else F.col("score") > high
        between = ~above & (F.lit(True) if low is None else F.col("score") >= low)
        counts = rows.agg(F.count_if(above).alias("above"), F.count_if(between).alias("between")).first()
        if counts["above"] < wanted <= counts["above"] + counts["between"]:
            return Bracket(low, high, counts["above"])
        margin *= 8


def in_order(rows: DataFrame, before: int, id_col: str) -> DataFrame:
    """rows with rank, from before + 1: sorted by ranges, a row's place in its partition plus the sizes of those before it."""
    held = cut(rows.orderBy(F.desc("score"), F.col(id_col).asc_nulls_last()).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    sizes = held.groupBy(part).agg(F.count("*").alias("n"))  # a row a partition
    earlier = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("__part", part).join(F.broadcast(earlier), "__part").withColumn("rank", F.lit(before + 1) + F.col("__before") + place).drop("__at", "__part", "__before")


def select(scored: DataFrame, percent: int = 5, min_words: int = 20, id_col: str = "doc_id", sketch=sketched) -> DataFrame:
    """scored with rank: 1, 2, 3, ... on the floor(percent N / 100) highest scores of the N rows with min_words words, ties to the smaller id; null on the rest. scored is read several times: pass a written table."""
    fits = F.col("n_words") >= min_words
    rows = scored.where(fits)
    n = rows.count()
    wanted, none = percent * n // 100, F.lit(None).cast("bigint").alias("rank")
    if not wanted:
        return scored.withColumn("rank", none)
    low, high, above = bracket(rows, wanted, n, sketch)
    over = F.lit(False) if high is None else F.col("score") > high
    under = F.lit(False) if low is None else F.col("score") < low
    middle = in_order(rows.where(~over & ~under), above, id_col).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    out = middle.unionByName(scored.where(~fits | under).withColumn("rank", none))
    return out if high is None else out.unionByName(in_order(rows.where(over), 0, id_col))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less their texts, with n_words, n_features, weight, score and rank."""
    scored = score(docs, fit(docs, target, buckets, text_col), seed, id_col, text_col)
    return select(cut(scored.drop(text_col)), percent, min_words, id_col)


def drawn(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are drawn, texts included: scored again instead of joined, so no text is shuffled. Rows that repeat the last one's score and id are all kept."""
    weights = fit(docs, target, buckets, text_col)
    whole = docs.select(F.col(id_col), F.col(text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    scored = score(whole, weights, seed, id_col, text_col)
    last = select(cut(scored.select(id_col, "n_words", "score")), percent, min_words, id_col).where("rank is not null").agg(F.max_by(F.struct("score", id_col), "rank")).first()[0]
    if last is None:
        return docs.limit(0)
    tie = F.lit(True) if last[id_col] is None else F.coalesce(F.col(id_col) <= last[id_col], F.lit(False))
    return scored.where((F.col("n_words") >= min_words) & ((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & tie))).select("__doc.*")
