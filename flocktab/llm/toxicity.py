"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of its words; a word is the bag of its hashed character n-grams (3 to 5, with word boundaries) and
of itself. The vectors of all its words are averaged over the whole text and go into a softmax of two classes. Vectors
and softmax are trained together by stochastic gradient steps on a sample of at most `max_rows` labelled rows; a
misspelling that was never seen shares most n-grams, and so most of its vector, with the word that was.

An even average of a long text would hide a few telling words, so the average is weighted: a word weighs exp(SHARP times
its own logit), as attention does, with weights that sum to 1 over the text. They are part of the model: training goes
through them. Both the logit of a word and its weight are one number, so scoring needs just that number of each word, which
each worker keeps for words it has met (two generations of at most CACHE words).

Training rows are chosen by hash of the id, not by place, and leave out the fold that is held out. Scoring is one pass
over all rows, Arrow batch by Arrow batch, without a shuffle.

Defined results. Null or empty text: the score of an empty bag, that is the softmax of the bias. No labelled row, or
labels of one class only: every score is 0 (class 0 only or none) or 1. Repeated rows and null ids are scored as any
row; a null id is never trained on and never held out. An id that repeats may train with each of its texts and labels,
within max_rows, chosen by hash, so that two runs train alike. A very long text is scored whole, in its task. An empty
table gives an empty table. Other columns pass through, but for a column named score, which the new one replaces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

WORD = re.compile(r"[^\W_]+")
DIM, ROWS, SHARP, CACHE = 8, 1 << 16, 0.5, 250_000


def features(word: str) -> list[int]:
    """Rows of the embedding table: the word and its character n-grams."""
    w, of = f"<{word}>", xxhash.xxh3_64_intdigest
    return [of(w) % ROWS] + [of(w[i : i + n]) % ROWS for n in (3, 4, 5) for i in range(len(w) - n + 1)]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Model:
    """vectors (ROWS x DIM) and a softmax (DIM x 2) with bias, collapsed after training to one number a feature."""

    def __init__(self, weight: list[float] | None, bias: float):
        self.weight, self.bias = weight, bias
        self.known, self.older = {}, {}

    def __getstate__(self):
        return self.weight, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def part(self, word: str) -> float:
        """A word's number, from two generations of known words; when the newer is full, the older goes."""
        got = self.known.get(word)
        if got is None:
            got = self.older.get(word)
            if got is None:
                weight, rows = self.weight, features(word)
                got = sum([weight[r] for r in rows]) / len(rows)
            if len(self.known) >= CACHE:
                self.older, self.known = self.known, {}
            self.known[word] = got
        return got

    def logit(self, text: str | None) -> float:
        if self.weight is None:
            return self.bias
        known, part = self.known.get, self.part
        words = words_of(text)
        if not words:
            return self.bias
        own = np.array([part(w) if (p := known(w)) is None else p for w in words])
        weight = np.exp(SHARP * (own - own.max()))
        return self.bias + float(weight @ own / weight.sum())

    def score(self, text: str | None) -> float:
        x = max(-700.0, min(700.0, self.logit(text)))
        return 1.0 / (1.0 + math.exp(-x))


class _Adagrad:
    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.seen = value, rate, np.full(value.shape, 1e-8)

    def step(self, grad: np.ndarray) -> None:
        self.seen += grad * grad
        self.value -= self.rate * grad / np.sqrt(self.seen)


def summed(to: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Row k: the sum of the values whose `to` is k."""
    return np.stack([np.bincount(to, values[:, c], n) for c in range(values.shape[1])], axis=1)


def gradients(vectors: np.ndarray, soft: np.ndarray, bias: np.ndarray, bags: list[np.ndarray], y: np.ndarray, rows_of: list[np.ndarray]):
    """Mean loss of bags of words, none empty, and its derivatives by vectors, softmax and bias."""
    used, at = np.unique(np.concatenate(bags), return_inverse=True)
    length = np.array([len(b) for b in bags])
    doc, begin = np.repeat(np.arange(len(bags)), length), np.cumsum(length) - length
    size = np.array([len(rows_of[w]) for w in used])
    rows, word = np.concatenate([rows_of[w] for w in used]), np.repeat(np.arange(len(used)), size)
    of_word = np.add.reduceat(vectors[rows], np.cumsum(size) - size) / size[:, None]
    own = (of_word @ (soft[:, 1] - soft[:, 0]))[at]  # each word's logit
    share = np.exp(SHARP * (own - np.maximum.reduceat(own, begin)[doc]))
    share /= np.add.reduceat(share, begin)[doc]
    summed_up = lambda weight: np.add.reduceat(of_word[at] * weight[:, None], begin)
    z = summed_up(share) @ soft + bias
    # a word moves the logit by its share, and by what its share moves
    moves = share * (1 + SHARP * (own - np.add.reduceat(share * own, begin)[doc]))
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    docs = np.arange(len(bags))
    loss = -np.log(np.maximum(p[docs, y], 1e-300)).mean()
    p[docs, y] -= 1
    p /= len(bags)
    of_used = summed(at, (p @ soft.T)[doc] * moves[:, None], len(used))
    return loss, summed(rows, (of_used / size[:, None])[word], len(vectors)), summed_up(moves).T @ p, p.sum(0)


def fit(texts: list[str | None], labels: list[int], epochs: int = 8, rate: float = 0.1, batch: int = 64, decay: float = 3e-5, seed: int = 1) -> Model:
    """Adagrad with weight decay on mini-batches of whole texts."""
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(None, 800.0 if len(y) and y.max() == 1 else -800.0)
    rng = np.random.default_rng(seed)
    ids: dict[str, int] = {}
    bags = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t)], np.int32) for t in texts]
    rows_of = [np.array(features(w), np.int32) for w in ids]
    vectors = _Adagrad((rng.random((ROWS, DIM)) - 0.5) / DIM, rate)
    soft, bias = _Adagrad((rng.random((DIM, 2)) - 0.5) / DIM, rate), _Adagrad(np.zeros(2), rate)
    own = np.array([i for i, b in enumerate(bags) if len(b)], np.int64)
    for _ in range(epochs):
        order = rng.permutation(own)
        for k in range(0, len(order), batch):
            docs = order[k : k + batch]
            _, of_vectors, of_soft, of_bias = gradients(vectors.value, soft.value, bias.value, [bags[i] for i in docs.tolist()], y[docs], rows_of)
            soft.step(of_soft)
            bias.step(of_bias)
            vectors.step(of_vectors + decay * vectors.value)
    return Model((vectors.value @ (soft.value[:, 1] - soft.value[:, 0])).tolist(), float(bias.value[1] - bias.value[0]))


def fold(id_: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out; null for a null id."""
    return F.crc32(id_.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_chars: int = 8000) -> Model:
    """Fits on at most max_rows labelled rows with texts of at most max_chars, up to a quarter of class 1 and three quarters of class 0; both bounds keep what the driver holds small."""
    marked = labels.where(F.col(label_col).isNotNull() & (fold(F.col(id_col)) != 0)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    some = lambda c, n: marked.where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = F.broadcast(some(1, max_rows // 4).unionByName(some(0, max_rows - max_rows // 4)))  # max_rows small rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= max_chars)
    rows = texts.join(chosen, "id").select("id", "y", "text").orderBy(F.xxhash64("id", "y", "text"), "id", "y", "text").limit(max_rows).collect()
    rows.sort(key=lambda r: (r["id"], r["y"], r["text"]))
    return fit([r["text"] for r in rows], [r["y"] for r in rows])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score, from 0 to 1."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS numbers

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.score(x) for x in batch], dtype="float64")

    return docs.withColumn("score", scored(F.coalesce(F.col(text_col), F.lit(""))))
