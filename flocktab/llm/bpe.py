"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the whole vocabulary. A pre-token that is a vocabulary entry is resolved by one
probe and one comparison. Tier two, for misses: byte-pair merging with a heap of candidate merges over a linked list
of byte positions, so that a pre-token of n bytes takes O(n log n) also when it is very long. Each Python worker keeps
the ids of pre-tokens it has met in two generations of at most CACHE entries; when the newer is full, the older goes. Texts are processed one Arrow
batch at a time and no row leaves its task, so nothing is shuffled.

Defined results. Null text: empty, no ids. Empty tables give empty tables. Null ids, repeated rows and other columns
pass through as they are, but for columns of docs named ids or decoded, which the new ones replace. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Pre-tokens kept by a worker, and the longest that is kept.
CACHE, CACHE_BYTES = 250_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank. The vocabulary is read on the driver: it is a fixed table, not data."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of n keys: hash and displace, about two keys a bucket, largest buckets placed first.

    slot = ((a + d * b) mod 2^32) * n / 2^32, with a and odd b from the key's hash and d the displacement of its bucket. A bucket of one key
    takes any slot left over, stored as -1 - slot. A slot has the id of its key; the key itself is compared, so a
    foreign token is a miss.
    """

    def __init__(self, ranks: dict[bytes, int]):
        n = self.n = max(1, len(ranks))
        self.buckets = n // 2 + 1
        self.keys: list[bytes | None] = [None] * n
        self.ids = [0] * n
        self.displace = [0] * self.buckets
        of: list[list[tuple[int, int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in ranks:
            bucket, a, b = self._parts(key)
            of[bucket].append((a, b, key))
        taken = bytearray(n)
        order = sorted((x for x in range(self.buckets) if of[x]), key=lambda x: -len(of[x]))
        spare = 0
        for x in order:
            own = of[x]
            if len(own) == 1:
                spare = taken.index(0, spare)
                slots, self.displace[x] = [spare], -1 - spare
            else:
                d = 0
                while True:
                    slots = [((a + d * b & 0xFFFFFFFF) * n) >> 32 for a, b, _ in own]
                    if not any(taken[s] for s in slots) and len(set(slots)) == len(slots):
                        break
                    d += 1
                    if d > 50 * n:
                        raise ValueError("two keys with one hash")
                self.displace[x] = d
            for s, (_, _, key) in zip(slots, own, strict=True):
                taken[s], self.keys[s], self.ids[s] = 1, key, ranks[key]

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & 0xFFFFFFFF) % self.buckets, h >> 32 & 0xFFFFFFFF, h >> 64 & 0xFFFFFFFF | 1

    def get(self, token: bytes) -> int:
        """The token's id, or -1."""
        bucket, a, b = self._parts(token)
        d = self.displace[bucket]
        slot = -1 - d if d < 0 else ((a + d * b & 0xFFFFFFFF) * self.n) >> 32
        return self.ids[slot] if self.keys[slot] == token else -1


def merge_bytes(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a token by repeated merging of the adjacent pair of lowest rank, leftmost first."""
    n = len(token)
    end = list(range(1, n + 1))  # where the piece that starts at i ends; 0: merged into the one before
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if (r := ranks.get(token[i : i + 2])) is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= stop or end[mid] != stop:
            continue  # one of its pieces has changed
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(token[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i:
            p = before[i]
            if (r := ranks.get(token[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : end[i]]])
        i = end[i]
    return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.table = PerfectHash(ranks)
        self.size = 1 + max(ranks.values(), default=0)
        self.ready()

    def __getstate__(self):
        return self.ranks, self.pattern, self.table, self.size

    def __setstate__(self, state):
        self.ranks, self.pattern, self.table, self.size = state
        self.ready()

    def ready(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes_of = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token

    def _ids(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            token = piece.encode()
            one = self.table.get(token)
            ids = array("I", [one] if one >= 0 else merge_bytes(token, self.ranks)).tobytes()
            if len(token) > CACHE_BYTES:
                return ids
        if len(self.known) >= CACHE:
            self.older, self.known = self.known, {}
        self.known[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, ids = self.known.get, self._ids  # of a generation that ends meanwhile, known still holds true ids
        return b"".join([known(piece) or ids(piece) for piece in self.find(text or "")])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


def codec(spark: SparkSession, path: str, pattern: str):
    """The codec as a broadcast value: a fixed table of a few MB."""
    return spark.sparkContext.broadcast(Codec(read_ranks(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """The columns `keep` of docs (default: all but the text), ids (binary, little-endian unsigned 32-bit) and, if asked for, decoded (binary)."""
    keep = [c for c in docs.columns if c not in (text_col, "ids", "decoded")] if keep is None else keep
    small_batches(docs.sparkSession)
    shared = codec(docs.sparkSession, path, pattern)
    kind = T.StructType([T.StructField("ids", T.BinaryType()), *([T.StructField("decoded", T.BinaryType())] if decoded else [])])

    @F.pandas_udf(kind)
    def coded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for batch in texts:
            ids = [c.encode(x) for x in batch]
            yield pd.DataFrame({"ids": ids, "decoded": [c.decode(x) for x in ids]} if decoded else {"ids": ids})

    made = docs.select(*keep, coded(F.coalesce(F.col(text_col), F.lit(""))).alias("__coded"))
    return made.select(*keep, "__coded.*")


def decode(ids: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """ids with `decoded`, the bytes its ids stand for. Null ids: empty."""
    shared = codec(ids.sparkSession, path, "")

    @F.pandas_udf(T.BinaryType())
    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.decode(x or b"") for x in batch], dtype=object)

    return ids.withColumn("decoded", plain(F.col(ids_col)))
