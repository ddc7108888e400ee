"""SimHash near-dedup by the general pigeonhole principle.

Fingerprints: 64 bits from the XXH64 hashes of a text's word shingles, bit by bit the majority. Two fingerprints link
at `distance` or fewer differing bits; a document's component is the smallest id that links reach.

Candidates (after Qin et al., GPH: Similarity Search in Hamming Space, ICDE 2018). The bits are grouped into partitions,
correlated bits together. Partition i gets its own threshold t_i, from -1 (unused) up, with sum(t_i + 1) = distance + 1:
two fingerprints within the distance then differ by at most t_i bits in some partition i. A dynamic program takes the
thresholds of least estimated cost, probes plus candidates, estimated on a sample of at most SAMPLE fingerprints; it
is run for 1 to distance + 1 partitions. Whatever it chooses, no link is lost: the plan changes the work only.

Probe and verify. Equal fingerprints are one row from the start. Each puts itself under its partition's value and
probes all values within t_i bits; rows of one key meet in a task, sorted by key, are verified there by popcount, and
only a spanning forest of the true links leaves it, never all pairs of a group. A key with more than BLOCK rows is cut
into blocks of about BLOCK rows and each pair of blocks is a group of its own, so no task holds more than two blocks.
Within a group, rows linked by one or two bits are joined first through shared one-bit neighbours; only rows that
are still apart are compared. Components are found by star contraction over those forests.

Defined results. Null or blank text: fingerprint zero, linked like any other. Null ids: they get the component of
their fingerprint; a component of null ids only is null. Repeated rows share a fingerprint. A very long text is hashed
shingle by shingle within its task. An empty table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_skewed, small_batches
from .components import components

SEED, BLOCK, SAMPLE = 42, 8192, 2048
#: What a row sent to a task costs, in comparisons within one.
ROW_COST = 300


def shingle_hashes(text: str | None, words: int = 4) -> np.ndarray:
    """XXH64 of each shingle of the words, A-Z lower-cased; of the whole sequence if it is shorter."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and the six blanks only
    if not found:
        return np.empty(0, np.uint64)
    whole = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.fromiter([digest(whole[i:j], SEED) for i, j in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64, len(found) - words + 1)


def fingerprint(hashes: np.ndarray, chunk: int = 1 << 16) -> int:
    """Bits that are set in over half the hashes, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), chunk):
        bits = np.unpackbits(hashes[k : k + chunk].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row; fp: signed long."""

    small_batches(docs.sparkSession)

    @F.pandas_udf(T.LongType())
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(shingle_hashes(x, words)) for x in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), made(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"))


class Plan:
    """parts: lists of bits; thresholds: one for each."""

    def __init__(self, parts: list[list[int]], thresholds: list[int]):
        self.parts, self.thresholds = parts, thresholds


def plan(sample: np.ndarray, total: int, distance: int = 4) -> Plan:
    """The plan of least estimated cost a fingerprint for `total` fingerprints, from a sample of them."""
    bits = (sample[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.float64)
    x = bits - bits.mean(0) if len(bits) else np.zeros((1, 64))
    norm = np.sqrt((x * x).sum(0))
    like = np.abs(x.T @ x) / np.maximum(np.outer(norm, norm), 1e-9)
    best: tuple[float, Plan] | None = None
    for m in range(1, distance + 2):
        left, parts = set(range(64)), []
        for k in range(m):  # from a seed bit on, the bit most correlated with the group so far
            want = (64 + k) // m
            own = [min(left)]
            left.discard(own[0])
            while len(own) < want:
                nxt = max(sorted(left), key=lambda b: like[b, own].mean())
                own.append(nxt)
                left.discard(nxt)
            parts.append(sorted(own))
        cost = []  # cost[i][t + 1]
        for part in parts:
            v = bits[:, part]
            ones = v.sum(1)
            apart = ones[:, None] + ones[None] - 2 * (v @ v.T)
            pairs = max(1, len(sample) * (len(sample) - 1))
            row, probes = [0.0], 0
            for t in range(distance + 1):
                probes += len(list(combinations(range(len(part)), t))) if t < 4 else 10**9
                near = max(0, (apart <= t).sum() - len(sample)) / pairs
                near = max(near, sum(_choose(len(part), j) for j in range(t + 1)) / 2.0 ** len(part))
                row.append(ROW_COST * probes + near * total)
            cost.append(row)
        table = {0: (0.0, [])}  # sum of t_i + 1 -> cost and thresholds
        for row in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for used, (c, ts) in table.items():
                for t1, r in enumerate(row):
                    if used + t1 <= distance + 1 and (used + t1 not in nxt or nxt[used + t1][0] > c + r):
                        nxt[used + t1] = (c + r, [*ts, t1 - 1])
            table = nxt
        c, ts = table[distance + 1]
        if best is None or c < best[0]:
            best = (c, Plan(parts, ts))
    return best[1]


def _choose(n: int, k: int) -> int:
    import math

    return math.comb(n, k)


def _gather(values: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of a partition, packed."""
    out = np.zeros(len(values), np.uint64)
    for k, b in enumerate(part):
        out |= (values >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


class Forest:
    """Union-find over the rows of one group."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def group_links(fps: np.ndarray, distance: int, few: int = 64) -> list[tuple[int, int]]:
    """Links (row, row) of a spanning forest of all pairs within the distance."""
    n, forest = len(fps), Forest(len(fps))
    if n <= few:
        for i in range(n - 1):
            for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= distance):
                forest.join(i, i + 1 + int(j))
        return forest.links
    if distance >= 2:  # rows that share a one-bit neighbour differ by two bits or fewer
        masks = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
        near = (fps[:, None] ^ masks[None]).ravel()
        order = np.argsort(near, kind="stable")
        for k in np.flatnonzero(near[order[1:]] == near[order[:-1]]).tolist():
            forest.join(int(order[k]) // 65, int(order[k + 1]) // 65)
    roots = np.array([forest.root(i) for i in range(n)])
    largest = np.argmax(np.bincount(roots, minlength=n))
    rest = np.flatnonzero(roots != largest)
    for i in rest.tolist():  # all links but those within the largest tree
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= distance).tolist():
            forest.join(i, j)
    return forest.links


def links(fps: DataFrame, distance: int = 4, the_plan: Plan | None = None) -> DataFrame:
    """Links (a, b) between different fingerprints of fps(fp), which has no repeats: enough to connect all within the distance."""
    if the_plan is None:
        sample = [r["fp"] for r in fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()]
        the_plan = plan(np.array(sample, np.int64).astype(np.uint64), fps.count(), distance)
    chosen = [(k, part, t) for k, (part, t) in enumerate(zip(the_plan.parts, the_plan.thresholds, strict=True)) if t >= 0]

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["fp"].to_numpy().astype(np.uint64)
            for k, part, t in chosen:
                value = _gather(own, part)
                for flips in (f for n in range(t + 1) for f in combinations(range(len(part)), n)):
                    mask = np.uint64(sum(1 << b for b in flips))
                    yield pd.DataFrame({"part": np.int32(k), "value": (value ^ mask).astype(np.int64), "fp": batch["fp"].to_numpy()})

    rows = fps.select("fp").mapInPandas(probes, "part int, value bigint, fp bigint")
    full = rows.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    sized = rows.join(full, ["part", "value"]).withColumn("m", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    # every pair of blocks of a large key is a group; a key of one block is one group
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    dealt = sized.select("part", "value", "fp", "own", "m", other.alias("with")).select("part", "value", "fp", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"))
    keys = ["part", "value", "x", "y"]
    together = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
            if not len(group):
                return
            key = group[keys].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            fp = group["fp"].to_numpy().astype(np.uint64)
            a, b = [], []
            for own in np.split(fp, cuts):
                if len(own) > 1:
                    own = np.unique(own)
                    for i, j in group_links(own, distance):
                        a.append(own[i])
                        b.append(own[j])
            if a:
                yield pd.DataFrame({"a": np.array(a, np.uint64).astype(np.int64), "b": np.array(b, np.uint64).astype(np.int64)})

        held: list[pd.DataFrame] = []  # the last group of the batches so far may go on
        for batch in batches:
            if not len(batch):
                continue
            last = batch[keys].iloc[-1]
            tail = (batch[keys] == last).all(axis=1).to_numpy()
            begin = len(tail) - int(np.argmin(tail[::-1])) if not tail.all() else 0
            if begin:
                yield from out(pd.concat([*held, batch.iloc[:begin]]))
                held = [batch.iloc[begin:]]
            elif held and not (held[-1][keys].iloc[-1] == last).all():
                yield from out(pd.concat(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield from out(pd.concat(held))

    return together.mapInPandas(verify, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id) for each row of docs."""
    prints = cut(fingerprints(docs, words, id_col, text_col))
    each = cut(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    found = components(links(each, distance)).withColumnRenamed("node", "fp")
    members = cut(each.select("fp", "first").join(found, "fp"))
    total = each.agg(F.count("*").alias("prints"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    smallest = members.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    linked = join_skewed(members.select("fp", "component"), smallest, "component", total["prints"]).select("fp", "component_id")
    # alone, a fingerprint's component is its own smallest id; in a component of null ids only, that is null too
    by_print = cut(each.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id")))
    return join_skewed(prints, by_print, "fp", total["rows"]).select(F.col("id").alias(id_col), "fp", "component_id")
