"""Near-duplicates by the Jaccard similarity of word shingles: the SimHash operator's form for a similarity.

The SimHash operator's links come first: its fingerprints and its search, 4 or fewer differing bits. They can't carry this
contract alone: at a similarity of 0.8 two texts differ in about 10 of 64 bits, and in up to 24, where unrelated ones meet.
So texts that share a band of MinHash values are candidates too: with BANDS bands of ROWS values, a pair at similarity 0.8
shares none with probability (1 - 0.8 ** 4) ** 24, about 3 in a million, and fewer above. Every link of either kind is then
verified on the shingle sets themselves, so no pair below the threshold links.

Equal word sequences, by a digest of 128 bits, are one node from the start. A band's nodes are first compared with one of
their number only, the least; the links found contract the graph. Then nodes of a band that are still apart and whose sizes
allow the threshold are compared pair by pair: in bands of few nodes by a join, in others within tasks, which hold the
shingle sets of two blocks of a band at most, count all shared shingles at once and let out a spanning forest of the links.
There the nodes outside of the band's largest component meet all, so a band of one large component and a few others is sent
once, not once a block. A band that very many nodes share is broadcast to where its nodes are and cut into blocks; no task
gets all of it. Texts move once, those of nodes that share a band only, and copies are folded before.

Defined results. Null or blank texts are one node. A text of fewer words than a shingle is one shingle. Repeated rows and
null ids are rows like any other. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, at_most, join_skewed, small_batches
from .components import components
from .simhash import Forest, fingerprint, shingle_hashes
from .simhash import links as simhash_links

BANDS, ROWS = 24, 4
#: Words of a shingle and differing bits at most in SimHash, as in its own operator.
PRINT_WORDS, DISTANCE = 4, 4
#: Bands of up to FEW nodes are joined with themselves; larger ones are cut into blocks.
FEW, BLOCK = 8, 1024
#: Bytes of shingle hashes that a block holds on average, and columns of the table that counts shared ones.
BLOCK_BYTES, WIDTH = 32 << 20, 4096
_RANDOM = np.random.default_rng(42)
FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
ADDED = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def node(text: str | None) -> tuple[int, int]:
    """A digest of the word sequence, A-Z lower-cased, as two signed longs."""
    x = xxhash.xxh3_128_digest(b" ".join((text or "").encode().lower().split()))
    return int.from_bytes(x[:8], "big", signed=True), int.from_bytes(x[8:], "big", signed=True)


def bands(hashes: np.ndarray, chunk: int = 4096) -> list[int]:
    """A digest for each band of MinHash values; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), chunk):
        least = np.minimum(least, (hashes[k : k + chunk, None] * FACTORS + ADDED).min(axis=0))
    own = least.astype("<u8").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(own[k].tobytes(), k) for k in range(BANDS)]


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two arrays of different hashes have the Jaccard similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (len(a) + len(b) - both) - 1e-9


def sketches(docs: DataFrame, words: int, text_col: str, *keep) -> DataFrame:
    """(*keep, h1, h2, size, fp, bands) for each row; fp: the SimHash fingerprint."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("h1 long, h2 long, size int, fp long, bands array<long>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for x in texts:
                own = np.unique(shingle_hashes(x, words))
                rows.append((*node(x), len(own), fingerprint(shingle_hashes(x, PRINT_WORDS)), np.array(bands(own), np.uint64).astype(np.int64)))
            yield pd.DataFrame(rows, columns=["h1", "h2", "size", "fp", "bands"])

    return docs.select(*keep, made(F.coalesce(F.col(text_col), F.lit(""))).alias("__s")).select("*", "__s.*").drop("__s")


def texts_of(docs: DataFrame, linked: DataFrame, text_col: str, max_broadcast: int = 500_000) -> DataFrame:
    """(node, text) for linked(node, t1, t2): the text with that digest. A few digests are broadcast, so other texts stay where they are; else all are shuffled, copies folded first."""
    rows = docs.select(*text_digest(F.col(text_col)), F.col(text_col).alias("text"))
    if at_most(linked, max_broadcast):
        return rows.join(F.broadcast(linked), ["t1", "t2"]).groupBy("node").agg(F.first("text").alias("text"))
    return rows.groupBy("t1", "t2").agg(F.first("text").alias("text")).join(linked, ["t1", "t2"]).select("node", "text")


def text_digest(text) -> list:
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit(1), whole).alias("t2")]


def verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs(a, b, …) whose texts(node, text) have the similarity."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    held = pairs.join(two, "b").join(one, "a")

    @F.pandas_udf(T.BooleanType())
    def holds(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        seen: dict[str, np.ndarray] = {}

        def shingles(x: str) -> np.ndarray:
            if x not in seen:
                if len(seen) >= 64:
                    seen.pop(next(iter(seen)))
                seen[x] = np.unique(shingle_hashes(x, words))
            return seen[x]

        for left, right in batches:
            yield pd.Series([similar(shingles(x or ""), shingles(y or ""), threshold) for x, y in zip(left, right, strict=True)], dtype="bool")

    return held.where(holds("text_a", "text_b")).select(*pairs.columns)


def simhash_pairs(nodes: DataFrame, own: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes(node, size, fp), with size_a and size_b, that SimHash links: each node with the first of its fingerprint, and the firsts of two fingerprints that the operator's search links."""
    first = own.cut(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("c"), F.count("*").alias("n")), "firsts")
    same = join_skewed(nodes.select("fp", "node", "size"), first.where("n > 1"), "fp", nodes.count()).where(F.col("node") != F.col("c.node"))
    near = own.cut(simhash_links(first.select("fp"), DISTANCE).distinct(), "near")
    a, b = first.select(F.col("fp").alias("a"), F.col("c").alias("x")), first.select(F.col("fp").alias("b"), F.col("c").alias("y"))
    firsts = near.join(a, "a").join(b, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    pairs = firsts.unionByName(same.select(F.col("c").alias("x"), F.struct("node", "size").alias("y")))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.size").alias("size_a"), F.col("y.size").alias("size_b"))


def near_groups(docs: DataFrame, words: int = 5, threshold: float = 0.8, text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """(*keep, component) for each row: the component joins rows by links of the similarity. What it writes on the way is deleted but for two tables that the result is read from."""
    own = Scratch(docs.sparkSession)
    prints = own.cut(sketches(docs, words, text_col, *keep, *text_digest(F.col(text_col))), "prints")
    first = prints.groupBy("h1", "h2").agg(F.first(F.struct("t1", "t2", "size", "fp", "bands")).alias("x"))
    nodes = own.cut(first.select("h1", "h2", "x.*").withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = nodes.select("node", "size", F.explode("bands").alias("value"))
    shared = own.cut(rows.groupBy("value").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("c")).where("n > 1"), "shared")  # bands of one node go
    members = own.cut(join_skewed(rows, shared.withColumn("of", F.col("n")), "value", BANDS * nodes.count()), "members")
    fits = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y) - 1e-9
    prints_near = own.cut(simhash_pairs(nodes, own).where(fits(F.col("size_a"), F.col("size_b"))).select("a", "b"), "simhash")
    ends = members.select("node").unionByName(prints_near.select(F.explode(F.array("a", "b")).alias("node")))
    linked = nodes.join(ends.distinct(), "node", "left_semi").select("node", "t1", "t2")
    texts = own.cut(texts_of(docs, linked, text_col), "texts")

    stars = members.where((F.col("node") != F.col("c.node")) & fits(F.col("size"), F.col("c.size"))).select(F.col("c.node").alias("a"), F.col("node").alias("b"))
    links = own.cut(verified(stars.unionByName(prints_near).distinct(), texts, words, threshold), "links")
    found = components(links)
    # what is left: nodes of one band in different components
    placed = own.cut(members.join(found, "node", "left").select("value", "node", "size", "of", F.col("c.node").alias("centre"), F.coalesce("component", "node").alias("c")), "placed")
    by_group = placed.groupBy("value", "c").agg(F.count("*").alias("n"), F.sum("size").alias("sizes"))
    figures = [F.count("*").alias("groups"), F.max_by(F.struct("c", "n", "sizes"), F.struct("n", "c")).alias("major"), F.sum("n").alias("n"), F.sum("sizes").alias("sizes")]
    open_ = own.cut(by_group.groupBy("value").agg(*figures).where("groups > 1").drop("groups"), "open")
    left = own.cut(join_skewed(placed, open_, "value", BANDS * nodes.count()), "left")
    few = left.where(F.col("of") <= FEW)
    other = few.select("value", F.col("node").alias("b"), F.col("size").alias("size2"), F.col("c").alias("cb"))
    apart = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.col("a") != F.col("centre"))  # the centre, the least, has been compared
    small = few.select("value", "size", "centre", F.col("node").alias("a"), F.col("c").alias("ca")).join(other, "value").where(apart & fits(F.col("size"), F.col("size2"))).select("a", "b", "ca", "cb").distinct()
    more = own.cut(verified(small, texts, words, threshold).select("ca", "cb").unionByName(in_blocks(left.where(F.col("of") > FEW), texts, words, threshold)).distinct(), "more")
    joined = components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("c"), F.col("component").alias("last"))
    each = nodes.select("h1", "h2", "node").join(found, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("c"))
    final = own.cut(each.join(joined, "c", "left").select("h1", "h2", F.coalesce("last", "c").alias("component")), "final")
    own.drop("nodes", "shared", "members", "firsts", "near", "simhash", "texts", "links", "placed", "open", "left", "more")
    return prints.drop("t1", "t2", "size", "fp", "bands").join(final, ["h1", "h2"]).drop("h1", "h2")


def in_blocks(members: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """Links (ca, cb) of components among members(value, major, sizes, of, node, size, c) of one value: enough to join all components that have one."""

    @F.pandas_udf(T.BinaryType())
    def shingled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(shingle_hashes(x, words)).astype("<u8").tobytes() for x in texts], dtype=object)

    sets = texts.join(members.select("node").distinct(), "node", "left_semi").select("node", shingled(F.coalesce("text", F.lit(""))).alias("shingles"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.greatest(n / BLOCK, size * 8 / BLOCK_BYTES))).cast("int")
    sized = members.join(sets, "node").withColumns({"m": blocks(F.col("of"), F.col("sizes")), "k": blocks(F.col("of") - F.col("major.n"), F.col("sizes") - F.col("major.sizes")), "minor": F.col("c") != F.col("major.c")})
    # a group is a block of all nodes with a block of those outside of the largest component
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    everywhere = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = sized.select("value", "node", "c", "shingles", at("m").alias("x"), F.explode(everywhere("k")).alias("y"))
    dealt = dealt.unionByName(sized.where("minor").select("value", "node", "c", "shingles", F.explode(everywhere("m")).alias("x"), at("k").alias("y")))

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node")  # both as one of all and as one outside
        c, code = np.unique(group["c"].to_numpy(), return_inverse=True)
        sets, forest = [np.frombuffer(x, "<u8") for x in group["shingles"]], Forest(len(c))
        size = np.array([len(s) for s in sets])
        shared = common(sets)
        likely = np.argwhere(np.triu(shared >= threshold * (size[:, None] + size[None] - shared) - 1e-9, 1) & (code[:, None] != code[None]))
        for i, j in likely.tolist():
            forest.join(int(code[i]), int(code[j]))
        return pd.DataFrame([(min(c[i], c[j]), max(c[i], c[j])) for i, j in forest.links], columns=["ca", "cb"], dtype="int64")

    return dealt.groupBy("value", "x", "y").applyInPandas(linked, "ca bigint, cb bigint")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1  # only values that two sets have
    row, col = row[count[col] > 1], place[col[count[col] > 1]]
    order, out = np.argsort(col, kind="stable"), np.zeros((n, n))
    row, col = row[order], col[order]
    for begin in range(0, int(col[-1]) + 1 if len(col) else 0, WIDTH):
        lo, hi = np.searchsorted(col, [begin, begin + WIDTH])
        own = np.zeros((n, WIDTH), np.float32)
        own[row[lo:hi], col[lo:hi] - begin] = 1
        out += own @ own.T
    return out
