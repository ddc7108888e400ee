"""Line dedup: drop lines that many documents share, all but the ones in the last document that holds them.

Method: the hashes of the lines are range-partitioned with a secondary sort by document and position, and one
streaming pass over each partition ranks the occurrences of every hash. Only row_number-like window functions over sorted
rows are used, so no group is ever held in memory. A hash that a third of all lines share would still fall to one task;
each hash is therefore spread over `salts` slices of the documents, and what is cut into ranges is the hash of line and
slice: uniform, so cut evenly, without a look at the data. The pass over a slice settles every occurrence beyond the slice's first `min_docs`
documents by itself; only the first `min_docs` documents of each slice go on to a second pass that ranks them across
slices. Both passes together are exact.

What the passes return is not text but, for each document that loses lines, a sparse bitmap: (word, bits) pairs, a set
bit for a dropped line, words without a set bit left out. They are written once, counted, and broadcast if they are few
bytes; else the documents are shuffled to meet them. Everything here is DataFrame functions.

Defined results. Null text: one empty line. A null id counts as one more document that sorts before all others. Rows
that repeat an id are one document when documents are counted, and each row keeps its own lines. A very long text or
line is hashed within its task, in time linear in its lines; only hashes leave it. An empty table gives an empty table. Other columns stay as they
are, but for columns that have the names of the two counts, which the new ones replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, cut, let

#: Bytes of bitmaps that are broadcast at most; of more, documents are shuffled to meet theirs.
MAX_BROADCAST = 16 << 20


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, salts: int = 1024) -> DataFrame:
    """One row (id, text_hash, drops) for each document that loses lines; drops: array of (word, bits), by word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.split(text, "\n").alias("lines"))  # beside the explode, the hash would be made for each line
    lines = base.select("id", "text_hash", F.posexplode_outer("lines").alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(BLANKS)), UPPER, LOWER)
    keyed = lines.withColumn("key", key).where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.pmod(F.hash("id"), F.lit(salts)).alias("slice"), "id", "text_hash", "pos")
    newest = F.col("id").desc_nulls_last()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = F.shiftright(F.xxhash64("h1", "h2", "slice"), 32) + F.lit(1 << 31)  # 0 to 2 ** 32, evenly, however often a key occurs
    ordered = keyed.withColumn("range", F.shiftright(top * n, 32).cast("int")).repartitionById(n, "range").sortWithinPartitions("range", "h1", "h2", "slice", newest, "pos")
    in_slice = Window.partitionBy("range", "h1", "h2", "slice").orderBy(newest)
    first = ordered.withColumn("rank", F.dense_rank().over(in_slice))  # by document: a line's repeats in one document share a rank
    # beyond the slice's first min_docs documents all is settled; those rows go on as groups of their own
    settled = F.col("rank") > min_docs
    first = first.withColumn("apart", F.when(settled, F.xxhash64("id", "pos"))).drop("range", "slice", "rank")
    by_key = Window.partitionBy("h1", "h2", "apart")
    ranked = first.withColumn("rank", F.dense_rank().over(by_key.orderBy(newest))).withColumn("n_docs", F.max("rank").over(by_key))
    dropped = ranked.where(F.col("apart").isNotNull() | ((F.col("rank") > 1) & (F.col("n_docs") >= min_docs))).select("id", "text_hash", "pos")
    words = (dropped.distinct().repartition("id", "text_hash")
             .groupBy("id", "text_hash", F.floor(F.col("pos") / 64).cast("int").alias("word"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)).alias("bits")))
    return words.groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, salts: int = 1024, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with its text less the dropped lines, and two counts: lines before, and lines dropped. All other columns stay."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs, salts).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("drops").alias("__drops"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    maps = cut(maps)
    if maps.agg(F.coalesce(F.sum(64 + 16 * F.size("__drops")), F.lit(0))).first()[0] <= MAX_BROADCAST:
        maps = F.broadcast(maps)  # documents stay where they are
    held = docs.withColumns({"__hash_of": F.xxhash64(text)})
    joined = held.join(maps, held[id_col].eqNullSafe(maps["__id"]) & (held["__hash_of"] == maps["__hash"]), "left")
    lines = F.split(text, "\n")

    def kept(own: Column) -> Column:
        """The lines whose bit is not set. The bitmap becomes an array with a place for each 64 lines, so a line's bit is one step away."""
        n_words = F.ceil(F.size(own) / 64).cast("int")
        gaps = F.transform("__drops", lambda x, k: F.struct((x["word"] - F.when(k > 0, F.get("__drops", k - 1)["word"]).otherwise(-1) - 1).alias("before"), x["bits"].alias("bits")))
        zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
        last = F.element_at("__drops", -1)["word"]
        dense = F.concat(F.flatten(F.transform(gaps, lambda g: F.concat(zeros(g["before"]), F.array(g["bits"])))), zeros(n_words - last - 1))
        bit = lambda words, pos: F.call_function("shiftright", F.get(words, F.floor(pos / 64).cast("int")), pos % 64).bitwiseAND(F.lit(1).cast("long"))
        return let(dense, lambda words: F.array_join(F.filter(own, lambda line, pos: bit(words, pos) == 0), "\n"))

    left = F.when(F.col("__drops").isNull(), text).otherwise(let(lines, kept))
    n_dropped = F.coalesce(F.aggregate("__drops", F.lit(0), lambda acc, x: acc + F.bit_count(x["bits"])), F.lit(0))
    return joined.withColumns({counts[0]: F.size(lines).cast("long"), counts[1]: n_dropped.cast("long"), text_col: left}).drop("__hash_of", "__id", "__hash", "__drops")
