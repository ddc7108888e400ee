"""Benchmark decontamination: find, and remove, document words that lie in an n-gram of a benchmark item.

Method: the normalised n-grams of the benchmark form a hash set that is broadcast; every document is scanned once, its
token windows are hashed and looked up, and a hit is verified word for word. The n-grams are counted first: a set of
more than `max_broadcast` n-grams is not broadcast but joined by a shuffle of the windows. An item with fewer words
than `n` is one window of its own length. Hits are few, so only they and one row a document are shuffled; window rows
without a hit end in the task that made them. On the shuffled way a window travels as its hash and place; its words stay
with the document and verify the hits when they come back. Everything is DataFrame functions.

Defined results. Null or empty text, in documents or items: no words, no hit. Null item ids take part as hits but are
not listed. Null ids are judged row by row; rows are told apart by a 128-bit digest of all their columns, rows that are
the same in all of them are judged once and returned as often as they came. A very long text is scanned in its task. Empty tables:
without documents no row, without items no hit. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, row_digest

#: After A-Z are lower-cased: a-z, 0-9 and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(WORD), F.lit(0))


def ngrams(bench: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row (h, gram, len, items) for each different window of the items."""
    items = bench.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))).alias("i")
    grams = items.select("item", "w", start).select("item", F.slice("w", F.col("i"), n).alias("gram"))
    return grams.groupBy("gram").agg(F.collect_set("item").alias("items")).select(F.xxhash64("gram").alias("h"), "gram", F.size("gram").alias("len"), "items")


def find_hits(docs: DataFrame, bench: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", max_broadcast: int = 200_000, keep_text: bool = True) -> DataFrame:
    """One row for each row of docs: __doc (struct of its columns), n_words, hits (sorted positions, from 0, of the words that are hit) and items."""
    grams = ngrams(bench, n, item_col)
    sizes = {r["len"]: r["n"] for r in grams.groupBy("len").agg(F.count("*").alias("n")).collect()}  # n rows at most
    small = sum(sizes.values()) <= max_broadcast
    kept = [c for c in docs.columns if keep_text or c != text_col]
    rows = docs.select(F.struct(*kept).alias("__doc"), row_digest(docs).alias("__row"), words_of(F.col(text_col)).alias("__w"))
    size = F.size("__w")
    fits = lambda length: F.greatest(size - (length - 1), F.lit(0))

    def windows(length: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), size - (length - 1)), lambda i: F.xxhash64(F.slice("__w", i, length)))
        return F.when(size >= length, made).otherwise(F.array().cast("array<bigint>"))

    # element 0 stands for the row itself, so that one pass gives rows and hits; the windows follow, length by length; outer only keeps Spark from computing the array twice
    hashes = F.concat(F.array(F.xxhash64("__row")), *[windows(k) for k in sorted(sizes)])
    scan = rows.withColumn("__h", hashes).select("__row", "__doc", "__w", F.posexplode_outer("__h").alias("__at", "h"))
    first, length, start = F.lit(1), F.lit(0), F.lit(0)
    for k in sorted(sizes):  # which window an element is: its length and its first word
        here = (F.col("__at") >= first) & (F.col("__at") < first + fits(k))
        length, start = F.when(here, k).otherwise(length), F.when(here, F.col("__at") - first).otherwise(start)
        first = first + fits(k)
    row = F.col("__at") == 0
    hit = F.struct(start.alias("at"), length.alias("len"))
    if small:
        # the words ride along uncopied: codegen writes them only for the few windows that find a partner
        found = scan.join(F.broadcast(grams), "h", "left").withColumn("__true", F.slice("__w", start + 1, length) == F.col("gram"))
        made = found.where(row | F.col("__true")).select("__row", "__at", F.when(row, F.col("__doc")).alias("__doc"), F.when(row, size.cast("long")).alias("n_words"), F.when(~row, hit).alias("hit"), F.when(~row, F.col("items")).alias("items"))
    else:
        once = scan.select("__row", "__at", "h", F.when(row, F.col("__doc")).alias("__doc"), F.when(row, F.col("__w")).alias("__w"), F.when(row, size.cast("long")).alias("n_words"), F.when(~row, hit).alias("hit"))
        made = once.join(grams, "h", "left").where(row | F.col("gram").isNotNull()).withColumn("items", F.when(~row, F.struct("hit", "gram", "items")))
    by_row = made.groupBy("__row").agg(F.first("__doc", ignorenulls=True).alias("__doc"), F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hit"), F.collect_set("items").alias("items"), F.count_if(row).cast("int").alias("__copies"),
                                       *([] if small else [F.first("__w", ignorenulls=True).alias("__w")]))
    if not small:
        true = F.filter("items", lambda x: F.slice("__w", x["hit"]["at"] + 1, x["hit"]["len"]) == x["gram"])
        by_row = by_row.withColumn("items", true).withColumn("hit", F.transform("items", lambda x: x["hit"])).withColumn("items", F.transform("items", lambda x: x["items"]))
    by_row = by_row.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies"))))
    positions = F.array_distinct(F.flatten(F.transform("hit", lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1))))
    return by_row.select("__doc", "n_words", F.sort_array(positions).alias("hits"), F.array_distinct(F.flatten("items")).alias("items"))


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 10, remove: str = "documents", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs without the documents that have a hit (remove="documents"), or without the words that are hit (remove="spans")."""
    found = find_hits(docs, bench, n, text_col, item_col)
    if remove == "documents":
        return found.where(F.size("hits") == 0).select("__doc.*")
    if remove != "spans":
        raise ValueError(f"remove is documents or spans, not {remove}")
    text = F.col(f"__doc.{text_col}")
    pieces = F.regexp_extract_all(text, F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|$)"), F.lit(0))
    left = F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains("hits", i)), "")
    return found.select(*[F.when(F.size("hits") == 0, text).otherwise(left).alias(c) if c == text_col else F.col(f"__doc.{c}") for c in docs.columns])
