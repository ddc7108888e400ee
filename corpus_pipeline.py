"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), docs as its predecessor left them, and works on all of them. All but the last
return the columns of documents; n_chars follows the text. Null and repeated ids: every row is judged by its own text,
and the third stage keeps one row of each group of near copies, the smallest id's, a null id last, then by the row's hash.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flocktab.llm import bpe, decontaminate, jaccard, line_dedup, quality
from flocktab.llm.common import Scratch, at_most, row_digest, shared_dir, table


#: Digests of rows in groups of near copies that are broadcast at most; of more, all rows are shuffled to meet them.
MAX_BROADCAST = 500_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every rule of the cascade."""
    return quality.judge(docs, out_col="__quality").where("__quality.kept").drop("__quality")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share."""
    return line_dedup.dedup_lines(docs, counts=("__lines", "__dropped")).drop("__lines", "__dropped").withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that links of similarity 0.8 or more join, in shingles of five words: that with the smallest id.

    Links are those of SimHash, as op3 finds them, and those of MinHash bands, which find the pairs that SimHash's four bits miss; all are verified."""
    held = docs.withColumn("__row", row_digest(docs))
    rows = jaccard.near_groups(held, words=5, threshold=0.8, keep=("doc_id", "__row"))
    # by row, not by id: ids may be null or repeat; nulls last
    by_row = rows.groupBy("component", "__row").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("x"), F.count("*").alias("n"))
    first = by_row.groupBy("component").agg(F.min("x").alias("x"), F.count("*").alias("rows"), F.min("n").alias("n"))
    # a group of one row stays as it is; of others the first row stays, once
    several = Scratch(spark).cut(first.where("rows > 1 or n > 1").select("component", F.col("x.__row").alias("first")), "several")
    marks = rows.join(several, "component").select("__row", (F.col("__row") == F.col("first")).alias("stays")).distinct()
    marks = Scratch(spark).cut(marks, "marks")
    if at_most(marks, MAX_BROADCAST):
        marks = F.broadcast(marks)
    marked = held.join(marks, "__row", "left")
    return marked.where("stays is null").select(*docs.columns).unionByName(marked.where("stays").dropDuplicates(["__row"]).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as digests, and their decoded bytes'."""
    coded = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", lines), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("byte_bpe", encoding)]

#: SQL has neither XXH64 nor byte-pair merging; tests/llm compares the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
