"""URL filters: allow and block rules, and for URLs that no rule fits a logistic regression on hashed character n-grams.

A rule is a host with a path prefix ("example.org/es/"); it fits its host and all subdomains where the URL's path
starts with the rule's, and the longest fitting rule decides (of equally long ones the first in text order). The
regression's features are the hashed 3- and 4-grams of host and path, marked by which of the two they come from; it is
trained with spark.ml on a small labelled table of at most `max_rows` URLs. Rules are a short list given as a
parameter and become one CASE expression; everything runs as DataFrame functions and spark.ml in the JVM, within a
row, without a shuffle of the pages.

Defined results. Null URL or one without "://": host and path empty; the regression then has its intercept only. No
labelled row: all are allowed; labels of one class only: all get that class. Repeated rows and null ids are judged row
by row. A very long URL has as many n-grams as characters, in its row. An empty table gives an empty table. Other columns
stay as they are, but for columns named host, path, rule, rule_verdict, blocked or verdict, which the new ones replace or
take away.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

FEATURES = 1 << 14


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):  # the last one set is tried first
        at = rule.index("/") if "/" in rule else len(rule)
        own, prefix = rule[:at], rule[at:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _verdict(rule: Column, rules: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules.items():
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def _grams(host: Column, path: Column) -> Column:
    def of(text: Column, mark: str) -> Column:
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - (n - 1), F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))))
        return F.concat(cut(3), cut(4))

    return F.array_distinct(F.concat(of(host, "h"), of(path, "p")))


class UrlModel:
    """Adds `blocked` (probability) to a table with host and path."""

    def __init__(self, fitted, constant: float):
        self.fitted, self.constant = fitted, constant

    def add(self, urls: DataFrame) -> DataFrame:
        if self.fitted is None:
            return urls.withColumn("blocked", F.lit(self.constant))
        from pyspark.ml.functions import vector_to_array

        made = _hashed().transform(urls.withColumn("__grams", _grams(F.col("host"), F.col("path"))))
        return self.fitted.transform(made).withColumn("blocked", vector_to_array("__probability")[1]).drop("__grams", "__features", "__raw", "__probability", "__predicted")


def _hashed() -> HashingTF:
    return HashingTF(inputCol="__grams", outputCol="__features", numFeatures=FEATURES, binary=True)


def train(labelled: DataFrame, max_rows: int = 2000) -> UrlModel:
    """labelled(host, path, block: 0/1), of which the first max_rows by hash are taken."""
    few = labelled.where(F.col("block").isNotNull()).select("host", "path", F.col("block").cast("double").alias("label")).distinct()
    few = few.orderBy(F.xxhash64("host", "path"), "label").limit(max_rows).repartition(1).cache()  # max_rows short rows
    try:
        classes = sorted(r["label"] for r in few.select("label").distinct().collect())
        if len(classes) < 2:
            return UrlModel(None, classes[0] if classes else 0.0)
        regression = LogisticRegression(featuresCol="__features", labelCol="label", probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__predicted", regParam=0.01, maxIter=25)
        return UrlModel(regression.fit(_hashed().transform(few.withColumn("__grams", _grams(F.col("host"), F.col("path"))))), 0.0)
    finally:
        few.unpersist()


def parse(urls: DataFrame, rules: dict[str, str], url_col: str = "url") -> DataFrame:
    """urls with host, path, rule (or null) and rule_verdict (or null)."""
    made = urls.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))}).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    return made.withColumn("rule_verdict", _verdict(F.col("rule"), rules))


def judge(urls: DataFrame, rules: dict[str, str], model: UrlModel, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """urls with host, path, rule, blocked (the regression's probability) and verdict (allow or block)."""
    by_model = F.when(F.col("blocked") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return model.add(parse(urls, rules, url_col)).withColumn("verdict", F.coalesce("rule_verdict", by_model)).drop("rule_verdict")
