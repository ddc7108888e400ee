"""Quality rules: a short-circuit cascade whose order comes from costs and rejection rates measured on a sample.

The base figures (symbols, duplicate lines, repeated windows, ...) are computed for every document. The further rules
are tried one after another and stop at the first that rejects. The order is made rule by rule on a sample of at most
`sample_rows` documents that pass the base rule: the next rule is that with most rejections a second among the documents
that no rule before it rejects. One job applies all rules to each document of the sample REPEATS times, with the clock read
between them; the later half counts, when code is compiled. The sample is of
texts of at most SAMPLE_CHARS characters from the first partitions that have enough, so no partition is read for it that
need not be. The order changes the work, never the verdict. Everything is DataFrame functions within a row: no shuffle.

Defined results. Null text: no words, so the base rule rejects it. An empty table, or a sample that is: the order is the
given one. Repeated rows and null ids are judged like any other row. A very long text is judged whole, in its row. Columns
other than the text are neither read nor changed; the figures are returned in one struct, which replaces a column of its
name (`out_col`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
#: How often a rule is applied to time it, and the longest text of the sample.
REPEATS, SAMPLE_CHARS = 4, 20_000

Rule = Callable[[Column, Column, Column], Column]


def _count(text: Column, others: str) -> Column:
    """Characters left when all that match `others` are gone."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _word_lengths(text, words, m):
    return (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])


def _symbols(text, words, m):
    return 10 * m["n_symbols"] > m["n_words"]


def _same_lines(text, words, m):
    return (m["n_dup_lines"] >= 3) & (10 * m["n_dup_lines"] > 3 * m["n_full_lines"])  # one or two repeats are no pattern


def _shouting(text, words, m):
    return 10 * _count(text, "[^A-Z]+") > 4 * m["word_chars"]


def _exclaiming(text, words, m):
    return 2 * _count(text, "[^!]+") > m["n_words"]


def _no_letters(text, words, m):
    return 10 * F.size(F.filter(words, lambda w: ~w.rlike(r"[A-Za-z]|[^\x00-\x7F]"))) > 3 * m["n_words"]


def _stutter(text, words, m):
    return 10 * F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))) > 3 * m["n_words"]


#: name -> rule(text, words, figures), true where it rejects.
RULES: dict[str, Rule] = {"word_lengths": _word_lengths, "symbols": _symbols, "same_lines": _same_lines, "shouting": _shouting, "exclaiming": _exclaiming, "no_letters": _no_letters, "stutter": _stutter}


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more. The sort runs only for documents that have one."""

    def covered(pairs: Column) -> Column:
        same = lambda e, other: F.coalesce(e["h"] == other["h"], F.lit(False))
        starts = F.sort_array(F.transform(F.filter(pairs, lambda e, i: same(e, F.get(pairs, i + 1)) | same(e, F.get(pairs, i - 1))), lambda e: e["i"]))
        steps = lambda p: F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW))))
        return F.aggregate(let(starts, steps), F.lit(0).cast("long"), lambda acc, n: acc + n)

    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(by_hash, covered))


def _figures(text: Column, words: Column) -> Column:
    n = F.size(words)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    n_lines = let(lines, lambda own: F.struct(F.size(own).cast("long").alias("all"), (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("same")))
    return let(n_lines, lambda own: F.struct(
        n.cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), _count(text, r"[^#*$%&|<>]+").alias("n_symbols"), own["all"].alias("n_full_lines"),
        own["same"].alias("n_dup_lines"), let(windows, lambda hashes: _repeat_words(words, hashes)).alias("n_repeat_words")))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


FIGURES = ["n_words", "word_chars", "n_symbols", "n_full_lines", "n_dup_lines", "n_repeat_words"]


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def order_rules(docs: DataFrame, rules: dict[str, Rule], text_col: str = "text", sample_rows: int = 1000) -> list[str]:
    """Names of the rules, each the best in rejections a second of what those before it leave; ties keep the given order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = docs.select(text.alias("text")).where(F.length("text") <= SAMPLE_CHARS).take(sample_rows)  # bounded, and as few partitions as give them
    some = docs.sparkSession.createDataFrame(some, "text string").coalesce(1)  # timed in one task
    text, words, m = F.col("text"), F.col("__words"), F.col("__m")
    some = some.select("text", let(_words(text), lambda w: F.struct(w.alias("words"), _figures(text, w).alias("m"))).alias("x")).select("text", F.col("x.words").alias("__words"), F.col("x.m").alias("__m"))
    often = some.where(~base_failed(m)).withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    now = lambda: F.java_method(F.lit("java.lang.System"), F.lit("nanoTime")).cast("bigint")
    # a row's columns are computed one after another, so a rule's time is what lies between the two beside it
    steps = [x for k, rule in enumerate(rules.values()) for x in (F.coalesce(rule(text, words, m), F.lit(False)).alias(f"f{k}"), now().alias(f"t{k}"))]
    timed = often.select("__again", now().alias("first"), now().alias("begin"), *steps).collect()  # numbers and flags of the sample
    warm = [r for r in timed if r["__again"] > REPEATS // 2]  # code is compiled by then
    empty = sum(r["begin"] - r["first"] for r in warm)
    before = lambda r, k: r[f"t{k - 1}"] if k else r["begin"]
    cost = [max(sum(r[f"t{k}"] - before(r, k) for r in warm) - empty, 1) for k in range(len(rules))]
    left, order, names = [[r[f"f{k}"] for k in range(len(rules))] for r in timed if r["__again"] == REPEATS], [], list(rules)
    while len(order) < len(names):
        worth = {k: sum(r[k] for r in left) / cost[k] for k, name in enumerate(names) if name not in order}
        best = max(worth, key=lambda k: worth[k])
        order.append(names[best])
        left = [r for r in left if not r[best]]
    return order


def judge(docs: DataFrame, text_col: str = "text", rules: dict[str, Rule] | None = None, order: list[str] | None = None, out_col: str = "quality") -> DataFrame:
    """docs with `out_col`: a struct of the base figures, base_failed, rejected_by (name of the first rule that rejects, else null) and kept."""
    rules = RULES if rules is None else rules
    order = order_rules(docs, rules, text_col) if order is None else order
    text = F.coalesce(F.col(text_col), F.lit(""))

    def verdict(words: Column, m: Column) -> Column:
        out = F.when(base_failed(m), F.lit("base"))
        for name in order:
            out = out.when(rules[name](text, words, m), F.lit(name))
        return out

    # one expression, its parts bound once: a filter on the verdict that Spark pushes down cannot multiply them
    judged = let(_words(text), lambda w: let(_figures(text, w), lambda m: let(
        verdict(w, m), lambda by: F.struct(*[m[c].alias(c) for c in FIGURES], base_failed(m).alias("base_failed"), by.alias("rejected_by"), by.isNull().alias("kept")))))
    return docs.withColumn(out_col, judged)
