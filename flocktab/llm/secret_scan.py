"""Secret scans: an incremental ledger of blobs.

Every version of every file is addressed by its content, the SHA-256 of its text. The ledger holds which rules, each in
which version, have scanned which blob, and what they found. A scan hashes the versions that arrive, keeps one text a
blob (copies are folded in the map tasks first, so a text that a third of all rows share is no heavy key), joins the blobs
with the ledger, and applies to each blob just the rules that have not seen it: a pair of blob and rule version is scanned
once, however many paths and versions share the blob and however often they come again. A rule's version is a digest of
its definition, so a changed rule scans everything anew and an unchanged one nothing. Findings go back to all paths by one
join on the address; texts do not take part in it.

A scan writes one folder in a single job; a folder counts once Spark has committed it, so a scan that died left nothing.
Two scans at a time may do a pair twice, with the same result; the ledger's readers fold them. All of it is DataFrame
functions: offsets come from the pieces between matches, by prefix sums in blocks.

Defined results. Null text: the empty one. Repeated rows, ids that repeat or are null: each row gets its blob's findings.
A very long text is scanned whole in one task, its offsets take the square root of the matches for each match. An empty
table gives an empty table, and a scan of it an empty folder. Other columns stay; `spans` and `first_scan` are replaced.
A version whose blob lacks a scan of one of the rules has null spans.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let

SPAN = "array<struct<rule: string, start: int, end: int>>"
#: Steps that a prefix sum takes at a time.
BLOCK = 64


class Rule(NamedTuple):
    """A kind of secret: matches of a pattern, leftmost and not overlapping, whose group has `least` code points or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(repr(tuple(self)).encode()).hexdigest()[:12]}"


# The contract's three kinds. In the two of one character class a match that is too short can't hide a longer one, so the least length stands in the pattern.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
]
#: Further kinds: heads of private keys, signed web tokens, passwords in addresses.
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("userinfo", r"://[^\s/:@]+:[^\s/:@]+@"),
]
RULES = BASE + MORE


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def running(steps: Column) -> Column:
    """Sums of an array up to each element, itself included: whole blocks first, then the rest of the element's own block."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(steps, b * BLOCK + 1, BLOCK)))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    before = lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
    return let(let(blocks, before), lambda had: F.transform(steps, lambda _, i: F.get(had, block(i)) + total(F.slice(steps, block(i) * BLOCK + 1, i % BLOCK + 1))))


def found(text: Column, rule: Rule) -> Column:
    """The rule's spans of a text, in code points, ends exclusive."""
    matches = lambda group: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group))

    def placed(m: Column, pieces: Column, tested: Column) -> Column:
        steps = F.transform(m, lambda _, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0))
        spans = let(steps, lambda s: F.transform(running(s), lambda at, i: F.struct(F.lit(rule.version).alias("rule"), at.alias("start"), (at + F.length(F.get(m, i))).alias("end"))))
        return F.filter(spans, lambda _, i: F.length(F.get(tested, i)) >= rule.least)

    made = let(F.struct(matches(0).alias("m"), F.split(text, rule.pattern, -1).alias("p"), (matches(rule.group) if rule.group else matches(0)).alias("t")), lambda x: placed(x["m"], x["p"], x["t"]))
    return F.when(text.rlike(rule.pattern), made.cast(SPAN)).otherwise(F.array().cast(SPAN))


class Ledger:
    """A ledger of blobs in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _scans(self) -> list[str]:
        """Folders of the scans that were committed: one a scan."""
        Path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = Path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(x.getPath().getParent().toString() for x in fs.globStatus(Path(f"{self.folder}/scan-*/_SUCCESS")) or [])

    def entries(self) -> DataFrame:
        """(blob, rules, spans, scan): what each scan did; a blob has one row for each scan that found it new to a rule."""
        schema = f"blob binary, rules array<string>, spans {SPAN}, scan int"
        scans = self._scans()
        return self.spark.read.schema(schema).parquet(*scans) if scans else self.spark.createDataFrame([], schema)

    def blobs(self, rules: list[Rule] = RULES) -> DataFrame:
        """(blob, rules, spans, first_scan): one row a blob, of its rules and spans those of these rule versions. As many rows a blob are folded as there were rule changes."""
        versions = F.array(*[F.lit(r.version) for r in rules])
        own = self.entries().select("blob", F.array_intersect("rules", versions).alias("rules"), F.filter("spans", lambda s: F.array_contains(versions, s["rule"])).alias("spans"), "scan")
        flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        return own.groupBy("blob").agg(flat("rules"), flat("spans"), F.min("scan").alias("first_scan"))

    def scan(self, versions: DataFrame, rules: list[Rule] = RULES, number: int = 0, text_col: str = "text") -> None:
        """Scans the texts of versions with the rules that have not seen them; number is noted as the scan's."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        blobs = versions.select(address(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        none = F.array().cast("array<string>")
        todo = F.array_except(F.array(*[F.lit(r.version) for r in rules]), F.coalesce("rules", none))
        new = blobs.join(self.blobs(rules).select("blob", "rules"), "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)
        spans = [F.when(F.array_contains("todo", r.version), found(F.col("text"), r)).otherwise(F.array().cast(SPAN)) for r in rules]
        new.select("blob", F.col("todo").alias("rules"), F.concat(*spans).alias("spans"), F.lit(number).alias("scan")).write.parquet(f"{self.folder}/scan-{number:06d}-{uuid.uuid4().hex}")

    def findings(self, versions: DataFrame, rules: list[Rule] = RULES, text_col: str = "text") -> DataFrame:
        """versions less their texts, with spans (kind, start, end; by start, then as the rules are listed) and first_scan, the least number of a scan that had the blob."""
        place = {r.version: k for k, r in enumerate(rules)}
        order = F.create_map(*[x for v, k in place.items() for x in (F.lit(v), F.lit(k))])
        kinds = F.array(*[F.lit(r.kind) for r in rules])
        keyed = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[s["rule"]].alias("k"), s["end"].alias("end"))))
        listed = F.transform(keyed, lambda s: F.struct(F.get(kinds, s["k"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        # written, so that both sides of the join are plain shuffles and Spark can split the rows of a common blob
        known = cut(self.blobs(rules).select(F.col("blob").alias("__blob"), F.when(F.size("rules") == len(rules), listed).alias("spans"), "first_scan"))
        held = versions.withColumn("__blob", address(F.col(text_col))).drop(text_col, "spans", "first_scan")
        return held.join(known, "__blob", "left").drop("__blob")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
