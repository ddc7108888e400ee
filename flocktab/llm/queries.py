"""The registered queries of this subpackage: each applies one operator to a whole table. SQL for those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fim, line_dedup, quality, resample, secret_scan, shards, simhash, substring_dedup, toxicity, url_filter, warc
from .common import shared_dir, table

QUERIES = {}
ORACLE = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = lambda *names: [F.col(f"quality.{c}") for c in names]
    return quality.judge(docs).select("doc_id", *q("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))


ORACLE["op6_quality_rules"] = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
  row_number() OVER () AS r FROM documents),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
m AS (SELECT doc_id, text, w, l, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * len(l))
  OR 10 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 4 * word_chars OR 2 * length(regexp_replace(text, '[^!]+', '', 'g')) > n_words
  OR 10 * len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) > 3 * n_words
  OR 10 * coalesce(list_sum(list_transform(range(2, len(w) + 1), lambda i: CAST(w[i] = w[i - 1] AS INT))), 0) > 3 * n_words) AS kept
FROM b
"""


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE["op7_line_dedup"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, r, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
c AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.doc_id, k.r, k.i, k.line, c.key IS NOT NULL AND k.doc_id <> c.last AS dropped FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM f GROUP BY r, doc_id
"""


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(F.col("__doc.doc_id").alias("doc_id"), "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


ORACLE["op8_decontamination"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT r, i, n, item_id FROM win JOIN g USING (n, g)),
p AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
q AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)
"""


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    # a conversion to digests in Python as well would send the bytes to the workers a second time
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).select("doc_id", F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs).select("doc_id", "n_sentences", "n_removed", "removed_words", "text")


#: The rules of the query.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    parsed = url_filter.parse(pages, URL_RULES)
    labelled = parsed.where("rule_verdict is not null").select("host", "path", (F.col("rule_verdict") == "block").cast("int").alias("block"))
    return url_filter.judge(pages, URL_RULES, url_filter.train(labelled)).select("page_id", "host", "path", "rule", "verdict", "blocked")


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "nth")


ORACLE["op4_warc"] = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS body,
  regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''), '[\r\n]+', ' ', 'g'), '^.*?://', '', 's'), '#.*$', '', 's') AS rest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS chosen, regexp_extract(rest, '^[^/?]*') AS authority FROM p),
k AS (SELECT *, array_to_string(list_reverse(string_split(split_part(regexp_replace(lower(authority), '^.*@', '', 's'), ':', 1), '.')), ',') || ')' || coalesce(nullif(rest[length(authority) + 1:], ''), '/') AS url_key FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> chosen THEN chosen END AS refers_to, url_key, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS nth FROM k
"""


#: Arrivals of the query, and its fan-out: the second and the fourth fill the lowest tier, and then the next one is full too.
ARRIVALS, FANOUT = 5, 2


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = shards.ShardSet(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", base_bytes=1 << 16, fanout=FANOUT)
    arrival = F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(ARRIVALS))
    merges = 0
    for wave in range(ARRIVALS):
        before = kept.append(docs.where(arrival == wave))
        merges += kept.compact() - before
        kept.expire(0)  # nobody reads older versions
    # the newest manifest has all rows and no full tier, and more than one tier was merged: else something was lost or not compacted
    told = {"manifest_rows": F.lit(sum(x["rows"] for x in kept.manifest())).cast("long"), "full_tiers": F.lit(len(kept.full_tiers())), "compacted": F.lit(merges > 1)}
    return kept.read(docs.schema).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")).withColumns(told)


ORACLE["op5_sharding"] = "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256, 0 AS full_tiers, count(*) OVER () AS manifest_rows, true AS compacted FROM documents"


@query
def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secret_scan.Ledger(spark, f"{shared_dir(spark)}/secrets-{uuid.uuid4().hex}")
    # two commits to the history: even ids first, then all ids and further rules. Texts of the first are scanned for the further rules alone in the second.
    ledger.scan(docs.where(F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0), secret_scan.BASE, 1)
    ledger.scan(docs, secret_scan.RULES, 2)
    found = ledger.findings(docs, secret_scan.RULES)
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secret_scan.BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in secret_scan.BASE], F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"), "first_scan")


_KINDS = {
    "assign": (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 18), "hex": (r"([0-9a-f]+)", 1, 16), "pem": (r"(-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----)", 1, 0),
    "jwt": (r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 0), "userinfo": (r"(://[^\s/:@]+:[^\s/:@]+@)", 1, 0),
}
_MATCHES = ",\n".join(
    f"""m{k} AS (SELECT r, '{kind}' AS kind, {k} AS k, m, g, sum(length(p) + coalesce(length(before), 0)) OVER (PARTITION BY r ORDER BY i) AS s FROM
 (SELECT r, i, p, m, g, lag(m) OVER (PARTITION BY r ORDER BY i) AS before FROM (SELECT r, unnest(range(len(m))) AS i, unnest(p[1:len(m)]) AS p, unnest(m) AS m, unnest(g) AS g
 FROM (SELECT r, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS g FROM d WHERE regexp_matches(text, '{pattern}')))) QUALIFY length(g) >= {least})"""
    for k, (kind, (pattern, group, least)) in enumerate(_KINDS.items())
)
ORACLE["op11_secret_scans"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r, min(CASE WHEN coalesce(doc_id, 0) % 2 = 0 THEN 1 ELSE 2 END) OVER (PARTITION BY coalesce(text, '')) AS first_scan FROM documents),
{_MATCHES},
x AS ({" UNION ALL ".join(f"SELECT r, kind, k, CAST(s AS BIGINT) AS s, concat_ws(':', kind, CAST(s AS BIGINT), CAST(s + length(m) AS BIGINT)) AS span FROM m{k}" for k in range(len(_KINDS)))}),
a AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
 string_agg(span, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans FROM x GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, first_scan
FROM d LEFT JOIN a USING (r)
"""


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resample.resample(docs, table(spark, sf_dir, "benchmark"), percent=5, min_words=20, seed=42, buckets=10_000)
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "text"), f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    fim.store(docs).write.option("compression", "none").parquet(folder)  # frames are compressed
    made = fim.digests(fim.transform(spark.read.parquet(folder), seed=1, rate=90, spm=20))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE["op13_fill_in_middle"] = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, [CAST('0x' || h[8 * k - 7:8 * k] AS BIGINT) FOR k IN [1, 2, 3, 4]] AS g FROM h),
c AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
 CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR g[3] % 100 >= 90 THEN 'plain' WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substring(text, 1, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
  ELSE '<S>' || substring(text, b + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, b - a) END) AS output_sha256, sha256(text) AS restored_sha256 FROM c
"""
