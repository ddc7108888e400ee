"""Each operator against a brute-force version or an exact round trip, with nulls, empty and very long texts, ties,
repeated rows, empty tables and columns whose names clash."""

import base64
import hashlib
import io
import random
import re
import uuid
import zlib

import numpy as np
import public_tokenizers as PT
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from flocktab.llm import bpe, components, decontaminate, line_dedup, quality, queries, shards, simhash, substring_dedup, toxicity, url_filter, warc

DOCS = "doc_id long, text string, score double, rank int, key string, h1 string, component_id string, n_words string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """rows of (doc_id, text), with more columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 0.5, 1, "k", "h", "c", "n") for i, t in rows], DOCS)


def prose(rng, n, vocab=4000):
    return " ".join(f"w{rng.randrange(vocab)}" + (".\n" if rng.random() < 0.04 else ". " if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    shared = "this very line is shared by many of the documents here."
    passage = prose(rng, 70)
    rows = [(i, prose(rng, rng.randrange(1, 300))) for i in range(60)]
    rows += [(60 + i, rows[i][1]) for i in range(5)]  # exact copies
    rows += [(70 + i, rows[10][1] + f" tail{i}") for i in range(5)]
    rows += [(80 + i, prose(rng, 20) + "\n" + shared.upper() + " \n" + passage + "\n" + shared) for i in range(6)]
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, "ÀB é " * 30), (None, shared + "\nx"), (None, None), (94, prose(rng, 30_000)), (95, "Zu. " * 200)]
    return rows + [rows[3], rows[3], (85, "another row\n" + shared)]  # repeated rows, and one id with two texts


def brute_lines(rows):
    """(id, text left, lines, lines dropped) for each row."""
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({i: i + 32 for i in range(65, 91)})
    seen, out = {}, []
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                seen.setdefault(key(x), set()).add(-1 if i is None else i)
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(seen.get(key(x), ())) < 3 or max(seen[key(x)]) == (-1 if i is None else i)]
        out.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return out


def test_line_dedup(spark, corpus):
    got = line_dedup.dedup_lines(docs(spark, corpus)).select("doc_id", "text", "n_lines", "n_dropped", "key").collect()
    want = [(str(r[0]), *r[1:], "k") for r in brute_lines(corpus)]
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert sum(w[3] for w in want) >= 6


@pytest.mark.parametrize("salts", [1, 3])
def test_line_dedup_of_many_lines_and_both_ways(spark, corpus, monkeypatch, salts):
    """Bitmaps of several words with gaps, with the bitmaps broadcast and not."""
    shared = [f"this line number {k} is shared by all of them" for k in range(300)]
    rows = [(i, "\n".join(x for k, x in enumerate(shared) if k % (i + 2) < 2 or k > 250) + "\nown\n" * i) for i in range(5)] + corpus
    want = sorted((str(i), t, a, b) for i, t, a, b in brute_lines(rows))
    for bound in (0, 1 << 30):
        monkeypatch.setattr(line_dedup, "MAX_BROADCAST", bound)
        got = line_dedup.dedup_lines(docs(spark, rows), salts=salts).select("doc_id", "text", "n_lines", "n_dropped").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == want


@pytest.mark.parametrize("salts", [1, 3])
def test_line_dedup_salts_agree(spark, corpus, salts):
    a = line_dedup.dedup_lines(docs(spark, corpus), salts=salts).select("doc_id", "text", "n_dropped")
    b = line_dedup.dedup_lines(docs(spark, corpus)).select("doc_id", "text", "n_dropped")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_quality(spark, corpus):
    got = quality.judge(docs(spark, corpus)).select("doc_id", "quality.*").collect()
    want = []
    for i, t in corpus:
        w = WORDS.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        many = {g for g in grams if grams.count(g) > 1} if len(grams) < 2000 else set()
        hit = {p for k, g in enumerate(grams) if g in many for p in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), failed))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r["doc_id"]), *[r[c] for c in names]) for r in got) == sorted(want)
    assert all(not r["kept"] for r in got if r["base_failed"]) and any(r["kept"] for r in got)


def test_quality_order_heeds_costs(spark, corpus):
    """Of two rules that reject alike the quicker goes first; what it rejects counts no more for the other."""
    short = lambda text, words, m: m["n_words"] < 100
    slow = lambda text, words, m: (F.length(F.regexp_replace(F.repeat(text, 40), "[0-9]+w", "")) > 0) & (m["n_words"] < 100)
    other = lambda text, words, m: m["n_words"] > 250
    frame = docs(spark, [r for r in corpus if len(r[1] or "") < 3000])
    order = quality.order_rules(frame, {"slow": slow, "other": other, "short": short})
    assert sorted(order) == ["other", "short", "slow"] and order[-1] == "slow"
    assert quality.order_rules(frame.limit(0), {"slow": slow, "short": short}) == ["slow", "short"]


def test_quality_order_changes_nothing(spark, corpus):
    names = list(quality.RULES)
    a = quality.judge(docs(spark, corpus), order=names).select("doc_id", "quality.kept")
    b = quality.judge(docs(spark, corpus), order=names[::-1]).select("doc_id", "quality.kept")
    assert a.exceptAll(b).isEmpty()
    junk = docs(spark, [(1, " ".join(f"ABC{chr(65 + i)}XYZ" for i in range(26))), (2, " ".join(f"ab{i}! !" for i in range(30)))])
    assert {r[0] for r in quality.judge(junk, order=names).select("quality.rejected_by").collect()} == {"shouting", "exclaiming"}


def _decontaminated(rows, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    grams = {}
    for i, t in items:
        w = norm(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = norm(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[g]
        out.append((str(i), len(w), sorted(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("max_broadcast", [10**6, 0])
def test_decontamination(spark, corpus, max_broadcast):
    items = [(1, corpus[20][1][:300]), (2, "W1, w2 w3"), (3, None), (4, "..."), (5, corpus[82][1].split("\n")[2]), (5, corpus[82][1].split("\n")[2])]
    rows = [*corpus, (200, "x w1 W2-w3 y"), (201, "tail w1 w2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows += [rows[3], (None, "w1 w2 w3"), (None, "w1 w2 w3"), (None, None), (202, "w1 w2 w3 w2 w1 w2 w3")]
    got = decontaminate.find_hits(docs(spark, rows).repartition(3), bench, max_broadcast=max_broadcast)
    assert sorted((str(r["doc_id"]), r["n_words"], list(r["hits"]), sorted(r["items"])) for r in got.select("__doc.doc_id", "n_words", "hits", "items").collect()) == _decontaminated(rows, items)


def test_decontamination_removes(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    d = docs(spark, [(1, "a One, TWO three! b"), (2, "clean one"), (3, None)])
    left = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(d, bench, remove="spans").collect()}
    assert left == {1: "a! b", 2: "clean one", 3: None}
    assert {r["doc_id"] for r in decontaminate.decontaminate(d, bench).collect()} == {2, 3}
    assert decontaminate.decontaminate(d.limit(0), bench).count() == 0
    none = decontaminate.decontaminate(d, bench.limit(0))
    assert none.count() == 3 and none.columns == d.columns


def brute_fingerprint(text):
    w = WORDS.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=4):
    fps = sorted(set(fps))
    up = {x: x for x in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    a = np.array(fps, np.uint64)
    for k, x in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ a[k]) <= distance):
            p, q = root(x), root(fps[k + 1 + int(j)])
            up[max(p, q)] = min(p, q)
    return {x: root(x) for x in fps}


def test_simhash(spark, corpus):
    got = simhash.near_duplicates(docs(spark, corpus)).collect()
    fps = [brute_fingerprint(t) for _, t in corpus]
    root = brute_components(fps)
    least = {}
    for (i, _), f in zip(corpus, fps, strict=True):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = sorted((str(i), f, least.get(root[f])) for (i, _), f in zip(corpus, fps, strict=True))
    assert sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == want


@pytest.mark.parametrize("the_plan", [None, simhash.Plan([list(range(21)), list(range(21, 42)), list(range(42, 64))], [1, 1, 0]), simhash.Plan([list(range(32)), list(range(32, 64))], [2, 1])])
def test_simhash_links_dense(spark, the_plan, monkeypatch):
    """Clusters so dense that all pairs would be many; blocks small enough to be split."""
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for center in [rng.getrandbits(64) for _ in range(4)]:
        fps |= {center ^ sum(1 << b for b in rng.sample(range(40), rng.randrange(5))) for _ in range(250)}
    monkeypatch.setattr(simhash, "BLOCK", 64)
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), 4, the_plan).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in links)
    up = {x: x for x in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = root(a & (2**64 - 1)), root(b & (2**64 - 1))
        up[max(p, q)] = min(p, q)
    assert {x: root(x) for x in fps} == brute_components(fps)


def test_plan_keeps_the_sum(spark):
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 2**63, 200).astype(np.uint64)
    for total in (10, 10**6, 10**10):
        p = simhash.plan(sample, total)
        assert sum(t + 1 for t in p.thresholds) == 5 and sorted(b for x in p.parts for b in x) == list(range(64))


def test_components(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 300), (250, 300)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100, 200: 200, 250: 200, 300: 200}


def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PT.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=PT.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, corpus):
    rows = [*corpus, (300, "<|endoftext|> don't  stop\u00a0now 12345 \U0001f600\u0301"), (301, "a" * 20_000), (302, "ñ" * 5000 + " \t\n  x")]
    enc = reference_encoding()
    d = docs(spark, rows)
    got = bpe.encode(d, PT.path("byte_bpe_50k.tiktoken"), PT.PATTERN, decoded=True)
    want = sorted((str(i), np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), bytes(r["decoded"])) for r in got.collect()) == want
    again = bpe.decode(got.select("doc_id", "ids"), PT.path("byte_bpe_50k.tiktoken"))
    assert sorted(bytes(r["decoded"]) for r in again.collect()) == sorted(w[2] for w in want)
    assert "n_words" in got.columns


def test_perfect_hash():
    ranks = {f"k{i}".encode(): i for i in range(5000)}
    h = bpe.PerfectHash(ranks)
    assert all(h.get(k) == v for k, v in ranks.items()) and sorted(h.ids) == list(range(5000))
    assert h.get(b"none") == -1 and bpe.PerfectHash({}).get(b"x") == -1


def brute_substring(rows, run=3, min_words=20, whole=10):
    """For texts of plain sentences of at most 16 words: runs as strings, compared by looking through all that came before."""
    cut = lambda t: re.findall(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+$", t)
    order = sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is None, r[0] or 0, int(np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)).astype(np.int64))))
    seen, gone = set(), {}
    for i, t in order:
        own = [" ".join(x.lower().split()) for x in cut(t)]
        count = [len(x.split()) for x in own]
        spans = []
        if len(own) < run or sum(count) < min_words:
            spans = [(0, len(own), "whole")] if sum(count) >= whole else []
        else:
            for k in range(len(own) - run + 1):
                fits = [e for e in range(k + run, len(own) + 1) if sum(count[k:e]) >= min_words]
                back = [j for j in range(k, -1, -1) if sum(count[j : k + run]) >= min_words]
                spans += [(k, fits[0], "")] if fits else [(back[0], k + run, "back")] if back else []
        keys = [(kind, tuple(own[x:y])) for x, y, kind in spans]
        gone[i, t] = set()
        for key, (x, y, _) in zip(keys, spans, strict=True):
            if key in seen:
                gone[i, t] |= set(range(x, y))
            seen.add(key)
    return sorted(((str(i), t and "".join(s for k, s in enumerate(cut(t)) if k not in gone[i, t])) for i, t in rows), key=str)


def plain_prose(rng, n):
    return "".join(" ".join(f"v{rng.randrange(5000)}" for _ in range(rng.randrange(1, 14))) + rng.choice([". ", "! ", "\n", "?\n\n"]) for _ in range(n))


@pytest.mark.parametrize("chunk", [1 << 19, 7])
def test_substring_dedup(spark, chunk, monkeypatch):
    """Against strings; with chunks so small that a run is settled in several."""
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    rng = random.Random(9)
    shared, short = plain_prose(rng, 9), "one two three four five six seven eight nine ten eleven"
    rows = [(k, plain_prose(rng, rng.randrange(1, 12))) for k in range(40)]
    rows += [(50 + k, plain_prose(rng, 3) + shared + plain_prose(rng, 2)) for k in range(12)] + [(70, shared + shared), (71, shared.upper())]
    rows += [rows[3], rows[45], (45, rows[3][1]), (46, short), (47, short), (47, plain_prose(rng, 5) + shared), (47, plain_prose(rng, 4) + shared), (48, "Ja! Ja!"), (49, "Ja! Ja!")]
    rows += [(None, None), (None, shared), (None, plain_prose(rng, 4) + shared), (80, ""), (81, None), (82, " \n "), (83, plain_prose(rng, 250))]
    got = substring_dedup.dedup_substrings(docs(spark, rows).repartition(3))
    found = got.collect()
    assert sorted(((str(r["doc_id"]), r["text"]) for r in found), key=str) == brute_substring(rows)
    assert sum(r["removed_words"] > 50 for r in found) >= 12 and "key" in got.columns
    assert {r["text"] for r in found if r["doc_id"] in (46, 48, 49)} == {short, "Ja! Ja!"} and "" in {r["text"] for r in found if r["doc_id"] == 47 or r["doc_id"] == 45}


def test_sentences_are_lossless(corpus):
    for _, t in corpus:
        assert t is None or "".join(substring_dedup.sentences(t)) == t


RULES = queries.URL_RULES


def brute_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([len(rest), *[rest.find(c) for c in "/?#" if c in rest]])
        host, tail = rest[:end].translate({i: i + 32 for i in range(65, 91)}), rest[end:]
        path = re.split(r"[?#]", tail)[0]
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_filter(spark):
    urls = [None, "", "no scheme/x", "http://", "http://A.Example.ORG/es/1", "https://example.org/en/12?x=/es/", "http://example.org", "http://example.org?q=/", "http://x.com/fr/a#b", "http://x.com/de/", "http://com/fr/",
            "http://b.net/de/12", "a://b://c.com/fr/", "http://xexample.org/es/", "http://Ünï.com/de/x", "http://x.com/fr\n/de/", "http://y.net/" + "z" * 5000]
    rows = [(k, u) for k, u in enumerate(urls)] + [(None, "http://x.com/fr/")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("x"))
    parsed = url_filter.parse(pages.drop("rule"), RULES)
    labelled = parsed.where("rule_verdict is not null").select("host", "path", (F.col("rule_verdict") == "block").cast("int").alias("block"))
    got = url_filter.judge(pages.drop("rule"), RULES, url_filter.train(labelled)).collect()
    assert sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"])) for r in got) == sorted((str(i), *brute_rule(u)[:2], str(brute_rule(u)[2])) for i, u in rows)
    for r in got:
        assert r["verdict"] == (RULES[r["rule"]] if r["rule"] else "block" if r["blocked"] >= 0.5 else "allow")


def test_url_filter_clashing_and_empty(spark):
    """Columns that have the names of new ones are replaced; an empty table stays empty."""
    pages = spark.createDataFrame([(1, "http://x.com/de/", "p", "q", "r", "s", "t", 7)], "page_id long, url string, host string, path string, rule string, verdict string, blocked string, more int")
    model = url_filter.train(spark.createDataFrame([("a", "/x", 1), ("b", "/y", 0)], "host string, path string, block int"))
    r = url_filter.judge(pages, RULES, model).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"], r["more"]) == ("x.com", "/de/", "com/de/", "block", 7) and 0 <= r["blocked"] <= 1
    assert url_filter.judge(pages.limit(0), RULES, model).count() == 0


def test_url_model_is_a_logistic_regression(spark):
    """n-grams against a plain version; the probability is the sigmoid of their sum; at the optimum the penalised loss is flat."""
    from pyspark.ml.feature import HashingTF

    rng = random.Random(3)
    rows = [(f"{rng.choice(['shop', 'news', 'win'])}{rng.randrange(9)}.{rng.choice(['net', 'org'])}", f"/{rng.choice(['a', 'buy', 'x1'])}/{rng.randrange(30)}") for _ in range(60)]
    rows = [(h, p, int("win" in h or "buy" in p)) for h, p in sorted(set(rows))]
    frame = spark.createDataFrame(rows, "host string, path string, block int")
    model = url_filter.train(frame)

    def grams(h, p):
        return {m + f"^{t}$"[i : i + n] for t, m in ((h, "h"), (p, "p")) for n in (3, 4) for i in range(max(1, len(t) + 2 - n + 1))}

    made = frame.select("host", "path", url_filter._grams(F.col("host"), F.col("path")).alias("g")).collect()
    assert all(set(r["g"]) == grams(r["host"], r["path"]) for r in made)
    index = HashingTF(numFeatures=url_filter.FEATURES).indexOf
    x = np.zeros((len(rows), url_filter.FEATURES))
    for k, (h, p, _) in enumerate(rows):
        x[k, [index(g) for g in grams(h, p)]] = 1
    w, b, y = model.fitted.coefficients.toArray(), model.fitted.intercept, np.array([r[2] for r in rows])
    prob = 1 / (1 + np.exp(-(x @ w + b)))
    got = {(r["host"], r["path"]): r["blocked"] for r in model.add(frame).collect()}
    assert max(abs(got[h, p] - prob[k]) for k, (h, p, _) in enumerate(rows)) < 1e-9
    flat = x.T @ (prob - y) / len(y) + 0.01 * x.var(0, ddof=1) * w  # the penalty is on coefficients of features of variance 1
    assert np.abs(flat).max() < 2e-3 and abs((prob - y).mean()) < 2e-3 and ((prob > 0.5) == y).mean() > 0.95


def test_url_model_generalises(spark):
    ok, bad = [("good.net", f"/news/article-{k}", 0) for k in range(40)], [("casino.net", f"/win/bonus-{k}", 1) for k in range(40)]
    model = url_filter.train(spark.createDataFrame(ok + bad, "host string, path string, block int"))
    new = spark.createDataFrame([("other.net", "/news/article-99"), ("x.casino.net", "/win/bonus-77")], "host string, path string")
    assert [r["blocked"] > 0.5 for r in model.add(new).collect()] == [False, True]
    assert url_filter.train(spark.createDataFrame([], "host string, path string, block int")).add(new).first()["blocked"] == 0.0


def test_warc(spark, tmp_path):
    big = "<p>ß" + "x" * 1200
    rows = [(1, "http://b.org/x", big), (2, "http://a.b.org/", big), (3, None, None), (4, "http://b.org/x?y", "short"), (5, "u\r\nv", "short"), (6, "http://b.org/x", big), (None, "http://b.org/x", big), (7, "WARC/1.1", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (6, "http://b.org/x", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.round_trip(pages, str(tmp_path / "w")).orderBy("range", "pos").collect()
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = h == big and i != 6
        want.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 6 if revisit else None))
    assert sorted(map(str, want)) == sorted(str((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    keys = [(r["url_key"], r["ts"]) for r in got]
    assert keys == sorted(keys)
    seen = {}
    for r in got:
        seen[r["url_key"]] = seen.get(r["url_key"], 0) + 1
        assert r["nth"] == seen[r["url_key"]]
    assert max(seen.values()) >= 3


def test_warc_ranges(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.org/{k % 7}", "b" * (k % 50)) for k in range(600)], "page_id long, url string, html string").repartition(5)
    warc.write(pages, str(tmp_path / "w"), per_file=50, compression="none")
    got = warc.histories(warc.merge(warc.read(spark, str(tmp_path / "w")), range_rows=20)).orderBy("range", "pos").collect()
    keys, seen = [(r["url_key"], r["ts"], r["page_id"]) for r in got], {}
    for r in got:  # keys go on over several ranges
        seen[r["url_key"]] = seen.get(r["url_key"], 0) + 1
        assert r["nth"] == seen[r["url_key"]]
    assert len(got) == 600 and keys == sorted(keys) and len({r["range"] for r in got}) > 3


def test_warc_dates_are_utc(spark, tmp_path):
    """Whatever the session's time zone, also where its clock goes back."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    pages = spark.createDataFrame([(k * 1800 + 26_000_000, "http://a.org/", "x") for k in range(40)] + [(-5, "u", None), (2**62, "u", "y")], "page_id long, url string, html string")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = warc.round_trip(pages, str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    import datetime

    assert {r["page_id"]: r["ts"] for r in got} == {i: datetime.datetime.fromtimestamp(warc.EPOCH + i % 2**36, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ") for i in (r["page_id"] for r in pages.collect())}


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_archives_are_parsed_record_by_record(spark, tmp_path, monkeypatch):
    """Offsets, long payloads, blocks that look like records; cut archives are errors; a store that pyarrow does not know gives the same rows."""
    page = "WARC/1.1\r\n\r\n" * 3 + "x" * 3_000_000
    pages = spark.createDataFrame([(k, f"http://a.b/{k}", page if k == 3 else f"<p>{k}</p>\n" * k) for k in range(9)], "page_id long, url string, html string")
    for compression in ("gzip", "none"):
        folder = str(tmp_path / compression)
        warc.write(pages, folder, per_file=4, compression=compression)
        got = {r["page_id"]: r for r in warc.read(spark, folder).collect()}
        assert {k: r["payload_bytes"] for k, r in got.items()} == {k: len(page) if k == 3 else len(f"<p>{k}</p>\n" * k) for k in range(9)}
        with monkeypatch.context() as m:
            m.setattr(warc, "file_system", lambda x: (_ for _ in ()).throw(pa.ArrowInvalid("unknown")))
            assert sorted(map(tuple, warc.read(spark, folder).collect())) == sorted(map(tuple, got.values()))
    r = got[5]
    content = (tmp_path / "none" / r["archive"]).read_bytes()
    assert content[r["offset"] :].startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5>")
    assert [at for at, _, _ in warc.parse(io.BytesIO(content))] == sorted(x["offset"] for x in got.values() if x["archive"] == r["archive"])
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(io.BytesIO(content[:-9])))
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse(io.BytesIO(b"x" + content)))


def test_empty_warc(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w")).count() == 0


def test_shards(spark, tmp_path, corpus):
    kept = shards.ShardSet(spark, str(tmp_path / uuid.uuid4().hex), shard_rows=5, base_bytes=1024, fanout=3, target_bytes=1 << 20)
    d = docs(spark, corpus)
    assert kept.version() == 0 and kept.read(d.schema).count() == 0
    for wave in range(3):
        kept.append(d.where(F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == wave))
    before = kept.manifest()
    assert kept.version() == 3 and len(before) > 10
    kept.compact()
    after = kept.manifest()
    assert len(after) < len(before) and sum(x["rows"] for x in after) == len(corpus)
    for v in (3, None):
        back = kept.read(version=v)
        assert back.exceptAll(d).isEmpty() and d.exceptAll(back).isEmpty()
    with pytest.raises(RuntimeError):
        kept.commit([], 2)
    kept.append(d.limit(0))
    assert kept.version() > 4 and kept.read().count() == len(corpus)
    old = kept.read(version=3)
    assert kept.expire(3600) == 0 and old.count() == len(corpus)  # readers of older versions have time to end
    assert kept.expire(0) >= len(before) and kept.read().count() == len(corpus) and kept.version() > 4
    assert kept.expire(0) == 0


def test_a_commit_whose_answer_is_lost(spark, tmp_path, monkeypatch):
    """The rename succeeds and reports a failure: the version stands, and so do its shards. If it fails in truth, with another writer's version there, the own files go."""
    kept = shards.ShardSet(spark, str(tmp_path / uuid.uuid4().hex))
    rows = spark.createDataFrame([(k, "x") for k in range(10)], "doc_id long, text string")
    rename = shards.ShardSet._rename

    def lost(self, old, new):
        rename(self, old, new)
        rename(self, old, new)  # the file is gone: an error from the store

    monkeypatch.setattr(shards.ShardSet, "_rename", lost)
    assert kept.append(rows) == 1 and kept.read().count() == 10

    def outrun(self, old, new):
        self._write(new, '{"commit": "other", "parts": [], "at": 0}')
        rename(self, old, new)

    monkeypatch.setattr(shards.ShardSet, "_rename", outrun)
    with pytest.raises(RuntimeError, match="committed already"):
        kept.append(rows)
    monkeypatch.setattr(shards.ShardSet, "_rename", rename)
    assert kept.version() == 2 and len(list((tmp_path / kept.root.rsplit("/", 1)[1] / "data").iterdir())) == 1


def test_parts_of_a_manifest(spark, tmp_path, monkeypatch):
    """An append adds a part and leaves the others; a compaction rewrites parts that lose a shard, or are short."""
    monkeypatch.setattr(shards, "PART_LINES", 2)
    kept = shards.ShardSet(spark, str(tmp_path / uuid.uuid4().hex), shard_rows=4, base_bytes=1 << 20, fanout=4)
    rows = lambda n: spark.createDataFrame([(k, "x") for k in range(n)], "doc_id long, text string").coalesce(1)
    kept.append(rows(8))
    first = kept.parts()
    kept.append(rows(3))
    assert kept.parts()[:1] == first and len(kept.parts()) == 2 and len(kept.manifest()) == 3
    kept.append(rows(4))
    kept.compact()
    assert len(kept.manifest()) == 1 and len(kept.parts()) == 1 and kept.read().count() == 15
    assert [len(kept.parts(v)) for v in (1, 2, 3, 4)] == [1, 2, 3, 1] and kept.read(version=2).count() == 11


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    from flocktab.llm.common import table

    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.train(d, labels)
    held = d.join(labels, "doc_id").where(toxicity.fold(F.col("doc_id")) == 0).select("doc_id", "text", "toxic")
    rows = toxicity.score(held, model).collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    caught = (s >= 0.5) & (y == 1)
    assert caught.sum() > 0.85 * y.sum() and caught.sum() > 0.92 * (s >= 0.5).sum()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows[:50])


def loop_loss(vectors, soft, bias, bags, y, rows_of):
    """Loss of bags of words, one number after another: words weighted by what they say themselves, vectors averaged, softmax."""
    total = 0.0
    for words, label in zip(bags, y, strict=True):
        each = [[sum(vectors[r, d] for r in rows_of[w]) / len(rows_of[w]) for d in range(vectors.shape[1])] for w in words]
        weight = [np.exp(toxicity.SHARP * sum(v * (soft[d, 1] - soft[d, 0]) for d, v in enumerate(e))) for e in each]
        mean = [sum(w * e[d] for w, e in zip(weight, each, strict=True)) / sum(weight) for d in range(vectors.shape[1])]
        z = [sum(mean[d] * soft[d, c] for d in range(len(mean))) + bias[c] for c in (0, 1)]
        total -= z[label] - np.log(sum(np.exp(z)))
    return total / len(bags)


def test_toxicity_gradients():
    """Loss against a plain loop, derivatives against differences of it."""
    rng = np.random.default_rng(4)
    vectors, soft, bias = rng.normal(size=(30, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    rows_of = [rng.integers(0, 30, n) for n in (1, 4, 3, 6, 2)]  # rows may repeat within a word
    bags, y = [np.array(b) for b in ([0, 1, 1], [4], [2, 3, 0, 4], [3, 3])], np.array([0, 1, 1, 0])
    loss, *made = toxicity.gradients(vectors, soft, bias, bags, y, rows_of)
    assert abs(loss - loop_loss(vectors, soft, bias, bags, y, rows_of)) < 1e-12
    for k, value in enumerate((vectors, soft, bias)):
        for at in np.ndindex(value.shape):
            was, step = value[at], 1e-6
            value[at] = was + step
            up = loop_loss(vectors, soft, bias, bags, y, rows_of)
            value[at] = was - step
            down = loop_loss(vectors, soft, bias, bags, y, rows_of)
            value[at] = was
            assert abs(made[k][at] - (up - down) / (2 * step)) < 1e-6


def test_toxicity_score_is_the_softmax(monkeypatch):
    """A fitted model's score is the softmax of the whole text's weighted average; also when the cache of words turns over."""
    model = toxicity.Model(np.random.default_rng(5).normal(size=toxicity.ROWS).tolist(), 0.25)
    words = [f"Wort{k}" for k in range(19)]
    part = np.array([np.mean([model.weight[r] for r in toxicity.features(w.lower())]) for w in words])
    weight = np.exp(toxicity.SHARP * part)
    want = 1 / (1 + np.exp(-0.25 - weight @ part / weight.sum()))
    monkeypatch.setattr(toxicity, "CACHE", 4)
    for _ in range(2):
        assert abs(model.score(" ".join(words)) - want) < 1e-12 and abs(model.score(None) - 1 / (1 + np.exp(-0.25))) < 1e-12


def test_toxicity_in_long_texts_and_misspelt():
    """A few words in a long text count wherever they stand, and an unseen misspelling of one does."""
    rng = random.Random(8)
    bad = [(" ".join([prose(rng, n := rng.randrange(5, 200)), "you vile scumbag", prose(rng, 200 - n)]), 1) for _ in range(120)]
    good = [(prose(rng, 200), 0) for _ in range(240)]
    model = toxicity.fit(*zip(*(bad + good), strict=True))
    for at in (0, 7, 1500, 3000):
        own = prose(rng, 3000).split()
        assert model.score(" ".join(own)) < 0.5 < model.score(" ".join([*own[:at], "you vile scumbag", *own[at:]]))
    assert model.score("so a scumbagg here") > 0.5 > model.score("so a w77 here")


def test_toxicity_trains_alike_and_keeps_rows(spark, tmp_path):
    """Repeated ids with several texts and labels, null ids, and bounds that bite: two runs train the same model."""
    rng = random.Random(6)
    rows = [(k % 40, prose(rng, 15) + (" vile scum" if k % 3 == 0 else "")) for k in range(120)] + [(None, "x"), (None, None), (3, "")]
    labels = [(k, int(k % 3 == 0)) for k in range(40)] + [(5, 1), (5, 0), (None, 1)]
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    a = toxicity.train(frame.repartition(3), marks, max_rows=30)
    b = toxicity.train(frame.repartition(5).orderBy("text"), marks.repartition(4), max_rows=30)
    assert a.bias == b.bias and a.weight == b.weight
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.QUERIES["op10_toxicity"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r["held_out"] is (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_toxicity_edges(spark, corpus):
    bad = [("you utter idiot and moron " + prose(random.Random(k), 20), 1) for k in range(60)]
    good = [(prose(random.Random(k), 25), 0) for k in range(100, 200)]
    model = toxicity.fit(*zip(*(bad + good), strict=True))
    assert model.score("such an idiots here") > model.score("such a w12 here")
    scored = toxicity.score(docs(spark, corpus).drop("score"), model).collect()
    assert len(scored) == len(corpus) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.fit([], []).score("x") == 0.0 or toxicity.fit([], []).score("x") < 1e-300
    assert toxicity.fit(["a"], [1]).score("x") == 1.0


@pytest.mark.parametrize("make", [
    lambda d, s: line_dedup.dedup_lines(d), lambda d, s: quality.judge(d), lambda d, s: simhash.near_duplicates(d), lambda d, s: substring_dedup.dedup_substrings(d),
    lambda d, s: decontaminate.decontaminate(d, s.createDataFrame([(1, "a b")], "item_id long, text string")), lambda d, s: bpe.encode(d, PT.path("byte_bpe_50k.tiktoken"), PT.PATTERN),
    lambda d, s: toxicity.score(d.drop("score"), toxicity.Model(None, -800.0))])
def test_empty_tables(spark, make):
    assert make(docs(spark, []), spark).count() == 0


def test_substring_dedup_short_sentences(spark):
    """A repeated stretch of short sentences goes whole; so does one of text without spaces."""
    rng = random.Random(6)
    short = "".join(f"w{rng.randrange(9000)}! " for _ in range(60))
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300))
    rows = [(1, prose(rng, 40) + "\n" + short + "\n" + prose(rng, 40)), (2, prose(rng, 40) + "\n" + short + "\n" + prose(rng, 40)), (3, short), (4, han), (5, "x" + han + "y"), (6, "Ja! Ja! Nein! "), (7, "Ja! Ja! Nein! ")]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs(spark, rows)).collect()}
    assert [got[k]["n_removed"] for k in (1, 4, 6, 7)] == [0, 0, 0, 0]
    assert got[2]["removed_words"] == 60 and not set(short.split()) & set(got[2]["text"].split())
    assert got[3]["text"] == "" and len(got[5]["text"]) < 60


def test_substring_dedup_51_words_unpunctuated(spark):
    """A passage of 51 words at any place of unpunctuated text is found, but for its ends."""
    rng, rows, passages = random.Random(8), [], []
    word = lambda n: " ".join(f"w{rng.randrange(90000)}" for _ in range(n))
    for k in range(100):
        passages.append(word(51))
        rows += [(k, word(rng.randrange(30, 90)) + " " + passages[k] + " " + word(40)), (1000 + k, word(rng.randrange(30, 90)) + " " + passages[k] + " " + word(40))]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs(spark, rows)).collect()}
    removed = [got[1000 + k]["removed_words"] for k in range(100)]
    assert min(removed) > 0 and sum(removed) > 0.75 * 51 * 100
    assert max(removed) <= 51 and all(got[k]["n_removed"] == 0 for k in range(100))


def test_sentences_stand_alone():
    """A sentence is cut the same before a blank, before a newline and at the end of the text."""
    s = " ".join(f"w{k}" for k in range(15)) + " w15."
    assert {substring_dedup.sentences(s + end)[0].strip() for end in ("", " ", "\n", " Next one.")} == {s}


def test_shards_keep_later_columns(spark, tmp_path):
    kept = shards.ShardSet(spark, str(tmp_path / uuid.uuid4().hex), shard_rows=5, base_bytes=1 << 20, fanout=2)
    kept.append(spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1))
    kept.append(spark.createDataFrame([(2, "b", 7)], "doc_id long, text string, more long").coalesce(1))
    assert sorted(map(tuple, kept.read().select("doc_id", "more").collect())) == [(1, None), (2, 7)]
    kept.compact()
    assert len(kept.manifest()) == 1 and sorted(map(tuple, kept.read().select("doc_id", "more").collect())) == [(1, None), (2, 7)]
