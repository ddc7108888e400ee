"""WARC: write pages as archives with revisit records, read archives back, and merge their capture indexes.

Writing is a Spark job over the pages: of the records with equal payloads of at least `min_revisit` bytes, that with the
largest id is a response, the others revisit it. The largest id of a payload comes from an aggregation on digests that
combines before it shuffles; a payload that very many pages have is broadcast, so that its pages meet in no one task. Records are written by Spark's text writer with the WARC separator as line end, at most
`records` a file and compressed file by file, so archives go wherever Spark can write and each file is published once. A capture's
offset counts in the uncompressed archive.

Reading opens each archive from its store in a task, parses it by Content-Length record after record, so that a task holds
one payload whatever the archive's size, and yields its captures sorted by URL key and timestamp: a local run. The merge is external: every run is cut at splitters taken from a sample of at most
SPLIT_SAMPLE keys (key, timestamp and id together, so a URL with very many captures is cut as well), the pieces of one
range of keys meet in one task and go through a k-way loser tree, which hands its captures on as they come. Ranges are of
about `range_rows` captures, and (range, pos) orders all captures globally. A capture's place in the history of its URL
key is counted as the merge goes; a key that goes on in the next range is carried over by counts of the ranges, not rows.

Defined results. Null or empty html: an empty payload, always a response. Null URL: an empty target URI. A null id is
written as an empty id and read back as null; it never is the response others refer to. Rows that repeat the largest id are all
responses. A very long payload is held by the task that reads it, one at a time. An archive that is cut off, or has no record where one is due, is an error. Pages have no capture
time of their own: they are dated in UTC from EPOCH on, a second for each id (modulo 2 ** 36). An empty table gives an
empty archive set and no captures. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flocktab.sources.named_files import file_system

from .common import cut, shared_dir

END = "\r\n\r\n"
SPLIT_SAMPLE = 20_000
#: Captures without a date of their own are dated from here, a second for each id.
EPOCH = 1_704_067_200

CAPTURE = "url_key string, ts string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, offset bigint"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_revisit: int = 1000) -> DataFrame:
    """One WARC record (string, without its closing separator) for each page."""
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("body"))
    base = base.withColumns({"size": F.octet_length("body").cast("long"), "digest": F.sha1(F.col("body").cast("binary"))})
    shared = cut(base.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.max("id").alias("chosen"), F.count("*").alias("n")).where("n > 1 and chosen is not null"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    # payloads that more than a thousandth of these rows have are fewer than a thousand: broadcast; their rows, and those that ask for nothing, go anywhere
    heavy = F.broadcast(shared.where(F.col("n") > total / 1000).select("digest", F.col("chosen").alias("sure")))
    asks = F.col("sure").isNull() & (F.col("size") >= min_revisit)
    keyed = base.join(heavy, "digest", "left").withColumn("key", F.when(asks, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))))
    light = shared.where(F.col("n") <= total / 1000).select(F.col("digest").alias("key"), F.col("chosen").alias("may"))
    both = keyed.join(light, "key", "left").withColumn("chosen", F.coalesce("sure", "may"))
    revisit = F.col("chosen").isNotNull() & ~F.col("id").eqNullSafe(F.col("chosen"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    seconds = F.lit(EPOCH) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(1 << 36))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int"))
    rest = F.pmod(seconds, F.lit(86_400))  # arithmetic, so that the session's time zone has no part in it
    date = F.concat(day.cast("string"), F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", urn(F.col("id"))), line("WARC-Date", date),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("chosen"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return both.select(F.concat(header, block).alias("value"))


def write(pages: DataFrame, folder: str, per_file: int = 1000, compression: str = "gzip", **columns) -> None:
    """Archives of at most per_file records; compression: gzip or none."""
    records(pages, **columns).write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", compression).text(folder)


def url_key(url: str) -> str:
    """Host labels from the top level down, then the rest: com,example)/path."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut_at = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host = rest[:cut_at].lower().rsplit("@", 1)[-1].split(":", 1)[0]
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut_at:] or "/")


def parse(archive: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record of an archive, one after another."""
    at = 0
    while first := archive.readline():
        begin, at = at, at + len(first)
        if first == b"\r\n":
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {begin}")
        fields, line = {}, b""
        while (line := archive.readline()) not in (b"\r\n", b""):
            at += len(line)
            x = line.decode("utf-8", "replace").removesuffix("\r\n")
            k, v = x.split(": ", 1) if ": " in x else (x.rstrip(":"), "")
            fields[k.lower()] = v
        size = int(fields["content-length"])
        block = archive.read(size)
        if len(block) < size:
            raise ValueError(f"the record at byte {begin} is cut off")
        yield begin, fields, block
        at += len(line) + size


def _id(urn: str | None) -> int | None:
    tail = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(tail) if tail else None


def captures_of(name: str, archive: BinaryIO) -> list[tuple]:
    """A run: the captures of an archive by URL key, timestamp and id."""
    out = []
    for at, h, block in parse(archive):
        http, _, body = block.partition(b"\r\n\r\n")
        kind = h["warc-type"]
        if kind == "revisit":
            size = int(http.lower().split(b"content-length: ", 1)[1].split(b"\r\n", 1)[0])
            digest = h["warc-payload-digest"].removeprefix("sha1:")
        else:
            size, digest = len(body), hashlib.sha1(body).hexdigest()
        out.append((url_key(h["warc-target-uri"]), h["warc-date"], _id(h["warc-record-id"]), size, digest, kind, _id(h.get("warc-refers-to")), name, at))
    return sorted(out, key=_order)


def _order(row) -> tuple:
    """Null ids first."""
    return row[0], row[1], row[2] is not None, row[2] or 0


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of all archives of a folder; each archive is a sorted run within one partition."""
    files, names = spark.read.format("binaryFile").load(folder), [x.split()[0] for x in CAPTURE.split(", ")]

    def run(path: str, raw: BinaryIO) -> pd.DataFrame:
        with gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw) as archive:
            return _frame(captures_of(path.rsplit("/", 1)[1], archive), names)

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                store, at = file_system(path)
                with store.open_input_file(at) as raw:
                    yield run(path, raw)

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield run(path, io.BytesIO(content))

    try:
        file_system(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):  # a store that only Spark reads: archives come as rows
        return files.select("path", "content").mapInPandas(held, CAPTURE)
    return files.select("path").mapInPandas(opened, CAPTURE)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "refers_to"):
        df[c] = df[c].astype("Int64")
    return df


class LoserTree:
    """Merges sorted lists: inner nodes hold the loser of their match, the winner moves up."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * self.k
        self.head = [key(r[0]) if r else None for r in runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._replay(i, first=True)

    def _less(self, i: int, j: int) -> bool:
        a, b = self.head[i], self.head[j]
        return a is not None and (b is None or (a, i) < (b, j))

    def _replay(self, i: int, first: bool = False) -> None:
        node = (i + self.k) // 2
        while node:
            j = self.tree[node]
            if first and j < 0:
                self.tree[node] = i
                return
            if self._less(j, i):
                self.tree[node], i = i, j
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.head[i := self.tree[0]] is not None:
            run, at = self.runs[i], self.at[i]
            yield run[at]
            self.at[i] = at + 1
            self.head[i] = self.key(run[at + 1]) if at + 1 < len(run) else None
            self._replay(i)


def merge(captures: DataFrame, range_rows: int = 20_000) -> DataFrame:
    """Captures with range and pos, together a global order by URL key, timestamp and id, and seen, a capture's place among those of its key in its range. captures holds each run in order within a partition, as read() gives them."""
    names = captures.columns
    count = captures.count()
    n_ranges = max(1, -(-count // range_rows))
    splits: list[tuple] = []
    if n_ranges > 1:
        part = captures.select("url_key", "ts", "page_id").sample(min(1.0, SPLIT_SAMPLE / count), seed=3).limit(2 * SPLIT_SAMPLE)
        keys = sorted(_order(tuple(r)) for r in part.collect())
        splits = sorted({keys[len(keys) * k // n_ranges] for k in range(1, n_ranges)}) if keys else []

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Numbers a run's captures and names the range of each, walking run and splitters side by side."""
        run, seq, at = None, 0, 0
        for batch in batches:
            ranges, seqs = [], []
            for row in zip(batch["archive"], batch["url_key"], batch["ts"], batch["page_id"], strict=True):
                if row[0] != run:
                    run, seq, at = row[0], 0, 0
                key = (row[1], row[2], not pd.isna(row[3]), 0 if pd.isna(row[3]) else int(row[3]))
                while at < len(splits) and splits[at] <= key:
                    at += 1
                ranges.append(at)
                seqs.append(seq)
                seq += 1
            yield batch.assign(range=ranges, seq=seqs)

    cut_up = captures.mapInPandas(pieces, CAPTURE + ", range int, seq bigint")
    dealt = cut_up.repartition(n_ranges, "range").sortWithinPartitions("range", "archive", "seq")

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(number: int, rows: list[tuple]) -> Iterator[pd.DataFrame]:
            runs: dict[str, list[tuple]] = {}
            for r in rows:
                runs.setdefault(r[where], []).append(r)
            tree, k, key, seen = iter(LoserTree(list(runs.values()), _order)), 0, None, 0
            while done := list(islice(tree, 10_000)):
                places = []
                for r in done:
                    key, seen = (key, seen + 1) if r[0] == key else (r[0], 1)
                    places.append(seen)
                yield _frame(done, names).assign(range=number, pos=range(k, k + len(done)), seen=places)
                k += len(done)

        where, now, held = names.index("archive"), None, []
        for batch in batches:
            own = batch[names].astype(object).where(batch[names].notna(), None)
            for number, row in zip(batch["range"], own.itertuples(index=False, name=None), strict=True):
                if number != now and held:
                    yield from out(now, held)
                    held = []
                now = number
                held.append(row)
        if held:
            yield from out(now, held)

    return dealt.mapInPandas(merged, CAPTURE + ", range int, pos bigint, seen bigint")


def round_trip(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes pages as archives, reads them back and merges their indexes into histories."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, **columns)
    return histories(merge(cut(read(spark, folder))))


def histories(merged: DataFrame) -> DataFrame:
    """merged with nth, a capture's place in the history of its URL key. At most one key a range goes on from the one before."""
    merged = cut(merged)
    last = merged.groupBy("range").agg(F.max_by(F.struct("url_key", "seen"), "pos").alias("x")).select("x.url_key", "range", F.lit(1).alias("end"), "x.seen")
    first = merged.where("pos = 0").select("url_key", "range", F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("seen"))
    so_far = Window.partitionBy("url_key").orderBy("range", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # two rows a range; splitters are of a sample, so ranges are 2 * SPLIT_SAMPLE at most
    carried = first.unionByName(last).withColumn("carried", F.sum("seen").over(so_far)).where("end = 0 and carried > 0").select("range", "url_key", "carried")
    return merged.join(F.broadcast(carried), ["range", "url_key"], "left").withColumn("nth", F.col("seen") + F.coalesce("carried", F.lit(0))).drop("carried", "seen")
