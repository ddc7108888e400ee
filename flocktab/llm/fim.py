"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of FRAME code points each, with the cumulative counts of code points at
their ends. To cut a text at a place, the counts name the frame, and only that frame is decompressed; whole frames move
compressed, as they are. A transformed text is again such a list of frames: the parts in their new order with small frames
for the markers between. Digests come from the frames streamed in order, so a task holds one frame of plain text, however
long the text is. Forms and cuts are SQL functions of the id and the count alone.

Defined results. Null text: the empty one, form plain. A text with a marker in it is plain, so that a transformed text has
each marker once and the exact text can be rebuilt from it. Null ids cut like an empty id. Repeated rows are rows of their
own. A very long text is many frames. An empty table gives an empty table. Other columns stay, but for those named
as a new one, which are replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

FRAME = 1 << 16
# The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FRAMES = "frames array<binary>, ends array<long>"
#: Which part follows which marker, by form; parts: 0 prefix, 1 middle, 2 suffix.
ORDERS = {"psm": [(PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)], "spm": [(SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)]}

Store = tuple[list[bytes], list[int]]


def packed(text: str) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(text.encode())


def unpacked(frame: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(frame).decode()


def stored(text: str, size: int = FRAME) -> Store:
    """A text as frames, and the code points up to the end of each."""
    parts = [text[k : k + size] for k in range(0, len(text), size)]
    return [packed(p) for p in parts], [min(len(text), k + size) for k in range(0, len(text), size)]


def chosen(store: Store, low: int, high: int) -> Iterator[tuple[bytes, int]]:
    """The frames of code points low to high, with their counts; those that a bound cuts are packed anew."""
    frames, ends = store
    at = bisect_right(ends, low)
    while low < high:
        begin, end = (ends[at - 1] if at else 0), ends[at]
        if low == begin and high >= end:
            yield frames[at], end - begin
        else:
            part = unpacked(frames[at])[low - begin : min(high, end) - begin]
            yield packed(part), len(part)
        low, at = end, at + 1


def arranged(store: Store, form: str, first: int, second: int) -> Store:
    """The frames of the transformed text."""
    if form == "plain":
        return store
    n = store[1][-1]
    bounds, frames, ends = [(0, first), (first, second), (second, n)], [], []
    for marker, part in ORDERS[form]:
        for frame, units in [(packed(marker), len(marker)), *chosen(store, *bounds[part])]:
            frames.append(frame)
            ends.append((ends[-1] if ends else 0) + units)
    return frames, ends


def markers(store: Store) -> dict[str, int]:
    """Where each marker begins: one pass over the frames, with what of a marker may end one of them carried on."""
    out, tail, begin = {}, "", 0
    for frame in store[0]:
        seen = tail + unpacked(frame)
        for m in (PREFIX, SUFFIX, MIDDLE):
            if m not in out and (k := seen.find(m)) >= 0:
                out[m] = begin - len(tail) + k
        begin += len(seen) - len(tail)
        tail = seen[-2:]
    return out


def restored(store: Store, form: str) -> Iterator[bytes]:
    """The frames of the text that was transformed, from its markers."""
    if form == "plain":
        yield from store[0]
        return
    at = markers(store)
    order = [m for m, _ in ORDERS[form]]
    ends = {m: at[order[k + 1]] if k < 2 else store[1][-1] for k, m in enumerate(order)}
    for m in (PREFIX, MIDDLE, SUFFIX):
        for frame, _ in chosen(store, at[m] + len(m), ends[m]):
            yield frame


def digest(frames) -> str:
    """SHA-256 of the frames' text, streamed."""
    made, z = hashlib.sha256(), zstandard.ZstdDecompressor()
    for frame in frames:
        made.update(z.decompress(frame))
    return made.hexdigest()


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n (code points), marked (a marker stands in the text), frames and ends in place of the text."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(FRAMES)
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([stored(x) for x in batch], columns=["frames", "ends"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    held = docs.drop(*[c for c in ("n", "marked", "frames", "ends") if c != text_col])
    return held.select(*[c for c in held.columns if c != text_col], F.length(text).cast("long").alias("n"), marked.alias("marked"), made(text).alias("__s")).select("*", "__s.*").drop("__s")


def cuts(id_: Column, n: Column, marked: Column, seed: int = 1, rate: int = 90, spm: int = 20) -> list[Column]:
    """form, first and second: of 100 texts `rate` are transformed, of these `spm` of 100 with the suffix first; both cuts by hash of the id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    group = lambda k: F.conv(F.substring(h, 8 * k - 7, 8), 16, 10).cast("bigint")
    form = F.when((n == 0) | marked | (group(3) % 100 >= rate), "plain").when(group(4) % 100 < spm, "spm").otherwise("psm")
    a, b = group(1) % (n + 1), group(2) % (n + 1)
    return [form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second")]


def transform(held: DataFrame, id_col: str = "doc_id", seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """A store with form, prefix_chars and middle_chars (null if plain), and frames and ends of the transformed text."""

    @F.pandas_udf(FRAMES)
    def made(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([arranged((list(f), list(e)), *x) for f, e, *x in zip(*batch, strict=True)], columns=["frames", "ends"])

    form, first, second = cuts(F.col(id_col), F.col("n"), F.col("marked"), seed, rate, spm)
    planned = held.drop("form", "prefix_chars", "middle_chars").withColumns({"form": form, "__first": first, "__second": second})
    new = planned.withColumn("__s", made("frames", "ends", "form", "__first", "__second"))
    chars = lambda x: F.when(F.col("form") != "plain", x)
    return new.select(*[c for c in planned.columns if c not in ("frames", "ends", "__first", "__second")], chars(F.col("__first")).alias("prefix_chars"), chars(F.col("__second") - F.col("__first")).alias("middle_chars"), "__s.*")


def digests(made: DataFrame) -> DataFrame:
    """transform()'s rows with output_sha256 and restored_sha256, the text rebuilt from frames and form alone."""

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def hashed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(digest(f), digest(restored((list(f), list(e)), form))) for f, e, form in zip(*batch, strict=True)]
            yield pd.DataFrame(rows, columns=["output_sha256", "restored_sha256"])

    return made.withColumn("__d", hashed("frames", "ends", "form")).select(*[c for c in made.columns if c not in ("output_sha256", "restored_sha256")], "__d.*")


def texts(made: DataFrame) -> DataFrame:
    """transform()'s rows with text, the transformed text whole, in place of frames and ends."""

    @F.pandas_udf("string")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(["".join(map(unpacked, f)) for f in batch], dtype=object)

    return made.withColumn("text", whole("frames")).drop("frames", "ends")
