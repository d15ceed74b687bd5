"""Suffix-array dedup by difference-cover blockwise construction.

What is removed are bytes covered by a string of `window` bytes that also starts elsewhere: by neighbours in the
suffix array with that many bytes in common. The array is never held: a difference cover D of the period v, less
than the window, has for every distance two members that far apart (modulo v). So for any two suffixes there is
a shift below v that brings both to sample places (places in a document whose remainder by v is in D), and if
their first `window` bytes are equal, then so are the window - v + 1 bytes from there on.

1. Cover sample. Of every document the sample places, 12 of 133, are ranked by the window - v + 1 bytes that follow,
   among all documents: what is needed of a rank is which places share it.
2. Long ties. A suffix none of whose next v places is a sample place with a shared rank cannot agree with another for a
   window: it is settled and goes no further. About a fifth of all suffixes remain where a seventh of all
   windows are repeated (measured on 0.16 GB of documents).
3. Blockwise. The remaining suffixes are dealt to PASSES blocks by their first three bytes, and one block at a time
   is sorted in buckets and compared for the whole window, so disk and memory hold one block of suffixes.

Ranks and the order within a bucket are those of 96-bit names (64 for the sample, where an equal name by chance only
costs a comparison) made of the bytes themselves, so that all tasks agree on them without the text at hand; the order
of letters, which the result does not need, is not kept. Of 10^13 compared suffixes the chance of any wrong
removal is under 1 in 1000.

Exact copies of a text are counted first: all of their bytes go, if they have a window, and only one of them is
compared with the other texts. The exchanges are those of `substrings.repeats`: packed numbers by part and bucket, what
is repeated within a part is sent once. Texts that may have repeats are written once with their sample's answers, and
read from there in every pass.

Defined cases: a null text has no bytes; texts shorter than a window keep all bytes; rows with the same id and text are
documents that repeat each other; ids may be null and of any type that workers can read; other columns are
ignored; an empty table gives no rows. A document longer than PART_BYTES is a part by itself, whose names are
made piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwise.plans.tables import discard

from .common import attach, batches_of, partitions, save, tidy_shuffles
from .minhash import mix
from .substrings import FILTER_BITS, _bitmap, _halves, _planes, _unplanes, doc_key, repeats

WINDOW, PASSES, PART_BYTES, BUCKET_BYTES, BATCH = 200, 3, 1 << 21, 1 << 24, 2000
#: Perfect difference sets by period, fixed values: every distance modulo the period lies between exactly one pair.
COVERS = {7: (0, 1, 3), 31: (1, 5, 11, 24, 25, 27), 133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)}
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def period_of(window: int) -> int:
    """The longest period of a known cover that leaves a third of the window to the sample's ranks."""
    fitting = [v for v in COVERS if 3 * v <= 2 * window]
    if not fitting:
        raise ValueError("windows have at least 11 bytes")
    return max(fitting)


@lru_cache
def _letters(which: int) -> np.ndarray:
    """64 bits for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[which]))


def names(text: np.ndarray, at: np.ndarray, length: int, which: int = 0, piece: int = PART_BYTES) -> np.ndarray:
    """64 bits of hash of the `length` bytes from each of these rising places on: sums of powers of an odd number modulo
    2^64, put together from spans of 1, 2, 4 ... bytes, a piece of the text at a time."""
    out = np.empty(len(at), np.uint64)
    base = _BASES[which]
    for low in range(0, len(text), piece):
        a, b = np.searchsorted(at, (low, low + piece))
        if a == b:
            continue
        span, size, here = _letters(which)[text[low : low + piece + length]], 1, at[a:b] - low
        total, done = np.zeros(b - a, np.uint64), 0
        while size <= length:
            power = np.uint64(pow(base, size, 1 << 64))
            if length & size:
                total = total * power + span[here + done]
                done += size
            if 2 * size <= length:
                span = span[:-size] * power + span[size:]
            size *= 2
        out[a:b] = mix(total)
    return out


def sample_places(sizes: np.ndarray, window: int) -> np.ndarray:
    """Documents of these sizes, one after the other -> the cover sample's places."""
    v = period_of(window)
    in_cover = np.zeros(v, bool)
    in_cover[list(COVERS[v])] = True
    starts = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    return np.flatnonzero(in_cover[within % v] & (within <= np.repeat(sizes, sizes) - (window - v + 1)))


def unsettled(size: int, shared: np.ndarray, window: int) -> np.ndarray:
    """Suffixes of a document of `size` bytes that one of these sample places, whose ranks are shared, may tie with others."""
    v, n = period_of(window), size - window + 1
    steps = np.bincount(np.clip(shared - v + 1, 0, n), minlength=n + 1) - np.bincount(np.clip(shared + 1, 0, n), minlength=n + 1)
    return np.flatnonzero(np.cumsum(steps)[:n] > 0)


def covered(at: np.ndarray, size: int, window: int) -> np.ndarray:
    """Whether each byte lies in a window that starts at one of these places."""
    steps = np.bincount(at, minlength=size + 1) - np.bincount(at + window, minlength=size + 1)
    return np.cumsum(steps)[:size] > 0


def _parts(batch: pa.RecordBatch, text_at: int, key_of: Callable[[int, bytes], bytes], window: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, keys, sizes and bytes of documents with a window, about PART_BYTES at once."""
    rows, keys, texts, held = [], [], [], 0
    for row, text in enumerate(batch.column(text_at)):
        text = text.as_py() or b""
        if len(text) >= window:
            rows.append(row)
            keys.append(key_of(row, text))
            texts.append(text)
            held += len(text)
        if held >= PART_BYTES or (row == batch.num_rows - 1 and rows):
            yield rows, _halves(b"".join(keys)), np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8)
            rows, keys, texts, held = [], [], [], 0


def _ask_sample(window: int) -> Callable:
    """Rows: id, text."""

    def ask(batch: pa.RecordBatch) -> Iterator[tuple]:
        for _, keys, sizes, text in _parts(batch, 1, lambda row, t: doc_key(batch.column(0)[row].as_py(), t), window):
            at = sample_places(sizes, window)
            yield keys, np.cumsum(sizes) - sizes, at, names(text, at, window - period_of(window) + 1), np.empty(0, np.uint32), np.empty(0, np.int64)

    return ask


def block_of(text: np.ndarray, at: np.ndarray, blocks: int) -> np.ndarray:
    """The block that each suffix falls in, by its first three bytes."""
    first = text[at].astype(np.uint64) << np.uint64(16) | text[at + 1].astype(np.uint64) << np.uint64(8) | text[at + 2]
    return (mix(first) >> np.uint64(40)) % np.uint64(blocks)


def _ask_block(window: int, block: int, blocks: int) -> Callable:
    """Rows: key, more, text, places of shared sample ranks."""

    def ask(batch: pa.RecordBatch) -> Iterator[tuple]:
        halves = [batch.column(c).to_numpy(zero_copy_only=False).astype("<i8") for c in (0, 1)]
        key_of = lambda row, _: halves[0][row : row + 1].tobytes() + halves[1][row : row + 1].tobytes()
        for rows, keys, sizes, text in _parts(batch, 2, key_of, window):
            starts = np.cumsum(sizes) - sizes
            at = [start + unsettled(size, _unplanes(batch.column(3)[row].as_py() or b""), window) for row, start, size in zip(rows, starts.tolist(), sizes.tolist(), strict=True)]
            at = np.concatenate(at)
            # only bytes of windows that are still open are named
            near = np.flatnonzero(covered(at, len(text), window))
            at = at[block_of(text, at, blocks) == block]
            close, there = text[near], np.searchsorted(near, at)
            more = (names(close, there, window, 1) >> np.uint64(32)).astype(np.uint32)
            yield keys, starts, at, names(close, there, window), more, np.empty(0, np.int64)

    return ask


def _open_texts(bits, inside: bool, with_text: bool) -> Callable:
    """Rows id, text -> key, more, text_key, text_more, id, text of those whose bit is set, or of those others."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, whole, rows = [], [], []
            for row, (id_, text) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                text = text.as_py() or b""
                key = doc_key(id_.as_py(), text)
                at = int(_halves(key)[0, 0]) % (1 << FILTER_BITS)
                if bool(bits.value[at >> 3] >> (at & 7) & 1) == inside:
                    keys.append(key)
                    whole.append(xxhash.xxh3_128_digest(text, 7) if inside else b"\0" * 16)
                    rows.append(row)
            keys, whole = _halves(b"".join(keys)), _halves(b"".join(whole))
            columns = [pa.array(c) for c in (keys[:, 0], keys[:, 1], whole[:, 0], whole[:, 1])]
            if with_text:
                columns += [batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "more", "text_key", "text_more", "id", "text"][: len(columns)])

    return of


_KEYS = "key long, more long, text_key long, text_more long"


def _finish(window: int, with_text: bool) -> Callable:
    """Rows: id, text, copied, answers -> the result."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                text, copied, answers = (batch.column(c)[row].as_py() for c in (1, 2, 3))
                text = text or b""
                n = len(text)
                gone = np.zeros(n, bool)
                if copied and n >= window:
                    gone[:] = True
                elif answers:
                    at = np.concatenate([_unplanes(a) for a in answers])
                    gone = covered(at[at <= n - window], n, window)
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
                out.append((n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]]
            yield pa.RecordBatch.from_arrays(columns[: 5 + with_text], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return of


def remove_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", window: int = WINDOW, passes: int = PASSES, with_text: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes as `kept`), after removing every byte
    that a repeated string of `window` bytes covers."""
    spark = docs.sparkSession
    period_of(window)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-total // BUCKET_BYTES))
    with batches_of(spark, BATCH), tidy_shuffles(spark):
        sample = save(repeats(texts, _ask_sample(window), buckets, _planes))
        bits = spark.sparkContext.broadcast(_bitmap(sample))
        shared = sample.groupBy("key", "more").agg(F.max("places").alias("places"))  # rows of one key have equal places
        keys = save(texts.mapInArrow(_open_texts(bits, True, False), _KEYS))
        copies = save(keys.groupBy("text_key", "text_more").agg(F.count("*").alias("n"), F.min(F.struct("key", "more")).alias("first")).where("n > 1").drop("n"))
        copied = attach(keys.distinct(), copies, ["text_key", "text_more"]).select("key", "more", (F.struct("key", "more") == F.col("first")).alias("leads"))
        known = shared.join(copied, ["key", "more"], "left")
        schema = f"{_KEYS}, id {id_type}, text binary"
        opened = texts.mapInArrow(_open_texts(bits, True, True), schema).drop("text_key", "text_more").join(known, ["key", "more"], "left")
        opened = save(opened)
        # a text's first copy stands for all of them
        asking = opened.where("places IS NOT NULL AND coalesce(leads, true)").select("key", "more", "text", "places")
        blocks = [save(repeats(asking, _ask_block(window, b, passes), max(1, buckets // passes), _planes)) for b in range(passes)]
        found = blocks[0]
        for b in blocks[1:]:
            found = found.unionByName(b)
        one = found.groupBy("key", "more").agg(F.collect_set("places").alias("answers"))  # one a block
        result = f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
        rows = opened.join(one, ["key", "more"], "left").select("id", "text", F.col("leads").isNotNull().alias("copied"), "answers")
        rows = save(rows.mapInArrow(_finish(window, with_text), result))
    discard(sample, keys, copies, opened, *blocks)
    rest = texts.mapInArrow(_open_texts(bits, False, True), schema)
    kept = F.coalesce("text", F.lit(b""))
    zero = F.lit(0).cast("long")
    columns = ["id", F.octet_length(kept).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256")]
    return rows.unionByName(rest.select(*columns, *([kept.alias("kept")] if with_text else [])))


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT r, unnest(range(0, len(x) // 2 - 199)) AS i FROM d WHERE len(x) >= 400),
g AS (SELECT s.r, s.i, md5(substr(d.x, 2 * s.i + 1, 400)) AS h FROM s JOIN d USING (r)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
e AS (SELECT r, i, 1 AS step FROM c UNION ALL SELECT r, i + 200, -1 FROM c UNION ALL SELECT r, 0, 0 FROM d),
f AS (SELECT r, i, sum(step) AS step FROM e GROUP BY r, i),
a AS (SELECT r, i, sum(step) OVER w AS open, lead(i) OVER w AS upto FROM f WINDOW w AS (PARTITION BY r ORDER BY i)),
b AS (SELECT *, lag(open, 1, 0) OVER (PARTITION BY r ORDER BY i) AS was FROM a),
k AS (
  SELECT r, CAST(coalesce(sum(upto - i) FILTER (open > 0), 0) AS BIGINT) AS n_removed, count(*) FILTER (open > 0 AND was = 0) AS n_spans,
         coalesce(string_agg(substr(x, 2 * i + 1, 2 * (coalesce(upto, len(x) // 2) - i)), '' ORDER BY i) FILTER (open = 0), '') AS kept
  FROM b JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(x) // 2 AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN k USING (r)
"""
