"""Substring dedup by recompression.

Words become symbols by rounds of recompression: maximal runs of one word get a name from the word and
the run's length, then in each round every symbol falls left or right by a bit of its name, and each left
symbol followed by a right one becomes a pair, named from both (runs are not paired; pairs are at most
2^ROUNDS words long). A name is a 64-bit hash of what it stands for, so equal runs and pairs get the same
name in every task and document without exchanging a dictionary. Whether two neighbours pair depends on
their own names only, so in equal texts all symbols are equal but for those near the ends: a round can
change one symbol at either end, 1 + 1 + 2 + 4 = 8 words in three rounds.

So every symbol inside the middle 35 - 2 x 8 words of a repeated window also occurs elsewhere. Symbols of
3 words or more are held against all others (`repeats`); windows with a symbol in the middle that occurs
once are unique. The other windows are verified by 96-bit hashes of their 35 words, again against all.

`repeats` moves numbers, not rows. A task takes its documents in parts of at most PART_WORDS words and
sorts a part's hashes into buckets, one row of packed numbers a bucket. What is repeated within the part is
known there and sent once, so a hash in a third of all documents costs its bucket one entry a part. A
bucket finds the hashes that occurred twice and answers the part with their places, packed again; the
answers of a part come together once more and give one row for each of its documents. The texts' bytes are
summed first: there is a bucket for every BUCKET_BYTES of them, and at least one a shuffle partition; reducers
take their buckets one at a time, so what a task holds at once does not grow with the corpus. Documents are known by 128 bits of hash of id and text. Text is
exchanged only for documents that may have repeats: their keys' bitmap (4 MB, whatever the corpus) is broadcast;
keys that fall together only cost an exchange.

Defined cases: a null text has no words; texts shorter than a window keep all words; rows with the same id
and text are documents that repeat each other; ids may be null and of any type that workers can read; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, partitions, save
from .minhash import mix

WINDOW, ROUNDS, LEAST, FILTER_BITS, PART_WORDS, BUCKET_BYTES, BATCH = 35, 3, 3, 25, 1 << 19, 1 << 25, 2000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def doc_key(id_: object, text: bytes) -> bytes:
    """128 bits; null and no id differ."""
    return xxhash.xxh3_128_digest(text, xxhash.xxh3_64_intdigest(repr(id_)))


def _halves(keys: bytes) -> np.ndarray:
    """Keys, one after the other -> two columns of whole numbers."""
    return np.frombuffer(keys, "<i8").reshape(-1, 2)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def recompress(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and their documents -> name, first word, number of words, whether a run."""
    if not len(words):
        return words, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    start = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (doc[1:] != doc[:-1]))))
    size = np.diff(np.append(start, len(words)))
    run, doc = size > 1, doc[start]
    name = np.where(run, mix(words[start] * _A + size.astype(np.uint64)), words[start])
    for turn in range(rounds):
        right = mix(name ^ (_B >> np.uint64(turn))) >> np.uint64(63) == 1
        pairs = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:]) & ~run[:-1] & ~run[1:]
        head = np.flatnonzero(pairs)
        stays = np.ones(len(name), bool)
        stays[head + 1] = False
        name[head] = mix(mix(name[head] * _B) + name[head + 1] * _C)
        size[head] += size[head + 1]
        name, start, size, run, doc = name[stays], start[stays], size[stays], run[stays], doc[stays]
    return name, start, size, run


def witnesses(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, first words and sizes of the symbols that are held against all others."""
    name, start, size, run = recompress(words, doc)
    use = (size >= LEAST) & ~run
    return name[use], start[use], size[use]


def unsure(starts: np.ndarray, sizes: np.ndarray, doc: np.ndarray, first: np.ndarray, size: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Documents of `sizes` words begin at `starts`. Of all their windows those that have none of these
    symbols (of document `doc`, from word `first` on) in their middle, by their first words."""
    edge, n = 1 << ROUNDS, int(sizes.sum())
    low = np.maximum(first + size - (window - edge), starts[doc])
    high = np.minimum(first - edge, (starts + sizes)[doc] - window)
    ok = low <= high
    covered = np.cumsum(np.bincount(low[ok], minlength=n + 1) - np.bincount(high[ok] + 1, minlength=n + 1))[:n]
    fits = np.ones(n + 1, np.int64)
    fits[:n] -= np.arange(n) > np.repeat(starts + sizes - window, sizes)
    return np.flatnonzero((covered == 0) & (fits[:n] == 1))


def window_hashes(words: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of hash of the windows that start at these words: sums of powers of odd numbers modulo
    2^64, put together from spans of 1, 2, 4 ... words."""
    out = []
    for base, twist in ((int(_A), _B), (int(_C), _A)):
        span, length = mix(words ^ twist), 1
        total, done = np.zeros(len(at), np.uint64), 0
        while length <= window:
            power = np.uint64(pow(base, length, 1 << 64))
            if window & length:
                total = total * power + span[at + done]
                done += length
            if 2 * length <= window:
                span = span[:-length] * power + span[length:]
            length *= 2
        out.append(mix(total))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def _planes(numbers: np.ndarray) -> bytes:
    """Rising numbers as differences, byte by byte of all: mostly zeros, which shuffle files compress."""
    return np.diff(numbers, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64))


_ROW = "bucket int, origin long, hashes binary, more binary, known binary, places binary, keys binary, starts binary"
_ROW_SCHEMA = pa.schema([("bucket", pa.int32()), ("origin", pa.int64()), *((c, pa.binary()) for c in ("hashes", "more", "known", "places", "keys", "starts"))])


def _twice(h: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes occur more than once; which are the first of theirs. `more` may be empty."""
    order = np.lexsort((more, h)) if len(more) else np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    if len(more):
        same &= more[order][1:] == more[order][:-1]
    twice, first = np.zeros(len(h), bool), np.ones(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    first[order[1:][same]] = False
    return twice, first


def _pack(buckets: int, keys: np.ndarray, starts: np.ndarray, place: np.ndarray, h: np.ndarray, more: np.ndarray, named: np.ndarray) -> pa.RecordBatch:
    """A part's hashes with their places (counted through its documents, whose places begin at `starts`) -> a
    row for each bucket, and one with bucket -1: the documents' keys, the places known to be repeated, and the
    documents to be named in any case."""
    origin = xxhash.xxh3_64_intdigest(keys.tobytes()) - (1 << 63)
    twice, first = _twice(h, more)
    out = [(-1, origin, b"", b"", named.astype("<u4").tobytes(), _planes(place[twice]), keys.tobytes(), _planes(starts))]
    bucket = (h >> np.uint64(33)).astype(np.int64) % buckets
    sent = np.flatnonzero(first)
    sent = sent[np.argsort(bucket[sent], kind="stable")]
    cuts = np.searchsorted(bucket[sent], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        at = sent[cuts[b] : cuts[b + 1]]
        out.append((b, origin, h[at].tobytes(), more[at].tobytes() if len(more) else b"", np.packbits(twice[at]).tobytes(), _planes(place[at]), b"", b""))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ROW_SCHEMA, strict=True)], schema=_ROW_SCHEMA)


_ANSWER = "origin long, places binary, named binary, keys binary, starts binary"
_ANSWER_NAMES = ["origin", "places", "named", "keys", "starts"]


def _answers(parts: list[tuple]) -> pa.RecordBatch | None:
    """A bucket's rows -> to each part the places whose hashes occurred twice. Bucket -1 passes through."""
    if not parts:
        return None
    if parts[0][0] < 0:
        rows = [(p[1], p[5], p[4], p[6], p[7]) for p in parts]
    else:
        counts = [len(p[2]) // 8 for p in parts]
        h, more = np.frombuffer(b"".join(p[2] for p in parts), np.uint64), np.frombuffer(b"".join(p[3] for p in parts), np.uint32)
        known = np.concatenate([np.unpackbits(np.frombuffer(p[4], np.uint8), count=n).astype(bool) for p, n in zip(parts, counts, strict=True)])
        hits = np.split(_twice(h, more)[0] & ~known, np.cumsum(counts)[:-1])
        rows = [(p[1], _planes(_unplanes(p[5])[hit]), b"", b"", b"") for p, hit in zip(parts, hits, strict=True) if hit.any()]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.binary()] * 4], strict=True)], _ANSWER_NAMES)


def _grouped(batches: Iterator[pa.RecordBatch], finish: Callable, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Calls finish with the rows of each value of the first column, by which they are sorted."""
    value, parts = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in batch.columns)
            if row[0] != value or (row[0] == most and len(parts) >= 64):
                if (out := finish(parts)) is not None:
                    yield out
                value, parts = row[0], []
            parts.append(row)
    if (out := finish(parts)) is not None:
        yield out


def as_u4(places: np.ndarray) -> bytes:
    return places.astype("<u4").tobytes()


def _by_document(rows: list[tuple], encode: Callable[[np.ndarray], bytes]) -> pa.RecordBatch | None:
    """A part's answers -> (key, more, places) of its documents that have any, and of those named."""
    if not rows:
        return None
    keys, starts, named = _halves(b""), np.empty(0, np.int64), np.empty(0, np.int64)
    for r in rows:
        if r[3]:
            keys, starts, named = _halves(r[3]), _unplanes(r[4]), np.frombuffer(r[2], "<u4").astype(np.int64)
    at = np.sort(np.concatenate([_unplanes(r[1]) for r in rows]))
    doc = np.searchsorted(starts, at, "right") - 1
    wanted = np.union1d(np.unique(doc), named)
    low, high = np.searchsorted(doc, wanted), np.searchsorted(doc, wanted, "right")
    places = [encode(at[a:b] - starts[d]) for d, a, b in zip(wanted.tolist(), low.tolist(), high.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(keys[wanted, 0]), pa.array(keys[wanted, 1]), pa.array(places, pa.binary())], ["key", "more", "places"])


def repeats(rows: DataFrame, ask: Callable, buckets: int, encode: Callable[[np.ndarray], bytes] = as_u4) -> DataFrame:
    """ask: batch -> (keys, starts, places, hashes, more hash, documents to name) of each part -> (key,
    more, places): of every document the places whose hashes occur at least twice among all rows. Buckets are dealt to
    the session's reducers, which read them one at a time."""
    reducers = partitions(rows.sparkSession)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ask(batch):
                yield _pack(buckets, *part)

    asked = rows.mapInArrow(asking, _ROW)
    spread = F.when(F.col("bucket") < 0, F.pmod("origin", F.lit(buckets))).otherwise(F.col("bucket")).cast("int")
    asked = asked.repartition(reducers, spread).sortWithinPartitions("bucket")
    answered = asked.mapInArrow(lambda batches: _grouped(batches, _answers, -1), _ANSWER)
    answered = answered.repartition(reducers, "origin").sortWithinPartitions("origin")
    return answered.mapInArrow(lambda batches: _grouped(batches, lambda parts: _by_document(parts, encode)), "key long, more long, places binary")


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], bytes]]:
    for row, (id_, text) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
        text = text.as_py() or b""
        yield row, text.split(), doc_key(id_.as_py(), text)


def _parts(batch: pa.RecordBatch, window: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, keys, starts, sizes and word hashes of documents that have a window, at most about PART_WORDS
    words at once (a longer document alone)."""
    rows, keys, words, held = [], [], [], 0
    for row, text, key in _documents(batch):
        if len(text) >= window:
            rows.append(row)
            keys.append(key)
            words.append(word_hashes(text))
            held += len(text)
        if held >= PART_WORDS or (row == batch.num_rows - 1 and rows):
            sizes = np.array([len(w) for w in words], np.int64)
            yield rows, _halves(b"".join(keys)), np.cumsum(sizes) - sizes, sizes, np.concatenate(words)
            rows, keys, words, held = [], [], [], 0


def _ask_symbols(window: int) -> Callable:
    def ask(batch: pa.RecordBatch) -> Iterator[tuple]:
        for _, keys, starts, sizes, words in _parts(batch, window):
            doc = np.repeat(np.arange(len(keys)), sizes)
            name, at, size = witnesses(words, doc)
            # windows without any symbol in the middle are verified in any case
            blind = unsure(starts, sizes, doc[at], at, size, window)
            yield keys, starts, at, name, np.empty(0, np.uint32), np.unique(doc[blind])

    return ask


def _ask_windows(window: int) -> Callable:
    """Rows: id, text, answers (lists of places of symbols that are repeated)."""

    def ask(batch: pa.RecordBatch) -> Iterator[tuple]:
        for rows, keys, starts, sizes, words in _parts(batch, window):
            doc = np.repeat(np.arange(len(keys)), sizes)
            _, at, size = witnesses(words, doc)
            single = np.ones(len(words), bool)
            for row, start in zip(rows, starts.tolist(), strict=True):
                for known in batch.column(2)[row].as_py() or []:
                    at_ = start + np.frombuffer(known, "<u4").astype(np.int64)
                    single[at_[at_ < len(words)]] = False
            at, size = at[single[at]], size[single[at]]
            where = unsure(starts, sizes, doc[at], at, size, window)
            yield keys, starts, where, *window_hashes(words, where, window), np.empty(0, np.int64)

    return ask


def _bitmap(keys: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits, those of the keys set."""
    at = F.pmod(F.col("key"), F.lit(1 << FILTER_BITS)) + 1  # Spark counts bitmap places from 1
    blocks = keys.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in blocks.toLocalIterator():
        low = (r["block"] - 1) * 4096
        out[low : low + 4096] |= np.frombuffer(r["bits"], np.uint8)
    return out


def _some(bits, with_text_of_all: bool, window: int) -> Callable:
    """Rows id, text -> key, more, id, text, n_words, kept_sha256. Without its bit a document has no repeat: its
    text is left out, and the row itself, or else its digest is complete."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, words, key in _documents(batch):
                halves = _halves(key)[0].tolist()
                at = halves[0] % (1 << FILTER_BITS)
                maybe = len(words) >= window and bits.value[at >> 3] >> (at & 7) & 1
                if maybe:
                    out.append((*halves, batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), len(words), None))
                elif with_text_of_all:
                    out.append((*halves, batch.column(0)[row].as_py(), None, len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            columns = zip(*out, strict=True) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), batch.column(0).type, pa.binary(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "more", "id", "text", "n_words", "kept_sha256"])

    return of


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """id, text as bytes; and the type of ids."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return texts, texts.schema["id"].dataType.simpleString()


def _some_schema(id_type: str) -> str:
    return f"key long, more long, id {id_type}, text binary, n_words long, kept_sha256 string"


def _buckets(texts: DataFrame) -> int:
    """By the texts' bytes."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(texts.sparkSession), -(-total // BUCKET_BYTES))


def repeated_windows(docs: DataFrame, *, id_col="doc_id", text_col="text", window: int = WINDOW) -> DataFrame:
    """(key, more, places): of each document with repeated windows, the first words of those. Written."""
    if window <= 2 << ROUNDS:
        raise ValueError(f"windows have more than {2 << ROUNDS} words")
    spark = docs.sparkSession
    texts, id_type = _texts(docs, id_col, text_col)
    buckets = _buckets(texts)
    with batches_of(spark, BATCH):
        symbols = save(repeats(texts, _ask_symbols(window), buckets))
        bits = spark.sparkContext.broadcast(_bitmap(symbols))
        answers = symbols.groupBy("key", "more").agg(F.collect_list("places").alias("answers"))
        some = texts.mapInArrow(_some(bits, False, window), _some_schema(id_type)).select("key", "more", "id", "text")
        return save(repeats(some.join(answers, ["key", "more"]).select("id", "text", "answers"), _ask_windows(window), buckets))


def remove_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 (and the kept words as `kept`), after removing every word
    that a repeated window covers."""
    spark = docs.sparkSession
    places = repeated_windows(docs, id_col=id_col, text_col=text_col, window=window)
    bits = spark.sparkContext.broadcast(_bitmap(places) if not with_text else np.full((1 << FILTER_BITS) // 8, 255, np.uint8))
    texts, id_type = _texts(docs, id_col, text_col)
    some = texts.mapInArrow(_some(bits, True, 0 if with_text else window), _some_schema(id_type))
    rows = some.join(places.groupBy("key", "more").agg(F.collect_list("places").alias("answers")), ["key", "more"], "left")
    schema = f"id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return rows.select("id", "text", "n_words", "kept_sha256", "answers").mapInArrow(_finish(window, with_text), schema)


def _finish(window: int, with_text: bool) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, text, n, digest, answers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept, removed = b"", 0
                if digest is None:
                    words = (text or b"").split()
                    at = np.frombuffer(b"".join(answers or []), "<u4").astype(np.int64)
                    at = at[at <= n - window]  # windows that begin in the text's last words would end beyond it
                    steps = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + window, n), minlength=n + 1)
                    gone = np.cumsum(steps)[:n] > 0
                    removed = int(gone.sum())
                    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if removed else b" ".join(words)
                    digest = hashlib.sha256(kept).hexdigest()
                out.append((id_, n, removed, digest, *([kept.decode()] if with_text else ())))
            columns = zip(*out, strict=True) if out else [[]] * (4 + with_text)
            types = [batch.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["id", "n_words", "n_removed", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names[: 4 + with_text])

    return of


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT s.r, s.i, md5(array_to_string(d.w[s.i : s.i + 34], ' ')) AS h FROM s JOIN d USING (r)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
e AS (SELECT r, i, 1 AS step FROM c UNION ALL SELECT r, i + 35, -1 FROM c),
f AS (SELECT r, i, sum(step) AS step FROM e GROUP BY r, i),
a AS (SELECT r, i, sum(step) OVER (PARTITION BY r ORDER BY i) AS open, lead(i) OVER (PARTITION BY r ORDER BY i) AS upto FROM f),
x AS (SELECT r, list(j) AS gone FROM (SELECT r, unnest(range(i, upto)) AS j FROM a WHERE open > 0) GROUP BY r),
k AS (
  SELECT d.r, string_agg(t.word, ' ' ORDER BY t.j) AS kept
  FROM d, unnest(d.w) WITH ORDINALITY AS t(word, j) ANTI JOIN (SELECT r AS xr, unnest(gone) AS xj FROM x) ON xr = d.r AND xj = t.j GROUP BY d.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(x.gone), 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN x ON x.r = d.r LEFT JOIN k ON k.r = d.r
"""
