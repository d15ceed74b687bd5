"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

A text's five-word shingles are hashed once; the hash's high bits choose one of `bins` bins and each bin
keeps its least hash. An empty bin takes the value of a bin that its own fixed sequence of draws reaches
first among the filled ones (optimal densification). Of each bin's value, mixed with the bin's number so
that one value in many bins gives independent codes, `bits` low-order bits are stored, as hexadecimal.
Likeness of two fingerprints: the share m of equal codes, freed of chance matches as
(m - c) / (1 - c) with c = 2^-bits, and held within 0 and 1.

Defined cases: fewer words than a shingle form one shingle; a null text counts as empty; a text without
words has the fingerprint of zeros (no other text's codes are all zero but by a chance of 2^-2048), whose
likeness is 1 to another such text and 0 to any other; bytes that are no UTF-8 are read as U+FFFD; ids may be of
any type that has an order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

BINS, BITS, SHINGLE, RANGE_SAMPLE = 256, 8, 5, 100
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    words = text.split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(h))
    if not size:
        return h
    n, total = len(h) - size + 1, np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        total = mix(total + h[j : j + n] * _ODD[j % 5])
    return total


@lru_cache
def draws(bins: int, upto: int) -> np.ndarray:
    """Row t: the t-th bin that each bin draws."""
    t, b = np.arange(upto, dtype=np.uint64)[:, None], np.arange(bins, dtype=np.uint64)[None, :]
    return (mix(mix(t + np.uint64(1)) + b * _ODD[1]) % np.uint64(bins)).astype(np.int32)


def fingerprint(text: bytes | None, bins: int = BINS, bits: int = BITS, size: int = SHINGLE) -> np.ndarray:
    """The codes, one a bin, as bytes; zeros without words. bins is a power of two, bits at most 8."""
    h = shingle_hashes(text or b"", size)
    if not len(h):
        return np.zeros(bins, np.uint8)
    at = (h >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64)
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, at, h)
    filled = np.zeros(bins, bool)
    filled[at] = True
    source, empty, upto = np.arange(bins), np.flatnonzero(~filled), 64
    if filled.sum() == 1:
        source[:] = at[0]
        empty = empty[:0]
    while len(empty):
        drawn = draws(bins, upto)[:, empty]
        hits = filled[drawn]
        first = hits.argmax(axis=0)
        done = hits[first, np.arange(len(empty))]
        source[empty[done]] = drawn[first[done], np.flatnonzero(done)]
        empty, upto = empty[~done], upto * 4
    codes = mix(least[source] + np.arange(bins, dtype=np.uint64) * _ODD[2]) & np.uint64((1 << bits) - 1)
    return codes.astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> float:
    if not a.any() or not b.any():
        return float(not a.any() and not b.any())
    chance = 2.0**-bits
    return min(1.0, max(0.0, (float(np.mean(a == b)) - chance) / (1 - chance)))


def pack(codes: np.ndarray, bits: int = BITS) -> str:
    """Lowest bit of the first code first, in whole bytes, as hexadecimal."""
    if bits == 8:
        return codes.tobytes().hex()
    return np.packbits(np.unpackbits(codes[:, None], axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes().hex()


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row in a range of places (column `range`, rows sorted by place: id and text hash), and the row after
    each range's last also there, marked `after`: so a task finds each row's successor in its own rows.
    The texts are shuffled once, each range to a task of its own. Ranges are cut at the quantiles of a
    sample of places, about RANGE_SAMPLE a range, so neither null ids nor an id that repeats are one range."""
    spark = docs.sparkSession
    n = partitions(spark)
    id_ = F.col(id_col)
    order = F.struct(id_.isNotNull().alias("some"), id_.alias("id"), F.xxhash64(text_col).alias("hash"))
    placed = docs.select(order.alias("place"), text_col)
    share = min(1.0, n * RANGE_SAMPLE / max(1, docs.count()))
    sample = sorted(placed.select("place.*").sample(share, seed=11).limit(2 * n * RANGE_SAMPLE).collect(), key=_order)
    cuts = sorted({_order(sample[len(sample) * i // n]) for i in range(1, n)}) if sample else []

    @F.arrow_udf("int")
    def range_of(places: pa.Array) -> pa.Array:
        return pa.array([bisect_right(cuts, _order(p.values())) for p in places.to_pylist()], pa.int32())

    ranged = placed.select(range_of("place").alias("range"), "place", text_col)
    firsts = ranged.groupBy("range").agg(F.min("place").alias("place")).collect()  # one row a range
    firsts.sort(key=lambda r: r["range"])
    known = [(r["range"], r["place"], firsts[i - 1]["range"]) for i, r in enumerate(firsts)]
    known = spark.createDataFrame(known, f"range int, first {ranged.schema['place'].dataType.simpleString()}, before int")
    own = F.struct("range", F.lit(False).alias("after"))
    more = F.struct(F.col("before").alias("range"), F.lit(True).alias("after"))
    homes = F.when(F.col("place").eqNullSafe(F.col("first")), F.array(own, more)).otherwise(F.array(own))
    rows = ranged.join(F.broadcast(known), "range").select(F.explode(homes).alias("home"), "place", text_col)
    return rows.select("home.*", "place", text_col).repartitionById(n, F.col("range")).sortWithinPartitions("range", "after", "place")


def _order(place) -> tuple:
    """A place in Spark's order: rows without id first."""
    some, id_, text_hash = place
    return some, 0 if id_ is None else id_, text_hash is not None, text_hash or 0


SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _prints(bins: int, bits: int, size: int):
    def row(doc, after):
        id_, text, codes = doc
        changed = edited(text, after[1]).encode()
        new = fingerprint(changed, bins, bits, size)
        return id_, len(text), hashlib.sha256(changed).hexdigest(), pack(codes, bits), pack(new, bits), likeness(codes, new, bits), likeness(codes, after[2], bits)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = pa.schema([("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        held = None  # the row whose successor is still to come
        for batch in batches:
            out, schema = [], pa.schema([batch.schema.field(2).with_name("id"), *rest])
            for at, after, id_, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if after and held is None:
                    continue  # another row with the same place
                text = (text or b"").decode(errors="replace")
                doc = id_, text, fingerprint(text.encode(), bins, bits, size)
                if held is not None:
                    out.append(row(held, doc))
                held = None if after else doc
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return of


def print_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", bins: int = BINS, bits: int = BITS, size: int = SHINGLE) -> DataFrame:
    """Per row: its fingerprint, that of its edited text (the last half replaced by as much of the next
    row's start), and the likenesses of the fingerprint to the edited text's and to the next row's.
    Rows are in the order of their ids, null first, rows of one id by the hash of their texts; the first
    comes after the last."""
    rows = with_next(docs, id_col, text_col).select("range", "after", F.col("place.id").alias("id"), F.col(text_col).cast("binary"))
    return rows.mapInArrow(_prints(bins, bits, size), f"id {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}")


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return print_documents(docs).withColumnRenamed("id", "doc_id")
