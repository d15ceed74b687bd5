"""SimHash near-dedup by a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Fingerprints that differ in at most 3 bits differ in at most 3 bytes, so
they share at least 5 bytes at the same positions: the guaranteed minimum. Of any 5 of 8 positions at
least 3 lie in the first or in the last half, so postings are kept by three bytes of one half (8 lists a
fingerprint, 2^24 values each) instead of by one byte, whose lists would each hold 1/256 of the corpus.
Within a list the shared positional bytes of each pair are tallied, pairs under the minimum go, and the
rest is verified by its differing bits. Equal fingerprints are one entry, so copies never form pairs. A
long list is cut into tiles of at most 2 x TILE entries that separate tasks compare; each tile returns
a spanning forest of its links, never the pairs.

Defined cases: a null text has no words, like an empty one: its fingerprint is zero, and is linked like
any other; fewer words than a shingle form one shingle; a null id never names a group that has another;
rows with the same id and text are alike (one of them stays in `keep_one`); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from operator import getitem

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, row_key, save
from .components import components

BYTES, MAX_BITS, TILE, SEED = 8, 3, 2048, 42
LISTS = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of `size` words joined by one space; all words if there are fewer; none without words."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return list(map(getitem, repeat(joined), map(slice, starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())))


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """64 bits, each 1 if it is set in over half of the shingles' XXH64 values; as a signed integer."""
    runs = shingles(text.lower().split(), size) if text else []
    if not runs:
        return 0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(runs))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, BYTES)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, size: int = 3) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    return of(text.cast("binary"))


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _lists(fp: Column) -> Column:
    """The keys of a fingerprint's postings: which three positions, and their bytes."""
    return F.array(*[F.lit(n << 24) + _byte(fp, a) * 65536 + _byte(fp, b) * 256 + _byte(fp, c) for n, (a, b, c) in enumerate(LISTS)])


def forest(members: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever `max_bits` connects among the members, one fewer than members at most."""
    octets = np.ascontiguousarray(members).view(np.uint8).reshape(-1, BYTES)
    label, least = np.arange(len(members)), BYTES - max_bits
    step = max(1, (1 << 19) // len(members))
    for at in range(0, len(members), step):
        rows = slice(at, min(at + step, len(members)))
        tally = np.zeros((rows.stop - at, len(members)), np.uint8)
        for p in range(BYTES):
            tally += octets[rows, p, None] == octets[None, :, p]
        i, j = np.nonzero(tally >= least)
        near = np.bitwise_count(members[rows][i] ^ members[j]) <= max_bits
        i, j = i[near], j[near]
        bounds = np.searchsorted(i, np.arange(rows.stop - at + 1))
        for row in range(rows.stop - at):
            met = label[j[bounds[row] : bounds[row + 1]]]  # a row is always near itself
            if (met != met[0]).any():
                met = np.unique(met)
                label[np.isin(label, met)] = met[0]
    linked = np.flatnonzero(label != np.arange(len(members)))
    return members[linked], members[label[linked]]


def _link_tiles(max_bits: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by list and tile; a tile's rows may come in two batches."""
        kept_keys, kept = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
        for batch in _ended(batches):
            if batch is not None:
                keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], axis=1)
                kept_keys = np.concatenate((kept_keys, keys))
                kept = np.concatenate((kept, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(kept):
                continue
            cuts = np.flatnonzero((kept_keys[1:] != kept_keys[:-1]).any(axis=1)) + 1
            bounds = np.concatenate(([0], cuts, [len(kept)] if batch is None else []))
            found = _forests(kept, bounds.astype(np.int64), max_bits)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], ["a", "b"])
            kept_keys, kept = kept_keys[int(bounds[-1]) :], kept[int(bounds[-1]) :]

    return of


def _ended(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _forests(members: np.ndarray, bounds: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(bounds)
    two = bounds[:-1][sizes == 2]
    a, b = members[two], members[two + 1]
    tally = (a.view(np.uint8).reshape(-1, BYTES) == b.view(np.uint8).reshape(-1, BYTES)).sum(axis=1)
    near = (tally >= BYTES - max_bits) & (np.bitwise_count(a ^ b) <= max_bits)
    parts = [(a[near], b[near])]
    for n in np.flatnonzero(sizes > 2):
        parts.append(forest(members[bounds[n] : bounds[n + 1]], max_bits))
    return tuple(np.concatenate([p[k] for p in parts]) for k in (0, 1))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """(fp) without repeats -> (a, b): links that connect what `max_bits` differing bits connect."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the index guarantees matches for 0 to 3 differing bits")
    index = distinct.select(F.explode(_lists(F.col("fp"))).alias("list"), "fp")
    sizes = save(index.groupBy("list").agg(F.count("*").alias("n")).where("n > 1"))
    shared = index.join(sizes, "list").withColumn("chunks", F.ceil(F.col("n") / tile))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    tiles = shared.select("list", own.alias("own"), other.alias("other"), "fp")
    tiles = tiles.select("list", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    n = partitions(distinct.sparkSession)
    tiles = tiles.repartition(n, "list", "low", "high").sortWithinPartitions("list", "low", "high", "fp")
    return tiles.mapInArrow(_link_tiles(max_bits), "a long, b long")


def simhash_groups(docs: DataFrame, *, id_col="doc_id", text_col="text", size: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """id, key (128 bits of hash of id and text), fp, component_id, first_key: the smallest id that links reach from
    the row, and the key of the row that bears it."""
    id_, text = F.col(id_col), F.col(text_col)
    prints = save(docs.select(id_.alias("id"), row_key(id_, text).alias("key"), fingerprints(text, size).alias("fp")))
    low = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("low")
    distinct = save(prints.groupBy("fp").agg(low))
    parts = components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    first = save(rooted.groupBy("root").agg(F.min("low").alias("low")))
    named = save(rooted.select("fp", "root").join(first, "root").select("fp", F.col("low.id").alias("component_id"), F.col("low.key").alias("first_key")))
    return prints.join(named, "fp").select("id", "key", "fp", "component_id", "first_key")


def keep_one(docs: DataFrame, *, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The row with the smallest id of each group, with its columns as they are."""
    groups = simhash_groups(docs, id_col=id_col, text_col=text_col, **options)
    keys = groups.where("key = first_key").select("key").distinct()
    one = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), one)
    return rows.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    groups = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")
