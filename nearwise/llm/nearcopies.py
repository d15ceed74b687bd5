"""Near dedup by the Jaccard likeness of shingle sets: SimHash's byte-position index, then an exact join for the rest.

First the texts' SimHash fingerprints (of the same shingles) go through the index of `simhash`: postings by bytes at
their positions, shared bytes tallied, pairs under the guaranteed minimum dropped, the rest verified, first by bits
and then by the sets themselves. A likeness of 4/5 often means more than the 3 bits for which the index guarantees
matches, so an exact prefix-filter join follows, which finds every pair that the index cannot promise.

A text is the set of its five-word shingles (of lower-cased words, as 64-bit hashes). Sets of which 4/5 or
more are alike share an element among the first n - ceil(4n/5) + 1 of each, n being its size, in whatever
order all sets keep to; postings are kept for those. The order puts shingles last that a sample of texts
often has; the sample changes the lengths of lists, never what is found. Equal sets are one entry. Postings are
exchanged once, and only lists of two sets or more are written; lists of frequent elements are cut into chunks.

Each list has a hub, its least set. Each set that the index has not linked to it is verified against the hub that it
shares most postings with, so a large group of near copies is linked by as many pairs as it has sets; then, within each list, the
pairs whose sets are still in different components and whose sizes and places allow the likeness. Every pair of
the likeness is in one component after that. Long lists are cut into tiles that separate tasks compare. Before
texts are fetched, pairs whose sketches differ too much go: a sketch holds the parity of the set's elements by
residues, at least two for an element, so it differs in no more bits than the sets in elements. The rest is
verified by the sets themselves, of which only those in pairs are exchanged, as texts.

Sets are named by 64 bits of hash: among 10^10 different ones two or three pairs would count as equal.

Defined cases: a null text has no words, like an empty one; texts without words are alike; fewer words than
a shingle form one shingle; a null id never names a group that has another; rows with the same id and text
are alike (one of them stays); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from . import simhash
from .common import attach, batches_of, partitions, row_key, save
from .components import components
from .minhash import mix, shingle_hashes

SHINGLE, TILE, SAMPLE, OFTEN, MAX_OFTEN, SMALL, CHUNK, NARROW_ROWS = 5, 1024, 20_000, 20, 200_000, 512, 2048, 300_000
#: Texts and sketches are long: rows a batch that workers get at once; pairs of one text that a task verifies at once.
BATCH, VERIFY = 2000, 128


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles, sorted, without repeats."""
    return np.unique(shingle_hashes((text or b"").lower(), size))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard likeness of two sorted sets is at least 4/5; sets without elements are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def name_of(s: np.ndarray) -> int:
    return np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0).view(np.int64)


def sketch_of(s: np.ndarray) -> bytes:
    """The parity of the set's elements by residues: two or more for each element, a power of two."""
    bits = max(SMALL, 1 << (2 * len(s) - 1).bit_length()) if len(s) else SMALL
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of the same set with fewer residues, `size` bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, size // 8), axis=0)


def apart(a: bytes, b: bytes) -> int:
    """In how many elements two sets differ at least."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


_SET = "key string, set long, n int, small binary, sketch binary, first binary, fp long, id "


def _sets(size: int, often):
    """Rows: id, key, text -> the text's set: its name and size, its sketches, the elements that postings are
    kept for, in their order, and the text's SimHash fingerprint."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, count, _ = often.value
        for batch in batches:
            out = [[], [], [], [], [], []]
            for text in batch.column(2):
                s = shingle_set(text.as_py(), size)
                name, n, sketch = name_of(s), len(s), sketch_of(s)
                if len(token) and n:
                    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                    s = s[np.argsort(np.where(token[at] == s, count[at], 0), kind="stable")]
                first = s[: n + (-4 * n // 5) + 1] if n else s
                for column, value in zip(out, (name, n, folded(sketch, SMALL // 8).tobytes(), sketch, first.tobytes(), simhash.fingerprint(text.as_py(), size)), strict=True):
                    column.append(value)
            columns = [batch.column(1), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int64()), strict=True)), batch.column(0)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "set", "n", "small", "sketch", "first", "fp", "id"])

    return of


def _hashes(size: int):
    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t, size).view(np.int64) for t in texts])

    return of


def _often(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that a sample of texts often has, sorted; how often; into how many chunks their lists are cut."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    counts = some.select(F.explode(_hashes(size)("text")).alias("token")).groupBy("token").count()
    top = counts.where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "token").limit(MAX_OFTEN).toPandas()
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    count = top["count"].to_numpy(np.int64)[order]
    return token[order], count, np.ceil(count / share / CHUNK).astype(np.int64)


def _postings(often):
    """Rows: set, n, first -> a row for each of the elements; lists of frequent ones are dealt to chunks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, _, chunks = often.value
        for batch in batches:
            parts = [np.frombuffer(f, np.uint64) for f in batch.column(2).to_pylist()]
            sizes = [len(f) for f in parts]
            if not sum(sizes):
                continue
            found = np.concatenate(parts)
            names, n = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes) for c in (0, 1))
            place = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
            chunk = np.full(len(found), -1, np.int32)
            if len(token):
                at = np.minimum(np.searchsorted(token, found), len(token) - 1)
                cut = np.where(token[at] == found, chunks[at], 1)
                chunk = np.where(cut > 1, mix(names.view(np.uint64)) % cut.astype(np.uint64), -1).astype(np.int64).astype(np.int32)
            columns = [found.view(np.int64), chunk, names, n, place]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "chunk", "set", "n", "place"])

    return of


_LIST = "token long, chunk int, set long, n int, place int, hub long, hub_n int"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list and set: those of lists with two sets or more, with the list's first as `hub`. All rows
    of lists that are cut into chunks pass. Held between batches: the last row and its hub."""
    names = ["token", "chunk", "set", "n", "place"]
    held, hub, known = None, (0, 0), False  # a row that is first in its list, its hub, whether it went out
    for batch in _ended(batches):
        rows = None if batch is None else [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
        if rows is not None and not len(rows[0]):
            continue
        joined = rows if held is None else held if rows is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if joined is None:
            return
        token, chunk, name, n, place = joined
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (chunk[1:] != chunk[:-1])))
        start = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
        hub_name, hub_n = name[start], n[start]
        if held is not None:  # the first row of all is the held one, in a list that may have begun before
            own = start == 0
            hub_name, hub_n = np.where(own, hub[0], hub_name), np.where(own, hub[1], hub_n)
        single = new & np.concatenate((new[1:], [True])) & (chunk < 0)
        out = ~single
        if held is not None:
            out[0] = not known and (len(token) > 1 and not new[1] or bool(chunk[0] >= 0))
        last = len(token) - 1
        if rows is not None:
            went = bool(out[last]) or (last == 0 and known)
            held, hub, known = [x[last:] for x in joined], (int(hub_name[last]), int(hub_n[last])), went
        columns = [token, chunk, name, n, place, hub_name, hub_n]
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[out].astype(t)) for c, t in zip(columns, (np.int64, np.int32, np.int64, np.int32, np.int32, np.int64, np.int32), strict=True)], [*names, "hub", "hub_n"])


def _ended(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list and tile: the pairs of different components that may be alike."""
    kept = np.empty((0, 16), np.int64)
    for batch in _ended(batches):
        if batch is not None:
            numbers = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:8]], axis=1)
            sketches = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.int64).reshape(-1, 8)
            kept = np.concatenate((kept, np.hstack((numbers, sketches))))
        if not len(kept):
            continue
        cuts = np.flatnonzero((kept[1:, :3] != kept[:-1, :3]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), *([len(kept)] if batch is None else [])]
        for low, high in zip(bounds, bounds[1:]):
            name, n, place, root, own = kept[low:high, 3:8].T
            sketch = kept[low:high, 8:].view(np.uint64)
            both = kept[low, 1] != kept[low, 2]
            for i in range(len(name) - 1):
                rest = slice(i + 1, None)
                most = np.minimum(place[i], place[rest]) + 1 + np.minimum(n[i] - place[i] - 1, n[rest] - place[rest] - 1)
                may = (root[i] != root[rest]) & (9 * most >= 4 * (n[i] + n[rest]))
                may &= (5 * n[i] >= 4 * n[rest]) & (5 * n[rest] >= 4 * n[i])
                if both:  # pairs of one chunk are in that chunk's own tile
                    may &= own[i] != own[rest]
                may = np.flatnonzero(may)
                apart = np.bitwise_count(sketch[i] ^ sketch[rest][may]).sum(axis=1, dtype=np.int64)
                may = may[9 * apart <= n[i] + n[rest][may]]
                if len(may):
                    other = name[rest][may]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(name[i], other)), pa.array(np.maximum(name[i], other))], ["a", "b"])
        kept = kept[bounds[-1] :]


@F.pandas_udf(IntegerType())
def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([apart(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def _near_sketches(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow the likeness."""
    for end in ("a", "b"):
        own = distinct.select(F.col("set").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}"))
        pairs = pairs.join(own, end)
    return save(pairs.where(9 * _apart("sketch_a", "sketch_b") <= F.col("n_a") + F.col("n_b")).select("a", "b"))


def _compared(size: int):
    """Rows: a, chunk, whether b's, name, text, sorted: each chunk begins with the text of a -> the pairs of a with the
    others that are alike. A row like the one before it is passed over."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, before = None, None, None
        for batch in batches:
            a, chunk, other, name = (batch.column(c).to_pylist() for c in range(4))
            found = ([], [])
            for i, text in enumerate(batch.column(4)):
                if (a[i], chunk[i], other[i], name[i]) == before:
                    continue
                before = a[i], chunk[i], other[i], name[i]
                if before[:2] != at:
                    at, own = before[:2], None
                if not other[i]:
                    own = shingle_set(text.as_py(), size) if own is None else own
                elif own is not None and alike(own, shingle_set(text.as_py(), size)):
                    found[0].append(a[i])
                    found[1].append(name[i])
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], ["a", "b"])

    return of


def _verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike. A text goes once to each pair it is b of, and once to each chunk of
    the pairs it is a of; other texts stay where they are."""
    chunks = save(pairs.groupBy("a").agg(F.ceil(F.count("*") / VERIFY).cast("int").alias("chunks")))
    own = F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int")
    others = pairs.join(chunks, "a").select("a", own.alias("chunk"), F.lit(True).alias("other"), F.col("b").alias("name"))
    firsts = chunks.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("other"), F.col("a").alias("name"))
    asked = others.unionByName(firsts).join(distinct.select(F.col("set").alias("name"), F.col("low.key").alias("key")), "name")
    rows = attach(docs, save(asked), ["key"], limit=NARROW_ROWS).select("a", "chunk", "other", "name", "text")
    # rows with one id and text would come as often as they are there
    rows = rows.mapInArrow(_once, rows.schema)
    rows = rows.repartition(partitions(docs.sparkSession), "a", "chunk").sortWithinPartitions("a", "chunk", "other", "name")
    return save(rows.mapInArrow(_compared(size), "a long, b long").distinct())


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch's rows with the same first four values, one; those that other batches have go after the sort."""
    for batch in batches:
        seen, keep = set(), []
        for row in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            keep.append(row not in seen)
            seen.add(row)
        yield batch.filter(pa.array(keep, pa.bool_()))


def indexed(distinct: DataFrame) -> DataFrame:
    """set, fp -> pairs (a, b) of sets that the byte-position index links: of each fingerprint the least set with its
    others, and with that of the fingerprints linked to it. Written."""
    named = save(distinct.groupBy("fp").agg(F.min("set").alias("a"), F.count("*").alias("sets")))
    equal = distinct.select(F.col("set").alias("b"), "fp").join(named.where("sets > 1"), "fp").where("a <> b").select("a", "b")
    near = simhash.links(named.select("fp")).withColumnsRenamed({"a": "fp", "b": "fp_b"})
    near = near.join(named.select("fp", "a"), "fp").join(named.select(F.col("fp").alias("fp_b"), F.col("a").alias("b")), "fp_b")
    return save(equal.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())


def links(docs: DataFrame, distinct: DataFrame, often, size: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """docs: key, text; distinct: set, n, small, sketch, first, fp, low -> (node, root) of the sets that have a link
    and are not their component's least."""
    n = partitions(docs.sparkSession)
    edges = _verified(_near_sketches(indexed(distinct), distinct), distinct, docs, size)
    roots = components(edges).select(F.col("node").alias("set"), "root")
    postings = distinct.select("set", "n", "first").mapInArrow(_postings(often), "token long, chunk int, set long, n int, place int")
    postings = postings.repartition(n, "token", "chunk").sortWithinPartitions("token", "chunk", "set")
    shared = save(postings.mapInArrow(_lists, _LIST))
    # lists in chunks have a common hub too
    hubs = shared.where("chunk >= 0").groupBy("token").agg(F.min(F.struct("set", "n")).alias("all"))
    shared = shared.join(F.broadcast(hubs), "token", "left")  # MAX_OFTEN rows at most
    shared = shared.select("token", "set", "n", "place", F.coalesce("all.set", "hub").alias("hub"), F.coalesce("all.n", "hub_n").alias("hub_n"))
    stars = shared.where("set <> hub and 5 * n >= 4 * hub_n and 5 * hub_n >= 4 * n").groupBy("set", "hub").agg(F.count("*").alias("tally"))
    # of each set the pair that shares most elements; the others only where that leaves lists open
    stars = stars.groupBy("set").agg(F.max_by("hub", F.struct("tally", "hub")).alias("hub"))
    stars = save(stars.select(F.col("hub").alias("a"), F.col("set").alias("b")))
    for end in ("a", "b"):
        stars = attach(stars, roots.withColumnsRenamed({"set": end, "root": f"root_{end}"}), [end], "left", NARROW_ROWS)
    stars = stars.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    edges = edges.unionByName(_verified(_near_sketches(stars, distinct), distinct, docs, size))
    roots = components(edges).select(F.col("node").alias("set"), "root")
    mixed = save(attach(shared.select("token", "set", "n", "place"), roots, ["set"], "left", NARROW_ROWS).withColumn("root", F.coalesce("root", "set")))
    open_ = save(mixed.groupBy("token").agg(F.count("*").alias("entries"), (F.min("root") != F.max("root")).alias("open")).where("open").select("token", "entries"))
    mixed = attach(attach(mixed, open_, ["token"], "inner", NARROW_ROWS), distinct.select("set", "small"), ["set"])
    mixed = mixed.withColumn("chunks", F.ceil(F.col("entries") / tile))
    own = F.pmod(F.xxhash64("set"), F.col("chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    tiles = mixed.select("token", own.alias("own"), other.alias("other"), "set", "n", "place", "root", "small")
    tiles = tiles.select("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "set", "n", "place", "root", "own", "small")
    tiles = tiles.repartition(n, "token", "low", "high").sortWithinPartitions("token", "low", "high", "set")
    pairs = _near_sketches(tiles.mapInArrow(_pairs, "a long, b long").distinct(), distinct)
    return components(edges.unionByName(_verified(pairs, distinct, docs, size)))


def keep_one(docs: DataFrame, *, id_col="doc_id", text_col="text", size: int = SHINGLE) -> DataFrame:
    """The row with the smallest id of each group that likeness of 4/5 connects, with its columns as they are."""
    with batches_of(docs.sparkSession, BATCH):
        return _keep_one(docs, id_col, text_col, size)


def _keep_one(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    id_, text = F.col(id_col), F.col(text_col)
    key = row_key(id_, text)
    binary: Column = text.cast("binary")
    texts = docs.select(key.alias("key"), binary.alias("text"))
    often = docs.sparkSession.sparkContext.broadcast(_often(texts, size))
    prints = docs.select(id_.alias("id"), key.alias("key"), binary.alias("text")).mapInArrow(_sets(size, often), _SET + docs.schema[id_col].dataType.simpleString())
    low = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("low")
    distinct = save(prints.groupBy("set").agg(*[F.first(c).alias(c) for c in ("n", "small", "sketch", "first")], F.min("fp").alias("fp"), low))
    parts = links(texts, distinct, often, size).withColumnRenamed("node", "set")
    rooted = attach(distinct.select("set", "low"), parts, ["set"], "left", NARROW_ROWS).select("low", F.coalesce("root", "set").alias("root"))
    keys = save(rooted.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.key").alias("key")).distinct())
    one = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = attach(docs.select(key.alias("key"), one), keys, ["key"], "left_semi", NARROW_ROWS)
    # only rows that are there more than once need an exchange
    again = save(docs.select(key.alias("key")).groupBy("key").count().where("count > 1").select("key"))
    few = attach(rows, again, ["key"], "left_semi", NARROW_ROWS).dropDuplicates(["key"])
    return attach(rows, again, ["key"], "left_anti", NARROW_ROWS).unionByName(few).select("row.*")
