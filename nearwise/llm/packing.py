"""Packing documents into sequences by cutting-stock column generation.

One pass turns each document into token ids with an end id, cut at multiples of the sequence length, so
only a document's last piece is short. Piece lengths are counted in units of `unit` tokens (rounded up):
at most `length / unit` classes, whatever the corpus. On that histogram the driver solves the
cutting-stock linear program: the master's columns are patterns (how many pieces of each class share a
sequence), a knapsack dynamic program prices new ones, and solving stops when none can save 1 sequence in
5000. Each pattern's count is rounded down; the pieces left over, at most a pattern's worth for each
pattern, are filled greedily into patterns of their own. Pieces are ranked within their class by task and
order (counts of each task, summed up; no global sort), and a rank falls into one range of one pattern.

Defined cases: a null text is an empty one, a single end id; bytes that are no UTF-8 are read as U+FFFD; rows
are packed one by one, so repeated rows are packed repeatedly, and a null id stays null; ids are of any type that
workers can read; an empty table gives no rows; other columns are ignored. A special token's string in a text is that token, as the vocabulary's own library has it.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, save

LENGTH, UNIT, END = 2048, 8, 1
#: Scripts whose letters all versions of Unicode know alike; other texts take the slower library.
_SETTLED = re.compile("[^\x00-ͷЀ-ԯ‐-‧€]")


@lru_cache
def _coder(vocabulary: str):
    """texts -> lists of ids, as the vocabulary's file says; the ranks beside it give the same ids faster."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    ranks_file = re.sub(r"\.json$", ".tiktoken", vocabulary)
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(vocabulary) as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    import public_tokenizers

    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> list[int]:
        if _SETTLED.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:  # its pattern gives up on a long run of blanks
            return slow.encode(text, add_special_tokens=False).ids

    return ids


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _cut(vocabulary: str, length: int, unit: int, end: int, with_ids: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task, ranks = _coder(vocabulary), TaskContext.get().partitionId(), {}
        for batch in batches:
            columns = [[] for _ in range(8 + with_ids)]
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*ids_of((text or b"").decode(errors="replace")), end], "<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    size_class = -(-len(piece) // unit)
                    rank = ranks[size_class] = ranks.get(size_class, -1) + 1
                    row = (id_, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), task, size_class, rank, *([piece.view("<i4")] if with_ids else ()))
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.column(0).type, *_TYPES], strict=False)], _NAMES[: len(columns)])

    return of


_NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "task", "size_class", "rank", "ids"]
_TYPES = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64(), pa.list_(pa.int32())]
_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, task int, size_class int, rank long"


def _price(sizes: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: how often to take each size, for the greatest value that fits."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        fits = np.searchsorted(sizes, w, "right")
        best[w] = best[w - 1]
        if fits:
            gain = best[w - sizes[:fits]] + value[:fits]
            k = int(gain.argmax())
            if gain[k] > best[w] + 1e-12:
                best[w], last[w] = gain[k], k
    taken, w = np.zeros(len(sizes)), room
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            taken[last[w]] += 1
            w -= sizes[last[w]]
    return best[room], taken


def solve(sizes: np.ndarray, counts: np.ndarray, room: int, gap: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """The linear program min sum(x), patterns @ x >= counts, by column generation on a revised simplex:
    (patterns as columns, x). Any basis it stops at covers all counts; it stops within `gap` of the
    optimum or of the pieces' sum. Columns are sparse, so steps are sums of a few columns of the inverse."""
    m, least = len(sizes), counts @ sizes / room
    basis = np.diag(np.floor(room / sizes))
    inverse = np.diag(1 / np.diag(basis))
    x = counts / np.diag(basis)
    for turn in range(40 * m):
        value, column = _price(sizes, np.maximum(inverse.sum(axis=0), 0), room)
        if value <= 1 + gap or x.sum() <= least * (1 + gap):
            break
        used = np.flatnonzero(column)
        step = (inverse[:, used] * column[used]).sum(axis=1)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(ratio.argmin())
        basis[:, leaves] = column
        row = inverse[leaves] / step[leaves]
        inverse -= np.outer(step, row)
        inverse[leaves] = row
        x = (inverse * counts).sum(axis=1) if turn % 40 == 39 else np.maximum(x - step * ratio[leaves], 0)
        x[leaves] = x[leaves] if turn % 40 == 39 else ratio[leaves]
    return basis, np.maximum(np.linalg.solve(basis, counts), 0)


def patterns(histogram: dict[int, int], room: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[([(size, pieces a sequence), ...] largest first, sequences), ...] that hold every piece counted."""
    sizes = np.array(sorted(histogram))
    if not len(sizes):
        return []
    counts = np.array([histogram[s] for s in sizes.tolist()], float)
    columns, x = solve(sizes, counts, room)
    whole = np.floor(x + 1e-6).astype(np.int64)
    out = [(columns[:, p].astype(np.int64), int(whole[p])) for p in range(len(whole)) if whole[p]]
    rest = np.maximum(counts.astype(np.int64) - columns.astype(np.int64) @ whole, 0)
    while rest.any():
        pattern, left = np.zeros(len(sizes), np.int64), room
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(rest[k], left // sizes[k])
            left -= pattern[k] * sizes[k]
        times = int(min(rest[k] // pattern[k] for k in np.flatnonzero(pattern)))
        rest -= pattern * times
        out.append((pattern, times))
    return [([(int(sizes[k]), int(p[k])) for k in np.flatnonzero(p)[::-1]], n) for p, n in out]


def _ranges(histogram: dict[int, int], room: int) -> list[tuple[int, int, int, int, int]]:
    """(size_class, first rank, last rank, pieces a sequence, first sequence)."""
    used, base, out = dict.fromkeys(histogram, 0), 0, []
    for pattern, n in patterns(histogram, room):
        for size, each in pattern:
            here = min(each * n, histogram[size] - used[size])
            if here:
                out.append((size, used[size], used[size] + here - 1, each, base))
                used[size] += here
        base += n
    assert used == histogram
    return out


def pack(docs: DataFrame, *, id_col="doc_id", text_col="text", vocabulary: str | None = None, length: int = LENGTH, unit: int = UNIT, end: int = END, with_ids: bool = False) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, {_SCHEMA}" + ", ids array<int>" * with_ids
    cut = _cut(vocabulary or default_vocabulary(), length, unit, end, with_ids)
    pieces = save(texts.mapInArrow(cut, schema))
    each = save(pieces.groupBy("task", "size_class").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in each.groupBy("size_class").agg(F.sum("n")).collect()}  # length / unit rows at most
    earlier = F.sum("n").over(Window.partitionBy("size_class").orderBy("task")) - F.col("n")
    offsets = save(each.select("task", "size_class", earlier.alias("earlier")))
    ranges = spark.createDataFrame(_ranges(histogram, length // unit), "size_class int, first long, last long, each long, base long")
    ranked = attach(pieces, offsets, ["task", "size_class"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    placed = ranked.join(F.broadcast(ranges), (ranked["size_class"] == ranges["size_class"]) & ranked["rank"].between(ranges["first"], ranges["last"]))
    placed = placed.drop(ranges["size_class"]).withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("first")) / F.col("each")))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("size_class"), "rank")
    placed = placed.withColumn("offset", F.sum("length").over(before) - F.col("length"))
    return placed.select("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs).withColumnRenamed("id", "doc_id")
