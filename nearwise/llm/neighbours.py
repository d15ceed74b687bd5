"""Nearest neighbours by a block matrix join with int8 tiles and error bounds.

Queries and vectors are dealt into blocks; a task holds one block of vectors and passes the blocks of
queries by it (a stated query set against all rows, in blocks). Every vector is split as s * q + r, with
q in -127..127 and r its rounding residual. A tile of int8 products (exact in float32 up to 1040
dimensions, float64 beyond) gives s_a s_b (q_a . q_b), which misses the inner product by at most
|s_a q_a| |r_b| + |r_a| |b|. A pair survives if its upper bound reaches the query's k-th greatest lower
bound in the tile; survivors are recomputed in double, component by component in order, from the original
vectors. Each tile gives k results a query, and heaps merge the tiles' sorted lists. Nothing is missed: pairs whose
products might overflow (norms whose product is 1e307 or more) have no bounds and all survive.

Defined cases: vectors that are null, empty, zero, or have null or non-finite components take no part,
nor do rows without id; rows of one id are rows of their own: each is a query (their results have one query_id, each
with its own ranks) and each is a candidate of all but itself; only vectors of one length compare; ties go to the
smaller id; a product beyond a double is infinite, one whose sum meets infinities of both signs is NaN, which ranks
before all others, as in SQL; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, save

K, BLOCK, QUERY_BLOCK, STEP = 20, 8192, 65536, 256


def _valid(vector: Column) -> Column:
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


@np.errstate(over="ignore", invalid="ignore")
def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """v, rows of doubles -> s * q, |s * q|, |r|, |v|, of which s * q is kept as q and s."""
    scale = np.abs(v).max(axis=1) / 127
    scale[scale == 0] = np.finfo(float).tiny
    q = np.rint(v / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(v - q * scale[:, None], axis=1), np.linalg.norm(v, axis=1)


@np.errstate(over="ignore", invalid="ignore")
def tile(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, step: int = STEP):
    """Yields for each query its row and its k best of the block but that row: ids and scores, best first."""
    vq, vs, vr, vn = quantise(vectors)
    exact = np.float32 if vectors.shape[1] <= 1040 else np.float64
    right = vq.astype(exact).T
    for at in range(0, len(queries), step):
        a = queries[at : at + step]
        own = query_rows[at : at + step]
        q, s, r, n = quantise(a)
        near = (q.astype(exact) @ right).astype(float) * (s[:, None] * vs[None, :])
        # |s q| <= |v| + |r|; the last factor covers rounding in double
        slack = ((n + r)[:, None] * vr[None, :] + r[:, None] * vn[None, :]) * (1 + 1e-9) + (n[:, None] * vn[None, :]) * 1e-12
        # products below 1e-300 are all alike here; where sums might overflow, nothing is known but by the product itself
        upper, near = near + (slack + 1e-300), near - (slack + 1e-300)
        unknown = ~((n[:, None] * vn[None, :] < 1e307) & np.isfinite(upper) & np.isfinite(near))
        upper[unknown], near[unknown] = np.inf, -np.inf
        other = own[:, None] != rows[None, :]
        near[~other] = -np.inf
        floor = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] if near.shape[1] > k else np.full(len(a), -np.inf)
        i, j = np.nonzero((upper >= floor[:, None]) & other)
        score = np.zeros(len(i))
        for c in range(a.shape[1]):
            score += a[i, c] * vectors[j, c]
        order = np.lexsort((ids[j], -score, ~np.isnan(score), i))
        i, j, score = i[order], j[order], score[order]
        bounds = np.searchsorted(i, np.arange(len(a) + 1))
        for row in range(len(a)):
            best = slice(bounds[row], min(bounds[row] + k, bounds[row + 1]))
            yield int(own[row]), ids[j[best]], score[best]


def _tiles(k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows: dim, tile row, tile column, whether a query, id, row, vector; sorted so that a tile's vectors
        come before its queries, and both by id."""
        home, ids, numbers, vectors, matrix = None, [], [], [], None
        out: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            is_query = batch.column(3).to_numpy(zero_copy_only=False)
            row_ids, row_numbers = (batch.column(c).to_numpy(zero_copy_only=False) for c in (4, 5))
            flat, lengths = batch.column(6).flatten().to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            cuts = [0, *(n for n in range(1, len(keys)) if keys[n] != keys[n - 1] or is_query[n] != is_query[n - 1]), len(keys)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if keys[low] != home:
                    home, ids, numbers, vectors, matrix = keys[low], [], [], [], None
                part = flat[ends[low] - lengths[low] : ends[high - 1]].reshape(high - low, -1)
                if not is_query[low]:
                    ids.append(row_ids[low:high])
                    numbers.append(row_numbers[low:high])
                    vectors.append(part)
                    continue
                if not ids:
                    continue
                if matrix is None:
                    matrix = np.concatenate(vectors), np.concatenate(ids), np.concatenate(numbers)
                    vectors = []
                names = dict(zip(row_numbers[low:high].tolist(), row_ids[low:high].tolist(), strict=True))
                for row, best, score in tile(part, row_numbers[low:high], *matrix, k):
                    for column, value in zip(out, (row, names[row], best, score), strict=True):
                        column.append(value)
            if out[0]:
                types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["row", "query_id", "ids", "scores"])
                out = ([], [], [], [])

    return of


def _merge(k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, last, lists = None, None, []

        def best():
            found = islice(heapq.merge(*lists), k)
            return [(query, rank, id_, -score if real else float("nan")) for rank, (real, score, id_) in enumerate(found, 1)]

        for batch in batches:
            rows = []
            for row, q, ids, scores in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if row != last:
                    rows += best()
                    query, last, lists = q, row, []
                lists.append([(s == s, -s if s == s else 0.0, i) for s, i in zip(scores, ids, strict=True)])
                if len(lists) > 64:
                    lists = [list(islice(heapq.merge(*lists), k))]
            yield _rows(rows)
        yield _rows(best())

    return of


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = {"query_id": pa.int64(), "rank": pa.int32(), "vec_id": pa.int64(), "score": pa.float64()}
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))


def nearest(vectors: DataFrame, is_query: Column, *, id_col="vec_id", vector_col="embedding", k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner products, for every row for which
    `is_query` holds. Blocks hold about `block` rows; each query is copied once per block of vectors and
    each vector once per block of queries."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & _valid(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = save(rows.select(F.size("v").alias("dim"), "id", F.monotonically_increasing_id().alias("row"), "v", "query"))
    counted = rows.agg(F.count("*"), F.count_if("query")).first()
    n_blocks, n_query = max(1, -(-counted[0] // block)), max(1, -(-counted[1] // query_block))
    hashed = F.xxhash64("id", "row")
    right = rows.select("dim", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("qb"), F.pmod(hashed, F.lit(n_blocks)).cast("int").alias("vb"), F.lit(False).alias("query"), "id", "row", "v")
    left = rows.where("query").select("dim", F.pmod(hashed, F.lit(n_query)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("vb"), F.lit(True).alias("query"), "id", "row", "v")
    n = max(partitions(spark), min(n_blocks * n_query, 10 * partitions(spark)))
    dealt = right.unionByName(left).repartition(n, "dim", "qb", "vb").sortWithinPartitions("dim", "qb", "vb", "query", "id", "row")
    tiles = dealt.mapInArrow(_tiles(k), "row long, query_id long, ids array<long>, scores array<double>")
    return tiles.repartition(partitions(spark), "row").sortWithinPartitions("row").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP8_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (
  SELECT vec_id, e, row_number() OVER () AS i FROM v
  WHERE len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
s AS (
  SELECT q.i, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM u q JOIN u c ON q.vec_id % 20 = 0 AND c.i <> q.i AND len(c.e) = len(q.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
