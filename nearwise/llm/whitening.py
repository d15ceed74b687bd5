"""Embedding whitening by a one-sided Jacobi SVD.

Entries c become whole numbers x = floor(64 c) + 1000000. The fit list is each different x-vector once; its number
n and its sums S a dimension are exact, so x - S/n is formed from whole numbers and centring costs no digits.
Each task reduces its centred rows block by block to the triangle R of a QR factorisation; triangles are stacked and
factored again, FAN at a time, until one is left (TSQR): a task holds one block and FAN triangles, whatever the number
of rows. Plane rotations then make the columns of that one R, dimension x dimension numbers, orthogonal: their norms
over sqrt(n) are the standard deviations, accurate to double precision without ever squaring the data, and the
accumulated rotations are the components. A second pass over the fit list projects the rows and holds their
covariance against the identity; parts' means and products are merged by the same tree.

Defined cases: rows whose vector is null, empty, or holds null, non-finite or components of 2^40 and more (whose sums
would not be exact) have no result; ids may be null, repeat and be of any type; vectors of different lengths are
fitted apart, each length by itself; repeated vectors count once in the fit and each have their rows; a
component without any spread (at most 4 d eps of the greatest deviation, as when all rows are equal) has rows whose
`whitened` is null and `explained` zero, and takes no part in `identity_error`; a `deviation` beyond 64 bits is null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, save

SCALE, SHIFT, COMPONENTS, BATCH, FAN = 64, 1_000_000, 16, 2000, 16
#: Components from here on have no part: their whole numbers would need more digits than a double has.
LARGEST = 2.0**40


@dataclass
class Fit:
    """What is known of the fit list of one length of vectors."""

    n: int
    whole: np.ndarray  # S div n
    rest: np.ndarray  # S mod n
    axes: np.ndarray | None = None  # components as columns
    deviations: np.ndarray | None = None  # standard deviations, falling; zero where there is no spread
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """NaN along components without spread."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.deviations > 0, self.centred(x) @ self.axes / self.deviations, np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2; null beyond 64 bits."""
        x = x - self.whole
        if len(x) and x.shape[1] * (self.n * (int(np.abs(x).max()) + 1)) ** 2 < 1 << 63:
            return ((self.n * x - self.rest) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.rest.tolist(), strict=True)) for row in x.tolist()]
        return [d if d < 1 << 63 else None for d in exact]


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT))


def _usable(vector: Column) -> Column:
    v = vector.cast("array<double>")
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST))), F.lit(False))


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors -> for each length the rows that have it, and those as a matrix."""
    lengths, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        yield rows, flat[starts[rows][:, None] + np.arange(dim)]


_BLOCKS = "dim int, part long, block binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 3
    types = (pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["dim", "part", "block"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x -> dim, at, total, n: a task's sums, in halves of 32 bits so that none overflows."""
    totals: dict[int, list] = {}
    for batch in batches:
        for _, x in _matrices(batch.column(0)):
            total = totals.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
            total[0] += len(x)
            total[1] += (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
    rows = [(dim, at, Decimal(int(s)), n) for dim, (n, sums) in totals.items() for at, s in enumerate(sums)]
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    types = (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["dim", "at", "total", "n"])


def _counted(fit_list: DataFrame) -> dict[int, Fit]:
    """n and sums for every length; one row a dimension reaches the driver."""
    sums = fit_list.mapInArrow(_sums, "dim int, at int, total decimal(38,0), n long").groupBy("dim", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    fits: dict[int, Fit] = {}
    for r in sums.orderBy("dim", "at").collect():
        fit = fits.setdefault(r["dim"], Fit(r["n"], np.zeros(r["dim"], np.int64), np.zeros(r["dim"], np.int64)))
        fit.whole[r["at"]], fit.rest[r["at"]] = divmod(int(r["total"]), r["n"])
    return fits


def _blockwise(fits: dict[int, Fit], block_of: Callable[[Fit, np.ndarray], np.ndarray], merge: Callable[[int, list[np.ndarray]], np.ndarray]) -> Callable:
    """A task's rows -> one block for each length, merged as batches arrive."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                dim = x.shape[1]
                block = block_of(fits[dim], x)
                held[dim] = merge(dim, [held[dim], block] if dim in held else [block])
        part = TaskContext.get().partitionId()
        yield _rows([(dim, part, block.tobytes()) for dim, block in held.items()])

    return of


def _tree(blocks: DataFrame, parts: int, merge: Callable[[int, list[np.ndarray]], np.ndarray]) -> dict[int, np.ndarray]:
    """Merges FAN blocks of neighbouring parts at a time until each length has one."""

    def merged(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(c.to_pylist() for c in table.columns), strict=True), key=lambda r: r[1])
        dim, part = rows[0][0], rows[0][1] // FAN
        return pa.Table.from_batches([_rows([(dim, part, merge(dim, [np.frombuffer(r[2]) for r in rows]).tobytes())])])

    while parts > 1:
        parts = -(-parts // FAN)
        blocks = blocks.groupBy("dim", F.floor(F.col("part") / FAN).alias("above")).applyInArrow(lambda key, table: merged(table.select(["dim", "part", "block"])), _BLOCKS)
    return {r["dim"]: np.frombuffer(r["block"]) for r in blocks.collect()}


def _triangle(dim: int, blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack([b.reshape(-1, dim) for b in blocks]), "r")


def _moments(fit: Fit, x: np.ndarray) -> np.ndarray:
    """Of whitened rows: number, means, products of what is left after the means."""
    w = fit.whitened(x)[:, fit.deviations > 0]
    mean = w.mean(axis=0)
    return np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])


def _merged_moments(_: int, blocks: list[np.ndarray]) -> np.ndarray:
    k = (int(np.sqrt(4 * len(blocks[0]) - 3)) - 1) // 2  # 1 + k + k * k numbers
    n, mean, products = blocks[0][0], blocks[0][1 : k + 1], blocks[0][k + 1 :].reshape(k, k)
    for b in blocks[1:]:
        apart, both = b[1 : k + 1] - mean, n + b[0]
        products = products + b[k + 1 :].reshape(k, k) + np.outer(apart, apart) * (n * b[0] / both)
        mean, n = mean + apart * (b[0] / both), both
    return np.concatenate([[n], mean, products.ravel()])


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonalises r's columns by plane rotations, a round of disjoint pairs at a time -> norms, falling, and the
    accumulated rotations with columns in that order."""
    dim = r.shape[1]
    columns, turns = r.T.astype(float).copy(), np.eye(dim)
    ring = np.arange(dim + dim % 2)  # with an idle place if the number of columns is odd
    for _ in range(sweeps):
        still = True
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]
            real = (p < dim) & (q < dim)
            p, q = p[real], q[real]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            a, b = columns[p], columns[q]
            pp, qq, pq = (a * a).sum(axis=1), (b * b).sum(axis=1), (a * b).sum(axis=1)
            turn = np.abs(pq) > 2.0**-52 * np.sqrt(pp) * np.sqrt(qq)
            if not turn.any():
                continue
            still = False
            p, q, a, b, pp, qq, pq = (v[turn] for v in (p, q, a, b, pp, qq, pq))
            ratio = (qq - pp) / (2 * pq)
            tangent = np.where(ratio < 0, -1.0, 1.0) / (np.abs(ratio) + np.hypot(1, ratio))
            cosine = 1 / np.hypot(1, tangent)
            sine = cosine * tangent
            for rows in (columns, turns):
                a, b = rows[p], rows[q]
                rows[p], rows[q] = cosine[:, None] * a - sine[:, None] * b, sine[:, None] * a + cosine[:, None] * b
        if still:
            break
    norms = np.sqrt((columns * columns).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    return norms[order], turns[order].T


def fit_whitening(fit_list: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """fit_list: a written table of different vectors `x` -> length -> its fit, up to `components` axes."""
    fits = _counted(fit_list)
    if not fits:
        return {}
    parts = fit_list.rdd.getNumPartitions()
    centred = fit_list.mapInArrow(_blockwise(fits, lambda fit, x: fit.centred(x), _triangle), _BLOCKS)
    for dim, r in _tree(centred, parts, _triangle).items():
        fit = fits[dim]
        norms, axes = jacobi(r.reshape(-1, dim))
        spread = np.where(norms > 4 * dim * np.finfo(float).eps * norms[0], norms, 0.0)
        fit.axes, fit.deviations = axes[:, :components], spread[:components] / np.sqrt(fit.n)
        fit.explained = spread[:components] ** 2 / max((norms**2).sum(), np.finfo(float).tiny)
    projected = fit_list.mapInArrow(_blockwise(fits, _moments, _merged_moments), _BLOCKS)
    for dim, block in _tree(projected, parts, _merged_moments).items():
        k = int((fits[dim].deviations > 0).sum())
        if k:
            fits[dim].identity_error = float(np.abs(block[k + 1 :].reshape(k, k) / block[0] - np.eye(k)).max())
    return fits


def _whitened(fits: dict[int, Fit]) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch.column(1)):
                fit = fits[x.shape[1]]
                k = len(fit.deviations)
                w = fit.whitened(x).ravel()
                each = lambda values, n=len(x): np.tile(values, n)
                columns = [
                    batch.column(0).take(pa.array(np.repeat(rows, k))), pa.array(each(np.arange(1, k + 1, dtype=np.int32))), pa.array(np.full(len(w), fit.n)),
                    pa.array(fit.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(w, mask=np.isnan(w)),
                    pa.array(each(fit.explained)), pa.array(np.full(len(w), fit.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return of


def whiten(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for every usable row and component."""
    usable = vectors.where(_usable(F.col(f"`{vector_col}`"))).select(F.col(f"`{id_col}`").alias("id"), whole_numbers(F.col(f"`{vector_col}`")).alias("x"))
    with batches_of(vectors.sparkSession, BATCH):
        fits = fit_whitening(save(usable.select("x").distinct()), components)
    schema = f"id {usable.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return usable.mapInArrow(_whitened(fits), schema)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
