"""Points in files along a Hilbert curve, so that what is near in the plane is near in the files.

`write_curve` sorts rows by the place of their cell on the curve and cuts them into small row groups; the extents of
a group's coordinates are in the file's footer, so a filter on both coordinates skips groups elsewhere. A rectangle
reads the groups it touches, and the k nearest of a place are found in a rectangle that doubles until its circle holds k.
Rows of one cell are told apart by a hash of their columns, so a place with many rows fills many files and groups; only rows
that are equal in all columns share a file.

Defined cases: rows without finite coordinates are left out; all columns are kept, whatever their names; a null id comes
first among equals; a table without rows gives none; `k` beyond the rows gives all; one place or line is a curve too."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearwise.functions.geometry import dist2

#: Halvings of the extents; bytes of a row group (Spark's default is 128 MB, which a small rectangle would read whole).
BITS, GROUP_BYTES = 20, 1 << 20
#: Bits that are looked up together, from 4 * 4^TURN numbers.
TURN = 3
_ABOUT = "x string, y string, n long, min_x double, min_y double, max_x double, max_y double"


@lru_cache
def _turns(bits: int) -> list[int]:
    """For each way that the curve runs (0 to 3: swap of the axes, flip of both) and each pair of numbers of `bits` bits: the
    place on that stretch of the curve times 4, plus the way that it runs on."""
    out = []
    for way in range(4):
        for pair in range(4**bits):
            i, j, swap, flip, key = pair >> bits, pair & (2**bits - 1), way >> 1, way & 1, 0
            for at in range(bits - 1, -1, -1):
                # each pair of bits is a quarter; in the two low ones the axes are swapped, in one of them also flipped
                a, b = i >> at & 1 ^ flip, j >> at & 1 ^ flip
                first, second = (b, a) if swap else (a, b)
                key = key * 4 + (first * 3 ^ second)
                swap, flip = swap ^ (second == 0), flip ^ (second == 0 and first == 1)
            out.append(key * 4 + swap * 2 + flip)
    return out


def hilbert(i: Column, j: Column, bits: int = BITS) -> Column:
    """The place on the curve of cell (i, j), whose numbers have `bits` bits. From the top down TURN bits of each are looked up
    together. Each look-up has the one before as its way only, so the expression stays short; `i` and `j` should be columns
    of their own, because they are named in all of them."""
    key, before, left = F.lit(0).cast("long"), None, bits
    while left:
        some = min(left, (left - 1) % TURN + 1)
        left -= some
        part = lambda v: F.call_function("shiftright", v, F.lit(left)).bitwiseAND(F.lit(2**some - 1).cast("long")).cast("int")  # noqa: B023, E731
        at = part(i) * 2**some + part(j)
        table = F.expr(f"array({', '.join(map(str, _turns(some)))})")
        before = F.get(table, at if before is None else before.bitwiseAND(F.lit(3)) * 4**some + at)
        key = key * 4**some + F.shiftright(before, 2)
    return key


def write_curve(points: DataFrame, path: str, *, on: tuple[str, str] = ("x", "y"), files: int | None = None, group_bytes: int = GROUP_BYTES) -> None:
    """Writes the rows to a new folder; `files` is the number of ranges of the curve (the session's partitions if not given)."""
    spark, path = points.sparkSession, path.rstrip("/")
    x, y = (F.col(f"`{c}`").cast("double") for c in on)
    rows = points.where(x.isNotNull() & y.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & (F.abs(y) < F.lit(float("inf"))))
    n, *box = rows.agg(F.count("*"), F.min(x), F.min(y), F.max(x), F.max(y)).first()
    last = 2**BITS - 1

    def cell(v: Column, low: float | None, high: float | None) -> Column:
        # halves, because the width of finite extents may be beyond a double
        wide = (high / 2 - low / 2) if n else 0.0
        share = (v / 2 - F.lit((low or 0.0) / 2)) / F.lit(wide) if wide > 0 else F.lit(0.0)
        return F.least(F.floor(share * last), F.lit(last)).cast("long")

    row = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    hashed = [F.col(f"`{f.name}`") for f in points.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    placed = rows.select(cell(x, box[0], box[2]).alias("i"), cell(y, box[1], box[3]).alias("j"), F.xxhash64(*hashed).alias("spread"), row.alias("row"))
    placed = placed.select(hilbert(F.col("i"), F.col("j")).alias("key"), "spread", "row")
    parts = files or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = placed.repartitionByRange(parts, "key", "spread").sortWithinPartitions("key", "spread").select("row.*")
    placed.write.option("parquet.block.size", group_bytes).parquet(f"{path}/points")
    spark.createDataFrame([(*on, n, *box)], _ABOUT).coalesce(1).write.json(f"{path}/about")


def _open(spark: SparkSession, path: str):
    path = path.rstrip("/")
    return spark.read.parquet(f"{path}/points"), spark.read.schema(_ABOUT).json(f"{path}/about").first()


def _inside(rows: DataFrame, about, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Plain comparisons with the columns, which the scan takes over."""
    x, y = F.col(f"`{about.x}`"), F.col(f"`{about.y}`")
    return rows.where((x >= F.lit(float(min_x))) & (x <= F.lit(float(max_x))) & (y >= F.lit(float(min_y))) & (y <= F.lit(float(max_y))))


def read_box(spark: SparkSession, path: str, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """The rows in a rectangle, edges included."""
    return _inside(*_open(spark, path), min_x, min_y, max_x, max_y)


def _within(rows: DataFrame, about, x: float, y: float, reach: float) -> DataFrame:
    d2 = dist2(F.col(f"`{about.x}`").cast("double"), F.col(f"`{about.y}`").cast("double"), F.lit(x), F.lit(y))
    near = _inside(rows, about, x - reach, y - reach, x + reach, y + reach).withColumn("d2", d2)
    return near.where(F.col("d2") <= F.lit(reach * reach)) if reach * reach < math.inf else near


def nearest(spark: SparkSession, path: str, x: float, y: float, k: int, *, id_col: str = "id") -> DataFrame:
    """rank, right_id, distance of the k rows nearest to a place, ties to the smaller id."""
    if k < 1 or not (math.isfinite(x) and math.isfinite(y)):
        raise ValueError("k must be at least 1, and the place finite")
    (rows, about), x, y = _open(spark, path), float(x), float(y)
    ids = rows.select(F.col(f"`{id_col}`").alias("right_id"), *[F.col(f"`{c}`") for c in dict.fromkeys((about.x, about.y)) if c != "right_id"])
    reach = math.inf
    if about.n > k:
        # twice the radius that k rows would take if they were spread evenly, or to the extents from outside
        gap = max(about.min_x - x, x - about.max_x, about.min_y - y, y - about.max_y, 0.0)
        wide, tall = about.max_x - about.min_x, about.max_y - about.min_y
        reach = gap + 2 * max(math.sqrt(min(wide * tall, 1e300) / math.pi * k / about.n), max(wide, tall) * k / about.n / 100)
        far = max(abs(x - about.min_x), abs(x - about.max_x)) + max(abs(y - about.min_y), abs(y - about.max_y))
        while reach < far and _within(ids, about, x, y, reach).limit(k).count() < k:
            reach = max(2 * reach, far / 2**40)
        reach = reach if reach < far else math.inf
    near = _within(ids, about, x, y, reach).orderBy("d2", "right_id").limit(k)
    return near.select(F.row_number().over(Window.orderBy("d2", "right_id")).alias("rank"), "right_id", F.sqrt("d2").alias("distance"))
