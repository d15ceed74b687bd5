"""Sketches of each cell, merged up the levels of cells: distinct values and quantiles of a column.

Distinct values are counted with Spark's HyperLogLog sketches, whose merges are those of the rows' union. Quantiles come
from counts by bucket, a table of few rows a cell: bucket b holds the values from base^b up to base^(b + 1), base being
((1 + error) / (1 - error)), so its middle value is off by no more than the share `error`; counts of merged cells add up, so
no level is less exact than another. Rows are read once, for the finest cells; coarser levels merge what is below.

Cell (cx, cy) of a level is that of four cells of the one before: numbers halve, rounded down. Defined cases: rows without
finite coordinates are left out; a null, NaN or infinite value counts in n but not in sketches, and a cell with no other has null
quantiles and no distinct values; zero is a bucket, negative values mirror positive ones; a table without rows gives none."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearwise.plans.tables import save

_CELL = ("level", "cx", "cy")


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & (F.abs(F.col(c)) < F.lit(float("inf")))


def cell_sketches(points: DataFrame, size: float, levels: int, *, value: str, on: tuple[str, str] = ("x", "y"), error: float = 0.01, lg_k: int = 12) -> tuple[DataFrame, DataFrame]:
    """For `levels` levels of cells, the finest of `size`: (level, cx, cy, n, known), `known` being the sketch of distinct values,
    and (level, cx, cy, sign, bucket, held), the counts by bucket. Both are written, and can be merged with other tables'."""
    if not size > 0 or levels < 1 or not 0 < error < 1:
        raise ValueError("size and levels must be positive, error between 0 and 1")
    at = lambda c: F.floor(F.col(c) / F.lit(float(size))).cast("long")
    rows = points.select(*[F.col(f"`{c}`").cast("double").alias(a) for c, a in zip(on, "xy", strict=True)], F.col(f"`{value}`").cast("double").alias("v"))
    rows = rows.where(_finite("x") & _finite("y")).select(at("x").alias("cx"), at("y").alias("cy"), F.when(_finite("v"), F.col("v") + 0.0).alias("v"))
    base = math.log((1 + error) / (1 - error))
    bucket = F.when(F.col("v") != 0, F.floor(F.ln(F.abs("v")) / F.lit(base))).cast("long")
    sketch = [save(rows.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col("v").cast("string"), lg_k).alias("known")).withColumn("level", F.lit(0)))]
    counts = [save(rows.where("v is not null").groupBy("cx", "cy", F.signum("v").cast("int").alias("sign"), bucket.alias("bucket")).agg(F.count("*").alias("held")).withColumn("level", F.lit(0)))]
    up = lambda c: F.floor(F.col(c) / 2).cast("long").alias(c)
    for level in range(1, levels):
        merged = sketch[-1].groupBy(up("cx"), up("cy")).agg(F.sum("n").alias("n"), F.hll_union_agg("known").alias("known"))
        sketch.append(save(merged.withColumn("level", F.lit(level))))
        added = counts[-1].groupBy(up("cx"), up("cy"), "sign", "bucket").agg(F.sum("held").alias("held"))
        counts.append(save(added.withColumn("level", F.lit(level))))
    out = []
    for tables, columns in ((sketch, ("n", "known")), (counts, ("sign", "bucket", "held"))):
        all_ = tables[0].select(*_CELL, *columns)
        for t in tables[1:]:
            all_ = all_.unionByName(t.select(*_CELL, *columns))
        out.append(all_)
    return out[0], out[1]


def cell_estimates(sketches: tuple[DataFrame, DataFrame], shares: Sequence[float], *, error: float = 0.01) -> DataFrame:
    """level, cx, cy, n, distinct and `quantiles`, one for each of `shares`, rising: the value whose rank is the share of the
    known values, rounded up, at least the first. `error` is that of the sketches."""
    if not shares or any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares must lie between 0 and 1")
    known, counts = sketches
    grows = (1 + error) / (1 - error)
    # the value that is off by the same share from both ends of its bucket
    middle = F.when(F.col("sign") == 0, F.lit(0.0)).otherwise(F.col("sign") * F.pow(F.lit(grows), F.col("bucket").cast("double")) * (1 + error))
    # along the values: large buckets first among negative ones
    order = (F.col("sign") * F.coalesce("bucket", F.lit(0))).alias("place")
    own = Window.partitionBy(*_CELL)
    rows = counts.select(*_CELL, "sign", order, middle.alias("middle"), "held").withColumns({
        "upto": F.sum("held").over(own.orderBy("sign", "place").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("held").over(own),
    })
    wanted = [F.greatest(F.ceil(F.lit(float(s)) * F.col("all")), F.lit(1).cast("long")) for s in shares]
    taken = [F.max(F.when((F.col("upto") >= w) & (F.col("upto") - F.col("held") < w), F.col("middle"))) for w in wanted]
    found = rows.groupBy(*_CELL).agg(F.array(*taken).alias("quantiles"))
    named = known.select(*[F.col(c).alias(f"k_{c}") for c in _CELL], "n", F.hll_sketch_estimate("known").alias("distinct"))
    same = [F.col(f"k_{c}") == F.col(c) for c in _CELL]
    none = F.array(*[F.lit(None).cast("double")] * len(shares))
    return named.join(found, same[0] & same[1] & same[2], "left").select(*[F.col(f"k_{c}").alias(c) for c in _CELL], "n", "distinct", F.coalesce("quantiles", none).alias("quantiles"))
