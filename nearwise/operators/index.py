"""What a spatial index knows of its points, as tables: quad levels, median splits, leaf extents, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quad_levels(points: DataFrame, levels: int) -> DataFrame:
    """level, ix, iy, n and extents of every occupied quad of the points' bounding box, for 1 to `levels`
    halvings. Points are counted once, at the finest level; coarser ones add those up."""
    box = points.agg(F.min("x").alias("lx"), F.min("y").alias("ly"), F.max("x").alias("hx"), F.max("y").alias("hy"))
    last = 2**levels - 1

    def place(v: str, low: str, high: str) -> Column:
        step = (F.col(high) - F.col(low)) / F.lit(float(2**levels))
        return F.when(step > 0, F.least(F.floor((F.col(v) - F.col(low)) / step), F.lit(last).cast("long"))).otherwise(F.lit(0).cast("long"))

    rows = points.crossJoin(F.broadcast(box)).select("x", "y", place("x", "lx", "hx").alias("ix"), place("y", "ly", "hy").alias("iy"))
    finest = rows.groupBy("ix", "iy").agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    ups = finest.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(levels) - F.col("level"))).cast("long").alias(c)
    ups = ups.select("level", up("ix"), up("iy"), "n", "min_x", "max_x", "min_y", "max_y")
    return ups.groupBy("level", "ix", "iy").agg(F.sum("n").alias("n"), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"))


def ranked(points: DataFrame, groups: list[str], order: list[str], slices: int = 32) -> DataFrame:
    """Adds `rank` (from 1) and `n` within each group. A large group is first cut into slices of the leading
    column's approximate quantiles, so no task orders a whole group."""
    lead = order[0]
    cuts = points.groupBy(*groups).agg(F.percentile_approx(lead, F.array(*[F.lit(i / slices) for i in range(1, slices)]), F.lit(1000)).alias("cuts"), F.count("*").alias("n"))
    rows = points.join(cuts, groups).withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col(lead))))
    sizes = rows.groupBy(*groups, "slice").agg(F.count("*").alias("in_slice"))
    before = F.sum("in_slice").over(Window.partitionBy(*groups).orderBy("slice")) - F.col("in_slice")
    sizes = sizes.select(*groups, "slice", before.alias("before"))
    own = F.row_number().over(Window.partitionBy(*groups, "slice").orderBy(*order))
    return rows.join(sizes, [*groups, "slice"]).withColumn("rank", own + F.col("before")).drop("slice", "before", "cuts")


def kd_nodes(points: DataFrame, depth: int) -> DataFrame:
    """The points with `node`, 1 at the root and 2 n or 2 n + 1 below, after `depth` median splits by x and y
    in turn: the first half (rounded down) by coordinate, other coordinate and id goes left."""
    rows = points.select("id", "x", "y").withColumn("node", F.lit(1).cast("long"))
    for d in range(depth):
        axis, other = ("x", "y") if d % 2 == 0 else ("y", "x")
        rows = ranked(rows, ["node"], [axis, other, "id"])
        right = F.when(F.col("rank") > F.floor(F.col("n") / 2), 1).otherwise(0)
        rows = rows.select("id", "x", "y", (F.col("node") * 2 + right).alias("node"))
    return rows


def kd_split(points: DataFrame, depth: int) -> DataFrame:
    """node, n, left_n, split of every inner node: split is the left half's last coordinate, or null where
    the right half begins with the same one."""
    rows = kd_nodes(points, depth).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    below = F.floor(F.col("node") / F.pow(F.lit(2.0), F.lit(depth - 1) - F.col("level"))).cast("long")
    axis = F.when(F.col("level") % 2 == 0, F.col("x")).otherwise(F.col("y"))
    sides = rows.select(F.floor(below / 2).alias("node"), (below % 2).alias("right"), axis.alias("v"))
    left, first = F.max(F.when(F.col("right") == 0, F.col("v"))), F.min(F.when(F.col("right") == 1, F.col("v")))
    return sides.groupBy("node").agg(F.count("*").alias("n"), F.count_if(F.col("right") == 0).alias("left_n"), F.when(left != first, left).alias("split"))


def kd_leaf_extents(points: DataFrame, depth: int) -> DataFrame:
    return kd_nodes(points, depth).groupBy("node").agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def axis_histogram(points: DataFrame, axis: str, width: float) -> DataFrame:
    """bin, n: bins of a width from the least coordinate on."""
    if not width > 0:
        raise ValueError("width must be positive")
    low = points.agg(F.min(axis).alias("low"))
    rows = points.crossJoin(F.broadcast(low)).select(F.floor((F.col(axis) - F.col("low")) / F.lit(float(width))).alias("bin"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"))
