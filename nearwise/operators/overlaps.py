"""Joins of things that have an extent: intervals with intervals, points with polygons.

Extents are sorted into a dyadic hierarchy: the buckets of level k are 2^k wide, and an extent's own level is the first
whose buckets are as wide as it is, so it touches two of them at most (four cells in the plane). Two extents meet at the
level of the wider one, for which the narrower one is lifted to the levels that the other side has (a few
dozen, collected first). Of the buckets where they meet, the pair counts in the one with the first point of
both. What shares a bucket is joined by `equal_pairs`, which cuts a full bucket into tiles, so one extent over
everything meets the other side in many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .join import as_points, equal_pairs

#: Levels below the one that holds the greatest number: buckets finer than that would have numbers too great to tell apart.
FINEST = 40


def _level(width: Column, least: int) -> Column:
    up = F.ceil(F.log2(F.greatest(width, F.lit(2.0**least)))).cast("int")
    return F.greatest(F.when(F.pow(F.lit(2.0), up) < width, up + 1).otherwise(up), F.lit(least))


def _bucket(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("long")


def _finite(c: str) -> Column:
    return F.coalesce(F.abs(F.col(c)) < F.lit(float("inf")), F.lit(False))


def _least_level(*tops: float | None) -> int:
    top = max((t for t in tops if t), default=1.0)
    return max(-1000, int(top).bit_length() - FINEST if top >= 1 else -FINEST)


def interval_join(left: DataFrame, right: DataFrame, tile: int | None = None) -> DataFrame:
    """left_id, right_id, low, high of all pairs of overlapping closed intervals (id, low, high), and what both share.

    Intervals with a null, NaN or infinite end, or with low beyond high, meet nothing; ids may repeat and be null."""
    sides = []
    for rows, side in ((left, "left"), (right, "right")):
        ends = rows.select(F.col("id").alias(f"{side}_id"), F.col("low").cast("double").alias(f"{side}_low"), F.col("high").cast("double").alias(f"{side}_high"))
        sides.append(ends.where(_finite(f"{side}_low") & _finite(f"{side}_high") & (F.col(f"{side}_low") <= F.col(f"{side}_high"))))
    tops = [s.agg(F.max(F.greatest(F.abs(f"{n}_low"), F.abs(f"{n}_high")))).first()[0] for s, n in zip(sides, ("left", "right"), strict=True)]
    least = _least_level(*tops)
    sides = [s.withColumn(f"{n}_level", _level(F.col(f"{n}_high") - F.col(f"{n}_low"), least)) for s, n in zip(sides, ("left", "right"), strict=True)]
    levels = [sorted(r[0] for r in s.select(f"{n}_level").distinct().collect()) for s, n in zip(sides, ("left", "right"), strict=True)]

    def placed(side: int, own: bool, above: list[int]) -> DataFrame:
        """At its own level, or lifted to the other side's levels above (for the left) or from its own on (for the right)."""
        name = ("left", "right")[side]
        level = F.col(f"{name}_level")
        lifted = F.array(level) if own else F.filter(F.array(*[F.lit(x) for x in above]), lambda x: x >= level if side else x > level)
        rows = sides[side].withColumn(f"{name}_at", F.explode(lifted))
        at = F.col(f"{name}_at")
        spread = F.sequence(_bucket(F.col(f"{name}_low"), at), _bucket(F.col(f"{name}_high"), at))
        return rows.withColumn(f"{name}_key", F.explode(F.transform(spread, lambda b: F.concat_ws(":", at, b)))).drop(f"{name}_level", f"{name}_at")

    # the left is the wider or as wide, then the right is the wider
    met = equal_pairs(placed(0, True, []), placed(1, False, levels[0]), "left_key", "right_key", tile)
    if levels[1]:
        met = met.unionByName(equal_pairs(placed(0, False, levels[1]), placed(1, True, []), "left_key", "right_key", tile))
    low, high = F.greatest("left_low", "right_low"), F.least("left_high", "right_high")
    level = F.split_part("left_key", F.lit(":"), F.lit(1)).cast("int")
    first = F.concat_ws(":", level, _bucket(low, level)) == F.col("left_key")
    return met.where((low <= high) & first).select("left_id", "right_id", low.alias("low"), high.alias("high"))


def edges_of(rings: Column) -> Column:
    """Rings (arrays of structs x, y; the last corner joined to the first) -> edges x1, y1, x2, y2."""

    def of(ring: Column) -> Column:
        nexts = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        return F.zip_with(ring, nexts, lambda a, b: F.struct(a.x.cast("double").alias("x1"), a.y.cast("double").alias("y1"), b.x.cast("double").alias("x2"), b.y.cast("double").alias("y2")))

    return F.flatten(F.transform(rings, of))


def in_polygon(x: Column, y: Column, edges: Column) -> Column:
    """Whether a ray to the right crosses an odd number of edges, or the point lies on one."""

    def side(e: Column) -> Column:
        return (e.x2 - e.x1) * (y - e.y1) - (x - e.x1) * (e.y2 - e.y1)

    def on(e: Column) -> Column:
        return (side(e) == 0) & x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)) & y.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2))

    def crossed(e: Column) -> Column:
        return ((e.y1 > y) != (e.y2 > y)) & ((side(e) > 0) == (e.y2 < e.y1))

    odd = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(crossed(e), 1).otherwise(0)) % 2 == 1
    return odd | F.exists(edges, on)


def polygon_join(points: DataFrame, polygons: DataFrame, tile: int | None = None) -> DataFrame:
    """id, polygon_id of all points in polygons (id, rings). Rings count together, even and odd, so a ring within another is a hole;
    points on an edge, that of a hole too, are inside.

    Points without finite coordinates lie in none; a polygon with a null ring or corner, or one that is not finite, holds none; rings of
    one or two corners hold the points on them. Polygons are sorted by the extent of their corners."""
    p = as_points(points).toDF("id", "x", "y")
    shapes = polygons.select(F.col("id").alias("polygon_id"), edges_of(F.col("rings")).alias("edges"))
    fine = F.forall("edges", lambda e: F.forall(F.array(e.x1, e.y1, e.x2, e.y2), lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))))
    shapes = shapes.where(F.coalesce(fine & (F.size("edges") > 0), F.lit(False)))
    box = {f"{f}_{c}": g(F.col(f"edges.{c}1")) for c in "xy" for f, g in (("min", F.array_min), ("max", F.array_max))}
    shapes = shapes.withColumns(box)
    top = [p.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0], shapes.agg(F.max(F.greatest(*[F.abs(F.col(c)) for c in box]))).first()[0]]
    level = _level(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")), _least_level(*top))
    shapes = shapes.withColumn("level", level)
    levels = sorted(r[0] for r in shapes.select("level").distinct().collect())
    cells = lambda c: F.sequence(_bucket(F.col(f"min_{c}"), F.col("level")), _bucket(F.col(f"max_{c}"), F.col("level")))
    shapes = shapes.withColumn("cx", F.explode(cells("x"))).withColumn("cy", F.explode(cells("y")))
    shapes = shapes.withColumn("right_key", F.concat_ws(":", "level", "cx", "cy")).drop("level", "cx", "cy")
    keys = F.transform(F.array(*[F.lit(v) for v in levels]).cast("array<int>"), lambda v: F.concat_ws(":", v, _bucket(F.col("x"), v), _bucket(F.col("y"), v)))
    asks = p.withColumn("left_key", F.explode(keys))  # a point has one cell a level, so it meets a polygon once
    met = equal_pairs(asks, shapes, "left_key", "right_key", tile)
    met = met.where(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y")))
    return met.where(in_polygon(F.col("x"), F.col("y"), F.col("edges"))).select("id", "polygon_id")
