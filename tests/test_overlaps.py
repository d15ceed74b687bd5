"""Intervals and polygons against a look at every pair."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from nearwise.operators.join import equal_pairs
from nearwise.operators.overlaps import interval_join, polygon_join

IV = "id long, low double, high double"


def test_intervals(spark):
    rng = random.Random(1)

    def some(n):
        out = [(i, a, a + rng.choice([0, 0, 0.25, 1, 3, 70, 4096])) for i, a in ((i, rng.choice([rng.randrange(-50, 50), rng.uniform(-2000, 2000)])) for i in range(n))]
        return [(i, float(a), float(b)) for i, a, b in out] + [(None, 3.0, 4.0), (1, 5.0, 2.0), (2, None, 3.0), (3, float("nan"), 1.0), (4, 0.0, float("inf")), (7, 1.0, 1.0), (7, 1.0, 1.0), (8, -1e6, 1e6)]

    left, right = some(120), some(90)
    fine = lambda r: None not in r[1:] and abs(r[1]) < 1e300 and abs(r[2]) < 1e300 and r[1] <= r[2]
    want = Counter((a, c, max(b, d), min(x, y)) for a, b, x in filter(fine, left) for c, d, y in filter(fine, right) if b <= y and d <= x)
    l, r = spark.createDataFrame(left, IV), spark.createDataFrame(right, IV)
    for tile in (None, 8):
        assert Counter(map(tuple, interval_join(l, r, tile).collect())) == want
    assert interval_join(l.limit(0), r).count() == 0 == interval_join(l, r.limit(0)).count()


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
            if side == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def test_polygons(spark):
    rng = random.Random(2)
    square = lambda x, y, a: [(float(x + i * a), float(y + j * a)) for i, j in ((-1, -1), (-1, 1), (1, 1), (1, -1))]
    shapes = [(i, [square(rng.randrange(-40, 40), rng.randrange(-40, 40), rng.choice([0.25, 2, 9]))]) for i in range(20)]
    shapes += [(50, [square(0, 0, 1000.0), square(0, 0, 10.0)]), (51, [[(0.0, 0.0), (9.0, 3.0), (2.0, 8.0), (4.0, 4.0)]]), (52, [[(1.0, 1.0)]]), (53, [[(0.0, 0.0), (8.0, 8.0)]]), (None, [square(3, 3, 2)])]
    bad = [(60, None), (61, []), (62, [[(None, 1.0)]]), (63, [[(float("nan"), 1.0), (0.0, 0.0)]]), (64, [None])]
    points = [(i, float(rng.randrange(-45, 45)), float(rng.randrange(-45, 45))) for i in range(400)] + [(900, None, 1.0), (901, 10.0, 10.0), (901, 10.0, 10.0), (None, 1.0, 1.0)]
    polygons = spark.createDataFrame(shapes + bad, "id long, rings array<array<struct<x: double, y: double>>>")
    want = Counter((i, j) for i, x, y in points if x is not None for j, rings in shapes if inside(x, y, rings))
    df = spark.createDataFrame(points, "id long, x double, y double")
    for tile in (None, 16):
        assert Counter(map(tuple, polygon_join(df, polygons, tile).collect())) == want
    assert polygon_join(df.limit(0), polygons).count() == 0 == polygon_join(df, polygons.limit(0)).count()


def test_one_interval_over_everything_fills_many_tasks(spark):
    l = spark.createDataFrame([(1, 0.0, 1e6)], IV)
    r = spark.range(20_000).select("id", F.col("id").cast("double").alias("low"), F.col("id").cast("double").alias("high"))
    tasks = interval_join(l, r, 512).groupBy(F.spark_partition_id()).count().collect()
    assert sum(t["count"] for t in tasks) == 20_000 and len(tasks) > 1 and max(t["count"] for t in tasks) < 15_000
    assert equal_pairs(l.toDF("a", "b", "c"), r.toDF("d", "e", "f"), "b", "e").count() == 1
