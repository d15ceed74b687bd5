"""Leaves of the sampled layout stay small, however the points lie and however many there are."""

from __future__ import annotations

import json
from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

from nearwise.operators.layout import Layout, layout


def in_lines(spark, n):
    """Points on 25 lines, as of a number by nation."""
    return spark.range(0, n, 1, 4).select(F.pmod(F.xxhash64("id"), F.lit(1_100_000)).cast("double").alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(25)) * 40_000).cast("double").alias("y"))


def met(points, plane):
    """How many points lie in the leaf of a point, on average, and how many at most."""
    leaves = points.groupBy(plane.path(F.col("x"), F.col("y")).alias("leaf")).count()
    return leaves.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count"), F.max("count")).first()


def test_leaves_do_not_grow_with_the_points(spark, monkeypatch):
    monkeypatch.setattr("nearwise.operators.layout.KD_DEPTH", 10)
    monkeypatch.setattr("nearwise.operators.layout.SAMPLE", 5000)
    for n in (8192, 131_072):
        points = in_lines(spark, n)
        mean, most = met(points, layout(points, "kdtree", n, 32))
        assert mean < 64 and most < 1000, n


def test_medians_part_what_can_be_parted(spark):
    # more than half of all points have the greatest value of the wider axis
    points = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id") / 3).otherwise(F.lit(1000.0)).alias("x"), (F.col("id") / 10).alias("y"))
    plane = layout(points, "kdtree", 3000, 32)
    assert plane.splits[0] < 1000 and met(points, plane)[0] < 64


def test_layouts_without_axes_are_read_as_before(spark):
    """An index that was written before axes were kept takes x and y in turn."""
    old = json.loads(json.dumps({"depth": 5, "splits": [4.0, 2.0, 2.5], "boxes": [[0.0, 0.0, 4.0, 2.0], [0.0, 2.0, 4.0, 8.0], [4.0, 0.0, 8.0, 2.5], [4.0, 2.5, 8.0, 8.0]]}))
    points = spark.createDataFrame([(0.0, 0.0), (3.9, 1.9), (1.0, 7.0), (9.0, -1.0), (5.5, 4.2)], "x double, y double")
    paths = [r[0] for r in points.select(Layout(**old).path(F.col("x"), F.col("y"))).collect()]
    want = []
    for x, y in [(0.0, 0.0), (3.9, 1.9), (1.0, 7.0), (9.0, -1.0), (5.5, 4.2)]:
        leaf = 2 * (x > 4.0) + (y > (2.5 if x > 4.0 else 2.0))
        low_x, low_y, high_x, high_y = old["boxes"][leaf]
        i = min(max(int((x - low_x) // ((high_x - low_x) / 4)), 0), 3)
        j = min(max(int((y - low_y) // ((high_y - low_y) / 2)), 0), 1)
        want.append(leaf * 8 + (i >> 1) * 4 + j * 2 + (i & 1))
    assert paths == want


@pytest.mark.parametrize("kind", ["kdtree", "quadtree"])
def test_a_stored_layout_gives_the_same_paths(spark, monkeypatch, kind):
    monkeypatch.setattr("nearwise.operators.layout.KD_DEPTH", 3)
    points = in_lines(spark, 2000)
    plane = layout(points, kind, 2000, 8)
    again = Layout(**json.loads(json.dumps(asdict(plane))))
    one, two = (p.path(F.col("x"), F.col("y")) for p in (plane, again))
    assert points.where(one != two).isEmpty() and points.select(one.alias("p")).distinct().count() > 100
