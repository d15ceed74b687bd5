"""Tasks of the join follow the pairs that are compared, not the bytes that these grow out of."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from nearwise.operators import join


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    rng = random.Random(3)
    # half of the places lie within one leaf of the right side
    left = spark.createDataFrame([(i, rng.uniform(0, 1 if i % 2 else 100), rng.uniform(0, 1 if i % 2 else 100)) for i in range(4000)], "id long, x double, y double")
    right = spark.createDataFrame([(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(800)], "id long, x double, y double")
    monkeypatch.setattr(join, "MANY_PLACES", 100, raising=False)
    monkeypatch.setattr(join, "TASK_PAIRS", 4000, raising=False)
    monkeypatch.setattr(join, "TILE", 256)
    places = left.select(F.col("x").alias("px"), F.col("y").alias("py"))
    met = join.meetings(places, join.right_index(right, "kdtree", 800, 32), 3, 4000)
    tasks = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) > 40_000 and len(tasks) >= 8 and max(tasks) < sum(tasks) / 3
    got = join.knn_join(left, right, 3, output="exploded", direct_pairs=0)
    want = join.knn_join(left, right, 3, output="exploded", index="brute")
    assert got.count() == 12_000 and got.exceptAll(want).count() == 0
