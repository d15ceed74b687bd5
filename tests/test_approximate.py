"""Approximate neighbours: recall against all pairs, and whole results where windows hold all rows."""

from __future__ import annotations

import random

import pytest

from nearwise.operators.approximate import approximate_knn_join

SCHEMA = "id long, x double, y double"


def pairs(df):
    return sorted((r["left_id"], r["rank"], r["right_id"]) for r in df.collect())


def exact(left, right, k):
    near = lambda x, y: sorted({((x - a) ** 2 + (y - b) ** 2, i) for i, a, b in right})[:k]
    return sorted((i, rank, j) for i, x, y in left for rank, (_, j) in enumerate(near(x, y), 1))


def test_recall(spark):
    rng = random.Random(4)
    clumps = [(rng.uniform(0, 1000), rng.uniform(0, 1000), rng.choice((1, 10, 100))) for _ in range(12)]
    place = lambda: (lambda c: (rng.gauss(c[0], c[2]), rng.gauss(c[1], c[2])))(rng.choice(clumps))
    right = [(i, *place()) for i in range(4000)]
    left = [(i, *place()) for i in range(400)]
    got = pairs(approximate_knn_join(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), 10))
    assert len(got) == 4000
    want = {(i, j) for i, _, j in exact(left, right, 10)}
    assert len(want & {(i, j) for i, _, j in got}) >= 0.9 * len(want)


def test_cases(spark):
    right = [(i, float(i % 5), 2.0) for i in range(12)] + [(3, 3.0, 2.0), (90, None, 1.0), (91, float("inf"), 1.0)]
    left = [(1, 2.2, 2.0), (1, 2.2, 2.0), (2, -1e308, 1e308), (3, 0.0, 2.0), (4, None, 0.0)]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    got = pairs(approximate_knn_join(frame(left[:2] + left[3:]), frame(right), 4, window=20))
    assert got == exact([left[0], left[1], left[3]], right[:12], 4)
    assert len(pairs(approximate_knn_join(frame(left), frame(right), 4))) == 16
    assert pairs(approximate_knn_join(frame([]), frame(right), 2)) == pairs(approximate_knn_join(frame(left), frame([]), 2)) == []
    with pytest.raises(ValueError):
        approximate_knn_join(frame(left), frame(right), 0)


def test_recall_among_copies(spark):
    """Places with more rows than a window holds are met like others."""
    rng = random.Random(6)
    places = [(rng.uniform(0, 1000), rng.uniform(0, 1000)) for _ in range(300)]
    right = [(at * 60 + copy, *place) for at, place in enumerate(places) for copy in range(60)]
    left = [(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(200)]
    got = pairs(approximate_knn_join(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), 10))
    want = exact(left, right, 10)
    assert len(got) == len(want) and len(set(want) & set(got)) >= 0.97 * len(want)


def test_recall_beside_dense_lines(spark):
    """Points on lines, close to each other and far from who asks: their order along a curve says little about the asker."""
    rng = random.Random(8)
    right = [(i, round(rng.uniform(0, 10000), 2), 400.0 * (i % 4)) for i in range(8000)]
    left = [(i, rng.uniform(2, 400), rng.uniform(500, 700)) for i in range(150)]
    got = pairs(approximate_knn_join(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), 10))
    want = {(i, j) for i, _, j in exact(left, right, 10)}
    assert len(got) == len(want) and len(want & {(i, j) for i, _, j in got}) >= 0.9 * len(want)
