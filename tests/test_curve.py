"""Files along the curve: the curve is one, few groups are read, and results are those of all rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from nearwise.sources import curve

SCHEMA = "id long, x double, y double, d2 string"


def test_curve_visits_neighbours(spark):
    """Every cell once, each next to the one before."""
    cells = spark.range(16).select(F.col("id").alias("i")).crossJoin(spark.range(16).select(F.col("id").alias("j")))
    got = sorted((r["k"], r["i"], r["j"]) for r in cells.select("i", "j", curve.hilbert(F.col("i"), F.col("j"), 4).alias("k")).collect())
    assert [k for k, _, _ in got] == list(range(256))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(got, got[1:]))


def scanned(df):
    """Rows that the scan handed on, after it skipped groups."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_few_groups_are_read(spark, tmp_path):
    points = spark.range(200_000).select("id", (F.rand(1) * 1000).alias("x"), (F.rand(2) * 1000).alias("y"))
    points = spark.createDataFrame(points.toPandas())  # the same numbers in every run
    curve.write_curve(points, str(tmp_path / "c"), files=8, group_bytes=32 << 10)
    some = curve.read_box(spark, str(tmp_path / "c"), 500, 500, 520, 530)
    want = points.where("x between 500 and 520 and y between 500 and 530").count()
    assert some.count() == want > 50
    assert scanned(some) < 0.05 * 200_000
    near = [r["right_id"] for r in curve.nearest(spark, str(tmp_path / "c"), 700.0, 100.0, 7).collect()]
    d2 = (F.col("x") - 700) * (F.col("x") - 700) + (F.col("y") - 100) * (F.col("y") - 100)
    assert near == [r["id"] for r in points.orderBy(d2, "id").limit(7).collect()]


def test_cases(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(-9, 9)), float(rng.randint(-9, 9)), "kept") for i in range(300)] + [(1000 + i, 5.0, 5.0, None) for i in range(200)]
    strange = [(1, None, 0.0, ""), (2, float("nan"), 0.0, ""), (3, 0.0, float("inf"), "")]
    wild = [(5000, 1e300, -1e300, ""), (5001, -1e308, 1e308, "")]
    for n, (some, asks) in enumerate([(rows, [(5.0, 5.0, 210), (0.0, 0.4, 3), (-500.0, 30.0, 4), (0.0, 0.0, 900)]), ([], [(0.0, 0.0, 2)]), (rows[:1] * 4, [(1.0, 1.0, 3)]), ([(i, 2.0, float(i), "") for i in range(50)], [(2.0, 20.2, 3)]), (rows[:50] + wild, [(0.0, 0.0, 3)])]):
        path = str(tmp_path / str(n))
        curve.write_curve(spark.createDataFrame(some + strange, SCHEMA), path, files=3, group_bytes=1024)
        assert sorted(map(str, curve.read_box(spark, path, -2e308, -2e308, 2e308, 2e308).collect())) == sorted(map(str, spark.createDataFrame(some, SCHEMA).collect()))
        for x, y, k in asks:
            want = sorted(((x - px) ** 2 + (y - py) ** 2 if abs(px) < 1e150 else float("inf"), i) for i, px, py, _ in some)[:k]
            got = curve.nearest(spark, path, x, y, k).collect()
            assert [(r["rank"], r["right_id"]) for r in got] == [(at, i) for at, (_, i) in enumerate(want, 1)]
    with pytest.raises(ValueError):
        curve.nearest(spark, path, float("nan"), 0.0, 1)


def stepwise(i, j, bits):
    """The curve by single bits."""
    key = swap = flip = 0
    for at in range(bits - 1, -1, -1):
        a, b = i >> at & 1 ^ flip, j >> at & 1 ^ flip
        first, second = (b, a) if swap else (a, b)
        key = key * 4 + (first * 3 ^ second)
        swap, flip = (1 - swap, 1 - flip if first else flip) if second == 0 else (swap, flip)
    return key


def test_curve_is_looked_up(spark):
    """As by single bits, but in generated code: nothing is called for each bit of each row."""
    rng = random.Random(5)
    for bits in (1, 2, 7, 20, 30):
        cells = spark.createDataFrame([(rng.randrange(2**bits), rng.randrange(2**bits)) for _ in range(200)], "i long, j long")
        keys = cells.select("i", "j", curve.hilbert(F.col("i"), F.col("j"), bits).alias("k"))
        assert all(r["k"] == stepwise(r["i"], r["j"], bits) for r in keys.collect())
        assert "lambda" not in keys._jdf.queryExecution().toString()
