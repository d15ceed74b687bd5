"""As-of joins, prefix sums and the sweep: the same however the order is cut."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nearwise.operators import grid, join
from nearwise.operators.layout import layout
from nearwise.operators.ranges import asof_join, prefix_sums


def swept(sizes, least, most):
    part, held, out = -1, 0, []
    for n in sizes:
        if held == 0 or held >= least or held + n > most:
            part, held = part + 1, n
        else:
            held += n
        out.append(part)
    return out


@pytest.mark.parametrize("ranges", [1, 8, 64])
def test_sweep_in_ranges(spark, ranges):
    rng = random.Random(ranges)
    sizes = [rng.choice([1, 1, 2, 5, 30]) for _ in range(300)]
    cells = spark.createDataFrame([(i // 20, i % 20, n) for i, n in enumerate(sizes)], "cx long, cy long, n long").repartition(5)
    for least, most in ((12, 20), (1, 1), (10_000, 10_000), (50, 25)):
        got = grid.assign_partitions(cells, least, most, ranges).orderBy("cx", "cy").collect()
        assert [r["part_id"] for r in got] == swept(sizes, least, most)


def test_prefix_sums(spark):
    rows = spark.createDataFrame([(i, i % 7 - 3) for i in range(200)], "i long, v long").repartition(6)
    got = prefix_sums(rows, ["i"], {"before": F.col("v"), "count": F.lit(1)}, 9).orderBy("i").collect()
    assert [(r["before"], r["count"]) for r in got] == [(sum(j % 7 - 3 for j in range(i)), i) for i in range(200)]
    assert prefix_sums(rows.limit(0), ["i"], {"before": F.col("v")}).count() == 0


def matched(left, right, forward, strict):
    out = Counter()
    for id_, key, t in left:
        fits = []
        for r in right:
            if None not in (key, t, r[1], r[2]) and r[1] == key and ((r[2] < t if strict else r[2] <= t) if not forward else (r[2] > t if strict else r[2] >= t)):
                fits.append((r[2] if not forward else -r[2], r[0]))
        out[(id_, key, t, max(fits)[1] if fits else None)] += 1
    return out


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, forward, strict):
    rng = random.Random(1)
    pick = lambda: (rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, *range(40)]))
    left = [(i, *pick()) for i in range(150)] + [(7, "hot", 5)] * 3
    right = [(i, *pick()) for i in range(60)] + [(100 + i, "hot", 5) for i in range(20)]
    l = spark.createDataFrame(left, "id long, key string, t long").repartition(4)
    r = spark.createDataFrame(right, "id long, key string, t long").repartition(3)
    for ranges in (2, 13):
        got = asof_join(l, r, "t", "t", [("key", "key")], order=["id"], forward=forward, strict=strict, ranges=ranges)
        assert Counter((x["id"], x["key"], x["t"], x["match"]["id"] if x["match"] else None) for x in got.collect()) == matched(left, right, forward, strict)


def test_asof_defined_cases(spark):
    l = spark.createDataFrame([(1, 10.0), (2, 90.0)], "id long, t double")
    r = spark.createDataFrame([(5, 9.0), (6, 20.0)], "id long, t double")
    near = asof_join(l, r, "t", "t", within=F.col("t") - F.col("match.t") <= 5).orderBy("id").collect()
    assert [x["match"] and x["match"]["id"] for x in near] == [5, None]
    assert asof_join(l.limit(0), r, "t", "t").count() == 0
    assert [x["match"] for x in asof_join(l, r.limit(0), "t", "t").collect()] == [None, None]
    with pytest.raises(ValueError):
        asof_join(l, r, "t", "t", name="id")


def test_hot_key_fills_many_ranges(spark, monkeypatch):
    """No range holds more than its share, though all rows have one key and a third of them one time."""
    from nearwise.operators import ranges as module

    seen = []
    written = module.in_ranges
    monkeypatch.setattr(module, "in_ranges", lambda *a, **k: seen.append(written(*a, **k)) or seen[-1])
    l = spark.range(9000).select("id", F.lit("k").alias("key"), F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id") % 100).alias("t"))
    r = spark.range(100).select("id", F.lit("k").alias("key"), F.col("id").alias("t"))
    got = asof_join(l, r, "t", "t", [("key", "key")], ranges=16)
    assert got.where("match.t <> t OR match IS NULL").count() == 0
    most = seen[0].groupBy("part").count().agg(F.max("count")).first()[0]
    assert most < 9100 / 16 * 2


def test_hot_place_costs_k_pairs(spark):
    rng = random.Random(3)
    left = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(400)]
    right = [(i, 50.0, 50.0) for i in range(2000)] + [(5000 + i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(2000)]
    schema = "id long, x double, y double"
    points, places = spark.createDataFrame(right, schema), spark.createDataFrame(left, schema)
    few, n = join._limited(points, 10)
    assert n == 2010 == few.count()
    asked = places.select(F.col("x").alias("px"), F.col("y").alias("py"))
    pairs = join.meetings(asked, join.right_index(few, "kdtree", n, 32), 10, 400).withColumn("d2", join._d2()).where("d2 <= bound").count()
    assert pairs < 50 * 400 * 10
    got = join.knn_join(places, points, 10, direct_pairs=0).collect()
    for row in got[:40]:
        want = sorted(((row["x"] - x) ** 2 + (row["y"] - y) ** 2, i) for i, x, y in right)[:10]
        assert [i for _, i in want] == [p["id"] for p in row["neighbors"]]


@pytest.mark.parametrize("direct", [0, 10**9])
def test_own_tracks_are_left_out(spark, direct):
    """Ids repeat, one of them in a third of all rows, at one place for some."""
    rng = random.Random(4)
    rows = [(1 if i % 3 == 0 else 2 + i % 9, float(rng.randrange(12)), float(rng.randrange(12))) for i in range(300)]
    rows += [(1, 5.0, 5.0)] * 60 + [(77, 5.0, 5.0), (78, 1.0, 1.0), (None, 5.0, 5.0), (None, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = join.knn_join(df, df, 3, exclude_self=True, direct_pairs=direct, per_leaf=4).collect()
    assert len(got) == len(rows)
    for r in got:
        others = sorted(((r["x"] - x) ** 2 + (r["y"] - y) ** 2, -1 if i is None else i) for i, x, y in rows if i is None or i != r["id"])
        assert [(n["distance"] ** 2, n["id"]) for n in r["neighbors"]] == [(pytest.approx(d), None if i < 0 else i) for d, i in others[:3]]


def test_layout_samples_all_files(spark, tmp_path):
    spark.range(0, 200_000, 1, 8).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y")).write.parquet(str(tmp_path / "sorted"))
    points = spark.read.parquet(str(tmp_path / "sorted"))
    assert abs(layout(points, "kdtree", 200_000, 32).splits[0] / 100_000 - 1) < 0.02


def test_refined_cells_hold_no_more(spark):
    points = spark.createDataFrame([(float(i % 50), float(i // 50)) for i in range(2500)] + [(3.0, 3.0)] * 90, "x double, y double")
    cells = grid.refined(points, 32, 40, 3)
    assert cells.agg(F.sum("n")).first()[0] == 2590
    assert cells.where("level < 3 AND n > 40").count() == 0 and cells.where("level = 3 AND n > 40").count() == 1
