"""Neighbour joins against brute force, and in the cases where cells can go wrong."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearwise.operators import join
from nearwise.operators.join import all_knn_join, find_exact, knn_join, knn_point_query, range_join
from nearwise.plans.registry import queries

SCHEMA = "id long, x double, y double"


def brute(left, right, k):
    out = {}
    for i, x, y in left:
        d2 = sorted(((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b in right)
        out[i] = [(j, float(np.sqrt(d))) for d, j in d2[:k]]
    return out


def joined(spark, left, right, k, **options):
    rows = knn_join(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), k, **options).collect()
    return {r["id"]: [(n["id"], n["distance"]) for n in r["neighbors"]] for r in rows}


def cloud(seed, n, spread=1000.0, first=0):
    r = np.random.default_rng(seed)
    return [(first + i, float(x), float(y)) for i, (x, y) in enumerate(r.normal(0, spread, (n, 2)).round(1))]


@pytest.mark.parametrize("index", ["quadtree", "kdtree", "brute"])
@pytest.mark.parametrize("k", [1, 10, 300])
def test_cells_change_nothing(spark, index, k):
    left, right = cloud(1, 60), cloud(2, 250)
    assert joined(spark, left, right, k, index=index, direct_pairs=0, per_leaf=4) == brute(left, right, k)


CASES = {
    "prune_trap": ([(1, 251.0, 251.0)], [(1, 349.0, 349.0), (2, 149.0, 251.0)], 1),
    "ties": ([(1, 0.0, 0.0)], [(1, 1.0, 0.0), (2, 0.0, 1.0), (3, -1.0, 0.0), (4, 0.0, -1.0)], 2),
    "coincident": ([(1, 5.0, 5.0)], [(i, 5.0, 5.0) for i in range(50)], 10),
    "short_right": ([(i, float(i), 0.0) for i in range(3)], [(1, 0.0, 0.0), (2, 9.0, 9.0)], 5),
    "one_point": ([(1, 3.0, 4.0)], [(1, 3.0, 4.0)], 3),
    "collinear": ([(i, i * 7.0, 0.0) for i in range(9)], [(i, i * 3.0, 0.0) for i in range(40)], 4),
    "two_scales": ([(i, i * 1e-4, i * 1e6) for i in range(9)], [(i, i * 2e-4, i * 3e6 - 5e6) for i in range(40)], 4),
    "empty_right": ([(1, 0.0, 0.0), (2, 1.0, 1.0)], [], 3),
    "empty_left": ([], [(1, 0.0, 0.0)], 3),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("options", [{}, {"direct_pairs": -1, "per_leaf": 2, "index": "quadtree"}, {"direct_pairs": -1, "per_leaf": 2, "index": "kdtree"}])
def test_small_cases(spark, name, options):
    left, right, k = CASES[name]
    assert joined(spark, left, right, k, **options) == brute(left, right, k)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=1, max_size=40), st.integers(1, 6), st.sampled_from(["quadtree", "kdtree"]))
def test_any_points(spark, places, k, index):
    rows = [(i, x / 4, y / 4) for i, (x, y) in enumerate(places)]
    assert joined(spark, rows, rows, k, index=index, direct_pairs=-1, per_leaf=2) == brute(rows, rows, k)


def test_midpoints_below_the_medians(spark, monkeypatch):
    monkeypatch.setattr("nearwise.operators.layout.KD_DEPTH", 2)
    monkeypatch.setattr("nearwise.operators.layout.SAMPLE", 30)
    left, right = cloud(8, 50), cloud(9, 400)
    assert joined(spark, left, right, 6, direct_pairs=0, per_leaf=2) == brute(left, right, 6)


def test_null_and_nan(spark):
    rows = [(1, None, 1.0), (2, float("nan"), 1.0), (3, 0.0, 0.0)]
    assert joined(spark, rows, rows, 2) == {1: [], 2: [], 3: [(3, 0.0)]}


def test_exclude_self_and_both_directions(spark):
    rows = cloud(3, 40)
    got = joined(spark, rows, rows, 3, exclude_self=True, direct_pairs=0, per_leaf=3)
    assert got == {i: [n for n in ns if n[0] != i][:3] for i, ns in brute(rows, rows, 4).items()}
    a, b = spark.createDataFrame(cloud(4, 15), SCHEMA), spark.createDataFrame(cloud(5, 20), SCHEMA)
    both = all_knn_join(a, b, 2).groupBy("direction").count().collect()
    assert {r["direction"]: r["count"] for r in both} == {"left": 30, "right": 40}


@pytest.mark.parametrize("options", [{}, {"direct_pairs": -1, "per_leaf": 2}])
def test_left_ids_that_repeat_or_are_null(spark, options):
    left = spark.createDataFrame([(1, 0.0, 0.0), (1, 100.0, 0.0), (1, 0.0, 0.0), (None, 3.0, 0.0), (None, None, 0.0)], SCHEMA)
    right = [(7, 1.0, 0.0), (8, 99.0, 0.0), (9, 2.0, 0.0), (10, 101.0, 0.0)]
    rows = knn_join(left, spark.createDataFrame(right, SCHEMA), 2, **options).collect()
    got = sorted((r["id"] or 0, r["x"] if r["x"] is not None else -1.0, [(n["id"], n["distance"]) for n in r["neighbors"]]) for r in rows)
    origin = (1, 0.0, [(7, 1.0), (9, 2.0)])
    assert got == [(0, -1.0, []), (0, 3.0, [(9, 1.0), (7, 2.0)]), origin, origin, (1, 100.0, [(8, 1.0), (10, 1.0)])]
    flat = knn_join(left, spark.createDataFrame(right, SCHEMA), 2, output="exploded", **options).collect()
    assert len(flat) == 8 and sorted(r["rank"] for r in flat) == [1] * 4 + [2] * 4


def test_exclude_self_with_right_ids_that_repeat(spark):
    right = [(1, 0.0, 0.0), (1, 0.5, 0.0), (1, 0.6, 0.0), (2, 1.0, 0.0), (3, 2.0, 0.0), (None, 3.0, 0.0)]
    left = [(1, 0.0, 0.0), (None, 3.0, 0.0)]
    got = joined(spark, left, right, 3, exclude_self=True, direct_pairs=-1, per_leaf=1)
    assert got == {1: [(2, 1.0), (3, 2.0), (None, 3.0)], None: [(None, 0.0), (3, 1.0), (2, 2.0)]}


def test_columns_that_clash(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0, 5, 6, 7)], SCHEMA + ", px long, list long, left_id long")
    row = knn_join(left, spark.createDataFrame([(4, 3.0, 4.0)], SCHEMA), 1).first()
    assert row[:6] == (1, 0.0, 0.0, 5, 6, 7) and row["neighbors"][0]["distance"] == 5.0


@pytest.mark.parametrize("place", ["apart", "nested", "skewed", "same"])
def test_few_pairs_whatever_the_extents(spark, monkeypatch, place):
    """Far fewer than all pairs meet, and the result is that of brute force."""
    monkeypatch.setattr(join, "LEFT_CELL", 16)
    right = cloud(11, 1500, 10.0, first=10_000)
    left = {
        "apart": [(i, x + 5000, y - 3000) for i, x, y in cloud(12, 300, 2000.0)],
        "nested": cloud(13, 300, 1000.0),
        "skewed": [(i, x**3, y) for i, x, y in cloud(14, 300, 10.0)],
        "same": cloud(15, 300, 10.0),
    }[place]
    l, r = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    places = join.as_points(l).select(F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    met = join.meetings(places, join.right_index(join.as_points(r), "kdtree", 1500, 16), 5, places.count()).count()
    assert met < 0.1 * len(left) * len(right), met
    assert joined(spark, left, right, 5, direct_pairs=0, per_leaf=16) == brute(left, right, 5)


def test_hints_size_the_leaves(spark):
    df = join.as_points(spark.createDataFrame([(i, float(i % 100), float(i // 100)) for i in range(5000)], SCHEMA))
    assert join.leaf_size(5000, df, 3, 32, None, 0) == 32
    assert join.leaf_size(5000, df, 3, 32, 10.0, 0) == pytest.approx(5000 / (9.9 * 4.9), abs=1)
    assert join.leaf_size(5000, df, 3, 32, 10.0, 480) == 20
    with pytest.raises(ValueError):
        join.leaf_size(5000, df, 3, 32, 0, 0)


def test_view_for_sql(spark):
    spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], SCHEMA).createOrReplaceTempView("asks")
    spark.createDataFrame([(5, 3.0, 4.0), (6, 9.0, 9.0)], SCHEMA).createOrReplaceTempView("fixed")
    join.knn_view(spark, "near", "asks", "fixed", 1)
    rows = spark.sql("SELECT left_id, right_id, distance FROM near WHERE rank = 1 ORDER BY left_id").collect()
    assert [tuple(r) for r in rows] == [(1, 5, 5.0), (2, 6, 0.0)]


def test_plan_has_no_pairs_of_points(spark):
    df = spark.createDataFrame(cloud(6, 100), SCHEMA)
    plan = knn_join(df, df, 3, direct_pairs=0, per_leaf=4, output="exploded")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan.split("== Physical Plan ==")[1]


def test_bad_arguments(spark, monkeypatch):
    df = spark.createDataFrame(cloud(7, 3), SCHEMA)
    for options in ({"k": 0}, {"k": 1, "index": "none"}):
        with pytest.raises(ValueError):
            knn_join(df, df, **options)
    with pytest.raises(ValueError):
        range_join(df, df, 0)
    monkeypatch.setattr(join, "DIRECT_ROWS", 2)
    with pytest.raises(ValueError):
        knn_join(df, df, 1, index="brute")


def test_point_exact_and_range(spark):
    rows = [(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 3.0, 4.0), (4, 6.0, 8.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in knn_point_query(df, 0, 0, 3).orderBy("rank").collect()] == [(1, 1, 0.0), (2, 2, 5.0), (3, 3, 5.0)]
    assert {r["id"]: r["match_id"] for r in find_exact(df, df).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
    assert sorted((r[0], r[1]) for r in range_join(df, df, 5).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (2, 4), (3, 1), (3, 2), (3, 3), (3, 4), (4, 2), (4, 3), (4, 4)]


def test_equal_pairs_deals_one_key_to_many_tasks(spark):
    left = [(i, 1.5 if i % 10 else [-0.0, None, float("nan")][i // 10 % 3]) for i in range(300)] + [(7, 1.5)] * 3
    right = [(i, [1.5, 1.5, 0.0, None, float("nan"), 9.0][i % 6]) for i in range(600)]
    l, r = spark.createDataFrame(left, "left_id long, ly double"), spark.createDataFrame(right, "right_id long, ry double")
    same = lambda a, b: a is not None and b is not None and (a == b or a != a and b != b)
    want = sorted((i, j) for i, a in left for j, b in right if same(a, b))
    found = join.equal_pairs(l, r, "ly", "ry", tile=32)
    assert sorted((x["left_id"], x["right_id"]) for x in found.collect()) == want
    own = found.where("ly = 1.5").groupBy(F.spark_partition_id()).count().collect()
    assert len(own) > 1 and max(x["count"] for x in own) < len(want) / 2
    assert join.equal_pairs(l, r.limit(0), "ly", "ry").count() == 0


def test_distance_pairs_reads_no_key_in_one_task(spark, tmp_path):
    """The registered query, with all points on one line."""
    spark.range(3000).selectExpr("id AS s_suppkey", "CAST(id AS DOUBLE) AS s_acctbal", "1 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(5000).selectExpr("id AS c_custkey", "CAST(id AS DOUBLE) AS c_acctbal", "1 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    found = queries()["distance_pairs"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*"), F.sum(F.abs(F.col("left_id") - F.col("right_id")) - F.col("d"))).collect()
    assert sum(x[1] for x in found) == 15_000_000 and len(found) > 1 and all(x[2] == 0 for x in found)


def test_range_join_cuts_full_cells(spark, monkeypatch):
    """All points in one cell: no task has most of the pairs."""
    monkeypatch.setattr(join, "TILE", 32)
    left, right = spark.range(300).selectExpr("id", "id / 1000D AS x", "0D AS y"), spark.range(300).selectExpr("id", "id / 1000D AS x", "0.5D AS y")
    found = range_join(left, right, 10)
    assert found.distinct().count() == 90_000
    own = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(own) > 1 and max(x["count"] for x in own) < 45_000


def test_equal_pairs_keeps_equal_places_together(spark):
    """Rows of a place lie beside each other in a tile, those of one with more rows than a tile fill many."""
    left = [(i, 1.0, 5.0 if i % 2 else float(i % 7)) for i in range(210)]
    right = [(i, 1.0, float(i % 40)) for i in range(400)]
    l, r = spark.createDataFrame(left, "left_id long, ly double, lx double"), spark.createDataFrame(right, "right_id long, ry double, rx double")
    found = join.equal_pairs(l, r, "ly", "ry", tile=32, near=(("lx",), ("rx",)))
    assert found.columns == ["left_id", "ly", "lx", "right_id", "ry", "rx"]
    parts = found.select("left_id", "right_id", "lx", "rx").rdd.glom().collect()
    assert sorted((x[0], x[1]) for part in parts for x in part) == [(i, j) for i in range(210) for j in range(400)]
    runs = sum(a[2:] != b[2:] for part in parts for a, b in zip(part, part[1:]))
    assert runs < 84_000 / 8 and sum(map(bool, parts)) > 1


def test_equal_pairs_exchange_grows_with_rows(spark):
    """Four times the rows of one key are sixteen times the pairs; what is exchanged grows like the rows."""

    def exchanged() -> int:
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    sent = []
    for n in (600, 2400):
        l, r = spark.range(n).selectExpr("id AS left_id", "1 AS ly"), spark.range(n).selectExpr("id AS right_id", "1 AS ry")
        before = exchanged()
        found = join.equal_pairs(l, r, "ly", "ry", tile=16).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(F.col("left_id") * n + F.col("right_id")).alias("s")).collect()
        sent.append(exchanged() - before)
        assert sum(x["n"] for x in found) == n * n and sum(x["s"] for x in found) == n * n * (n * n - 1) // 2 and len(found) > 1
    assert sent[1] < 6 * sent[0]
