"""An index that is changed gives what a join with the final points gives."""

from __future__ import annotations

import random

import pytest

from nearwise.operators import stored
from nearwise.operators.join import knn_join
from nearwise.plans import tables
from nearwise.streaming.knn import stream_knn

SCHEMA = "id long, x double, y double"


def cloud(seed, n, first=0, spread=100.0):
    rng = random.Random(seed)
    return [(first + i, round(rng.gauss(0, spread), 1), round(rng.gauss(0, spread), 1)) for i in range(n)]


def lists(spark, left, right, k=4):
    return {r["id"]: [(n["distance"], n["id"]) for n in r["neighbors"]] for r in knn_join(spark.createDataFrame(left, SCHEMA), right, k).collect()}


def test_changes_are_seen(spark, tmp_path):
    now, left, path = cloud(1, 300), cloud(2, 40), str(tmp_path / "index")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    index = stored.Stored.create(frame([*now, (9, float("nan"), 0.0)]), path, per_leaf=8)
    steps = [("insert", cloud(3, 50, 1000, 900.0)), ("delete", [r for r in now if r[0] % 3 == 0]), ("insert", [(3, 0.0, 0.0), (None, 1.0, 1.0), (3, 0.0, 0.0)]), ("delete", [(3, 0.0, 0.0), (None, 0.0, 0.0), (77_777, 0.0, 0.0)])]
    for kind, rows in steps:
        getattr(index, kind)(frame(rows))
        now = now + rows if kind == "insert" else [r for r in now if r[0] is None or r[0] not in {i for i, _, _ in rows}]
        again = stored.Stored.open(spark, path)
        assert sorted(map(str, again.points().select("id", "x", "y").collect())) == sorted(map(str, frame(now).collect()))
        assert sum(r["n"] for r in again.index().levels[-1].collect()) == len(now)
        assert lists(spark, left, again.index()) == lists(spark, left, frame(now))
    index.compact()
    index.vacuum()
    assert len(index._since_base()) == 1
    assert lists(spark, left, stored.Stored.open(spark, path).index()) == lists(spark, left, frame(now))


def test_compacts_by_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "MAX_CHANGES", 2)
    index = stored.Stored.create(spark.createDataFrame(cloud(1, 100), SCHEMA), str(tmp_path / "index"))
    for i in range(3):
        index.insert(spark.createDataFrame(cloud(i, 3, 1000 * i + 1000), SCHEMA))
    assert [v["kind"] for v in index.versions] == ["base", "insert", "insert", "insert", "base"]
    assert index.points().count() == 109


def test_empty(spark, tmp_path):
    index = stored.Stored.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "index"))
    assert lists(spark, [(1, 0.0, 0.0)], index.index()) == {1: []}
    index.delete(spark.createDataFrame([(1,)], "id long"))
    index.insert(spark.createDataFrame([(5, 3.0, 4.0)], SCHEMA))
    assert lists(spark, [(1, 0.0, 0.0)], index.index()) == {1: [(5.0, 5)]}
    with pytest.raises(ValueError):
        stored.Stored(spark, "nowhere", []).plane()


def test_stream_sees_changes_and_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "base_dir", lambda spark: f"file://{tmp_path}/work")
    path, got = str(tmp_path / "index"), {}
    index = stored.Stored.create(spark.createDataFrame([(1, 0.0, 0.0)], SCHEMA), path)
    source = tmp_path / "in"
    home = next((tmp_path / "work").iterdir())
    before = len(list(home.iterdir()))

    def run(row):
        spark.createDataFrame([row], SCHEMA).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        writer = stream_knn(stream, path, 1, lambda df, n: got.update({r["left_id"]: r["right_id"] for r in df.collect()}), output="exploded", direct_pairs=0)
        writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)

    run((10, 5.0, 5.0))
    assert len(list(home.iterdir())) == before
    index.insert(spark.createDataFrame([(2, 6.0, 5.0)], SCHEMA))
    run((11, 5.0, 5.0))
    assert got == {10: 1, 11: 2}


def test_discard_refuses_other_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "mine"))
    with pytest.raises(ValueError):
        tables.discard(spark.read.parquet(str(tmp_path / "mine")))
    tables.discard(tables.save(spark.range(3)))
    assert spark.read.parquet(str(tmp_path / "mine")).count() == 3
