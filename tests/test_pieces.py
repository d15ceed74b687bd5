"""Grid, helpers, text and streams."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nearwise.functions import helpers as h
from nearwise.operators import grid
from nearwise.operators.join import knn_join
from nearwise.sources.points import format_results, parse_points, read_points, write_results
from nearwise.streaming.knn import stream_knn


def test_cells_round_half_up_from_zero(spark):
    rows = spark.createDataFrame([(v,) for v in (-190.0, -70.0, -120.0, 50.0, 250.0, 40.0)], "x double")
    assert [r[0] for r in rows.select(grid.cell(F.col("x"), 100)).collect()] == [-1, 0, -1, 1, 3, 0]


def test_capacity_sweep(spark):
    cells = spark.createDataFrame([(0, i, n) for i, n in enumerate([3, 3, 3, 9, 1, 1, 12, 1])], "cx long, cy long, n long")
    assert [r["part_id"] for r in grid.assign_partitions(cells, 6, 8).orderBy("cy").collect()] == [0, 0, 1, 2, 3, 3, 4, 5]
    assert grid.assign_partitions(cells.limit(0), 6, 8).count() == 0


def test_regrid_and_capacity():
    assert grid.regrid(100, 90, 10) == pytest.approx(100 / 3) and grid.regrid(100, 5, 10) == 100
    plan = grid.capacity(0, 1, 1, 400_000_000, 100)
    assert plan["min_partitions"] == 1 and plan["max_partitions"] == 1


def test_helpers(spark):
    row = spark.createDataFrame([("4GB", "1.05", "1.5", "banana", "")], "a string, b string, c string, d string, e string")
    got = row.select(
        h.bytes_of(F.col("a")), h.ceil_text(F.col("b")), h.ceil_text(F.col("c")), h.nth_index(F.col("d"), "ana", 2), h.nth_index(F.col("d"), "ana", 3),
        h.null_or_empty(F.col("e")), h.null_or_empty(F.col("e"), F.col("d")), h.before_point(F.col("b")), h.is_truth_text(F.lit("yes")),
    ).first()
    assert tuple(got) == (4_000_000_000, 1, 2, 3, -1, True, False, "1", True)
    with pytest.raises(PySparkException):
        row.select(h.bytes_of(F.col("d"))).collect()


def test_text_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([("10.9 -3.2,1 1",), ("13 0",), ("a b",), ("1",), ("",), (None,)], "value string")
    lines.where("value is not null").coalesce(1).write.text(str(tmp_path / "in"))
    points = read_points(spark, str(tmp_path / "in")).orderBy("x").collect()
    assert [tuple(r) for r in points] == [(10.0, -3.0, "10.9 -3.2"), (13.0, 0.0, "13 0")]
    with pytest.raises(PySparkException):
        parse_points(lines, strict=True).collect()
    left = spark.createDataFrame([(1, 10.0, -3.0, "10.9 -3.2")], "id long, x double, y double, t string")
    right = spark.createDataFrame([(7, 13.0, 0.0)], "id long, x double, y double")
    write_results(format_results(knn_join(left, right, 2), F.col("t"), text_of=lambda n: F.lit("13 0")), str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["10.9 -3.2;4.24264069,13 0"]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i), 0.0) for i in range(6)], "id long, x double, y double")
    rows.write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = stream_knn(stream, rows, 2, lambda df, n: got.extend(df.collect()), output="exploded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert len(got) == 12 and {r["right_id"] for r in got if r["left_id"] == 0} == {0, 1}


def test_output_dirs_and_logs(caplog):
    from nearwise.functions import helpers

    assert helpers.random_output_dir("/a", lambda n: n - 1) == "/a/998" and helpers.random_output_dir("/a/").startswith("/a/")
    with caplog.at_level("INFO"):
        helpers.log_if(False, [], lambda: 1 / 0)
        helpers.log_if(True, [], lambda: "found 3")
    assert caplog.messages == ["found 3"]


def test_partitions_are_numbered_anew(spark):
    from nearwise.operators import grid

    rows = spark.createDataFrame([(1, 4), (2, 9), (3, 4), (4, 2)], "id long, part_id long")
    needed = spark.createDataFrame([(4,), (9,)], "part_id long")
    assert sorted(map(tuple, grid.renumbered(rows, needed).select("id", "part_id").collect())) == [(1, 0), (2, 1), (3, 0)]


def test_work_tables_go(spark, tmp_path, monkeypatch):
    from nearwise.plans import tables

    monkeypatch.setattr(tables, "base_dir", lambda spark: f"file://{tmp_path}")
    assert tables.save(spark.range(3)).count() == 3 and len(list(tmp_path.iterdir())) == 1
    tables.clear(spark)
    assert not list(tmp_path.iterdir())
