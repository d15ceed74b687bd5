"""Neighbours of the last stretch of time: tables and streams give what all pairs give."""

from __future__ import annotations

import random
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest

from nearwise.streaming import recent

SCHEMA = "id long, x double, y double, at timestamp"
START = datetime(2024, 5, 1, tzinfo=timezone.utc)


def cloud(seed, n, first=0, hours=6.0):
    rng = random.Random(seed)
    return [(first + i, float(rng.randint(0, 40)), float(rng.randint(0, 40)), START + timedelta(seconds=rng.randint(0, int(hours * 3600)))) for i in range(n)]


def expected(asks, points, k, within, radius, upto=None):
    out = set()
    for i, x, y, t in set(asks):
        if upto is None or t.replace(second=0, microsecond=0) + timedelta(minutes=1) <= upto:
            near = sorted(((x - px) ** 2 + (y - py) ** 2, j) for j, px, py, s in points if t - timedelta(seconds=within) < s <= t)
            out |= {(i, rank, j, d2) for rank, (d2, j) in enumerate([n for n in near if n[0] <= radius**2][:k], 1)}
    return out


def got(df):
    return {(r["left_id"], r["rank"], r["right_id"], round(r["distance"] ** 2, 6)) for r in df.collect()}


@contextmanager
def rocks(spark):
    spark.conf.set(recent.PROVIDER, recent.ROCKS)
    yield
    spark.conf.unset(recent.PROVIDER)


def test_tables(spark):
    asks, points = cloud(1, 60), cloud(2, 400, 1000)
    points += points[:20] + [(5000 + i, 20.0, 20.0, START + timedelta(hours=2)) for i in range(100)]
    strange = [(None, 1.0, 1.0, START), (7, None, 1.0, START), (8, float("nan"), 1.0, START), (9, 1.0, 1.0, None)]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    found = recent.knn_recent(frame(asks + asks[:5] + strange), frame(points + strange), 5, within=3600, radius=9)
    assert got(found) == expected(asks, points, 5, 3600, 9)
    assert recent.knn_recent(frame([]), frame(points), 5, within=1, radius=1).count() == 0
    for bad in ({"within": 0, "radius": 1}, {"within": 1, "radius": float("nan")}):
        with pytest.raises(ValueError):
            recent.knn_recent(frame(asks), frame(points), 5, **bad)


def test_borders_of_time(spark):
    at = START + timedelta(hours=1)
    points = [(1, 0.0, 0.0, START), (2, 0.0, 0.0, START + timedelta(microseconds=1)), (3, 0.0, 0.0, at), (4, 0.0, 0.0, at + timedelta(microseconds=1))]
    found = recent.knn_recent(spark.createDataFrame([(9, 0.0, 0.0, at)], SCHEMA), spark.createDataFrame(points, SCHEMA), 9, within=3600, radius=1)
    assert [r["right_id"] for r in found.orderBy("rank").collect()] == [2, 3]


def test_streams(spark, tmp_path):
    """In order of time, in three batches and salted: each ask is answered once, as all pairs say; late rows are left out."""
    asks, points, out = sorted(cloud(3, 40), key=lambda r: r[3]), sorted(cloud(4, 300, 1000), key=lambda r: r[3]), []
    a, p = str(tmp_path / "asks"), str(tmp_path / "points")

    def run(some, others):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(a)
        spark.createDataFrame(others, SCHEMA).coalesce(1).write.mode("append").parquet(p)
        read = lambda path: spark.readStream.schema(SCHEMA).parquet(path)
        writer = recent.stream_knn_recent(read(a), read(p), 3, lambda df, n: out.extend(got(df)), within=3600, radius=9, salts=2)
        query = writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(200)
        assert query.exception() is None

    with rocks(spark):
        run(*[[r for r in rows if r[3] < START + timedelta(hours=2)] for rows in (asks, points)])
        first = len(out)
        late = [(77, points[0][1], points[0][2], START + timedelta(minutes=5))]
        rest = [[r for r in rows if r[3] >= START + timedelta(hours=2)] for rows in (asks, points)]
        run(rest[0] + late, rest[1])
    upto = max(r[3] for r in asks + points)
    assert first and len(out) == len(set(out))
    assert set(out) == expected(asks, points, 3, 3600, 9, upto)
    # nothing is kept for longer than two stretches of time
    with rocks(spark):
        kept = spark.read.format("statestore").option("stateVarName", "points").load(str(tmp_path / "c")).select("list_element.t").collect()
    assert kept and min(r["t"] for r in kept) > (upto.timestamp() - 2 * 3600) * 1_000_000


def test_state_store_is_asked_for(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        recent.stream_knn_recent(stream, stream, 1, print, within=1, radius=1)


class Handle:
    """State and timers of one key in memory."""

    def __init__(self):
        self.lists, self.timers = {}, []

    def getListState(self, name, schema):
        handle = self

        class State:
            exists = lambda _: bool(handle.lists.get(name))
            get = lambda _: iter(handle.lists[name])
            put = lambda _, rows: handle.lists.update({name: rows})
            appendList = lambda _, rows: handle.lists.update({name: handle.lists.get(name, []) + rows})
            clear = lambda _: handle.lists.pop(name, None)

        return State()

    def getValueState(self, name, schema):
        return self.getListState(name, schema)

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, now):
        self.getCurrentWatermarkInMs = lambda: now


def test_a_cell_answers_in_few_frames(monkeypatch):
    """One timer, and one frame for all asks that are due, or one for each share of the pairs."""
    rng, minute = random.Random(7), 60_000_000
    rows = [(rng.randrange(300) * minute + rng.randrange(minute), i, rng.uniform(0, 9), rng.uniform(0, 9), i % 3 == 0) for i in range(900)]
    frame = pd.DataFrame(rows, columns=["t", "id", "x", "y", "asking"])
    asks, points = [r for r in rows if r[4]], [r for r in rows if not r[4]]
    want = set()
    for t, i, x, y, _ in asks:
        near = sorted(((x - p[2]) ** 2 + (y - p[3]) ** 2, p[1]) for p in points if t - 60 * minute < p[0] <= t)
        want |= {(i, j) for d2, j in [n for n in near if n[0] <= 16][:3]}
    for most in (1 << 20, 5000):
        monkeypatch.setattr(recent, "PAIRS", most, raising=False)
        cell, handle = recent._Cell(3, 60 * minute, minute, 4), Handle()
        cell.init(handle)
        assert list(cell.handleInputRows(("k",), iter([frame]), Clock(0))) == []
        assert len(handle.timers) == 1 and handle.timers[0] <= min(r[0] for r in asks) // 1000 + 60_000
        frames = list(cell.handleExpiredTimer(("k",), Clock(301 * 60_000), None))
        assert {(i, j) for f in frames for i, j in zip(f["left_id"], f["right_id"])} == want
        assert len(frames) == 1 if most > 5000 else 1 < len(frames) < 60
        assert list(cell.handleExpiredTimer(("k",), Clock(301 * 60_000), None)) == []
        assert len(handle.timers) == 2 and handle.timers[1] > 301 * 60_000
