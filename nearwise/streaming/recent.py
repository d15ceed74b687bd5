"""Neighbours among what was there lately: asks (id, x, y, at) among points (id, x, y, at) that came up to `within`
seconds before them, no further than `radius` away.

Both forms cut the plane into cells as wide as the radius: a point lies in one, an ask goes to its own and the eight
around it. Over tables, asks and points meet by cell and by stretch of time, and the k nearest are kept by rank. Over
streams, a cell is a key with state: the points of the last `within` seconds and the asks that wait. An ask waits until
the watermark has passed the end of the `tick` it lies in, when all points it may see have come; then each of its cells
gives its k nearest, all in one micro-batch, whose rank leaves the k nearest of all cells. Timers answer asks and
drop points that are too old for any ask to come, so state holds two stretches of `within` at most, however long the streams run. A task
reads one cell's points at a time; where one place is hot, `salts` deals each cell's points to as many keys.

Defined cases: a point at an ask's time counts, one exactly `within` before it does not; ties go to the smaller point id;
equal asks (same id, place and time) are one; equal points are two neighbours; rows with a null id or time, or without finite
coordinates, are left out; an ask without neighbours has no rows. Ids are longs. Rows of a stream that come after
the watermark (the latest time seen in either stream, less `delay`) are left out; asks that the watermark never passes wait."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from nearwise.functions.geometry import dist2
from nearwise.operators.join import as_points
from nearwise.plans.tables import scratch

_ROW = "t long, id long, x double, y double"
_FOUND = "left_id long, px double, py double, asked_at long, right_id long, d2 double"
#: Pairs of an ask and a point that a cell's task compares at once.
PAIRS = 1 << 20
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _timed(rows: DataFrame, on: tuple[str, str, str, str]) -> DataFrame:
    """id, x, y, at and t, the time in microseconds."""
    named = rows.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(on, ("id", "x", "y", "at"), strict=True)])
    named = named.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("at").cast("timestamp").alias("at"))
    finite = [F.abs(F.col(c)) < F.lit(float("inf")) for c in ("x", "y")]
    return named.where(F.col("id").isNotNull() & F.col("at").isNotNull() & finite[0] & finite[1]).withColumn("t", F.unix_micros("at"))


def _cell(c: str, radius: float) -> Column:
    return F.floor(F.col(c) / F.lit(float(radius)))


def _around(asks: DataFrame, radius: float) -> DataFrame:
    """Asks once for each cell in which a point within the radius may lie."""
    steps = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    asks = asks.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    return asks.withColumns({"cx": _cell("x", radius) + F.col("i"), "cy": _cell("y", radius) + F.col("j")}).drop("i", "j")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """left_id, asked_at, rank, right_id, distance."""
    near = Window.partitionBy("left_id", "px", "py", "asked_at").orderBy("d2", "right_id")
    top = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    return top.select("left_id", F.timestamp_micros("asked_at").alias("asked_at"), "rank", "right_id", F.sqrt("d2").alias("distance"))


def _checked(k: int, within: float, radius: float) -> int:
    if k < 1 or not within > 0 or not radius > 0:
        raise ValueError("k, within and radius must be positive")
    return round(within * 1_000_000)


def knn_recent(asks: DataFrame, points: DataFrame, k: int, *, within: float, radius: float, asks_on=("id", "x", "y", "at"), points_on=("id", "x", "y", "at")) -> DataFrame:
    """Over tables: left_id, asked_at, rank, right_id, distance."""
    span = _checked(k, within, radius)
    stretch = F.floor(F.col("t") / F.lit(span))
    a = _around(_timed(asks, asks_on).distinct(), radius).withColumn("s", F.explode(F.array(stretch - 1, stretch)))
    a = a.select(F.col("id").alias("left_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("t").alias("asked_at"), "cx", "cy", "s")
    p = _timed(points, points_on).select(F.col("id").alias("right_id"), F.col("x").alias("qx"), F.col("y").alias("qy"), "t", _cell("x", radius).alias("cx"), _cell("y", radius).alias("cy"), stretch.alias("s"))
    met = a.join(p, ["cx", "cy", "s"]).withColumn("d2", dist2(*map(F.col, ("px", "py", "qx", "qy"))))
    met = met.where((F.col("t") <= F.col("asked_at")) & (F.col("t") > F.col("asked_at") - span) & (F.col("d2") <= F.lit(float(radius) ** 2)))
    return _nearest(met.select("left_id", "px", "py", "asked_at", "right_id", "d2"), k)


class _Cell(StatefulProcessor):
    """One cell's points and waiting asks."""

    def __init__(self, k: int, span: int, tick: int, radius: float) -> None:
        self.k, self.span, self.tick, self.r2 = k, span, tick, float(radius) ** 2
        self.now, self.done = None, set()

    def init(self, handle) -> None:
        self.handle = handle
        self.points, self.asks = handle.getListState("points", _ROW), handle.getListState("asks", _ROW)

    def _end(self, t: np.ndarray) -> np.ndarray:
        """Where the ticks of these times end."""
        return (t // self.tick + 1) * self.tick

    @staticmethod
    def _rows(state) -> np.ndarray:
        """In order of time."""
        kinds = [("t", "i8"), ("id", "i8"), ("x", "f8"), ("y", "f8")]
        rows = np.array([tuple(r) for r in state.get()] if state.exists() else [], dtype=kinds)
        return rows[np.lexsort([rows[c] for c in ("y", "x", "id", "t")])]

    @staticmethod
    def _keep(state, rows: np.ndarray) -> None:
        if len(rows):
            state.put([tuple(r) for r in rows.tolist()])
        else:
            state.clear()

    def _wake(self, asks: np.ndarray, points: np.ndarray, after: int = 0) -> None:
        """Sets one timer, for when the first of these is due: it deals with all that is due by then, and sets the next. A point goes at
        the end of the next stretch. `asks` and `points` are times."""
        ends = [self._end(asks).min()] if len(asks) else []
        ends += [(points.min() // self.span + 2) * self.span] if len(points) else []
        if ends:
            self.handle.registerTimer(max(int(-(-min(ends) // 1000)), after))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came: list[list[np.ndarray]] = [[], []]
        for batch in rows:
            for asking, state in ((1, self.asks), (0, self.points)):
                some = batch[batch["asking"] == bool(asking)]
                if len(some):
                    state.appendList(list(some[["t", "id", "x", "y"]].itertuples(index=False, name=None)))
                    came[asking].append(some["t"].to_numpy())
        none = np.array([], np.int64)
        self._wake(np.concatenate([none, *came[1]]), np.concatenate([none, *came[0]]))
        return iter(())

    def _answers(self, asks: np.ndarray, points: np.ndarray) -> Iterator[pd.DataFrame]:
        """The asks' nearest points, of some asks at once: as many as have PAIRS points in their stretches together, or one."""
        low, high = (np.searchsorted(points["t"], t, side="right") for t in (asks["t"] - self.span, asks["t"]))
        upto, first = np.cumsum(high - low), 0
        while first < len(asks):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, side="right")))
            n = high[first:last] - low[first:last]
            ask = np.repeat(np.arange(first, last), n)
            point = np.arange(len(ask)) - np.repeat(np.cumsum(n) - n, n) + low[ask]
            d2 = (asks["x"][ask] - points["x"][point]) ** 2 + (asks["y"][ask] - points["y"][point]) ** 2
            near = d2 <= self.r2
            ask, point, d2 = ask[near], point[near], d2[near]
            order = np.lexsort((points["id"][point], d2, ask))
            rank = np.arange(len(ask)) - np.searchsorted(ask, ask)  # asks come in order
            order = order[rank < self.k]
            if len(order):
                by, of = asks[ask[order]], points[point[order]]
                yield pd.DataFrame({"left_id": by["id"], "px": by["x"], "py": by["y"], "asked_at": by["t"], "right_id": of["id"], "d2": d2[order]})
            first = last

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if now != self.now:
            self.now, self.done = now, set()
        if key in self.done:  # an earlier timer of this batch did it all
            return
        self.done.add(key)
        asks, points = self._rows(self.asks), self._rows(self.points)
        asks = asks[np.append(True, asks[1:] != asks[:-1])[: len(asks)]]
        due = self._end(asks["t"]) <= now * 1000
        yield from self._answers(asks[due], points)
        waiting = asks[~due]
        self._keep(self.asks, waiting)
        since = min([now * 1000, *waiting["t"].tolist()]) - self.span  # asks that are still to come are later than now
        left = points[points["t"] > since]
        self._keep(self.points, left)
        self._wake(waiting["t"], left["t"], now + 1)

    def close(self) -> None:
        pass


def stream_knn_recent(
    asks: DataFrame, points: DataFrame, k: int, sink: Callable[[DataFrame, int], None], *, within: float, radius: float, delay: float = 0, tick: float = 60, salts: int = 1,
    asks_on=("id", "x", "y", "at"), points_on=("id", "x", "y", "at"),
) -> DataStreamWriter:
    """Over streams: each micro-batch of left_id, asked_at, rank, right_id, distance is handed to `sink` with its number. `within`,
    `delay` and `tick` are seconds. The session's state store must be RocksDB, as Spark asks of arbitrary state."""
    span, step = _checked(k, within, radius), round(tick * 1000) * 1000
    if step <= 0 or salts < 1 or delay < 0:
        raise ValueError("tick and salts must be positive, delay not negative")
    spark = asks.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        raise ValueError(f"set {PROVIDER} to {ROCKS}")
    both = _timed(asks, asks_on).withColumn("asking", F.lit(True)).unionByName(_timed(points, points_on).withColumn("asking", F.lit(False)))
    both = both.withWatermark("at", f"{round(delay * 1000)} milliseconds")
    # cells and salts are made in one pass, since a stream is read once for each branch of a plan
    steps = F.when(F.col("asking"), F.array(*[F.lit(i) for i in (-1, 0, 1)])).otherwise(F.array(F.lit(0)))
    salt = F.when(F.col("asking"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")))
    both = both.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).withColumn("salt", F.explode(salt))
    both = both.select("at", "t", "id", "x", "y", "asking", (_cell("x", radius) + F.col("i")).alias("cx"), (_cell("y", radius) + F.col("j")).alias("cy"), "salt")
    found = both.groupBy("cx", "cy", "salt").transformWithStateInPandas(_Cell(k, span, step, radius), _FOUND, "append", "eventTime")

    def ranked(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            sink(_nearest(batch, k), number)

    return found.writeStream.foreachBatch(ranked)
