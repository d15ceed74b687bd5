"""Binary space partitions of the plane as paths of bits, with levels of nodes above them.

A path has one bit a split. Splits are midpoints of the extents, x and y in turn ("quadtree", two bits a level), or
medians of a bounded sample ("kdtree", balanced under skew), at most KD_DEPTH of those and then midpoints within each
leaf. A median lies on the axis on which its points are spread most, and so does a midpoint below: an axis with few
values is not split again where one of them is left, so leaves stay small however many points there are. Either way
splits are a few numbers, so a point's path is a plain expression, and points beyond the extents belong to the
nearest cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwise.functions.geometry import rect

SAMPLE, DEEPEST, KD_DEPTH = 20_000, 40, 12


def _numbers(values: Sequence[float]) -> Column:
    """A constant array: one literal, because thousands of them are slow to hand over and to analyse."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


@dataclass
class Layout:
    depth: int
    splits: list[float]  # medians in heap order
    boxes: list[tuple[float, float, float, float]]  # extents below the medians, leaf by leaf
    axes: list[int] = field(default_factory=list)  # of the medians, 1 for y; without them x and y in turn
    turns: list[int] = field(default_factory=list)  # leaf by leaf the axes of the steps below, a bit each from the lowest on; likewise

    def path(self, x: Column, y: Column) -> Column:
        # lambdas bind what is used more than once; written out, it would double with every split
        tall = len(self.boxes).bit_length() - 1
        more, leaf = self.depth - tall, F.lit(0)
        if tall:
            table, axes = _numbers(self.splits), _numbers(self.axes or [((i + 1).bit_length() - 1) % 2 for i in range(len(self.splits))])
            right = lambda at: F.when(F.when(F.get(axes, at) == 0, x).otherwise(y) > F.get(table, at), 1).otherwise(0)
            leaf = F.aggregate(F.sequence(F.lit(0), F.lit(tall - 1)), F.lit(0), lambda at, d: at * 2 + 1 + right(at)) - (2**tall - 1)
        if not more:
            return leaf.cast("long")
        turns = self.turns or [sum(1 << d for d in range(1, more, 2))] * len(self.boxes)
        y_bits = [t.bit_count() for t in turns]

        def cell(v: Column, at: Column, low: int, high: int, bits: list[int]) -> Column:
            lows = F.get(_numbers([b[low] for b in self.boxes]), at)
            steps = F.get(_numbers([(b[high] - b[low]) / 2**n or 1.0 for b, n in zip(self.boxes, bits, strict=True)]), at)
            last = F.get(_numbers([2.0**n - 1 for n in bits]), at)
            return F.least(F.greatest(F.floor((v - lows) / steps).cast("double"), F.lit(0.0)), last).cast("long")

        # a leaf's cell as one number, x above y, and for each step the place of its bit there
        places = []
        for t, n in zip(turns, y_bits, strict=True):
            left = [more, n]
            for d in range(more):
                left[t >> d & 1] -= 1
                places.append(left[t >> d & 1])

        def woven(c: Column) -> Column:
            out = c.leaf
            for d in range(more):
                at = F.lit(places[d]) if len(set(turns)) == 1 else F.get(_numbers(places), (c.leaf * more + d).cast("int")).cast("int")
                out = out * 2 + F.call_function("shiftright", c.cell, at).bitwiseAND(F.lit(1).cast("long"))
            return out

        wide = lambda at: F.get(_numbers([2.0**n for n in y_bits]), at).cast("long")
        placed = lambda at: F.struct(at.cast("long").alias("leaf"), (cell(x, at, 0, 2, [more - n for n in y_bits]) * wide(at) + cell(y, at, 1, 3, y_bits)).alias("cell"))
        return F.get(F.transform(F.transform(F.array(leaf), placed), woven), 0)


def _cut(g: np.ndarray) -> tuple[int, float]:
    """The axis on which points are spread most, and the value there up to which about half of them lie, but never all."""
    if not len(g):
        return 0, 0.0
    axis = int(np.argmax(g.max(axis=0) - g.min(axis=0)))
    values = np.sort(g[:, axis])
    cut = values[(len(g) - 1) // 2]
    below, upto = np.searchsorted(values, cut, "left"), np.searchsorted(values, cut, "right")
    if below and (upto == len(g) or len(g) - 2 * below < 2 * upto - len(g)):
        cut = values[below - 1]
    return axis, float(cut)


def _extents(g: np.ndarray, region: np.ndarray) -> tuple[float, float, float, float]:
    """Of the leaf that the sample's points `g` stand for: theirs and what lies beyond the outermost, within the leaf's splits."""
    if not len(g):
        return (0.0, 0.0, 0.0, 0.0)
    low, high = g.min(axis=0), g.max(axis=0)
    gap = 2 * (high - low) / max(1, len(g) - 1)
    low, high = np.maximum(low - gap, region[0]), np.minimum(high + gap, region[1])
    return tuple(map(float, (*low, *high)))


def _turns(box: tuple[float, float, float, float], steps: int) -> int:
    """The axes of midpoints in a box, always of its longer side, as bits."""
    sides, turns = [box[2] - box[0], box[3] - box[1]], 0
    for d in range(steps):
        axis = d % 2 if not any(sides) else int(sides[1] > sides[0])
        turns |= axis << d
        sides[axis] /= 2
    return turns


def layout(points: DataFrame, kind: str, n: int, per_leaf: int) -> Layout:
    """For n points with columns x and y, about `per_leaf` a leaf."""
    depth = 0
    while n > per_leaf << depth and depth < DEEPEST:
        depth += 1
    if kind == "quadtree":
        b = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        return Layout(depth if b[0] is not None else 0, [], [tuple(map(float, b)) if b[0] is not None else (0.0, 0.0, 0.0, 0.0)])
    # the least of random numbers, so that all files have their share
    sample = points.select("x", "y", F.rand(7).alias("draw")).where(F.col("draw") <= min(1.0, 2 * SAMPLE / max(1, n))).orderBy("draw").limit(SAMPLE).toPandas()
    groups, splits, axes = [(sample[["x", "y"]].to_numpy(dtype=float), np.array([[-np.inf] * 2, [np.inf] * 2]))], [], []
    tall = min(depth, KD_DEPTH)
    for _ in range(tall):
        below = []
        for g, region in groups:
            axis, cut = _cut(g)
            splits.append(cut)
            axes.append(axis)
            lower, upper, low = region.copy(), region.copy(), g[:, axis] <= cut
            lower[1, axis] = upper[0, axis] = cut
            below += [(g[low], lower), (g[~low], upper)]
        groups = below
    boxes = [_extents(g, region) for g, region in groups]
    return Layout(depth, splits, boxes, axes, [_turns(b, depth - tall) for b in boxes])


def nodes(points: DataFrame, depth: int) -> DataFrame:
    """path -> count and extents at `depth`."""
    box = rect(F.min("x"), F.min("y"), F.max("x"), F.max("y")).alias("box")
    return points.groupBy(F.col("path").alias("node")).agg(F.count("*").alias("n"), box)


def parents(level: DataFrame, bits: int) -> DataFrame:
    box = rect(F.min("box.min_x"), F.min("box.min_y"), F.max("box.max_x"), F.max("box.max_y")).alias("box")
    return level.groupBy(F.shiftright("node", bits).alias("node")).agg(F.sum("n").alias("n"), box)
