"""Grid cells: assignment, histogram, summaries, partitions by capacity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearwise.functions.geometry import rect
from nearwise.functions.helpers import round_half_up_from_zero

from nearwise.plans.tables import save

from .index import axis_histogram
from .layout import parents
from .ranges import asof_join, prefix_sums


def cell(v: Column, size: float) -> Column:
    """The cell of a coordinate: its multiple of the cell size, rounded half up from zero."""
    return round_half_up_from_zero(v / F.lit(float(size))).cast("long")


def with_cells(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)})


def extents(prefix: str = "") -> list[Column]:
    return [f(c).alias(f"{prefix}{name}_{c}") for c in ("x", "y") for f, name in ((F.min, "min"), (F.max, "max"))]


def histogram(points: DataFrame, size: float) -> DataFrame:
    """cx, cy, n and the true extents of each cell that has points."""
    return with_cells(points, size).groupBy("cx", "cy").agg(F.count("*").alias("n"), *extents())


def levels(cells: DataFrame, step: int = 4) -> tuple[list[DataFrame], list[int]]:
    """Of a histogram: (levels of nodes over its cells, root first; bits of each step down), for
    `join.candidates`. The bits of cx and cy are woven, so a node is a square of cells; leaves keep cx and cy."""
    low = cells.agg(F.min("cx"), F.min("cy"), F.max("cx"), F.max("cy")).first()
    bits = 0 if low[0] is None else max(low[2] - low[0], low[3] - low[1]).bit_length()
    bit = lambda c, at, b: F.shiftleft(F.shiftright(F.col(c) - at, b).bitwiseAND(F.lit(1).cast("long")), 2 * b + (c == "cx"))
    node = F.lit(0).cast("long")
    for b in range(bits):
        node = node + bit("cx", low[0], b) + bit("cy", low[1], b)
    found, steps, left = [cells.select(node.alias("node"), "n", rect(*map(F.col, ("min_x", "min_y", "max_x", "max_y"))).alias("box"), "cx", "cy")], [], 2 * bits
    while left:
        steps.append(min(step, left))
        found.append(parents(found[-1], steps[-1]))
        left -= steps[-1]
    return found[::-1], steps[::-1]


def renumbered(assigned: DataFrame, needed: DataFrame, column: str = "part_id") -> DataFrame:
    """Rows of the needed partitions, which are numbered anew without gaps, in order. `needed` has one row a
    partition."""
    new = needed.select(column, (F.row_number().over(Window.orderBy(column)) - 1).cast("long").alias("new"))
    return assigned.join(new, column).withColumn(column, F.col("new")).drop("new")


def distinct_bins(points: DataFrame, axis: str, width: float) -> DataFrame:
    """bins: how many bins of a width, from the least coordinate on, have points."""
    return axis_histogram(points, axis, width).agg(F.count("*").alias("bins"))


def summary(cells: DataFrame) -> DataFrame:
    """Of a histogram: number of points, most in a cell, cells, extents."""
    return cells.agg(F.sum("n").alias("n"), F.max("n").alias("max_cell"), F.count("*").alias("cells"), *[f(c).alias(c) for f, c in ((F.min, "min_x"), (F.max, "max_x"), (F.min, "min_y"), (F.max, "max_y"))])


def regrid(size: float, most: int, least_capacity: int) -> float:
    """A smaller cell size if the fullest cell has more points than a partition should: size over the
    rounded-up root of their ratio, never below a millionth of what it was."""
    rate = most / max(1, least_capacity)
    return max(size / -(-(rate**0.5) // 1), size * 1e-6) if rate > 1 else size


def assign_partitions(cells: DataFrame, least: int, most: int, ranges: int | None = None) -> DataFrame:
    """Cells in order of (cx, cy), dealt to partitions: a new one begins where the current one has `least`
    points or would exceed `most`.

    Where a partition that begins at a cell would end depends on prefix sums only, so an as-of join finds for every
    cell the one where the next partition would begin. Which cells really begin one is the chain of these from the first cell
    on, followed by doubling: known beginnings jump 1, 2, 4 ... partitions ahead, so the number of rounds is the
    logarithm of the number of partitions, each a join on whole cell numbers."""
    one = F.lit(1).cast("long")
    rows = save(prefix_sums(cells.select("cx", "cy", "n"), ["cx", "cy"], {"i": one, "before": F.col("n")}, ranges))
    points, count = rows.agg(F.sum("n"), F.count("*")).first()
    spark = cells.sparkSession
    # a partition from i on ends before the first cell with `least` points before it, and before the first that ends beyond `most`
    ends = F.explode(F.array(F.struct(F.lit(True).alias("full"), (F.col("before") + least).alias("reach")), F.struct(F.lit(False).alias("full"), (F.col("before") + most + 1).alias("reach"))))
    asked = rows.select("i", ends.alias("e")).select("i", "e.full", "e.reach")
    marks = rows.select(F.col("i").alias("j"), "before").unionByName(spark.createDataFrame([(count, points or 0)], "j long, before long"))
    met = asof_join(asked, marks, "reach", "before", forward=True, ranges=ranges).select("i", F.when(F.col("full"), F.col("match.j")).otherwise(F.col("match.j") - 1).alias("to"))
    jump = met.groupBy("i").agg(F.min("to").alias("to")).where("to IS NOT NULL").select("i", F.greatest("to", F.col("i") + 1).alias("to"))
    jump = save(jump.where(F.col("to") < count))
    begins = [save(rows.where("i = 0").select("i"))]
    while True:
        known = begins[0]
        for b in begins[1:]:
            known = known.unionByName(b)
        ahead = save(known.join(jump, "i").select(F.col("to").alias("i")))
        if ahead.isEmpty():
            break
        begins.append(ahead)
        jump = save(jump.join(jump.select(F.col("i").alias("to"), F.col("to").alias("further")), "to").select("i", F.col("further").alias("to")))
    marked = rows.join(known.withColumn("begins", one), "i", "left").withColumn("begins", F.coalesce("begins", F.lit(0).cast("long")))
    numbered = prefix_sums(marked.select("cx", "cy", "n", "begins"), ["cx", "cy"], {"part_id": F.col("begins")}, ranges)
    return numbered.select("cx", "cy", "n", (F.col("part_id") + F.col("begins") - 1).alias("part_id"))


def room(executors: int, cores: int, memory: int, max_bytes: int = 0) -> int:
    """Bytes of points that a partition may hold: 300 MB of an executor are set aside, then half of 0.6 x 0.5 of the rest is
    for the points of its cores."""
    per_core = int(-(-0.5 * (memory - 300_000_000) * 0.6 * 0.5 // cores))
    return per_core if max_bytes <= 0 else min(per_core, max_bytes)


def capacity(n: int, executors: int, cores: int, memory: int, point_bytes: int, max_bytes: int = 0) -> dict[str, int]:
    """How many points a partition holds, from executor memory (`room`): partitions are at least enough for all
    points and at most one fewer than a multiple of all cores."""
    fewest = max(1, -(-n * point_bytes // room(executors, cores, memory, max_bytes)))
    all_cores = executors * cores
    largest = max(fewest, -(-fewest // all_cores) * all_cores - 1)
    return {"min_partitions": fewest, "max_partitions": largest, "min_points": n // largest, "max_points": -(-n // fewest)}


def point_bytes(points: DataFrame, *payload: str, sample: float = 1.0, overhead: int = 24) -> int:
    """Bytes of a row on average, rounded up: what `overhead` says for id and coordinates, and the payload's text."""
    rows = points.sample(sample, seed=7) if sample < 1 else points
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in payload), F.lit(overhead))
    total, n = rows.agg(F.sum(width.cast("long")), F.count("*")).first()
    return -(-total // n) if n else overhead


def plan_layout(points: DataFrame, size: float, *, executors: int, cores: int, memory: int, payload: Sequence[str] = (), max_bytes: int = 0, sample: float = 1.0) -> dict:
    """A layout from what the table holds: `capacity` from the number of points and their measured width, and `grid_dim`,
    a finer cell size if the fullest cell has more points than the least partition should."""
    cells = histogram(points, size)
    n, fullest = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    plan = capacity(n, executors, cores, memory, point_bytes(points, *payload, sample=sample), max_bytes)
    return plan | {"fullest": fullest, "grid_dim": regrid(size, fullest, plan["min_points"])}


def planned_partitions(points: DataFrame, size: float, **resources) -> DataFrame:
    """cx, cy, n, part_id: cells of the planned size, dealt to partitions of the planned capacity."""
    plan = plan_layout(points, size, **resources)
    return assign_partitions(histogram(points, plan["grid_dim"]), max(1, plan["min_points"]), max(1, plan["max_points"]))


def refined(points: DataFrame, size: float, most: int, levels: int = 8) -> DataFrame:
    """level, cx, cy, n and extents: cells of `size`, of which those with more than `most` points are cut into cells of half the size,
    and so on for at most `levels` levels. Only the points of overfull cells are counted again."""
    rows, done = points.select("x", "y"), None
    for level in range(levels + 1):
        own = save(histogram(rows, size / 2**level))
        over = F.col("n") > most if level < levels else F.lit(False)
        kept = own.where(~over).withColumn("level", F.lit(level))
        done = kept if done is None else done.unionByName(kept)
        full = own.where(over).select("cx", "cy")
        if level == levels or full.isEmpty():
            break
        rows = with_cells(rows, size / 2**level).join(full, ["cx", "cy"], "left_semi").select("x", "y")
    return done


def estimate_nodes(n: Column, index: str) -> Column:
    """Nodes of an index over n points with 4 points a node."""
    if index == "quadtree":
        return F.ceil((n - 4) / 7 * 4 + 1)
    height = F.floor(F.lit(1.44) * F.log2(F.floor(n / 4)))
    return F.when(height <= 1, 1).otherwise(F.pow(F.lit(2.0), height + 1).cast("long") - 4 + 1)
