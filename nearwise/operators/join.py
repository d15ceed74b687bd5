"""The k-nearest-neighbour join and its relatives.

What is asked are the distinct places of the left rows; every left row then gets its place's list, so
repeated rows, ids that repeat and rows without an id all have their own. Small inputs are compared
directly. Otherwise each side is laid out by its own points: the left into cells of about LEFT_CELL places,
the right into a tree. Cells look for right nodes from the root down: each level replaces the kept nodes by
their children (an equi-join), takes as bound the least reach within which the nodes hold k points, and
drops the nodes whose gap is beyond it. A cell that still meets more than SPREAD nodes is too wide for the
right side's density there, as where the sides lie apart; it stops, and its places go on down by themselves. At
the leaves all places have a bound of their own. Places then meet points by equi-joins on leaves, a point
beyond its place's bound is dropped at once, and the k nearest are kept by rank, which Spark limits before
its exchange. Bounds use true extents, so the result is exact; ties go to the smaller right id.

Of a place on the right where more rows lie than an asker can take, only the least ids are kept, so a place with
half of all rows costs its neighbours k pairs each. Where a row's own id is left out and that id repeats on the right,
the place asks together with its id: nodes count without the id's points, so the bounds are no wider than those of
other places, and nodes with nothing else are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearwise.functions.geometry import dist2, rect, rect_gap2, rect_reach2
from nearwise.plans.tables import save

from .layout import Layout, layout, nodes, parents

#: Pairs up to which points are compared directly, and right rows up to which those are broadcast for it.
DIRECT_PAIRS, DIRECT_ROWS = 1_000_000, 200_000
#: Right points a leaf; places a left cell; nodes a cell may meet; bits a step down.
PER_LEAF, LEFT_CELL, SPREAD, STEP = 32, 64, 16, 3
#: Bytes of a point (id, x, y) that the byte limit of a leaf counts with.
POINT_BYTES = 24
INDEXES = ("quadtree", "kdtree", "brute")
#: Places from which on what they meet is counted and dealt by its number: about TASK_PAIRS pairs (some 90 MB to sort) a task.
MANY_PLACES, TASK_PAIRS = 50_000, 1 << 20
#: Rows of each side that meet in a tile of `equal_pairs`; few enough for a sort-merge join to hold them in memory.
TILE = 2048
#: Tiles a task, from which on tiles grow with the pairs instead of their number, and the most sides of `tile` that one then has.
TASK_TILES, WIDEST = 8, 32


def as_points(df: DataFrame, on: tuple[str, str, str] = ("id", "x", "y")) -> DataFrame:
    """id, x, y of the rows with finite coordinates."""
    rows = df.select(F.col(on[0]).alias("id"), F.col(on[1]).cast("double").alias("x"), F.col(on[2]).cast("double").alias("y"))
    finite = [F.col(c).isNotNull() & (F.abs(F.col(c)) < F.lit(float("inf"))) for c in ("x", "y")]
    return rows.where(finite[0] & finite[1])


def _right(points: DataFrame) -> DataFrame:
    return points.select(F.col("id").alias("right_id"), F.col("x").alias("right_x"), F.col("y").alias("right_y"))


def _d2() -> Column:
    return dist2(F.col("px"), F.col("py"), F.col("right_x"), F.col("right_y")).alias("d2")


def _limited(points: DataFrame, wanted: int, apart: bool = False) -> tuple[DataFrame, int]:
    """The points without those of a place that no asker for `wanted` can take, and their number: beyond the least ids, or
    with `apart`, when askers leave out one id each, beyond the least ids of which none has more than `wanted`. Places are
    counted first; where none has more, nothing is exchanged for it."""
    upto = 2 * wanted if apart else wanted
    most, n = points.groupBy("x", "y").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (most or 0) <= upto:
        return points, n or 0
    for place, least in ((["x", "y", "id"], wanted), (["x", "y"], upto)) if apart else ((["x", "y"], upto),):
        points = points.withColumn("at", F.row_number().over(Window.partitionBy(*place).orderBy("id"))).where(F.col("at") <= least).drop("at")
    points = save(points)
    return points, points.count()


def _pruned(pairs: DataFrame, asker: Sequence[str], box: Column, k: int, own: DataFrame | None = None) -> DataFrame:
    """Pairs of an asker with nodes (node, n, node_box) -> those that may hold one of its k nearest, with
    `bound`. `own` (node, me, mine) has how many of a node's points bear the asker's id `me`, which do not count."""
    if own is not None:
        pairs = pairs.join(own, ["node", "me"], "left").withColumn("n", F.col("n") - F.coalesce("mine", F.lit(0))).where(F.col("n") > 0).drop("mine")
    own = Window.partitionBy(*asker)
    pairs = pairs.withColumns({"gap": rect_gap2(box, F.col("node_box")), "reach": rect_reach2(box, F.col("node_box"))})
    pairs = pairs.withColumn("held", F.sum("n").over(own.orderBy("reach")))
    bound = F.min(F.when(F.col("held") >= k, F.col("reach"))).over(own)
    pairs = pairs.withColumn("bound", F.coalesce(bound, F.lit(float("inf")))).where(F.col("gap") <= F.col("bound"))
    return pairs.drop("gap", "reach", "held")


def _level(table: DataFrame, bits: int) -> DataFrame:
    """A level's nodes (node, n, box) under their parents."""
    return table.select(F.shiftright("node", bits).alias("up"), "node", "n", F.col("box").alias("node_box"))


def _down(pairs: DataFrame, level: DataFrame, keep: Sequence[str]) -> DataFrame:
    return pairs.select(*keep, F.col("node").alias("up")).join(level, "up").drop("up")


def candidates(left_cells: DataFrame, right_levels: list[DataFrame], bits: list[int], k: int, spread: int | None = None, own: list[DataFrame] | None = None) -> list[DataFrame]:
    """Left cells (node, box) and the right side's levels, root first; `bits`: of each step down. For each
    level the pairs of left cells with the nodes (left_node, left_box, node, n, node_box, bound) that may hold one of
    a cell's points' k nearest, of the cells that stop there: with more than `spread` nodes, or at the leaves
    (the last level), where all do that are left. Without `spread` only the last level has pairs. With `own`, the levels'
    counts by id, cells have an id `me` whose points do not count."""
    cell = ["left_node", "me"] if own else ["left_node"]
    asks = left_cells.select(F.col("node").alias("left_node"), F.col("box").alias("left_box"), *cell[1:])
    pairs = asks.crossJoin(F.broadcast(right_levels[0].select("node", "n", F.col("box").alias("node_box"))))  # the root is one row
    stopped = []
    for depth, level in enumerate(right_levels):
        if depth:
            pairs = _down(pairs, _level(level, bits[depth - 1]), (*cell, "left_box"))
        pairs = _pruned(pairs, cell, F.col("left_box"), k, own[depth] if own else None)
        if spread is None or depth == len(right_levels) - 1:
            stopped.append(pairs)
            continue
        pairs = save(pairs.withColumn("met", F.count("*").over(Window.partitionBy(*cell))))
        stopped.append(pairs.where(F.col("met") > spread).drop("met"))
        pairs = pairs.where(F.col("met") <= spread).drop("met")
    return stopped


def leaf_size(n: int, points: DataFrame, k: int, per_leaf: int, grid_dim: float | None, max_bytes: int) -> int:
    """Points a leaf: `per_leaf`, or what a grid cell of size `grid_dim` holds on average if that is given, at
    most what `max_bytes` holds if that is positive; at least 1, and k where it is greater."""
    if grid_dim is not None:
        if not grid_dim > 0:
            raise ValueError("grid_dim must be positive")
        wide = points.agg((F.max("x") - F.min("x")).alias("x"), (F.max("y") - F.min("y")).alias("y")).first()
        cells = max(1.0, (wide["x"] or 0.0) / grid_dim) * max(1.0, (wide["y"] or 0.0) / grid_dim)
        per_leaf = int(min(max(n / cells, 8.0), 4096.0))
    if max_bytes > 0:
        per_leaf = min(per_leaf, max_bytes // POINT_BYTES)
    return max(per_leaf, k, 1)


@dataclass
class RightIndex:
    """Points (id, x, y, path) and the levels of nodes above them, root first; `bits`: of each step down."""

    points: DataFrame
    plane: Layout
    levels: list[DataFrame]
    bits: list[int]


def levels_of(leaves: DataFrame, depth: int) -> tuple[list[DataFrame], list[int]]:
    """Of a written table of leaves (node, n, box): levels and bits, root first."""
    levels, bits = [leaves], []
    while depth:
        bits.append(min(STEP, depth))
        levels.append(parents(levels[-1], bits[-1]))
        depth -= bits[-1]
    return levels[::-1], bits[::-1]


def right_index(right: DataFrame, kind: str, n_right: int, per_leaf: int) -> RightIndex:
    plane = layout(right, kind, n_right, per_leaf)
    right = save(right.select("id", "x", "y", plane.path(F.col("x"), F.col("y")).alias("path")))  # read several times, placed once
    return RightIndex(right, plane, *levels_of(save(nodes(right, plane.depth)), plane.depth))


def meetings(places: DataFrame, index: RightIndex, k: int, n_places: int) -> DataFrame:
    """px, py, bound and the right points (right_id, right_x, right_y) of the leaves that may hold one of the
    place's k nearest: what the cell join compares. Places with an id `me` ask for points with other ids."""
    who = ["px", "py", "me"] if "me" in places.columns else ["px", "py"]
    right, levels, bits, mine = index.points, index.levels, index.bits, None
    if "me" in who:
        asked = places.select(F.col("me").alias("id")).distinct()
        mine = [save(right.join(asked, "id").groupBy(F.col("path").alias("node"), F.col("id").alias("me")).agg(F.count("*").alias("mine")))]
        for step in bits[::-1]:
            mine.append(mine[-1].groupBy(F.shiftright("node", step).alias("node"), "me").agg(F.sum("mine").alias("mine")))
        mine = mine[::-1]
    cut = layout(places.select(F.col("px").alias("x"), F.col("py").alias("y")), "kdtree", n_places, LEFT_CELL)
    asks = save(places.withColumn("left_node", cut.path(F.col("px"), F.col("py"))))
    cells = asks.groupBy(F.col("left_node").alias("node"), *who[2:]).agg(rect(F.min("px"), F.min("py"), F.max("px"), F.max("py")).alias("box"))
    found = None
    for depth, stopped in enumerate(candidates(cells, levels, bits, k, SPREAD, mine)):
        if depth < len(levels) - 1 and stopped.isEmpty():
            continue
        point = rect(F.col("px"), F.col("py"), F.col("px"), F.col("py"))
        pairs = asks.join(stopped.drop("left_box", "bound"), ["left_node", *who[2:]]).drop("left_node")  # whose counts are without `me`
        pairs = _pruned(pairs, who, point, k)
        for below in range(depth + 1, len(levels)):
            pairs = _pruned(_down(pairs, _level(levels[below], bits[below - 1]), who), who, point, k, mine[below] if mine else None)
        pairs = pairs.select(*who, "node", "n", "bound")
        found = pairs if found is None else found.unionByName(pairs)
    points = right.select(F.col("path").alias("right_node"), F.col("id").alias("right_id"), F.col("x").alias("right_x"), F.col("y").alias("right_y"))
    if n_places <= MANY_PLACES:
        met = found.drop("n").join(points, F.col("node") == F.col("right_node"))
    else:
        # an exchange sized by its bytes would give a task all pairs that grow out of few bytes
        found = save(found)
        n_pairs = found.agg(F.sum("n")).first()[0] or 0
        met = equal_pairs(found.drop("n"), points, "node", "right_node", parts=-(-n_pairs // TASK_PAIRS))
    met = met.drop("node", "right_node")
    return met.where(_not_own()) if mine else met


def _not_own() -> Column:
    return ~F.col("right_id").eqNullSafe(F.col("me"))


def _lists(places: DataFrame, r: DataFrame, built: RightIndex | None, wanted: int, who: list[str], index: str, grid_dim: float | None, max_bytes: int, direct_pairs: int, per_leaf: int) -> DataFrame:
    """The askers `who` with `list`, their `wanted` nearest right points in order."""
    r, n_right = _limited(r, wanted, len(who) > 2)  # a node's count beyond what is kept there changes no bound
    if index == "brute" and n_right > DIRECT_ROWS:
        raise ValueError(f"brute force takes at most {DIRECT_ROWS} right rows")
    places = save(places)
    n_places = places.count()
    if built is not None:
        pairs = meetings(places, replace(built, points=r), wanted, n_places).withColumn("d2", _d2()).where(F.col("d2") <= F.col("bound"))
    elif n_right <= DIRECT_ROWS and (index == "brute" or n_right * n_places <= direct_pairs):
        pairs = places.crossJoin(F.broadcast(_right(r))).withColumn("d2", _d2())
        pairs = pairs.where(_not_own()) if len(who) > 2 else pairs
    else:
        size = leaf_size(n_right, r, wanted, per_leaf, grid_dim, max_bytes)
        pairs = meetings(places, right_index(r, index, n_right, size), wanted, n_places).withColumn("d2", _d2()).where(F.col("d2") <= F.col("bound"))
    near = Window.partitionBy(*who).orderBy("d2", "right_id")
    top = pairs.select(*who, "d2", "right_id", "right_x", "right_y").withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= wanted)
    one = F.struct("rank", F.sqrt("d2").alias("distance"), F.col("right_id").alias("id"), F.col("right_x").alias("x"), F.col("right_y").alias("y"))
    lists = top.groupBy(*who).agg(F.array_sort(F.collect_list(one)).alias("ranked"))  # `wanted` at most
    return lists.select(*who, F.transform("ranked", lambda n: F.struct(n.distance.alias("distance"), n.id.alias("id"), n.x.alias("x"), n.y.alias("y"))).alias("list"))


def knn_join(
    left: DataFrame, right: DataFrame | RightIndex, k: int, *, left_on=("id", "x", "y"), right_on=("id", "x", "y"), index: str = "kdtree", grid_dim: float | None = None,
    partition_max_bytes: int = 0, exclude_self: bool = False, output: str = "nested", direct_pairs: int = DIRECT_PAIRS, per_leaf: int = PER_LEAF,
) -> DataFrame:
    """For every left row the k nearest right rows: all left columns and `neighbors`, an array of (distance,
    id, x, y) in order (output "nested"), or left_id, rank, right_id, distance ("exploded").

    Every left row has its own result, whether its id is null or repeats; right rows at one place, or with one
    id, are separate neighbours, and a null right id comes first among equals. With `exclude_self` right rows
    with the left row's id are left out. Left rows without finite coordinates, or when right has none, keep an
    empty list; such right rows are left out. `index` chooses how cells are laid out, never the result; nor do
    `grid_dim` and `partition_max_bytes`, from which the leaves' size follows (`leaf_size`). "brute" compares all
    pairs and is refused beyond DIRECT_ROWS right rows. A `RightIndex` (as of `stored.Stored.open`) is used as it is laid out."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if index not in INDEXES:
        raise ValueError(f"index must be one of {INDEXES}")
    built = right if isinstance(right, RightIndex) else None
    r = built.points if built else as_points(right, right_on)
    rows = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"), *[F.col(f"`{c}`").alias(a) for c, a in zip(left_on, ("left_id", "left_x", "left_y"), strict=True)])
    asking = [(rows, k)]
    if exclude_self:
        # an id that the right side has once costs one neighbour more; one that repeats there asks for itself
        repeated = save(r.where(F.col("id").isNotNull()).groupBy("id").count().where("count > 1").select(F.col("id").alias("twin")))
        asking = [(rows.join(repeated, F.col("left_id") == F.col("twin"), "left_anti"), k + 1)]
        if not repeated.isEmpty():
            asking.append((rows.join(repeated, F.col("left_id") == F.col("twin"), "left_semi"), k))
    done = None
    for at, (some, wanted) in enumerate(asking):
        who = ["px", "py", "me"] if at else ["px", "py"]
        places = as_points(some, ("left_id", "left_x", "left_y")).select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("id").alias("me"))
        lists = _lists(places.select(*who).distinct(), r, built, wanted, who, index, grid_dim, partition_max_bytes, direct_pairs, per_leaf)
        same = (F.col("left_x").cast("double") == F.col("px")) & (F.col("left_y").cast("double") == F.col("py"))
        found = F.coalesce("list", F.array().cast(lists.schema["list"].dataType))
        if exclude_self and not at:
            found = F.slice(F.filter(found, lambda n: ~n.id.eqNullSafe(F.col("left_id")) | n.id.isNull()), 1, k)
        some = some.join(lists, same & (F.col("left_id") == F.col("me")) if at else same, "left").select("row", "left_id", found.alias("found"))
        done = some if done is None else done.unionByName(some)
    rows = done
    if output == "exploded":
        rows = rows.select("left_id", F.posexplode("found").alias("at", "one"))
        return rows.select("left_id", (F.col("at") + 1).alias("rank"), F.col("one.id").alias("right_id"), F.col("one.distance").alias("distance"))
    return rows.select("row.*", F.col("found").alias("neighbors"))


def all_knn_join(left: DataFrame, right: DataFrame, k: int, **options) -> DataFrame:
    """Both directions: direction "left" (left rows' neighbours) or "right", left_id being the asking row's."""
    options["output"] = "exploded"
    swapped = options | {"left_on": options.get("right_on", ("id", "x", "y")), "right_on": options.get("left_on", ("id", "x", "y"))}
    one, two = knn_join(left, right, k, **options), knn_join(right, left, k, **swapped)
    return one.withColumn("direction", F.lit("left")).unionByName(two.withColumn("direction", F.lit("right")))


def knn_view(spark: SparkSession, name: str, left: str, right: str, k: int, **options) -> None:
    """A temporary view for SQL with the neighbours of two tables or views, one row each unless `output` says else."""
    options.setdefault("output", "exploded")
    knn_join(spark.table(left), spark.table(right), k, **options).createOrReplaceTempView(name)


def knn_point_query(points: DataFrame, x: float, y: float, k: int) -> DataFrame:
    """rank, right_id, distance of the k points nearest to one."""
    if k < 1:
        raise ValueError("k must be at least 1")
    d2 = dist2(F.col("x"), F.col("y"), F.lit(float(x)), F.lit(float(y)))
    near = as_points(points).select(F.col("id").alias("right_id"), d2.alias("d2")).orderBy("d2", "right_id").limit(k)
    return near.select(F.row_number().over(Window.orderBy("d2", "right_id")).alias("rank"), "right_id", F.sqrt("d2").alias("distance"))


def topk_per_group(df: DataFrame, group: str, order: list[Column | str], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def find_exact(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, match_id: the smallest right id at exactly the same place, or null."""
    first = as_points(right).groupBy("x", "y").agg(F.min("id").alias("match_id"))
    return as_points(left).join(first, ["x", "y"], "left").select("id", "match_id")


def range_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """left_id, right_id, distance of all pairs within `radius`: each left point meets the right points of
    its own and the eight neighbouring cells, whose size is the radius. Cells with many points are cut into tiles."""
    if not radius > 0:
        raise ValueError("radius must be positive")
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius)))
    around = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    l = as_points(left).withColumn("i", F.explode(around)).withColumn("j", F.explode(around))
    l = l.select(F.col("id").alias("left_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.struct((cell("x") + F.col("i")).alias("cx"), (cell("y") + F.col("j")).alias("cy")).alias("left_cell"))
    r = as_points(right).select(F.col("id").alias("right_id"), F.col("x").alias("right_x"), F.col("y").alias("right_y"), F.struct(cell("x").alias("cx"), cell("y").alias("cy")).alias("right_cell"))
    # the few cells that both sides have are cut by their pairs; an exchange sized by its bytes would leave all pairs to one task
    d = equal_pairs(l, r, "left_cell", "right_cell").select("left_id", "right_id", F.sqrt(_d2()).alias("distance"))
    return d.where(F.col("distance") <= F.lit(float(radius)))


def equal_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tile: int | None = None, *, parts: int = 0, near: tuple[Sequence[str], Sequence[str]] = ((), ())) -> DataFrame:
    """All columns of both sides (which share no name) for every pair of equal keys. A key with many pairs is cut into
    tiles of about `tile` rows a side, each a group of its own to the exchange, so the tasks grow with the pairs, not
    with the number of keys. Null keys meet nothing. There are at least `parts` tasks. A row goes to every tile of the other side's
    cuts, so with tiles of one size what is exchanged would grow with the pairs; where there are more than TASK_TILES tiles a task, tiles
    are wider instead (up to WIDEST times `tile` a side), and the exchange grows with the rows.

    `near` names columns of each side: rows equal in them share a tile, unless they alone are more than a tile, and lie beside each
    other there. Of what is made from these columns equal values then come in runs, which files store once."""
    size, sides, n = tile or TILE, [], max(2, parts, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for rows, key in ((left, left_key), (right, right_key)):
        sides.append(rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("tile_key")).agg(F.count("*").alias("n")))
    cuts = save(sides[0].withColumnRenamed("n", "left_n").join(sides[1].withColumnRenamed("n", "right_n"), "tile_key"))
    n_pairs = cuts.agg(F.sum(F.col("left_n").cast("double") * F.col("right_n"))).first()[0] or 0.0
    size = max(size, min(int((n_pairs / (n * TASK_TILES)) ** 0.5), size * WIDEST))
    cuts = cuts.select("tile_key", F.ceil(F.col("left_n") / size).alias("left_cuts"), F.ceil(F.col("right_n") / size).alias("right_cuts"))
    dealt = []
    for rows, key, name, own, other, by in ((left, left_key, "left_tile", "left_cuts", "right_cuts", near[0]), (right, right_key, "right_tile", "right_cuts", "left_cuts", near[1])):
        columns, spread = rows.columns, F.xxhash64(*rows.columns)
        if by:
            often = rows.groupBy(key, *by).count().where(F.col("count") > size).select(*[F.col(c).alias(f"often{i}") for i, c in enumerate((key, *by))])
            rows = rows.join(often, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"often{i}")) for i, c in enumerate((key, *by))]), "left")
            spread = F.when(F.col("often0").isNull(), F.xxhash64(*by)).otherwise(spread)
        mine, each = F.pmod(spread, F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        met = rows.join(cuts, F.col(key) == F.col("tile_key")).select(*columns, "right_cuts", mine.alias("mine"), each.alias("each"))
        i, j = ("mine", "each") if name == "left_tile" else ("each", "mine")
        tile_of = F.xxhash64(key).bitwiseXOR(F.col(i) * F.col("right_cuts") + F.col(j))
        met = met.select(*columns, tile_of.alias(name)).repartition(n, name)
        if by:
            # the join keeps the order of a window by tile; a plain sort below a join is taken out
            beside = Window.partitionBy(name).orderBy(*by, *[c for c in columns if c not in by])
            met = met.withColumn(f"{name}_at", F.row_number().over(beside)).where(F.col(f"{name}_at") > 0)
        dealt.append(met)
    # tiles of one key differ; those of others may fall together. As an equality this would be a key of the exchange too
    same = F.col(left_key).between(F.col(right_key), F.col(right_key))
    return dealt[0].join(dealt[1], (F.col("left_tile") == F.col("right_tile")) & same).drop("left_tile", "right_tile", "left_tile_at", "right_tile_at")


def neighbor_accessors(neighbors: DataFrame, at: int, upto: int) -> DataFrame:
    """Of nested results with column id: number, first and last distance, id at a place, the list cut short."""
    n = F.col("neighbors")
    return neighbors.select(
        F.col("id").alias("left_id"), F.size(n).alias("n"), F.try_element_at(n, F.lit(1)).distance.alias("first_distance"), F.try_element_at(n, F.lit(-1)).distance.alias("last_distance"),
        F.try_element_at(n, F.lit(at)).id.alias("id_at"), F.size(F.slice(n, 1, upto)).alias("n_cut"),
    )
