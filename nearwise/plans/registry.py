"""Every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearwise.functions import geometry as g
from nearwise.functions import helpers as h
from nearwise.operators import approximate, grid, index, join, overlaps, ranges, sketches, stored
from nearwise.plans import tables
from nearwise.sources import curve
from nearwise.sources import points as text
from nearwise.streaming import recent

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Views of points over the tables: id, x, y.
VIEWS = {
    "sup": ("supplier", "s_suppkey", "s_acctbal", "CAST(s_nationkey AS DOUBLE) * CAST(400 AS DOUBLE)"),
    "cus": ("customer", "c_custkey", "c_acctbal", "CAST(c_nationkey AS DOUBLE) * CAST(400 AS DOUBLE)"),
    "prt": ("part", "p_partkey", "CAST(p_size AS DOUBLE) * CAST(2 AS DOUBLE)", "p_retailprice"),
    "rep": ("customer", "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 7 END", "CAST(c_nationkey % 5 AS DOUBLE) * CAST(1500 AS DOUBLE)", "CAST(c_nationkey AS DOUBLE) * CAST(300 AS DOUBLE)"),
    "hot": ("part", "p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN CAST(3000 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) * CAST(200 AS DOUBLE) END", "CASE WHEN p_partkey % 2 = 0 THEN CAST(4000 AS DOUBLE) ELSE p_retailprice * CAST(5 AS DOUBLE) END"),
    "trj": ("part", "CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 40 END", "CAST(p_size AS DOUBLE) * CAST(2 AS DOUBLE)", "p_retailprice"),
    "nat": ("nation", "CAST(n_nationkey AS BIGINT)", "CAST(n_nationkey AS DOUBLE) * CAST(300 AS DOUBLE)", "CAST(n_regionkey AS DOUBLE) * CAST(2000 AS DOUBLE)"),
    "emb": ("embeddings", "vec_id", "CAST(embedding[{0}] AS DOUBLE)", "CAST(embedding[{1}] AS DOUBLE)"),
}


def points(spark: SparkSession, sf_dir: str, name: str, *more: str) -> DataFrame:
    file, id_, x, y = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{file}.parquet").selectExpr(f"{id_} AS id", f"{x.format(0, 1)} AS x", f"{y.format(0, 1)} AS y", *more)


def with_views(sql: str, first: str = "") -> str:
    """DuckDB counts list elements from 1."""
    used = [f"{n} AS (SELECT {i} AS id, {x.format(1, 2)} AS x, {y.format(1, 2)} AS y FROM {t})" for n, (t, i, x, y) in VIEWS.items() if n in sql + first]
    tables = ", ".join([*used, *([first] if first else [])])
    return f"WITH {tables} {sql}" if tables else sql


def query(name: str, sql: str | None = None, first: str = ""):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql, first)
        return f

    return add


def knn_sql(left: str, right: str, k: int, extra: str = "", where: str = "TRUE") -> str:
    return f"""
SELECT {extra}left_id, rank, right_id, distance FROM (
  SELECT left_id, right_id, sqrt(d2) AS distance, CAST(row_number() OVER (PARTITION BY left_id ORDER BY d2, right_id) AS INTEGER) AS rank
  FROM (SELECT l.id AS left_id, r.id AS right_id, (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) AS d2 FROM {left} l, {right} r WHERE {where}))
WHERE rank <= {k}"""


def _knn(name: str, left: str, right: str, k: int, **options) -> None:
    where = "l.id <> r.id" if options.get("exclude_self") else "TRUE"
    query(name, knn_sql(left, right, k, where=where))(lambda s, d: join.knn_join(points(s, d, left), points(s, d, right), k, output="exploded", **options))


_knn("knn_join", "sup", "cus", 10)
_knn("knn_join_cells", "cus", "prt", 10, direct_pairs=0)
_knn("knn_join_quadtree", "sup", "cus", 10, index="quadtree", direct_pairs=0)
_knn("knn_join_kdtree", "sup", "cus", 10, index="kdtree", direct_pairs=0)
_knn("knn_join_k1", "cus", "sup", 1)
_knn("knn_join_exploded", "emb", "emb", 5, direct_pairs=0)
_knn("knn_join_short", "cus", "nat", 40)
_knn("knn_self_join", "prt", "prt", 4, direct_pairs=0)
_knn("knn_self_join_others", "prt", "prt", 4, direct_pairs=0, exclude_self=True)


_knn("knn_join_hot", "cus", "hot", 10, direct_pairs=0)


@query(
    "knn_self_join_tracks",
    """SELECT left_id, rank, right_id, distance FROM (
  SELECT left_id, right_id, sqrt(d2) AS distance, CAST(row_number() OVER (PARTITION BY i ORDER BY d2, right_id) AS INTEGER) AS rank
  FROM (SELECT i, l.id AS left_id, r.id AS right_id, (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) AS d2 FROM (SELECT *, row_number() OVER () AS i FROM trj) l JOIN trj r ON l.id <> r.id))
WHERE rank <= 4""",
)
def _(s, d):
    """Points of tracks, whose ids repeat, among those of other tracks; a third of all rows are one track's."""
    return join.knn_join(points(s, d, "trj"), points(s, d, "trj"), 4, output="exploded", direct_pairs=0, exclude_self=True)


def _updated(s, d):
    """An index of customers, of which some go, others move and suppliers come, opened anew."""
    at, cus = tables.work_dir(s), points(s, d, "cus")
    made = stored.Stored.create(cus, at)
    made.delete(cus.where("id % 7 = 0"))
    made.insert(points(s, d, "sup").withColumn("id", F.col("id") + 10_000_000))
    moved = cus.where("id % 50 = 1")
    made.delete(moved)
    made.insert(moved.withColumn("x", F.col("x") + 1000))
    return stored.Stored.open(s, at)


_UPDATED = """u AS (
  SELECT id, CASE WHEN id % 50 = 1 THEN x + 1000 ELSE x END AS x, y FROM cus WHERE id % 7 <> 0 OR id % 50 = 1
  UNION ALL SELECT id + 10000000, x, y FROM sup)"""
query("knn_after_updates", knn_sql("prt", "u", 5) + " /* cus sup */", _UPDATED)(lambda s, d: join.knn_join(points(s, d, "prt"), _updated(s, d).index(), 5, output="exploded"))
query("points_after_updates", "SELECT id, x, y FROM u /* cus sup */", _UPDATED)(lambda s, d: _updated(s, d).points().select("id", "x", "y"))


@query("knn_approximate_recall", "SELECT CAST(count(*) AS BIGINT) * 10 AS n, TRUE AS recalled FROM prt")
def _(s, d):
    """How many neighbours the exact join finds, and whether the approximate one finds nine in ten of them, by distance."""
    l, r = points(s, d, "prt"), points(s, d, "cus")
    exact = join.knn_join(l, r, 10, output="exploded").groupBy("left_id").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
    near = approximate.approximate_knn_join(l, r, 10).select(F.col("left_id").alias("who"), "distance")
    hits = exact.join(near, (F.col("left_id") == F.col("who")) & (F.col("distance") <= F.col("far")), "left").groupBy("left_id", "n").agg(F.count("who").alias("hits"))
    return hits.agg(F.sum("n").alias("n"), (F.sum("hits") >= 0.9 * F.sum("n")).alias("recalled"))


@query(
    "knn_join_repeats",
    """SELECT coalesce(left_id, -1) AS left_id, rank, right_id, distance FROM (
  SELECT left_id, right_id, sqrt(d2) AS distance, CAST(row_number() OVER (PARTITION BY i ORDER BY d2, right_id) AS INTEGER) AS rank
  FROM (SELECT i, l.id AS left_id, r.id AS right_id, (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) AS d2 FROM (SELECT *, row_number() OVER () AS i FROM rep) l, sup r))
WHERE rank <= 6""",
)
def _(s, d):
    """Left ids repeat and are null, and so are places."""
    found = join.knn_join(points(s, d, "rep"), points(s, d, "sup"), 6, output="exploded", direct_pairs=0)
    return found.withColumn("left_id", F.coalesce("left_id", F.lit(-1)))


@query("all_knn_join", f"SELECT * FROM ({knn_sql('sup', 'cus', 5, extra=chr(39) + 'left' + chr(39) + ' AS direction, ')} UNION ALL {knn_sql('cus', 'sup', 5, extra=chr(39) + 'right' + chr(39) + ' AS direction, ')})")
def _(s, d):
    return join.all_knn_join(points(s, d, "sup"), points(s, d, "cus"), 5)


@query("knn_point_query", "SELECT CAST(row_number() OVER (ORDER BY d2, right_id) AS INTEGER) AS rank, right_id, sqrt(d2) AS distance FROM (SELECT id AS right_id, (x - 4000.0::DOUBLE) * (x - 4000.0::DOUBLE) + (y - 4100.0::DOUBLE) * (y - 4100.0::DOUBLE) AS d2 FROM cus) ORDER BY d2, right_id LIMIT 10")
def _(s, d):
    return join.knn_point_query(points(s, d, "cus"), 4000, 4100, 10)


def _on_curve(s, d):
    """The folder of all part and customer points, in files along the curve."""
    at = tables.work_dir(s)
    curve.write_curve(points(s, d, "cus").unionByName(points(s, d, "prt").withColumn("id", -F.col("id"))), at)
    return at


_CURVE = "c AS (SELECT id, x, y FROM cus UNION ALL SELECT -id, x, y FROM prt)"
query("curve_box", "SELECT id, x, y FROM c WHERE x BETWEEN 20 AND 2000 AND y BETWEEN 800 AND 1600 /* cus prt */", _CURVE)(lambda s, d: curve.read_box(s, _on_curve(s, d), 20, 800, 2000, 1600))
query(
    "curve_nearest",
    "SELECT CAST(row_number() OVER (ORDER BY d2, right_id) AS INTEGER) AS rank, right_id, sqrt(d2) AS distance FROM (SELECT id AS right_id, (x - 60.0::DOUBLE) * (x - 60.0::DOUBLE) + (y - 1100.0::DOUBLE) * (y - 1100.0::DOUBLE) AS d2 FROM c) ORDER BY d2, right_id LIMIT 25 /* cus prt */",
    _CURVE,
)(lambda s, d: curve.nearest(s, _on_curve(s, d), 60, 1100, 25))


@query("topk_per_group", "SELECT * FROM (SELECT l_suppkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_quantity) AS INTEGER) AS rank, l_extendedprice, l_orderkey, l_linenumber FROM lineitem) WHERE rank <= 3")
def _(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return join.topk_per_group(rows, "l_suppkey", ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], 3).select("l_suppkey", "rank", "l_extendedprice", "l_orderkey", "l_linenumber")


@query(
    "neighbor_accessors",
    "SELECT left_id, CAST(count(*) AS INTEGER) AS n, min(distance) AS first_distance, max(distance) AS last_distance, max(CASE WHEN rank = 3 THEN right_id END) AS id_at, CAST(least(count(*), 4) AS INTEGER) AS n_cut FROM k GROUP BY left_id",
    first=f"k AS ({with_views(knn_sql('sup', 'cus', 10))})",
)
def _(s, d):
    return join.neighbor_accessors(join.knn_join(points(s, d, "sup"), points(s, d, "cus"), 10), 3, 4)


@query("find_exact", "SELECT l.id, min(r.id) AS match_id FROM prt l LEFT JOIN prt r ON l.x = r.x AND l.y = r.y GROUP BY l.id")
def _(s, d):
    return join.find_exact(points(s, d, "prt"), points(s, d, "prt"))


@query("range_join", "SELECT * FROM (SELECT l.id AS left_id, r.id AS right_id, sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) AS distance FROM sup l, cus r) WHERE distance <= 250")
def _(s, d):
    return join.range_join(points(s, d, "sup"), points(s, d, "cus"), 250)


_PAIRS = "sup l JOIN cus r ON l.y = r.y"


@query("distance_pairs", f"SELECT l.id AS left_id, r.id AS right_id, (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) AS d2, sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) AS d FROM {_PAIRS}")
def _(s, d):
    l, r = points(s, d, "sup").toDF("left_id", "lx", "ly"), points(s, d, "cus").toDF("right_id", "rx", "ry")
    both = join.equal_pairs(l, r, "ly", "ry", near=(("lx",), ("rx",)))
    at = [F.col(c) for c in ("lx", "ly", "rx", "ry")]
    return both.select("left_id", "right_id", g.dist2(*at).alias("d2"), g.dist(*at).alias("d"))


# -- grid ---------------------------------------------------------------------------------------------------


def cell_sql(v: str, size: float) -> str:
    q = f"({v} / {float(size)}::DOUBLE)"
    return f"CAST(CASE WHEN {q} < trunc({q}) + 0.5 THEN trunc({q}) ELSE ceil({q}) END AS BIGINT)"


def cells_sql(view: str, size: float = 100) -> str:
    return f"(SELECT *, {cell_sql('x', size)} AS cx, {cell_sql('y', size)} AS cy FROM {view})"


def histogram_sql(view: str, size: float = 100) -> str:
    return f"(SELECT cx, cy, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM {cells_sql(view, size)} GROUP BY cx, cy)"


def _cells(s, d, view="cus", size=100):
    return grid.histogram(points(s, d, view), size)


query("grid_assign", f"SELECT id, cx, cy FROM {cells_sql('cus')}")(lambda s, d: grid.with_cells(points(s, d, "cus"), 100).select("id", "cx", "cy"))
query("grid_histogram", f"SELECT * FROM {histogram_sql('cus')}")(_cells)
_SUMMARY = "SELECT CAST(sum(n) AS BIGINT) AS n, max(n) AS max_cell, count(*) AS cells, min(min_x) AS min_x, max(max_x) AS max_x, min(min_y) AS min_y, max(max_y) AS max_y FROM "
query("right_summary", _SUMMARY + histogram_sql("cus"))(lambda s, d: grid.summary(_cells(s, d)))
query("left_summary", _SUMMARY + histogram_sql("sup"))(lambda s, d: grid.summary(_cells(s, d, "sup")))
query("left_cells_distinct", f"SELECT DISTINCT cx, cy FROM {cells_sql('sup')}")(lambda s, d: grid.with_cells(points(s, d, "sup"), 100).select("cx", "cy").distinct())
query("cells_ordered", f"SELECT cx, cy, n FROM {histogram_sql('sup')} ORDER BY cx, cy")(lambda s, d: _cells(s, d, "sup").select("cx", "cy", "n").orderBy("cx", "cy"))
query("regrid", f"SELECT cx, cy, n FROM {histogram_sql('cus', 25)}")(lambda s, d: _cells(s, d, size=grid.regrid(100, 160, 10)).select("cx", "cy", "n"))

def _parts_sql(size: float, least: int, most: int) -> str:
    new = f"p.held >= {least} OR p.held + o.n > {most}"
    return f"""
o AS (SELECT cx, cy, n, row_number() OVER (ORDER BY cx, cy) AS i FROM {histogram_sql('cus', size)}),
part_cells AS (
  SELECT i, cx, cy, n, CAST(0 AS BIGINT) AS part_id, CAST(n AS BIGINT) AS held FROM o WHERE i = 1
  UNION ALL
  SELECT o.i, o.cx, o.cy, o.n, p.part_id + CASE WHEN {new} THEN 1 ELSE 0 END, CASE WHEN {new} THEN o.n ELSE p.held + o.n END
  FROM part_cells p JOIN o ON o.i = p.i + 1)"""


_PARTS = _parts_sql(100, 60, 90)


def _parts(s, d):
    return grid.assign_partitions(_cells(s, d), 60, 90)


def _parts_query(name: str, sql: str, f: Query) -> None:
    QUERIES[name] = f
    cus = with_views("cus").split("WITH ")[1].rsplit(" cus", 1)[0]
    SQL[name] = f"WITH RECURSIVE {cus}, {_PARTS.strip()} {sql}"


_parts_query("partition_assign", "SELECT cx, cy, n, part_id FROM part_cells", _parts)


def _part_mbrs(s, d):
    return _parts(s, d).groupBy("part_id").agg(F.min("cx").alias("min_x"), F.min("cy").alias("min_y"), F.max("cx").alias("max_x"), F.max("cy").alias("max_y"), F.sum("n").alias("n"))


_MBRS = "SELECT part_id, min(cx) AS min_x, min(cy) AS min_y, max(cx) AS max_x, max(cy) AS max_y, CAST(sum(n) AS BIGINT) AS n FROM part_cells GROUP BY part_id"
_parts_query("partition_mbrs", _MBRS, _part_mbrs)
_parts_query(
    "mbr_format", f"SELECT part_id, format('{{:,}}\t{{:,}}\t{{:,}}\t{{:,}}\t{{:,}}', min_x, min_y, max_x, max_y, part_id) AS text FROM ({_MBRS})",
    lambda s, d: _part_mbrs(s, d).select("part_id", g.format_mbr(F.struct("min_x", "min_y", "max_x", "max_y"), F.col("part_id")).alias("text")),
)
_parts_query(
    "right_partition_assign", f"SELECT c.id, p.part_id FROM {cells_sql('cus')} c JOIN part_cells p USING (cx, cy)",
    lambda s, d: grid.with_cells(points(s, d, "cus"), 100).join(_parts(s, d), ["cx", "cy"]).select("id", "part_id"),
)

# -- candidates ---------------------------------------------------------------------------------------------

_CANDIDATES = f"""
lc AS (SELECT * FROM {histogram_sql('sup', 1000)}), rc AS (SELECT * FROM {histogram_sql('cus', 1000)}),
p AS (
  SELECT lc.cx AS left_cx, lc.cy AS left_cy, rc.cx, rc.cy, rc.n,
         greatest(0, lc.min_x - rc.max_x, rc.min_x - lc.max_x) * greatest(0, lc.min_x - rc.max_x, rc.min_x - lc.max_x)
         + greatest(0, lc.min_y - rc.max_y, rc.min_y - lc.max_y) * greatest(0, lc.min_y - rc.max_y, rc.min_y - lc.max_y) AS gap,
         greatest(lc.max_x - rc.min_x, rc.max_x - lc.min_x) * greatest(lc.max_x - rc.min_x, rc.max_x - lc.min_x)
         + greatest(lc.max_y - rc.min_y, rc.max_y - lc.min_y) * greatest(lc.max_y - rc.min_y, rc.max_y - lc.min_y) AS reach FROM lc, rc),
q AS (SELECT *, sum(n) OVER (PARTITION BY left_cx, left_cy ORDER BY reach) AS held FROM p),
b AS (SELECT *, min(CASE WHEN held >= 10 THEN reach END) OVER (PARTITION BY left_cx, left_cy) AS bound FROM q),
cand AS (SELECT left_cx, left_cy, cx, cy, n, gap, part_id FROM b JOIN part_cells USING (cx, cy, n) WHERE gap <= coalesce(bound, 'inf'::DOUBLE))"""


def _coarse_parts(s, d):
    return grid.assign_partitions(_cells(s, d, size=1000), 60, 90)


def _candidates(s, d):
    """left_cx, left_cy, cx, cy, n, gap, found from the root of the right side's levels down."""
    found, steps = grid.levels(_cells(s, d, size=1000))
    l = _cells(s, d, "sup", 1000).select(F.struct("cx", "cy").alias("node"), g.rect(*map(F.col, ("min_x", "min_y", "max_x", "max_y"))).alias("box"))
    pairs = join.candidates(l, [t.select("node", "n", "box") for t in found], steps, 10)[-1]
    pairs = pairs.join(found[-1].select("node", "cx", "cy"), "node")
    return pairs.select(F.col("left_node.cx").alias("left_cx"), F.col("left_node.cy").alias("left_cy"), "cx", "cy", "n", g.rect_gap2(F.col("left_box"), F.col("node_box")).alias("gap"))


def _candidate_parts(s, d):
    return _candidates(s, d).join(_coarse_parts(s, d).select("cx", "cy", "part_id"), ["cx", "cy"])


def _needed(s, d):
    pairs = _candidate_parts(s, d).select("left_cx", "left_cy", "part_id").distinct()
    return pairs.groupBy("part_id").agg(F.count("*").alias("left_cells"))


def _candidate_query(name: str, sql: str, f: Query) -> None:
    QUERIES[name] = f
    views = with_views("sup cus").split("WITH ")[1].rsplit(" sup cus", 1)[0]
    SQL[name] = f"WITH RECURSIVE {views}, {_parts_sql(1000, 60, 90).strip()}, {_CANDIDATES.strip()} {sql}"


_candidate_query("candidate_cells", "SELECT left_cx, left_cy, cx, cy, n, gap FROM cand", _candidates)
_candidate_query(
    "candidate_partitions", "SELECT left_cx, left_cy, part_id, min(gap) AS gap FROM cand GROUP BY ALL",
    lambda s, d: _candidate_parts(s, d).groupBy("left_cx", "left_cy", "part_id").agg(F.min("gap").alias("gap")),
)
_candidate_query("needed_partitions", "SELECT part_id, count(*) AS left_cells FROM (SELECT DISTINCT left_cx, left_cy, part_id FROM cand) GROUP BY part_id", _needed)
_candidate_query(
    "right_partition_pruned",
    f"SELECT c.id, k.new AS part_id FROM {cells_sql('cus', 1000)} c JOIN part_cells p USING (cx, cy) JOIN (SELECT part_id, row_number() OVER (ORDER BY part_id) - 1 AS new FROM (SELECT DISTINCT part_id FROM cand)) k ON k.part_id = p.part_id",
    lambda s, d: grid.renumbered(grid.with_cells(points(s, d, "cus"), 1000).join(_coarse_parts(s, d), ["cx", "cy"]).select("id", "part_id"), _needed(s, d)),
)

# -- geometry -----------------------------------------------------------------------------------------------

_BY_NATION = "nb AS (SELECT CAST(c_nationkey AS BIGINT) AS nk, min(c_acctbal) AS min_x, min(c_custkey * 1.0::DOUBLE) AS min_y, max(c_acctbal) AS max_x, max(c_custkey * 1.0::DOUBLE) AS max_y FROM customer GROUP BY 1)"


def _nation_boxes(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    x, y = F.col("c_acctbal"), F.col("c_custkey").cast("double")
    return c.groupBy(F.col("c_nationkey").cast("long").alias("nk")).agg(g.rect(F.min(x), F.min(y), F.max(x), F.max(y)).alias("r"))


def _edges(r, prefix=""):
    return [r[c].alias(prefix + c) for c in ("min_x", "min_y", "max_x", "max_y")]


query("mbr_merge", "SELECT * FROM nb", _BY_NATION)(lambda s, d: _nation_boxes(s, d).select("nk", *_edges(F.col("r"))))
query("mbr_expand", "SELECT nk, min_x - 5 AS min_x, min_y - 5 AS min_y, max_x + 5 AS max_x, max_y + 5 AS max_y FROM nb", _BY_NATION)(
    lambda s, d: _nation_boxes(s, d).select("nk", (F.col("r.min_x") - 5).alias("min_x"), (F.col("r.min_y") - 5).alias("min_y"), (F.col("r.max_x") + 5).alias("max_x"), (F.col("r.max_y") + 5).alias("max_y"))
)
_TWO = "FROM nb a JOIN nb b ON b.nk = a.nk + 1"


def _two(s, d):
    a, b = _nation_boxes(s, d).toDF("nk", "a"), _nation_boxes(s, d).toDF("nk2", "b")
    return a.join(b, F.col("nk2") == F.col("nk") + 1)


query("rect_merge", f"SELECT a.nk, least(a.min_x, b.min_x) AS min_x, least(a.min_y, b.min_y) AS min_y, greatest(a.max_x, b.max_x) AS max_x, greatest(a.max_y, b.max_y) AS max_y {_TWO}", _BY_NATION)(lambda s, d: _two(s, d).select("nk", *_edges(g.rect_merge(F.col("a"), F.col("b")))))
query("rect_intersects", f"SELECT a.nk, NOT (a.min_x > b.max_x OR a.max_x < b.min_x OR a.min_y > b.max_y OR a.max_y < b.min_y) AS hit {_TWO}", _BY_NATION)(lambda s, d: _two(s, d).select("nk", g.rect_intersects(F.col("a"), F.col("b")).alias("hit")))
_box = lambda: g.rect(F.lit(0.0), F.lit(1200.0), F.lit(5000.0), F.lit(4000.0))
query("rect_contains", "SELECT id, x BETWEEN 0 AND 5000 AND y BETWEEN 1200 AND 4000 AS inside FROM cus")(lambda s, d: points(s, d, "cus").select("id", g.rect_contains(_box(), F.col("x"), F.col("y")).alias("inside")))
query("rect_edges", "SELECT id, x - 50 AS min_x, y - 25 AS min_y, x + 50 AS max_x, y + 25 AS max_y FROM cus")(lambda s, d: points(s, d, "cus").select("id", *_edges(g.rect_around(F.col("x"), F.col("y"), F.lit(50.0), F.lit(25.0)))))
query("circle_edges", "SELECT id, x - 75 AS min_x, y - 75 AS min_y, x + 75 AS max_x, y + 75 AS max_y FROM sup")(lambda s, d: points(s, d, "sup").select("id", *_edges(g.circle_edges(F.col("x"), F.col("y"), F.lit(75.0)))))


def _circles(s, d, test):
    return points(s, d, "sup").crossJoin(F.broadcast(_nation_boxes(s, d))).select("id", "nk", test(F.col("x"), F.col("y"), F.lit(6000.0), F.col("r")).alias("hit"))


query("circle_contains_rect", "SELECT id, nk, min_x > x - 6000 AND max_x < x + 6000 AND min_y > y - 6000 AND max_y < y + 6000 AS hit FROM sup, nb", _BY_NATION)(lambda s, d: _circles(s, d, g.circle_contains_rect))
query("circle_intersects_rect", "SELECT id, nk, min_x <= x + 6000 AND max_x >= x - 6000 AND min_y <= y + 6000 AND max_y >= y - 6000 AS hit FROM sup, nb", _BY_NATION)(lambda s, d: _circles(s, d, g.circle_intersects_rect))
query("circle_format", "SELECT id, format('{:,.8f},{:,.8f},{:,.8f}', x, y, 75.5::DOUBLE) AS text FROM sup")(lambda s, d: points(s, d, "sup").select("id", g.format_circle(F.col("x"), F.col("y"), F.lit(75.5)).alias("text")))
query("quadrant", "SELECT id, CASE WHEN x <= 4500 THEN CASE WHEN y <= 4800 THEN 0 ELSE 1 END ELSE CASE WHEN y <= 4800 THEN 2 ELSE 3 END END AS quadrant FROM cus")(lambda s, d: points(s, d, "cus").select("id", g.quadrant(F.col("x"), F.col("y"), F.lit(4500.0), F.lit(4800.0)).alias("quadrant")))

# -- index tables -------------------------------------------------------------------------------------------

_EXT = "count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y"
query(
    "quad_levels",
    f"""SELECT level, ix // (8 // (2 ** level)::BIGINT) AS ix, iy // (8 // (2 ** level)::BIGINT) AS iy, {_EXT} FROM q, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS level) GROUP BY 1, 2, 3""",
    "q AS (SELECT x, y, CAST(least(floor((x - lx) / ((hx - lx) / 8.0::DOUBLE)), 7) AS BIGINT) AS ix, CAST(least(floor((y - ly) / ((hy - ly) / 8.0::DOUBLE)), 7) AS BIGINT) AS iy FROM cus, (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM cus))",
)(lambda s, d: index.quad_levels(points(s, d, "cus"), 3))


def _kd_sql(depth: int) -> str:
    out = "k0 AS (SELECT id, x, y, CAST(1 AS BIGINT) AS node FROM cus)"
    for n in range(depth):
        a, b = ("x", "y") if n % 2 == 0 else ("y", "x")
        out += f", k{n + 1} AS (SELECT id, x, y, node * 2 + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY {a}, {b}, id) > (count(*) OVER (PARTITION BY node)) // 2 THEN 1 ELSE 0 END AS node FROM k{n})"
    return out


query(
    "kd_split",
    " UNION ALL ".join(
        f"SELECT node // 2 AS node, count(*) AS n, count(*) FILTER (node % 2 = 0) AS left_n, CASE WHEN max({a}) FILTER (node % 2 = 0) <> min({a}) FILTER (node % 2 = 1) THEN max({a}) FILTER (node % 2 = 0) END AS split FROM k{n + 1} GROUP BY 1" for n, a in enumerate("xyx")
    )
    + " /* cus */",
    _kd_sql(3),
)(lambda s, d: index.kd_split(points(s, d, "cus"), 3))
query("kd_leaf_extents", f"SELECT node, {_EXT} FROM k3 GROUP BY node /* cus */", _kd_sql(3))(lambda s, d: index.kd_leaf_extents(points(s, d, "cus"), 3))
query("axis_histogram", "SELECT CAST(floor((x - low) / 500.0::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM cus, (SELECT min(x) AS low FROM cus) GROUP BY 1")(lambda s, d: index.axis_histogram(points(s, d, "cus"), "x", 500))

query("axis_bins_distinct", "SELECT count(DISTINCT floor((y - low) / 500.0::DOUBLE)) AS bins FROM cus, (SELECT min(y) AS low FROM cus)")(lambda s, d: grid.distinct_bins(points(s, d, "cus"), "y", 500))

_GROWS = 1.01 / 0.99
_ESTIMATE = f"round(CAST(sign(x) AS DOUBLE) * pow({_GROWS!r}::DOUBLE, floor(ln(abs(x)) / {math.log(_GROWS)!r}::DOUBLE)) * 1.01::DOUBLE, 6)"


@query(
    "cell_quantiles",
    f"""SELECT level, cx, cy, max(n) AS n, max(CASE WHEN i = greatest(1, ceil(0.5::DOUBLE * n)) THEN e END) AS median, max(CASE WHEN i = greatest(1, ceil(0.99::DOUBLE * n)) THEN e END) AS high
FROM (SELECT *, row_number() OVER (PARTITION BY level, cx, cy ORDER BY v) AS i, count(*) OVER (PARTITION BY level, cx, cy) AS n FROM (
  SELECT level, CAST(floor(floor(x / 1000.0::DOUBLE) / (2 ** level)) AS BIGINT) AS cx, CAST(floor(floor(y / 1000.0::DOUBLE) / (2 ** level)) AS BIGINT) AS cy, x AS v, CASE WHEN x = 0 THEN 0 ELSE {_ESTIMATE} END AS e
  FROM cus, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS level))) GROUP BY level, cx, cy""",
)
def _(s, d):
    """Median and 99th percentile of balances by cell and level, 1 % off at most."""
    found = sketches.cell_estimates(sketches.cell_sketches(points(s, d, "cus"), 1000, 3, value="x"), (0.5, 0.99))
    return found.select("level", "cx", "cy", "n", F.round(F.get("quantiles", 0), 6).alias("median"), F.round(F.get("quantiles", 1), 6).alias("high"))


# -- time ---------------------------------------------------------------------------------------------------

_AT = {"asks_on": ("event_id", "value", "y", "ts"), "points_on": ("event_id", "value", "y", "ts")}
#: For each error the three nearest clicks of the six hours before it: by value and user, no further than 60.
_RECENT = {"within": 6 * 3600, "radius": 60}


def _recent_sql(clock: str, due: str) -> str:
    return f"""
WITH e AS (SELECT event_id AS id, event_type, value AS x, CAST(user_id AS DOUBLE) * CAST(3 AS DOUBLE) AS y, epoch_us(ts) AS t FROM events WHERE event_type IN ('error', 'click')),
m AS ({clock}),
p AS (SELECT a.id AS left_id, c.id AS right_id, (a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) AS d2
  FROM e a JOIN e c ON c.t <= a.t AND c.t > a.t - 21600000000, m WHERE a.event_type = 'error' AND c.event_type = 'click' AND {due})
SELECT left_id, rank, right_id, sqrt(d2) AS distance
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY left_id ORDER BY d2, right_id) AS INTEGER) AS rank FROM p WHERE d2 <= 3600) WHERE rank <= 3"""


def _events(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = rows.withColumn("y", F.col("user_id").cast("double") * 3)
    return rows.where("event_type = 'error'"), rows.where("event_type = 'click'")


@query("knn_recent", _recent_sql("SELECT 0 AS now", "TRUE"))
def _(s, d):
    return recent.knn_recent(*_events(s.read.parquet(f"{d}/events.parquet")), 3, **_RECENT, **_AT).drop("asked_at")


@query("knn_recent_stream", _recent_sql("SELECT max(t) // 1000 * 1000 AS now FROM e", "(a.t // 600000000 + 1) * 600000000 <= m.now"))
def _(s, d):
    """The same from streams, as far as their end has passed the asks' ten minutes."""
    at, here = tables.work_dir(s), f"{d}/events.parquet"
    schema, before = s.read.parquet(here).schema, s.conf.get(recent.PROVIDER)
    # a pattern, because a stream reads no path of a single file
    sides = [_events(s.readStream.schema(schema).parquet(f"{here}*"))[i] for i in (0, 1)]
    s.conf.set(recent.PROVIDER, recent.ROCKS)
    try:
        found = recent.stream_knn_recent(*sides, 3, lambda df, n: df.write.mode("overwrite").parquet(f"{at}/found/batch={n}"), tick=600, **_RECENT, **_AT)
        found.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        s.conf.set(recent.PROVIDER, before)
    given = "left_id long, asked_at timestamp, rank int, right_id long, distance double"
    s.createDataFrame([], given).write.mode("append").parquet(f"{at}/found/batch=-1")
    return s.read.schema(given).parquet(f"{at}/found").drop("batch", "asked_at")


# -- planning, text and helpers -----------------------------------------------------------------------------


#: For 4 executors of 5 cores and 4 GB: a core's share of memory, and partitions from it.
_ROOM = "CAST(ceil(0.5::DOUBLE * (4000000000 - 300000000) * 0.6::DOUBLE * 0.5::DOUBLE / 5) AS BIGINT)"


def _plan_sql(width: str, view: str = "cus", room: str = _ROOM) -> str:
    return f"""
w AS (SELECT count(*) AS n, greatest(1, (count(*) * {width} + {room} - 1) // {room}) AS fewest FROM {view}),
plan AS (SELECT *, n // max_partitions AS min_points, (n + min_partitions - 1) // min_partitions AS max_points FROM (
  SELECT n, CAST(fewest AS BIGINT) AS min_partitions, CAST(greatest(fewest, (fewest + 19) // 20 * 20 - 1) AS BIGINT) AS max_partitions FROM w))"""


@query("plan_capacity", "SELECT min_partitions, max_partitions, min_points, max_points FROM plan /* cus */", _plan_sql("200").strip())
def _(s, d):
    plan = grid.capacity(points(s, d, "cus").count(), executors=4, cores=5, memory=4_000_000_000, point_bytes=200)
    return s.createDataFrame([plan], "min_partitions long, max_partitions long, min_points long, max_points long")


query(
    "estimate_nodes",
    "SELECT CAST(ceil((n - 4) / 7.0::DOUBLE * 4 + 1) AS BIGINT) AS quadtree, CASE WHEN floor(1.44::DOUBLE * log2(n // 4)) <= 1 THEN 1 ELSE CAST(2 ** (floor(1.44::DOUBLE * log2(n // 4)) + 1) AS BIGINT) - 3 END AS kdtree FROM (SELECT count(*) AS n FROM cus)",
)(lambda s, d: points(s, d, "cus").agg(F.count("*").alias("n")).select(grid.estimate_nodes(F.col("n"), "quadtree").alias("quadtree"), grid.estimate_nodes(F.col("n"), "kdtree").cast("long").alias("kdtree")))
query("point_format", "SELECT id, printf('(%.10f,%.10f)', x, y) AS text FROM cus")(lambda s, d: points(s, d, "cus").select("id", g.format_point(F.col("x"), F.col("y")).alias("text")))


@query("read_points", "SELECT trunc(x) AS x, trunc(y) AS y, CAST(x AS VARCHAR) || ' ' || CAST(y AS VARCHAR) AS user_data FROM cus")
def _(s, d):
    """Through a file: written as text, read as points."""
    at = tables.work_dir(s)
    points(s, d, "cus").select(F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string")).alias("value")).write.text(at)
    return text.read_points(s, at)


@query("format_results", f"SELECT CAST(left_id AS VARCHAR) || ';' || string_agg(printf('%.8f', distance) || ',' || right_id, ';' ORDER BY rank) AS value FROM ({knn_sql('sup', 'cus', 3)}) GROUP BY left_id")
def _(s, d):
    """Through a file: written as gzip text, read as lines."""
    at = tables.work_dir(s)
    text.write_results(text.format_results(join.knn_join(points(s, d, "sup"), points(s, d, "cus"), 3), F.col("id")), at)
    return s.read.text(at)


def _helper(name: str, file: str, key: str, spark_column, sql: str) -> None:
    query(f"helper_{name}", f"SELECT {key} AS id, {sql} AS value FROM {file}")(lambda s, d: s.read.parquet(f"{d}/{file}.parquet").select(F.col(key).alias("id"), spark_column().alias("value")))


_bal = lambda: F.col("c_acctbal")
_helper("round", "customer", "c_custkey", lambda: grid.cell(_bal(), 1), cell_sql("c_acctbal", 1))
_helper("ceil_str", "customer", "c_custkey", lambda: h.ceil_text(_bal().cast("decimal(12,2)").cast("string")), "CAST(floor(CAST(c_acctbal AS DECIMAL(12,2))) AS BIGINT) + CASE WHEN substr(split_part(CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR), '.', 2), 1, 1) = '0' THEN 0 ELSE 1 END")
_helper("abs_diff", "part", "p_partkey", lambda: h.abs_diff(F.col("p_retailprice"), F.col("p_size").cast("double")), "abs(p_retailprice - CAST(p_size AS DOUBLE))")
_helper("min_max", "part", "p_partkey", lambda: h.larger(F.col("p_size"), F.lit(20)) - h.smaller(F.col("p_size"), F.lit(20)), "greatest(p_size, 20) - least(p_size, 20)")
_helper("log", "part", "p_partkey", lambda: F.round(h.log_base(F.col("p_retailprice"), F.lit(2.0)), 9), "round(ln(p_retailprice) / ln(2.0::DOUBLE), 9)")
_helper("sorted_contains", "part", "p_partkey", lambda: h.in_sorted(F.array(*map(F.lit, (3, 7, 21, 40))), F.col("p_size")), "list_contains([3, 7, 21, 40], p_size)")
_helper("bool_str", "orders", "o_orderkey", lambda: F.concat(h.truth_text(F.col("o_orderstatus") == "F"), h.truth_text(h.is_truth_text(F.col("o_orderpriority")))), "CASE WHEN o_orderstatus = 'F' THEN 'T' ELSE 'F' END || CASE WHEN upper(substr(o_orderpriority, 1, 1)) IN ('T', 'Y') THEN 'T' ELSE 'F' END")
_helper("null_or_empty", "customer", "c_custkey", lambda: h.null_or_empty(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("")), "c_mktsegment = 'BUILDING' OR c_mktsegment = ''")
_helper("floor_str", "customer", "c_custkey", lambda: h.before_point(_bal().cast("decimal(12,2)").cast("string")), "split_part(CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR), '.', 1)")
_helper("nth_index", "customer", "c_custkey", lambda: h.nth_index(F.col("c_name"), "0", 2), "CASE WHEN instr(c_name, '0') = 0 OR instr(substr(c_name, instr(c_name, '0') + 1), '0') = 0 THEN -1 ELSE instr(c_name, '0') + instr(substr(c_name, instr(c_name, '0') + 1), '0') - 1 END::INTEGER")
_helper("to_byte", "part", "p_partkey", lambda: h.bytes_of(F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("K", "mb", "G", ""))), F.col("p_size") % 4 + 1))), "CAST(p_size AS BIGINT) * [1000, 1000000, 1000000000, 1][p_size % 4 + 1]")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
