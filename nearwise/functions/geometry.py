"""Points, rectangles and circles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dist2(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance, as products of differences: rounding is the same wherever it is compared."""
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def dist(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(dist2(x1, y1, x2, y2))


def rect(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return F.struct(min_x.alias("min_x"), min_y.alias("min_y"), max_x.alias("max_x"), max_y.alias("max_y"))


def rect_around(x: Column, y: Column, half_x: Column, half_y: Column | None = None) -> Column:
    """Edges from a centre and half extents; a square if there is one."""
    half_y = half_x if half_y is None else half_y
    return rect(x - half_x, y - half_y, x + half_x, y + half_y)


def rect_contains(r: Column, x: Column, y: Column) -> Column:
    """Points on an edge are inside."""
    return x.between(r.min_x, r.max_x) & y.between(r.min_y, r.max_y)


def rect_intersects(a: Column, b: Column) -> Column:
    """Touching counts."""
    return (a.min_x <= b.max_x) & (b.min_x <= a.max_x) & (a.min_y <= b.max_y) & (b.min_y <= a.max_y)


def rect_merge(a: Column, b: Column) -> Column:
    return rect(F.least(a.min_x, b.min_x), F.least(a.min_y, b.min_y), F.greatest(a.max_x, b.max_x), F.greatest(a.max_y, b.max_y))


def circle_edges(x: Column, y: Column, radius: Column) -> Column:
    """The circle's square."""
    return rect_around(x, y, radius)


def circle_contains_rect(x: Column, y: Column, radius: Column, r: Column) -> Column:
    """Whether the rectangle lies within the circle's square and touches none of its edges."""
    c = circle_edges(x, y, radius)
    return (r.min_x > c.min_x) & (r.max_x < c.max_x) & (r.min_y > c.min_y) & (r.max_y < c.max_y)


def circle_intersects_rect(x: Column, y: Column, radius: Column, r: Column) -> Column:
    """Whether the rectangle meets the circle's square; touching counts."""
    return rect_intersects(circle_edges(x, y, radius), r)


def quadrant(x: Column, y: Column, centre_x: Column, centre_y: Column) -> Column:
    """0 left bottom, 1 left top, 2 right bottom, 3 right top; the centre's lines are left and bottom."""
    return F.when(x <= centre_x, 0).otherwise(2) + F.when(y <= centre_y, 0).otherwise(1)


def rect_gap2(a: Column, b: Column) -> Column:
    """Squared least distance of two rectangles."""
    zero = F.lit(0.0)
    dx = F.greatest(zero, a.min_x - b.max_x, b.min_x - a.max_x)
    dy = F.greatest(zero, a.min_y - b.max_y, b.min_y - a.max_y)
    return dx * dx + dy * dy


def rect_reach2(a: Column, b: Column) -> Column:
    """Squared greatest distance of a point of one from a point of the other."""
    dx = F.greatest(a.max_x - b.min_x, b.max_x - a.min_x)
    dy = F.greatest(a.max_y - b.min_y, b.max_y - a.min_y)
    return dx * dx + dy * dy


def format_point(x: Column, y: Column, payload: Column | None = None) -> Column:
    parts = F.format_string("(%.10f,%.10f", x, y)
    return F.concat(parts, F.lit(")")) if payload is None else F.concat(parts, F.lit(","), F.coalesce(payload.cast("string"), F.lit("")), F.lit(")"))


def format_circle(x: Column, y: Column, radius: Column) -> Column:
    return F.format_string("%,.8f,%,.8f,%,.8f", x, y, radius)


def format_mbr(r: Column, part: Column) -> Column:
    """Whole edges and the partition, with thousands marked, between tabs."""
    return F.format_string("%,d\t%,d\t%,d\t%,d\t%,d", *[r[c].cast("long") for c in ("min_x", "min_y", "max_x", "max_y")], part)
