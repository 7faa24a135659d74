"""Rectangles: structs of min_x, min_y, max_x, max_y; null is the empty rectangle.

All functions build Columns, so the optimiser sees plain comparisons and can push
them into Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Slack per axis within which rectangles count as adjacent.
ADJACENT_EPS = 1e-9


def _c(m: Column | str) -> Column:
    return F.col(m) if isinstance(m, str) else m


def mbr(min_x, min_y, max_x, max_y) -> Column:
    names = ("min_x", "min_y", "max_x", "max_y")
    cells = [(x if isinstance(x, Column) else F.lit(float(x))).cast("double").alias(n) for n, x in zip(names, (min_x, min_y, max_x, max_y))]
    return F.struct(*cells)


def point(x, y) -> Column:
    cells = [(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in (("x", x), ("y", y))]
    return F.struct(*cells)


def empty() -> Column:
    return F.lit(None).cast("struct<min_x:double,min_y:double,max_x:double,max_y:double>")


def is_empty(m) -> Column:
    m = _c(m)
    return m.isNull() | F.coalesce((m["min_x"] > m["max_x"]) | (m["min_y"] > m["max_y"]), F.lit(True))


def overlaps_box(m, box: tuple[float, float, float, float]) -> Column:
    """Closed overlap with a constant box, as four bare comparisons that scans can use.

    An inverted box is empty and meets nothing.
    """
    x0, y0, x1, y1 = map(float, box)
    if not (x0 <= x1 and y0 <= y1):
        return F.lit(False)
    m = _c(m)
    return (m["min_x"] <= x1) & (m["max_x"] >= x0) & (m["min_y"] <= y1) & (m["max_y"] >= y0)


def intersects(a, b) -> Column:
    """Closed overlap; false if either is empty."""
    a, b = _c(a), _c(b)
    touch = (a["min_x"] <= b["max_x"]) & (a["max_x"] >= b["min_x"]) & (a["min_y"] <= b["max_y"]) & (a["max_y"] >= b["min_y"])
    return ~is_empty(a) & ~is_empty(b) & F.coalesce(touch, F.lit(False))


def contains_point(m, x, y) -> Column:
    m = _c(m)
    x, y = (v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y))
    return (m["min_x"] <= x) & (m["max_x"] >= x) & (m["min_y"] <= y) & (m["max_y"] >= y)


def contains_mbr(a, b) -> Column:
    a, b = _c(a), _c(b)
    inside = (a["min_x"] <= b["min_x"]) & (a["max_x"] >= b["max_x"]) & (a["min_y"] <= b["min_y"]) & (a["max_y"] >= b["max_y"])
    return ~is_empty(a) & ~is_empty(b) & F.coalesce(inside, F.lit(False))


def adjacent(a, b, eps: float = ADJACENT_EPS) -> Column:
    """Overlap with a slack of ``eps`` on each axis."""
    a, b = _c(a), _c(b)
    e = F.lit(eps)
    return (a["min_x"] <= b["max_x"] + e) & (a["max_x"] >= b["min_x"] - e) & (a["min_y"] <= b["max_y"] + e) & (a["max_y"] >= b["min_y"] - e)


def adjacent_box(m, box: tuple[float, float, float, float], eps: float = ADJACENT_EPS) -> Column:
    x0, y0, x1, y1 = map(float, box)
    m = _c(m)
    return (m["min_x"] <= x1 + eps) & (m["max_x"] >= x0 - eps) & (m["min_y"] <= y1 + eps) & (m["max_y"] >= y0 - eps)


def centroid(m) -> Column:
    """The middle; (0, 0) for an empty rectangle."""
    m = _c(m)
    gone = is_empty(m)
    return point(
        F.when(gone, F.lit(0.0)).otherwise((m["min_x"] + m["max_x"]) * 0.5),
        F.when(gone, F.lit(0.0)).otherwise((m["min_y"] + m["max_y"]) * 0.5),
    )


def area(m) -> Column:
    m = _c(m)
    return F.when(is_empty(m), F.lit(0.0)).otherwise((m["max_x"] - m["min_x"]) * (m["max_y"] - m["min_y"]))


def intersection(a, b) -> Column:
    """The common rectangle; null if there is none."""
    a, b = _c(a), _c(b)
    common = mbr(F.greatest(a["min_x"], b["min_x"]), F.greatest(a["min_y"], b["min_y"]), F.least(a["max_x"], b["max_x"]), F.least(a["max_y"], b["max_y"]))
    return F.when(intersects(a, b), common)


def union(a, b) -> Column:
    """The rectangle around both; an empty one adds nothing."""
    a, b = _c(a), _c(b)
    around = mbr(F.least(a["min_x"], b["min_x"]), F.least(a["min_y"], b["min_y"]), F.greatest(a["max_x"], b["max_x"]), F.greatest(a["max_y"], b["max_y"]))
    return F.when(is_empty(a), F.when(~is_empty(b), b)).when(is_empty(b), a).otherwise(around)


def expand_point(m, x, y) -> Column:
    return union(m, mbr(x, y, x, y))


def bounds_of(m) -> Column:
    """Aggregate: the rectangle around a column of rectangles; null without any."""
    m = _c(m)
    low = F.min(m["min_x"])
    return F.when(low.isNotNull(), mbr(low, F.min(m["min_y"]), F.max(m["max_x"]), F.max(m["max_y"])))


def quadrant(bounds, x, y) -> Column:
    """NW, NE, SW or SE of a rectangle's middle; the middle itself belongs to the east and north."""
    bounds = _c(bounds)
    mid_x, mid_y = (bounds["min_x"] + bounds["max_x"]) * 0.5, (bounds["min_y"] + bounds["max_y"]) * 0.5
    return F.concat(F.when(y < mid_y, F.lit("S")).otherwise(F.lit("N")), F.when(x < mid_x, F.lit("W")).otherwise(F.lit("E")))


def quadrant_bounds(bounds, name: str) -> Column:
    """The quarter of a rectangle by its name."""
    b = _c(bounds)
    mid_x, mid_y = (b["min_x"] + b["max_x"]) * 0.5, (b["min_y"] + b["max_y"]) * 0.5
    x = (b["min_x"], mid_x) if name[1] == "W" else (mid_x, b["max_x"])
    y = (b["min_y"], mid_y) if name[0] == "S" else (mid_y, b["max_y"])
    return mbr(x[0], y[0], x[1], y[1])


def quad_key(bounds: tuple[float, float, float, float], x: Column, y: Column, depth: int) -> Column:
    """Path of quadrants from the whole to the cell at ``depth``: 0 SW, 1 SE, 2 NW, 3 NE."""
    x0, y0, x1, y1 = map(float, bounds)
    side = 1 << depth
    cell = lambda v, lo, hi: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor((v - lo) / F.lit((hi - lo) or 1.0) * side))).cast("long")
    cx, cy = cell(x, x0, x1), cell(y, y0, y1)
    digits = [(F.getbit(cx, F.lit(b)).cast("int") + F.getbit(cy, F.lit(b)).cast("int") * 2).cast("string") for b in range(depth - 1, -1, -1)]
    return F.concat(*digits) if digits else F.lit("")
