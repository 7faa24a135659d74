"""Measures of points, lines and polygons as Columns over nested arrays.

Lines are arrays of points, polygons structs of an exterior ring and holes; rings may
repeat their first vertex at the end.  Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import LINE, MBR, POINT, POLYGON
from . import mbr as R

#: Lengths and areas below this are taken for zero.
TINY = 1e-10


def _c(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distance_sq(a, b) -> Column:
    a, b = _c(a), _c(b)
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return dx * dx + dy * dy


def distance(a, b) -> Column:
    return F.sqrt(distance_sq(a, b))


def point_equals(a, b, eps: float = TINY) -> Column:
    a, b = _c(a), _c(b)
    return (F.abs(a["x"] - b["x"]) < eps) & (F.abs(a["y"] - b["y"]) < eps)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _steps(line: Column) -> Column:
    """Consecutive pairs of vertices."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _turns(ring: Column) -> Column:
    """Consecutive pairs of vertices, the last with the first."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    ahead = F.concat(F.slice(ring, F.lit(2), n), F.slice(ring, 1, 1))
    return F.zip_with(ring, ahead, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def line_length(line) -> Column:
    """Sum of segment lengths; 0 for fewer than two vertices."""
    return _sum(F.transform(_steps(_c(line)), lambda s: distance(s["a"], s["b"])))


def line_centroid(line) -> Column:
    """Middle of segments weighted by length; the first vertex of a line without length."""
    line = _c(line)
    parts = F.transform(
        _steps(line),
        lambda s: F.struct(distance(s["a"], s["b"]).alias("w"), ((s["a"]["x"] + s["b"]["x"]) * 0.5).alias("x"), ((s["a"]["y"] + s["b"]["y"]) * 0.5).alias("y")),
    )
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    add = lambda t, p: F.struct((t["w"] + p["w"]).alias("w"), (t["x"] + p["x"] * p["w"]).alias("x"), (t["y"] + p["y"] * p["w"]).alias("y"))
    finish = lambda t: F.when(t["w"] >= TINY, R.point(F.try_divide(t["x"], t["w"]), F.try_divide(t["y"], t["w"])))
    return F.when(F.size(line) >= 1, F.coalesce(F.aggregate(parts, zero, add, finish), F.get(line, F.lit(0))))


def points_mbr(points) -> Column:
    """Rectangle around an array of points; null if there are none."""
    points = _c(points)
    pick = lambda axis: F.transform(points, lambda p: p[axis])
    box = R.mbr(F.array_min(pick("x")), F.array_min(pick("y")), F.array_max(pick("x")), F.array_max(pick("y")))
    return F.when(F.size(points) >= 1, box)


line_mbr = points_mbr


def ring_signed_area(ring) -> Column:
    """Shoelace area, positive counter-clockwise; 0 for fewer than three vertices."""
    ring = _c(ring)
    cross = F.transform(_turns(ring), lambda t: t["a"]["x"] * t["b"]["y"] - t["b"]["x"] * t["a"]["y"])
    return F.when(ring.isNotNull(), F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(_sum(cross) * 0.5))


def ring_centroid(ring) -> Column:
    """Centroid by area; the mean vertex of a ring without area; null without vertices."""
    ring = _c(ring)
    parts = F.transform(
        _turns(ring),
        lambda t: F.struct(
            (t["a"]["x"] * t["b"]["y"] - t["b"]["x"] * t["a"]["y"]).alias("c"),
            (t["a"]["x"] + t["b"]["x"]).alias("sx"),
            (t["a"]["y"] + t["b"]["y"]).alias("sy"),
            t["a"]["x"].alias("x"),
            t["a"]["y"].alias("y"),
        ),
    )
    names = ("c", "cx", "cy", "x", "y", "n")
    zero = F.struct(*[F.lit(0.0).alias(n) for n in names])
    add = lambda t, p: F.struct(
        (t["c"] + p["c"]).alias("c"), (t["cx"] + p["sx"] * p["c"]).alias("cx"), (t["cy"] + p["sy"] * p["c"]).alias("cy"),
        (t["x"] + p["x"]).alias("x"), (t["y"] + p["y"]).alias("y"), (t["n"] + 1.0).alias("n"),
    )
    # Sum of cross products is twice the area, so 6 * area is three times that sum.
    flat = lambda t: R.point(F.try_divide(t["x"], t["n"]), F.try_divide(t["y"], t["n"]))
    full = lambda t: R.point(F.try_divide(t["cx"], t["c"] * 3.0), F.try_divide(t["cy"], t["c"] * 3.0))
    finish = lambda t: F.when(F.abs(t["c"] * 0.5) < TINY, flat(t)).otherwise(full(t))
    return F.when(F.size(ring) >= 1, F.aggregate(parts, zero, add, finish))


def polygon_centroid(polygon) -> Column:
    """Centroid of the exterior; null for fewer than three vertices."""
    ring = _c(polygon)["exterior"]
    return F.when(F.size(ring) >= 3, ring_centroid(ring))


def polygon_mbr(polygon) -> Column:
    return points_mbr(_c(polygon)["exterior"])


def polygon_area(polygon) -> Column:
    """Area of the exterior less the areas of the holes, whatever their orientation."""
    p = _c(polygon)
    holes = F.transform(F.coalesce(p["holes"], F.array().cast(f"array<{LINE}>")), lambda h: F.abs(ring_signed_area(h)))
    return F.when(p["exterior"].isNotNull(), F.abs(ring_signed_area(p["exterior"])) - _sum(holes))


def polygon_is_clockwise(polygon) -> Column:
    return ring_signed_area(_c(polygon)["exterior"]) < 0


def line_add_point(line, p) -> Column:
    return F.array_append(_c(line), _c(p))


def polygon_add_hole(polygon, ring) -> Column:
    p = _c(polygon)
    return F.struct(p["exterior"].alias("exterior"), F.array_append(F.coalesce(p["holes"], F.array().cast(f"array<{LINE}>")), _c(ring)).alias("holes"))


def make_polygon(exterior, holes=None) -> Column:
    holes = F.array().cast(f"array<{LINE}>") if holes is None else _c(holes)
    return F.struct(_c(exterior).alias("exterior"), holes.alias("holes")).cast(POLYGON)


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def _all_finite(points: Column) -> Column:
    return F.forall(points, lambda p: p.isNotNull() & _finite(p["x"]) & _finite(p["y"]))


def geometry_is_valid(geom_type, point, line, polygon) -> Column:
    """Whether a geometry has enough finite vertices: 1, 1 and 3 by type."""
    ring = _c(polygon)["exterior"]
    found = (
        F.when(_c(geom_type) == "POINT", _finite(_c(point)["x"]) & _finite(_c(point)["y"]))
        .when(_c(geom_type) == "LINESTRING", (F.size(_c(line)) >= 1) & _all_finite(_c(line)))
        .when(_c(geom_type) == "POLYGON", (F.size(ring) >= 3) & _all_finite(ring))
    )
    return F.coalesce(found, F.lit(False))


def derive(df: DataFrame) -> DataFrame:
    """Adds centroid, mbr and is_valid; the first two are null for an invalid geometry."""
    p, kind = F.col("point"), F.col("geom_type")
    ok = df.withColumn("is_valid", geometry_is_valid("geom_type", "point", "line", "polygon"))
    centre = F.when(kind == "POINT", p).when(kind == "LINESTRING", line_centroid("line")).when(kind == "POLYGON", polygon_centroid("polygon"))
    box = F.when(kind == "POINT", R.mbr(p["x"], p["y"], p["x"], p["y"])).when(kind == "LINESTRING", line_mbr("line")).when(kind == "POLYGON", polygon_mbr("polygon"))
    return ok.withColumn("centroid", F.when(F.col("is_valid"), centre).cast(POINT)).withColumn("mbr", F.when(F.col("is_valid"), box).cast(MBR))


def features_from(df: DataFrame, id_col: Column, geom_type: str, geometry: Column, properties: Column | None = None) -> DataFrame:
    """A feature table from one geometry column."""
    null = lambda kind: F.lit(None).cast(kind)
    raw = df.select(
        id_col.cast("long").alias("id"),
        null("string").alias("id_str"),
        F.lit(geom_type).alias("geom_type"),
        (geometry if geom_type == "POINT" else null(POINT)).cast(POINT).alias("point"),
        (geometry if geom_type == "LINESTRING" else null(LINE)).cast(LINE).alias("line"),
        (geometry if geom_type == "POLYGON" else null(POLYGON)).cast(POLYGON).alias("polygon"),
        (null("string") if properties is None else properties.cast("string")).alias("properties"),
    )
    return derive(raw)


def point_features(df: DataFrame, id_col: Column, x: Column, y: Column) -> DataFrame:
    return features_from(df, id_col, "POINT", R.point(x, y))
