"""Well-known text in and out, by string functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import derive, let
from ..schema import LINE, POINT, POLYGON


def _body(text: Column, word: str) -> Column:
    """What stands between the outer parentheses of a geometry of this kind; empty if it is another."""
    return F.regexp_extract(text, rf"(?is)^\s*{word}\s*\((.*)\)\s*$", 1)


def _pair(text: Column) -> Column:
    """The first two numbers of a vertex whose blanks are single; null if there are fewer or they are not finite."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    number = lambda c, i: F.get(c, F.lit(i)).try_cast("double")
    pair = lambda c: F.struct(number(c, 0).alias("x"), number(c, 1).alias("y"))
    good = lambda p: F.when(finite(p["x"]) & finite(p["y"]), p)
    return let(F.split(F.trim(text), " ", 3), lambda c: let(pair(c), good))


def _path(text: Column) -> Column:
    """All vertices of a comma-separated list; null if any is bad."""
    return let(F.transform(F.split(text, ","), _pair), lambda points: F.when(F.forall(points, lambda p: p.isNotNull()), points))


def _rings(text: Column) -> Column:
    """Polygon of a list of rings; null if there are none or any is bad."""
    rings = F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1)), _path)
    whole = lambda r: (F.size(r) >= 1) & F.forall(r, lambda v: v.isNotNull())
    parts = lambda r: F.struct(F.get(r, F.lit(0)).alias("exterior"), F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))).alias("holes"))
    return let(rings, lambda r: F.when(whole(r), parts(r)))


def geometry_from_wkt(text: Column) -> Column:
    """Struct geom_type, point, line, polygon; the first ring of a polygon is its exterior, the rest are holes.

    Each step is bound once: columns that are used twice are worked out twice, and steps that build on each other so multiply.
    """
    read = lambda t, word, make, kind: let(_body(t, word), lambda b: F.when(b != "", make(b))).cast(kind)
    found = lambda t: F.struct(read(t, "POINT", _pair, POINT).alias("point"), read(t, "LINESTRING", _path, LINE).alias("line"), read(t, "POLYGON", _rings, POLYGON).alias("polygon"))
    kind = lambda g: F.when(g["point"].isNotNull(), "POINT").when(g["line"].isNotNull(), "LINESTRING").when(g["polygon"].isNotNull(), "POLYGON")
    named = lambda g: F.struct(kind(g).alias("geom_type"), g["point"].alias("point"), g["line"].alias("line"), g["polygon"].alias("polygon"))
    return let(F.regexp_replace(text, r"\s+", " "), lambda t: let(found(t), named))


def is_valid_wkt(text: Column) -> Column:
    return geometry_from_wkt(text)["geom_type"].isNotNull()


def from_wkt(rows: DataFrame, text: str = "value", id_col: str | None = None) -> DataFrame:
    """Features of a text column; texts that are not WKT are skipped."""
    # A generator, as the optimiser would repeat the parse in a filter.
    good = F.inline(F.filter(F.array(geometry_from_wkt(F.col(text))), lambda g: g["geom_type"].isNotNull()))
    parsed = rows.select((F.col(id_col) if id_col else F.lit(None)).cast("long").alias("id"), F.lit(None).cast("string").alias("id_str"), good)
    return derive(parsed.withColumn("properties", F.lit(None).cast("string")))


def geometry_to_wkt(geom_type, point, line, polygon, decimals: int | None = 6) -> Column:
    num = lambda v: v.cast("string") if decimals is None else F.format_string(f"%.{decimals}f", v)
    pair = lambda p: F.concat(num(p["x"]), F.lit(" "), num(p["y"]))
    path = lambda points: F.concat(F.lit("("), F.array_join(F.transform(points, pair), ", "), F.lit(")"))
    rings = F.concat(F.array(polygon["exterior"]), F.coalesce(polygon["holes"], F.array().cast(f"array<{LINE}>")))
    return (
        F.when(geom_type == "POINT", F.concat(F.lit("POINT ("), pair(point), F.lit(")")))
        .when(geom_type == "LINESTRING", F.concat(F.lit("LINESTRING "), path(line)))
        .when(geom_type == "POLYGON", F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, path), ", "), F.lit(")")))
    )


def detect_type(text: Column) -> Column:
    """Kind of a WKT or GeoJSON text by its beginning or first geometry name; POINT if nothing is found."""
    head = F.upper(F.ltrim(text))
    return (
        F.when(head.startswith("POINT"), "POINT")
        .when(head.startswith("LINESTRING"), "LINESTRING")
        .when(head.startswith("POLYGON"), "POLYGON")
        .when(text.contains('"Point"'), "POINT")
        .when(text.contains('"LineString"'), "LINESTRING")
        .when(text.contains('"Polygon"'), "POLYGON")
        .otherwise("POINT")
    )
