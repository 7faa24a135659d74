"""Measures of points, lines, polygons and rectangles on small literals."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G, mbr as R
from tessera.schema import RAW_FEATURE


def points(*xy):
    return F.array(*[R.point(float(x), float(y)) for x, y in xy])


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
HOLE = [(2, 2), (8, 2), (8, 8), (2, 8), (2, 2)]


def ask(spark, **cells):
    return spark.range(1).select(*[c.alias(n) for n, c in cells.items()]).first()


def test_distances(spark):
    a, b = R.point(0.0, 0.0), R.point(3.0, 4.0)
    r = ask(spark, d=G.distance(a, b), d2=G.distance_sq(a, b), same=G.point_equals(R.point(10.0, 20.0), R.point(10 + 1e-12, 20 - 1e-12), 1e-6), other=G.point_equals(R.point(10.0, 20.0), R.point(10.1, 20.0), 1e-6))
    assert (r.d, r.d2, r.same, r.other) == (5.0, 25.0, True, False)


def test_lines(spark):
    r = ask(
        spark,
        centre=G.line_centroid(points((0, 0), (10, 0))),
        box=G.line_mbr(points((-5, 10), (15, -3), (8, 20))),
        length=G.line_length(points((0, 0), (3, 4), (6, 0))),
        single=G.line_centroid(points((7, 8))),
        still=G.line_centroid(points((1, 1), (1, 1))),
        none=G.line_centroid(F.array().cast("array<struct<x:double,y:double>>")),
        short=G.line_length(points((7, 8))),
    )
    assert tuple(r.centre) == (5, 0) and tuple(r.box) == (-5, -3, 15, 20) and r.length == 10
    assert tuple(r.single) == (7, 8) and tuple(r.still) == (1, 1) and r.none is None and r.short == 0


def test_polygons(spark):
    plain, holed = G.make_polygon(points(*SQUARE)), G.make_polygon(points(*SQUARE), F.array(points(*HOLE)))
    r = ask(
        spark,
        centre=G.polygon_centroid(plain),
        area=G.polygon_area(plain),
        holed=G.polygon_area(holed),
        turned=G.polygon_area(G.make_polygon(points(*SQUARE[::-1]), F.array(points(*HOLE)))),
        ccw=G.polygon_is_clockwise(plain),
        cw=G.polygon_is_clockwise(G.make_polygon(points(*SQUARE[::-1]))),
        open_=G.polygon_area(G.make_polygon(points(*SQUARE[:-1]))),
        flat=G.polygon_centroid(G.make_polygon(points((0, 0), (1e-6, 0), (1e-6, 1e-6), (0, 0)))),
        two=G.polygon_centroid(G.make_polygon(points((0, 0), (1, 1)))),
        box=G.polygon_mbr(plain),
    )
    assert tuple(r.centre) == (5, 5) and r.area == 100 and r.holed == 64 and r.turned == 64 and r.open_ == 100
    assert r.ccw is False and r.cw is True and r.two is None and tuple(r.box) == (0, 0, 10, 10)
    # Below the area limit the mean of the vertices counts, the closing one included.
    assert r.flat.x == pytest.approx(0.5e-6) and r.flat.y == pytest.approx(0.25e-6)


def test_rectangles(spark):
    a, b, far = R.mbr(0, 0, 10, 10), R.mbr(5, 5, 15, 15), R.mbr(20, 20, 30, 30)
    r = ask(
        spark,
        meets=R.intersects(a, b),
        apart=R.intersects(a, far),
        touch=R.intersects(a, R.mbr(10, 10, 12, 12)),
        inside=R.contains_point(a, 5, 5),
        outside=R.contains_point(a, 15, 5),
        holds=R.contains_mbr(a, R.mbr(1, 1, 9, 9)),
        centre=R.centroid(R.mbr(0, 0, 10, 20)),
        area=R.area(R.mbr(0, 0, 10, 20)),
        common=R.intersection(a, b),
        nothing=R.intersection(a, far),
        around=R.union(a, far),
        same=R.union(a, R.empty()),
        with_empty=R.intersects(a, R.empty()),
        empty_area=R.area(R.empty()),
        near=R.adjacent(a, R.mbr(10 + 5e-10, 0, 20, 10)),
        grown=R.expand_point(a, -3.0, 12.0),
        quad=R.quadrant(a, F.lit(5.0), F.lit(4.0)),
        part=R.quadrant_bounds(a, "NE"),
        key=R.quad_key((0, 0, 8, 8), F.lit(7.0), F.lit(1.0), 3),
        inverted=R.intersects(a, R.mbr(9, 9, 1, 1)),
    )
    assert (r.meets, r.apart, r.touch, r.inside, r.outside, r.holds) == (True, False, True, True, False, True)
    assert tuple(r.centre) == (5, 10) and r.area == 200 and tuple(r.common) == (5, 5, 10, 10) and r.nothing is None
    assert tuple(r.around) == (0, 0, 30, 30) and tuple(r.same) == (0, 0, 10, 10) and r.with_empty is False and r.empty_area == 0
    assert r.near is True and tuple(r.grown) == (-3, 0, 10, 12) and r.quad == "SE" and tuple(r.part) == (5, 5, 10, 10)
    assert r.key == "113" and r.inverted is False


def test_derive_marks_invalid_geometries(spark):
    rows = [
        (1, None, "POINT", (1.0, 2.0), None, None, None),
        (2, None, "POINT", (math.nan, 2.0), None, None, None),
        (3, None, "LINESTRING", None, [], None, None),
        (4, None, "LINESTRING", None, [(0.0, 0.0), (10.0, 10.0)], None, None),
        (5, None, "POLYGON", None, None, ([(0.0, 0.0), (1.0, 1.0)], []), None),
        (6, None, "CIRCLE", None, None, None, None),
        (7, None, None, None, None, None, None),
    ]
    got = {r.id: r for r in G.derive(spark.createDataFrame(rows, RAW_FEATURE)).collect()}
    assert [got[i].is_valid for i in range(1, 8)] == [True, False, False, True, False, False, False]
    assert tuple(got[4].centroid) == (5, 5) and all(got[i].mbr is None and got[i].centroid is None for i in (2, 3, 5, 6, 7))
