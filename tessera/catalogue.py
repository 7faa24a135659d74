"""The package's queries over the test tables, and the same in SQL.

Doubles that come out of sums are rounded in both, as engines add in different orders.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fixtures as X
from .functions import geometry as G, mbr as R
from .operators import adjacency, join, layout, placement, quadtree, query, stats
from .plans.catalog import Catalog
from .plans.frame import SpatialFrame
from .schema import SpatialConfig
from .sources import geojson, store, synthetic, wkt
from .sources.shared import settled, shared_folder
from .streaming import ingest

_DAY = lambda y, m, d: float((datetime.date(y, m, d) - datetime.date(1970, 1, 1)).days)

#: Box of the flagship query: price and day of order.
BOX = (100000.0, _DAY(1996, 1, 1), 300000.0, _DAY(1999, 12, 31))
SMALL_BOX = (150000.0, _DAY(1997, 1, 1), 200000.0, _DAY(1997, 12, 31))
PART_BOX = (950.0, 10.0, 1050.0, 20.0)
AT = (150000.0, _DAY(1998, 6, 1))
REGIONS = [(1, 50000.0, 9500.0, 90000.0, 9800.0), (2, 150000.0, 10000.0, 200000.0, 10400.0), (3, 0.0, 9000.0, 500000.0, 9400.0), (4, 600000.0, 0.0, 700000.0, 1.0), (5, 250000.0, 10200.0, 250000.0, 11000.0)]
CONFIG = SpatialConfig(block_size=1024, page_capacity=64, pages_per_track=16)

# Queries ---------------------------------------------------------------------------------

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    """Registers a query under its function's name, with the same in SQL."""

    def add(f):
        _Q[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _flat(box: str = "mbr", prefix: str = "") -> list:
    return [F.col(f"{box}.{n}").alias(prefix + n) for n in ("min_x", "min_y", "max_x", "max_y")]


_ORDERS = "SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS x, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y FROM orders"
_CUSTOMERS = "SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer"
_EVENTS = "SELECT event_id AS id, CAST(user_id AS DOUBLE) AS x, CAST(value AS DOUBLE) AS y FROM events"
_PARTBOX = "SELECT p_partkey AS id, CAST(p_retailprice AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, CAST(p_partkey % 7 + 1 AS DOUBLE) AS w, CAST(p_partkey % 5 + 1 AS DOUBLE) AS h FROM part"
_BOXES = f"SELECT id, x AS min_x, y AS min_y, x + w AS max_x, y + h AS max_y, w, h FROM ({_PARTBOX})"
_VERTICES = "SELECT l_orderkey AS id, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS k FROM lineitem"
_STEPS = f"SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ({_VERTICES}) WINDOW w AS (PARTITION BY id ORDER BY k)"

#: Level-wise median splits; node is the path, pivot marks split points.
_KD = f"""
kd AS (
  SELECT 0 AS lvl, '' AS node, id, x, y, false AS mid FROM ({_ORDERS})
  UNION ALL
  SELECT lvl + 1,
    CASE WHEN n <= {CONFIG.block_size} THEN node WHEN mid OR rn < n // 2 THEN node || '0' ELSE node || '1' END,
    id, x, y, mid OR (n > {CONFIG.block_size} AND rn = n // 2)
  FROM (
    SELECT *, max(n) OVER () AS most FROM (
      SELECT *, row_number() OVER (PARTITION BY node ORDER BY mid, CASE WHEN lvl % 2 = 0 THEN x ELSE y END, id) - 1 AS rn,
        count(*) FILTER (NOT mid) OVER (PARTITION BY node) AS n
      FROM kd
    )
  ) WHERE most > {CONFIG.block_size}
), leaf AS (
  SELECT * FROM kd WHERE lvl = (SELECT max(lvl) FROM kd)
), blocks AS (
  SELECT row_number() OVER (ORDER BY node) AS block_id, * FROM (
    SELECT node, min(x) FILTER (NOT mid) AS min_x, min(y) FILTER (NOT mid) AS min_y, max(x) FILTER (NOT mid) AS max_x, max(y) FILTER (NOT mid) AS max_y,
      count(*) FILTER (NOT mid) AS object_count, count(*) AS stored_count
    FROM leaf GROUP BY node
  )
)"""

_CELL = lambda v, lo, hi: f"greatest(0, least(65535, CAST(floor(CASE WHEN {hi} > {lo} THEN ({v} - {lo}) / ({hi} - {lo}) ELSE 0 END * 65536) AS BIGINT)))"
_PAGE = f"""{_KD}, cells AS (
  SELECT l.id, l.x, l.y, b.block_id, {_CELL('l.x', 'b.min_x', 'b.max_x')} AS cx, {_CELL('l.y', 'b.min_y', 'b.max_y')} AS cy
  FROM leaf l JOIN blocks b USING (node)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY z, id) - 1 AS place,
    (SELECT count(*) FROM kd WHERE lvl = 0) AS total
  FROM (SELECT *, list_sum(list_transform(range(16), lambda b: (((cx >> b) & 1) << (2 * b)) + (((cy >> b) & 1) << (2 * b + 1)))) AS z FROM cells)
), shape AS (
  SELECT CAST(ceil(({CONFIG.block_size} + greatest(1, (SELECT max(lvl) FROM kd))) / {CONFIG.page_capacity}.0) AS INTEGER) AS pages
), laid AS (
  SELECT id, x, y, block_id,
    CAST((block_id - 1) * pages + place // {CONFIG.page_capacity} + 1 AS BIGINT) AS page_id,
    CAST((block_id - 1) * CAST(ceil(pages / {CONFIG.pages_per_track}.0) AS INTEGER) + (place // {CONFIG.page_capacity}) // {CONFIG.pages_per_track} + 1 AS BIGINT) AS track_id
  FROM placed, shape
), pages AS (
  SELECT page_id, min(track_id) AS track_id, min(block_id) AS block_id, count(*) AS object_count, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y,
    avg(x) AS cx, avg(y) AS cy
  FROM laid GROUP BY page_id
)"""


def _meets(box, a="min_x", b="min_y", c="max_x", d="max_y") -> str:
    return f"{a} <= {box[2]} AND {c} >= {box[0]} AND {b} <= {box[3]} AND {d} >= {box[1]}"


def _within(box) -> str:
    return f"x BETWEEN {box[0]} AND {box[2]} AND y BETWEEN {box[1]} AND {box[3]}"


def _d2(x, y) -> str:
    return f"(x - {x}) * (x - {x}) + (y - {y}) * (y - {y})"


def _id_xy(df: DataFrame, *more) -> DataFrame:
    return df.select("id", F.col("centroid.x").alias("x"), F.col("centroid.y").alias("y"), *more)


@_query(f"SELECT id, x, y FROM ({_ORDERS}) WHERE {_within(BOX)}")
def range_query(spark, sf):
    return _id_xy(query.range_query(X.orders_points(spark, sf), BOX))


@_query(f"SELECT id, min_x, min_y, max_x, max_y FROM ({_BOXES}) WHERE {_meets(PART_BOX)}")
def range_query_boxes(spark, sf):
    return query.range_query(X.part_boxes(spark, sf), PART_BOX).select("id", *_flat())


@_query(f"SELECT id FROM ({_BOXES}) WHERE 1000.5 BETWEEN min_x AND max_x AND 21 BETWEEN min_y AND max_y")
def point_query(spark, sf):
    return query.point_query(X.part_boxes(spark, sf), 1000.5, 21.0).select("id")


@_query(f"SELECT id, {_d2(*AT)} AS d2 FROM ({_ORDERS}) ORDER BY d2, id LIMIT 10")
def knn_10(spark, sf):
    return query.knn(X.orders_points(spark, sf), *AT, 10).select("id", "d2")


@_query(f"SELECT id, {_d2(75.0, 250.0)} AS d2 FROM ({_EVENTS}) ORDER BY d2, id LIMIT 1")
def nearest_1(spark, sf):
    return query.nearest(X.event_points(spark, sf), 75.0, 250.0).select("id", "d2")


@_query(f"SELECT id, {_d2(*AT)} AS d2 FROM ({_ORDERS}) ORDER BY d2, id LIMIT 25")
def knn_two_phase(spark, sf):
    laid, _, found = _layout(spark, sf, often=True)
    return query.knn_pruned(laid, found, *AT, 25).select("id", "d2")


@_query(f"SELECT id, x, y FROM ({_EVENTS}) WHERE {_within((20.0, 100.0, 60.0, 200.0))}")
def kd_range(spark, sf):
    return _id_xy(query.centroid_range(X.event_points(spark, sf), (20.0, 100.0, 60.0, 200.0)))


@_query(f"SELECT id, {_d2(75.0, 250.0)} AS d2 FROM ({_EVENTS}) WHERE {_within((45.0, 220.0, 105.0, 280.0))} AND {_d2(75.0, 250.0)} <= 900")
def radius_query(spark, sf):
    return query.radius_query(X.event_points(spark, sf), 75.0, 250.0, 30.0).select("id", "d2")


@_query(f"SELECT id FROM (SELECT *, (min_x + max_x) / 2 AS x, (min_y + max_y) / 2 AS y FROM ({_BOXES})) WHERE {_meets((980.0, 0.0, 1020.0, 40.0))} AND {_d2(1000.0, 20.0)} <= 400")
def item_radius(spark, sf):
    return query.item_radius(X.part_boxes(spark, sf), 1000.0, 20.0, 20.0).select("id")


@_query(f"SELECT id, {_d2(100.0, 10.0)} AS d2, sqrt({_d2(100.0, 10.0)}) AS d FROM ({_CUSTOMERS})")
def point_distance(spark, sf):
    c = X.customer_points(spark, sf)
    return c.select("id", G.distance_sq("point", R.point(100.0, 10.0)).alias("d2"), G.distance("point", R.point(100.0, 10.0)).alias("d"))


@_query(f"SELECT id, abs(x - round(x)) < 0.1 AND abs(y - round(y)) < 0.1 AS same FROM ({_CUSTOMERS})")
def point_equals(spark, sf):
    c = X.customer_points(spark, sf)
    near = R.point(F.round(F.col("point.x")), F.round(F.col("point.y")))
    return c.select("id", G.point_equals("point", near, 0.1).alias("same"))


@_query(f"SELECT id, round(coalesce(sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))), 0), 4) AS length FROM ({_STEPS}) GROUP BY id")
def line_length(spark, sf):
    return X.order_lines(spark, sf).select("id", F.round(G.line_length("line"), 4).alias("length"))


@_query(
    f"""SELECT id, round(CASE WHEN t >= 1e-10 THEN sx / t ELSE fx END, 4) AS cx, round(CASE WHEN t >= 1e-10 THEN sy / t ELSE fy END, 4) AS cy FROM (
  SELECT id, coalesce(sum(d), 0) AS t, sum((x + x2) * 0.5 * d) AS sx, sum((y + y2) * 0.5 * d) AS sy, min(x) FILTER (k = 1) AS fx, min(y) FILTER (k = 1) AS fy
  FROM (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS d FROM ({_STEPS})) GROUP BY id)"""
)
def line_centroid(spark, sf):
    return X.order_lines(spark, sf).select("id", F.round("centroid.x", 4).alias("cx"), F.round("centroid.y", 4).alias("cy"))


@_query(f"SELECT id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM ({_VERTICES}) GROUP BY id")
def line_mbr(spark, sf):
    return X.order_lines(spark, sf).select("id", *_flat())


@_query(f"SELECT id, round(w * h * CASE WHEN id % 10 = 0 THEN 0.75 ELSE 1 END, 4) AS area FROM ({_PARTBOX})")
def polygon_area(spark, sf):
    return X.part_boxes(spark, sf).select("id", F.round(G.polygon_area("polygon"), 4).alias("area"))


@_query(f"SELECT id, round(x + w / 2, 3) AS cx, round(y + h / 2, 3) AS cy FROM ({_PARTBOX})")
def polygon_centroid(spark, sf):
    return X.part_boxes(spark, sf).select("id", F.round("centroid.x", 3).alias("cx"), F.round("centroid.y", 3).alias("cy"))


@_query(f"SELECT id, min_x, min_y, max_x, max_y FROM ({_BOXES})")
def polygon_mbr(spark, sf):
    return X.part_boxes(spark, sf).select("id", *_flat())


@_query("SELECT p_partkey AS id, p_partkey % 2 = 1 AS clockwise FROM part")
def polygon_clockwise(spark, sf):
    turned = F.when(F.col("id") % 2 == 1, F.reverse("polygon.exterior")).otherwise(F.col("polygon.exterior"))
    return X.part_boxes(spark, sf).select("id", G.polygon_is_clockwise(G.make_polygon(turned)).alias("clockwise"))


def _part_pairs(spark, sf):
    """Each part's rectangle with that of the next part."""
    p = X.part_boxes(spark, sf).select("id", "mbr")
    return p.join(p.select((F.col("id") - 1).alias("id"), F.col("mbr").alias("next")), "id")


_PAIR = f"SELECT a.id, a.min_x, a.min_y, a.max_x, a.max_y, b.min_x AS bx0, b.min_y AS by0, b.max_x AS bx1, b.max_y AS by1 FROM ({_BOXES}) a JOIN ({_BOXES}) b ON b.id = a.id + 1"
_PAIR_MEETS = "min_x <= bx1 AND max_x >= bx0 AND min_y <= by1 AND max_y >= by0"


@_query(f"SELECT id, greatest(min_x, bx0) AS min_x, greatest(min_y, by0) AS min_y, least(max_x, bx1) AS max_x, least(max_y, by1) AS max_y FROM ({_PAIR}) WHERE {_PAIR_MEETS}")
def mbr_intersection(spark, sf):
    both = _part_pairs(spark, sf).select("id", R.intersection("mbr", "next").alias("m")).where(F.col("m").isNotNull())
    return both.select("id", *_flat("m"))


@_query(f"SELECT id, least(min_x, bx0) AS min_x, least(min_y, by0) AS min_y, greatest(max_x, bx1) AS max_x, greatest(max_y, by1) AS max_y FROM ({_PAIR})")
def mbr_union(spark, sf):
    return _part_pairs(spark, sf).select("id", R.union("mbr", "next").alias("m")).select("id", *_flat("m"))


@_query(f"SELECT id, {_PAIR_MEETS} AS meets, min_x <= bx0 AND max_x >= bx1 AND min_y <= by0 AND max_y >= by1 AS holds, min_x <= 1000 AND max_x >= 1000 AND min_y <= 25 AND max_y >= 25 AS holds_point FROM ({_PAIR})")
def mbr_contains(spark, sf):
    return _part_pairs(spark, sf).select("id", R.intersects("mbr", "next").alias("meets"), R.contains_mbr("mbr", "next").alias("holds"), R.contains_point("mbr", 1000.0, 25.0).alias("holds_point"))


@_query(f"SELECT id, round(min_x + w / 2, 4) AS cx, round(min_y + h / 2, 4) AS cy, round(w * h, 4) AS area FROM ({_BOXES})")
def mbr_measures(spark, sf):
    p = X.part_boxes(spark, sf)
    c = R.centroid("mbr")
    return p.select("id", F.round(c["x"], 4).alias("cx"), F.round(c["y"], 4).alias("cy"), F.round(R.area("mbr"), 4).alias("area"))


def _all_features(spark, sf):
    return X.customer_points(spark, sf).unionByName(X.part_boxes(spark, sf)).unionByName(X.order_lines(spark, sf))


@_query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) + (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_objects")
def count_objects(spark, sf):
    return stats.count_objects(_all_features(spark, sf))


@_query(
    f"""SELECT min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM (
  SELECT x AS min_x, y AS min_y, x AS max_x, y AS max_y FROM ({_CUSTOMERS}) UNION ALL SELECT min_x, min_y, max_x, max_y FROM ({_BOXES})
  UNION ALL SELECT x, y, x, y FROM ({_VERTICES}))"""
)
def bounds(spark, sf):
    return stats.bounds(_all_features(spark, sf)).select(*_flat("bounds"))


@_query("SELECT 'POINT' AS geom_type, count(*) AS n_objects FROM customer UNION ALL SELECT 'POLYGON', count(*) FROM part UNION ALL SELECT 'LINESTRING', count(DISTINCT l_orderkey) FROM lineitem")
def count_by_type(spark, sf):
    return stats.count_by_type(_all_features(spark, sf))


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"


def _layout(spark, sf, often: bool = False):
    """Laid-out orders, blocks and pages; ``often`` writes the layout once for queries that read it several times."""
    every = layout.placed(X.orders_points(spark, sf), CONFIG)
    if often:
        every = settled(every, "layout")
    laid = every.drop("x", "y", "node", "pivot")
    return laid, layout.kd_blocks(every), layout.pages_of(laid, CONFIG)


@_query(f"WITH RECURSIVE {_KD} SELECT block_id, node, min_x, min_y, max_x, max_y, object_count FROM blocks")
def kd_blocks(spark, sf):
    blocks = layout.kd_blocks(layout.kd_nodes(X.orders_points(spark, sf), CONFIG))
    return blocks.select("block_id", "node", *_flat("bounds"), "object_count")


@_query(f"WITH RECURSIVE {_KD} SELECT min(block_id) AS block_id FROM blocks WHERE {AT[0]} BETWEEN min_x AND max_x AND {AT[1]} BETWEEN min_y AND max_y HAVING min(block_id) IS NOT NULL")
def block_at_point(spark, sf):
    _, blocks, _ = _layout(spark, sf)
    return layout.block_at(blocks, *AT).select("block_id")


@_query(f"WITH RECURSIVE {_KD} SELECT block_id, object_count FROM blocks WHERE {_meets(SMALL_BOX)}")
def blocks_in_region(spark, sf):
    _, blocks, _ = _layout(spark, sf)
    return layout.blocks_in_region(blocks, SMALL_BOX).select("block_id", "object_count")


@_query(f"WITH RECURSIVE {_PAGE} SELECT page_id, track_id, block_id, object_count, min_x, min_y, max_x, max_y, round(cx, 3) AS cx, round(cy, 3) AS cy FROM pages")
def pages(spark, sf):
    _, _, found = _layout(spark, sf)
    return found.select("page_id", "track_id", "block_id", "object_count", *_flat("extent"), F.round("centroid.x", 3).alias("cx"), F.round("centroid.y", 3).alias("cy"))


@_query(f"WITH RECURSIVE {_PAGE} SELECT track_id, count(*) AS page_count, CAST(sum(object_count) AS BIGINT) AS object_count, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM pages GROUP BY track_id")
def tracks(spark, sf):
    _, _, found = _layout(spark, sf)
    return layout.tracks_of(found, CONFIG).select("track_id", "page_count", "object_count", *_flat("extent"))


@_query(
    f"""WITH RECURSIVE {_PAGE} SELECT CAST(sum(object_count) AS BIGINT) AS total_objects, count(*) AS total_pages, count(DISTINCT track_id) AS total_tracks,
  (SELECT count(*) FROM blocks) AS total_blocks, round(avg(object_count), 4) AS avg_objects_per_page, round(avg(object_count / {CONFIG.page_capacity}.0), 4) AS page_utilization FROM pages"""
)
def index_stats(spark, sf):
    laid, blocks, found = _layout(spark, sf)
    s = stats.index_stats(laid, found, blocks, CONFIG)
    return s.select("total_objects", "total_pages", "total_tracks", "total_blocks", F.round("avg_objects_per_page", 4).alias("avg_objects_per_page"), F.round("page_utilization", 4).alias("page_utilization"))


_NEAR = lambda box: f"min_x <= {box[2]} + 1e-9 AND max_x >= {box[0]} - 1e-9 AND min_y <= {box[3]} + 1e-9 AND max_y >= {box[1]} - 1e-9"


@_query(f"WITH RECURSIVE {_PAGE} SELECT page_id, track_id FROM pages WHERE {_NEAR(SMALL_BOX)}")
def adjacent_pages(spark, sf):
    _, _, found = _layout(spark, sf)
    return adjacency.adjacent_pages(found, SMALL_BOX).select("page_id", "track_id")


@_query(f"SELECT id, x, y FROM ({_ORDERS}) WHERE {_within(SMALL_BOX)}")
def query_adjacent(spark, sf):
    laid, _, found = _layout(spark, sf, often=True)
    return _id_xy(adjacency.query_adjacent(laid, found, SMALL_BOX))


_REGIONS = "(VALUES " + ", ".join(str(r) for r in REGIONS) + ") r(region_id, a, b, c, d)"


@_query(
    f"""WITH RECURSIVE {_PAGE} SELECT r.region_id, count(p.page_id) AS pages, greatest(count(DISTINCT p.track_id) - 1, 0) AS seeks
  FROM {_REGIONS} LEFT JOIN pages p ON min_x <= c + 1e-9 AND max_x >= a - 1e-9 AND min_y <= d + 1e-9 AND max_y >= b - 1e-9 GROUP BY r.region_id"""
)
def estimate_seeks(spark, sf):
    _, _, found = _layout(spark, sf)
    regions = spark.createDataFrame(REGIONS, "region_id int, a double, b double, c double, d double")
    boxes = regions.select("region_id", R.mbr(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("mbr"))
    return adjacency.region_seeks(found, boxes)


@_query(f"WITH RECURSIVE {_PAGE} SELECT count(*) AS pages, count(*) FILTER (track_id <> was) AS seeks FROM (SELECT *, lag(track_id) OVER (ORDER BY min_y, page_id) AS was FROM pages WHERE {_NEAR(SMALL_BOX)})")
def seeks_in_order(spark, sf):
    _, _, found = _layout(spark, sf)
    near = adjacency.adjacent_pages(found, SMALL_BOX).withColumn("low", F.col("extent.min_y"))
    return adjacency.estimate_seeks(near, ("low", "page_id"))


@_query(f"SELECT a.id AS a, b.id AS b FROM ({_BOXES}) a JOIN ({_BOXES}) b ON a.id < b.id AND a.min_x <= b.max_x + 1e-9 AND a.max_x >= b.min_x - 1e-9 AND a.min_y <= b.max_y + 1e-9 AND a.max_y >= b.min_y - 1e-9")
def adjacent_items(spark, sf):
    return adjacency.adjacency_pairs(X.part_boxes(spark, sf))


@_query(f"SELECT b.id FROM ({_BOXES}) a JOIN ({_BOXES}) b ON a.id = 7 AND a.min_x <= b.max_x + 1e-9 AND a.max_x >= b.min_x - 1e-9 AND a.min_y <= b.max_y + 1e-9 AND a.max_y >= b.min_y - 1e-9")
def adjacent_to_item(spark, sf):
    return adjacency.adjacent_items(X.part_boxes(spark, sf), 7).select("id")


@_query(f"SELECT id, CASE WHEN y < 250 THEN 'S' ELSE 'N' END || CASE WHEN x < 75 THEN 'W' ELSE 'E' END AS quadrant FROM ({_EVENTS})")
def quadrant_of(spark, sf):
    e = X.event_points(spark, sf)
    return e.select("id", R.quadrant(R.mbr(0.0, 0.0, 150.0, 500.0), F.col("point.x"), F.col("point.y")).alias("quadrant"))


@_query(f"SELECT count(*) AS leaves, CAST(sum(n) AS BIGINT) AS items, max(n) AS most_items FROM (SELECT floor(x / 150 * 16) AS a, floor(y / 500 * 16) AS b, count(*) AS n FROM ({_EVENTS}) GROUP BY 1, 2)")
def quad_stats(spark, sf):
    return stats.quad_stats(X.event_points(spark, sf), (0.0, 0.0, 150.0, 500.0), 4)


@_query(f"SELECT id, x, y FROM ({_CUSTOMERS}) WHERE id % 3 <> 0")
def remove_objects(spark, sf):
    frame = SpatialFrame(spark, features=X.customer_points(spark, sf))
    frame.remove_many(frame.features.where("id % 3 = 0"))
    return _id_xy(frame.features)


@_query(f"SELECT id, CASE WHEN id % 4 = 0 THEN x + 1000 ELSE x END AS x, y FROM ({_CUSTOMERS})")
def update_objects(spark, sf):
    frame = SpatialFrame(spark, features=X.customer_points(spark, sf))
    moved = frame.features.where("id % 4 = 0")
    frame.update(G.point_features(moved, F.col("id"), F.col("point.x") + 1000.0, F.col("point.y")))
    return _id_xy(frame.features)


@_query(f"SELECT id, x, y FROM ({_CUSTOMERS}) UNION ALL SELECT id + 10000000, x, y FROM ({_EVENTS})")
def bulk_insert(spark, sf):
    frame = SpatialFrame(spark, features=X.customer_points(spark, sf))
    e = X.event_points(spark, sf)
    frame.bulk_insert(G.point_features(e, F.col("id") + 10000000, F.col("point.x"), F.col("point.y")))
    return _id_xy(frame.features)


@_query(f"SELECT id, x, y FROM ({_CUSTOMERS}) WHERE id = 42")
def get_object(spark, sf):
    return _id_xy(query.get_object(X.customer_points(spark, sf), 42))


@_query(f"SELECT id, round(x, 2) AS x, y FROM ({_CUSTOMERS})")
def geojson_roundtrip(spark, sf):
    texts = X.customer_points(spark, sf).select(geojson.feature_to_geojson().alias("value"))
    back = geojson.from_geojson_strings(texts)
    return back.select("id", F.round("point.x", 2).alias("x"), F.col("point.y").alias("y"))


@_query(f"SELECT id, round(w * h * CASE WHEN id % 10 = 0 THEN 0.75 ELSE 1 END, 3) AS area, CAST(CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_holes FROM ({_PARTBOX})")
def geojson_polygons(spark, sf):
    texts = X.part_boxes(spark, sf).select(geojson.feature_to_geojson().alias("value"))
    back = geojson.from_geojson_strings(texts)
    return back.select("id", F.round(G.polygon_area("polygon"), 3).alias("area"), F.size("polygon.holes").alias("n_holes"))


@_query(f"SELECT id, round(w * h * CASE WHEN id % 10 = 0 THEN 0.75 ELSE 1 END, 3) AS area, 5 AS n_vertices FROM ({_PARTBOX})")
def wkt_roundtrip(spark, sf):
    p = X.part_boxes(spark, sf)
    texts = p.select("id", wkt.geometry_to_wkt(F.col("geom_type"), F.col("point"), F.col("line"), F.col("polygon")).alias("value"))
    # A small file is read by one or two tasks, which should not parse all of it.
    back = wkt.from_wkt(texts.repartition(spark.sparkContext.defaultParallelism), id_col="id")
    return back.select("id", F.round(G.polygon_area("polygon"), 3).alias("area"), F.size("polygon.exterior").alias("n_vertices"))


@_query("SELECT count(*) AS n_points, CAST(sum(k) AS BIGINT) AS n_vertices FROM (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY l_orderkey)")
def wkt_lines(spark, sf):
    lines = X.order_lines(spark, sf)
    texts = lines.select("id", wkt.geometry_to_wkt(F.col("geom_type"), F.col("point"), F.col("line"), F.col("polygon")).alias("value"))
    return wkt.from_wkt(texts, id_col="id").agg(F.count(F.lit(1)).alias("n_points"), F.sum(F.size("line")).alias("n_vertices"))


def _odd_texts(spark, sf, good):
    """A customer's text, with each third cut short."""
    c = X.customer_points(spark, sf)
    return c.select("id", F.when(F.col("id") % 3 == 0, F.substring(good, 1, 12)).otherwise(good).alias("value"))


@_query("SELECT c_custkey AS id, c_custkey % 3 <> 0 AS valid FROM customer")
def geojson_validate(spark, sf):
    return _odd_texts(spark, sf, geojson.feature_to_geojson()).select("id", geojson.is_valid_geojson(F.col("value")).alias("valid"))


@_query("SELECT c_custkey AS id, c_custkey % 3 <> 0 AS valid FROM customer")
def wkt_validate(spark, sf):
    text = wkt.geometry_to_wkt(F.col("geom_type"), F.col("point"), F.col("line"), F.col("polygon"))
    return _odd_texts(spark, sf, text).select("id", wkt.is_valid_wkt(F.col("value")).alias("valid"))


@_query("SELECT 'POINT' AS detected, count(*) AS n FROM customer UNION ALL SELECT 'POLYGON', count(*) FROM part UNION ALL SELECT 'LINESTRING', count(DISTINCT l_orderkey) FROM lineitem")
def detect_type(spark, sf):
    f = _all_features(spark, sf)
    text = F.when(F.col("id") % 2 == 0, geojson.feature_to_geojson()).otherwise(wkt.geometry_to_wkt(F.col("geom_type"), F.col("point"), F.col("line"), F.col("polygon")))
    return f.groupBy(wkt.detect_type(text).alias("detected")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS missing FROM customer")
def json_get(spark, sf):
    from .functions.json import get_number, get_string

    c = X.table(spark, sf, "customer")
    text = F.to_json(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("k")).alias("nation")))
    return c.select(
        F.col("c_custkey").alias("id"),
        get_string(text, "$.name").alias("name"),
        get_number(text, "$.nation.k").cast(c.schema["c_nationkey"].dataType).alias("nation"),
        F.coalesce(get_string(text, "$.segment"), F.col("c_mktsegment")).alias("missing"),
    )


@_query(f"SELECT a.id AS region_id, b.id FROM ({_BOXES}) a JOIN ({_CUSTOMERS}) b ON b.x BETWEEN a.min_x AND a.max_x AND b.y BETWEEN a.min_y AND a.max_y")
def region_join(spark, sf):
    regions = X.part_boxes(spark, sf).select(F.col("id").alias("region_id"), "mbr")
    return join.region_join(regions, X.customer_points(spark, sf))


@_query(f"SELECT * FROM (SELECT q.id AS query_id, p.id, row_number() OVER (PARTITION BY q.id ORDER BY (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y), p.id) AS rank FROM (SELECT id, x + w / 2 AS x, y + h / 2 AS y FROM ({_PARTBOX})) q, ({_CUSTOMERS}) p) WHERE rank <= 3")
def knn_join(spark, sf):
    asked = X.part_boxes(spark, sf).select(F.col("id").alias("query_id"), F.col("centroid.x").alias("x"), F.col("centroid.y").alias("y"))
    return join.knn_join(asked, X.customer_points(spark, sf), 3, small=100).select("query_id", "id", "rank")


@_query(f"SELECT id, x, y FROM ({_ORDERS})")
def save_load_roundtrip(spark, sf):
    path = _folder(spark)
    SpatialFrame(spark, CONFIG, X.orders_points(spark, sf)).save(path)
    return _id_xy(SpatialFrame.load(spark, path).features)


# Pages and tracks one at a time, trees, storage and the service --------------------------------


@_query(f"WITH RECURSIVE {_PAGE} SELECT page_id, object_count FROM pages WHERE {_meets(SMALL_BOX)}")
def pages_in_region(spark, sf):
    _, _, found = _layout(spark, sf)
    return layout.pages_in_region(found, SMALL_BOX).select("page_id", "object_count")


_TRACKS = f"SELECT track_id, count(*) AS page_count, CAST(sum(object_count) AS BIGINT) AS object_count, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, avg(cx) AS cx, avg(cy) AS cy, count(*) < {CONFIG.pages_per_track} AS has_space FROM pages GROUP BY track_id"


@_query(f"WITH RECURSIVE {_PAGE} SELECT track_id, page_count FROM ({_TRACKS}) WHERE {_meets(SMALL_BOX)}")
def tracks_in_region(spark, sf):
    _, _, found = _layout(spark, sf)
    return layout.tracks_in_region(layout.tracks_of(found, CONFIG), SMALL_BOX).select("track_id", "page_count")


@_query(f"WITH RECURSIVE {_PAGE} SELECT page_id, object_count >= {CONFIG.page_capacity} AS is_full, round(object_count / {CONFIG.page_capacity}.0, 6) AS utilization FROM pages")
def full_pages(spark, sf):
    _, _, found = _layout(spark, sf)
    return found.select("page_id", "is_full", F.round("utilization", 6).alias("utilization"))


@_query(f"WITH RECURSIVE {_PAGE} SELECT track_id, has_space FROM ({_TRACKS})")
def track_space(spark, sf):
    _, _, found = _layout(spark, sf)
    return layout.tracks_of(found, CONFIG).select("track_id", "has_space")


@_query(f"WITH RECURSIVE {_PAGE} SELECT page_id FROM pages WHERE page_id % 5 = 0")
def verify_pages(spark, sf):
    """Finds each page that was tampered with: a feature of every fifth page moves."""
    laid, _, found = _layout(spark, sf, often=True)
    bad = laid.withColumn("centroid", F.when((F.col("page_id") % 5 == 0) & (F.col("slot") == 0), R.point(F.col("centroid.x") + 1.0, F.col("centroid.y"))).otherwise(F.col("centroid")))
    return layout.verify_pages(bad, found).select("page_id")


_GAP = "greatest(min_x - {x}, {x} - max_x, 0) * greatest(min_x - {x}, {x} - max_x, 0) + greatest(min_y - {y}, {y} - max_y, 0) * greatest(min_y - {y}, {y} - max_y, 0)"


@_query(f"WITH RECURSIVE {_KD} SELECT block_id FROM blocks ORDER BY {_GAP.format(x=600000.0, y=9000.0)}, block_id LIMIT 1")
def find_leaf(spark, sf):
    _, blocks, _ = _layout(spark, sf)
    return layout.find_leaf(blocks, 600000.0, 9000.0).select("block_id")


@_query(f"WITH RECURSIVE {_KD} SELECT CAST(max(length(node)) AS INTEGER) AS depth, CAST(ceil(log2(count(*) + 1)) AS INTEGER) AS optimal, max(length(node)) <= 2 * greatest(1, ceil(log2(count(*) + 1))) AS is_balanced FROM blocks")
def kd_balance(spark, sf):
    _, blocks, _ = _layout(spark, sf)
    return stats.balance(blocks)


@_query(f"WITH RECURSIVE {_PAGE} SELECT count(*) AS pages_total, count(*) FILTER ({_meets(SMALL_BOX)}) AS pages_read, CAST(coalesce(sum(object_count) FILTER ({_meets(SMALL_BOX)}), 0) AS BIGINT) AS objects_read, round(1 - count(*) FILTER ({_meets(SMALL_BOX)}) / count(*), 6) AS skipped_share FROM pages")
def io_stats(spark, sf):
    _, _, found = _layout(spark, sf)
    return stats.io_stats(found, SMALL_BOX).withColumn("skipped_share", F.round("skipped_share", 6))


@_query(f"WITH RECURSIVE {_PAGE}, t AS ({_TRACKS}) SELECT a.track_id AS a, b.track_id AS b, round(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)), 4) AS distance FROM t a, t b WHERE a.track_id = 1 AND b.track_id = 2")
def track_distance(spark, sf):
    _, _, found = _layout(spark, sf)
    return layout.track_distance(layout.tracks_of(found, CONFIG), 1, 2).withColumn("distance", F.round("distance", 4))


_TRACK_COST = {
    "nearest": f"SELECT 'nearest' AS strategy, track_id FROM t WHERE has_space ORDER BY sqrt((cx - {AT[0]}) * (cx - {AT[0]}) + (cy - {AT[1]}) * (cy - {AT[1]})), track_id LIMIT 1",
    "best_fit": f"SELECT 'best_fit' AS strategy, track_id FROM t WHERE has_space ORDER BY (greatest(max_x, {AT[0]}) - least(min_x, {AT[0]})) * (greatest(max_y, {AT[1]}) - least(min_y, {AT[1]})) - (max_x - min_x) * (max_y - min_y), track_id LIMIT 1",
    "sequential": "SELECT 'sequential' AS strategy, track_id FROM (SELECT * FROM t ORDER BY track_id DESC LIMIT 1) WHERE has_space",
    "new": "SELECT 'new' AS strategy, track_id FROM t LIMIT 0",
}


@_query(f"WITH RECURSIVE {_PAGE}, t AS ({_TRACKS}) " + " UNION ALL ".join(f"SELECT * FROM ({q})" for q in _TRACK_COST.values()))
def best_tracks(spark, sf):
    _, _, found = _layout(spark, sf)
    tracks = layout.tracks_of(found, CONFIG)
    parts = [placement.best_track(tracks, *AT, k).select(F.lit(k).alias("strategy"), "track_id") for k in _TRACK_COST]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@_query(f"WITH RECURSIVE {_PAGE} SELECT max(page_id) + 1 AS page_id, max(track_id) + 1 AS track_id, true AS new_track FROM pages")
def allocate_page(spark, sf):
    _, _, found = _layout(spark, sf)
    return placement.allocate_page(found, layout.tracks_of(found, CONFIG), *AT, "new")


@_query(f"WITH RECURSIVE {_PAGE} SELECT page_id FROM (SELECT * FROM pages ORDER BY (cx - {AT[0]}) * (cx - {AT[0]}) + (cy - {AT[1]}) * (cy - {AT[1]}), page_id LIMIT 1) WHERE object_count < {CONFIG.page_capacity}")
def page_for_insert(spark, sf):
    _, _, found = _layout(spark, sf)
    return placement.page_for(found, *AT).select("page_id")


@_query(f"WITH RECURSIVE {_PAGE} SELECT page_id, object_count FROM pages WHERE page_id <> 1")
def free_page(spark, sf):
    laid, _, _ = _layout(spark, sf, often=True)
    return layout.pages_of(placement.free_page(laid, 1), CONFIG).select("page_id", "object_count")


@_query(f"WITH RECURSIVE {_PAGE} SELECT track_id, count(*) AS page_count FROM (SELECT CASE WHEN page_id = 1 THEN 999999 ELSE track_id END AS track_id FROM pages) GROUP BY track_id")
def move_page(spark, sf):
    laid, _, _ = _layout(spark, sf, often=True)
    return layout.tracks_of(layout.pages_of(placement.move_page(laid, 1, 999999), CONFIG), CONFIG).select("track_id", "page_count")


@_query(f"WITH RECURSIVE {_KD} SELECT (SELECT count(*) FROM kd WHERE lvl = 0) + (SELECT count(*) FROM customer) AS n_objects, true AS fits, (SELECT count(*) FROM kd WHERE lvl = 0) AS unmoved")
def place_features(spark, sf):
    """Customers placed among the orders: all are there, no page is overfull, and no order has moved."""
    laid, _, found = _layout(spark, sf, often=True)
    more = X.customer_points(spark, sf)
    grown = placement.place_features(laid, found, G.point_features(more, F.col("id") + 100000000, F.col("point.x"), F.col("point.y") + 9000.0), CONFIG)
    old = laid.select("id", F.col("page_id").alias("was"), F.col("slot").alias("at"))
    both = grown.join(old, "id", "left").withColumn("same", (F.col("was") == F.col("page_id")) & (F.col("at") == F.col("slot")))
    sizes = both.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last"), F.count_if("same").alias("same"))
    fits = (F.max("n") <= CONFIG.page_capacity) & (F.max("last") < CONFIG.page_capacity) & F.every(F.col("n") == F.col("slots"))
    return sizes.agg(F.sum("n").alias("n_objects"), fits.alias("fits"), F.sum("same").alias("unmoved"))


_QT_BOX = (0.0, 0.0, 150.0, 500.0)
_QT = f"""c AS (
  SELECT d AS depth, cx >> (20 - d) AS cx, cy >> (20 - d) AS cy, count(*) AS items FROM (
    SELECT CAST(greatest(0, least(1048575, floor(x / 150.0 * 1048576))) AS BIGINT) AS cx, CAST(greatest(0, least(1048575, floor(y / 500.0 * 1048576))) AS BIGINT) AS cy FROM ({_EVENTS})
  ), (SELECT CAST(unnest(range(0, 21)) AS INTEGER) AS d) GROUP BY ALL
)"""


@_query(f"WITH {_QT} SELECT CAST(sum(items) FILTER (depth = 0) AS BIGINT) AS total_items, 1 + 4 * count(*) FILTER (items > 8 AND depth < 20) AS total_nodes, 1 + 3 * count(*) FILTER (items > 8 AND depth < 20) AS leaf_count, coalesce(max(depth + 1) FILTER (items > 8 AND depth < 20), 0) AS max_depth FROM c")
def quadtree_stats(spark, sf):
    return quadtree.tree_stats(X.event_points(spark, sf), _QT_BOX)


@_query(f"WITH {_QT} SELECT a.depth, a.cx, a.cy, a.items FROM c a LEFT JOIN c p ON p.depth = a.depth - 1 AND p.cx = a.cx >> 1 AND p.cy = a.cy >> 1 WHERE (a.items <= 8 OR a.depth = 20) AND (a.depth = 0 OR p.items > 8)")
def quadtree_leaves(spark, sf):
    return quadtree.leaves(X.event_points(spark, sf), _QT_BOX)


@_query(f"SELECT id, CAST(CASE WHEN min_x < 75 THEN 0.0 ELSE 75.0 END AS DOUBLE) AS qx FROM (SELECT id, x AS min_x, y FROM ({_EVENTS}))")
def quadrant_bounds(spark, sf):
    e = X.event_points(spark, sf)
    whole = R.mbr(0.0, 0.0, 150.0, 500.0)
    low = F.when(F.col("point.x") < 75, R.quadrant_bounds(whole, "SW")).otherwise(R.quadrant_bounds(whole, "SE"))
    return e.select("id", low["min_x"].alias("qx"))


@_query(f"SELECT id, least(min_x, 1000.0) AS min_x, least(min_y, 25.0) AS min_y, greatest(max_x, 1000.0) AS max_x, greatest(max_y, 25.0) AS max_y FROM ({_BOXES})")
def mbr_expand_point(spark, sf):
    p = X.part_boxes(spark, sf).select("id", R.expand_point("mbr", F.lit(1000.0), F.lit(25.0)).alias("m"))
    return p.select("id", *_flat("m"))


@_query(f"SELECT id, count(*) + 1 AS n_points FROM ({_VERTICES}) GROUP BY id")
def line_add_point(spark, sf):
    longer = G.line_add_point("line", R.point(F.lit(0.0), F.lit(0.0)))
    return X.order_lines(spark, sf).select("id", F.size(longer).cast("long").alias("n_points"))


@_query(f"SELECT id, round(w * h * CASE WHEN id % 10 = 0 THEN 0.75 ELSE 1 END - w * h / 16, 4) AS area FROM ({_PARTBOX})")
def polygon_add_hole(spark, sf):
    m = F.col("mbr")
    w, h = (m["max_x"] - m["min_x"]) / 4, (m["max_y"] - m["min_y"]) / 4
    ring = F.array(R.point(m["min_x"], m["min_y"]), R.point(m["min_x"] + w, m["min_y"]), R.point(m["min_x"] + w, m["min_y"] + h), R.point(m["min_x"], m["min_y"] + h), R.point(m["min_x"], m["min_y"]))
    return X.part_boxes(spark, sf).select("id", F.round(G.polygon_area(G.polygon_add_hole("polygon", ring)), 4).alias("area"))


@_query("SELECT r_regionkey AS k, format('{:,}', CAST(r_regionkey AS BIGINT) * 1234567) AS text FROM region")
def format_number(spark, sf):
    from .functions.json import thousands

    r = X.table(spark, sf, "region")
    return r.select(F.col("r_regionkey").alias("k"), thousands(F.col("r_regionkey").cast("long") * 1234567).alias("text"))


@_query(f"SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 2 END AS line, CASE WHEN c_custkey % 3 = 0 THEN 8 END AS \"column\" FROM customer")
def json_error_position(spark, sf):
    c = X.customer_points(spark, sf)
    text = F.when(F.col("id") % 3 == 0, F.lit('{"a":\n [1, 2 }')).otherwise(F.lit('{"a": 1}'))
    return c.select("id", geojson.parse_error(text).alias("e")).select("id", "e.line", "e.column")


@_query(f"SELECT round(min(x), 2) AS min_x, min(y) AS min_y, round(max(x), 2) AS max_x, max(y) AS max_y, count(*) AS n_features FROM ({_CUSTOMERS})")
def collection_bounds(spark, sf):
    texts = geojson.collection_text(X.customer_points(spark, sf))
    found = geojson.collection_bounds(texts)
    return found.select(F.round("bounds.min_x", 2).alias("min_x"), F.col("bounds.min_y").alias("min_y"), F.round("bounds.max_x", 2).alias("max_x"), F.col("bounds.max_y").alias("max_y"), "n_features")


@_query(f"SELECT id, round(x, 2) AS x, y FROM ({_CUSTOMERS})")
def geojson_files(spark, sf):
    path = _folder(spark)
    geojson.write_geojson(X.customer_points(spark, sf), path)
    return geojson.read_geojson(spark, path, lines=True).select("id", F.round("point.x", 2).alias("x"), F.col("point.y").alias("y"))


@_query(f"SELECT id, round(x, 2) AS x, y FROM ({_CUSTOMERS})")
def geojson_stream(spark, sf):
    path = _folder(spark)
    geojson.write_geojson(X.customer_points(spark, sf), f"{path}/in")
    ingest.append_features(ingest.stream_features(spark, f"{path}/in"), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("id", F.round("point.x", 2).alias("x"), F.col("point.y").alias("y"))


@_query("SELECT 'LINESTRING' AS geom_type, 30 AS n_objects UNION ALL SELECT 'POLYGON', 50 UNION ALL SELECT 'POINT', 20")
def made_city(spark, sf):
    return stats.count_by_type(synthetic.city(spark, 30, 50, 20)).withColumn("n_objects", F.col("n_objects").cast("int"))


@_query("SELECT 'POINT' AS geom_type, count(*) AS n_objects FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'LINESTRING', count(*) FROM (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)")
def map_extract(spark, sf):
    """Customers as nodes, tagged where even; nations as ways through their customers."""
    c = X.table(spark, sf, "customer")
    none = F.create_map().cast("map<string,string>")
    nodes = c.select(F.col("c_custkey").cast("long").alias("id"), F.col("c_acctbal").cast("double").alias("lon"), F.col("c_nationkey").cast("double").alias("lat"), F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("shop"), F.lit("x"))).otherwise(none).alias("tags"))
    ways = c.groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.sort_array(F.collect_list(F.col("c_custkey").cast("long"))).alias("nodes")).withColumn("tags", F.create_map(F.lit("highway"), F.lit("road")))
    return stats.count_by_type(synthetic.map_features(nodes, ways))


@_query("SELECT true AS is_there, false AS is_elsewhere, true AS has_bytes, 0 AS n_problems")
def stored_index(spark, sf):
    path = _folder(spark)
    SpatialFrame(spark, CONFIG, X.customer_points(spark, sf)).save(path)
    row = (store.exists(spark, path), store.exists(spark, path + "x"), store.stored_bytes(spark, path) > 0, len(store.validate(spark, path)))
    return spark.createDataFrame([row], "is_there boolean, is_elsewhere boolean, has_bytes boolean, n_problems int")


@_query(f"SELECT id, x, y FROM ({_CUSTOMERS}) WHERE id % 2 = 0")
def saved_again(spark, sf):
    """A frame saved over the version that it was loaded from."""
    path = _folder(spark)
    SpatialFrame(spark, CONFIG, X.customer_points(spark, sf)).save(path)
    frame = SpatialFrame.load(spark, path)
    frame.remove_many(frame.features.where("id % 2 = 1"))
    frame.save(path)
    return _id_xy(SpatialFrame.load(spark, path).features)


@_query(
    """SELECT what, CAST(value AS DOUBLE) AS value FROM (VALUES ('count', 7.0), ('in_box', 3.0), ('at_point', 1.0), ('nearest', 1.0), ('adjacent', 3.0), ('pages', 1.0), ('total_objects', 6.0),
  ('min_x', -100.0), ('max_y', 150.0), ('got', 10.0), ('removed', 1.0), ('missing', 0.0), ('indexes', 2.0), ('loaded', 6.0)) t(what, value)"""
)
def service_calls(spark, sf):
    """Every call of a catalogue of indexes, on a few made features."""
    path, c = _folder(spark), Catalog(spark)
    c.create_index("a", CONFIG)
    c.create_index("gone")
    c.destroy_index("gone")
    geojson.write_geojson(X.customer_points(spark, sf).where("id = 10").limit(1).withColumn("point", R.point(F.lit(1.0), F.lit(2.0))), f"{path}/in")
    c.load_geojson_string("a", '{"type":"Feature","id":10,"properties":{},"geometry":{"type":"Point","coordinates":[10,20]}}')
    c.load_wkt("a", "POINT (-100 -50)")
    c.load_wkt("a", "LINESTRING (200 150, 201 140)")
    one = c.insert_point("a", 5.0, 5.0)
    c.insert_linestring("a", [(0.0, 0.0), (4.0, 4.0)])
    c.insert_polygon("a", [(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (1.0, 9.0)])
    c.insert_point("a", 90.0, 90.0)
    values = {"count": c.get_count("a"), "in_box": c.query_range("a", (0.0, 0.0, 9.0, 9.0)).count(), "got": c.get_object("a", 10).id}
    values |= {"at_point": c.query_point("a", 2.0, 8.0).count(), "nearest": float(c.query_knn("a", 90.0, 91.0, 1).first().point.x == 90.0)}
    values |= {"min_x": c.get_bounds("a")[0], "max_y": c.get_bounds("a")[3], "removed": c.remove("a", one + 3), "missing": c.remove("a", 123456)}
    c.build("a")
    values |= {"adjacent": c.query_adjacent("a", (0.0, 0.0, 9.0, 9.0)).count(), "pages": c.find_adjacent_pages("a", (0.0, 0.0, 9.0, 9.0)).count(), "total_objects": c.get_stats("a").total_objects}
    c.optimize("a")
    c.save("a", f"{path}/index")
    c.load("b", f"{path}/index")
    values |= {"loaded": c.get_count("b"), "indexes": len(c.list_indexes())}
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "what string, value double")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["queries", "oracle_sql", "SparkSession"]
