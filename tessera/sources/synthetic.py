"""Cities made by rule, and map extracts turned into features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import mbr as R
from ..functions.geometry import derive
from ..schema import LINE, POINT, POLYGON


def _unit(*parts):
    """A number from 0 to 1 that depends on the arguments alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / F.lit(float(1 << 30))


def city(spark: SparkSession, roads: int = 200, buildings: int = 500, landmarks: int = 100, extent: float = 10_000.0, seed: int = 7) -> DataFrame:
    """Roads (random walks of 5 to 10 points), rectangular buildings on a grid, and landmarks; the same for the same seed."""
    s = F.lit(seed)
    null = lambda kind: F.lit(None).cast(kind)
    i = F.col("id")

    steps = (F.lit(5) + F.floor(_unit(i, s, F.lit("n")) * 6)).cast("int")
    turn = lambda axis: F.transform(F.sequence(F.lit(1), steps), lambda k: (_unit(i, k, s, F.lit(axis)) - 0.5) * extent * 0.1)
    walk = F.aggregate(
        F.zip_with(turn("x"), turn("y"), lambda a, b: R.point(a, b)),
        F.array().cast(LINE),
        lambda acc, d: F.array_append(acc, R.point(F.coalesce(F.get(acc, F.size(acc) - 1)["x"], _unit(i, s, F.lit("x0")) * extent) + d["x"], F.coalesce(F.get(acc, F.size(acc) - 1)["y"], _unit(i, s, F.lit("y0")) * extent) + d["y"])),
    )
    lines = spark.range(1, roads + 1).select("id", F.lit("LINESTRING").alias("geom_type"), null(POINT).alias("point"), walk.cast(LINE).alias("line"), null(POLYGON).alias("polygon"))

    side = max(1, int(buildings**0.5 + 0.999))
    step = extent / side
    x, y = (i % side) * step, F.floor(i / side) * step
    w, h = 20 + F.floor(_unit(i, s, F.lit("w")) * 50), 20 + F.floor(_unit(i, s, F.lit("h")) * 50)
    ring = F.array(R.point(x, y), R.point(x + w, y), R.point(x + w, y + h), R.point(x, y + h), R.point(x, y))
    boxes = spark.range(buildings).select((i + roads + 1).alias("id"), F.lit("POLYGON").alias("geom_type"), null(POINT).alias("point"), null(LINE).alias("line"), F.struct(ring.alias("exterior"), F.array().cast(f"array<{LINE}>").alias("holes")).cast(POLYGON).alias("polygon"))

    marks = spark.range(landmarks).select((i + roads + buildings + 1).alias("id"), F.lit("POINT").alias("geom_type"), R.point(_unit(i, s, F.lit("px")) * extent, _unit(i, s, F.lit("py")) * extent).alias("point"), null(LINE).alias("line"), null(POLYGON).alias("polygon"))
    rows = lines.unionByName(boxes).unionByName(marks)
    return derive(rows.select("id", null("string").alias("id_str"), "geom_type", "point", "line", "polygon", null("string").alias("properties")))


def map_features(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Features of a map extract: nodes (id, lon, lat, tags map), ways (id, nodes array of ids, tags map).

    Nodes with tags become points; closed ways with a building tag or area=yes become polygons;
    other ways with two or more known nodes become lines.  Ids are numbered anew: points first.
    """
    tagged = nodes.where(F.size("tags") > 0).select(F.lit(0).alias("kind"), F.col("id").alias("source_id"), F.lit("POINT").alias("geom_type"), R.point(F.col("lon"), F.col("lat")).alias("point"), F.lit(None).cast(LINE).alias("line"), F.lit(None).cast(POLYGON).alias("polygon"), F.to_json("tags").alias("properties"))
    corners = ways.select("id", F.posexplode("nodes").alias("at", "node")).join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node")
    paths = corners.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "lon", "lat"))), lambda p: R.point(p["lon"], p["lat"])).alias("path"))
    shaped = ways.join(paths, "id")
    closed = (F.size("nodes") >= 4) & (F.element_at("nodes", 1) == F.element_at("nodes", -1))
    area = F.coalesce(F.col("tags").getItem("building").isNotNull() | (F.col("tags").getItem("area") == "yes"), F.lit(False))
    poly = closed & area
    found = shaped.where(poly | (F.size("path") >= 2)).select(
        F.lit(1).alias("kind"),
        F.col("id").alias("source_id"),
        F.when(poly, "POLYGON").otherwise("LINESTRING").alias("geom_type"),
        F.lit(None).cast(POINT).alias("point"),
        F.when(~poly, F.col("path")).cast(LINE).alias("line"),
        F.when(poly, F.struct(F.col("path").alias("exterior"), F.array().cast(f"array<{LINE}>").alias("holes"))).cast(POLYGON).alias("polygon"),
        F.to_json("tags").alias("properties"),
    )
    from ..plans.frame import number_rows

    ordered = tagged.unionByName(found).repartitionByRange("kind", "source_id").sortWithinPartitions("kind", "source_id")
    numbered = number_rows(ordered, 1)
    return derive(numbered.select("id", F.lit(None).cast("string").alias("id_str"), "geom_type", "point", "line", "polygon", "properties"))
