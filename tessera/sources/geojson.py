"""GeoJSON in and out, parsed and written by Spark's JSON functions.

A document is a FeatureCollection, a Feature or a bare geometry.  Points, LineStrings
and Polygons with holes are read; other features are skipped, kept as corrupt rows, or an
error, by ``mode``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import mbr as R
from ..functions.geometry import derive, let
from ..schema import LINE, POINT, POLYGON, InvalidArgument, ParseError

_ROOT = "type string, features array<string>, geometry string"
_FEATURE = "type string, id variant, geometry string, properties string"
_GEOMETRY = "type string, coordinates string"


def _point(coords: Column) -> Column:
    """First two ordinates; null for fewer."""
    return F.when((F.size(coords) >= 2) & F.get(coords, F.lit(0)).isNotNull() & F.get(coords, F.lit(1)).isNotNull(), F.struct(F.get(coords, F.lit(0)).alias("x"), F.get(coords, F.lit(1)).alias("y")))


def _strict_points(coords: Column) -> Column:
    """All points, or null if any is bad."""
    points = F.transform(coords, _point)
    return F.when(F.forall(points, lambda p: p.isNotNull()), points)


def _good_points(coords: Column) -> Column:
    return F.filter(F.transform(F.coalesce(coords, F.array().cast("array<array<double>>")), _point), lambda p: p.isNotNull())


def _shape(g: Column) -> Column:
    """A parsed geometry (type, coordinates) as a struct; coordinates are read once, as its type says."""
    typed = F.struct(
        F.when(g["type"] == "Point", F.from_json(g["coordinates"], "array<double>")).alias("flat"),
        F.when(g["type"] == "LineString", F.from_json(g["coordinates"], "array<array<double>>")).alias("path"),
        F.when(g["type"] == "Polygon", F.from_json(g["coordinates"], "array<array<array<double>>>")).alias("rings"),
    )

    def build(c: Column) -> Column:
        rings = c["rings"]
        holes = F.transform(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), _good_points)
        parts = F.struct(
            _point(c["flat"]).cast(POINT).alias("point"),
            _strict_points(c["path"]).cast(LINE).alias("line"),
            F.when(F.size(rings) >= 1, let(_strict_points(F.get(rings, F.lit(0))), lambda e: F.when(e.isNotNull(), F.struct(e.alias("exterior"), holes.alias("holes"))))).cast(POLYGON).alias("polygon"),
        )
        kind = lambda p: F.when(p["point"].isNotNull(), "POINT").when(p["line"].isNotNull(), "LINESTRING").when(p["polygon"].isNotNull(), "POLYGON")
        return let(parts, lambda p: F.struct(kind(p).alias("geom_type"), p["point"].alias("point"), p["line"].alias("line"), p["polygon"].alias("polygon")))

    return let(typed, build)


def geometry_from_geojson(text: Column) -> Column:
    """Struct geom_type, point, line, polygon of one geometry; all null if it is not supported or malformed."""
    return let(F.from_json(text, _GEOMETRY), _shape)


def geojson_type(text: Column) -> Column:
    return F.from_json(text, "type string")["type"]


def is_valid_geojson(text: Column) -> Column:
    """Whether a text is a GeoJSON document; one without usable features is still valid."""
    kinds = ("FeatureCollection", "Feature", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
    return F.coalesce(geojson_type(text).isin(*kinds), F.lit(False))


def split_features(docs: DataFrame, text: str = "value") -> DataFrame:
    """One row per feature of each document: doc (text) becomes feature (text); a bare geometry is wrapped."""
    root = F.from_json(F.col(text), _ROOT)
    wrapped = F.concat(F.lit('{"type":"Feature","geometry":'), F.col(text), F.lit("}"))
    parts = (
        F.when(root["type"] == "FeatureCollection", F.coalesce(root["features"], F.array().cast("array<string>")))
        .when(root["type"] == "Feature", F.array(F.col(text)))
        .when(root["type"].isNotNull(), F.array(wrapped))
        .otherwise(F.array(F.lit(None).cast("string")))
    )
    return docs.select(*[c for c in docs.columns if c != text], F.explode(parts).alias("feature"))


def parse_features(rows: DataFrame, feature: str = "feature", mode: str = "PERMISSIVE", keep_corrupt: bool = False) -> DataFrame:
    """Features of a column of GeoJSON features.

    mode PERMISSIVE skips bad features (or keeps them with ``_corrupt`` set, if asked to),
    FAILFAST raises when the bad row is read.
    """
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise InvalidArgument(f"unknown mode {mode!r}")
    def read(f: Column) -> Column:
        kind = F.schema_of_variant(f["id"])
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return F.struct(
            F.coalesce(numeric, F.lit(False)).alias("num"),
            F.when(f["id"].isNotNull() & (kind != "VOID"), F.variant_get(f["id"], "$", "string")).alias("id"),
            f["properties"].alias("properties"),
            geometry_from_geojson(f["geometry"]).alias("g"),
        )

    # The generator keeps filters above from repeating the parse below.
    parsed = rows.select("*", F.explode(F.array(let(F.from_json(F.col(feature), _FEATURE), read))).alias("f")).select("*", F.col("f.g").alias("g"))
    bad = F.col("g.geom_type").isNull()
    if mode == "FAILFAST":
        fail = F.raise_error(F.concat(F.lit("bad GeoJSON feature: "), F.coalesce(F.substring(feature, 1, 200), F.lit("null"))))
        parsed = parsed.withColumn("_ok", F.when(bad, fail.cast("boolean")).otherwise(F.lit(True))).where("_ok")
    elif not keep_corrupt:
        parsed = parsed.where(~bad)
    known = F.col("f.num")
    out = parsed.select(
        F.when(known, F.coalesce(F.expr("try_cast(f.id AS bigint)"), F.expr("try_cast(try_cast(f.id AS double) AS bigint)"))).alias("id"),
        F.when(~known, F.col("f.id")).alias("id_str"),
        F.col("g.geom_type").alias("geom_type"),
        F.col("g.point").alias("point"),
        F.col("g.line").alias("line"),
        F.col("g.polygon").alias("polygon"),
        F.col("f.properties").alias("properties"),
        *([F.when(bad, F.coalesce(F.col(feature), F.lit(""))).alias("_corrupt")] if keep_corrupt else []),
    )
    return derive(out)


def read_geojson(spark: SparkSession, path, lines: bool = False, **options) -> DataFrame:
    """Features of files: one document a file, or with ``lines`` one feature a line (splittable, for large inputs)."""
    docs = spark.read.text(path, wholetext=not lines)
    if lines:
        docs = docs.where(F.trim("value") != "")
    return parse_features(split_features(docs), **options)


def from_geojson_strings(docs: DataFrame, text: str = "value", **options) -> DataFrame:
    return parse_features(split_features(docs.select(F.col(text).alias("value"))), **options)


def from_geojson_string(spark: SparkSession, text: str, **options) -> DataFrame:
    docs = spark.createDataFrame([(text,)], "value string")
    if options.get("mode") == "FAILFAST" and not docs.select(is_valid_geojson(F.col("value"))).first()[0]:
        raise ParseError("not a GeoJSON document")
    return from_geojson_strings(docs, **options)


def collection_bounds(docs: DataFrame, text: str = "value") -> DataFrame:
    """One row: the rectangle (bounds) around all features of the documents, null without any, and their number."""
    return from_geojson_strings(docs, text).agg(R.bounds_of("mbr").alias("bounds"), F.count(F.lit(1)).alias("n_features"))


def parse_error(text: Column) -> Column:
    """Struct line, column, message: where a text stops being JSON, from 1, and why; all null for a text that is JSON."""

    @F.pandas_udf(StructType([StructField("line", IntegerType()), StructField("column", IntegerType()), StructField("message", StringType())]))
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                json.loads(t if t is not None else "")
                rows.append((None, None, None))
            except json.JSONDecodeError as e:
                rows.append((e.lineno, e.colno, e.msg))
        return pd.DataFrame(rows, columns=["line", "column", "message"]).astype({"line": "Int32", "column": "Int32"})

    return found(text)


def _num(v: Column, decimals: int | None) -> Column:
    return v.cast("string") if decimals is None else F.format_string(f"%.{decimals}f", v)


def _coords(points: Column, decimals: int | None) -> Column:
    each = F.transform(points, lambda p: F.concat(F.lit("["), _num(p["x"], decimals), F.lit(","), _num(p["y"], decimals), F.lit("]")))
    return F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))


def geometry_to_geojson(geom_type, point, line, polygon, decimals: int | None = 6) -> Column:
    """Geometry as GeoJSON text, holes included; ``decimals`` None writes the shortest exact numbers."""
    p, ring = point, F.concat(F.array(polygon["exterior"]), F.coalesce(polygon["holes"], F.array().cast(f"array<{LINE}>")))
    body = (
        F.when(geom_type == "POINT", F.concat(F.lit('{"type":"Point","coordinates":['), _num(p["x"], decimals), F.lit(","), _num(p["y"], decimals), F.lit("]}")))
        .when(geom_type == "LINESTRING", F.concat(F.lit('{"type":"LineString","coordinates":'), _coords(line, decimals), F.lit("}")))
        .when(geom_type == "POLYGON", F.concat(F.lit('{"type":"Polygon","coordinates":['), F.array_join(F.transform(ring, lambda r: _coords(r, decimals)), ","), F.lit("]}")))
    )
    return body


def feature_to_geojson(decimals: int | None = 6) -> Column:
    """A feature row as GeoJSON text with id and properties."""
    geometry = geometry_to_geojson(F.col("geom_type"), F.col("point"), F.col("line"), F.col("polygon"), decimals)
    quoted = F.to_json(F.struct(F.col("id_str").alias("i")))
    own_id = F.when(F.col("id").isNotNull(), F.concat(F.lit('"id":'), F.col("id").cast("string"), F.lit(","))).when(
        F.col("id_str").isNotNull(), F.concat(F.lit('"id":'), F.regexp_extract(quoted, r'^\{"i":(.*)\}$', 1), F.lit(","))
    )
    return F.concat(F.lit('{"type":"Feature",'), F.coalesce(own_id, F.lit("")), F.lit('"properties":'), F.coalesce(F.col("properties"), F.lit("{}")), F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}"))


def write_geojson(features: DataFrame, path: str, decimals: int | None = 6, mode: str = "error") -> None:
    """One feature a line, in parallel; readable with ``read_geojson(lines=True)``."""
    features.select(feature_to_geojson(decimals).alias("value")).write.mode(mode).text(path)


def collection_text(features: DataFrame, decimals: int | None = 6) -> DataFrame:
    """All features as one FeatureCollection text (column value); for results that fit in one row."""
    rows = features.select(F.col("id"), feature_to_geojson(decimals).alias("f"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("id", "f"))), lambda r: r["f"])
    return rows.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(ordered, ","), F.lit("]}")).alias("value"))
