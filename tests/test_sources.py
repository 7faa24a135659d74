"""GeoJSON, WKT, saved indexes, streams, made cities and map extracts."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import json as J
from tessera.functions.geometry import polygon_area
from tessera.plans.catalog import Catalog
from tessera.plans.frame import SpatialFrame
from tessera.schema import AlreadyExists, InvalidArgument, NotFound, SpatialConfig, StorageError
from tessera.sources import geojson, store, synthetic, wkt
from tessera.streaming.ingest import append_features, stream_features

COLLECTION = json.dumps({
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "id": 7, "properties": {"name": 'a "b"\n'}, "geometry": {"type": "Point", "coordinates": [10, 20, 5]}},
        {"type": "Feature", "id": "x9", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [10, 10]]}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[2, 2], [8, 2], [8, 8], [2, 8], [2, 2]]]}},
        {"type": "Feature", "geometry": None},
        {"type": "Feature", "geometry": {"type": "MultiPoint", "coordinates": [[1, 2]]}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1]]}},
    ],
})


def test_geojson_collection(spark):
    rows = geojson.from_geojson_string(spark, COLLECTION).collect()
    assert [r.geom_type for r in rows] == ["POINT", "LINESTRING", "POLYGON"]
    assert [r.id for r in rows] == [7, None, None] and [r.id_str for r in rows] == [None, "x9", None]
    assert tuple(rows[0].point) == (10, 20) and json.loads(rows[0].properties) == {"name": 'a "b"\n'}
    assert len(rows[2].polygon.holes) == 1
    kept = geojson.from_geojson_string(spark, COLLECTION, keep_corrupt=True)
    assert kept.where("_corrupt IS NOT NULL").count() == 3
    with pytest.raises(Exception, match="bad GeoJSON"):
        geojson.from_geojson_string(spark, COLLECTION, mode="FAILFAST").collect()


def test_geojson_roots_and_validity(spark):
    texts = ['{"type":"Point","coordinates":[1,2]}', '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}}', '{"type":"FeatureCollection","features":[]}', "not json", "{}", ""]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    assert geojson.from_geojson_strings(df).count() == 2
    assert [r[0] for r in df.select(geojson.is_valid_geojson(F.col("value"))).collect()] == [True, True, True, False, False, False]


def test_geojson_files_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(COLLECTION)
    rows = geojson.read_geojson(spark, str(tmp_path / "a.json"))
    geojson.write_geojson(rows, str(tmp_path / "out"))
    back = geojson.read_geojson(spark, str(tmp_path / "out"), lines=True)
    key = lambda df: sorted(map(str, df.select("id", "id_str", "geom_type", "point", "line", "polygon").collect()))
    assert key(back) == key(rows)
    one = json.loads(geojson.collection_text(rows).first().value)
    assert len(one["features"]) == 3


def test_wkt(spark):
    texts = ["POINT (10 20)", "  linestring(0 0, 10 10, 20 0)", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 8 2, 8 8, 2 8, 2 2))", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))", "POINT (nan 1)", "POINT (1)", "CIRCLE (1 2)", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, value string")
    rows = {r.id: r for r in wkt.from_wkt(df, id_col="i").withColumn("area", polygon_area("polygon")).collect()}
    assert sorted(rows) == [0, 1, 2, 3] and len(rows[3].polygon.exterior) == 5 and rows[2].area == 64 and rows[3].area == 100
    assert [bool(r[0]) for r in df.select(wkt.is_valid_wkt(F.col("value"))).collect()] == [True] * 4 + [False] * 5
    out = wkt.from_wkt(df, id_col="i").select("id", wkt.geometry_to_wkt(F.col("geom_type"), F.col("point"), F.col("line"), F.col("polygon")).alias("t"))
    assert {r.id: r.t for r in out.collect()}[0] == "POINT (10.000000 20.000000)"
    kinds = spark.createDataFrame([("point (1 2)",), (" LINESTRING(0 0)",), ('{"type":"Polygon"}',), ("?",)], "t string")
    assert [r[0] for r in kinds.select(wkt.detect_type(F.col("t"))).collect()] == ["POINT", "LINESTRING", "POLYGON", "POINT"]


def test_wkt_is_parsed_once(spark):
    """The plan has the patterns of the parser a few times, and not once for every use of every step."""
    df = spark.range(9).select("id", F.concat(F.lit("POLYGON ((0 0,\t4  0, 4 4 7, 0 0))"), F.when(F.col("id") < 0, "x").otherwise("")).alias("value"))
    back = wkt.from_wkt(df, id_col="id")
    plan = back.where("is_valid").select("id", polygon_area("polygon"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2
    assert [(p.x, p.y) for p in back.first().polygon.exterior] == [(0, 0), (4, 0), (4, 4), (0, 0)]


def test_json_getters(spark):
    t = F.lit('{"a":1.5,"b":true,"c":null,"d":["x","y"],"a":2}')
    r = spark.range(1).select(J.get_number(t, "$.a"), J.get_bool(t, "$.b"), J.is_null(t, "$.c"), J.get_string(t, "$.z", "none"), J.get_item(J.get_value(t, "$.d"), 1), J.thousands(F.lit(1234567))).first()
    assert tuple(r) == (1.5, True, True, "none", "y", "1,234,567")


def test_frame_changes(spark):
    f = SpatialFrame(spark)
    assert f.count() == 0 and f.bounds() is None and f.query_knn(0, 0, 3).count() == 0
    a, b, c = f.insert_point(10, 10), f.insert_point(20, 20), f.insert_point(30, 30)
    assert (a, b, c) == (1, 2, 3)
    f.remove(b)
    assert f.count() == 2 and f.get(b).first() is None
    with pytest.raises(NotFound):
        f.remove(b)
    with pytest.raises(AlreadyExists):
        f.insert_point(0, 0, object_id=1)
    with pytest.raises(InvalidArgument):
        f.insert_polygon([(0, 0), (1, 1)])
    with pytest.raises(InvalidArgument):
        f.insert_linestring([])
    with pytest.raises(InvalidArgument):
        f.query_range(None)
    assert f.insert_linestring([(0, 0), (100, 0), (100, 100), (0, 100)]) == 4
    assert f.query_range((40, -10, 60, 10)).first().id == 4
    f.set_properties(1, '{"k":1}')
    assert f.get(1).first().properties == '{"k":1}'
    assert f.load_geojson_string(COLLECTION) == 3 and f.load_wkt(["POINT (-100 -50)", "POINT (200 150)"]) == 2
    assert f.count() == 8 and f.bounds() == (-100, -50, 200, 150)
    assert f.get(7).first().geom_type == "POINT"
    f.clear()
    assert f.count() == 0


def test_save_and_load(spark, tmp_path):
    f = SpatialFrame(spark, SpatialConfig(block_size=20, page_capacity=8, pages_per_track=2))
    f.bulk_insert(synthetic.city(spark, 20, 30, 10))
    f.insert_linestring([(float("nan"), 0.0)])
    path = str(tmp_path / "idx")
    f.save(path)
    g = SpatialFrame.load(spark, path)
    assert g.count() == f.count() == 61 and g.bounds() == f.bounds() and g.config.block_size == 20
    assert sorted(map(str, g.features.collect())) == sorted(map(str, f.features.collect()))
    assert g.insert_point(1, 1) == f.features.agg(F.max("id")).first()[0] + 1
    assert store.exists(spark, path) and not store.exists(spark, path + "x") and store.stored_bytes(spark, path) > 0
    with pytest.raises(StorageError):
        SpatialFrame.load(spark, path + "x")
    assert f.find_adjacent_pages((0, 0, 3000, 3000)).count() > 0
    assert f.estimate_seeks([(0, 0, 3000, 3000)]) >= 0 and f.estimate_seeks([]) == 0


def test_catalog(spark, tmp_path):
    c = Catalog(spark)
    with pytest.raises(InvalidArgument):
        c.create_index("")
    c.create_index("a")
    with pytest.raises(AlreadyExists):
        c.create_index("a")
    with pytest.raises(NotFound):
        c.query_point("b", 0, 0)
    for x, y in ((0, 0), (1, 1), (2, 2), (10, 10), (20, 20)):
        c.insert_point("a", x, y)
    assert c.get_count("a") == 5 and [r.id for r in c.query_knn("a", 0.5, 0.5, 3).collect()] == [1, 2, 3]
    assert c.build("a") > 0 and c.get_stats("a").total_objects == 5 and c.get_bounds("a") == (0, 0, 20, 20)
    assert c.remove("a", 1) is True and c.remove("a", 1) is False and c.get_object("a", 1) is None
    with pytest.raises(InvalidArgument):
        c.insert_linestring("a", [(0, 0)])
    assert c.query_adjacent("a", (0, 0, 5, 5)).count() == 2 and c.find_adjacent_pages("a", (0, 0, 5, 5)).count() == 1
    c.save("a", str(tmp_path / "a"))
    c.load("b", str(tmp_path / "a"))
    assert c.list_indexes() == ["a", "b"] and c.get_count("b") == 4 and c.version()
    c.destroy_index("a")
    assert c.list_indexes() == ["b"]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"type": "Feature", "id": 10 * i + k, "geometry": {"type": "Point", "coordinates": [i, k]}}) for k in range(4)))
    seen = []
    q = append_features(stream_features(spark, str(src), max_files=1), str(tmp_path / "out"), str(tmp_path / "cp"), lambda df, n: seen.append(df.count()))
    q.awaitTermination()
    assert seen == [4, 4, 4] and spark.read.parquet(str(tmp_path / "out")).select("id").distinct().count() == 12


def test_made_city_repeats(spark):
    a, b = (synthetic.city(spark, 5, 9, 4).orderBy("id").collect() for _ in range(2))
    assert a == b and [r.id for r in a] == list(range(1, 19)) and all(r.is_valid for r in a)
    assert {r.geom_type for r in a} == {"POINT", "LINESTRING", "POLYGON"}


def test_map_extract(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, {}), (2, 1.0, 0.0, {}), (3, 1.0, 1.0, {}), (4, 5.0, 5.0, {"shop": "x"})], "id long, lon double, lat double, tags map<string,string>")
    ways = spark.createDataFrame([(10, [1, 2, 3, 1], {"building": "yes"}), (11, [1, 2, 99], {"highway": "y"}), (12, [99], {})], "id long, nodes array<long>, tags map<string,string>")
    rows = synthetic.map_features(nodes, ways).orderBy("id").collect()
    assert [(r.id, r.geom_type) for r in rows] == [(1, "POINT"), (2, "POLYGON"), (3, "LINESTRING")]
    assert len(rows[1].polygon.exterior) == 4 and json.loads(rows[0].properties) == {"shop": "x"}
