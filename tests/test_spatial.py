"""Queries, layout, adjacency and joins on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import mbr as R
from tessera.functions.geometry import features_from, make_polygon, point_features
from tessera.operators import adjacency, join, layout, query, stats
from tessera.schema import InvalidArgument, SpatialConfig
from tessera.sources.shared import in_plan


def pts(spark, rows):
    return point_features(spark.createDataFrame([(i, float(x), float(y)) for i, x, y in rows], "i long, x double, y double"), F.col("i"), F.col("x"), F.col("y"))


def boxes(spark, rows):
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "i double, a double, b double, c double, d double")
    ring = F.array(R.point(F.col("a"), F.col("b")), R.point(F.col("c"), F.col("b")), R.point(F.col("c"), F.col("d")), R.point(F.col("a"), F.col("d")))
    return features_from(df, F.col("i"), "POLYGON", make_polygon(ring))


def ids(df, name="id"):
    return [r[name] for r in df.select(name).collect()]


def test_point_queries(spark):
    five = pts(spark, [(1, 5, 5), (2, 2, 3), (3, 8, 7), (4, 1, 1), (5, 9, 9)])
    assert ids(query.nearest(five, 2.5, 3.5)) == [2]
    assert sorted(ids(query.centroid_range(five, (0, 0, 6, 6)))) == [1, 2, 4]
    assert sorted(ids(query.range_query(five, (6, 6, 0, 0)))) == []  # inverted
    assert sorted(ids(query.radius_query(pts(spark, [(1, 0, 0), (2, 1, 0), (3, 0, 1), (4, 10, 10)]), 0, 0, 1.5))) == [1, 2, 3]
    line = pts(spark, [(2, 1, 1), (1, 0, 0), (3, 2, 2), (4, 10, 10), (5, 20, 20)])
    assert ids(query.knn(line, 0.5, 0.5, 2)) == [1, 2]  # a tie goes by id
    assert ids(query.knn(line, 0.5, 0.5, 0)) == [] and len(ids(query.knn(line, 0, 0, 99))) == 5
    assert ids(query.get_object(line, 3)) == [3] and ids(query.get_object(line, 33)) == []


def test_box_queries(spark):
    four = boxes(spark, [(1, 10, 10, 20, 20), (2, 60, 10, 70, 20), (3, 10, 60, 20, 70), (4, 60, 60, 70, 70)])
    assert ids(query.range_query(four, (0, 0, 50, 50))) == [1]
    assert sorted(ids(query.range_query(four, (0, 50, 100, 100)))) == [3, 4]
    three = boxes(spark, [(1, 10, 10, 30, 30), (2, 20, 20, 40, 40), (3, 60, 60, 80, 80)])
    assert sorted(ids(query.point_query(three, 25, 25))) == [1, 2] and ids(query.point_query(three, 70, 70)) == [3]
    touching = boxes(spark, [(1, 10, 10, 30, 30), (2, 30, 10, 50, 30), (3, 60, 60, 80, 80)])
    assert sorted(ids(adjacency.adjacent_items(touching, 1))) == [1, 2]
    assert ids(adjacency.adjacent_items(touching, 1, include_self=False)) == [2]
    assert [tuple(r) for r in adjacency.adjacency_pairs(touching).collect()] == [(1, 2)]
    assert sorted(ids(query.item_radius(three, 20, 20, 5))) == [1]


def test_range_plan_reaches_the_scan(spark, tmp_path):
    pts(spark, [(i, i, i) for i in range(50)]).write.parquet(str(tmp_path / "f"))
    plan = query.range_query(spark.read.parquet(str(tmp_path / "f")), (3, 3, 7, 7)).select("id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(mbr.max_x,3.0)" in plan and "LessThanOrEqual(mbr.min_x,7.0)" in plan


def test_blocks_match_the_size_recursion(spark):
    rng = random.Random(1)
    for n, want in ((2781, 8), (859, 2)):
        f = pts(spark, [(i, rng.random(), rng.random()) for i in range(n)])
        blocks = layout.kd_blocks(layout.kd_nodes(f, SpatialConfig(block_size=512))).collect()
        assert len(blocks) == want and sum(b.stored_count for b in blocks) == n and max(b.object_count for b in blocks) <= 512
    grid = pts(spark, [(10 * i + j, i, j) for i in range(10) for j in range(10)])
    assert layout.kd_blocks(layout.kd_nodes(grid, SpatialConfig(block_size=25))).count() >= 4
    assert [layout.tree_depth(n) for n in (2324, 859, 2781)] == [12, 10, 12]


def test_layout_keeps_every_feature_once(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(50), rng.randrange(50)) for i in range(1500)]  # many equal coordinates
    config = SpatialConfig(block_size=200, page_capacity=16, pages_per_track=4)
    laid, blocks = layout.layout(pts(spark, rows), config)
    pages = layout.pages_of(laid, config)
    assert sorted(ids(laid)) == list(range(1500))
    assert max(r.object_count for r in pages.collect()) <= 16 and pages.agg(F.sum("object_count")).first()[0] == 1500
    tracks = layout.tracks_of(pages, config).collect()
    assert max(t.page_count for t in tracks) <= 4 and sum(t.object_count for t in tracks) == 1500
    box = (10, 10, 30, 20)
    want = sorted(i for i, x, y in rows if 10 <= x <= 30 and 10 <= y <= 20)
    assert sorted(ids(adjacency.query_adjacent(laid, pages, box))) == want
    got = [(r.id, r.d2) for r in query.knn_pruned(laid, pages, 25.0, 25.0, 9).collect()]
    assert got == sorted(((i, (x - 25) ** 2 + (y - 25) ** 2) for i, x, y in rows), key=lambda t: (t[1], t[0]))[:9]
    assert layout.verify_pages(laid, pages).count() == 0
    s = stats.index_stats(laid, pages, blocks, config).first()
    assert s.total_objects == 1500 and s.total_pages == pages.count() and s.total_blocks == blocks.count()
    assert "objects" in stats.format_stats(s)
    one = layout.block_at(blocks, 25.0, 25.0).collect()
    assert len(one) <= 1 and layout.find_leaf(blocks, -1e6, -1e6).count() == 1


def test_coarse_splits_hold_all_rows(spark):
    rng = random.Random(3)
    f = pts(spark, [(i, rng.random(), rng.random()) for i in range(4000)])
    laid, blocks = layout.layout(f, SpatialConfig(block_size=300, exact_rows=1000))
    assert laid.count() == 4000 and max(b.object_count for b in blocks.collect()) <= 300


def test_layout_does_not_depend_on_exact_rows(spark):
    """Medians by counting are those of windows, also with a third of the rows at one x and split points stored."""
    rng = random.Random(7)
    rows = [(i, 5.0 if i % 3 == 0 else rng.random() * 9, rng.choice([1.0, rng.random()])) for i in range(900)]
    f = pts(spark, rows).persist()
    found = []
    for exact_rows in (4_000_000, 200):
        config = SpatialConfig(block_size=100, page_capacity=16, exact_rows=exact_rows)
        laid, blocks = layout.layout(f, config)
        assert max(b.object_count for b in blocks.collect()) <= 100
        found.append((sorted((r.id, r.block_id, r.page_id, r.track_id, r.slot) for r in laid.collect()), sorted(map(repr, blocks.collect()))))
    assert found[0] == found[1]
    nodes = [{r.id: (r.node, r.pivot) for r in layout.kd_nodes(f, SpatialConfig(block_size=100, exact_rows=n)).collect()} for n in (4_000_000, 20)]
    assert nodes[0] == nodes[1]


def test_seeks(spark):
    pages = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 2)], "page_id int, track_id int")
    assert tuple(adjacency.estimate_seeks(pages).first()) == (4, 1)
    assert tuple(adjacency.estimate_seeks(pages, ("page_id",)).first()) == (4, 3)
    rated = spark.createDataFrame([(0.29,), (0.3,), (0.5,), (0.7,)], "r double").select(adjacency.seek_rating(F.col("r")))
    assert [r[0] for r in rated.collect()] == ["EXCELLENT", "GOOD", "OK", "POOR"]


def test_spatial_join_agrees_with_all_pairs(spark):
    rng = random.Random(4)

    def some(n):
        out = []
        for i in range(n):
            x, y, w, h = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0, 1, 3, 40]), rng.choice([0, 1, 2, 60])
            out.append((i, round(x), round(y), round(x) + w, round(y) + h))
        return out

    a, b = some(60), some(50)
    got = [(r.left_id, r.right_id) for r in join.spatial_join(boxes(spark, a), boxes(spark, b)).collect()]
    want = [(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("small", [0, 1000])
def test_knn_join_agrees_with_all_pairs(spark, small):
    rng = random.Random(5)
    p = [(i, rng.randrange(30), rng.gauss(0, 5)) for i in range(300)]
    q = [(i, rng.randrange(-10, 60), rng.gauss(0, 9)) for i in range(40)]
    asked = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in q], "query_id long, x double, y double")
    got = sorted((r.query_id, r["rank"], r.id) for r in join.knn_join(asked, pts(spark, p), 4, small=small).collect())
    want = []
    for i, x, y in q:
        near = sorted(p, key=lambda t: ((t[1] - x) ** 2 + (t[2] - y) ** 2, t[0]))[:4]
        want += [(i, k + 1, t[0]) for k, t in enumerate(near)]
    assert got == sorted(want)


def test_knn_join_of_outlying_queries(spark):
    """Queries many extents away from all features keep their neighbours on the grid path."""
    rng = random.Random(6)
    p = [(i, rng.random(), rng.random()) for i in range(80)]
    q = [(0, 0.5, 0.5), (1, 100.0, 100.0), (2, -3000.0, 0.2), (3, 7.0, -1e7)]
    asked = spark.createDataFrame(q, "query_id long, x double, y double")
    got = sorted((r.query_id, r["rank"], r.id) for r in join.knn_join(asked, pts(spark, p), 3, small=0).collect())
    want = []
    for i, x, y in q:
        near = sorted(p, key=lambda t: ((t[1] - x) ** 2 + (t[2] - y) ** 2, t[0]))[:3]
        want += [(i, k + 1, t[0]) for k, t in enumerate(near)]
    assert got == sorted(want)


def test_stats_of_an_empty_table(spark):
    none = pts(spark, [(1, 1, 1)]).limit(0)
    assert stats.bounds(none).first().bounds is None and stats.count_objects(none).first()[0] == 0
    laid, blocks = layout.layout(none)
    pages = layout.pages_of(laid)
    assert stats.index_stats(laid, pages, blocks).first().total_objects == 0 and blocks.count() == 0
    with pytest.raises(InvalidArgument):
        SpatialConfig(block_size=0)


def test_quad_stats_beyond_the_box(spark):
    """Cells outside the box are cells of their own, as in the SQL."""
    f = pts(spark, [(1, 1, 1), (2, 9, 9), (3, 11, 9), (4, 25, 9), (5, -1, 9), (6, 25.5, 9)])
    assert tuple(stats.quad_stats(f, (0.0, 0.0, 10.0, 10.0), 1).first()) == (5, 6, 2)


def test_joins_compare_copies_once(spark):
    """Equal rectangles meet as packs, and no round of a kNN join stays in the plan of the next."""
    same = [(i, 1, 1, 2, 2) for i in range(70)] + [(i, 2, 2, 3, 3) for i in range(70, 80)]
    f = boxes(spark, same).select("id", "mbr")
    packs = join.packed_join(f, f, once=True).select(F.size("left_ids").alias("a"), F.size("right_ids").alias("b")).collect()
    assert sorted(tuple(r) for r in packs) == [(6, 6), (6, 10), (10, 10), (64, 6), (64, 10), (64, 64)]
    assert sorted(tuple(r) for r in adjacency.adjacency_pairs(f).collect()) == [(i, j) for i in range(80) for j in range(i + 1, 80)]
    assert adjacency.adjacency_pairs(f, include_self=True).count() == 80 * 81 // 2
    asked = spark.createDataFrame([(i, float(i % 2), 0.0) for i in range(6)], "query_id long, x double, y double")
    near = join.knn_join(asked, pts(spark, [(i, i % 3, 0) for i in range(30)]), 2, small=0)
    assert "InMemoryRelation" not in near._jdf.queryExecution().toString()
    assert sorted((r.query_id, r["rank"], r.id) for r in near.collect()) == sorted((i, k + 1, i % 2 + 3 * k) for i in range(6) for k in range(2))


def test_layout_gives_a_task_few_rows(spark, monkeypatch):
    """Nodes are split by counting down to what one Python task may hold, also below ``exact_rows``."""
    rng = random.Random(8)
    f = pts(spark, [(i, rng.randrange(40), rng.random()) for i in range(900)]).persist()
    config = SpatialConfig(block_size=50, page_capacity=16)
    found = []
    for most in (1 << 19, 200):
        monkeypatch.setattr(layout, "TASK_ROWS", most)
        points = f.select("id", F.col("centroid.x").alias("x"), F.col("centroid.y").alias("y"), F.lit("").alias("node"), F.lit(False).alias("pivot"))
        _, levels, left = layout._counted(points, 900, config)
        assert left <= most and levels == (0 if most > 900 else 3)
        found.append(sorted(tuple(r) for r in layout.placed(f, config).select("id", "block_id", "page_id", "track_id", "slot", "node", "pivot").collect()))
    assert found[0] == found[1]


def test_a_task_of_the_layout_is_small():
    """The most features that a task may hold are split in less than 20 MB beside their input."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng, n = np.random.default_rng(9), layout.TASK_ROWS
    ids, x, y = np.arange(n), rng.random(n), rng.random(n)
    for _ in range(2):  # what the first call loads is not the task's
        before = pa.total_allocated_bytes()
        tracemalloc.start()
        found = layout._split(1, ids, (x, y), np.zeros(n, bool), n, SpatialConfig())
        taken = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before
        tracemalloc.stop()
    assert taken < 20_000_000, taken
    assert found.schema.field("node").type == pa.int64() and np.array_equal(np.sort(found["id"].to_numpy()), ids)
    blocks, counts = np.unique(found["block_id"].to_numpy(), return_counts=True)
    assert list(blocks) == list(range(1, layout.leaves(n, 1024) + 1)) and counts.max() <= 1024 + 20


def test_counting_of_medians_starts_no_python(spark):
    """Split points go out with the plan: a layout's only Python on the executors is the split of its nodes."""
    points = spark.range(3000).select("id", (F.col("id") * 37 % 1000).cast("double").alias("x"), (F.col("id") * 91 % 777).cast("double").alias("y"), F.lit(False).alias("pivot"))
    found, levels, _ = layout._counted(points, 3000, SpatialConfig(block_size=10, exact_rows=400))
    assert levels == 3 and found.where("pivot").count() == 7
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
    empty = in_plan(spark, [], "node long, _v double, _i string")
    assert empty.collect() == [] and empty.dtypes == [("node", "bigint"), ("_v", "double"), ("_i", "string")]
    assert [tuple(r) for r in in_plan(spark, [(1, -0.0, "a"), (2**62, 1e300, None)], "node long, _v double, _i string").collect()] == [(1, -0.0, "a"), (2**62, 1e300, None)]
