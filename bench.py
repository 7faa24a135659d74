"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: cores (default 8).  Each
query runs once to warm up and then three times over cached or Parquet input, and the
median counts.  Rates compare with the reference's: features loaded, regions and
neighbours answered in a batch, and the share of row groups that a box query reads.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH")) if x)

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from tessera import fixtures as X  # noqa: E402
from tessera.catalogue import AT, BOX, CONFIG  # noqa: E402
from tessera.operators import adjacency, join, layout, query, stats  # noqa: E402
from tessera.plans.frame import SpatialFrame  # noqa: E402
from tessera.sources import geojson, synthetic  # noqa: E402


def sides(extent, share: float):
    """The middle box whose sides are this share of the extent's."""
    x0, y0, x1, y1 = extent
    mx, my, w, h = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) * share / 2, (y1 - y0) * share / 2
    return mx - w, my - h, mx + w, my + h


def run(df) -> int:
    """All rows and columns, without a sink's cost."""
    df.write.mode("overwrite").format("noop").save()
    return 0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    work = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.default.parallelism", str(cpus))
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{work}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    rates: dict[str, float] = {}

    def timed(name: str, f, rows: int | None = None, repeat: int = 3) -> None:
        f()
        took = []
        for _ in range(repeat):
            t = time.perf_counter()
            f()
            took.append(time.perf_counter() - t)
        times[name] = round(statistics.median(took), 4)
        if rows:
            rates[name] = round(rows / times[name])

    points = X.orders_points(spark, sf)
    n = points.count()
    frame = SpatialFrame(spark, CONFIG, points)
    frame.save(f"{work}/index")
    saved = SpatialFrame.load(spark, f"{work}/index")
    extent = saved.bounds()

    # Load: GeoJSON texts to features.
    city = synthetic.city(spark, 20_000, 60_000, 20_000)
    geojson.write_geojson(city, f"{work}/city")
    timed("load_geojson", lambda: run(geojson.read_geojson(spark, f"{work}/city", lines=True)), 100_000)
    timed("build_layout", lambda: run(layout.layout(points, CONFIG, n)[0]), n)

    feats = saved.features.persist()
    feats.count()
    for share in (0.01, 0.05, 0.25, 1.0):
        timed(f"range_{round(100 * share)}", lambda: query.range_query(feats, sides(extent, share)).count())  # noqa: B023
    timed("range_flagship", lambda: run(query.range_query(feats, BOX)))
    timed("knn_10", lambda: query.knn(feats, *AT, 10).collect())
    timed("knn_10_pruned", lambda: query.knn_pruned(saved.laid, saved.pages, *AT, 10).collect())
    timed("adjacent_pages_25", lambda: adjacency.adjacent_pages(saved.pages, sides(extent, 0.25)).count())
    timed("stats", lambda: stats.index_stats(saved.laid, saved.pages, saved.blocks, CONFIG).collect())

    # Batches: thousands of regions and queries in one job.
    w, h = (extent[2] - extent[0]) * 0.01, (extent[3] - extent[1]) * 0.01
    at = spark.range(5000).select("id", (F.rand(1) * (extent[2] - extent[0]) + extent[0]).alias("x"), (F.rand(2) * (extent[3] - extent[1]) + extent[1]).alias("y")).persist()
    regions = at.select(F.col("id").alias("region_id"), F.struct(F.col("x").alias("min_x"), F.col("y").alias("min_y"), (F.col("x") + w).alias("max_x"), (F.col("y") + h).alias("max_y")).alias("mbr"))
    timed("region_join_5000", lambda: run(join.region_join(regions, feats)), 5000)
    asked = at.select(F.col("id").alias("query_id"), "x", "y")
    timed("knn_join_5000", lambda: run(join.knn_join(asked, feats, 10)), 5000, 2)
    timed("adjacency_pairs", lambda: run(adjacency.adjacency_pairs(X.part_boxes(spark, sf).limit(5000))), None, 2)

    print(json.dumps({"metric": "total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rates_per_sec": rates, "rows": n, "sf": sf}))


if __name__ == "__main__":
    main()
