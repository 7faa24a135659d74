"""An index object over immutable feature tables, with the calls a user works with."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions import mbr as R
from ..functions.geometry import derive
from ..operators import adjacency, join, layout, placement, query, stats
from ..schema import FEATURE, RAW_FEATURE, AlreadyExists, InvalidArgument, NotFound, SpatialConfig
from ..sources import geojson, store, wkt
from ..sources.shared import settled

Box = query.Box


class SpatialFrame:
    """Features with a configuration; changes give the frame a new table, queries see it at once.

    Many small inserts make long plans: gather rows and insert them in bulk, or call
    ``compact`` now and then.
    """

    def __init__(self, spark: SparkSession, config: SpatialConfig | None = None, features: DataFrame | None = None):
        self.spark, self.config = spark, config or SpatialConfig()
        self._features = spark.createDataFrame([], FEATURE) if features is None else features
        self._placed = self._laid = self._pages = self._blocks = None

    # Tables ---------------------------------------------------------------------------

    @property
    def features(self) -> DataFrame:
        return self._features

    def _set(self, features: DataFrame) -> None:
        self.release()
        self._features = features
        if self.config.persist and self.config.data_path:
            self.sync()

    def release(self) -> None:
        """Drops what ``build`` has kept in memory."""
        for df in (self._placed, self._pages, self._blocks):
            if df is not None:
                df.unpersist()
        self._placed = self._laid = self._pages = self._blocks = None

    def build(self) -> SpatialFrame:
        """Lays the features out; later calls use this until something changes."""
        self.release()
        self._placed = layout.placed(self._features, self.config).persist()
        self._laid = self._placed.drop("x", "y", "node", "pivot")
        self._blocks = layout.kd_blocks(self._placed).persist()
        self._pages = layout.pages_of(self._laid, self.config).persist()
        return self

    optimize = build

    def _built(self) -> SpatialFrame:
        return self if self._laid is not None else self.build()

    @property
    def laid(self) -> DataFrame:
        return self._built()._laid

    @property
    def pages(self) -> DataFrame:
        return self._built()._pages

    @property
    def blocks(self) -> DataFrame:
        return self._built()._blocks

    @property
    def tracks(self) -> DataFrame:
        return layout.tracks_of(self.pages, self.config)

    # Input ----------------------------------------------------------------------------

    def _next_id(self) -> int:
        return (self._features.agg(F.max("id")).first()[0] or 0) + 1

    def bulk_insert(self, rows: DataFrame, on_duplicate: str = "error") -> int:
        """Appends feature rows; those without an id (or with 0) get ids after the largest one.

        on_duplicate: ``error`` refuses ids that are there already, ``first`` keeps the old row,
        ``replace`` the new one.  Returns the number of rows added.
        """
        if on_duplicate not in ("error", "first", "replace"):
            raise InvalidArgument(f"unknown choice {on_duplicate!r}")
        names = [f.name for f in self._features.schema]
        if "mbr" not in rows.columns or "is_valid" not in rows.columns:
            for name in ("id_str", "properties"):
                if name not in rows.columns:
                    rows = rows.withColumn(name, F.lit(None).cast("string"))
            rows = derive(rows)
        rows = rows.select(names)
        # 0 stands for no id, except where rows are replaced by it.
        asked = F.col("id").isNotNull() & ((F.col("id") != 0) | F.lit(on_duplicate == "replace"))
        given = rows.where(asked)
        if on_duplicate == "error":
            twice = given.groupBy("id").count().where("count > 1").select("id")
            clash = given.join(self._features.select("id"), "id", "left_semi").select("id").unionByName(twice).limit(1).collect()
            if clash:
                raise AlreadyExists(f"id {clash[0].id}")
        base = self._features
        if on_duplicate == "first":
            given = given.dropDuplicates(["id"]).join(base.select("id"), "id", "left_anti").select(names)
        elif on_duplicate == "replace":
            given = given.dropDuplicates(["id"])
            base = base.join(given.select("id"), "id", "left_anti").select(names)
        start = max(self._next_id(), (given.agg(F.max("id")).first()[0] or 0) + 1)
        new = number_rows(rows.where(~F.coalesce(asked, F.lit(False))).drop("id"), start).select(names)
        added = given.unionByName(new)
        n = added.count()
        self._set(base.unionByName(added))
        return n

    def _insert_one(self, kind: str, point=None, line=None, polygon=None, object_id: int | None = None, properties: str | None = None) -> int:
        object_id = object_id or self._next_id()
        if not self._features.where(F.col("id") == object_id).isEmpty():
            raise AlreadyExists(f"id {object_id}")
        row = self.spark.createDataFrame([(object_id, None, kind, point, line, polygon, properties)], RAW_FEATURE)
        self._set(self._features.unionByName(derive(row).select(self._features.columns)))
        return object_id

    def insert_point(self, x: float, y: float, **more) -> int:
        return self._insert_one("POINT", point=(float(x), float(y)), **more)

    def insert_linestring(self, points: Sequence[tuple[float, float]], **more) -> int:
        if not points:
            raise InvalidArgument("a line needs points")
        return self._insert_one("LINESTRING", line=[(float(x), float(y)) for x, y in points], **more)

    def insert_polygon(self, exterior: Sequence[tuple[float, float]], holes: Iterable[Sequence[tuple[float, float]]] = (), **more) -> int:
        if len(exterior) < 3:
            raise InvalidArgument("a polygon needs three points")
        ring = lambda r: [(float(x), float(y)) for x, y in r]
        return self._insert_one("POLYGON", polygon=(ring(exterior), [ring(h) for h in holes]), **more)

    def load_geojson(self, path: str, **options) -> int:
        return self.bulk_insert(geojson.read_geojson(self.spark, path, **options), "first")

    def load_geojson_string(self, text: str, **options) -> int:
        return self.bulk_insert(geojson.from_geojson_string(self.spark, text, **options), "first")

    def load_wkt(self, text: str | Sequence[str]) -> int:
        texts = [text] if isinstance(text, str) else list(text)
        return self.bulk_insert(wkt.from_wkt(self.spark.createDataFrame([(t,) for t in texts], "value string")))

    def remove(self, object_id: int) -> None:
        if self._features.where(F.col("id") == object_id).isEmpty():
            raise NotFound(object_id)
        self._set(self._features.where(~F.coalesce(F.col("id") == object_id, F.lit(False))))

    def remove_many(self, ids: DataFrame) -> None:
        """Removes the features of a table of ids."""
        self._set(self._features.join(ids.select("id").distinct(), "id", "left_anti").select(self._features.columns))

    def update(self, rows: DataFrame) -> None:
        """Replaces features by id; unknown ids are an error."""
        if not rows.join(self._features, "id", "left_anti").isEmpty():
            raise NotFound("an id to update")
        self.bulk_insert(rows, "replace")

    def set_properties(self, object_id: int, properties: str | None) -> None:
        changed = F.when(F.col("id") == object_id, F.lit(properties)).otherwise(F.col("properties"))
        self._set(self._features.withColumn("properties", changed))

    def clear(self) -> None:
        self._set(self._features.limit(0))

    def compact(self, path: str) -> None:
        """Writes the features and goes on from the file, so that the plan is short again."""
        self._features.write.mode("error").parquet(path)
        self._set(self.spark.read.parquet(path))

    # Queries --------------------------------------------------------------------------

    def get(self, object_id: int) -> DataFrame:
        return query.get_object(self._features, object_id)

    def query_range(self, box: Box | None) -> DataFrame:
        if box is None:
            raise InvalidArgument("a range is needed")
        return query.range_query(self._features, box)

    def query_point(self, x: float, y: float) -> DataFrame:
        return query.point_query(self._features, x, y)

    def query_knn(self, x: float, y: float, k: int, pruned: bool = False) -> DataFrame:
        """``pruned`` lays the features out first and reads only pages that can matter."""
        return query.knn_pruned(self.laid, self.pages, x, y, k) if pruned else query.knn(self._features, x, y, k)

    def query_radius(self, x: float, y: float, r: float) -> DataFrame:
        return query.radius_query(self._features, x, y, r)

    def find_adjacent_pages(self, region: Box | None) -> DataFrame:
        if region is None:
            raise InvalidArgument("a region is needed")
        return adjacency.adjacent_pages(self.pages, region)

    def query_adjacent(self, region: Box | None) -> DataFrame:
        if region is None:
            raise InvalidArgument("a region is needed")
        return adjacency.query_adjacent(self.laid, self.pages, region)

    def adjacent_to(self, object_id: int, include_self: bool = True) -> DataFrame:
        return adjacency.adjacent_items(self._features, object_id, include_self)

    def estimate_seeks(self, regions: Sequence[Box]) -> int:
        """Total seeks over the adjacent pages of each region."""
        rows = [(i, *map(float, b)) for i, b in enumerate(regions)]
        if not rows:
            return 0
        table = self.spark.createDataFrame(rows, "region_id long, a double, b double, c double, d double")
        boxes = table.select("region_id", R.mbr(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("mbr"))
        return adjacency.region_seeks(self.pages, boxes).agg(F.sum("seeks")).first()[0] or 0

    def join_regions(self, regions: DataFrame) -> DataFrame:
        return join.region_join(regions, self._features)

    def knn_join(self, queries: DataFrame, k: int) -> DataFrame:
        return join.knn_join(queries, self._features, k)

    def block_at(self, x: float, y: float) -> DataFrame:
        return layout.block_at(self.blocks, x, y)

    def blocks_in(self, box: Box) -> DataFrame:
        return layout.blocks_in_region(self.blocks, box)

    def pages_in(self, box: Box) -> DataFrame:
        return layout.pages_in_region(self.pages, box)

    def tracks_in(self, box: Box) -> DataFrame:
        return layout.tracks_in_region(self.tracks, box)

    def count(self) -> int:
        return self._features.count()

    def bounds(self) -> Box | None:
        b = stats.bounds(self._features).first().bounds
        return None if b is None else tuple(b)

    def stats(self):
        return stats.index_stats(self.laid, self.pages, self.blocks, self.config).first()

    def print_stats(self) -> None:
        print(stats.format_stats(self.stats()))

    # Storage --------------------------------------------------------------------------

    def place(self, rows: DataFrame) -> int:
        """Inserts rows with ids into pages as they are, without a new layout: each to the page nearest to it, or to new pages.

        Returns the number of rows; ids that are there already are an error.
        """
        built = self._built()
        laid, pages, blocks = built._laid, built._pages, built._blocks
        if "mbr" not in rows.columns:
            rows = derive(rows)
        rows = rows.select(self._features.columns)
        if not rows.join(self._features.select("id"), "id", "left_semi").isEmpty():
            raise AlreadyExists("an id to place")
        grown = settled(placement.place_features(laid, pages, rows, self.config), "placed")
        n = rows.count()
        features = self._features.unionByName(rows)
        self._set(features)
        self._laid, self._blocks = grown, blocks
        self._pages = layout.pages_of(grown, self.config)
        return n

    def save(self, path: str, partition_tracks: bool = False) -> None:
        """A whole snapshot as a new version; invalid features are kept under block 0."""
        laid = self.laid
        rest = self._features.where(~F.col("is_valid"))
        for name in ("block_id", "page_id", "track_id", "slot"):
            rest = rest.withColumn(name, F.lit(0).cast("int" if name == "slot" else "long"))
        store.save(path, laid.unionByName(rest.select(laid.columns)), self.pages, self.blocks, self.config, partition_tracks)

    def sync(self) -> None:
        """Writes to the configured path."""
        if not self.config.data_path:
            raise InvalidArgument("no data_path is configured")
        self.save(self.config.data_path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SpatialFrame:
        laid, pages, blocks, config = store.load(spark, path)
        names = [f.name for f in spark.createDataFrame([], FEATURE).schema]
        frame = cls(spark, dataclasses.replace(config, persist=False), laid.select(names))
        frame._laid, frame._pages, frame._blocks = laid.where("block_id > 0"), pages, blocks
        return frame


def number_rows(rows: DataFrame, start: int) -> DataFrame:
    """Gapless ids from ``start``: places in partitions plus the sizes of those before, without a global window.

    The rows are written first, so that every use of the result sees the same partitions and the same ids.
    """
    placed = settled(rows, "rows").withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    # One row per partition.
    before = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = placed.join(F.broadcast(before), "_part")
    numbered = numbered.withColumn("id", F.lit(start).cast("long") + F.col("_base") + F.col("_row") - F.col("_first"))
    return settled(numbered.drop("_part", "_row", "_n", "_first", "_base"), "numbered")
