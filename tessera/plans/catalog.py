"""Named indexes: the service's calls, without the network."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from .. import __version__
from ..schema import AlreadyExists, InvalidArgument, NotFound, SpatialConfig
from .frame import Box, SpatialFrame


class Catalog:
    """A session's indexes by id, each call named after what it does to one of them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._frames: dict[str, SpatialFrame] = {}

    def _new(self, index_id: str) -> None:
        if not index_id:
            raise InvalidArgument("an index id is needed")
        if index_id in self._frames:
            raise AlreadyExists(index_id)

    def index(self, index_id: str) -> SpatialFrame:
        if index_id not in self._frames:
            raise NotFound(index_id)
        return self._frames[index_id]

    def create_index(self, index_id: str, config: SpatialConfig | None = None) -> SpatialFrame:
        self._new(index_id)
        self._frames[index_id] = SpatialFrame(self.spark, config)
        return self._frames[index_id]

    def destroy_index(self, index_id: str) -> None:
        self.index(index_id).release()
        del self._frames[index_id]

    def list_indexes(self) -> list[str]:
        return sorted(self._frames)

    def load_geojson(self, index_id: str, path: str) -> int:
        return self.index(index_id).load_geojson(path)

    def load_geojson_string(self, index_id: str, text: str) -> int:
        return self.index(index_id).load_geojson_string(text)

    def load_wkt(self, index_id: str, text: str) -> int:
        return self.index(index_id).load_wkt(text)

    def insert_point(self, index_id: str, x: float, y: float) -> int:
        return self.index(index_id).insert_point(x, y)

    def insert_linestring(self, index_id: str, points) -> int:
        if len(points) < 2:
            raise InvalidArgument("a line needs two points")
        return self.index(index_id).insert_linestring(points)

    def insert_polygon(self, index_id: str, exterior, holes=()) -> int:
        return self.index(index_id).insert_polygon(exterior, holes)

    def remove(self, index_id: str, object_id: int) -> bool:
        """False if there is no such object."""
        try:
            self.index(index_id).remove(object_id)
        except NotFound:
            self.index(index_id)
            return False
        return True

    def get_object(self, index_id: str, object_id: int):
        """The row, or None."""
        return self.index(index_id).get(object_id).first()

    def build(self, index_id: str) -> float:
        """Milliseconds that the layout took."""
        began = time.perf_counter()
        self.index(index_id).build().pages.count()
        return 1000 * (time.perf_counter() - began)

    optimize = build

    def query_range(self, index_id: str, box: Box | None) -> DataFrame:
        return self.index(index_id).query_range(box)

    def query_point(self, index_id: str, x: float, y: float) -> DataFrame:
        return self.index(index_id).query_point(x, y)

    def query_knn(self, index_id: str, x: float, y: float, k: int) -> DataFrame:
        return self.index(index_id).query_knn(x, y, k)

    def query_adjacent(self, index_id: str, region: Box | None) -> DataFrame:
        return self.index(index_id).query_adjacent(region)

    def find_adjacent_pages(self, index_id: str, region: Box | None) -> DataFrame:
        return self.index(index_id).find_adjacent_pages(region)

    def get_stats(self, index_id: str):
        return self.index(index_id).stats()

    def get_count(self, index_id: str) -> int:
        return self.index(index_id).count()

    def get_bounds(self, index_id: str) -> Box | None:
        return self.index(index_id).bounds()

    def save(self, index_id: str, path: str) -> None:
        self.index(index_id).save(path)

    def load(self, index_id: str, path: str) -> SpatialFrame:
        self._new(index_id)
        self._frames[index_id] = SpatialFrame.load(self.spark, path)
        return self._frames[index_id]

    @staticmethod
    def version() -> str:
        return __version__
