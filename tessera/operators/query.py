"""Queries over feature tables: boxes, points, nearest neighbours and radii.

All predicates use a feature's rectangle or centroid, in closed intervals.  Invalid
features have neither and are in no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import mbr as R
from ..functions.geometry import distance_sq

Box = tuple[float, float, float, float]


def range_query(features: DataFrame, box: Box) -> DataFrame:
    """Features whose rectangle meets the box."""
    return features.where(R.overlaps_box("mbr", box))


def point_query(features: DataFrame, x: float, y: float) -> DataFrame:
    """Features whose rectangle contains the point."""
    return features.where(R.contains_point("mbr", x, y))


def centroid_range(features: DataFrame, box: Box) -> DataFrame:
    """Features whose centroid lies in the box."""
    x0, y0, x1, y1 = map(float, box)
    if not (x0 <= x1 and y0 <= y1):
        return features.where(F.lit(False))
    c = F.col("centroid")
    return features.where((c["x"] >= x0) & (c["x"] <= x1) & (c["y"] >= y0) & (c["y"] <= y1))


def with_distance_sq(features: DataFrame, x: float, y: float, name: str = "d2") -> DataFrame:
    return features.withColumn(name, distance_sq("centroid", R.point(x, y)))


def knn(features: DataFrame, x: float, y: float, k: int) -> DataFrame:
    """The k features of nearest centroid with ``d2``, nearest first, ties by id; one bounded heap per task."""
    if k <= 0:
        return with_distance_sq(features, x, y).where(F.lit(False))
    return with_distance_sq(features.where(F.col("centroid").isNotNull()), x, y).orderBy("d2", "id").limit(k)


def nearest(features: DataFrame, x: float, y: float) -> DataFrame:
    """The one nearest feature, as an aggregate."""
    near = with_distance_sq(features.where(F.col("centroid").isNotNull()), x, y)
    cells = F.struct(*[F.col(c) for c in near.columns])
    best = near.agg(F.min_by(cells, F.struct("d2", "id")).alias("best")).where(F.col("best").isNotNull())
    return best.select("best.*")


def radius_query(features: DataFrame, x: float, y: float, r: float) -> DataFrame:
    """Features whose centroid lies within r; the box around the circle is tested first, as scans can use it."""
    near = centroid_range(features, (x - r, y - r, x + r, y + r))
    return with_distance_sq(near, x, y).where(F.col("d2") <= float(r) * float(r))


def item_radius(features: DataFrame, x: float, y: float, r: float) -> DataFrame:
    """Features whose rectangle meets the circle's box and whose centroid lies within r."""
    return with_distance_sq(range_query(features, (x - r, y - r, x + r, y + r)), x, y).where(F.col("d2") <= float(r) * float(r))


def get_object(features: DataFrame, object_id: int) -> DataFrame:
    return features.where(F.col("id") == object_id).limit(1)


def knn_pruned(features: DataFrame, pages: DataFrame, x: float, y: float, k: int) -> DataFrame:
    """``knn`` over a laid-out table, reading only pages that can hold one of the k.

    A page's centroids lie between the least and greatest distance of their bounds.  Pages
    in order of greatest distance hold k features at some distance; farther pages go.
    """
    if k <= 0:
        return knn(features, x, y, k)
    b = F.col("centroid_bounds")
    gap = lambda lo, hi, v: F.greatest(lo - F.lit(float(v)), F.lit(float(v)) - hi, F.lit(0.0))
    far = lambda lo, hi, v: F.greatest(F.abs(lo - F.lit(float(v))), F.abs(hi - F.lit(float(v))))
    gx, gy = gap(b["min_x"], b["max_x"], x), gap(b["min_y"], b["max_y"], y)
    fx, fy = far(b["min_x"], b["max_x"], x), far(b["min_y"], b["max_y"], y)
    bounds = pages.where("object_count > 0").select("page_id", "object_count", (gx * gx + gy * gy).alias("least"), (fx * fx + fy * fy).alias("most"))
    # Pages hold at least one feature each, so the k pages of smallest ``most`` settle the limit.
    limit, held = None, 0
    for row in bounds.orderBy("most").limit(k).collect():
        held, limit = held + row.object_count, row.most
        if held >= k:
            break
    if limit is None:
        return knn(features, x, y, k)
    if held < k:
        limit = float("inf")
    slack = limit * 1e-12
    near = bounds.where(F.col("least") <= F.lit(limit + slack)).select("page_id")
    return knn(features.join(near, "page_id", "left_semi"), x, y, k)
