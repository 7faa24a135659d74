"""Page adjacency and the cost of reading pages in some order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import mbr as R
from ..sources.shared import settled
from .join import packed_join, spatial_join


def adjacent_pages(pages: DataFrame, box) -> DataFrame:
    """Pages whose extent meets the box within a slack of 1e-9."""
    return pages.where(R.adjacent_box("extent", box))


def query_adjacent(laid: DataFrame, pages: DataFrame, box) -> DataFrame:
    """Features of adjacent pages whose rectangle meets the box."""
    near = adjacent_pages(pages, box).select("page_id")
    return laid.join(near, "page_id", "left_semi").where(R.overlaps_box("mbr", box))


def adjacent_items(features: DataFrame, item_id: int, include_self: bool = True) -> DataFrame:
    """Features whose rectangle is adjacent to that of one feature."""
    own = features.where(F.col("id") == item_id).limit(1).select(F.col("mbr").alias("own"))
    found = features.join(F.broadcast(own), R.adjacent("mbr", "own")).drop("own")  # one row is broadcast
    return found if include_self else found.where(F.col("id") != item_id)


def adjacency_pairs(features: DataFrame, cell: float | None = None, include_self: bool = False) -> DataFrame:
    """All adjacent pairs (a, b), a < b, or a <= b with ``include_self``."""
    wide = features.select(F.col("id"), F.struct(*[(F.col("mbr")[n] + (-1 if n.startswith("min") else 1) * R.ADJACENT_EPS / 2).alias(n) for n in ("min_x", "min_y", "max_x", "max_y")]).alias("mbr"))
    packs = packed_join(wide, wide, cell, once=True).select((F.get("left_ids", F.lit(0)) < F.get("right_ids", F.lit(0))).alias("apart"), "left_ids", "right_ids")
    pairs = packs.select("apart", F.explode("left_ids").alias("i"), "right_ids").select("apart", "i", F.explode("right_ids").alias("j"))
    # Two packs meet one way round and give all their pairs; a pack with itself gives each pair once.
    kept = (F.col("apart") & (F.col("i") != F.col("j"))) | (F.col("i") < F.col("j"))
    pairs = pairs.where(kept | (F.col("i") == F.col("j")) if include_self else kept)
    return pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def estimate_seeks(pages: DataFrame, order: Sequence[str] = ("track_id", "page_id"), by: Sequence[str] = ()) -> DataFrame:
    """pages and seeks (changes of track between pages read in ``order``), per group ``by``.

    In the default order a seek is a further track, so distinct tracks are counted and
    no window is needed; any other order is followed row by row.
    """
    if tuple(order) == ("track_id", "page_id"):
        seeks = F.greatest(F.count_distinct("track_id") - 1, F.lit(0))
        return pages.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), seeks.alias("seeks"))
    window = Window.partitionBy(*by).orderBy(*order)
    moved = pages.withColumn("_before", F.lag("track_id").over(window))
    change = F.count_if((F.col("_before") != F.col("track_id")) & (F.col("track_id") != 0))
    return moved.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), change.alias("seeks"))


def region_seeks(pages: DataFrame, regions: DataFrame, cell: float | None = None) -> DataFrame:
    """Pages and seeks of each region (region_id, mbr), by the grid join; neither side need be small."""
    pages = settled(pages.select("page_id", "track_id", "extent"), "pages")
    wide = regions.select("region_id", F.struct(*[(F.col("mbr")[n] + (-1 if n.startswith("min") else 1) * R.ADJACENT_EPS).alias(n) for n in ("min_x", "min_y", "max_x", "max_y")]).alias("mbr"))
    pairs = spatial_join(wide, pages.select("page_id", F.col("extent").alias("mbr")), cell, "region_id", "page_id")
    near = pairs.select(F.col("left_id").alias("region_id"), F.col("right_id").alias("page_id")).join(pages.select("page_id", "track_id"), "page_id")
    counted = estimate_seeks(near, by=("region_id",))
    full = regions.select("region_id").join(counted, "region_id", "left")
    return full.select("region_id", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("seeks", F.lit(0)).alias("seeks"))


def seek_rating(ratio) -> object:
    """EXCELLENT below 0.3, GOOD below 0.5, OK below 0.7, else POOR."""
    return F.when(ratio < 0.3, "EXCELLENT").when(ratio < 0.5, "GOOD").when(ratio < 0.7, "OK").otherwise("POOR")
