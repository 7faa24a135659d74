"""Pages and tracks that change one at a time: where new pages and features go, and what goes away.

All of it is set-based: a call takes tables and gives tables, and nothing is changed in place.
Page and track tables are those of ``layout.pages_of`` and ``layout.tracks_of``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import mbr as R
from ..functions.geometry import distance, distance_sq
from ..schema import InvalidArgument, NotFound, SpatialConfig
from ..sources.shared import settled
from .join import knn_join


def best_track(tracks: DataFrame, x: float, y: float, strategy: str = "nearest") -> DataFrame:
    """The track that takes a new page with its centroid at (x, y), in one row; no row where a new track is needed.

    nearest: the track of nearest centroid; best_fit: the one whose extent grows least;
    sequential: the last track.  Tracks without space are passed over (the last track is not replaced
    by another).  new: always a new track.  Ties go to the smaller number.
    """
    room = tracks.where("has_space")
    at = R.point(F.lit(float(x)), F.lit(float(y)))
    if strategy == "nearest":
        return room.withColumn("cost", distance("centroid", at)).orderBy("cost", "track_id").limit(1)
    if strategy == "best_fit":
        grown = R.area(R.expand_point("extent", F.lit(float(x)), F.lit(float(y)))) - R.area("extent")
        return room.withColumn("cost", grown).orderBy("cost", "track_id").limit(1)
    if strategy == "sequential":
        return tracks.orderBy(F.desc("track_id")).limit(1).where("has_space").withColumn("cost", F.lit(0.0))
    if strategy == "new":
        return tracks.limit(0).withColumn("cost", F.lit(0.0))
    raise InvalidArgument(f"unknown strategy {strategy!r}")


def allocate_page(pages: DataFrame, tracks: DataFrame, x: float, y: float, strategy: str = "nearest") -> DataFrame:
    """(page_id, track_id, new_track) of a new page: the next page number, and its track or the next one."""
    last = pages.agg(F.coalesce(F.max("page_id"), F.lit(0)).alias("page"), F.coalesce(F.max("track_id"), F.lit(0)).alias("track"))
    chosen = best_track(tracks, x, y, strategy).agg(F.min("track_id").alias("chosen"))
    both = last.withColumn("k", F.lit(1)).join(chosen.withColumn("k", F.lit(1)), "k")  # one row each
    return both.select((F.col("page") + 1).alias("page_id"), F.coalesce("chosen", F.col("track") + 1).alias("track_id"), F.col("chosen").isNull().alias("new_track"))


def page_for(pages: DataFrame, x: float, y: float) -> DataFrame:
    """The page of nearest centroid if it has room; no row if it is full, which asks for a new page."""
    at = R.point(F.lit(float(x)), F.lit(float(y)))
    return pages.withColumn("d2", distance_sq("centroid", at)).orderBy("d2", "page_id").limit(1).where("NOT is_full")


def free_page(laid: DataFrame, page_id: int) -> DataFrame:
    """The laid-out features without those of a page; an unknown page is an error."""
    if laid.where(F.col("page_id") == page_id).isEmpty():
        raise NotFound(page_id)
    return laid.where(F.col("page_id") != page_id)


def move_page(laid: DataFrame, page_id: int, track_id: int) -> DataFrame:
    """The laid-out features with a page taken from its track and added to another."""
    if laid.where(F.col("page_id") == page_id).isEmpty():
        raise NotFound(page_id)
    return laid.withColumn("track_id", F.when(F.col("page_id") == page_id, F.lit(track_id).cast("long")).otherwise(F.col("track_id")))


def place_features(laid: DataFrame, pages: DataFrame, new: DataFrame, config: SpatialConfig | None = None) -> DataFrame:
    """The laid-out features with new ones placed, without a new layout of the old.

    A feature goes to the page of nearest centroid while that has free slots, lower ids first.  What finds no slot
    goes to new pages of the nearest page's block and track; these follow the last page number, page by page.
    """
    config = config or SpatialConfig()
    c = F.col("centroid")
    valid = new.where("is_valid")
    pages = settled(pages.select("page_id", "track_id", "block_id", "object_count", "centroid"), "pages")
    asked = valid.select(F.col("id").alias("query_id"), c["x"].alias("x"), c["y"].alias("y"))
    homes = pages.select(F.col("page_id").alias("id"), "centroid")
    near = knn_join(asked, homes, 1).select(F.col("query_id").alias("id"), F.col("id").alias("home"))
    held = pages.select(F.col("page_id").alias("home"), "track_id", "block_id", "object_count")
    slots = laid.groupBy(F.col("page_id").alias("home")).agg(F.max("slot").alias("last"))
    order = F.row_number().over(Window.partitionBy("home").orderBy("id"))
    at = near.join(held, "home").join(slots, "home", "left").withColumn("nth", order)
    free = F.lit(config.page_capacity) - F.col("object_count")
    over = F.col("nth") - F.greatest(free, F.lit(0)) - 1  # from 0, for those without a slot
    at = at.withColumn("extra", F.when(over >= 0, F.floor(over / config.page_capacity)))
    # New pages are numbered home by home: few rows, one for every page that is made.
    made = at.where("extra IS NOT NULL").groupBy("home", "extra").agg(F.count(F.lit(1)).alias("n"))
    numbered = made.withColumn("number", F.row_number().over(Window.orderBy("home", "extra"))).select("home", "extra", "number")
    last = pages.agg(F.coalesce(F.max("page_id"), F.lit(0)).alias("last_page"))
    placed = at.join(numbered, ["home", "extra"], "left").join(F.broadcast(last))
    page = F.when(F.col("number").isNotNull(), F.col("last_page") + F.col("number")).otherwise(F.col("home"))
    slot = F.when(F.col("extra").isNotNull(), over % config.page_capacity).otherwise(F.coalesce("last", F.lit(-1)) + F.col("nth"))
    places = placed.select("id", F.col("block_id").cast("long").alias("block_id"), page.cast("long").alias("page_id"), F.col("track_id").cast("long").alias("track_id"), slot.cast("int").alias("slot"))
    return laid.unionByName(valid.join(places, "id").select(laid.columns))
