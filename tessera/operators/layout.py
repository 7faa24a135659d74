"""Set-based layout: blocks by median splits, pages along a z-order, tracks of pages.

Blocks: a node with more than ``block_size`` features is split at its median by x, the
next level by y, and so on; the median itself is a split point, which does not count for
the bounds of a block but is stored with the first block to its right.

Only (id, x, y) is moved while nodes are split; whole features meet their places in one join at
the end.  Nodes of more than ``exact_rows`` features find their medians by counting: bins over
the coordinate, then over the id, narrow down the place of the median until a window may
hold the rest.  A node of fewer rows (and of ``TASK_ROWS`` at most, as Python holds it) goes to one task, which splits it down to its blocks and puts each block in
order.  So no task holds the whole table, and results do not depend on the size.

A node's path is a number while nodes are split: a leading 1, then a bit for each split.

The shape of the tree follows from the row count alone (halves of a count, again and again), so a
block's number in the order of paths is arithmetic and needs no window over the blocks.
Ids are taken to be unique and not null.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import mbr as R
from ..functions.geometry import distance
from ..schema import SpatialConfig
from ..sources.shared import in_plan


def levels_needed(n: int, block_size: int) -> int:
    """Median splits until no node holds more than ``block_size``; the larger half has n // 2."""
    levels = 0
    while n > block_size:
        n, levels = n // 2, levels + 1
    return levels


def tree_depth(n: int) -> int:
    """Depth of a balanced tree with a feature in every node."""
    return n.bit_length()


def _axis(level: int) -> Column:
    return F.col("x" if level % 2 == 0 else "y")


#: Bins that a node's features are counted in at a time, and all nodes' together.
BINS = 4096
ALL_BINS = 1 << 18

#: Features that one task splits in Python, whatever ``exact_rows`` allows.
TASK_ROWS = 1 << 18



def _most(config: SpatialConfig) -> int:
    return min(config.exact_rows, TASK_ROWS)


def _path(node: Column) -> Column:
    """The path of a node's number, as a text of 0 and 1."""
    return F.substring(F.bin(node), 2, 64)


_RANGE = ("v0", "v1", "i0", "i1")


def _medians(points: DataFrame, level: int, held: dict[int, dict], config: SpatialConfig) -> list[tuple]:
    """(node, coordinate, id) of the split point of every node to split, by counting in bins; ``held``: counts and bounds."""
    spark = points.sparkSession
    own = points.where(~F.col("pivot")).select("node", _axis(level).alias("v"), "id")
    bounds = [F.min("v").alias("v0"), F.max("v").alias("v1"), F.min("id").alias("i0"), F.max("id").alias("i1")]
    nodes = {x: {"c": h["c"], "rank": h["c"] // 2, "v0": h["at"][level % 2][0], "v1": h["at"][level % 2][1], "i0": h["ids"][0], "i1": h["ids"][1]} for x, h in held.items() if h["c"] > config.block_size}
    kind = own.schema["id"].dataType.simpleString()

    def within(names) -> DataFrame:
        rows = [(x, *[nodes[x][c] for c in _RANGE], nodes[x]["rank"]) for x in names]
        found = own.join(F.broadcast(in_plan(spark, rows, f"node long, v0 double, v1 double, i0 {kind}, i1 {kind}, rank long")), "node")
        return found.where(F.col("v").between(F.col("v0"), F.col("v1")) & F.col("id").between(F.col("i0"), F.col("i1")))

    def share(v: str, lo: str, hi: str) -> Column:
        at, lo, hi = (F.col(c).cast("double") for c in (v, lo, hi))
        return F.coalesce(F.least(F.lit(bins_each - 1), F.floor(F.try_divide(at - lo, hi - lo) * bins_each)), F.lit(0))

    open_ = [x for x, r in nodes.items() if r["c"] > _most(config)]
    while open_:
        bins_each = max(64, min(BINS, ALL_BINS // len(open_)))
        number = F.when(F.col("v0") < F.col("v1"), share("v", "v0", "v1")).otherwise(share("id", "i0", "i1"))
        bins = within(open_).withColumn("bin", number).groupBy("node", "rank", "bin").agg(F.count(F.lit(1)).alias("c"), *bounds)
        before = F.sum("c").over(Window.partitionBy("node").orderBy("bin")) - F.col("c")
        chosen = bins.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c"))).collect()
        open_ = []
        for r in chosen:
            narrowed = {c: r[c] for c in (*_RANGE, "c")}
            if narrowed["c"] > _most(config) and any(nodes[r.node][c] != narrowed[c] for c in _RANGE):
                open_.append(r.node)
            nodes[r.node] |= narrowed | {"rank": r["rank"] - r["before"]}
    if not nodes:
        return []
    place = F.row_number().over(Window.partitionBy("node").orderBy("v", "id")) - 1
    return [(r.node, r.v, r.id) for r in within(nodes).withColumn("place", place).where(F.col("place") == F.col("rank")).collect()]


def _counted(points: DataFrame, n: int, config: SpatialConfig) -> tuple[DataFrame, int, int]:
    """First levels of nodes that no window should hold; also their number, and the most features of a node that is left."""
    level = 0
    points = points.withColumn("node", F.lit(1).cast("long"))
    kind = points.schema["id"].dataType.simpleString()
    if n > max(_most(config), config.block_size):
        ends = points.agg(*[f(c) for f in (F.min, F.max) for c in ("x", "y", "id")]).first()
        low, high = ends[:3], ends[3:]
        # Counts of nodes are arithmetic, and a split point bounds both sides: one pass does for all levels.
        held = {1: {"c": n, "at": [(low[0], high[0]), (low[1], high[1])], "ids": (low[2], high[2])}}
    while n > max(_most(config), config.block_size):
        found = _medians(points, level, held, config)
        for node, v, _ in found:
            of, k = held.pop(node), level % 2
            for side, c, range_ in ((0, of["c"] // 2, (of["at"][k][0], v)), (1, of["c"] - of["c"] // 2 - 1, (v, of["at"][k][1]))):
                held[2 * node + side] = of | {"c": c, "at": [range_ if i == k else r for i, r in enumerate(of["at"])]}
        cuts = in_plan(points.sparkSession, found, f"node long, _v double, _i {kind}")
        v = _axis(level)
        below = (v < F.col("_v")) | ((v == F.col("_v")) & (F.col("id") < F.col("_i")))
        here = F.coalesce((v == F.col("_v")) & (F.col("id") == F.col("_i")), F.lit(False))
        side = F.when(F.col("pivot") | below, 0).otherwise(1)
        points = points.join(F.broadcast(cuts), "node", "left")
        points = points.withColumn("node", F.when(F.col("_v").isNotNull(), 2 * F.col("node") + side).otherwise(F.col("node")))
        points = points.withColumn("pivot", F.col("pivot") | here).drop("_v", "_i")
        n, level = n // 2, level + 1
    return points, level, n


@lru_cache(maxsize=None)
def leaves(size: int, block_size: int) -> int:
    """Blocks of a node of so many features."""
    return 1 if size <= block_size else leaves(size // 2, block_size) + leaves(size - size // 2 - 1, block_size)


def _start(n: int, node: int, block_size: int) -> int:
    """Blocks before those of a node."""
    before = 0
    for side in bin(node)[3:]:
        if side == "1":
            before += leaves(n // 2, block_size)
        n = n // 2 if side == "0" else n - n // 2 - 1
    return before


def _z_places(x: np.ndarray, y: np.ndarray, bits: int = 16) -> np.ndarray:
    """``z_order`` of points between bounds that are already 0 and 1."""
    side = 1 << bits
    z = np.zeros(len(x), np.int64)
    for k, v in enumerate((x, y)):
        cell = np.clip(np.floor(v * side), 0, side - 1).astype(np.int64)
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            cell = (cell | (cell << shift)) & mask
        z |= cell << k
    return z


def _split(node: int, ids: np.ndarray, at: tuple[np.ndarray, np.ndarray], pivot: np.ndarray, n: int, config: SpatialConfig) -> pa.Table:
    """Blocks of one node: number, path, split points, and places in the order of pages."""
    size = len(ids)
    block, place, path, mid = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64), pivot.copy()
    todo = [(node, np.flatnonzero(~pivot), np.flatnonzero(pivot), _start(n, node, config.block_size))]
    while todo:
        node, own, stored, before = todo.pop()
        if len(own) > config.block_size:
            half = len(own) // 2
            own = own[np.lexsort((ids[own], at[(node.bit_length() - 1) % 2][own]))]
            mid[own[half]] = True
            todo.append((2 * node, own[:half], stored, before))
            todo.append((2 * node + 1, own[half + 1 :], own[half : half + 1], before + leaves(half, config.block_size)))
            continue
        every = np.concatenate([own, stored])
        block[every], path[every] = before + 1, node
        if config.strategy == "zorder" and len(own):
            lo, hi = ([f(v[own]) for v in at] for f in (np.min, np.max))
            unit = [np.divide(v[every] - a, b - a) if b > a else np.zeros(len(every)) for v, a, b in zip(at, lo, hi)]
            key = _z_places(*unit)
        else:
            key = np.zeros(len(every), np.int64)
        place[every[np.lexsort((ids[every], key))]] = np.arange(len(every))
    return pa.table({"id": ids, "x": at[0], "y": at[1], "block_id": block, "node": path, "pivot": mid, "place": place})


def kd_nodes(features: DataFrame, config: SpatialConfig, n: int | None = None) -> DataFrame:
    """(id, x, y, block_id, node, pivot, place) of the valid features: block, path of splits, split points, place in the block."""
    if n is None:
        n = features.where("is_valid").count()
    c = F.col("centroid")
    points = features.where("is_valid").select("id", c["x"].alias("x"), c["y"].alias("y"), F.lit(False).alias("pivot"))
    points, _, _ = _counted(points, n, config)

    def split(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        ids, x, y, pivot = (table.column(k).to_numpy() for k in ("id", "x", "y", "pivot"))
        return _split(node, ids, (x, y), pivot.astype(bool), n, config)

    kind = points.schema["id"].dataType.simpleString()
    found = points.groupBy("node").applyInArrow(split, f"id {kind}, x double, y double, block_id long, node long, pivot boolean, place long")
    return found.withColumn("node", _path(F.col("node")))


def kd_blocks(nodes: DataFrame) -> DataFrame:
    """block_id, node, bounds and centre of centroids, and counts, with block_id in the order of paths."""
    own = F.when(~F.col("pivot"), R.mbr(F.col("x"), F.col("y"), F.col("x"), F.col("y")))
    found = nodes.groupBy("block_id", "node").agg(R.bounds_of(own).alias("bounds"), F.count_if(~F.col("pivot")).alias("object_count"), F.count(F.lit(1)).alias("stored_count"))
    return found.select("block_id", "node", "bounds", R.centroid("bounds").alias("centroid"), "object_count", "stored_count")


def z_order(x: Column, y: Column, bounds, bits: int = 16) -> Column:
    """Interleaved bits of both coordinates, quantised between the bounds (constants or a struct column)."""
    side = 1 << bits
    if isinstance(bounds, Column):
        x0, y0, x1, y1 = (bounds[n] for n in ("min_x", "min_y", "max_x", "max_y"))
    else:
        x0, y0, x1, y1 = (F.lit(float(v)) for v in bounds)

    def cell(v: Column, lo: Column, hi: Column) -> Column:
        share = F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0))
        return F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor(share * side))).cast("long")

    def spread(v: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(cell(x, x0, x1)).bitwiseOR(F.shiftleft(spread(cell(y, y0, y1)), 1))


def placed(features: DataFrame, config: SpatialConfig | None = None, n: int | None = None) -> DataFrame:
    """Valid features with block_id, page_id, track_id and slot, and node and pivot, from which ``kd_blocks`` makes the blocks.

    Page and track numbers come from the block's number and the place in the block, so
    numbering needs no pass over all rows.
    """
    config = config or SpatialConfig()
    if n is None:
        n = features.where("is_valid").count()
    levels = max(1, levels_needed(n, config.block_size))
    pages = -(-(config.block_size + levels) // config.page_capacity)
    tracks = -(-pages // config.pages_per_track)
    base, in_block = F.col("block_id") - 1, F.floor(F.col("place") / config.page_capacity).cast("long")
    where = kd_nodes(features, config, n).select(
        "id", "x", "y", "node", "pivot", "block_id",
        (base * pages + in_block + 1).alias("page_id"),
        (base * tracks + F.floor(in_block / config.pages_per_track).cast("long") + 1).alias("track_id"),
        (F.col("place") % config.page_capacity).cast("int").alias("slot"),
    )
    return features.where("is_valid").join(where, "id").select(*features.columns, "block_id", "page_id", "track_id", "slot", "x", "y", "node", "pivot")


def layout(features: DataFrame, config: SpatialConfig | None = None, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(laid-out features with block_id, page_id, track_id, slot; blocks)."""
    every = placed(features, config, n)
    return every.drop("x", "y", "node", "pivot"), kd_blocks(every)


def pages_of(laid: DataFrame, config: SpatialConfig | None = None) -> DataFrame:
    """One row per page: extent, mean centroid, bounds of centroids, utilisation.

    Means add a page's few features in the order of their slots, so that they do not depend on how the rows are dealt out.
    """
    config = config or SpatialConfig()
    c = F.col("centroid")
    members = F.sort_array(F.collect_list(F.struct("slot", c["x"].alias("x"), c["y"].alias("y"))))
    mean = lambda k: F.aggregate(members, F.lit(0.0), lambda total, m: total + m[k]) / F.size(members)
    found = laid.groupBy("page_id").agg(
        F.first("track_id").alias("track_id"),
        F.first("block_id").alias("block_id"),
        F.count(F.lit(1)).alias("object_count"),
        R.bounds_of("mbr").alias("extent"),
        R.point(mean("x"), mean("y")).alias("centroid"),
        R.bounds_of(R.mbr(c["x"], c["y"], c["x"], c["y"])).alias("centroid_bounds"),
        F.bit_xor(F.xxhash64("id", "centroid")).alias("checksum"),
    )
    full = F.col("object_count") >= config.page_capacity
    return found.withColumn("utilization", F.col("object_count") / F.lit(float(config.page_capacity))).withColumn("is_full", full)


def tracks_of(pages: DataFrame, config: SpatialConfig | None = None) -> DataFrame:
    """One row per track: extent over its pages, mean of page centroids."""
    config = config or SpatialConfig()
    c = F.col("centroid")
    found = pages.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum("object_count").alias("object_count"),
        R.bounds_of("extent").alias("extent"),
        R.point(F.avg(c["x"]), F.avg(c["y"])).alias("centroid"),
    )
    return found.withColumn("has_space", F.col("page_count") < config.pages_per_track)


def block_at(blocks: DataFrame, x: float, y: float) -> DataFrame:
    """The block of smallest number whose bounds hold the point."""
    return blocks.where(R.contains_point("bounds", x, y)).orderBy("block_id").limit(1)


def blocks_in_region(blocks: DataFrame, box) -> DataFrame:
    return blocks.where(R.overlaps_box("bounds", box))


def pages_in_region(pages: DataFrame, box) -> DataFrame:
    return pages.where(R.overlaps_box("extent", box))


def tracks_in_region(tracks: DataFrame, box) -> DataFrame:
    return tracks.where(R.overlaps_box("extent", box))


def find_leaf(blocks: DataFrame, x: float, y: float) -> DataFrame:
    """The block whose bounds are nearest to the point: its own where one holds it."""
    b = F.col("bounds")
    gap = lambda lo, hi, v: F.greatest(lo - F.lit(float(v)), F.lit(float(v)) - hi, F.lit(0.0))
    gx, gy = gap(b["min_x"], b["max_x"], x), gap(b["min_y"], b["max_y"], y)
    return blocks.where(b.isNotNull()).withColumn("gap2", gx * gx + gy * gy).orderBy("gap2", "block_id").limit(1)


def track_distance(tracks: DataFrame, a: int, b: int) -> DataFrame:
    """Distance between the centroids of two tracks; no row if one of them is missing."""
    one = tracks.where(F.col("track_id") == a).select(F.lit(1).alias("k"), F.col("centroid").alias("ca"))
    other = tracks.where(F.col("track_id") == b).select(F.lit(1).alias("k"), F.col("centroid").alias("cb"))
    return one.join(other, "k").select(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), distance("ca", "cb").alias("distance"))


def verify_pages(laid: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages whose stored checksum differs from that of their features."""
    now = laid.groupBy("page_id").agg(F.bit_xor(F.xxhash64("id", "centroid")).alias("now"))
    return pages.join(now, "page_id", "left").where(~F.col("checksum").eqNullSafe(F.col("now"))).select("page_id", "checksum", "now")
