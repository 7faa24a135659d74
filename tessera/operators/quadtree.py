"""A quadtree that splits by capacity, as tables.

A cell with more than ``capacity`` centroids is split into four, down to ``max_depth``.  Cells are counted at all
depths in one aggregation over the distinct cells of the greatest depth, so no level needs a pass of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CAPACITY = 8
MAX_DEPTH = 20


def _counts(features: DataFrame, box, max_depth: int) -> DataFrame:
    """(depth, cx, cy, items) of every cell that holds a centroid; points on the outer edge belong to the last cells."""
    x0, y0, x1, y1 = map(float, box)
    side, c = 1 << max_depth, F.col("centroid")
    cell = lambda v, lo, hi: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor((v - lo) / F.lit((hi - lo) or 1.0) * side))).cast("long")
    finest = features.where(c.isNotNull()).groupBy(cell(c["x"], x0, x1).alias("x"), cell(c["y"], y0, y1).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    every = finest.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
    part = lambda v: F.expr(f"shiftright({v}, {max_depth} - depth)")
    return every.groupBy("depth", part("x").alias("cx"), part("y").alias("cy")).agg(F.sum("n").alias("items"))


def leaves(features: DataFrame, box, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(depth, cx, cy, items) of the leaves that hold centroids."""
    cells = _counts(features, box, max_depth)
    is_leaf = (F.col("items") <= capacity) | (F.col("depth") == max_depth)
    split = cells.where(~is_leaf).select((F.col("depth") + 1).alias("depth"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    below = cells.where(is_leaf & (F.col("depth") > 0)).withColumn("px", F.expr("shiftright(cx, 1)")).withColumn("py", F.expr("shiftright(cy, 1)"))
    found = below.join(split, ["depth", "px", "py"], "left_semi").select("depth", "cx", "cy", "items")
    return found.unionByName(cells.where(is_leaf & (F.col("depth") == 0)).select("depth", "cx", "cy", "items"))


def tree_stats(features: DataFrame, box, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row: items, nodes, leaves (empty ones too) and the greatest depth."""
    cells = _counts(features, box, max_depth)
    split = (F.col("items") > capacity) & (F.col("depth") < max_depth)
    n = F.count_if(split)
    return cells.agg(
        F.coalesce(F.sum(F.when(F.col("depth") == 0, F.col("items"))), F.lit(0)).alias("total_items"),
        (F.lit(1) + 4 * n).alias("total_nodes"),
        (F.lit(1) + 3 * n).alias("leaf_count"),
        F.coalesce(F.max(F.when(split, F.col("depth") + 1)), F.lit(0)).alias("max_depth"),
    )
