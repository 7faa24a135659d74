"""Connected components of an edge table, by alternating large and small stars.

Each round points every vertex at the least vertex of its neighbourhood.  A vertex
with very many edges costs no more than its edges: minima are aggregated before
the shuffle and the joins are plain equi-joins whose skewed keys can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import kept


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where(F.col("v") < F.col("u"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    side = F.col("v") > F.col("u") if large else F.col("v") < F.col("u")
    moved = both.where(side).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, left: str = "u", right: str = "v", rounds: int = 1000) -> DataFrame:
    """(id, component) of every vertex that has an edge; component is its least vertex.

    The loop ends when a round changes nothing, which a checksum over the edges tells.  It needs
    about the logarithm of the longest path; should ``rounds`` not do, that is an error.
    """
    now = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(F.col("u") != F.col("v")).distinct()
    now, seen = kept(now, "edges"), None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = kept(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(roots)
