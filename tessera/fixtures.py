"""Feature tables derived from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import mbr as R
from .functions.geometry import features_from, point_features
from .schema import LINE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders at (total price, days since 1970)."""
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return point_features(table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_totalprice").cast("double"), days.cast("double"))


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers at (balance, nation)."""
    return point_features(table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("double"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at (user, value)."""
    return point_features(table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id").cast("double"), F.col("value").cast("double"))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at their first two components."""
    v = F.col("embedding")
    return point_features(table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.get(v, F.lit(0)).cast("double"), F.get(v, F.lit(1)).cast("double"))


def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rectangles at (retail price, size); each tenth has a hole in its middle."""
    k = F.col("p_partkey")
    x, y = F.col("p_retailprice").cast("double"), F.col("p_size").cast("double")
    w, h = (k % 7 + 1).cast("double"), (k % 5 + 1).cast("double")

    def ring(x0, y0, w, h):
        return F.array(R.point(x0, y0), R.point(x0 + w, y0), R.point(x0 + w, y0 + h), R.point(x0, y0 + h), R.point(x0, y0))

    hole = ring(x + w * 0.25, y + h * 0.25, w * 0.5, h * 0.5)
    holes = F.when(k % 10 == 0, F.array(hole)).otherwise(F.array().cast(f"array<{LINE}>"))
    return features_from(table(spark, sf_dir, "part"), k, "POLYGON", F.struct(ring(x, y, w, h).alias("exterior"), holes.alias("holes")))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines through (quantity, extended price) of their items."""
    items = table(spark, sf_dir, "lineitem")
    cell = F.struct(F.col("l_linenumber"), F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    lines = items.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("line"))
    return features_from(lines, F.col("l_orderkey"), "LINESTRING", F.col("line"))
