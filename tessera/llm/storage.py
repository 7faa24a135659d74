"""Cutting lineage through the shared checkpoint folder, and joins that move texts only if they must."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of two numbers at most that are sent to every task: some 30 MB.
FEW = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, as in tests on one machine, a temporary folder is
    set for it; on a cluster the setting must be there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def kept(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back; lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(rows: DataFrame, gone: DataFrame, key: str, few: int = FEW) -> DataFrame:
    """``rows`` whose key is not in ``gone`` (key).  Up to ``few`` keys, counted first, go to every task, so that the rows stay where they are."""
    gone = kept(gone.select(key).distinct(), "gone")
    return rows.join(F.broadcast(gone) if gone.count() <= few else gone, key, "left_anti")
