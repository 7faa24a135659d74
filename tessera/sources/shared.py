"""Tables that are written once to the folder that all executors share, and small ones that go out with the plan."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session has none and runs on one machine, as in tests, a temporary folder is set for it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settled(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it back: its rows and their order in files are the same for every use."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_plan(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a part of the plan itself; from a list alone, Spark would start Python workers on the executors to read them."""
    struct = StructType.fromDDL(schema)
    kinds = to_arrow_schema(struct)
    columns = zip(*rows) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds), struct)
