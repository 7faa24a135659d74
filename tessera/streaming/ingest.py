"""Continuous ingest of GeoJSON features with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.geojson import parse_features, split_features


def stream_features(spark: SparkSession, path: str, lines: bool = True, max_files: int = 100) -> DataFrame:
    """A stream of features from files as they arrive: a feature a line, or a document a file."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).option("wholetext", str(not lines).lower())
    return parse_features(split_features(reader.load(path)))


def append_features(stream: DataFrame, target: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
    """Appends a stream of features to a Parquet table, each batch once; ``on_batch`` sees every batch.

    A batch that is run again after a failure overwrites its own folder, so rows are
    neither lost nor doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if on_batch:
            on_batch(batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
