"""Saved indexes: Parquet tables clustered by place, and a small table of settings.

Features are written in the order of blocks and pages, so row groups have tight
rectangles and box queries skip most of them.  All paths go through Spark, so any store that
Spark reaches will do.
"""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.layout import verify_pages
from ..schema import SpatialConfig, StorageError
from .shared import in_plan

FORMAT, VERSION = "tessera-index", 1


def save(path: str, laid: DataFrame, pages: DataFrame, blocks: DataFrame, config: SpatialConfig, partition_tracks: bool = False) -> None:
    """Writes features, pages, blocks and settings as a new version.

    Each version has a folder of its own, and its settings come last, so readers see the
    old version or the new one, and a run that fails leaves the old one whole.  ``vacuum`` removes old versions.
    The number of files follows the data, by the shuffle's own sizes.
    """
    spark = laid.sparkSession
    number = max(_versions(spark, path), default=0) + 1
    data = f"{path}/v{number:010d}"
    ordered = laid.repartitionByRange("block_id", "page_id").sortWithinPartitions("block_id", "page_id", "slot")
    writer = ordered.write.mode("overwrite")
    (writer.partitionBy("track_id") if partition_tracks else writer).parquet(f"{data}/features")
    pages.write.mode("overwrite").parquet(f"{data}/pages")
    blocks.write.mode("overwrite").parquet(f"{data}/blocks")
    meta = json.dumps({"format": FORMAT, "version": VERSION, "config": dataclasses.asdict(config)})
    in_plan(spark, [(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{data}/meta")


def _folder(spark: SparkSession, path: str):
    """The file system and path objects of a folder, whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of whole versions: those with settings."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return []
    names = [f.getPath().getName() for f in files.listStatus(where)]
    done = lambda n: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/meta/_SUCCESS"))
    return [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and done(n)]


def latest(spark: SparkSession, path: str) -> str:
    """The folder of the newest whole version."""
    found = _versions(spark, path)
    if not found:
        raise StorageError(f"no index at {path}")
    return f"{path}/v{max(found):010d}"


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Removes all but the newest ``keep`` versions and what failed runs left; frames that read them must be loaded anew."""
    stay = {f"v{n:010d}" for n in sorted(_versions(spark, path))[-keep:]}
    files, where = _folder(spark, path)
    gone = [f.getPath() for f in files.listStatus(where) if f.getPath().getName() not in stay]
    for p in gone:
        files.delete(p, True)
    return len(gone)


def read_meta(spark: SparkSession, path: str) -> SpatialConfig:
    try:
        rows = spark.read.text(f"{latest(spark, path)}/meta").collect()  # one line
    except AnalysisException as e:
        raise StorageError(f"no index at {path}") from e
    try:
        meta = json.loads(rows[0].value)
        if meta["format"] != FORMAT or meta["version"] != VERSION:
            raise StorageError(f"{path} holds {meta['format']} version {meta['version']}")
        return SpatialConfig(**meta["config"])
    except (IndexError, KeyError, ValueError, TypeError) as e:
        raise StorageError(f"damaged settings at {path}") from e


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, SpatialConfig]:
    """(features, pages, blocks, config) of a saved index, its newest version."""
    config, data = read_meta(spark, path), latest(spark, path)
    return spark.read.parquet(f"{data}/features"), spark.read.parquet(f"{data}/pages"), spark.read.parquet(f"{data}/blocks"), config


def validate(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with a saved index: its settings, pages whose checksum differs, features of unknown pages; empty if it is sound."""
    try:
        features, pages, _, _ = load(spark, path)
    except StorageError as e:
        return [str(e)]
    laid = features.where("block_id > 0")
    found = [f"page {r.page_id}: checksum" for r in verify_pages(laid, pages).orderBy("page_id").limit(100).collect()]
    lost = laid.join(pages.select("page_id"), "page_id", "left_anti").count()
    return found + ([f"{lost} features of unknown pages"] if lost else [])


def exists(spark: SparkSession, path: str) -> bool:
    try:
        read_meta(spark, path)
    except StorageError:
        return False
    return True


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of the saved feature files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{latest(spark, path)}/features")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
