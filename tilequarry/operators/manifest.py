"""Resumable work: a manifest by target and zoom, committed a zoom at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "target string, z int, tiles long, finished timestamp"


def commit(spark: SparkSession, path: str, target: str, zoom: int, tiles: int) -> None:
    """Record a finished zoom. Each is a file of its own, so that jobs side by side do not overwrite each other."""
    row = spark.createDataFrame([(target, zoom, tiles)], "target string, z int, tiles long").withColumn("finished", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; an empty one where none was written."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], SCHEMA)


def left(spark: SparkSession, path: str, target: str, zooms: list[int]) -> list[int]:
    """Zooms still to do; a manifest with a zoom that is not asked for is stale, and all are left."""
    done = {r["z"] for r in read(spark, path).where(F.col("target") == target).select("z").distinct().limit(64).collect()}
    return sorted(zooms) if done - set(zooms) else sorted(set(zooms) - done)


def without(manifest: DataFrame, target: str | None) -> DataFrame:
    """The manifest after one target, or all, were cleaned."""
    return manifest.limit(0) if target is None else manifest.where(F.col("target") != target)
