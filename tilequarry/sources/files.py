"""Local and shared files: listings, tile caches and manifests."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.functions import template
from tilequarry.sources.registry import sources

#: File name patterns by format.
PATTERNS = {"geotiff": "*.{tif,tiff}", "gpkg": "*.gpkg", "img": "*.img", "jpeg": "*.{jpg,jpeg}", "png": "*.png"}
_TILE = r"/([0-9]+)/([0-9]+)/([0-9]+)\.([a-z0-9]+)$"


def listing(spark: SparkSession, paths: list[str], kind: str | None = None, content: bool = False) -> DataFrame:
    """Files below paths: path, size, modified (and content). Without content, no file is opened: the column is pruned."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if kind:
        reader = reader.option("pathGlobFilter", PATTERNS.get(kind, f"*.{kind}"))
    df = reader.load(paths).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return df if content else df.drop("content")


def tile_cache(files: DataFrame) -> DataFrame:
    """Tiles z, x, y, path, size of a cache's listing; a tile without its world file does not count."""
    part = lambda i: F.regexp_extract("path", _TILE, i)
    named = files.where(F.col("path").rlike(_TILE)).select(part(1).cast("int").alias("z"), part(2).cast("long").alias("x"), part(3).cast("long").alias("y"), part(4).alias("ext"), "path", "size")
    world = named.where(F.col("ext").isin("jgw", "pgw", "tfw", "wld")).select("z", "x", "y")
    return named.where(~F.col("ext").isin("jgw", "pgw", "tfw", "wld", "json") & (F.col("size") > 0)).join(world, ["z", "x", "y"], "left_semi").drop("ext")


def status(files: DataFrame) -> DataFrame:
    """Files and bytes of a cache by source (its first folder), by extension, and in all."""
    source = F.regexp_extract("path", r"/cache/([^/]+)/", 1)
    return files.select(source.alias("source"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), "size").rollup("source", "ext").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def usable(items: DataFrame) -> DataFrame:
    """Add status to items(expected_size, size, has_sidecar, old): missing, stale or cached."""
    whole = (F.col("size") > 0) & F.col("has_sidecar") & (F.col("expected_size").isNull() | (F.col("size") >= F.col("expected_size")))
    return items.withColumn("status", F.when(~F.coalesce(whole, F.lit(False)), "missing").when(F.col("old"), "stale").otherwise("cached"))


def world_file(px: float, left: float, top: float) -> str:
    """The six lines of a world file of square pixels."""
    return "".join(f"{v:.10f}\n" for v in (px, 0.0, 0.0, -px, left, top))


@sources.register("path")
class PathSource:
    """Files named by templates, relative to the configuration's folder."""

    def handles(self, config: dict[str, Any]) -> bool:
        return config.get("type") == "path"

    def catalog(self, spark: SparkSession, config: dict[str, Any]) -> DataFrame:
        base = config.get("config_dir", ".")
        paths = [template.expand(u, config.get("defaults", {})) for u in config["urls"]]
        return listing(spark, [p if p.startswith("/") or "://" in p else f"{base}/{p}" for p in paths], config.get("format"))
