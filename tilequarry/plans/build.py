"""A build as one plan: entries to tiles, what is cached, sizes, groups and offsets. Nothing is fetched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.operators import aggregate, grid, layout
from tilequarry.plans.config import Config

#: The share of a file's largest size that is planned, that size, and the size of an unknown tile.
SHARE, LARGEST, UNKNOWN = 0.85, 600_000_000, 50_000


@dataclass
class Plan:
    stack: DataFrame
    tiles: DataFrame
    summary: DataFrame
    groups: DataFrame
    layout: DataFrame


def plan(spark: SparkSession, config: Config, target: str, cached: DataFrame) -> Plan:
    """The build of a target against cached(z, x, y, path, size).

    ``stack`` has a row for every layer of every tile, lowest first; ``layout`` the tiles by group
    with the offset of each payload. Only the zooms' totals are folded in order; tiles stay spread.
    """
    entries = config.entries(spark).where(F.col("target") == target)
    boxes = entries.select("pos", F.explode("zooms").alias("z"), F.col("west").alias("w"), F.col("south").alias("s"), F.col("east").alias("e"), F.col("north").alias("n"), "opacity", "opacity_by_zoom")
    stack = grid.grid(boxes).select("z", "x", "y", "pos", F.coalesce(F.try_element_at("opacity_by_zoom", F.col("z")), "opacity", F.lit(1.0)).alias("opacity"))
    tiles = grid.metadata(stack.select("z", "x", "y").distinct(), cached, UNKNOWN)
    summary = aggregate.summary(tiles.withColumn("cached", F.col("path").isNotNull()), UNKNOWN)
    placed = aggregate.packed_groups(tiles, "size", "lat_min", ["x", "y"], int(SHARE * LARGEST))
    groups = placed.groupBy("grp", "z").agg(F.sum("size").cast("long").alias("bytes"), F.count(F.lit(1)).alias("tiles"))
    return Plan(stack, tiles, summary, groups, layout.offsets(placed, ["grp", "z"], ["x", "y"], "size"))
