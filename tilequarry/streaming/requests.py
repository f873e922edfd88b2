"""Beyond the inventory: a heat map of tile requests over time, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.functions import tile


def heat(requests: DataFrame, zoom: int, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Requests(ts, lon, lat) by tile and window; those later than ``late`` no longer count. Works on tables and streams."""
    z = F.lit(zoom)
    placed = requests.withWatermark("ts", late).select("ts", tile.tile_x(F.col("lon"), z).alias("x"), tile.tile_y(F.col("lat"), z).alias("y"))
    return placed.groupBy(F.window("ts", window).alias("w"), "x", "y").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "x", "y", "n")
