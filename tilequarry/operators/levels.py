"""Subdivisions of a map, level by level: every parent's tiles are dealt to the cells of a grid, which are its children."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilequarry.operators import spatial

#: Up to this many tiles are one subdivision.
FEW = 4


def _cells(tiles: DataFrame) -> DataFrame:
    """Add side, row and col to tiles(parent, bounds): a grid whose side is the fourth root of the parent's tiles, by their centres."""
    lims = tiles.groupBy(F.col("parent").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("lat_min").alias("_s"), F.max("lat_max").alias("_t"), F.min("lon_min").alias("_w"), F.max("lon_max").alias("_e"))
    side = F.when(F.col("_n") <= FEW, 1).otherwise(F.greatest(F.lit(2), F.floor(F.pow(F.col("_n").cast("double"), 0.25) + 1e-9))).cast("int")

    def place(low: str, high: str, first: str, last: str) -> Column:
        span = F.when(F.col(last) > F.col(first), F.col(last) - F.col(first)).otherwise(1.0)
        at = F.floor(((F.col(low) + F.col(high)) / 2 - F.col(first)) / (span / F.col("side"))).cast("int")
        return F.greatest(F.lit(0), F.least(at, F.col("side") - 1))

    df = tiles.join(lims, F.col("parent") == F.col("_p")).withColumn("side", side)
    return df.withColumn("row", place("lat_min", "lat_max", "_s", "_t")).withColumn("col", place("lon_min", "lon_max", "_w", "_e")).drop("_p", "_n", "_s", "_t", "_w", "_e")


def subdivisions(tiles: DataFrame, zooms: list[int], bounds: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """The tree of subdivisions of tiles(z, x, y, lat_min, lon_min, lat_max, lon_max), and the tiles with theirs.

    First: idx (from 0, by level, then parent, row and column), level, parent, n_tiles, west,
    south, east, north, next_level_index (the first child's idx, null on the last level). Second:
    the tiles with level and idx. A tile belongs to every parent in whose bounds its centre lies,
    edges included; a parent without tiles has one empty child of its own bounds; a first level
    without tiles is one subdivision of ``bounds`` (west, south, east, north).

    A level is one join of its tiles with the cells of the level before. Only cells, some square
    root of a parent's tiles, are numbered in order.
    """
    spark = tiles.sparkSession
    parents = spark.createDataFrame([(-1, *bounds)], "idx bigint, west double, south double, east double, north double")
    done, members, base = [], [], 0
    for level, z in enumerate(zooms):
        own = tiles.where(F.col("z") == z)
        if level:
            centres = own.select(F.struct(*own.columns).alias("id"), ((F.col("lon_min") + F.col("lon_max")) / 2).alias("lon"), ((F.col("lat_min") + F.col("lat_max")) / 2).alias("lat"))
            boxes = parents.select(F.col("idx").alias("id"), F.col("west").alias("w"), F.col("south").alias("s"), F.col("east").alias("e"), F.col("north").alias("n"))
            dealt = spatial.points_in_boxes(centres, boxes).select("point_id.*", F.col("box_id").alias("parent"))
        else:
            dealt = own.withColumn("parent", F.lit(-1).cast("long"))
        placed = _cells(dealt)
        cells = placed.groupBy("parent", "row", "col").agg(F.count(F.lit(1)).alias("n_tiles"), F.min("lon_min").alias("west"), F.min("lat_min").alias("south"), F.max("lon_max").alias("east"), F.max("lat_max").alias("north"))
        empty = parents.join(cells.select("parent").distinct(), F.col("idx") == F.col("parent"), "left_anti").select(F.col("idx").alias("parent"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(0).cast("long").alias("n_tiles"), "west", "south", "east", "north")
        order = Window.partitionBy(F.lit(level)).orderBy("parent", "row", "col")
        numbered = cells.unionByName(empty).withColumn("idx", (F.row_number().over(order) - 1 + base).cast("long")).withColumn("level", F.lit(level)).persist()
        base += numbered.count()
        done.append(numbered)
        at = numbered.select(F.col("parent").alias("_p"), F.col("row").alias("_r"), F.col("col").alias("_c"), "idx", "level")
        members.append(placed.join(at, (F.col("parent") == F.col("_p")) & (F.col("row") == F.col("_r")) & (F.col("col") == F.col("_c"))).select(*tiles.columns, "level", "idx"))
        parents = numbered.select("idx", "west", "south", "east", "north")
    tree = reduce(DataFrame.unionByName, done)
    first = tree.groupBy(F.col("parent").alias("_parent")).agg(F.min("idx").alias("next_level_index"))
    linked = tree.join(first, F.col("idx") == F.col("_parent"), "left")
    return linked.select("idx", "level", "parent", "n_tiles", "west", "south", "east", "north", "next_level_index"), reduce(DataFrame.unionByName, members)
