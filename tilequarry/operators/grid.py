"""Tile grids: boxes by zooms to tiles, pyramids, and grids of any tile matrix set."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequarry.functions import tile


def zooms(boxes: DataFrame, levels: Iterable[int]) -> DataFrame:
    """Every box at every zoom, in column z."""
    return boxes.withColumn("z", F.explode(F.array(*[F.lit(int(z)) for z in sorted(set(levels))])))


def ranges(boxes: DataFrame, west: str = "w", south: str = "s", east: str = "e", north: str = "n", z: str = "z") -> DataFrame:
    """Add x0, x1, y0, y1, the tile ranges of each box. A box with west > east crosses 180 degrees and becomes two.

    Where both halves of such a box meet in a tile column, the second one leaves it out.
    """
    halves = F.when(F.col(west) <= F.col(east), F.array(F.struct(F.col(west).alias("a"), F.col(east).alias("b")))).otherwise(F.array(F.struct(F.col(west).alias("a"), F.lit(180.0).alias("b")), F.struct(F.lit(-180.0).alias("a"), F.col(east).alias("b"))))
    df = boxes.withColumn("_half", F.explode(halves))
    zoom = F.col(z)
    spans = {"x0": tile.tile_x(F.col("_half.a"), zoom), "x1": tile.tile_x(F.col("_half.b"), zoom), "y0": tile.tile_y(F.col(north), zoom), "y1": tile.tile_y(F.col(south), zoom)}
    crosses = F.col(west) > F.col(east)
    first_x0 = F.when(crosses & (F.col("_half.a") == -180.0) & (F.col("_half.b") == F.col(east)), tile.tile_x(F.col(west), zoom))
    spans["x1"] = F.coalesce(F.least(spans["x1"], first_x0 - 1), spans["x1"])
    return df.withColumns(spans).where("x0 <= x1").drop("_half")


def grid(boxes: DataFrame, **names: str) -> DataFrame:
    """One row for every tile of every box: the box's columns, x and y. Rows are generated where the box is, without a shuffle."""
    return ranges(boxes, **names).withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1"))).drop("x0", "x1", "y0", "y1")


def grid_size() -> Column:
    """Tiles of a row of ``ranges``, without generating them."""
    return (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)


def with_bounds(tiles: DataFrame) -> DataFrame:
    """Add lat_min, lon_min, lat_max, lon_max to tiles(z, x, y)."""
    return tiles.withColumns(tile.tile_bounds(F.col("x"), F.col("y"), F.col("z")))


def pyramid(tiles: DataFrame, levels: int = 1) -> DataFrame:
    """The ancestors of tiles(z, x, y), each once, with how many of the tiles each holds."""
    up = F.lit(levels)
    return tiles.where(F.col("z") >= levels).groupBy((F.col("z") - levels).alias("z"), tile.parent(F.col("x"), up).alias("x"), tile.parent(F.col("y"), up).alias("y")).agg(F.count(F.lit(1)).alias("children"))


def matrix_grid(boxes: DataFrame, matrices: DataFrame, metres_per_unit: float = 1.0, pixel_mm: float = 0.28) -> DataFrame:
    """Tiles of boxes (id, w, s, e, n in the set's units) on matrices(z, scale, tlx, tly, tw, th, mw, mh).

    A zoom that the set lacks gives no tile; indices stay within the matrix.
    """
    unit = F.col("scale") * (pixel_mm / 1000.0) / metres_per_unit
    span_x, span_y = unit * F.col("tw"), unit * F.col("th")
    clamp = lambda c, most: F.greatest(F.lit(0).cast("long"), F.least(c.cast("long"), F.col(most).cast("long") - 1))
    cut = {
        "x0": clamp(F.floor((F.col("w") - F.col("tlx")) / span_x), "mw"), "x1": clamp(F.floor((F.col("e") - F.col("tlx")) / span_x), "mw"),
        "y0": clamp(F.floor((F.col("tly") - F.col("n")) / span_y), "mh"), "y1": clamp(F.floor((F.col("tly") - F.col("s")) / span_y), "mh"),
    }
    met = boxes.join(matrices, "z").withColumns(cut)
    return met.select("id", "z", F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1").select("id", "z", "x", F.explode(F.sequence("y0", "y1")).alias("y"))


def metadata(tiles: DataFrame, manifest: DataFrame, default_size: int = 0) -> DataFrame:
    """Tiles(z, x, y) with bounds and the path and size of their cached file; a missing one has ``default_size``."""
    return with_bounds(tiles).join(manifest.select("z", "x", "y", "path", "size"), ["z", "x", "y"], "left").withColumn("size", F.coalesce("size", F.lit(default_size)))
