"""Positions in packed files: prefix sums, segment sizes, flags of last members, block chains and records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilequarry.functions import scalars

#: Blocks named by one directory entry, and the filler behind the last.
CHAIN, FILLER = 240, 0xFFFF
#: A record: bounds as signed 32-bit fixed point, size and image index.
RECORD = "<iiiiII"


def offsets(rows: DataFrame, group: list[str], order: list[str], size: str) -> DataFrame:
    """Add offset: the sizes of the rows before, in order, within each group."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def sizes(rows: DataFrame, group: list[str], order: list[str], offset: str, total: str) -> DataFrame:
    """Add size: up to the next offset, the last up to the group's total."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("size", (F.coalesce(F.lead(offset).over(w), F.col(total)) - F.col(offset)).cast("long"))


def last_flag(rows: DataFrame, group: list[str], order: list[str], bit: int = 15) -> DataFrame:
    """Add flag: the bit set on the last row of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("flag", F.when(F.lead(F.lit(1)).over(w).isNull(), 1 << bit).otherwise(0))


def first_children(rows: DataFrame) -> DataFrame:
    """Add first_child: the smallest index of the next level, null at the deepest, for rows(level, idx)."""
    firsts = rows.groupBy((F.col("level") - 1).alias("level")).agg(F.min("idx").alias("first_child"))
    return rows.join(F.broadcast(firsts), "level", "left")


def level_numbers(rows: DataFrame, group: list[str], zoom: str, top: int = 24) -> DataFrame:
    """Add level: the finest zoom of a group is ``top``, each coarser one is one less. Groups are the few zooms of a map."""
    w = Window.partitionBy(*group).orderBy(F.desc(zoom))
    return rows.withColumn("level", top + 1 - F.row_number().over(w))


def zoom_codes(levels: DataFrame) -> DataFrame:
    """Codes of levels(level, has_tiles): N-1-place, with 0x80 on leading levels without tiles (if none has any, on the first only)."""
    w = Window.partitionBy(F.lit(0)).orderBy("level")
    whole = Window.partitionBy(F.lit(0))
    ranked = levels.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_first", F.min(F.when(F.col("has_tiles"), F.col("_i"))).over(whole))
    leading = F.col("_i") < F.coalesce("_first", F.lit(1))
    return ranked.select("level", (F.col("_n") - 1 - F.col("_i") + F.when(leading, 0x80).otherwise(0)).cast("int").alias("code"))


def placed(files: DataFrame, order: str, size: str, block: int) -> DataFrame:
    """Add first_block and n_blocks of consecutive, block-aligned files, and parts, the directory entries of each."""
    need = scalars.blocks(F.col(size), F.lit(block))
    before = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = files.withColumn("n_blocks", need)
    return df.withColumn("first_block", F.coalesce(F.sum("n_blocks").over(before), F.lit(0)).cast("long")).withColumn("parts", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_blocks") / CHAIN)))


def block_chain(files: DataFrame) -> DataFrame:
    """Entries of placed files: one row a part, with its CHAIN block numbers, filled up."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    df = files.withColumn("part", part).withColumn("_low", F.col("part") * CHAIN)
    numbers = F.transform(F.sequence(F.lit(0), F.lit(CHAIN - 1)), lambda i: F.when(F.col("_low") + i < F.col("n_blocks"), F.col("first_block") + F.col("_low") + i).otherwise(FILLER))
    return df.withColumn("blocks", numbers).drop("_low")


def encoded(tiles: DataFrame) -> DataFrame:
    """Add record (binary) to tiles with lat_min, lon_min, lat_max, lon_max, size and image."""

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in stream:
            fixed = (part[["lat_min", "lon_min", "lat_max", "lon_max"]] * (2**31 / 180)).astype("int64").clip(-(2**31), 2**31 - 1)
            part["record"] = [struct.pack(RECORD, *b, s, i) for b, s, i in zip(fixed.itertuples(index=False, name=None), part["size"], part["image"], strict=True)]
            yield part

    return tiles.mapInPandas(run, tiles.withColumn("record", F.lit(b"")).schema)


def decoded(rows: DataFrame) -> DataFrame:
    """The fields of rows(image_key, record): image_key, lat_min, lon_min, lat_max, lon_max, size, image."""
    at = lambda i: F.conv(F.hex(F.concat(*[F.substring("record", i + k, 1) for k in (3, 2, 1, 0)])), 16, 10).cast("long")
    signed = lambda c: F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c)
    names = ("lat_min", "lon_min", "lat_max", "lon_max")
    return rows.select("image_key", *[(signed(at(1 + 4 * i)) * 180.0 / 2.0**31).alias(n) for i, n in enumerate(names)], at(17).alias("size"), at(21).alias("image"))


def compared(one: DataFrame, other: DataFrame, key: list[str], fields: list[str], tolerance: float = 1e-6) -> DataFrame:
    """A full outer comparison by key and field: key, field, left_value, right_value, status (OK, DIFF, LEFT_ONLY, RIGHT_ONLY)."""
    long = lambda df: df.select(*key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])).alias("x")).select(*key, "x.field", "x.value")
    a, b = long(one).withColumnRenamed("value", "left_value").withColumn("_l", F.lit(1)), long(other).withColumnRenamed("value", "right_value").withColumn("_r", F.lit(1))
    met = a.join(b, [*key, "field"], "full")
    same = F.coalesce(F.abs(F.col("left_value") - F.col("right_value")) <= tolerance, F.col("left_value").isNull() & F.col("right_value").isNull())
    status = F.when(F.col("_r").isNull(), "LEFT_ONLY").when(F.col("_l").isNull(), "RIGHT_ONLY").when(same, "OK").otherwise("DIFF")
    return met.select(*key, "field", "left_value", "right_value", status.alias("status"))
