"""Summaries, size estimates and packing under caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def medians(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """The upper median of ``value`` in every group, null without values: counts of equal values and their running sums.

    No group is held in one array; what is sorted in a group is its distinct values.
    """
    counts = rows.groupBy(*group, value).agg(F.count(value).alias("_n"))
    w = Window.partitionBy(*group)
    below, total = F.sum("_n").over(w.orderBy(value)), F.sum("_n").over(w)
    ranked = counts.withColumn("_upto", below).withColumn("_all", total)
    return ranked.groupBy(*group).agg(F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col(value))).alias(name))


def summary(tiles: DataFrame, default_size: int = 30_000) -> DataFrame:
    """tiles(z, cached, size) by zoom and, with z null, in all: total, cached, to_process, bytes, all_cached."""
    cached = F.count_if(F.col("cached"))
    total = F.count(F.lit(1))
    return tiles.rollup("z").agg(total.alias("total"), cached.alias("cached"), (total - cached).alias("to_process"), F.sum(F.coalesce("size", F.lit(default_size))).alias("bytes"), (total == cached).alias("all_cached"))


def sampled_size(tiles: DataFrame, key: list[str], value: str, n: int = 5, default: int = 30_000) -> DataFrame:
    """For every z the whole mean of ``value`` over the ``n`` rows of the smallest hash of ``key``; a feature, not a shortcut."""
    w = Window.partitionBy("z").orderBy(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key])), *key)
    some = tiles.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    mean = F.floor(F.sum(value) / F.count(value)).cast("long")
    return tiles.select("z").distinct().join(some.groupBy("z").agg(mean.alias("size")), "z", "left").withColumn("size", F.coalesce("size", F.lit(default)))


def extent(boxes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The smallest box around all boxes (w, s, e, n), zeros if there are none."""
    zero = F.lit(0.0)
    return boxes.groupBy(*(by or [])).agg(*[F.coalesce(f(c), zero).alias(c) for f, c in ((F.min, "w"), (F.min, "s"), (F.max, "e"), (F.max, "n"))])


def quartic_cells(tiles: DataFrame, group: str, lon: str = "lon", lat: str = "lat", few: int = 4) -> DataFrame:
    """Put the rows of every group into a square grid whose side is the fourth root of their number, at least 2: row, col.

    Groups of up to ``few`` rows are one cell. Extents come from one aggregation joined back,
    rather than a window that would hold a whole group.
    """
    lims = tiles.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min(lon).alias("_w"), F.max(lon).alias("_e"), F.min(lat).alias("_s"), F.max(lat).alias("_t"))
    root = F.floor(F.pow(F.col("_n").cast("double"), 0.25) + 1e-9)
    side = F.when(F.col("_n") <= few, 1).otherwise(F.greatest(F.lit(2), root)).cast("int")
    at = lambda c, low, high: F.when(F.col(high) > F.col(low), F.least(F.floor((F.col(c) - F.col(low)) / ((F.col(high) - F.col(low)) / F.col("side"))).cast("int"), F.col("side") - 1)).otherwise(0)
    return tiles.join(lims, group).withColumn("side", side).withColumn("row", at(lat, "_s", "_t")).withColumn("col", at(lon, "_w", "_e")).drop("_n", "_w", "_e", "_s", "_t")


def greedy_groups(sizes: DataFrame, order: str, size: str, cap: int) -> DataFrame:
    """Pack few ordered items (zooms) into consecutive groups of at most ``cap``; an item above it stands alone.

    The items are the aggregate of a large table, a row a zoom; the fold runs over one array of them.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(size).alias("v"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).alias("g"), F.array().cast("array<struct<k:bigint,v:bigint,g:int>>").alias("out"))

    def add(now: Column, x: Column) -> Column:
        new = (now["g"] < 0) | (now["used"] + x["v"] > cap)
        g = F.when(new, now["g"] + 1).otherwise(now["g"])
        used = F.when(new, x["v"]).otherwise(now["used"] + x["v"])
        return F.struct(used.cast("long").alias("used"), g.alias("g"), F.concat(now["out"], F.array(F.struct(x["k"].cast("long").alias("k"), x["v"].cast("long").alias("v"), g.alias("g")))).alias("out"))

    return sizes.agg(F.aggregate(items, start, add, lambda end: end["out"]).alias("o")).select(F.explode("o").alias("x")).select(F.col("x.k").alias(order), F.col("x.v").alias(size), F.col("x.g").alias("grp"))


def latitude_bands(tiles: DataFrame, group: str, lat: str, tie: list[str], bands: Column) -> DataFrame:
    """Deal the rows of every group, by latitude, to ``bands`` bands of equal counts (the last may be short); no empty bands."""
    w = Window.partitionBy(group)
    ranked = tiles.withColumn("_r", F.row_number().over(w.orderBy(lat, *tie)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.withColumn("band", F.floor(F.col("_r") / F.ceil(F.col("_n") / bands)).cast("int")).drop("_r", "_n")


def packed_groups(tiles: DataFrame, size: str, lat: str, tie: list[str], cap: int) -> DataFrame:
    """Deal tiles(z, ...) to groups of at most about ``cap`` bytes: grp, from 0.

    Whole zooms are packed in order; a zoom above the cap is cut alone, by latitude, into as many
    bands of equal counts as its bytes need, the last of which may be short or empty. Ranks come
    from counts by latitude, so no task holds a zoom.
    """
    by_zoom = tiles.groupBy(F.col("z").cast("long").alias("z")).agg(F.sum(size).cast("long").alias("v"), F.count(F.lit(1)).alias("n"))
    items = F.array_sort(F.collect_list(F.struct("z", "v", "n")))
    kind = "array<struct<z:bigint,n:bigint,g:int,bands:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("next"), F.array().cast(kind).alias("out"))

    def add(now: Column, x: Column) -> Column:
        bands = F.when(x["v"] > cap, F.ceil(x["v"] / cap)).otherwise(F.lit(1)).cast("long")
        joins = (now["used"] > 0) & (bands == 1) & (now["used"] + x["v"] <= cap)
        g = F.when(joins, now["next"] - 1).otherwise(now["next"])
        used = F.when(bands > 1, F.lit(0)).when(joins, now["used"] + x["v"]).otherwise(x["v"])
        item = F.struct(x["z"].alias("z"), x["n"].alias("n"), g.cast("int").alias("g"), bands.alias("bands"))
        return F.struct(used.cast("long").alias("used"), (g + bands).cast("int").alias("next"), F.concat(now["out"], F.array(item)).alias("out"))

    plan = by_zoom.agg(F.aggregate(items, start, add, lambda end: end["out"]).alias("o")).select(F.explode("o").alias("x")).select(F.col("x.z").alias("_z"), F.col("x.n").alias("_n"), F.col("x.g").alias("_g"), F.col("x.bands").alias("_bands"))
    rows = tiles.join(F.broadcast(plan), F.col("z").cast("long") == F.col("_z"))  # a row a zoom
    whole, cut = rows.where("_bands = 1").withColumn("grp", F.col("_g")), rows.where("_bands > 1")
    below = Window.partitionBy("_z").orderBy("_lat").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("_z", F.col(lat).alias("_lat")).agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select(F.col("_z").alias("_z2"), "_lat", F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_start"))
    ranked = cut.withColumn("_r", F.row_number().over(Window.partitionBy("_z", lat).orderBy(*tie)) - 1).join(starts, (F.col("_z") == F.col("_z2")) & (F.col(lat) == F.col("_lat")))
    band = F.floor((F.col("_start") + F.col("_r")) / F.ceil(F.col("_n") / F.col("_bands")))
    cut = ranked.withColumn("grp", (F.col("_g") + band).cast("int"))
    return whole.select(*tiles.columns, "grp").unionByName(cut.select(*tiles.columns, "grp"))


def violations(files: DataFrame, limits: dict[str, int], key: list[str] | None = None) -> DataFrame:
    """Limits that are exceeded: the key, name, value, allowed; ``limits`` maps an aggregate's column to its largest value."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("value"), F.lit(v).cast("long").alias("allowed")) for n, v in limits.items()])).alias("x")
    return files.select(*(key or []), rows).select(*(key or []), "x.*").where("value > allowed")


def manhattan_nearest(tiles: DataFrame, k: int) -> DataFrame:
    """The ``k`` tiles (z, x, y) of every zoom nearest to the middle of their range, ties by x, then y."""
    mid = tiles.groupBy("z").agg(F.floor((F.min("x") + F.max("x")) / 2).alias("_mx"), F.floor((F.min("y") + F.max("y")) / 2).alias("_my"))
    d = F.abs(F.col("x") - F.col("_mx")) + F.abs(F.col("y") - F.col("_my"))
    w = Window.partitionBy("z").orderBy("dist", "x", "y")
    return tiles.join(F.broadcast(mid), "z").withColumn("dist", d.cast("long")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("z", "x", "y", "dist")
