"""Catalogs: keyed unions, field overrides, references and resumable work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilequarry.functions import scalars


def last_wins(rows: DataFrame, key: list[str], precedence: list[str]) -> DataFrame:
    """One row a key, the one of the highest precedence; max_by combines before the shuffle, which a window would not."""
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*precedence)).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def merged(files: list[DataFrame], key: list[str]) -> DataFrame:
    """The union of catalogs in order of files; for a key in several, the last file's row."""
    numbered = [df.withColumn("_file", F.lit(i)) for i, df in enumerate(files)]
    return last_wins(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered), key, ["_file"]).drop("_file")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that come more than once, with their number."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def settings(*layers: Column) -> Column:
    """The first setting given: command line, environment, file, default."""
    return F.coalesce(*layers)


def inherited(own: Column, base: Column) -> Column:
    """An override: its own value unless it is null or empty."""
    return F.when(own.isNull() | (own.cast("string") == ""), base).otherwise(own)


def resolved(entries: DataFrame, layers: DataFrame, ref: str, key: str, fields: list[str]) -> DataFrame:
    """Entries with the fields of the layer they refer to, their own values first; order columns stay."""
    base = layers.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    met = entries.join(base, F.col(ref) == F.col("_key"), "left")
    return met.withColumns({f: inherited(F.col(f), F.col(f"_{f}")) for f in fields}).drop("_key", *[f"_{f}" for f in fields])


def dangling(rows: DataFrame, ref: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose reference names nothing."""
    return rows.where(F.col(ref).isNotNull()).join(targets.select(F.col(key).alias("_key")), F.col(ref) == F.col("_key"), "left_anti")


def missing(wanted: DataFrame, cached: DataFrame, key: list[str]) -> DataFrame:
    """What is still to fetch."""
    return wanted.join(cached.select(*key).distinct(), key, "left_anti")


def present(wanted: DataFrame, cached: DataFrame, key: list[str]) -> DataFrame:
    """What is there already."""
    return wanted.join(cached.select(*key).distinct(), key, "left_semi")


def remaining(requested: Column, completed: Column) -> Column:
    """Zooms left to do; a checkpoint with zooms that were not requested is stale, and all are left."""
    stale = F.size(F.array_except(completed, requested)) > 0
    return F.array_sort(F.when(stale, requested).otherwise(F.array_except(requested, completed)))


def freshest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key by an order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def typed(rules: DataFrame, types: DataFrame) -> DataFrame:
    """Rules(id, kind, value, code) with the code and the finest and coarsest level of types(value, type, low, high).

    An exact rule takes the type of its value, a wildcard that of '*', others none; a rule's own
    code stays and has no levels from here. ``types`` is a style's map, one row a value.
    """
    key = F.when(F.col("kind") == "exact", F.col("value")).when(F.col("kind") == "wildcard", F.lit("*"))
    named = types.select(F.col("value").alias("_key"), scalars.type_code(F.col("type")).alias("_code"), F.coalesce("low", F.lit(16)).alias("_low"), F.coalesce("high", F.lit(24)).alias("_high"))
    met = rules.withColumn("_want", F.when(F.col("code").isNull(), key)).join(named, F.col("_want") == F.col("_key"), "left")
    return met.select("id", F.coalesce("code", "_code").alias("code"), F.col("_low").alias("low"), F.col("_high").alias("high"))


def stacks(tiles: DataFrame, layers: DataFrame, rasters: DataFrame) -> DataFrame:
    """The rasters to composite for every tile(z, x, y), by pos: those of layers(pos, zooms) that have the zoom; what has no raster is left out.

    Rasters(z, x, y, pos, ...) are cut to the layers' zooms first (pairs of a layer and a zoom), so
    no tile is multiplied by its layers.
    """
    used = layers.select("pos", F.explode("zooms").alias("z")).distinct()
    return rasters.join(used, ["pos", "z"], "left_semi").join(tiles.select("z", "x", "y").distinct(), ["z", "x", "y"], "left_semi")


def first_records(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by an order; a filter on the result comes after the limit and is not moved before it."""
    return rows.orderBy(*order).limit(n)


def record_stats(records: DataFrame, group: list[str], image: str) -> DataFrame:
    """Records and distinct images by group. Equal images of a group are counted together before the shuffle."""
    once = records.groupBy(*group, image).agg(F.count(F.lit(1)).alias("_n"))
    return once.groupBy(*group).agg(F.sum("_n").cast("long").alias("records"), F.count(image).alias("images"))
