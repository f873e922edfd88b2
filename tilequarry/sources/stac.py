"""Item catalogs in JSON: pages of features to rows, box filter, and the choice of an asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.sources.registry import sources

SCHEMA = "features array<struct<id: string, bbox: array<double>, assets: map<string, map<string, string>>>>"
#: Asset keys, media types and endings that mark a raster, and a GeoPackage, best first.
RASTER_KEYS = ("geotiff", "data", "image", "cog")
RASTER_MEDIA = ("image/tiff", "image/tiff; application=geotiff", "image/tiff; application=geotiff; profile=cloud-optimized", "application/geo+tiff")
RASTER_ENDING = r"\.tiff?$"
PACKAGE_KEYS = ("gpkg", "geopackage", "data")
PACKAGE_MEDIA = ("application/x.geopackage+zip", "application/geopackage+zip")
PACKAGE_ENDING = r"\.gpkg\.zip$"


def items(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row for every feature of all pages: id, w, s, e, n, assets."""
    pages = spark.read.schema(SCHEMA).option("multiLine", "true").json(paths)
    rows = pages.select(F.explode("features").alias("f")).select("f.id", "f.bbox", "f.assets")
    return rows.select("id", *[F.get("bbox", i).alias(n) for i, n in enumerate("wsen")], "assets")


def within(rows: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Items whose box overlaps, touching edges included; literals, so row groups can be skipped."""
    return rows.where((F.col("w") <= east) & (F.col("e") >= west) & (F.col("s") <= north) & (F.col("n") >= south))


def _chosen(assets: Column, wanted: dict[str, str], keys: tuple, media: tuple, ending: str) -> Column:
    """The address of an asset: candidates are those of known keys, else of a media type, else of an ending.

    ``wanted`` properties select among the candidates, the first that fits; without them, several
    candidates are an error. Null without a candidate, or if none fits.
    """
    known = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.try_element_at(assets, F.lit(k)).alias("value")) for k in keys]), lambda e: e["value"].isNotNull())
    entries = F.array_sort(F.transform(F.map_keys(assets), lambda k: F.struct(k.alias("key"))))
    entries = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.try_element_at(assets, e["key"]).alias("value")))
    by_type = F.filter(entries, lambda e: F.coalesce(e["value"]["type"].isin(*media), F.lit(False)))
    by_ending = F.filter(entries, lambda e: F.coalesce(F.lower(e["value"]["href"]).rlike(ending), F.lit(False)))
    found = F.when(F.size(known) > 0, known).when(F.size(by_type) > 0, by_type).otherwise(by_ending)
    if wanted:
        fits = lambda e: F.forall(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(str(v)).alias("v")) for k, v in wanted.items()]), lambda w: F.coalesce(F.try_element_at(e["value"], w["k"]), F.lit("")) == w["v"])
        return F.get(F.filter(found, fits), 0)["value"]["href"]
    return F.when(F.size(found) > 1, F.raise_error(F.lit("several assets fit; an asset_filter must select one"))).otherwise(F.get(found, 0)["value"]["href"])


def raster_asset(assets: Column, wanted: dict[str, str] | None = None) -> Column:
    """The address of the raster among assets."""
    return _chosen(assets, wanted or {}, RASTER_KEYS, RASTER_MEDIA, RASTER_ENDING)


def package_asset(assets: Column, wanted: dict[str, str] | None = None) -> Column:
    """The address of the zipped GeoPackage among assets."""
    return _chosen(assets, wanted or {}, PACKAGE_KEYS, PACKAGE_MEDIA, PACKAGE_ENDING)


@sources.register("stac")
class StacSource:
    def handles(self, config):
        return config.get("type") == "stac"

    def catalog(self, spark: SparkSession, config) -> DataFrame:
        rows = items(spark, config["urls"])
        choose = package_asset if config.get("format") == "gpkg" else raster_asset
        href = choose(F.col("assets"), config.get("asset_filter"))
        return rows.withColumn("href", href).where(F.col("href").isNotNull())
