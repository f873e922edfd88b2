"""Relations that stand for map data, derived from the driver's tables; SQL holds the same for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.spark import table

#: DuckDB definitions under the names that the oracle's queries use.
SQL = {
    "pts": "select c_custkey id, 5.96::double+((c_custkey*7919)%10007)/10007.0::double*4.53::double lon, 45.82::double+((c_custkey*104729)%10009)/10009.0::double*1.99::double lat from customer",
    "gpts": "select event_id id, -180::double+((event_id*7919)%100003)/100003.0::double*360::double lon, -80::double+((event_id*104729)%100019)/100019.0::double*160::double lat from events",
    "boxes": "select n_nationkey::bigint id, (-170+n_nationkey*13)::double w, (-150+n_nationkey*13)::double e, (-10+n_nationkey)::double s, (2+n_nationkey)::double n from nation",
    "centres": "select s_suppkey id, 5.96::double+((s_suppkey*6007)%10007)/10007.0::double*4.53::double lon, 45.82::double+((s_suppkey*15013)%10009)/10009.0::double*1.99::double lat from supplier",
    "parcels": "select id, lon-pow(2,id%8)*0.0005 w, lat-pow(2,id%5)*0.0005 s, lon+pow(2,id%8)*0.0005 e, lat+pow(2,id%5)*0.0005 n from (select c_custkey id, 5.96::double+((c_custkey*7919)%10007)/10007.0::double*4.53::double lon, 45.82::double+((c_custkey*104729)%10009)/10009.0::double*1.99::double lat from customer)",
    "sheets": "select id, lon-0.2 w, lat-0.05-id%3 s, lon+0.2 e, lat+0.05 n from (select s_suppkey id, 5.96::double+((s_suppkey*6007)%10007)/10007.0::double*4.53::double lon, 45.82::double+((s_suppkey*15013)%10009)/10009.0::double*1.99::double lat from supplier)",
    "tile_sizes": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::bigint sz from lineitem",
    "features": "select event_id id, event_type typ, value, json_extract_string(props,'$.k') k from events",
}


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (5.96 + (k * 7919 % 10007) / 10007.0 * 4.53).alias("lon"), (45.82 + (k * 104729 % 10009) / 10009.0 * 1.99).alias("lat"))


def centres(spark: SparkSession, d: str) -> DataFrame:
    """A point for each supplier, in the region of ``points``."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), (5.96 + (k * 6007 % 10007) / 10007.0 * 4.53).alias("lon"), (45.82 + (k * 15013 % 10009) / 10009.0 * 1.99).alias("lat"))


def parcels(spark: SparkSession, d: str) -> DataFrame:
    """Many boxes of eight sizes in one small region."""
    dx, dy = (F.pow(F.lit(2.0), F.col("id") % k) * 0.0005 for k in (8, 5))
    return points(spark, d).select("id", (F.col("lon") - dx).alias("w"), (F.col("lat") - dy).alias("s"), (F.col("lon") + dx).alias("e"), (F.col("lat") + dy).alias("n"))


def sheets(spark: SparkSession, d: str) -> DataFrame:
    """Larger boxes over the same region."""
    lon, lat = F.col("lon"), F.col("lat")
    return centres(spark, d).select("id", (lon - 0.2).alias("w"), (lat - 0.05 - F.col("id") % 3).alias("s"), (lon + 0.2).alias("e"), (lat + 0.05).alias("n"))


def world_points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").select(k.alias("id"), (-180.0 + (k * 7919 % 100003) / 100003.0 * 360.0).alias("lon"), (-80.0 + (k * 104729 % 100019) / 100019.0 * 160.0).alias("lat"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    side = lambda c: c.cast("double")
    return table(spark, d, "nation").select(k.cast("long").alias("id"), side(k * 13 - 170).alias("w"), side(k * 13 - 150).alias("e"), side(k - 10).alias("s"), side(k + 2).alias("n"))


def tile_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor("l_extendedprice").cast("long").alias("sz"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """Events with an attribute map; absent attributes are absent keys."""
    attrs = F.map_filter(F.create_map(F.lit("type"), F.col("event_type"), F.lit("value"), F.col("value").cast("string"), F.lit("k"), F.get_json_object("props", "$.k")), lambda _, v: v.isNotNull())
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", "value", attrs.alias("attrs"))
