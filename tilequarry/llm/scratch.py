"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only where it is unset (local tests) does a
local default apply. Tables are written once and reread, so that a lost executor costs a reread.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tilequarry-"))
    return f"file://{_LOCAL[0]}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table of the shared folder and return a frame that reads it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as a table of the shared folder, dealt by ``key``: a join or grouping by it moves no row of it again.

    The catalog knows the table only while it is written; what is returned reads its files.
    """
    spark = df.sparkSession
    name = f"tilequarry_{uuid.uuid4().hex}"
    df.write.bucketBy(min(buckets, 100_000), key).option("compression", "none").option("path", f"{folder(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    out.schema  # the plan is resolved before the name goes; an external table's files stay
    spark.sql(f"drop table {name}")
    return out
