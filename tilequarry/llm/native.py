"""Column expressions shared by the operators that run on DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The contract's blanks: space and the five controls from tab to carriage return.
BLANKS = r"\x20\x09-\x0D"


def words(text: Column) -> Column:
    """The runs of non-blank characters, in order; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), "")


def unit(*of: Column) -> Column:
    """A reproducible number in [0, 1) from the hash of ``of``."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") * F.lit(2.0**-53)


def numbered(df: DataFrame, group: list[str], order: list[str], bucket: Column, rows: int, label: str) -> DataFrame:
    """Number rows from 0 without gaps within ``group``, in no task more than about ``rows`` rows a key.

    A plain window over ``group`` would sort a whole group in one task. Rows are dealt to buckets
    inside each group instead; each bucket is numbered alone and moved up by the sizes of the
    buckets before it. ``bucket`` is a non-negative integer expression; rows that agree in
    ``order`` are interchangeable. ``df`` is read twice and should be a stored table.
    """
    total = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, math.ceil(total / rows))
    dealt = df.withColumn("_part", F.pmod(bucket, F.lit(parts)).cast("long"))
    sizes = dealt.groupBy(*group, "_part").count()
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(g).alias(f"_of_{g}") for g in group], F.col("_part").alias("_of_part"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(inside))
    on = [F.col(g) == F.col(f"_of_{g}") for g in group] + [F.col("_part") == F.col("_of_part")]
    joined = ranked.join(starts, on, "inner")
    return joined.withColumn(label, (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_part", "_of_part", "_start", "_rank", *[f"_of_{g}" for g in group])
