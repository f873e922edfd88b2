"""Ordered folds of layers: source-over compositing of values or of raw rasters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def over(rows: DataFrame, key: list[str], pos: str, value: str, opacity: str) -> DataFrame:
    """Composite the values of every key from the lowest position up: key, value, alpha.

    A key's layers are a short stack; they are sorted in an array and folded without Python.
    """
    stack = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(value).cast("double").alias("v"), F.col(opacity).cast("double").alias("o"))))
    start = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("a"))

    def add(now: Column, x: Column) -> Column:
        a = x["o"] + now["a"] * (1.0 - x["o"])
        v = F.when(a > 0, F.try_divide(x["v"] * x["o"] + now["v"] * now["a"] * (1.0 - x["o"]), a)).otherwise(0.0)
        return F.struct(v.alias("v"), a.alias("a"))

    folded = rows.groupBy(*key).agg(F.aggregate(stack, start, add).alias("f"))
    return folded.select(*key, F.col("f.v").alias("value"), F.col("f.a").alias("alpha"))


def blended(layers: list[tuple[np.ndarray, float]]) -> np.ndarray | None:
    """RGBA arrays (h, w, 4, uint8) with opacities, the lowest first, as one RGBA array; None without layers."""
    if not layers:
        return None
    colour = np.zeros((*layers[0][0].shape[:2], 3))
    alpha = np.zeros((*layers[0][0].shape[:2], 1))
    for image, opacity in layers:
        own = np.floor(image[..., 3:].astype(float) * opacity) / 255.0
        total = own + alpha * (1 - own)
        mixed = image[..., :3] * own + colour * alpha * (1 - own)
        colour = np.divide(mixed, total, out=np.zeros_like(mixed), where=total > 0)
        alpha = total
    return np.concatenate((np.round(colour), np.round(alpha * 255)), axis=2).astype(np.uint8)


def flattened(image: np.ndarray, background: int = 255) -> np.ndarray:
    """An RGBA array over a plain background, as RGB."""
    a = image[..., 3:].astype(float) / 255.0
    return np.round(image[..., :3] * a + background * (1 - a)).astype(np.uint8)


def palette(indices: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Indices (h, w) through a table of up to 256 colours."""
    full = np.zeros((256, table.shape[1]), table.dtype)
    full[: len(table)] = table
    return full[indices]


def stacked(rasters: DataFrame, size: int = 256) -> DataFrame:
    """Composite raw RGBA tiles: rasters(z, x, y, pos, opacity, data) to z, x, y, data. A tile's stack is one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        image = blended([(np.frombuffer(d, np.uint8).reshape(size, size, 4), o) for d, o in zip(group["data"], group["opacity"], strict=True)])
        return pd.DataFrame({"z": group["z"].iloc[:1], "x": group["x"].iloc[:1], "y": group["y"].iloc[:1], "data": [image.tobytes()]})

    return rasters.groupBy("z", "x", "y").applyInPandas(run, "z int, x long, y long, data binary")
