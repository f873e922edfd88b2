"""Raster kernels on raw arrays; image codecs are optional and not needed here."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalised(image: np.ndarray) -> np.ndarray:
    """An array (h, w) or (h, w, bands) of 1 to 4 bands as RGB: grey repeated, alpha over white."""
    if image.ndim == 2:
        image = image[..., None]
    if image.shape[2] == 1:
        return np.repeat(image, 3, axis=2)
    if image.shape[2] == 2:
        return normalised_alpha(np.repeat(image[..., :1], 3, axis=2), image[..., 1:])
    return image if image.shape[2] == 3 else normalised_alpha(image[..., :3], image[..., 3:])


def normalised_alpha(rgb: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    share = alpha.astype(float) / 255.0
    return np.round(rgb * share + 255 * (1 - share)).astype(np.uint8)


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the cubic convolution kernel (a = -0.5) for distances t."""
    t = np.abs(t)
    return np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))


def resampled(image: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Cubic samples of an image (h, w, bands) at fractional pixel centres; rows and cols are separable. Edges repeat."""

    def along(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        base = np.floor(at).astype(int)
        out = 0.0
        for k in range(-1, 3):
            place = np.clip(base + k, 0, values.shape[0] - 1)
            out = out + values[place] * _cubic(at - (base + k)).reshape(-1, *[1] * (values.ndim - 1))
        return out

    vertical = along(image.astype(float), rows)
    both = along(vertical.swapaxes(0, 1), cols).swapaxes(0, 1)
    return np.clip(np.round(both), 0, 255).astype(np.uint8)


def plate_tile(image: np.ndarray, z: int, x: int, y: int, size: int = 256) -> np.ndarray:
    """A web Mercator tile's image resampled to rows of equal latitude steps over the tile's own bounds."""
    n = 2.0**z
    edge = [math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * k / n)))) for k in (y, y + 1)]
    lat = edge[0] + (np.arange(size) + 0.5) / size * (edge[1] - edge[0])
    part = (1 - np.arcsinh(np.tan(np.radians(lat))) / math.pi) / 2 * n - y
    return resampled(normalised(image), part * image.shape[0] - 0.5, (np.arange(size) + 0.5) / size * image.shape[1] - 0.5)


def tile_of(image: np.ndarray, bounds: tuple[float, float, float, float], want: tuple[float, float, float, float], size: int = 256) -> np.ndarray | None:
    """The part of a raster with bounds w, s, e, n that a tile wants, cubic to size; None if they do not meet or all is 0."""
    w, s, e, n = bounds
    if want[2] <= w or want[0] >= e or want[3] <= s or want[1] >= n:
        return None
    step = (np.arange(size) + 0.5) / size
    cols = (want[0] + step * (want[2] - want[0]) - w) / (e - w) * image.shape[1] - 0.5
    rows = (n - want[3] + step * (want[3] - want[1])) / (n - s) * image.shape[0] - 0.5
    out = resampled(normalised(image), rows, cols)
    out[(rows < -0.5) | (rows > image.shape[0] - 0.5)] = 0
    out[:, (cols < -0.5) | (cols > image.shape[1] - 0.5)] = 0
    return out if out.any() else None


def overview(pixels: DataFrame) -> DataFrame:
    """The next coarser raster of pixels(px, py, band, value): means of two by two, rounded half up."""
    return pixels.groupBy(F.floor(F.col("px") / 2).alias("px"), F.floor(F.col("py") / 2).alias("py"), "band").agg(F.round(F.avg("value")).cast("int").alias("value"))


def dashes(points: DataFrame, pattern: tuple[float, float]) -> DataFrame:
    """Segments of lines(line_id, ord, x, y) with their place along the line and whether each starts inside a dash."""
    w = Window.partitionBy("line_id").orderBy("ord")
    step = points.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where(F.col("x2").isNotNull())
    long = step.withColumn("length", F.sqrt(F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2)))
    before = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return long.withColumn("start", before).withColumn("drawn", F.pmod(F.col("start"), F.lit(sum(pattern))) < pattern[0])


def drawn(size: int, lines: list[np.ndarray], colour: tuple[int, int, int], width: float, casing: tuple[tuple[int, int, int], float] | None = None) -> np.ndarray:
    """Lines of pixel coordinates on a transparent RGBA square: the casing under the core, by distance to each segment."""
    image = np.zeros((size, size, 4), np.uint8)
    yy, xx = np.mgrid[0:size, 0:size] + 0.5
    for paint, reach in ([(casing[0], width / 2 + casing[1])] if casing else []) + [(colour, width / 2)]:
        for line in lines:
            for (ax, ay), (bx, by) in zip(line[:-1], line[1:], strict=True):
                dx, dy = bx - ax, by - ay
                t = np.clip(((xx - ax) * dx + (yy - ay) * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
                image[np.hypot(xx - ax - t * dx, yy - ay - t * dy) <= reach] = (*paint, 255)
    return image


def mosaic(tiles: dict[tuple[int, int], np.ndarray], size: int = 256, grey: int = 200) -> np.ndarray | None:
    """RGB tiles by (x, y) on one grey sheet; None without tiles."""
    if not tiles:
        return None
    x0, y0 = min(x for x, _ in tiles), min(y for _, y in tiles)
    sheet = np.full(((max(y for _, y in tiles) - y0 + 1) * size, (max(x for x, _ in tiles) - x0 + 1) * size, 3), grey, np.uint8)
    for (x, y), image in tiles.items():
        sheet[(y - y0) * size : (y - y0 + 1) * size, (x - x0) * size : (x - x0 + 1) * size] = image
    return sheet
