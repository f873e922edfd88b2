"""Fetching into a tile cache: what is there stays, what is missing is fetched on the workers and appears whole or not at all."""

from __future__ import annotations

import datetime
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.functions import scalars, tile
from tilequarry.sources import files, wmts

SCHEMA = "z int, x bigint, y bigint, url string, path string, size bigint, state string"


def _read(url: str) -> tuple[int | None, bytes]:
    """Status and body of an address; None for a connection that broke."""
    try:
        with urllib.request.urlopen(url, timeout=30) as answer:  # noqa: S310  addresses come from the configuration
            return 200, answer.read()
    except urllib.error.HTTPError as error:
        return error.code, b""
    except (urllib.error.URLError, OSError) as error:
        missing = isinstance(getattr(error, "reason", error), FileNotFoundError)
        return (404 if missing else None), b""


def _placed(path: str, data: bytes) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def wanted(tiles: DataFrame, template: str, folder: str, extension: str) -> DataFrame:
    """Tiles(z, x, y), each once, with url, path, and px, left_m and top_m of their world file."""
    m = tile.tile_metres(F.col("x"), F.col("y"), F.col("z"))
    values = {name: F.col(name) for name in ("z", "x", "y")} | {"zoom": F.col("z")}
    path = F.concat_ws("/", F.lit(folder), F.col("z"), F.col("x"), F.concat(F.col("y").cast("string"), F.lit(f".{extension}")))
    return tiles.select("z", "x", "y").distinct().select("z", "x", "y", scalars.filled(F.lit(template), values).alias("url"), path.alias("path"), m["px"].alias("px"), m["left_m"].alias("left_m"), m["top_m"].alias("top_m"))


def fetched(todo: DataFrame, read: Callable[[str], tuple[int | None, bytes]] = _read, pauses: tuple = wmts.PAUSES) -> DataFrame:
    """Fetch the rows of ``wanted``: z, x, y, url, path, size, state (fetched, repaired or failed).

    Addresses are tried again as wmts.decision says. A tile whose world file alone is missing is
    repaired without a request. Image, world file and a note (JSON) of address and time are each
    put in place whole, the image last, so a lost task leaves no half tile that counts as cached.
    """

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in stream:
            out = []
            for row in part.itertuples(index=False):
                stem, ending = os.path.splitext(row.path)
                world = stem + {".png": ".pgw", ".tif": ".tfw"}.get(ending, ".jgw")
                whole = os.path.exists(row.path) and os.path.getsize(row.path) > 0
                status, data, attempt = (200, b"", 1) if whole else (None, b"", 0)
                while not whole:
                    attempt += 1
                    status, data = read(row.url)
                    if wmts.decision(status, attempt) != "retry":
                        break
                    time.sleep(pauses[attempt - 1])
                if status != 200 or not (whole or data):
                    out.append((row.z, row.x, row.y, row.url, row.path, 0, "failed"))
                    continue
                _placed(world, files.world_file(row.px, row.left_m, row.top_m).encode())
                if not whole:
                    note = {"url": row.url, "download_date": datetime.datetime.now(datetime.UTC).isoformat()}
                    _placed(f"{row.path}.json", json.dumps(note).encode())
                    _placed(row.path, data)
                out.append((row.z, row.x, row.y, row.url, row.path, os.path.getsize(row.path), "repaired" if whole else "fetched"))
            yield pd.DataFrame(out, columns=["z", "x", "y", "url", "path", "size", "state"])

    return todo.mapInPandas(run, SCHEMA)


def download(tiles: DataFrame, template: str, folder: str, extension: str, parallel: int = 8, offline: bool = False, **options) -> DataFrame:
    """Tiles(z, x, y) with path, size and state: cached ones as they are, missing ones fetched, or missing where ``offline``.

    ``folder`` is one that all workers reach. The cache's listing is met by a join, so only missing tiles become requests.
    """
    spark = tiles.sparkSession
    os.makedirs(folder, exist_ok=True)
    cached = files.tile_cache(files.listing(spark, [folder])).select(F.col("z").alias("_z"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("size").alias("size"))
    on = (F.col("z") == F.col("_z")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))
    rows = wanted(tiles, template, folder, extension)
    there = rows.join(cached, on).select("z", "x", "y", "url", "path", "size", F.lit("cached").alias("state"))
    todo = rows.join(cached, on, "left_anti")
    if offline:
        return there.unionByName(todo.select("z", "x", "y", "url", "path", F.lit(0).cast("long").alias("size"), F.lit("missing").alias("state")))
    return there.unionByName(fetched(todo.repartition(parallel), **options))


def by_zoom(results: DataFrame) -> DataFrame:
    """Tiles of a download by zoom and, with z null, in all: total, cached, fetched, failed, bytes."""
    state = F.col("state")
    return results.rollup("z").agg(F.count(F.lit(1)).alias("total"), F.count_if(state == "cached").alias("cached"), F.count_if(state.isin("fetched", "repaired")).alias("fetched"), F.count_if(state.isin("failed", "missing")).alias("failed"), F.sum("size").alias("bytes"))
