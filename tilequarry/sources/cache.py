"""A cache's folders: what each source holds, clearing them, and moving older names to new ones."""

from __future__ import annotations

import re
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.functions import scalars
from tilequarry.sources import files

#: Endings of tiles.
TILES = ("jpeg", "jpg", "png", "tif", "tiff")


def status(spark: SparkSession, root: str) -> DataFrame:
    """Tiles and bytes by source (a folder of the cache) and in all, where source is null: source, tiles, bytes, human."""
    below = F.substring_index(F.col("path"), f"{root.rstrip('/')}/", -1)
    listed = files.listing(spark, [root]).select(F.split(below, "/").alias("parts"), "size")
    source = F.get("parts", F.lit(0))
    ending = F.regexp_extract(F.element_at("parts", -1), r"\.([A-Za-z0-9]+)$", 1)
    tiles = listed.where((F.size("parts") > 1) & ~source.startswith(".") & ending.isin(*TILES))
    by = tiles.select(source.alias("source"), "size").rollup("source").agg(F.count(F.lit(1)).alias("tiles"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return by.withColumn("human", scalars.human_size(F.col("bytes")))


def folders(root: str | Path, source: str | None = None) -> list[Path]:
    """The folders of all sources, or of one; hidden ones stay out, and so does what lies outside of the cache."""
    root = Path(root)
    found = sorted(f for f in root.iterdir() if f.is_dir() and not f.name.startswith(".")) if root.is_dir() else []
    return found if source is None else [f for f in found if f.name == source]


def clean(found: list[Path]) -> list[str]:
    """Remove folders; a link is removed, not followed."""
    for folder in found:
        folder.unlink() if folder.is_symlink() else shutil.rmtree(folder)
    return [folder.name for folder in found]


def migrated(source_folder: str | Path, key: str) -> Path | None:
    """Give the first folder with an older, hashed name its new name, unless that is there: the renamed folder, or None."""
    root = Path(source_folder)
    if not root.is_dir() or (root / key).exists():
        return None
    old = next((f for f in sorted(root.iterdir()) if f.is_dir() and re.fullmatch("[0-9a-f]{12}", f.name)), None)
    return old.rename(root / key) if old else None
