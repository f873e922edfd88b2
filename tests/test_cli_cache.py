"""Extents, zooms and caches as the command line takes them."""

import pytest
from pyspark.sql import functions as F

from tilequarry.functions import scalars
from tilequarry.plans import config, extent
from tilequarry.sources import cache

BOX = {"west": 6.0, "south": 46.0, "east": 7.0, "north": 47.0}


def test_extents():
    assert extent.extent() is None
    assert extent.extent((6, 46, 7, 47)) == BOX
    assert extent.extent(lng=8.0, lat=0.0, width=111.32, height=222.64) == pytest.approx({"west": 7.5, "south": -1.0, "east": 8.5, "north": 1.0})
    for bad in ({"bbox": (1, 2, 3)}, {"bbox": (1, 2, 3, 4), "lng": 1.0}, {"lng": 1.0, "lat": 2.0}, {"width": 3.0}):
        with pytest.raises(config.ConfigError):
            extent.extent(**bad)
    assert extent.zooms("10, 12") == [10, 12] and extent.zooms(None) is None
    with pytest.raises(config.ConfigError):
        extent.zooms("10,x")


def test_narrowed_targets():
    conf = config.Config()
    conf.sections["layers"]["base"] = {"bounds": BOX, "zoom_levels": [10]}
    inside = dict(BOX, west=6.5)
    out = extent.narrowed(conf, "base", inside, [11, 12])
    assert out.sections["targets"]["base"]["layers"] == [{"ref": "base", "bounds": inside, "zoom_levels": [11, 12]}]
    assert not conf.sections["targets"]
    with pytest.raises(config.ConfigError, match="exceeds"):
        extent.narrowed(conf, "base", dict(BOX, west=5.0), None)
    with pytest.raises(config.ConfigError, match="no target"):
        extent.narrowed(conf, "none", None, None)


def test_cache_status_clean_and_migration(spark, tmp_path):
    for name, size in (("swiss/k/1/2/3.jpeg", 700), ("swiss/k/1/2/3.jgw", 50), ("alps/4.png", 500), (".hidden/5.png", 9), ("loose.png", 7)):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    got = {r["source"]: (r["tiles"], r["bytes"], r["human"]) for r in cache.status(spark, str(tmp_path)).collect()}
    assert got == {"swiss": (1, 700, "700 B"), "alps": (1, 500, "500 B"), None: (2, 1200, "1.17 KB")}
    assert [f.name for f in cache.folders(tmp_path)] == ["alps", "swiss"] and cache.folders(tmp_path, "../x") == []
    old = tmp_path / "alps" / "0123456789ab"
    old.mkdir()
    assert cache.migrated(tmp_path / "alps", "new-key").name == "new-key" and not old.exists()
    assert cache.migrated(tmp_path / "alps", "new-key") is None and cache.migrated(tmp_path / "none", "k") is None
    assert cache.clean(cache.folders(tmp_path, "swiss")) == ["swiss"] and (tmp_path / "loose.png").exists()


def test_folders_and_codes(spark):
    row = spark.range(1).select(
        scalars.item_folder(F.lit("s"), F.lit("https://h.example.org/collections/a"), F.lit("i/1\\2"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("folder"),
        *[scalars.type_code(F.lit(t)).alias(f"t{i}") for i, t in enumerate(("0x1F", "0X2a", "12", "x"))],
    ).first()
    assert row.folder == "cache/s/collections-a-a_1%2Cb_2/i_1_2"
    assert [row.t0, row.t1, row.t2, row.t3] == [31, 42, 12, None]
