"""Table-driven cases and differential checks of functions and the attribute language."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tilequarry.functions import scalars, template, tile
from tilequarry.operators import composite, layout, predicates


def plain_tile(lon, lat, z):
    n = 1 << z
    lat = max(-tile.MAX_LAT, min(tile.MAX_LAT, lat))
    x = math.floor((lon + 180) / 360 * n)
    y = math.floor((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n)
    return max(0, min(n - 1, x)), max(0, min(n - 1, y))


def test_tiles_of_both_hemispheres(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-180, 180), rng.uniform(-84, 84), rng.choice([0, 1, 5, 10, 17, 22])) for _ in range(2000)] + [(180.0, 0.0, 3), (-180.0, 90.0, 3), (0.0, -90.0, 22), (18.42, -33.9, 10)]
    got = spark.createDataFrame(rows, "lon double, lat double, z int").select("lon", "lat", "z", tile.tile_x(F.col("lon"), F.col("z")).alias("x"), tile.tile_y(F.col("lat"), F.col("z")).alias("y")).collect()
    assert sum((r.x, r.y) != plain_tile(r.lon, r.lat, r.z) for r in got) <= 2
    assert [(r.x, r.y) for r in got][-1] == (564, 614)


CASES = [
    ("", True), ("*", True), ("difficulty=WS", True), ("difficulty=ZS", False), ("difficulty!=ZS", True), ("gone=1", False), ("gone!=1", True), ("gone=*", False), ("gone!=*", True), ("difficulty", True), ("!gone", True),
    ("difficulty~^W", True), ("gone~.", False), ("elevation>3000", True), ("elevation>=3500 & elevation<3501", True), ("difficulty>1", False), ("gone<5", False), ("!(difficulty=WS | gone=1)", False), ("gone=1 | difficulty=WS & elevation<1", False), ("!difficulty=ZS", True), ("access=0", True),
]


def test_attribute_language(spark):
    attrs = F.create_map(*map(F.lit, ("difficulty", "WS", "elevation", "3500", "access", "0")))
    got = spark.range(1).select(*[predicates.compiled(predicates.parse(text), attrs).alias(f"c{i}") for i, (text, _) in enumerate(CASES)]).first()
    assert [(t, g) for (t, _), g in zip(CASES, got, strict=True)] == CASES


@pytest.mark.parametrize("text", ["a=", "a & ", "(a", "a b", "a>x", "& a", "a)"])
def test_bad_expressions(text):
    with pytest.raises(ValueError):
        predicates.parse(text)


def test_second_front_end():
    assert predicates.parse_sql_like('"type" <> \'x\' AND "n" >= 3') == predicates.parse("type!=x & n>=3")
    assert predicates.parse_sql_like("ELSE") == predicates.parse_sql_like("$area > 3") == predicates.EVERYTHING


@pytest.mark.parametrize(("text", "want"), [("${A}/x", "1/x"), ("$A$$", "1$"), ("\\$A", "$A"), ("${B:-d}", "d"), ("${B:-${A}}", "1"), ("${B}", "${B}"), ("$B", "$B"), ("${A", "${A")])
def test_templates(text, want):
    assert template.expand(text, {"A": "1"}) == want


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.colour(F.lit("#0F8")).alias("a"), scalars.colour(F.lit("300, -5,7")).alias("b"), scalars.colour(F.lit("Red")).alias("c"), scalars.colour(F.lit("nope")).alias("d"),
        scalars.human_size(F.lit(1536)).alias("e"), scalars.human_size(F.lit(7)).alias("f"), scalars.epsg(F.lit("urn:ogc:def:crs:EPSG:6.18.3:3857")).alias("g"), scalars.varint(F.lit(5)).alias("h"), scalars.varint(F.lit(300)).alias("i"),
        scalars.filter_name(F.create_map(*map(F.lit, ("b", "2", "a", "1")))).alias("j"), scalars.signed24(F.lit(0xFFFFFF)).alias("k"), scalars.zoom_of_scale(F.lit(1000)).alias("l"), scalars.older_than(F.lit("nonsense"), F.current_timestamp(), 3).alias("m"),
    ).first()
    assert (list(row.a), list(row.b), list(row.c), row.d) == ([0, 255, 136], [255, 0, 7], [255, 0, 0], None)
    assert (row.e, row.f, row.g, row.h, row.i, row.j, row.k, row.l, row.m) == ("1.5 KB", "7 B", 3857, "0B", "B204", "a=1,b=2", -1, 17, True)


def test_records_round_trip(spark):
    rows = [(i, -33.9 + i, -70.5 + i, -33.0 + i, -69.9 + i, 1000 + i, i) for i in range(20)]
    tiles = spark.createDataFrame(rows, "image_key int, lat_min double, lon_min double, lat_max double, lon_max double, size long, image long")
    back = layout.decoded(layout.encoded(tiles)).collect()
    assert all(abs(a - b) < 1e-6 for got, want in zip(sorted(back), rows, strict=True) for a, b in zip(got, want, strict=True))


def test_block_chain_and_codes(spark):
    files = spark.createDataFrame([(1, 4096 * 241), (2, 1)], "id int, sz long")
    chain = {(r.id, r.part): r.blocks for r in layout.block_chain(layout.placed(files, "id", "sz", 4096)).collect()}
    assert chain[1, 0][:2] == [0, 1] and chain[1, 1][:2] == [240, layout.FILLER] and chain[2, 0][0] == 241
    codes = layout.zoom_codes(spark.createDataFrame([(1, False), (2, True), (3, False)], "level int, has_tiles boolean")).collect()
    assert sorted((r.level, r.code) for r in codes) == [(1, 2 | 0x80), (2, 1), (3, 0)]


def test_blended():
    import numpy as np

    red = np.zeros((2, 2, 4), np.uint8)
    red[..., 0], red[..., 3] = 255, 255
    blue = np.zeros((2, 2, 4), np.uint8)
    blue[..., 2], blue[..., 3] = 255, 255
    assert composite.blended([(red, 1.0), (blue, 0.5)])[0, 0].tolist() in ([128, 0, 127, 255], [127, 0, 128, 255])
    assert composite.blended([]) is None
    assert composite.flattened(np.zeros((1, 1, 4), np.uint8))[0, 0].tolist() == [255, 255, 255]


KEYS = [
    ("https://wmts.example.org/1.0.0/relief/default/current/3857/${z}/${x}/${y}.jpeg", "", "1.0.0-relief-default-current-3857-jpeg"),
    ("https://e/a//b/{zoom}/$x/$y.png?style=dark&v=2", "", "a-b-png-style_dark_v_2"), ("https://e/a b/é/c", "x y", "a%20b-%C3%A9-c-x%20y"), ("http://e/~t/*/(1)+2", "", "~t-%2A-%281%29%2B2"), ("https://e/" + "p" * 300, "", "p" * 200), ("rel/../t.", "", "rel--t"),
]


def test_cache_keys(spark):
    rows = spark.createDataFrame([(i, u, e) for i, (u, e, _) in enumerate(KEYS)], "i int, url string, extra string")
    got = {r.i: r.k for r in rows.select("i", scalars.cache_key(F.col("url"), F.col("extra")).alias("k")).collect()}
    assert [got[i] for i in range(len(KEYS))] == [want for _, _, want in KEYS]


def test_scales_names_and_types(spark):
    scales = {600000000: 0, 500000000: 0, 499999999: 1, 545978: 9, 1000: 17, 999: 18, 150: 20, 100: 20, 99: 21, 0: 21, -5: 21}
    got = spark.createDataFrame([(k,) for k in scales], "d long").select("d", scalars.zoom_of_scale(F.col("d")).alias("z")).collect()
    assert {r.d: r.z for r in got} == scales
    names = {"cyan": [0, 255, 255], "MAGENTA": [255, 0, 255], "grey": [128, 128, 128], "transparent": [0, 0, 0], "brown": None, "0a0B0c": [10, 11, 12]}
    got = spark.createDataFrame([(k,) for k in names], "n string").select("n", scalars.colour(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == names
    urls = {"https://e/{zoom}": "wmts", "https://e/${zoom}/a": "wmts", "https://e/$zoom": None, "https://e/collections/x": "stac", "./a": "path", "a/b": "path", "https://e/a": None, "/x://y": "path"}
    got = spark.createDataFrame([(k,) for k in urls], "u string").select("u", scalars.source_type(F.lit(None).cast("string"), F.col("u")).alias("t")).collect()
    assert {r.u: r.t for r in got} == urls


def test_map_ids(spark):
    import hashlib
    import struct

    seed = "alps:47.810000,45.820000,5.960000,10.490000"
    want = struct.unpack("<I", hashlib.md5(seed.encode()).digest()[:4])[0] & 0x7FFFFFFF  # noqa: S324
    ids = scalars.map_id(F.lit("alps"), F.lit(5.96), F.lit(45.82), F.lit(10.49), F.lit(47.81))
    row = spark.range(1).select(ids.alias("a"), scalars.group_map_id(ids, F.lit(2)).alias("b")).first()
    assert (row.a, row.b) == (want, (want + 3) & 0x7FFFFFFF)


def test_numbers_in_bytes(spark):
    import datetime
    import struct

    values = [0, 1, 127, 128, 300, 8191, 8192, -1]
    got = {r.v: (r.a, r.b) for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", scalars.varint(F.col("v")).alias("a"), scalars.varint_value(scalars.varint(F.col("v"))).alias("b")).collect()}
    assert all(got[v][1] == v for v in values[:6]) and got[8191][0] == "FE7F" and got[8192] == got[-1] == (None, None)
    long = {"0C0000": 1, "04": None, "100000": None, "10000000": 1, "F0FFFFFF": (1 << 28) - 1, "FCFFFF": (1 << 21) - 1}
    got = spark.createDataFrame([(k,) for k in long], "h string").select("h", scalars.varint_value(F.col("h")).alias("v")).collect()
    assert {r.h: r.v for r in got} == long
    numbers = [0, 1, 255, 256, -1, -32768, 2**31 - 1, -(2**31)]
    got = spark.createDataFrame([(v,) for v in numbers], "v long").select("v", scalars.little(F.col("v"), 4).alias("h"), scalars.little_value(scalars.little(F.col("v"), 4), 0, 4, True).alias("b")).collect()
    assert all(bytes.fromhex(r.h) == struct.pack("<i", r.v) and r.b == r.v for r in got)
    moment = datetime.datetime(2026, 5, 2, 13, 4, 59)
    got = spark.createDataFrame([(moment,)], "t timestamp_ntz").select(scalars.date7(F.col("t")).alias("d")).first().d
    assert bytes.fromhex(got) == struct.pack("<HBBBBB", 2026, 5, 2, 13, 4, 59) + b"\0"
