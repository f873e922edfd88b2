"""Sources, configuration, build plans, marks and kernels on small inputs made here."""

import json
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilequarry.operators import manifest, raster, watermark
from tilequarry.plans import build, config
from tilequarry.sources import files, geopackage, registry, stac, wmts

XML = """<Capabilities xmlns="w" xmlns:ows="o"><Contents>
<Layer><ows:Title>Relief</ows:Title><ows:Identifier>relief</ows:Identifier><ows:WGS84BoundingBox><ows:LowerCorner>5 45</ows:LowerCorner><ows:UpperCorner>10 48</ows:UpperCorner></ows:WGS84BoundingBox>
<TileMatrixSetLink><TileMatrixSet>geo</TileMatrixSet></TileMatrixSetLink><TileMatrixSetLink><TileMatrixSet>merc</TileMatrixSet></TileMatrixSetLink>
<Dimension><ows:Identifier>Time</ows:Identifier><Default>now</Default></Dimension>
<ResourceURL resourceType="tile" format="image/png" template="https://e/geo/{x}.png"/><ResourceURL resourceType="tile" format="image/jpeg" template="https://e/merc/{x}.jpeg"/></Layer>
<TileMatrixSet><ows:Identifier>geo</ows:Identifier><ows:SupportedCRS>urn:ogc:def:crs:EPSG::4326</ows:SupportedCRS><TileMatrix><ows:Identifier>0</ows:Identifier><ScaleDenominator>bad</ScaleDenominator></TileMatrix></TileMatrixSet>
<TileMatrixSet><ows:Identifier>merc</ows:Identifier><ows:SupportedCRS>urn:ogc:def:crs:EPSG:6.18:3857</ows:SupportedCRS>
<TileMatrix><ows:Identifier>1</ows:Identifier><ScaleDenominator>100</ScaleDenominator><TopLeftCorner>-10 10</TopLeftCorner><TileWidth>256</TileWidth><TileHeight>256</TileHeight><MatrixWidth>2</MatrixWidth><MatrixHeight>2</MatrixHeight></TileMatrix>
<TileMatrix><ows:Identifier>0</ows:Identifier><ScaleDenominator>200</ScaleDenominator><TopLeftCorner>-10 10</TopLeftCorner><TileWidth>256</TileWidth><TileHeight>256</TileHeight><MatrixWidth>1</MatrixWidth><MatrixHeight>1</MatrixHeight></TileMatrix></TileMatrixSet>
</Contents></Capabilities>"""


def test_capabilities(spark):
    caps = wmts.parse(XML)
    assert caps.layers["relief"].box == (5, 45, 10, 48) and caps.layers["relief"].dimensions == {"Time": "now"}
    assert [m[0] for m in caps.sets["merc"]] == ["0", "1"] and caps.sets["geo"] == []
    assert caps.choose("relief")[1:] == ("merc", "https://e/merc/{x}.jpeg")
    assert caps.choose("relief", kind="image/png")[2] == "https://e/geo/{x}.png"
    assert caps.matrices(spark).count() == 2
    with pytest.raises(KeyError):
        caps.choose("other")


def test_fetch_policy():
    assert [wmts.decision(*a) for a in ((200, 1), (404, 1), (429, 1), (500, 2), (500, 3), (None, 1))] == ["done", "stop", "retry", "retry", "stop", "retry"]
    turn = wmts.Rotation(["a", "b"])
    for _ in range(wmts.RETIRE):
        turn.report("a", False)
    assert {turn.take() for _ in range(4)} == {"b"}
    assert wmts.schedule([(0, "a"), (0, "a"), (0, "b"), (9, "a")], 2) == [0, 2, 0, 9]


def test_item_catalog(spark, tmp_path):
    item = lambda i, box, **assets: {"id": i, "bbox": box, "assets": assets}
    page = {"features": [item("a", [7, 46, 8, 47], data={"href": "a.tif", "type": "x"}), item("b", [8, 46, 9, 47], thumb={"href": "b.png", "type": "image/png"}, big={"href": "b.x", "type": "image/tiff; application=geotiff"}), item("c", [20, 0, 21, 1], z={"href": "c.TIFF"})]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    rows = stac.items(spark, [str(tmp_path / "p.json")])
    assert {r.id for r in stac.within(rows, 7.5, 46, 8, 47).collect()} == {"a", "b"}
    assert {r.id: r.h for r in rows.select("id", stac.raster_asset(F.col("assets")).alias("h")).collect()} == {"a": "a.tif", "b": "b.x", "c": "c.TIFF"}
    # a filter selects among the rasters, not among all assets
    assert rows.where("id = 'b'").select(stac.raster_asset(F.col("assets"), {"type": "image/png"}).alias("h")).first().h is None


def test_asset_tiers(spark):
    tiff, cog = "image/tiff; application=geotiff", "image/tiff; application=geotiff; profile=cloud-optimized"
    rows = [
        ("keys", {"visual": {"href": "v.tif"}, "image": {"href": "i.tif", "gsd": "2"}}, "i.tif", None), ("media", {"a": {"href": "a", "type": cog}, "z": {"href": "z.tif"}}, "a", None), ("unknown media", {"a": {"href": "a", "type": "image/tiff; x"}}, None, None),
        ("package", {"p": {"href": "p.GPKG.zip"}, "q": {"href": "q", "type": "text/html"}}, None, "p.GPKG.zip"), ("both", {"data": {"href": "d.tif", "type": tiff}, "z": {"href": "z.gpkg.zip"}}, "d.tif", "d.tif"),
    ]
    df = spark.createDataFrame([(n, a) for n, a, _, _ in rows], "n string, assets map<string,map<string,string>>")
    got = {r.n: (r.a, r.b) for r in df.select("n", stac.raster_asset(F.col("assets")).alias("a"), stac.package_asset(F.col("assets")).alias("b")).collect()}
    assert got == {n: (a, b) for n, _, a, b in rows}
    two = spark.createDataFrame([({"geotiff": {"href": "g", "gsd": "1"}, "cog": {"href": "c", "gsd": "2"}},)], "assets map<string,map<string,string>>")
    assert two.select(stac.raster_asset(F.col("assets"), {"gsd": 2}).alias("h")).first().h == "c"
    with pytest.raises(Exception, match="asset_filter"):
        two.select(stac.raster_asset(F.col("assets")).alias("h")).collect()


def test_tile_cache(spark, tmp_path):
    for name in ("cache/s/8/1/2.jpg", "cache/s/8/1/2.jgw", "cache/s/8/1/3.jpg"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * 7)
    found = files.listing(spark, [str(tmp_path)])
    assert [(r.z, r.x, r.y, r["size"]) for r in files.tile_cache(found).collect()] == [(8, 1, 2, 7)]
    assert {(r.source, r.ext): r.files for r in files.status(found).collect()}[(None, None)] == 3
    assert registry.sources.resolve("path") is files.PathSource
    with pytest.raises(KeyError, match="there are"):
        registry.sources.resolve("ftp")


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    con = sqlite3.connect(path)
    con.execute("create table gpkg_geometry_columns (table_name, column_name)")
    con.execute("insert into gpkg_geometry_columns values ('t', 'geom')")
    con.execute("create table t (geom blob, name text, n int)")
    line = b"GP\0\x01" + b"\0" * 4 + struct.pack("<BII", 1, 2, 2) + struct.pack("<4d", 1, 2, 3, 4)
    con.execute("insert into t values (?, 'x', null)", (line,))
    con.execute("insert into t values (?, 'far', 2)", (b"GP\0\x01" + b"\0" * 4 + struct.pack("<BI2d", 1, 1, 50, 60),))
    con.commit()
    con.close()
    got = geopackage.features(spark.createDataFrame([(path,)], "path string"), (0, 0, 10, 10)).collect()
    assert [(r.kind, r.lines, r.attrs) for r in got] == [("LineString", [[[1.0, 2.0], [3.0, 4.0]]], {"name": "x"})]


def test_configuration(spark, tmp_path):
    (tmp_path / "base.yaml").write_text("sources:\n  s: {type: wmts, urls: ['https://e/{x}']}\nlayers:\n  l: {source: s, zoom_levels: [6, 7], bounds: alps, opacity: 0.5}\nbounds:\n  alps: {west: 6, south: 46, east: 8, north: 47}\n")
    (tmp_path / "main.yaml").write_text("includes: [base.yaml]\ntargets:\n  t:\n    layers: [{ref: l}, {ref: l, opacity: {6: 0.25}, zoom_levels: []}]\nsettings: {quality: 80}\n")
    loaded = config.load(tmp_path / "main.yaml", {})
    plan = build.plan(spark, loaded, "t", spark.createDataFrame([(6, 33, 22, "p", 10)], "z int, x long, y long, path string, size long"))
    stack = plan.stack.collect()
    assert {(r.z, r.pos): r.opacity for r in stack} == {(6, 0): 0.5, (7, 0): 0.5, (6, 1): 0.25, (7, 1): 1.0}
    total = plan.summary.where("z is null").first()
    assert total.total == plan.tiles.count() == plan.layout.count() and total.cached == 1
    assert config.setting(loaded, "quality", default=1) == 80
    (tmp_path / "bad.yaml").write_text("layers:\n  l: {source: none, zoom_levels: [40]}\ntargets:\n  t: {layers: [{ref: gone}]}\n")
    with pytest.raises(config.ConfigError, match="none.*40.*gone"):
        config.load(tmp_path / "bad.yaml", {})
    (tmp_path / "loop.yaml").write_text("includes: [loop.yaml]\n")
    with pytest.raises(config.ConfigError, match="circle"):
        config.load(tmp_path / "loop.yaml", {})
    (tmp_path / "odd.yaml").write_text("include: [base.yaml]\n")
    with pytest.raises(config.ConfigError, match="unknown keys: include"):
        config.load(tmp_path / "odd.yaml", {})


def test_resume(spark, tmp_path):
    path = str(tmp_path / "m")
    assert manifest.left(spark, path, "t", [3, 4]) == [3, 4]
    manifest.commit(spark, path, "t", 3, 9)
    assert manifest.left(spark, path, "t", [3, 4]) == [4] and manifest.left(spark, path, "t", [4]) == [4]
    assert manifest.without(manifest.read(spark, path), "t").count() == 0


def test_marks(spark):
    key, map_id = watermark.key_of("secret"), 0x09C102B0
    at = watermark.place_of(key, map_id)
    assert 0x400 + 128 <= at <= 0x1000 - 286 and at == watermark.place_of(key, map_id) != watermark.place_of(key, map_id + 1)
    df = spark.createDataFrame([(bytes(range(256)) * 32,)], "data binary")
    marked = df.select("data", watermark.marked(F.col("data"), key, map_id, "buyer 7", "order=gGeN33kt").alias("m"))
    got = marked.select("data", "m", watermark.header_text(F.col("m")).alias("h"), watermark.payload(F.col("m"), key, map_id).alias("p"), watermark.payload(F.col("m"), watermark.key_of("other"), map_id).alias("x"), watermark.header_text(F.col("data")).alias("none")).first()
    data, m = bytes(got.data), bytes(got.m)
    assert (len(m), got.h, got.p, got.x, got.none) == (8192, "order=gGeN33kt", "buyer 7", None, None)
    assert m[0x400:0x406] == b"CH" + struct.pack("<HH", 20, 1) and m[at : at + 6] == b"CW" + struct.pack("<HH", 12 + 7 + 16, 0)
    assert m[at + 6 : at + 18] == watermark.nonce_of(key, b"buyer 7")
    assert m[:0x400] == data[:0x400] and m[0x414:at] == data[0x414:at] and m[at + 41 :] == data[at + 41 :]
    with pytest.raises(ValueError, match="120"):
        watermark.header("x" * 121)


def test_kernels(spark):
    flat = np.full((64, 64, 3), 90, np.uint8)
    assert (raster.plate_tile(flat, 5, 10, 12, 32) == 90).all()
    assert raster.tile_of(flat, (0, 0, 1, 1), (5, 5, 6, 6)) is None
    half = raster.tile_of(flat, (0, 0, 1, 1), (0.5, 0, 1.5, 1), 16)
    assert (half[:, :7] == 90).all() and (half[:, 9:] == 0).all()
    line = raster.drawn(16, [np.array([[0, 8], [16, 8]])], (1, 2, 3), 2, ((9, 9, 9), 2))
    assert line[8, 8].tolist() == [1, 2, 3, 255] and line[5, 8].tolist() == [9, 9, 9, 255] and line[0, 0, 3] == 0
    assert raster.mosaic({(3, 3): flat, (4, 4): flat}, 64).shape == (128, 128, 3)
    pixels = spark.createDataFrame([(i, j, 0, i * 4) for i in range(4) for j in range(4)], "px int, py int, band int, value int")
    assert sorted((r.px, r.value) for r in raster.overview(pixels).collect()) == [(0, 2), (0, 2), (1, 10), (1, 10)]
    dashes = raster.dashes(spark.createDataFrame([(1, i, float(3 * i), 0.0) for i in range(4)], "line_id int, ord int, x double, y double"), (4.0, 4.0)).orderBy("ord").collect()
    assert [(r.start, r.drawn) for r in dashes] == [(0.0, True), (3.0, True), (6.0, False)]


def test_command_line_reads_marks(spark, tmp_path, capsys):
    from tilequarry import cli

    path = tmp_path / "a.img"
    path.write_bytes(bytes(0x400) + watermark.header("order=1") + bytes(0xC00))
    assert cli.main(["mark", str(path)]) == 0 and capsys.readouterr().out.strip().endswith("order=1")


def test_packed_files(spark, tmp_path):
    """Header, directory and payloads written as one file and read back; a group above the cap becomes bands."""
    from tilequarry.functions import scalars
    from tilequarry.operators import aggregate, packed

    subfiles = spark.createDataFrame([("a.img", 0, "0000000A", "GMP", 9_000_000), ("a.img", 1, "MAPSOURC", "MPS", 98), ("b.img", 0, "0000000B", "GMP", 5)], "file string, ord int, name string, kind string, size long")
    placed = packed.file_layout(subfiles)
    laid = {(r.file, r.ord): r for r in placed.collect()}
    a = laid["a.img", 0]
    assert (a.block, a.n_blocks, a.parts, a.data_start) == (32768, 275, 2, 32768) and laid["a.img", 1].start_block == 276 and a.total_blocks == 277
    heads = placed.where("ord = 0").select("file", packed.header(F.lit("Relief map"), F.lit("E807050D1E3B"), F.col("e2"), F.col("total_blocks")).alias("h"), "data_start")
    entries = packed.directory(placed).orderBy("file", "ord", "part").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part", "entry"))), lambda e: e["entry"]), "").alias("d"))
    start = heads.join(entries, "file").select("file", F.lit(0).alias("ord"), F.unhex(F.rpad(F.concat(F.rpad("h", 2 * packed.DIRECTORY_AT, "0"), "d"), F.col("data_start").cast("int") * 2, "0")).alias("data"))
    body = spark.createDataFrame([("a.img", 2, b"xy"), ("a.img", 1, b"JPEG"), ("b.img", 1, b"z")], "file string, ord int, data binary")
    got = {r.file: r for r in packed.written(start.unionByName(body), str(tmp_path / "out")).collect()}
    assert {k: r.bytes for k, r in got.items()} == {"a.img": 32768 + 6, "b.img": 32768 + 1}
    raw = (tmp_path / "out" / "a.img").read_bytes()
    assert raw[0x10:0x17] == b"DSKIMG\0" and raw[0x41:0x49] == b"GARMIN\0\0" and raw[0x49:0x5D] == b"Relief map".ljust(20) and raw[0x61:0x65] == bytes([9, 6]) + struct.pack("<H", 277)
    assert raw[0x39:0x3F].hex() == "e807050d1e3b" and raw[0x1BE:0x1C3].hex() == "010000ff60" and raw[0x1FE:0x200] == b"\x55\xaa" and struct.unpack("<I", raw[0x1CA:0x1CE])[0] == 277 * 64
    assert raw[0x1000] == 1 and raw[0x1010] == 3 and struct.unpack("<H", raw[0x1020:0x1022])[0] == 0 and raw[32768:] == b"JPEGxy"
    files_read = spark.read.format("binaryFile").load(str(tmp_path / "out")).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
    back = {(r.path, r.name): r for r in packed.parsed_directory(files_read).collect()}
    assert back["a.img", "0000000A"].blocks == list(range(1, 276)) and back["a.img", "0000000A"].size == 9_000_000 and back["a.img", "MAPSOURC"].blocks == [276] and back["b.img", "0000000B"].blocks == [1]
    head = files_read.where("path = 'a.img'").select(*[c.alias(n) for n, c in packed.parsed_header(F.col("content")).items()]).first()
    assert (head.name, head.e2, head.total_blocks) == ("Relief map", 6, 277)
    assert spark.createDataFrame([(b"short",)], "content binary").select(packed.parsed_header(F.col("content"))["name"].alias("n")).first().n is None

    tiles = spark.createDataFrame([(z, float(k), k, 10) for z, n in ((1, 2), (2, 3), (3, 23), (4, 1)) for k in range(n)], "z int, lat double, x int, size long")
    groups = {}
    for r in aggregate.packed_groups(tiles, "size", "lat", ["x"], 50).collect():
        groups.setdefault(r.grp, []).append((r.z, r.x))
    assert sorted(groups[0]) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)] and [len(groups[g]) for g in (1, 2, 3, 4, 5)] == [5, 5, 5, 5, 3] and groups[6] == [(4, 0)]
    assert scalars.block_exponent is not None


def test_nearest_and_intervals(spark):
    from tilequarry.operators import spatial

    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 170.0, 60.0), (3, -179.0, -80.0)], "id long, lon double, lat double")
    centres = spark.createDataFrame([(7, 0.5, 0.5), (8, 0.5, -0.5), (9, -100.0, 10.0)], "id long, lon double, lat double")
    got = {r.point_id: (r.centre_id, r.dist2) for r in spatial.nearest(points, centres, 0.25).collect()}
    want = {i: min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in ((7, 0.5, 0.5), (8, 0.5, -0.5), (9, -100.0, 10.0))) for i, x, y in ((1, 0.0, 0.0), (2, 170.0, 60.0), (3, -179.0, -80.0))}
    assert got == {i: (k, d) for i, (d, k) in want.items()}
    assert spatial.nearest(points, centres.limit(0)).count() == 0
    values = spark.createDataFrame([(g, v) for g in ("a", "b", None) for v in (0, 5, 9, 10, 99)] + [("c", 1), ("a", None)], "g string, v int")
    spans = spark.createDataFrame([("a", 0, 5, 1), ("a", 5, 10, 2), ("b", 3, 6, 3), (None, 9, 11, 4)], "g string, low int, high int, span int")
    got = sorted((str(r.g), r.v, r.span) for r in spatial.in_intervals(values, spans, ["g"], "v").collect())
    assert got == [("None", 9, 4), ("None", 10, 4), ("a", 0, 1), ("a", 5, 2), ("a", 9, 2), ("b", 5, 3)]


def test_boxes_across_the_date_line(spark):
    from tilequarry.operators import grid

    boxes = spark.createDataFrame([(1, 170.0, -10.0, -170.0, 10.0), (2, 10.0, -1.0, 9.0, 1.0)], "id int, w double, s double, e double, n double")
    got = [(r.id, r.z, r.x, r.y) for r in grid.grid(grid.zooms(boxes, [0, 1, 3])).collect()]
    assert len(got) == len(set(got)) and {x for i, z, x, _ in got if (i, z) == (1, 3)} == {0, 7} and {x for i, z, x, _ in got if (i, z) == (2, 3)} == set(range(8))
