"""Style files, the walk down the levels and fetching, on inputs made here."""

import random

import pytest
from pyspark.sql import functions as F

from tilequarry.operators import levels, predicates
from tilequarry.sources import fetch, qml


def stroke(color, width, order=0, kind="solid", dash=None):
    own = f'<prop k="customdash" v="{dash}"/><prop k="use_custom_dash" v="1"/>' if dash else ""
    return f'<layer class="SimpleLine" pass="{order}"><prop k="line_color" v="{color}"/><prop k="line_width" v="{width}"/><prop k="line_style" v="{kind}"/>{own}</layer>'


SYMBOLS = (
    f'<symbols><symbol name="0" type="line">{stroke("255,0,0,255", 2)}</symbol><symbol name="1" type="line">{stroke("#00f", 1, 1, "dash")}{stroke("0,0,0", 3, 0)}</symbol>'
    f'<symbol name="2" type="line">{stroke("1,2,3", 4, 5)}{stroke("9,9,9", 1, 2)}<layer class="MarkerLine"/></symbol><symbol name="3" type="line">{stroke("5,5,5", 2, 0, "no")}</symbol>'
    f'<symbol name="4" type="line">{stroke("5,5,5", 2, 0, "dot", "3;1.5")}</symbol><symbol name="5" type="marker"/></symbols>'
)
RULES = f"""<qgis><renderer-v2 type="RuleRenderer"><rules>
<rule symbol="0" filter="&quot;kind&quot; = 'road' AND &quot;lanes&quot; &gt;= 2" scalemindenom="1000" scalemaxdenom="50000"/>
<rule filter="group"><rule symbol="1" filter="&quot;kind&quot; = 'path' OR &quot;kind&quot; = 'track'"/><rule symbol="5" filter="x"/></rule>
<rule symbol="2" filter="$length &gt; 3 AND &quot;name&quot;"/><rule symbol="3" filter="ELSE"/></rules>{SYMBOLS}</renderer-v2></qgis>"""


def test_style_rules(spark):
    rules = qml.rules(RULES)
    assert len(rules) == 4 and sorted(rules[0].zooms) == [12, 13, 14, 15, 16, 17] and rules[0].zooms[12] == qml.Line((255, 0, 0), 2.0)
    assert rules[1].default == qml.Line((0, 0, 255), 1.0, (5.0, 2.0), (0, 0, 0), 1.0)
    assert rules[2].default == qml.Line((1, 2, 3), 4.0, None, (9, 9, 9), 0.25) and rules[3].default == qml.Line((5, 5, 5), 0.0, opacity=0.0)
    assert (rules[0].at(11), rules[0].at(30)) == (qml.Line(), qml.Line((255, 0, 0), 2.0))
    rows = [("a", {"kind": "road", "lanes": "3"}, 14), ("b", {"kind": "road", "lanes": "3"}, 5), ("c", {"kind": "track"}, 9), ("d", {"name": "x", "kind": "road"}, 9), ("e", {}, 9)]
    df = spark.createDataFrame(rows, "id string, attrs map<string,string>, z int")
    got = {r.id: (tuple(r.s.color), r.s.width, r.s.border_width) for r in df.select("id", qml.styled(rules, F.col("attrs"), F.col("z")).alias("s")).collect()}
    assert got == {"a": ((255, 0, 0), 2.0, None), "b": ((0, 0, 0), 1.0, None), "c": ((0, 0, 255), 1.0, 1.0), "d": ((1, 2, 3), 4.0, 0.25), "e": ((5, 5, 5), 0.0, None)}


def test_other_renderers(tmp_path):
    categories = f'<qgis><renderer-v2 type="categorizedSymbol" attr="k"><categories><category value="a" symbol="4"/><category value="" symbol="0"/><category value="b" symbol="9"/></categories>{SYMBOLS}</renderer-v2></qgis>'
    got = qml.rules(categories)
    assert [(r.match, r.default.dash) for r in got] == [(predicates.Test("k", "=", "a"), (3.0, 1.5)), (predicates.EVERYTHING, None)]
    assert qml.rules(f'<q><renderer-v2 type="singleSymbol"><symbol>{stroke("red", 1)}</symbol></renderer-v2></q>')[0].default.color == (255, 0, 0)
    for bad in ("<q/>", '<q><renderer-v2 type="heat"/></q>'):
        with pytest.raises(ValueError):
            qml.rules(bad)
    (tmp_path / "s.qml").write_text(RULES)
    assert len(qml.of_layer({"style": "s.qml"}, str(tmp_path))) == 4 and qml.of_layer({"style": "gone.qml"}, str(tmp_path)) == [] == qml.of_layer({}, "")
    own = qml.of_layer({"style": "s.qml", "rules": [{"match": "a=1", "styles": {8: {"color": "red", "width": 2}, 6: {"color": "#010203"}}}]}, str(tmp_path))
    assert len(own) == 1 and own[0].default == qml.Line((1, 2, 3)) and own[0].at(9) == qml.Line((255, 0, 0), 2.0)


def brute_levels(tiles, zooms, bounds):
    """Subdivisions one after another: (level, parent, n, west, south, east, north), and the first child of each."""
    out, first = [], {}

    def children(parent, own, box, level):
        if not own:
            out.append((level, parent, 0, *box))
            return
        side = 1 if len(own) <= 4 else max(2, int(len(own) ** 0.25 + 1e-9))
        s, n, w, e = min(t[3] for t in own), max(t[5] for t in own), min(t[4] for t in own), max(t[6] for t in own)
        cells = {}
        for t in own:
            row = max(0, min(side - 1, int(((t[3] + t[5]) / 2 - s) / (((n - s) or 1.0) / side))))
            col = max(0, min(side - 1, int(((t[4] + t[6]) / 2 - w) / (((e - w) or 1.0) / side))))
            cells.setdefault((row, col), []).append(t)
        for _, some in sorted(cells.items()):
            out.append((level, parent, len(some), min(t[4] for t in some), min(t[3] for t in some), max(t[6] for t in some), max(t[5] for t in some)))

    for level, z in enumerate(zooms):
        own = [t for t in tiles if t[0] == z]
        if not level:
            children(-1, own, bounds, 0)
            continue
        for idx, p in [(i, p) for i, p in enumerate(out) if p[0] == level - 1]:
            first[idx] = len(out)
            children(idx, [t for t in own if p[4] <= (t[3] + t[5]) / 2 <= p[6] and p[3] <= (t[4] + t[6]) / 2 <= p[5]], p[3:], level)
    return out, first


@pytest.mark.parametrize("counts", [{3: 20, 5: 90, 6: 300}, {3: 0, 5: 3, 6: 40}, {3: 4, 5: 0, 6: 1}])
def test_levels(spark, counts):
    rng = random.Random(sum(counts.values()))
    tiles = []
    for z, n in counts.items():
        places = rng.sample([(x, y) for x in range(32) for y in range(32)], n)
        tiles += [(z, x, y, y * 0.25, x * 0.5, y * 0.25 + 0.25, x * 0.5 + 0.5) for x, y in places]
    df = spark.createDataFrame(tiles, "z int, x long, y long, lat_min double, lon_min double, lat_max double, lon_max double")
    tree, members = levels.subdivisions(df, sorted(counts), (0.0, 0.0, 16.0, 8.0))
    want, first = brute_levels(tiles, sorted(counts), (0.0, 0.0, 16.0, 8.0))
    rows = sorted(tree.collect(), key=lambda r: r.idx)
    assert [(r.level, r.parent, r.n_tiles, r.west, r.south, r.east, r.north) for r in rows] == want
    assert {r.idx: r.next_level_index for r in rows if r.next_level_index is not None} == first
    assert members.groupBy("idx").count().count() == sum(1 for w in want if w[2])


def test_fetch(spark, tmp_path):
    origin, cache = tmp_path / "origin", tmp_path / "cache"
    for x in range(3):
        (origin / "4" / str(x)).mkdir(parents=True)
        (origin / "4" / str(x) / "7.jpeg").write_bytes(b"image" * (x + 1))
    tiles = spark.createDataFrame([(4, x, 7) for x in (0, 1, 2, 2, 9)], "z int, x long, y long")
    template = f"file://{origin}/${{z}}/{{x}}/${{y}}.jpeg"
    got = {r.x: (r.state, r.size) for r in fetch.download(tiles, template, str(cache), "jpeg").collect()}
    assert got == {0: ("fetched", 5), 1: ("fetched", 10), 2: ("fetched", 15), 9: ("failed", 0)}
    (cache / "4" / "1" / "7.jgw").unlink()
    again = fetch.download(tiles, template, str(cache), "jpeg")
    assert {r.x: r.state for r in again.collect()} == {0: "cached", 1: "repaired", 2: "cached", 9: "failed"}
    assert not list(cache.rglob("*.part")) and len((cache / "4" / "1" / "7.jgw").read_text().split()) == 6
    total = {r.z: (r.total, r.cached, r.failed) for r in fetch.by_zoom(fetch.download(tiles, template, str(cache), "jpeg", offline=True)).collect()}
    assert total == {4: (4, 3, 1), None: (4, 3, 1)}
