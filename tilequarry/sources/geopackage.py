"""GeoPackage features: SQLite files read on executors, with the box test inside SQLite."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, fid long, kind string, lines array<array<array<double>>>, attrs map<string,string>"
_ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def geometry(blob: bytes) -> tuple[str, list[list[list[float]]]]:
    """Kind and lines (lists of x, y) of a geometry blob: points and lines, single or multiple; others are empty."""
    if blob[:2] == b"GP":
        blob = blob[8 + _ENVELOPE[blob[3] >> 1 & 7] :]
    return _wkb(memoryview(blob), 0)[:2]


def _wkb(b: memoryview, at: int) -> tuple[str, list, int]:
    order = "<" if b[at] else ">"
    code = struct.unpack_from(order + "I", b, at + 1)[0]
    at, dims = at + 5, 2 + (code // 1000 in (1, 2)) + 2 * (code // 1000 == 3)
    kind = code % 1000

    def point(at: int) -> tuple[list[float], int]:
        return list(struct.unpack_from(f"{order}{dims}d", b, at)[:2]), at + 8 * dims

    if kind == 1:
        p, at = point(at)
        return "Point", [[p]], at
    n = struct.unpack_from(order + "I", b, at)[0]
    at += 4
    if kind == 2:
        line = []
        for _ in range(n):
            p, at = point(at)
            line.append(p)
        return "LineString", [line], at
    if kind in (4, 5):
        lines = []
        for _ in range(n):
            _, part, at = _wkb(b, at)
            lines += part
        return {4: "MultiPoint", 5: "MultiLineString"}[kind], lines, at
    return "Other", [], at


def features(paths: DataFrame, box: tuple[float, float, float, float] | None = None, layer: str | None = None) -> DataFrame:
    """Features of the files in paths(path): path, fid, kind, lines, attrs without nulls.

    The files must lie in a folder that executors share. A box w, s, e, n becomes a condition on
    the layer's spatial index where it has one.
    """

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in stream:
            for path in part["path"]:
                con = sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)
                try:
                    table, column = con.execute("select table_name, column_name from gpkg_geometry_columns" + (" where table_name = ?" if layer else ""), (layer,) if layer else ()).fetchone()
                    sql, args = f'select rowid, * from "{table}"', ()
                    index = f"rtree_{table}_{column}"
                    if box and con.execute("select 1 from sqlite_master where name = ?", (index,)).fetchone():
                        sql += f' where rowid in (select id from "{index}" where minx <= ? and maxx >= ? and miny <= ? and maxy >= ?)'
                        args = (box[2], box[0], box[3], box[1])
                    rows = con.execute(sql, args)
                    names = [d[0] for d in rows.description]
                    out = []
                    for row in rows:
                        record = dict(zip(names, row, strict=True))
                        kind, lines = geometry(record.pop(column)) if record.get(column) else ("Other", [])
                        xy = [p for line in lines for p in line]
                        if box and xy and (max(p[0] for p in xy) < box[0] or min(p[0] for p in xy) > box[2] or max(p[1] for p in xy) < box[1] or min(p[1] for p in xy) > box[3]):
                            continue
                        out.append((path, row[0], kind, lines, {k: str(v) for k, v in record.items() if v is not None and k not in (column, "rowid")}))
                finally:
                    con.close()
                yield pd.DataFrame(out, columns=["path", "fid", "kind", "lines", "attrs"])

    return paths.select("path").mapInPandas(run, SCHEMA)
