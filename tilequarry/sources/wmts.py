"""Tile services: capabilities documents to tables, the choice of layer, matrix set and address, and fetch policy."""

from __future__ import annotations

import logging
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tilequarry.sources.registry import sources

log = logging.getLogger(__name__)
MATRIX_SCHEMA = "tms_id string, crs string, z int, id string, scale double, tlx double, tly double, tw int, th int, mw long, mh long"
#: Attempts at a tile and the seconds before each further one; failures in a row that retire an address.
ATTEMPTS, PAUSES, RETIRE = 3, (1.0, 2.0), 5


@dataclass
class Layer:
    identifier: str
    title: str = ""
    box: tuple[float, float, float, float] | None = None
    sets: list[str] = field(default_factory=list)
    templates: list[tuple[str, str]] = field(default_factory=list)
    dimensions: dict[str, str] = field(default_factory=dict)


@dataclass
class Capabilities:
    layers: dict[str, Layer]
    sets: dict[str, list[tuple]]
    crs: dict[str, str]

    def matrices(self, spark: SparkSession) -> DataFrame:
        """All matrices as rows; z is the place in the set by falling scale."""
        rows = [(name, self.crs[name], z, *m) for name, ms in self.sets.items() for z, m in enumerate(ms)]
        return spark.createDataFrame(rows, MATRIX_SCHEMA)

    def choose(self, layer: str, tms: str | None = None, kind: str | None = None) -> tuple[Layer, str, str]:
        """Layer, matrix set (the named one, else web Mercator, else the first) and address (by format, then by set, then the first)."""
        if layer not in self.layers:
            raise KeyError(f"no layer {layer!r}; there are {', '.join(sorted(self.layers))}")
        own = self.layers[layer]
        linked = [s for s in own.sets if s in self.sets]
        if tms is not None and str(tms) not in linked:
            raise KeyError(f"layer {layer!r} has no matrix set {tms!r}")
        if not linked or not own.templates:
            raise KeyError(f"layer {layer!r} has no matrix set or no address")
        name = str(tms) if tms is not None else next((s for s in linked if epsg(self.crs[s]) == 3857), linked[0])
        ranked = [t for f, t in own.templates if kind and f == kind] or [t for _, t in own.templates if name in t] or [t for _, t in own.templates]
        return own, name, ranked[0]


def epsg(name: str) -> int | None:
    found = re.search(r"(?i)EPSG.*?([0-9]+)[^0-9]*$", name or "")
    return int(found[1]) if found else None


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _all(node, name: str):
    return [c for c in node if _local(c.tag) == name]


def _text(node, name: str, default: str = "") -> str:
    found = next((c for c in _all(node, name)), None)
    return (found.text or "").strip() if found is not None else default


def parse(xml: str) -> Capabilities:
    """Layers and matrix sets of a capabilities document; malformed parts are skipped with a warning."""
    root = ET.fromstring(xml)
    contents = next((c for c in root.iter() if _local(c.tag) == "Contents"), root)
    layers: dict[str, Layer] = {}
    for node in _all(contents, "Layer"):
        own = Layer(_text(node, "Identifier"), _text(node, "Title"))
        for box in _all(node, "WGS84BoundingBox"):
            low, high = _text(box, "LowerCorner").split(), _text(box, "UpperCorner").split()
            own.box = (float(low[0]), float(low[1]), float(high[0]), float(high[1])) if len(low) == len(high) == 2 else None
        own.sets = [_text(link, "TileMatrixSet") for link in _all(node, "TileMatrixSetLink")]
        own.templates = [(r.get("format", ""), r.get("template", "")) for r in _all(node, "ResourceURL") if r.get("resourceType") == "tile"]
        own.dimensions = {_text(dim, "Identifier"): _text(dim, "Default") for dim in _all(node, "Dimension")}
        if own.identifier:
            layers[own.identifier] = own
        else:
            log.warning("a layer without identifier is skipped")
    sets: dict[str, list[tuple]] = {}
    crs: dict[str, str] = {}
    for node in _all(contents, "TileMatrixSet"):
        rows = []
        for m in _all(node, "TileMatrix"):
            try:
                corner = _text(m, "TopLeftCorner").split()
                rows.append((_text(m, "Identifier"), float(_text(m, "ScaleDenominator")), float(corner[0]), float(corner[1]), int(_text(m, "TileWidth")), int(_text(m, "TileHeight")), int(_text(m, "MatrixWidth")), int(_text(m, "MatrixHeight"))))
            except (ValueError, IndexError):
                log.warning("a malformed matrix is skipped")
        name = _text(node, "Identifier")
        sets[name] = sorted(rows, key=lambda r: -r[1])
        crs[name] = _text(node, "SupportedCRS")
    return Capabilities(layers, sets, crs)


def decision(status: int | None, attempt: int) -> str:
    """What follows an answer: done, stop or retry; ``attempt`` counts from 1 and None is a broken connection."""
    if status == 200:
        return "done"
    if status is not None and status != 429 and status < 500:
        return "stop"
    return "retry" if attempt < ATTEMPTS else "stop"


class Rotation:
    """Addresses in turn; one that fails RETIRE times in a row is left out while others remain."""

    def __init__(self, urls: list[str]):
        self.failed = dict.fromkeys(urls, 0)
        self._next = 0

    def active(self) -> list[str]:
        good = [u for u, n in self.failed.items() if n < RETIRE]
        return good or list(self.failed)

    def take(self) -> str:
        urls = self.active()
        self._next += 1
        return urls[(self._next - 1) % len(urls)]

    def report(self, url: str, good: bool) -> None:
        self.failed[url] = 0 if good else self.failed[url] + 1


def schedule(requests: list[tuple[float, str]], interval: float) -> list[float]:
    """When requests (time, address) may start if those of an address keep an interval."""
    free: dict[str, float] = {}
    out = []
    for at, url in requests:
        start = max(at, free.get(url, at))
        free[url] = start + interval
        out.append(start)
    return out


@sources.register("wmts")
class WmtsSource:
    """A tile source needs no catalog beyond its matrices: tiles are generated, then met with the cache."""

    def handles(self, config) -> bool:
        return config.get("type") in ("wmts", "xyz")

    def catalog(self, spark: SparkSession, config) -> DataFrame:
        with open(config["capabilities_path"], encoding="utf-8") as f:
            return parse(f.read()).matrices(spark)
