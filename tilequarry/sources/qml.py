"""Line styles from style files in XML (QML): rules, categories and single symbols, with casings and dashes.

A file is read on the driver; its rules become one CASE over attributes and zoom, like all rules.
"""

from __future__ import annotations

import logging
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilequarry.functions import scalars
from tilequarry.operators import predicates

log = logging.getLogger(__name__)
#: Dashes of named line styles, and the width of a casing that is narrower than its core.
DASHES = {"dash": (5.0, 2.0), "dot": (1.0, 2.0), "dash dot": (5.0, 2.0, 1.0, 2.0)}
NARROW = 0.5
#: Type of a style as a column.
STYLE = "struct<color:array<int>,width:double,dash:array<double>,border_color:array<int>,border_width:double,opacity:double>"


@dataclass(frozen=True)
class Line:
    """What a line looks like; colours are red, green and blue."""

    color: tuple[int, ...] = (0, 0, 0)
    width: float = 1.0
    dash: tuple[float, ...] | None = None
    border_color: tuple[int, ...] | None = None
    border_width: float | None = None
    opacity: float = 1.0

    def column(self) -> Column:
        listed = lambda values, kind: F.lit(None).cast(f"array<{kind}>") if values is None else F.array(*map(F.lit, values)).cast(f"array<{kind}>")
        parts = {"color": listed(self.color, "int"), "width": F.lit(float(self.width)), "dash": listed(self.dash, "double"), "border_color": listed(self.border_color, "int"), "border_width": F.lit(self.border_width).cast("double"), "opacity": F.lit(float(self.opacity))}
        return F.struct(*[c.alias(n) for n, c in parts.items()])


@dataclass
class Rule:
    """A match expression, styles by the zoom from which on they hold, and the style below all of them."""

    match: object
    zooms: dict[int, Line] = field(default_factory=dict)
    default: Line = Line()

    def at(self, zoom: int) -> Line:
        below = [z for z in self.zooms if z <= zoom]
        return self.zooms[max(below)] if below else self.default

    def column(self, zoom: Column) -> Column:
        """The style at a zoom, as STYLE: neighbouring zooms of one style are one case."""
        out, last = self.default.column(), self.default
        for z in sorted(self.zooms):
            if self.zooms[z] != last or z == min(self.zooms):
                out, last = F.when(zoom >= z, self.zooms[z].column()).otherwise(out), self.zooms[z]
        return out


def rgb(text: str) -> tuple[int, ...]:
    """A colour by name, as #RRGGBB, #RGB or RRGGBB, or as 'r,g,b[,a]' (clamped); ValueError if it is none."""
    low = text.strip().lower()
    if low in scalars.COLOURS:
        return scalars.COLOURS[low]
    digits = low.removeprefix("#")
    if low.startswith("#") and len(digits) == 3:
        digits = "".join(c * 2 for c in digits)
    if len(digits) == 6 and all(c in "0123456789abcdef" for c in digits):
        return tuple(bytes.fromhex(digits))
    parts = low.split(",")
    if len(parts) in (3, 4):
        return tuple(max(0, min(255, int(p))) for p in parts[:3])
    raise ValueError(f"{text!r} is no colour")


def zoom_of(denominator: float) -> int:
    """The zoom of a scale denominator, as scalars.zoom_of_scale has it."""
    return next((z for z, least in enumerate(scalars.SCALES) if denominator >= least), len(scalars.SCALES))


def _strokes(symbol: ET.Element) -> list[tuple[int, Line]]:
    """Drawing order and style of a symbol's plain lines; markers, arrows and effects are left out."""
    out = []
    for layer in symbol.findall("layer"):
        if layer.get("class") != "SimpleLine":
            continue
        prop = {p.get("k"): p.get("v", "") for p in layer.findall("prop")}
        color, width, kind = rgb(prop.get("line_color", "0,0,0")), float(prop.get("line_width", 1.0)), prop.get("line_style", "solid")
        own = tuple(float(x) for x in prop.get("customdash", "").split(";") if x.strip())
        if kind == "no":
            line = Line(color, 0.0, opacity=0.0)
        else:
            line = Line(color, width, own if prop.get("use_custom_dash") == "1" and own else DASHES.get(kind))
        out.append((int(layer.get("pass", "0")), Line(line.color, width, line.dash, opacity=line.opacity) if kind != "no" else line))
    return out


def line_of(symbol: ET.Element) -> Line | None:
    """The style of a symbol: of several lines the one drawn first is the casing of the one drawn last."""
    strokes = [line for _, line in sorted(_strokes(symbol), key=lambda s: s[0])]
    if not strokes:
        return None
    if len(strokes) == 1:
        return strokes[0]
    casing, core = strokes[0], strokes[-1]
    wider = casing.width - core.width
    return Line(core.color, core.width, core.dash, casing.color, (wider if wider >= 0 else NARROW) / 2, core.opacity)


def _leaves(parent: ET.Element) -> list[ET.Element]:
    out = []
    for rule in parent.findall("rule"):
        out += _leaves(rule) if rule.find("rule") is not None else [rule]
    return out


def _scaled(rule: ET.Element, line: Line) -> Rule:
    match = predicates.parse_sql_like(rule.get("filter", ""))
    low, high = rule.get("scalemindenom"), rule.get("scalemaxdenom")
    if low is None and high is None:
        return Rule(match, {}, line)
    zooms = range(zoom_of(int(high) if high else scalars.SCALES[0]), zoom_of(int(low) if low else 1) + 1)
    return Rule(match, dict.fromkeys(zooms, line))


def rules(xml: str) -> list[Rule]:
    """The rules of a style file; ValueError if it has no renderer or one of another kind."""
    root = ET.fromstring(xml)
    renderer = root.find("renderer-v2")
    if renderer is None:
        raise ValueError("no renderer-v2 in the style file")
    kind = renderer.get("type", "")
    if kind == "singleSymbol":
        symbol = renderer.find("symbol")
        line = line_of(symbol) if symbol is not None else None
        return [Rule(predicates.EVERYTHING, {}, line)] if line else []
    if kind not in ("RuleRenderer", "categorizedSymbol"):
        raise ValueError(f"renderer {kind!r} is not one of RuleRenderer, categorizedSymbol, singleSymbol")
    listed = renderer.find("symbols") if renderer.find("symbols") is not None else root.find("symbols")
    lines = {s.get("name", ""): line_of(s) for s in (listed if listed is not None else []) if s.tag == "symbol" and s.get("type") == "line"}
    if kind == "RuleRenderer":
        top = renderer.find("rules")
        return [_scaled(r, lines[r.get("symbol")]) for r in (_leaves(top) if top is not None else []) if lines.get(r.get("symbol"))]
    out = []
    for c in renderer.iterfind("categories/category"):
        if lines.get(c.get("symbol")):
            value = c.get("value", "")
            match = predicates.EVERYTHING if c.get("type") == "NULL" or not value else predicates.Test(renderer.get("attr", ""), "=", value)
            out.append(Rule(match, {}, lines[c.get("symbol")]))
    return out


def of_layer(layer: dict, folder: str) -> list[Rule]:
    """A layer's rules: its own ones before those of its style file; a missing file is a warning and no rule."""
    if layer.get("rules"):
        out = []
        for rule in layer["rules"]:
            styles = {k: _line(v) for k, v in (rule.get("styles") or {}).items()}
            zooms = {int(k): v for k, v in styles.items() if k != "default"}
            default = styles.get("default") or (zooms[min(zooms)] if zooms else Line())
            out.append(Rule(predicates.parse(rule.get("match", "")), zooms, default))
        return out
    if not layer.get("style"):
        return []
    path = layer["style"] if layer["style"].startswith("/") else f"{folder}/{layer['style']}"
    try:
        with open(path, encoding="utf-8") as f:
            return rules(f.read())
    except FileNotFoundError:
        log.warning("style file %s is missing", path)
        return []


def _line(style: dict) -> Line:
    color = lambda name: rgb(str(style[name])) if style.get(name) is not None else None
    border = style.get("border_width")
    return Line(color("color") or (0, 0, 0), float(style.get("width", 1.0)), tuple(map(float, style["dash"])) if style.get("dash") else None, color("border_color"), None if border is None else float(border), float(style.get("opacity", 1.0)))


def styled(listed: list[Rule], attrs: Column, zoom: Column) -> Column:
    """The style (STYLE) of the first rule that matches attributes, at a zoom; null if none does."""
    out = F.lit(None).cast(STYLE)
    for rule in reversed(listed):
        out = F.when(predicates.compiled(rule.match, attrs), rule.column(zoom)).otherwise(out)
    return out
