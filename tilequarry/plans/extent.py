"""Extents and zooms as given on a command line."""

from __future__ import annotations

import math
from collections.abc import Sequence

from tilequarry.functions.tile import KM_PER_DEGREE
from tilequarry.plans.config import ConfigError

SIDES = ("west", "south", "east", "north")


def extent(bbox: Sequence[float] | None = None, lng: float | None = None, lat: float | None = None, width: float | None = None, height: float | None = None) -> dict[str, float] | None:
    """Bounds from four numbers, or from a centre and kilometres; None if nothing is given. Both at once, or half a centre, is an error."""
    centre = {"lng": lng, "lat": lat, "width": width, "height": height}
    if bbox is not None:
        if any(v is not None for v in centre.values()):
            raise ConfigError("give a box, or a centre with width and height, not both")
        if len(bbox) != 4:
            raise ConfigError(f"a box has four numbers (west south east north), not {len(bbox)}")
        return dict(zip(SIDES, map(float, bbox), strict=True))
    lacking = [name for name, v in centre.items() if v is None]
    if len(lacking) == len(centre):
        return None
    if lacking:
        raise ConfigError("a centre needs lng, lat, width and height; missing: " + ", ".join(lacking))
    dy, dx = height / KM_PER_DEGREE / 2, width / (KM_PER_DEGREE * math.cos(math.radians(lat))) / 2
    return {"west": lng - dx, "south": lat - dy, "east": lng + dx, "north": lat + dy}


def zooms(text: str | None) -> list[int] | None:
    """Zooms from a list with commas."""
    try:
        return None if text is None else [int(part) for part in text.split(",")]
    except ValueError as error:
        raise ConfigError(f"zooms must be whole numbers with commas between, not {text!r}") from error


def check_within(wanted: dict[str, float], bounds: dict[str, float] | None, name: str) -> None:
    """Raise unless an extent lies within bounds, edges included; no bounds hold everything."""
    if bounds and any(wanted[k] < bounds[k] for k in SIDES[:2]) | any(wanted[k] > bounds[k] for k in SIDES[2:]):
        raise ConfigError(f"the extent {[wanted[k] for k in SIDES]} exceeds the bounds {[bounds[k] for k in SIDES]} of {name}")


def narrowed(config, target: str, box: dict[str, float] | None, levels: list[int] | None):
    """A configuration whose target has another extent, which must lie within each layer's bounds, and other zooms."""
    from copy import deepcopy

    from tilequarry.plans.config import resolved

    out = deepcopy(config)
    sections = out.sections
    if target not in sections["targets"]:
        if target not in sections["layers"]:
            raise ConfigError(f"no target and no layer {target!r}")
        sections["targets"][target] = {"layers": [{"ref": target}]}
    for entry in sections["targets"][target]["layers"]:
        if box is not None:
            check_within(box, resolved(out, target, entry)["bounds"], f"{target!r}")
            entry["bounds"] = dict(box)
        if levels is not None:
            entry["zoom_levels"] = list(levels)
    return out
