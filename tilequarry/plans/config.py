"""Catalogs in YAML: includes, merges (the last file wins), checks, references, and settings."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tilequarry.functions import template
from tilequarry.operators import predicates

log = logging.getLogger(__name__)
SECTIONS = ("sources", "layers", "targets", "bounds", "products")
#: Source types, and the zooms that a layer may name.
TYPES, LOWEST, HIGHEST = ("wmts", "xyz", "stac", "path"), 0, 22


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    sections: dict[str, dict[str, dict]] = field(default_factory=lambda: {s: {} for s in SECTIONS})
    settings: dict[str, Any] = field(default_factory=dict)

    def entries(self, spark: SparkSession) -> DataFrame:
        """Target entries as rows: target, pos, ref, west, south, east, north, zooms, opacity, opacity_by_zoom."""
        rows = []
        for name, target in self.sections["targets"].items():
            for pos, entry in enumerate(target["layers"]):
                layer = resolved(self, name, entry)
                b, o = layer.get("bounds") or {}, layer.get("opacity", 1.0)
                rows.append((name, pos, entry.get("ref"), *[b.get(k) for k in ("west", "south", "east", "north")], layer.get("zoom_levels") or [], None if isinstance(o, dict) else float(o), {int(k): float(v) for k, v in o.items()} if isinstance(o, dict) else None))
        return spark.createDataFrame(rows, "target string, pos int, ref string, west double, south double, east double, north double, zooms array<int>, opacity double, opacity_by_zoom map<int,double>")


def load(path: str | Path, variables: dict[str, str] | None = None) -> Config:
    """The configuration of a file and all that it includes, checked."""
    config = Config()
    _load(Path(path).resolve(), config, variables if variables is not None else dict(os.environ), ())
    check(config)
    return config


def _load(path: Path, config: Config, variables: dict[str, str], seen: tuple[Path, ...]) -> None:
    import yaml

    if path in seen:
        raise ConfigError("includes form a circle: " + " -> ".join(p.name for p in (*seen, path)))
    data = yaml.safe_load(template.expand(path.read_text(encoding="utf-8"), variables)) or {}
    if not isinstance(data, dict):
        raise ConfigError(f"{path}: a mapping is expected")
    unknown = set(data) - {"includes", "settings", *SECTIONS}
    if unknown:
        raise ConfigError(f"{path}: unknown keys: {', '.join(sorted(map(str, unknown)))}")
    includes = data.get("includes") or []
    if not isinstance(includes, list) or not all(isinstance(other, str) for other in includes):
        raise ConfigError(f"{path}: includes must be a list of paths")
    for other in includes:
        _load((path.parent / other).resolve(), config, variables, (*seen, path))
    for section in SECTIONS:
        for name, item in (data.get(section) or {}).items():
            if name in config.sections[section]:
                log.warning("%s: %s %r is defined again; this one counts", path.name, section, name)
            config.sections[section][name] = dict(item or {}, config_dir=str(path.parent)) if section == "sources" else item
    config.settings.update({k: v for k, v in (data.get("settings") or {}).items() if v is not None})


def bounds_of(config: Config, value: Any, where: str) -> dict[str, float] | None:
    """Bounds by name or as west, south, east, north."""
    if value is None:
        return None
    if isinstance(value, str):
        if value not in config.sections["bounds"]:
            raise ConfigError(f"{where}: no bounds {value!r}")
        value = config.sections["bounds"][value]
    try:
        out = {k: float(value[k]) for k in ("west", "south", "east", "north")}
    except (KeyError, TypeError, ValueError) as error:
        raise ConfigError(f"{where}: bounds need numbers for west, south, east and north") from error
    if out["west"] >= out["east"] or out["south"] >= out["north"]:
        raise ConfigError(f"{where}: west must be below east and south below north")
    return out


def resolved(config: Config, target: str, entry: dict) -> dict:
    """An entry with what it inherits from the layer that it names; empty values inherit, null rules do not."""
    base = dict(config.sections["layers"].get(entry.get("ref"), {}))
    for key, value in entry.items():
        if key != "ref" and (value not in ("", [], {}) if key not in ("rules", "style") else value != ""):
            base[key] = value
    base["bounds"] = bounds_of(config, base.get("bounds"), f"target {target!r}")
    return base


def check(config: Config) -> None:
    """Raise ConfigError with every fault found."""
    faults = []
    s = config.sections
    for name, source in s["sources"].items():
        if source.get("type") not in TYPES:
            faults.append(f"source {name!r}: type must be one of {', '.join(TYPES)}")
        if not source.get("urls") and not source.get("capabilities_url"):
            faults.append(f"source {name!r}: urls are missing")
    for name, layer in s["layers"].items():
        if layer.get("source") is not None and layer["source"] not in s["sources"]:
            faults.append(f"layer {name!r}: no source {layer['source']!r}")
        for z in layer.get("zoom_levels") or []:
            if not isinstance(z, int) or not LOWEST <= z <= HIGHEST:
                faults.append(f"layer {name!r}: zoom {z!r} is not from {LOWEST} to {HIGHEST}")
        for rule in layer.get("rules") or []:
            try:
                predicates.parse(rule.get("match", ""))
            except ValueError as error:
                faults.append(f"layer {name!r}: {error}")
    for name, target in s["targets"].items():
        if not target.get("layers"):
            faults.append(f"target {name!r}: layers are missing")
        for entry in target.get("layers") or []:
            if entry.get("ref") is not None and entry["ref"] not in s["layers"]:
                faults.append(f"target {name!r}: no layer {entry['ref']!r}")
    for name, product in s["products"].items():
        faults += [f"product {name!r}: no target {t!r}" for t in product.get("targets") or [] if t not in s["targets"]]
    for kind in ("layers", "targets"):
        for name, item in s[kind].items():
            try:
                bounds_of(config, item.get("bounds"), f"{kind[:-1]} {name!r}")
            except ConfigError as error:
                faults.append(str(error))
    if faults:
        raise ConfigError("; ".join(faults))


def setting(config: Config, name: str, given: Any = None, default: Any = None) -> Any:
    """A setting: as given, else from TILEQUARRY_<NAME>, else from the files, else the default."""
    if given is not None:
        return given
    env = os.environ.get(f"TILEQUARRY_{name.upper()}")
    return env if env is not None else config.settings.get(name, default)
