"""Layered settings: files over defaults, profiles that extend each other, and overrides by name."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What queries and operators may be tuned by; a layer that names anything else is an error.
DEFAULTS: dict[str, object] = {"near_dup.least": 0.25, "vendor.share": 0.4, "vendor.least_groups": 3, "budget.floor": 5, "budget.ceil": 90, "anchor.least": 0.30, "anchor.margin": 0.02, "sessions.gap_s": 1800}


def read(path: str) -> dict:
    """A TOML or JSON file."""
    text = Path(path).read_text(encoding="utf-8")
    return json.loads(text) if path.endswith(".json") else tomllib.loads(text)


def flat(doc: Mapping, prefix: str = "") -> dict[str, object]:
    """Nested tables as dotted names."""
    out: dict[str, object] = {}
    for name, value in doc.items():
        out |= flat(value, f"{prefix}{name}.") if isinstance(value, Mapping) else {f"{prefix}{name}": value}
    return out


def extended(profiles: Mapping[str, Mapping], name: str) -> dict:
    """A profile over those it extends; one that extends itself is an error."""
    chain: list[str] = []
    while name:
        if name in chain:
            raise ValueError(f"profiles extend each other: {' > '.join([*chain, name])}")
        if name not in profiles:
            raise ValueError(f"no profile {name}")
        chain.append(name)
        name = str(profiles[name].get("extends", ""))
    out: dict = {}
    for part in reversed(chain):
        out |= {k: v for k, v in profiles[part].items() if k != "extends"}
    return out


def resolved(layers: Iterable[tuple[str, Mapping]], sets: Iterable[str] = (), defaults: Mapping[str, object] = DEFAULTS) -> dict[str, tuple[object, str]]:
    """Every setting's value and the layer it comes from: the last layer wins, then `name=value` overrides."""
    out = {name: (value, "default") for name, value in defaults.items()}
    given = [(layer, flat(doc)) for layer, doc in layers]
    given += [("set", {s.split("=", 1)[0].strip(): json.loads(s.split("=", 1)[1])}) for s in sets]
    for layer, doc in given:
        for name, value in doc.items():
            if name not in defaults:
                raise KeyError(f"{layer}: no setting {name}")
            kind = type(defaults[name])
            if isinstance(value, bool) != (kind is bool) or not isinstance(value, (int, float) if kind in (int, float) else kind):
                raise TypeError(f"{layer}: {name} is {kind.__name__}")
            out[name] = (kind(value), layer)
    return out


def table(spark: SparkSession, found: Mapping[str, tuple[object, str]]) -> DataFrame:
    """(name, value, layer) of resolved settings."""
    return spark.createDataFrame([(n, str(v), layer) for n, (v, layer) in sorted(found.items())], "name string, value string, layer string")
