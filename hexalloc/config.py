"""Configuration: TOML documents, read once, as the typed values that operators take."""

from __future__ import annotations

import functools
import inspect
import tomllib
from pathlib import Path

from .operators.index import FLOORS, Indicator, Model, Weights
from .operators.solvers import Settings


class ConfigError(ValueError):
    pass


@functools.cache
def load(path: str) -> dict:
    """A document; the same object for every call, so it must not be changed."""
    return tomllib.loads(Path(path).read_text())


def accepted(kind: type, given: dict, what: str) -> dict:
    """Of some values those that a type takes; an unknown name is an error, not a surprise later."""
    known = inspect.signature(kind).parameters
    if unknown := sorted(given.keys() - known.keys()):
        raise ConfigError(f"{what}: unknown {', '.join(unknown)}; known: {', '.join(known)}")
    return given


def model_of(doc: dict) -> Model:
    """``[[indicator]]`` tables, ``[weights]`` by dimension and ``[weights.inside.<dimension>]``."""
    indicators = tuple(Indicator(**accepted(Indicator, i, f"indicator {i.get('column')}")) for i in doc["indicator"])
    weights = doc["weights"]
    inside, outer = weights["inside"], {k: float(v) for k, v in weights["dimensions"].items()}
    for name, parts in [("dimensions", outer), *inside.items()]:
        if abs(sum(parts.values()) - 1) > 1e-9:
            raise ConfigError(f"weights of {name} add up to {sum(parts.values())}")
    if absent := [i.column for i in indicators if i.column not in inside.get(i.dimension, {})]:
        raise ConfigError(f"no weight for {', '.join(absent)}")
    return Model(indicators, Weights(outer, inside, bool(weights.get("provisional", True))), {**FLOORS, **doc.get("floors", {})}, doc.get("method", "robust_minmax"))


def settings_of(doc: dict) -> Settings:
    found = Settings(**accepted(Settings, doc.get("solver", {}), "solver"))
    if faults := found.faults():
        raise ConfigError("; ".join(faults))
    return found


def commodity(doc: dict, name: str) -> dict:
    """Settings of one commodity, over those that hold for all."""
    table = doc.get("commodity", {})
    if name not in table:
        raise ConfigError(f"unknown commodity {name!r}; known: {', '.join(sorted(table))}")
    return doc.get("commodities", {}) | table[name] | {"name": name}
