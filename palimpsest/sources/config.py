"""Configuration: defaults, a JSON file, the environment and the host, merged right over left."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Mapping
from time import monotonic
from typing import Any

#: Name, default, least and greatest.
BOUNDS = {
    "retrieval.top_k": (5, 1, 10),
    "retrieval.candidates": (20, 1, 100),
    "retrieval.min_score": (0.35, 0.0, 1.0),
    "retrieval.project_boost": (0.05, 0.0, 1.0),
    "retrieval.timeout_ms": (2500, 100, 30_000),
    "capture.max_jobs": (10_000, 1, 100_000),
    "curation.turns": (10, 1, 1000),
    "curation.tool_calls": (15, 1, 1000),
    "clock.max_skew_ms": (300_000, 0, 3_600_000),
}
ENV_PREFIX = "PALIMPSEST_"


def deep_merge(left: Mapping, right: Mapping) -> dict:
    """Nested mappings merged; the right wins, and a list or a value replaces whole."""
    out = dict(left)
    for key, value in right.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def nested(flat: Mapping[str, Any]) -> dict:
    out: dict = {}
    for name, value in flat.items():
        at = out
        *path, last = name.split(".")
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value
    return out


def load_config(text: str = "{}", env: Mapping[str, str] | None = None, host: str | None = None) -> dict:
    """The configuration of a host: defaults, then the file, its part for the host, then the environment.

    A value out of bounds or of another type is an error, and so is an unknown name.
    """
    given = json.loads(text)
    hosts = given.pop("hosts", {})
    merged = deep_merge(nested({k: v[0] for k, v in BOUNDS.items()}), given)
    merged = deep_merge(merged, hosts.get(host, {}) if host else {})
    flat = {f"{a}.{b}": v for a, group in merged.items() for b, v in (group.items() if isinstance(group, Mapping) else ())}
    for name in BOUNDS:
        override = (env or {}).get(ENV_PREFIX + name.upper().replace(".", "_"))
        if override is not None:
            flat[name] = json.loads(override)
    for name, value in flat.items():
        if name not in BOUNDS:
            raise ValueError(f"unknown setting {name}")
        default, least, most = BOUNDS[name]
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not least <= value <= most or (isinstance(default, int) and value != int(value)):
            raise ValueError(f"{name} must be from {least} to {most}")
    return nested(flat)


def detect_host(marker: str | None, argv: list[str], known: tuple[str, ...] = ("alpha", "beta")) -> str:
    """The host by its marker, else by the program's name, else the first known."""
    if marker is not None:
        if marker not in known:
            raise ValueError("unknown host")
        return marker
    name = (argv[0] if argv else "").rsplit("/", 1)[-1]
    return next((h for h in sorted(known, key=len, reverse=True) if name.startswith(h)), known[0])


class RecallCache:
    """Plans in flight by key: at most ``size`` of them, for at most ``ttl`` seconds; settled ones go."""

    def __init__(self, size: int = 32, ttl: float = 300.0, clock: Callable[[], float] = monotonic) -> None:
        self.size, self.ttl, self.clock = size, ttl, clock
        self.held: OrderedDict[str, tuple[float, Any]] = OrderedDict()

    def get(self, key: str, make: Callable[[], Any]) -> Any:
        now = self.clock()
        for old in [k for k, (t, _) in self.held.items() if now - t >= self.ttl]:
            del self.held[old]
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key][1]
        self.held[key] = (now, make())
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return self.held[key][1]

    def settle(self, key: str) -> None:
        self.held.pop(key, None)
