"""Settings: variables of the environment in configurations, dotted lookups, stages and their names."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from typing import Any


def resolved(config: Any, environment: Mapping[str, str] | None = None) -> Any:
    """config with every ${NAME} in its texts replaced; a name that is not set is empty."""
    env = os.environ if environment is None else environment
    if isinstance(config, Mapping):
        return {k: resolved(v, env) for k, v in config.items()}
    if isinstance(config, list):
        return [resolved(v, env) for v in config]
    return re.sub(r"\$\{([^}]+)\}", lambda m: env.get(m[1], ""), config) if isinstance(config, str) else config


def lookup(config: Mapping, path: str, default: Any = None) -> Any:
    """The value at a dotted path, default if there is none."""
    for k in path.split("."):
        if not isinstance(config, Mapping) or k not in config:
            return default
        config = config[k]
    return config


def stages(text: str, last: int) -> list[int]:
    """Numbers and ranges such as "3-6,9", ascending, each once; ValueError for anything else or beyond 1..last."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"0*(\d+)(?:\s*-\s*0*(\d+))?", part)
        if not m or (m[2] and int(m[1]) > int(m[2])):
            raise ValueError(f"no stage or range: {part!r}")
        out |= set(range(int(m[1]), int(m[2] or m[1]) + 1))
    if not out or min(out) < 1 or max(out) > last:
        raise ValueError(f"stages must be within 1 to {last}")
    return sorted(out)


class StageNames:
    """Stage ids in order, and older names for them."""

    def __init__(self, ids: list[str], aliases: Mapping[str, str] | None = None):
        self.ids, self.aliases = list(ids), dict(aliases or {})

    def canonical(self, name: str) -> str:
        name = self.aliases.get(name, name)
        if name not in self.ids:
            raise KeyError(name)
        return name

    def number(self, name: str) -> int:
        return self.ids.index(self.canonical(name)) + 1

    def folder(self, name: str) -> str:
        return f"{self.number(name):02d}_{self.canonical(name)}"
