"""Settings in layers: command line, environment, project file, global file, defaults."""

from __future__ import annotations

import configparser
import os
import re
from collections import ChainMap
from collections.abc import Mapping
from pathlib import Path

DEFAULTS = {"index.path": "", "embedding.url": "", "embedding.model": "", "embedding.key": "", "search.limit": "10", "search.mode": "hybrid", "chunk.max_tokens": "1500", "chunk.min_tokens": "100"}
_REF = re.compile(r"\$(?:\$|\{([A-Za-z_]\w*)(?:(:?-)([^{}]*(?:\{[^{}]*\}[^{}]*)*))?\}|([A-Za-z_]\w*))")


def expand(text: str, env: Mapping[str, str], depth: int = 10) -> str:
    """``$$``, ``$V``, ``${V}``, ``${V:-D}`` (unset or empty) and ``${V-D}`` (unset)."""
    if depth < 0:
        raise ValueError("references are nested too deeply")

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return "$"
        value = env.get(m[1] or m[4])
        if m[2] and (value is None or (m[2] == ":-" and not value)):
            return expand(m[3], env, depth - 1)
        return value or ""

    return _REF.sub(one, text)


def read_file(path: str | Path, env: Mapping[str, str] | None) -> dict[str, str]:
    """Settings of a file; references stay as they are if there is no environment."""
    p = configparser.ConfigParser(interpolation=None)
    p.read(path)
    return {f"{s}.{k}": v if env is None else expand(v, env) for s in p.sections() for k, v in p.items(s)}


class Settings:
    def __init__(self, options: Mapping[str, str] | None = None, env: Mapping[str, str] | None = None, project: str | Path | None = None, user: str | Path | None = None) -> None:
        env = os.environ if env is None else env
        named = {k: env[n] for k in DEFAULTS if (n := "LECTERN_" + k.upper().replace(".", "_")) in env}
        self.layers = [("option", dict(options or {})), ("environment", named), ("project", read_file(project, env) if project else {}), ("user", read_file(user, env) if user else {}), ("default", DEFAULTS)]
        self.all = ChainMap(*(d for _, d in self.layers))

    def get(self, key: str) -> str | None:
        return self.all.get(key)

    def source(self, key: str) -> str | None:
        """The layer that a value comes from."""
        return next((name for name, d in self.layers if key in d), None)


def save(path: str | Path, values: Mapping[str, str]) -> None:
    """Write settings; those at their default are there as comments."""
    out: dict[str, list[str]] = {}
    for k in {**DEFAULTS, **values}:
        section, name = k.split(".", 1)
        v = values.get(k, DEFAULTS.get(k, ""))
        out.setdefault(section, []).append(f"{'# ' if v == DEFAULTS.get(k) else ''}{name} = {v}")
    Path(path).write_text("\n\n".join(f"[{s}]\n" + "\n".join(lines) for s, lines in out.items()) + "\n")
