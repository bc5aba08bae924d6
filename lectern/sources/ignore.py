"""Ignore rules: patterns in a file's lines, the last that matches a path decides.

Patterns become regular expressions once, on the driver; paths are tested with ``rlike``, so
filtering stays in the scan.  A directory that is ignored is never entered: a later ``!``
can't bring back what lies below it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that a walk never enters, besides hidden ones.  Fixed values.
NOISE_DIRS = ("node_modules", "__pycache__", ".git", ".jj", "zig-cache", "zig-out")


def glob_regex(glob: str) -> str:
    """`*` within a path part, `**` across parts, `?` one character but `/`; anything else is itself."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            i += 3 if glob.startswith("**/", i) else 2
            out.append(".*")
            continue
        out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or re.escape(glob[i]))
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class Pattern:
    glob: str
    keep: bool
    dirs_only: bool
    anchored: bool

    @classmethod
    def parse(cls, line: str) -> Pattern | None:
        line = line.rstrip(" \t\r\n")
        if not line or line.startswith("#"):
            return None
        keep = line.startswith("!")
        glob = line[keep:]
        dirs_only = glob.endswith("/")
        glob = glob[:-1] if dirs_only else glob
        anchored = "/" in glob
        glob = glob.removeprefix("/")
        return cls(glob, keep, dirs_only, anchored) if glob else None

    def regex(self, is_dir: bool) -> str | None:
        """What a whole relative path must look like; None: this pattern can't match it."""
        body = glob_regex(self.glob)
        if self.anchored:
            here = f"^{body}"
        else:
            here = f"^(?:.*/)?{body}"
        if not self.dirs_only:
            return here + "$"
        return here + ("(?:/.*)?$" if is_dir else "/.*$")


class IgnoreRules:
    def __init__(self, text: str = "") -> None:
        self.patterns = [p for p in map(Pattern.parse, text.split("\n")) if p]

    def matches(self, path: str, is_dir: bool = False) -> bool:
        """Is this one path ignored, its parents aside?"""
        ignored = False
        for p in self.patterns:
            r = p.regex(is_dir)
            if r and re.search(r, path):
                ignored = not p.keep
        return ignored

    def kept(self, path: str) -> bool:
        """Would a walk from the root come to this file?"""
        parts = path.split("/")
        return not any(self.matches("/".join(parts[:n]), True) for n in range(1, len(parts))) and not self.matches(path)

    def _ignored(self, path: Column, is_dir: bool) -> Column:
        out = F.lit(False)
        for p in self.patterns:
            r = p.regex(is_dir)
            if r:
                out = F.when(path.rlike(r), F.lit(not p.keep)).otherwise(out)
        return out

    def kept_column(self, path: Column | str) -> Column:
        """As :meth:`kept`, for a column of relative paths."""
        path = F.col(path) if isinstance(path, str) else path
        parts = F.split(path, "/")
        above = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        return ~F.exists(above, lambda d: self._ignored(d, True)) & ~self._ignored(path, False)


def walked(path: Column | str) -> Column:
    """No part of the relative path is hidden or a noise directory."""
    path = F.col(path) if isinstance(path, str) else path
    noise = "|".join(re.escape(d) for d in NOISE_DIRS if not d.startswith("."))
    return ~path.rlike(rf"(^|/)(\.|({noise})/)")
