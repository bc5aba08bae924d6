"""Markdown and plain text: number-sign headings, paragraphs reflowed."""

from __future__ import annotations

import re

from ...functions.charset import to_text
from . import Document, Section, nest

_HEADING = re.compile(r"(#{1,6}) (.*)", re.S)


def reflow(lines: list[str]) -> str:
    """Trimmed lines joined by spaces, runs of blank lines as one line feed."""
    paragraphs: list[list[str]] = [[]]
    for line in lines:
        line = line.strip(" \t\r")
        if line:
            paragraphs[-1].append(line)
        elif paragraphs[-1]:
            paragraphs.append([])
    return "\n".join(" ".join(p) for p in paragraphs if p)


def parse(raw: bytes) -> Document:
    found: list[tuple[Section, list[str]]] = []
    for n, line in enumerate(to_text(raw).split("\n"), 1):
        m = _HEADING.fullmatch(line)
        if m:
            found.append((Section(len(m[1]), m[2].strip(" \t"), source_line=n), []))
        elif found:
            found[-1][1].append(line)
        elif line.strip(" \t\r"):
            found.append((Section(source_line=n), [line]))
    for s, lines in found:
        s.content = reflow(lines)
    sections = nest([s for s, _ in found])
    return Document(sections, next((s.heading for s in sections if s.level == 1), None))
