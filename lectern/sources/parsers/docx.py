"""DOCX: body paragraphs, heading styles, page breaks, core properties."""

from __future__ import annotations

import re

from . import Document, Section, nest
from .xmltree import Archive, attr, local, parse_xml

#: Core property -> name in the metadata.
PROPERTIES = {"title": "title", "creator": "author", "subject": "subject", "description": "description", "keywords": "keywords", "created": "created", "modified": "modified"}


def heading_level(style: str | None) -> int | None:
    """Title is 0, Heading 1 to 6 their number, any other style none."""
    if style is None:
        return None
    if style.lower() == "title":
        return 0
    m = re.fullmatch(r"heading ?([1-6])", style.lower())
    return int(m[1]) if m else None


def _paragraph(p) -> tuple[str, str | None, int]:
    """Text, style and page breaks of a paragraph."""
    text, style, breaks = [], None, 0
    for e in p.iter():
        tag = local(e.tag)
        if tag == "pStyle":
            style = attr(e, "val")
        elif tag == "t":
            text.append(e.text or "")
        elif tag == "lastRenderedPageBreak" or (tag == "br" and attr(e, "type") == "page"):
            breaks += 1
        elif tag in ("br", "tab"):
            text.append(" ")
    return "".join(text), style, breaks


def parse(raw: bytes) -> Document:
    z = Archive(raw)
    main = z.read("word/document.xml")
    if main is None:
        raise ValueError("no word/document.xml")
    found: list[tuple[Section, list[str]]] = []
    page = 1
    for p in (e for e in parse_xml(main).iter() if local(e.tag) == "p"):
        text, style, breaks = _paragraph(p)
        level = heading_level(style)
        if level is not None and text.strip():
            found.append((Section(level, text.strip(), page_physical=page), []))
        elif text.strip():
            if not found:
                found.append((Section(page_physical=page), []))
            found[-1][1].append(text.strip())
        page += breaks
    for s, lines in found:
        s.content = "\n".join(lines)
    meta = {}
    if core := z.read("docProps/core.xml"):
        for e in parse_xml(core):
            if (name := PROPERTIES.get(local(e.tag))) and (e.text or "").strip():
                meta[name] = e.text.strip()
    sections = nest([s for s, _ in found])
    return Document(sections, meta.get("title") or next((s.heading for s in sections if s.level in (0, 1)), None), meta)
