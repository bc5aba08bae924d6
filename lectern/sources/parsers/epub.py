"""EPUB: container, package, chapters in spine order; HTML by a tolerant reader."""

from __future__ import annotations

import posixpath
from html.parser import HTMLParser
from urllib.parse import unquote

from . import Document, Section, nest
from .xmltree import Archive, attr, local, parse_xml

SKIPPED = {"script", "style", "head", "nav", "svg", "math"}
BLOCKS = {"p", "div", "br", "li", "tr", "ul", "ol", "table", "blockquote", "section", "article", "header", "footer", "pre", "hr", "dt", "dd", "figure", "figcaption"}
VOID = {"br", "hr", "img", "meta", "link", "input", "col", "area", "base", "source", "wbr"}


class HtmlSections(HTMLParser):
    """Sections of a page of HTML, in document order; unclosed tags and loose entities are fine."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[Section, list[str]]] = []
        self.skip: list[str] = []
        self.heading: tuple[int, list[str]] | None = None
        self.title: str | None = None
        self.in_title = False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "title":
            self.in_title = True
        if tag in SKIPPED:
            self.skip.append(tag)
        if self.skip:
            return
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.heading = (int(tag[1]), [])
        elif tag in BLOCKS:
            self._text("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in self.skip:
            del self.skip[self.skip.index(tag) :]
            return
        if self.skip:
            return
        if self.heading and tag == f"h{self.heading[0]}":
            level, parts = self.heading
            self.heading = None
            text = " ".join("".join(parts).split())
            if text:
                self.found.append((Section(level, text), []))
        elif tag in BLOCKS:
            self._text("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title and self.title is None and data.strip():
            self.title = data.strip()
        if not self.skip:
            self._text(data)

    def _text(self, data: str) -> None:
        if self.heading:
            self.heading[1].append(data)
            return
        if not self.found:
            if not data.strip():
                return
            self.found.append((Section(), []))
        self.found[-1][1].append(data)

    def sections(self) -> list[Section]:
        for s, parts in self.found:
            lines = (" ".join(line.split()) for line in "".join(parts).split("\n"))
            s.content = "\n".join(x for x in lines if x)
        return [s for s, _ in self.found]


def html_sections(text: str) -> tuple[list[Section], str | None]:
    p = HtmlSections()
    p.feed(text)
    p.close()
    return p.sections(), p.title


def parse_html(raw: bytes) -> Document:
    from ...functions.charset import to_text

    sections, title = html_sections(to_text(raw))
    return Document(nest(sections), title or next((s.heading for s in sections if s.heading), None))


def parse(raw: bytes) -> Document:
    z = Archive(raw)
    container = z.read("META-INF/container.xml")
    if container is None:
        raise ValueError("no container")
    root = next(attr(e, "full-path") for e in parse_xml(container).iter() if local(e.tag) == "rootfile")
    package = parse_xml(z.read(root) or b"")
    meta: dict[str, str] = {}
    manifest: dict[str, str] = {}
    spine: list[str] = []
    for e in package.iter():
        tag = local(e.tag)
        if tag == "item" and attr(e, "id") and attr(e, "href"):
            manifest[attr(e, "id")] = attr(e, "href")
        elif tag == "itemref":
            spine.append(attr(e, "idref") or "")
        elif tag in ("title", "creator", "language", "identifier", "publisher", "date", "subject", "description") and (e.text or "").strip():
            meta.setdefault({"creator": "author"}.get(tag, tag), e.text.strip())
    sections: list[Section] = []
    for ref in spine:
        if ref not in manifest:
            continue
        name = posixpath.normpath(posixpath.join(posixpath.dirname(root), unquote(manifest[ref].split("#")[0])))
        chapter = z.read(name)
        if chapter is not None:
            sections += html_sections(chapter.decode("utf-8-sig", "replace"))[0]
    nest(sections)
    return Document(sections, meta.get("title") or next((s.heading for s in sections if s.heading), None), meta)
