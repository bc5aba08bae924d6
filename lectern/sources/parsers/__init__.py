"""Parsers: bytes of a document to flat sections, and from there to a tree and its rows.

A parser is a Python function of one document; Spark runs it over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Section:
    """A heading (or none, level 0) with the text below it up to the next."""

    level: int = 0
    heading: str | None = None
    content: str = ""
    page_physical: int | None = None
    page_logical: int | None = None
    page_section: int | None = None
    page_roman: bool = False
    source_line: int | None = None
    parent: int | None = None


@dataclass
class Document:
    sections: list[Section] = field(default_factory=list)
    title: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    error: str | None = None


class TooLarge(ValueError):
    """A part of a file unpacks to more than its parser reads (``LARGEST`` bytes): always an error."""


def nest(sections: list[Section]) -> list[Section]:
    """Set each section's parent: the nearest earlier one with a heading and a smaller level.

    Sections without heading neither have children nor are children."""
    open_: list[int] = []
    for i, s in enumerate(sections):
        if s.heading is None:
            open_ = []
            continue
        while open_ and sections[open_[-1]].level >= s.level:
            open_.pop()
        s.parent = open_[-1] if open_ else None
        open_.append(i)
    return sections


def parser_for(fmt: str) -> Callable[[bytes], Document]:
    from . import doc, docx, epub, markdown, pdf, rtf

    known = {"md": markdown.parse, "txt": markdown.parse, "docx": docx.parse, "epub": epub.parse, "rtf": rtf.parse, "doc": doc.parse, "pdf": pdf.parse, "html": epub.parse_html}
    if fmt not in known:
        raise ValueError(f"no parser for {fmt}")
    return known[fmt]


#: Formats whose broken files count as errors; others give an empty document.
STRICT = {"docx"}


def parse_bytes(fmt: str, raw: bytes) -> Document:
    try:
        return parser_for(fmt)(raw)
    except Exception as e:  # whatever a broken file brings about
        return Document(error=f"{type(e).__name__}: {e}" if fmt in STRICT or isinstance(e, TooLarge) else None)


SECTIONS = "document_id long, seq int, parent_seq int, level int, heading string, content string, page_physical int, page_logical int, page_section int, page_roman boolean, source_line int, title string, metadata map<string,string>, error string"


def parse(files: DataFrame, id_col: str = "document_id", format_col: str = "format", content_col: str = "content") -> DataFrame:
    """Section rows of each file.  A file without sections gives one row with a null ``seq``, which
    carries its title, metadata and, if it could not be read, the error."""
    names = ["document_id", "seq", "parent_seq", "level", "heading", "content", "page_physical", "page_logical", "page_section", "page_roman", "source_line", "title", "metadata", "error"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]

    def run(batches):
        for b in batches:
            out = []
            for i, fmt, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                d = parse_bytes(fmt, raw or b"")
                rest = (d.title, list(d.metadata.items()), d.error)
                out += [(i, k, s.parent, s.level, s.heading, s.content, s.page_physical, s.page_logical, s.page_section, s.page_roman, s.source_line, *rest) for k, s in enumerate(d.sections)] or [(i, None, None, None, None, None, None, None, None, None, None, *rest)]
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return files.select(F.col(id_col).cast("long"), F.col(format_col), F.col(content_col).cast("binary")).mapInArrow(run, SECTIONS)


def plain_text(sections: list[Section]) -> str:
    """Heading lines and bodies, in order."""
    return "".join(f"{x}\n" for s in sections for x in (s.heading, s.content) if x)
