"""RTF: a reader of groups and control words; headings by type size."""

from __future__ import annotations

import re
from collections import Counter

from . import Document, Section, nest

# Destinations whose text isn't the document's.
SKIPPED = {
    "fonttbl", "colortbl", "stylesheet", "listtable", "listoverridetable", "pict", "object", "header", "headerl", "headerr", "headerf",
    "footer", "footerl", "footerr", "footerf", "footnote", "annotation", "atnid", "atnauthor", "themedata", "colorschememapping",
    "datastore", "latentstyles", "generator", "xmlnstbl", "rsidtbl", "fldinst", "bkmkstart", "bkmkend", "revtbl", "mmathPr", "pgdsctbl",
    "field", "datafield", "objdata", "nonshppict", "shp", "shpinst", "shprslt", "atnicn",
}
INFO = ("title", "subject", "author", "manager", "company", "operator", "category", "keywords", "comment", "doccomm")
SIGNS = {"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "tab": "\t", "line": "\n", "emspace": " ", "enspace": " "}
_TOKEN = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+", re.S)


def _spans(raw: bytes) -> tuple[list[tuple[str, float, int]], dict[str, str]]:
    """(text, size, page) spans and the fields of the info group."""
    out: list[tuple[str, float, int]] = []
    meta: dict[str, list[str]] = {}
    state = {"skip": False, "size": 12.0, "uc": 1, "field": None}
    stack: list[dict] = []
    page, drop, at, star = 1, 0, 0, False

    def emit(text: str) -> None:
        nonlocal drop
        if drop:
            n = min(drop, len(text))
            drop -= n
            text = text[n:]
        if not text:
            return
        if state["field"]:
            meta.setdefault(state["field"], []).append(text)
        elif not state["skip"]:
            out.append((text, state["size"], page))

    while at < len(raw):
        m = _TOKEN.match(raw, at)
        if not m:
            at += 1
            continue
        at = m.end()
        word, number, code, sign, brace, text = m.groups()
        if brace == b"{":
            stack.append(dict(state))
            star = False
        elif brace == b"}":
            state = stack.pop() if stack else state
            drop = 0
        elif code is not None:
            emit(bytes([int(code, 16)]).decode("cp1252", "ignore") or ("?" if drop else ""))
        elif sign is not None:
            if sign == b"*":
                star = True
            else:
                emit({b"~": "\u00a0", b"_": "-", b"-": "", b"\n": "\n", b"\r": "\n"}.get(sign, sign.decode("latin-1") if sign in b"\\{}" else ""))
        elif text is not None:
            emit(text.decode("cp1252", "replace"))
        elif word is not None:
            w, n = word.decode(), int(number) if number else None
            if w in SKIPPED or (star and w not in INFO):
                state["skip"] = True
            elif w == "info":
                state["skip"] = True
                state["in_info"] = True
            elif w in INFO and state.get("in_info"):
                state["field"] = w
            elif w == "u" and n is not None:
                emit(chr(n + 65536 if n < 0 else n))
                drop = state["uc"]
            elif w == "uc":
                state["uc"] = n or 0
            elif w == "bin":
                at += max(0, n or 0)
            elif w == "fs":
                state["size"] = (n or 24) / 2
            elif w in ("plain",):
                state["size"] = 12.0
            elif w in ("par", "sect", "row"):
                emit("\n")
            elif w == "page":
                page += 1
                emit("\n")
            elif w in SIGNS:
                emit(SIGNS[w])
            star = False
    return out, {k: "".join(v).strip() for k, v in meta.items() if "".join(v).strip()}


def by_size(lines: list[tuple[str, float, int]]) -> list[Section]:
    """Lines at 1.15 times the size that holds most bytes, or larger, are headings; the largest is level 1."""
    weight: Counter = Counter()
    for text, size, _ in lines:
        weight[size] += len(text.encode())
    if not weight:
        return []
    body = max(weight, key=lambda s: (weight[s], -s))
    sizes = sorted({s for t, s, _ in lines if s >= 1.15 * body and t.strip()}, reverse=True)
    found: list[tuple[Section, list[str]]] = []
    for text, size, page in lines:
        if size in sizes and text.strip():
            last = found[-1][0] if found else None
            if last and last.heading and not found[-1][1] and last.level == sizes.index(size) + 1:
                last.heading += " " + text.strip()  # a heading over two lines
            else:
                found.append((Section(sizes.index(size) + 1, text.strip(), page_physical=page), []))
        elif text.strip() or found:
            if not found:
                found.append((Section(page_physical=page), []))
            found[-1][1].append(text.strip())
    for s, parts in found:
        s.content = re.sub("\n{3,}", "\n\n", "\n".join(parts)).strip("\n")
    return [s for s, _ in found]


def parse(raw: bytes) -> Document:
    if not raw.lstrip().startswith(b"{\\rtf"):
        raise ValueError("not RTF")
    spans, meta = _spans(raw)
    lines: list[tuple[str, float, int]] = []
    text, size, page = "", 0.0, 1
    for t, s, p in spans:
        for k, part in enumerate(t.split("\n")):
            if k:
                lines.append((text, size, page))
                text, size = "", 0.0
            if part:
                if not text:
                    page = p
                text, size = text + part, max(size, s)
    lines.append((text, size, page))
    sections = nest(by_size(lines))
    return Document(sections, meta.get("title") or next((s.heading for s in sections if s.heading), None), meta)
