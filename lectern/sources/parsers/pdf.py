"""PDF text: content streams to runs, runs to lines in reading order, lines to sections."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from statistics import median

from . import Document, Section, nest
from .pdfobjects import Lexer, Name, Operator, Pdf

#: Glyph names that Unicode's own names don't give.  Fixed values.
GLYPHS = {"ff": "ff", "fi": "fi", "fl": "fl", "ffi": "ffi", "ffl": "ffl", "quoteright": "’", "quoteleft": "‘", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "space": " ", "hyphen": "-", "period": ".", "comma": ",", "ellipsis": "…", "section": "§", "paragraph": "¶", "degree": "°", "germandbls": "ß"}
ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "cedilla": "̧", "ring": "̊", "caron": "̌"}


@dataclass
class Run:
    page: int
    x: float
    y: float
    size: float
    text: str
    end: float


def glyph(name: str) -> str | None:
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    m = re.fullmatch(r"uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6})", name)
    if m:
        return chr(int(m[1] or m[2], 16))
    m = re.fullmatch(r"([A-Za-z])(" + "|".join(ACCENTS) + ")", name)
    if m:
        return unicodedata.normalize("NFC", m[1] + ACCENTS[m[2]])
    try:
        return unicodedata.lookup({"parenleft": "left parenthesis", "parenright": "right parenthesis", "exclam": "exclamation mark", "question": "question mark", "numbersign": "number sign", "dollar": "dollar sign", "percent": "percent sign"}.get(name, {"zero": "digit zero", "one": "digit one", "two": "digit two", "three": "digit three", "four": "digit four", "five": "digit five", "six": "digit six", "seven": "digit seven", "eight": "digit eight", "nine": "digit nine"}.get(name, name)))
    except KeyError:
        return None


def cmap(raw: bytes) -> tuple[dict[int, str], int]:
    """Code to text of a ToUnicode map, and the bytes of a code."""
    out: dict[int, str] = {}
    width = 1
    text = lambda b: b.decode("utf-16-be", "ignore")
    lex, kind, held = Lexer(raw), None, []
    while (x := lex.next()) is not None:
        if isinstance(x, Operator):
            if x in (b"beginbfchar", b"beginbfrange", b"begincodespacerange"):
                kind, held = bytes(x), []
            elif x == b"endcodespacerange":
                width = max([len(h) for h in held if isinstance(h, bytes)] or [1])
            elif x == b"endbfchar":
                out |= {int.from_bytes(a, "big"): text(b) for a, b in zip(held[::2], held[1::2]) if isinstance(b, bytes)}
            elif x == b"endbfrange":
                for lo, hi, to in zip(held[::3], held[1::3], held[2::3]):
                    lo, hi = int.from_bytes(lo, "big"), int.from_bytes(hi, "big")
                    for k in range(min(hi - lo + 1, 65536)):
                        if isinstance(to, list):
                            out[lo + k] = text(to[k]) if k < len(to) else ""
                        else:
                            out[lo + k] = text(to[:-2]) + chr((int.from_bytes(to[-2:], "big") + k) & 0xFFFF)
        elif kind:
            held.append(x)
    return out, width


class Font:
    def __init__(self, pdf: Pdf, d: dict) -> None:
        self.map: dict[int, str] = {}
        self.width, self.base = 1, "cp1252"
        encoding = pdf.get(d.get("Encoding"))
        if d.get("Subtype") == "Type0":
            self.width = 2
        if encoding == "MacRomanEncoding" or (isinstance(encoding, dict) and encoding.get("BaseEncoding") == "MacRomanEncoding"):
            self.base = "mac-roman"
        if "ToUnicode" in d:
            self.map, width = cmap(pdf.stream(d["ToUnicode"]))
            self.width = max(self.width, width)
        if isinstance(encoding, dict):
            code = 0
            for x in pdf.get(encoding.get("Differences")) or []:
                if isinstance(x, Name):
                    g = glyph(str(x))
                    # a ligature's name is surer than a map that leaves it out or blank
                    if g and (not self.map.get(code, "").strip("\0 ") or len(g) > 1):
                        self.map[code] = g
                    code += 1
                elif isinstance(x, int):
                    code = x

    def text(self, raw: bytes) -> str:
        out = []
        for i in range(0, len(raw), self.width):
            code = int.from_bytes(raw[i : i + self.width], "big")
            if code in self.map:
                out.append(self.map[code])
            elif self.width == 1:
                out.append(bytes([code]).decode(self.base, "ignore"))
        return "".join(out)


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def page_runs(pdf: Pdf, page: dict, number: int) -> list[Run]:
    out: list[Run] = []

    def show(data: bytes, resources: dict, ctm: tuple, depth: int) -> None:
        fonts: dict[str, Font] = {}
        of_fonts, forms = pdf.get(resources.get("Font")) or {}, pdf.get(resources.get("XObject")) or {}
        stack: list[tuple] = []
        args: list = []
        tm = line = (1, 0, 0, 1, 0, 0)
        font, size, leading = None, 12.0, 0.0
        lex = Lexer(data)

        def put(text: str) -> None:
            nonlocal tm
            m = _times(tm, ctm)
            high = abs(size) * max(abs(m[3]), abs(m[1]), 1e-6)
            wide = len(text) * size * 0.5
            after = _times((1, 0, 0, 1, wide, 0), tm)
            if text:
                out.append(Run(number, m[4], m[5], high, text, _times(after, ctm)[4]))
            tm = after

        def newline(x: float, y: float) -> None:
            nonlocal tm, line
            line = _times((1, 0, 0, 1, x, y), line)
            tm = line

        while (x := lex.next()) is not None or lex.at < len(data):
            if not isinstance(x, Operator):
                args.append(x)
                continue
            nums = [float(a) for a in args if isinstance(a, (int, float)) and not isinstance(a, bool)]
            if x == b"q":
                stack.append((ctm, font, size, leading))
            elif x == b"Q" and stack:
                ctm, font, size, leading = stack.pop()
            elif x == b"cm" and len(nums) == 6:
                ctm = _times(tuple(nums), ctm)
            elif x == b"BT":
                tm = line = (1, 0, 0, 1, 0, 0)
            elif x == b"Tf" and args and isinstance(args[0], Name):
                name = str(args[0])
                if name not in fonts:
                    d = pdf.get(of_fonts.get(name))
                    fonts[name] = Font(pdf, d if isinstance(d, dict) else {})
                font, size = fonts[name], nums[-1] if nums else size
            elif x == b"TL" and nums:
                leading = nums[0]
            elif x in (b"Td", b"TD") and len(nums) == 2:
                leading = -nums[1] if x == b"TD" else leading
                newline(*nums)
            elif x == b"Tm" and len(nums) == 6:
                tm = line = tuple(nums)
            elif x == b"T*":
                newline(0, -leading)
            elif x in (b"Tj", b"'", b'"') and args and isinstance(args[-1], bytes):
                if x != b"Tj":
                    newline(0, -leading)
                put((font or Font(pdf, {})).text(args[-1]))
            elif x == b"TJ" and args and isinstance(args[-1], list):
                parts = []
                for a in args[-1]:
                    if isinstance(a, bytes):
                        parts.append((font or Font(pdf, {})).text(a))
                    elif isinstance(a, (int, float)) and a < -200 and parts:
                        parts.append(" ")
                put("".join(parts))
            elif x == b"Do" and args and depth < 8:
                ref = forms.get(str(args[-1]))
                d = pdf.get(ref)
                if isinstance(d, dict) and d.get("Subtype") == "Form":
                    m = pdf.get(d.get("Matrix"))
                    inner = _times(tuple(float(v) for v in m), ctm) if isinstance(m, list) and len(m) == 6 else ctm
                    show(pdf.stream(ref), pdf.get(d.get("Resources")) or resources, inner, depth + 1)
            elif x == b"ID":
                end = re.compile(rb"\sEI\b").search(data, lex.at)
                lex.at = end.end() if end else len(data)
            args = []

    contents = page.get("Contents")
    got = pdf.get(contents)
    data = b"\n".join(pdf.stream(c) for c in got) if isinstance(got, list) else pdf.stream(contents)
    show(data, pdf.get(page.get("Resources")) or {}, (1, 0, 0, 1, 0, 0), 0)
    return out


def gutter(runs: list[Run], bins: int = 64) -> float | None:
    """The middle of an empty strip in the page's middle third that parts two columns; None for one."""
    if len(runs) < 20:
        return None
    lo, hi = min(r.x for r in runs), max(r.end for r in runs)
    if hi <= lo:
        return None
    cover = [0] * bins
    for r in runs:
        a, b = (int(bins * (v - lo) / (hi - lo)) for v in (r.x, r.end))
        for k in range(max(0, a), min(bins - 1, b) + 1):
            cover[k] += 1
    third = range(bins // 3, bins - bins // 3)
    best = min(third, key=lambda k: (cover[k], abs(k - bins // 2)))
    x = lo + (best + 0.5) * (hi - lo) / bins
    left, right = sum(r.end <= x for r in runs), sum(r.x >= x for r in runs)
    return x if cover[best] <= 0.05 * len(runs) and min(left, right) >= 0.25 * len(runs) else None


def lines_of(runs: list[Run]) -> list[list[Run]]:
    """Runs as visual lines, top to bottom, one column after the other."""
    if not runs:
        return []
    x = gutter(runs)
    columns = [runs] if x is None else [[r for r in runs if r.x < x], [r for r in runs if r.x >= x]]
    out: list[list[Run]] = []
    near = 0.5 * median(r.size for r in runs)
    for column in columns:
        lines: list[list[Run]] = []
        for r in sorted(column, key=lambda r: (-r.y, r.x)):
            if lines and abs(lines[-1][0].y - r.y) <= near:
                lines[-1].append(r)
            else:
                lines.append([r])
        out += [sorted(line, key=lambda r: r.x) for line in lines]
    return out


def line_text(line: list[Run]) -> str:
    out = line[0].text
    for a, b in zip(line, line[1:]):
        gap = b.x - a.end
        out += (" " if gap > 0.15 * b.size and not out.endswith(" ") and not b.text.startswith(" ") else "") + b.text
    return " ".join(out.split())


# Headers of the parts of a table of authorities.
AUTHORITY_HEADERS = (
    "Constitutional Provisions", "Statutory Provisions", "Legislative Materials", "Legislative History", "Table of Authorities",
    "Other Authorities", "Federal Cases", "State Cases", "Authorities", "Regulations", "Treatises", "Miscellaneous", "Statutes", "Cases", "Rules",
)
_AUTHORITY = re.compile(rf"^((?:{'|'.join(AUTHORITY_HEADERS)}):?)[ \t]+(?=(?-i:[A-Z0-9]))", re.I | re.M)
_LEADERS = re.compile(r"(?:(?<![ \t])[ \t]+)?\.(?:[ \t]*\.){4,}[ \t]*")


def part_entries(text: str) -> str:
    """Dot leaders become line feeds, and a header of a table of authorities gets a line of its own."""
    text, n = _LEADERS.sub("\n", text), 1
    while n:  # an entry may begin with a header itself
        text, n = _AUTHORITY.subn(r"\1\n", text)
    return text


def sections_of(pages: list[list[list[Run]]]) -> list[Section]:
    weight: Counter = Counter()
    for lines in pages:
        for line in lines:
            for r in line:
                weight[round(r.size)] += len(r.text.encode())
    if not weight:
        return []
    body = max(weight, key=lambda s: (weight[s], -s))
    size_of = lambda line: round(max(r.size for r in line))

    def heads(line: list[Run]) -> bool:
        t = line_text(line)
        if size_of(line) < 1.15 * body or len(t) < 3:
            return False
        return " " in t or t.isupper() or size_of(line) >= 2 * body

    sizes = sorted({size_of(x) for lines in pages for x in lines if heads(x)}, reverse=True)
    gaps = Counter(round(a[0].y - b[0].y) for lines in pages for a, b in zip(lines, lines[1:]) if 4 <= a[0].y - b[0].y <= 72)
    usual = max(gaps, key=lambda g: (gaps[g], -g)) if sum(gaps.values()) >= 4 else None
    out: list[Section] = []
    for lines in pages:
        last, heading_y = None, None
        for line in lines:
            t = line_text(line)
            if not t:
                continue
            if heads(line):
                level = sizes.index(size_of(line)) + 1
                if out and out[-1].heading and not out[-1].content and out[-1].level == level and heading_y is not None and 0 < heading_y - line[0].y < 2 * size_of(line):
                    out[-1].heading += " " + t
                else:
                    out.append(Section(level, t, page_physical=line[0].page))
                last, heading_y = None, line[0].y
                continue
            if not out or (last is None and heading_y is None and out[-1].page_physical != line[0].page):
                out.append(Section(page_physical=line[0].page))
            s = out[-1]
            if not s.content:
                s.content = t
            else:
                gap = last[0].y - line[0].y if last else 0
                wraps = last is not None and 0 < gap < (1.5 * usual if usual else 2.2 * body)
                if wraps and s.content.endswith("-") and t[:1].islower():
                    s.content = s.content[:-1] + t
                else:
                    s.content += (" " if wraps or (last is not None and gap <= 0) else "\n") + t
            last = line
    for s in out:
        s.content = part_entries(s.content)
    return out


def page_labels(pdf: Pdf) -> list[tuple[int, str, int]]:
    """(first page index, style, first number) of each range, in order."""
    root = pdf.get(pdf.trailer.get("Root")) or {}
    out = []

    def walk(x, depth: int = 0) -> None:
        d = pdf.get(x)
        if not isinstance(d, dict) or depth > 16:
            return
        nums = pdf.get(d.get("Nums")) or []
        for i, v in zip(nums[::2], nums[1::2]):
            v = pdf.get(v)
            if isinstance(v, dict) and isinstance(i, int):
                out.append((i, str(v.get("S") or ""), int(pdf.get(v.get("St")) or 1)))
        for k in pdf.get(d.get("Kids")) or []:
            walk(k, depth + 1)

    walk(root.get("PageLabels"))
    return sorted(out)[:32]


def apply_labels(sections: list[Section], labels: list[tuple[int, str, int]]) -> None:
    """Top-level sections get the number that the last range at or before their page gives."""
    for s in sections:
        if s.parent is not None or s.page_physical is None:
            continue
        found = [(k, r) for k, r in enumerate(labels, 1) if r[0] <= s.page_physical - 1]
        if found:
            k, (start, style, first) = found[-1]
            s.page_logical, s.page_section, s.page_roman = s.page_physical - 1 - start + first, k, style in ("r", "R")


def parse(raw: bytes) -> Document:
    pdf = Pdf(raw)
    pages = [lines_of(page_runs(pdf, p, n)) for n, p in enumerate(pdf.pages(), 1)]
    sections = nest(sections_of(pages))
    apply_labels(sections, page_labels(pdf))
    info = pdf.get(pdf.trailer.get("Info")) or {}
    text = lambda v: v[2:].decode("utf-16-be", "ignore") if v.startswith(b"\xfe\xff") else v.decode("latin-1")
    meta = {k.lower(): text(v).strip() for k in ("Title", "Author", "Subject", "Keywords") if isinstance(v := pdf.get(info.get(k)), bytes) and v.strip()}
    return Document(sections, meta.get("title") or next((s.heading for s in sections if s.level == 1), None), meta)
