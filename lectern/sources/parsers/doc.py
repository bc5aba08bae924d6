"""Legacy DOC: compound file, piece table, headings by how a line looks."""

from __future__ import annotations

import re
import struct

from . import Document, Section

SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
_END = 0xFFFFFFFA  # sector numbers from here on aren't sectors


class CompoundFile:
    """Streams of an OLE2 compound file by name."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != SIGNATURE:
            raise ValueError("not a compound file")
        self.raw = raw
        self.sector = 1 << struct.unpack_from("<H", raw, 30)[0]
        self.mini = 1 << struct.unpack_from("<H", raw, 32)[0]
        n_fat, first_dir = struct.unpack_from("<II", raw, 44)
        self.cutoff, first_mini, _, next_difat, n_difat = struct.unpack_from("<IIIII", raw, 56)
        difat = list(struct.unpack_from("<109I", raw, 76))
        per = self.sector // 4
        for _ in range(min(n_difat, len(raw) // self.sector)):
            if next_difat >= _END:
                break
            more = self._longs(next_difat)
            difat += more[: per - 1]
            next_difat = more[-1]
        self.fat: list[int] = []
        for s in [s for s in difat if s < _END][:n_fat]:
            self.fat += self._longs(s)
        directory = self._chain(first_dir)
        self.entries: dict[str, tuple[int, int, int]] = {}
        root = (0, 0)
        for at in range(0, len(directory) - 127, 128):
            size = struct.unpack_from("<H", directory, at + 64)[0]
            kind, start, length = directory[at + 66], *struct.unpack_from("<IQ", directory, at + 116)
            name = directory[at : at + max(0, size - 2)].decode("utf-16-le", "replace")
            if kind == 5:
                root = (start, length)
            elif kind == 2:
                self.entries[name] = (kind, start, length & 0xFFFFFFFF)
        self.mini_stream = self._chain(root[0])
        table = self._chain(first_mini)
        self.mini_fat = list(struct.unpack(f"<{len(table) // 4}I", table[: len(table) // 4 * 4]))

    def _longs(self, s: int) -> list[int]:
        at = (s + 1) * self.sector
        return list(struct.unpack_from(f"<{self.sector // 4}I", self.raw.ljust(at + self.sector, b"\xff"), at))

    def _chain(self, s: int) -> bytes:
        out, seen = [], set()
        while s < _END and s not in seen and s < len(self.fat):
            seen.add(s)
            out.append(self.raw[(s + 1) * self.sector : (s + 2) * self.sector])
            s = self.fat[s]
        return b"".join(out)

    def read(self, name: str) -> bytes | None:
        if name not in self.entries:
            return None
        _, s, length = self.entries[name]
        if length >= self.cutoff:
            return self._chain(s)[:length]
        out, seen = [], set()
        while s < _END and s not in seen and s < len(self.mini_fat):
            seen.add(s)
            out.append(self.mini_stream[s * self.mini : (s + 1) * self.mini])
            s = self.mini_fat[s]
        return b"".join(out)[:length]


def piece_text(word: bytes, table: bytes, at: int, size: int) -> str:
    """The text that a piece table describes: pieces of one-byte or two-byte characters."""
    end = at + size
    while at < end and table[at] == 1:  # property runs come first
        at += 3 + struct.unpack_from("<H", table, at + 1)[0]
    if at >= end or table[at] != 2:
        raise ValueError("no piece table")
    length = struct.unpack_from("<I", table, at + 1)[0]
    n = (length - 4) // 12
    places = struct.unpack_from(f"<{n + 1}I", table, at + 5)
    out = []
    for k in range(n):
        spot = struct.unpack_from("<I", table, at + 5 + 4 * (n + 1) + 8 * k + 2)[0]
        count = places[k + 1] - places[k]
        if spot & 0x40000000:
            start = (spot & 0x3FFFFFFF) // 2
            out.append(word[start : start + count].decode("cp1252", "ignore"))
        else:
            out.append(word[spot : spot + 2 * count].decode("utf-16-le", "ignore"))
    return "".join(out)


def raw_text(word: bytes) -> str:
    """Without a piece table: UTF-16 text from 0x200 on, else long runs of ASCII."""
    wide = word[0x200:]
    if len(wide) > 64 and wide[1:257:2].count(0) > 64:
        return wide[: len(wide) // 2 * 2].decode("utf-16-le", "ignore")
    return "\n".join(m.decode("ascii") for m in re.findall(rb"[\t\r\n\x20-\x7e]{20,}", word))


def clean(text: str) -> str:
    """Word's marks to plain ones: cells to tabs, paragraphs to line feeds, fields and objects away."""
    text = re.sub(r"\x13[^\x14\x15]*\x14?|\x15", "", text)
    text = text.replace("\r\n", "\n").translate({7: "\t", 11: "\n", 12: "\n", 13: "\n", 30: "-", 160: " "})
    return re.sub("\n{3,}", "\n\n", re.sub(r"[\x00-\x08\x0e-\x1f]", "", text)).strip("\n")


def heading_of(line: str) -> int | None:
    """Chapter and the like, and capitals, are level 1; numbering tells its depth."""
    line = line.strip()
    if not line or len(line.encode()) > 80:
        return None
    if len(line.encode()) < 40 and re.match(r"(?i)(chapter|section|article|part)\s", line):
        return 1
    m = re.match(r"(\d+(?:\.\d+)*)(\.?)\s+\S", line)
    if m and (m[2] or "." in m[1]) and not line.endswith("."):
        return min(6, m[1].count(".") + 1)
    letters = [c for c in line if c.isalpha()]
    return 1 if len(line) >= 3 and len(letters) >= 2 and all(c.isupper() for c in letters) else None


def parse(raw: bytes) -> Document:
    f = CompoundFile(raw)
    word = f.read("WordDocument")
    if word is None:
        raise ValueError("no WordDocument")
    try:
        flags = struct.unpack_from("<H", word, 10)[0]
        table = f.read("1Table" if flags & 0x200 else "0Table") or b""
        text = piece_text(word, table, *struct.unpack_from("<II", word, 0x1A2))
    except (ValueError, struct.error, IndexError):
        text = raw_text(word)
    found: list[tuple[Section, list[str]]] = []
    for line in clean(text).split("\n"):
        level = heading_of(line)
        if level:
            found.append((Section(level, line.strip()), []))
        elif line.strip() or found:
            if not found:
                found.append((Section(), []))
            found[-1][1].append(line.strip(" \t"))
    for s, lines in found:
        s.content = "\n".join(lines).strip("\n")
    sections = [s for s, _ in found]
    return Document(sections, next((s.heading for s in sections if s.level == 1), None))
