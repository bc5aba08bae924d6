"""Charsets: naming the encoding of some bytes, and decoding whatever the name."""

from __future__ import annotations

import codecs

#: Names that Python's codecs don't know, or know otherwise.
ALIASES = {"tis-620": "cp874", "x-mac-roman": "mac-roman", "macintosh": "mac-roman", "ascii": "cp1252", "us-ascii": "cp1252", "latin1": "cp1252", "iso-8859-1": "cp1252", "x-mac-cyrillic": "mac-cyrillic", "ibm855": "cp855", "ibm866": "cp866"}
_MARKS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]


def detect(raw: bytes) -> str:
    """A byte-order mark, valid UTF-8, the zeros of UTF-16, else the Windows Latin code page."""
    for mark, name in _MARKS:
        if raw.startswith(mark):
            return name
    try:
        raw.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    head = raw[:4096]
    even, odd = head[::2].count(0), head[1::2].count(0)
    if max(even, odd) > len(head) // 5:
        return "utf-16-le" if odd > even else "utf-16-be"
    return "cp1252"


def decode(raw: bytes, name: str | None = None) -> str:
    """Text of ``raw`` in the named charset; a byte-order mark overrides the name's byte order.

    Bytes without meaning and lone surrogates are dropped; an unknown name is Latin-1.
    """
    name = (name or detect(raw)).strip().lower()
    wide = name.replace("_", "-").startswith(("utf-16", "utf16", "utf-32", "utf32", "ucs-2"))
    for mark, marked in _MARKS:
        if raw.startswith(mark) and (wide == (marked != "utf-8") or name.startswith("utf-8")):
            raw, name = raw[len(mark) :], marked
            break
    else:
        if wide and not name.endswith(("le", "be")):
            name += "-be" if "-" in name else "be"
    try:
        codec = codecs.lookup(ALIASES.get(name, name)).name
    except LookupError:
        codec = "latin-1"
    return raw.decode(codec, "ignore")


def to_text(raw: bytes) -> str:
    return decode(raw)
