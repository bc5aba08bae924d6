"""XML and zip helpers of the office and e-book parsers."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from . import TooLarge

LARGEST = 64 << 20  # bytes of one unpacked entry: more is taken for a bomb


def strip_doctype(text: str) -> str:
    """XML without its document type, which can define entities without end."""
    return re.sub(r"<!DOCTYPE(?:[^\[>]|\[[^\]]*\])*>", "", text, flags=re.I)


def parse_xml(raw: bytes | str) -> ElementTree.Element:
    text = raw.decode("utf-8-sig", "replace") if isinstance(raw, bytes) else raw
    text = re.sub(r"^\s*<\?xml[^>]*\?>", "", strip_doctype(text))
    return ElementTree.fromstring(text)


def local(tag: object) -> str:
    """An element's name without its namespace; '' for comments."""
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def attr(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


class Archive:
    def __init__(self, raw: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        self.names = set(self.zip.namelist())

    def read(self, name: str) -> bytes | None:
        if name not in self.names:
            return None
        if self.zip.getinfo(name).file_size > LARGEST:
            raise TooLarge(f"{name} unpacks to more than {LARGEST} bytes")
        with self.zip.open(name) as f:
            out = f.read(LARGEST + 1)
        if len(out) > LARGEST:
            raise TooLarge(f"{name} unpacks to more than {LARGEST} bytes")
        return out
