"""Chunking: section rows to chunk rows.

Within a document chunking is sequential (groups fill greedily, small neighbours merge), so
it runs as one Arrow function over each document's sections; offsets and identifiers are
window functions.  All budgets count UTF-8 bytes; a hard cut backs up to a character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNKS = "document_id long, chunk_index int, section_path string, heading string, text string, heading_level int, page_physical int, page_logical int, page_section int, page_roman boolean, source_line int"
_BLANK = b" \t\r\n"
_PAGES = ("page_physical", "page_logical", "page_section", "page_roman", "source_line")


@dataclass(frozen=True)
class ChunkOptions:
    max_tokens: int = 1500
    min_tokens: int = 100
    tokens_per_byte: float = 0.25
    hard_bytes: int = 256 << 10

    @property
    def byte_budget(self) -> int:
        return max(1, min(int(self.max_tokens / self.tokens_per_byte), self.hard_bytes))

    def tokens(self, raw: bytes) -> int:
        return max(1, -int(-len(raw) * self.tokens_per_byte // 1)) if raw else 0


def split_bytes(raw: bytes, budget: int) -> Iterator[bytes]:
    """Parts of at most ``budget`` bytes: after the last sentence that ends in a part's second
    half, else at its last blank, else at a character."""
    at = 0
    while at < len(raw):
        end = at + budget
        if end >= len(raw):
            yield raw[at:]
            return
        half = at + budget // 2
        spot = next((i for i in range(end, half, -1) if raw[i : i + 1] in (b" ", b"\t") and raw[i - 1 : i] in (b".", b"!", b"?")), None)
        if spot is None:
            spot = next((i for i in range(end, half, -1) if raw[i : i + 1] in (b" ", b"\t")), None)
        if spot is not None:
            yield raw[at:spot]
            at = spot + 1
            continue
        while end > at + 1 and raw[end] & 0xC0 == 0x80:
            end -= 1
        yield raw[at:end]
        at = end


def _spans(raw: bytes, separator: bytes) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in re.finditer(separator, raw):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(raw)))
    return [(a, b) for a, b in out if raw[a:b].strip(_BLANK)]


def split_content(raw: bytes, o: ChunkOptions) -> list[bytes]:
    """Content within the token limit: whole, or groups of paragraphs, or of lines, or cut bytes."""
    if o.tokens(raw) <= o.max_tokens:
        return [raw]
    spans = _spans(raw, b"\n{2,}")
    if len(spans) <= 1:
        spans = _spans(raw, b"\n")
    if len(spans) <= 1:
        return [p for p in split_bytes(raw, o.byte_budget) if p.strip(_BLANK)]
    groups: list[tuple[int, int]] = []
    held = 0
    for a, b in spans:
        n = o.tokens(raw[a:b])
        if held and held + n <= o.max_tokens:
            groups[-1] = (groups[-1][0], b)
            held += n
        else:
            groups.append((a, b))
            held = n
    out: list[bytes] = []
    for a, b in groups:
        text = raw[a:b]
        out += [text] if o.tokens(text) <= o.max_tokens else [p for p in split_bytes(text, o.byte_budget) if p.strip(_BLANK)]
    return out


def chunk_sections(sections: list[dict], o: ChunkOptions) -> list[dict]:
    """Chunks of one document's sections (seq, parent_seq, level, heading, content, pages), in order.

    Each non-blank content is one chunk or more; then runs of small neighbours below the same
    parent merge while they fit, under the first one's heading.
    """
    path: dict[int, str] = {}
    made: list[dict] = []
    for s in sorted(sections, key=lambda s: s["seq"]):
        above = path.get(s["parent_seq"], "") if s["parent_seq"] is not None else ""
        own = " > ".join(x for x in (above, s["heading"] or "") if x)
        path[s["seq"]] = own
        raw = (s["content"] or "").encode()
        if raw.strip(_BLANK):
            for part in split_content(raw, o):
                made.append({"parent": above, "section_path": own, "heading": s["heading"], "raw": part, "tokens": o.tokens(part), "heading_level": s["level"]} | {p: s.get(p) for p in _PAGES})
    out: list[dict] = []
    run = 0  # tokens in the merge that is open; 0: none
    for c in made:
        small = c["tokens"] < o.min_tokens
        if run and small and c["parent"] == out[-1]["parent"] and run + c["tokens"] <= o.max_tokens:
            out[-1]["raw"] += b"\n\n" + c["raw"]
            run += c["tokens"]
        else:
            out.append(c)
            run = c["tokens"] if small else 0
    return out


def chunk(sections: DataFrame, options: ChunkOptions | None = None, doc_col: str = "document_id") -> DataFrame:
    """Chunk rows, with ``start_byte`` and ``end_byte`` running over each document's chunks."""
    o = options or ChunkOptions()
    names = [c.split(" ")[0] for c in CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32()]

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        out = []
        for i, c in enumerate(chunk_sections(rows, o)):
            out.append((rows[0]["document_id"], i, c["section_path"] or None, c["heading"], c["raw"].decode(), c["heading_level"], *(c[p] for p in _PAGES)))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names=names)

    wanted = ["seq", "parent_seq", "level", "heading", "content", *_PAGES]
    have = [F.col(doc_col).cast("long").alias("document_id"), *(F.col(c) if c in sections.columns else F.lit(None).cast("int").alias(c) for c in wanted)]
    made = sections.select(*have).groupBy("document_id").applyInArrow(run, CHUNKS)
    so_far = Window.partitionBy("document_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.octet_length("text").cast("long")).over(so_far)
    return made.withColumn("end_byte", end).withColumn("start_byte", F.col("end_byte") - F.octet_length("text"))
