"""Blocks of documents that ask the whole corpus about their keys.

A text table is dealt by a hash of the id into blocks of some 16 MB.  A block sends each of its
distinct keys (64-bit hashes) once, packed by key range, to the reducer of that range, and
gets one packed answer a range back, in the order it asked: keys travel one way and
small answers the other.  A key that fills a third of all rows is one key for each block.
The blocks' exchange is made once and read again by each later step of the same plan.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, partitions

BLOCK_BYTES = 16 << 20
U8, U4 = np.dtype("<u8"), np.dtype("<u4")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SPACED = bytes(32 if c in SPACES.encode() else c for c in range(256))
SLICE, LONG = 1 << 18, 1 << 16  # bytes hashed at once; words above LONG bytes are hashed by themselves


def power_of_two(least: int) -> int:
    n = 1
    while n < least:
        n *= 2
    return n


def block_count(docs: DataFrame, text_col: str = "text", size: int = BLOCK_BYTES) -> int:
    """A power of two: by the bytes of all texts, counted, and no fewer than the shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return power_of_two(max(partitions(docs.sparkSession), -(-total // size)))


def to_blocks(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", rest: list[str] | None = None) -> DataFrame:
    """(block, doc_id, text[, rest]): null texts become empty, ids are cast to long; rows without an id are spread by text."""
    doc_id = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    by = F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id, F.lit(7)))
    more = [F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest")] if rest else []
    return docs.select(F.pmod(by, F.lit(n)).cast("int").alias("block"), doc_id.alias("doc_id"), text.alias("text"), *more)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x.astype(U8, copy=True)
    x ^= x >> np.uint64(31)
    x *= _M2
    x ^= x >> np.uint64(29)
    x *= _M1
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int) -> np.ndarray:
    out = np.full(SLICE + LONG + 1, base, U8)
    out[0] = 1
    return np.cumprod(out, dtype=U8)


_BASE = 0xD6E8FEB86659FD93
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=U8) * np.uint64(2) + np.uint64(1)


class Words:
    """The words of texts as places in one buffer, with a 64-bit hash of each.

    The hash is a polynomial over random numbers of the bytes, taken as differences of running
    sums, and mixed: no object is made for a word.  Memory is some twelve times the texts.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.raw = b"\n".join(texts).translate(_SPACED)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.cumsum(lengths + 1) - lengths - 1
        data = np.frombuffer(self.raw, np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = data != 32
        edge = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.begins = np.searchsorted(self.starts, self.offsets)  # of each text, its first word and the next text's
        self.finals = np.append(self.begins[1:], len(self.starts))
        self.letters = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        self.hashes = self._hash(data)

    def _hash(self, data: np.ndarray) -> np.ndarray:
        starts, ends = self.starts, self.ends
        out = np.empty(len(starts), U8)
        long = np.flatnonzero(ends - starts > LONG)
        if len(long):
            ends = ends.copy()
            ends[long] = starts[long]
        cuts = np.searchsorted(starts, np.arange(0, len(data) + SLICE, SLICE))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a < z:
                low, high = int(starts[a]), int(max(ends[z - 1], starts[z - 1]))
                sums = np.zeros(high - low + 1, U8)
                np.cumsum(_BYTES[data[low:high]] * _UP[: high - low], out=sums[1:])
                s = starts[a:z] - low
                out[a:z] = (sums[ends[a:z] - low] - sums[s]) * _DOWN[s]
        for i in long.tolist():
            out[i] = xxhash.xxh64_intdigest(self.raw[self.starts[i] : self.ends[i]])
        return mix(out)

    def joined(self, a: int, z: int) -> bytes:
        """Words a to z, joined by one space."""
        if a >= z:
            return b""
        piece = self.raw[self.starts[a] : self.ends[z - 1]]
        return piece if len(piece) == self.letters[z] - self.letters[a] + z - a - 1 else b" ".join(piece.split())


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct uint64 keys as deltas of the fewest bytes that hold them all."""
    if not len(keys):
        return b""
    deltas = np.empty(len(keys), U8)
    deltas[0], deltas[1:] = keys[0], np.diff(keys)
    rest = deltas[1:]
    width = max(1, -(-int(rest.max()).bit_length() // 8)) if len(rest) else 1
    return bytes([width]) + deltas[:1].tobytes() + rest.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, U8)
    width = raw[0]
    rest = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(rest) + 1, 8), np.uint8)
    out[1:, :width] = rest
    out = out.view(U8).reshape(-1)
    out[0] = np.frombuffer(raw, U8, 1, 1)[0]
    return np.cumsum(out, dtype=U8)


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte a count; those of 255 or more follow as uint64."""
    big = counts[counts >= 255].astype(U8)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + big.tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, U8, offset=n).astype(np.int64)
    return out


def range_starts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Places in sorted ``keys`` where each of ``ranges`` (a power of two) equal key ranges begins, and the end."""
    shift = 64 - (ranges.bit_length() - 1)
    if ranges == 1:
        return np.array([0, len(keys)])
    return np.searchsorted(keys >> np.uint64(shift), np.arange(ranges + 1).astype(U8))
