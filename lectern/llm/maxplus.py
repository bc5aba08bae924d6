"""SentencePiece encoding and decoding by a max-plus parallel scan.

The pieces of a public vocabulary and their scores span a lattice over a text; its encoding
is the path of the highest sum, in max-plus algebra a product of matrices.  A giant document
is cut into chunks of fixed length.  The state at a chunk's boundary is how far the piece
that crosses it reaches into the next chunk, so each chunk, alone and in any order, yields
a matrix from entry to exit states.  The products are associative: groups of chunks are
multiplied in parallel, then the groups of a document, and going back down fixes the state at
every boundary.  Then each chunk traces its own best path between its two states.

Where no piece spans two neighbouring characters every path is cut; with this kind of
vocabulary that is at each space after another character.  Between cuts a segment's path depends
on nothing else, so segments are encoded once and cached, and a chunk with a cut has a
matrix of rank one: its left edge, plus its right edge.

Scores are integers with a term from the piece's own hash below them, so only paths with the
same pieces in another order tie (runs of one character, or of one pattern).  Of those the path with the least
sum of starts is taken: matrices carry that sum beside the score.  Moving a text moves
all such sums alike, so the ids depend neither on where chunks end nor on where a segment stands.  Characters without a piece are spelt as byte pieces.  Decoding joins the pieces: encoding and decoding give back any text.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import write_table
from .common import partitions, table
from .vocab import LONGEST, vocabulary_path

NEVER = -(1 << 61)
LEAST = np.iinfo(np.int64).min
SHIFT = 62  # a path's weight: its score, then (below it) less its sum of starts, which no text of 2 GB brings to 1 << 61
CHUNK = 16_384  # characters; more than the longest piece
SEGMENTS = 800_000  # cached by a worker, some 200 MB
GROUP = 64  # chunks multiplied by one task
_CUT = re.compile(r"(?<=[^ ])(?= )")
_loaded: dict[str, "Lattice"] = {}


def _ids(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Segments(dict):
    """Segment -> ids; bounded, as the caches of ``vocab`` are."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, segment: str) -> bytes:
        ids = self.encode(segment)
        if len(segment) <= LONGEST:
            if len(self) >= SEGMENTS:
                self.clear()
            self[segment] = ids
        return ids


class Lattice:
    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces: dict[str, tuple[int, int]] = {}
        self.text: list[bytes] = [b""] * size
        self.byte_ids = [0] * 256
        least = 0.0
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                s, score = piece.replace("▁", " "), max(sp.get_score(i), -1e6)
                least = min(least, score) if sp.get_score(i) > -1e6 else least
                self.pieces[s] = (i, round(score) * (1 << 32) - zlib.crc32(s.encode()))
                self.text[i] = s.encode()
        self.spelt = round(least - 10) * (1 << 32)
        self.longest = max(map(len, self.pieces))
        #: each beginning of a piece; with its id and score if it is a piece itself
        self.trie = {s[:n]: self.pieces.get(s[:n]) for s in self.pieces for n in range(1, len(s) + 1)}
        self.bigrams = {s[k : k + 2] for s in self.pieces for k in range(len(s) - 1)}
        self.cut_at_spaces = not any(b[1] == " " and b[0] != " " for b in self.bigrams)
        self.first = _Segments(self.best)
        self.later = _Segments(lambda p: self.best(" " + p))

    def steps(self, s: str, i: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(next place, id or -1 for bytes, score) of each piece at place i."""
        trie, spelt = self.trie, True
        for j in range(i + 1, min(end, i + self.longest) + 1):
            part = s[i:j]
            if part not in trie:
                break
            if (hit := trie[part]) is not None:
                spelt &= j > i + 1
                yield j, *hit
        if spelt:
            yield i + 1, -1, self.spelt

    def forward(self, s: str, begin: int, stop: int, end: int, base: int = 0) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
        """Best weights from ``begin`` to each place, by pieces that start before ``stop`` and end by ``end``; and the last piece.

        ``base`` is where ``s`` starts in its document."""
        best, back = {begin: 0}, {}
        for i in range(begin, stop):
            if (at := best.get(i)) is None:
                continue
            at -= base + i
            for j, piece, score in self.steps(s, i, end):
                x = at + (score << SHIFT)
                if j not in best or x > best[j]:
                    best[j], back[j] = x, (i, piece)
        return best, back

    def trace(self, s: str, back: dict[int, tuple[int, int]], begin: int, end: int) -> bytes:
        out: list[int] = []
        while end > begin:
            i, piece = back[end]
            out += [piece] if piece >= 0 else [self.byte_ids[c] for c in reversed(s[i].encode("utf-8", "replace"))]
            end = i
        return _ids(out[::-1])

    def best(self, s: str) -> bytes:
        """Ids of a whole segment: :meth:`forward` and :meth:`trace` in one, for the many short ones."""
        n, get, longest = len(s), self.trie.get, self.longest
        top, back, starts = [NEVER] * (n + 1), [(0, 0)] * (n + 1), [0] * (n + 1)
        top[0] = 0
        for i in range(n):
            at = top[i]
            if at == NEVER:
                continue
            single, sum_of = False, starts[i] + i
            for j in range(i + 1, min(n, i + longest) + 1):
                hit = get(s[i:j], 0)
                if hit is None:
                    continue
                if hit == 0:
                    break
                single |= j == i + 1
                x = at + hit[1]
                if x > top[j] or x == top[j] and sum_of < starts[j]:
                    top[j], back[j], starts[j] = x, (i, hit[0]), sum_of
            if not single and at + self.spelt > top[i + 1]:
                top[i + 1], back[i + 1], starts[i + 1] = at + self.spelt, (i, -1), sum_of
        out: list[int] = []
        while n:
            i, piece = back[n]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.byte_ids[c] for c in reversed(s[i].encode("utf-8", "replace"))]
            n = i
        return _ids(out[::-1])

    def path(self, s: str, begin: int, stop: int, end: int) -> bytes:
        return self.trace(s, self.forward(s, begin, stop, end)[1], begin, end) if end > begin else b""

    def segments(self, s: str) -> bytes:
        """Ids of a text that starts and ends at cuts."""
        if not s:
            return b""
        if not self.cut_at_spaces:
            return self.path(s, 0, len(s), len(s))
        if s[0] == " " and "  " not in s and s[-1] != " ":
            later = self.later
            return b"".join([later[p] for p in s[1:].split(" ")])
        first = self.first
        return b"".join([first[p] for p in _CUT.split(s)])

    def cuts(self, s: str, n: int) -> tuple[int, int] | None:
        """The first and the last place from 1 to n that every path passes."""
        sure = (lambda p: s[p - 1 : p + 1] not in self.bigrams and p < len(s)) if len(s) > 1 else (lambda p: False)
        first = next((p for p in range(1, n + 1) if sure(p)), None)
        return None if first is None else (first, next(p for p in range(n, 0, -1) if sure(p)))

    def matrix(self, s: str, n: int, base: int = 0) -> np.ndarray:
        """Best weights from each entry to each exit state of a chunk of ``n`` characters and what follows, up to
        a constant: scores, and less the sums of starts.  ``base`` is where the chunk starts in its document."""
        m = self.longest
        found = self.cuts(s, n)
        best: dict[tuple[int, int], int] = {}
        if found:
            first, last = found
            right = {j - n: x for j, x in self.forward(s, last, n, len(s), base)[0].items() if j >= n}
            left: dict[int, int] = {first: 0}
            for i in range(first - 1, -1, -1):
                left[i] = max((left[j] + (x << SHIFT) - base - i for j, _, x in self.steps(s, i, first)))
            best = {(a, b): x + y for a, x in left.items() if a < m for b, y in right.items() if b < m}
        else:
            for a in range(min(m, n + 1)):
                best |= {(a, j - n): x for j, x in self.forward(s, a, n, len(s), base)[0].items() if n <= j < n + m}
            best |= {(a, a - n): 0 for a in range(n, m)}  # the piece reaches past the whole chunk
        out = np.zeros((2, m, m), np.int64)
        out[0] = NEVER
        scores = {k: -(-x >> SHIFT) for k, x in best.items()}
        top = max(scores.values())
        for k, x in best.items():
            if scores[k] - top > NEVER:
                out[0][k], out[1][k] = scores[k] - top, x - (scores[k] << SHIFT)
        return out

    def chunk(self, s: str, n: int, a: int, b: int) -> bytes:
        """Ids of a chunk's best path between two boundary states."""
        found = self.cuts(s, n)
        if not found or a > found[0]:
            return self.path(s, a, n, n + b) if n + b > a else b""
        first, last = found
        return self.path(s, a, first, first) + self.segments(s[first:last]) + self.path(s, last, n, n + b)

    def total(self, ids: np.ndarray) -> int:
        """The sum of scores of a path."""
        of = {i: x for i, x in self.pieces.values()}
        lead = sum(1 for i in ids.tolist() if i not in of and self.text[i][0] & 0xC0 != 0x80)
        return sum(of.get(i, 0) for i in ids.tolist()) + lead * self.spelt

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the pieces joined, less the leading space."""
        return b"".join(map(self.text.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def lattice(vocabulary: str) -> Lattice:
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Lattice(vocabulary_path(vocabulary))
    return _loaded[vocabulary]


def _scaled(scores: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Weights less those of the best, entries without a path alike."""
    top = scores.max()
    if top <= NEVER // 2:
        return np.stack([np.full_like(scores, NEVER), np.zeros_like(sums)])
    real = scores > NEVER // 2
    return np.stack([np.where(real, scores - top, NEVER), np.where(real, sums - sums[real].max(), 0)])


def _largest(scores: np.ndarray, sums: np.ndarray, axis: int) -> np.ndarray:
    """The largest weights along an axis, scaled."""
    top = scores.max(axis=axis, keepdims=True)
    return _scaled(top.squeeze(axis), np.where(scores == top, sums, LEAST).max(axis=axis))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of weights, scaled so that its largest entry is 0; associative up to that scale."""
    scores, sums = a[:, :, :, None] + b[:, None, :, :]
    return _largest(scores, sums, 1)


def route(matrices: list[np.ndarray], begin: int, end: int) -> list[int]:
    """The boundary states of the best path through a run of matrices, both ends included."""
    v = np.zeros((2, matrices[0].shape[1]), np.int64)
    v[0] = NEVER
    v[0, begin] = 0
    seen = [v]
    for m in matrices:
        scores, sums = v[:, :, None] + m
        v = _largest(scores, sums, 0)
        seen.append(v)
    states = [end]
    for v, m in zip(reversed(seen[:-1]), reversed(matrices)):
        scores, sums = v + m[:, :, states[-1]]
        states.append(int(np.where(scores == scores.max(), sums, LEAST).argmax()))
    return states[::-1]


def _matrices(raws: Iterable[bytes]) -> list[np.ndarray]:
    out = [np.frombuffer(r, "<i8") for r in raws]
    side = int((len(out[0]) // 2) ** 0.5) if out else 0
    return [m.reshape(2, side, side) for m in out]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "piece_bpe_32k.model", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids, chunks, text_crc32) of each row; ids are little-endian uint16.

    A null or empty text has no ids; a null id stays null; repeated rows are encoded as often as
    they come; an empty table gives an empty result.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    crc = F.crc32(F.col("text").cast("binary")).alias("text_crc32")
    out = "doc_id long, ids binary, chunks int, text_crc32 long"

    def small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(vocabulary)
        for b in batches:
            ids = [lat.segments(" " + t) if t else b"" for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary()), pa.array([1] * len(ids), pa.int32()), b.column(2)], names=["doc_id", "ids", "chunks", "text_crc32"])

    few = rows.filter(F.char_length("text") < chunk).select("doc_id", "text", crc).mapInArrow(small, out)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = lattice(vocabulary).longest - 1
        for b in batches:
            for key, doc, t, c in zip(*(b.column(k).to_pylist() for k in range(4))):
                s = " " + t
                at = range(0, len(s), chunk)
                parts = [s[i : i + chunk + more] for i in at]
                yield pa.record_batch([pa.array([v] * len(parts), k) for v, k in ((key, pa.int64()), (doc, pa.int64()), (c, pa.int64()))] + [pa.array(range(len(parts)), pa.int32()), pa.array([min(chunk, len(s) - i) for i in at], pa.int32()), pa.array(parts, pa.string())], names=["key", "doc_id", "text_crc32", "chunk", "n", "part"])

    giants = rows.filter(F.char_length("text") >= chunk).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", crc)
    parts = write_table(giants.mapInArrow(cut, "key long, doc_id long, text_crc32 long, chunk int, n int, part string"), "chunks")

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(vocabulary)
        for b in batches:
            made = [lat.matrix(s, n, at * chunk).astype("<i8").tobytes() for at, n, s in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["key", "chunk", "m"])

    spread = parts.select("key", "chunk", "n", "part").repartition(partitions(docs.sparkSession), "key", "chunk")
    weighed = write_table(spread.mapInArrow(weigh, "key long, chunk int, m binary").withColumn("group", F.floor(F.col("chunk") / GROUP).cast("int")), "matrices")

    def product(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        ms = _matrices(t.column("m").to_pylist())
        while len(ms) > 1:
            ms = [times(*ms[i : i + 2]) if i + 1 < len(ms) else ms[i] for i in range(0, len(ms), 2)]
        return pa.table([t.column("key")[:1], t.column("group")[:1], pa.array([ms[0].astype("<i8").tobytes()], pa.binary())], names=["key", "group", "m"])

    def ends(t: pa.Table) -> pa.Table:
        t = t.sort_by("group")
        states = route(_matrices(t.column("m").to_pylist()), 0, 0)
        return pa.table([t.column("key"), t.column("group"), pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32())], names=["key", "group", "a", "b"])

    def inner(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        states = route(_matrices(t.column("m").to_pylist()), t.column("a")[0].as_py(), t.column("b")[0].as_py())
        return pa.table([t.column("key"), t.column("chunk"), pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32())], names=["key", "chunk", "a", "b"])

    groups = weighed.groupBy("key", "group").applyInArrow(product, "key long, group int, m binary")
    bounds = groups.groupBy("key").applyInArrow(ends, "key long, group int, a int, b int")
    states = weighed.join(bounds, ["key", "group"]).groupBy("key", "group").applyInArrow(inner, "key long, chunk int, a int, b int")

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(vocabulary)
        for b in batches:
            ids = [lat.chunk(s, n, x, y) for s, n, x, y in zip(*(b.column(c).to_pylist() for c in ("part", "n", "a", "b")))]
            yield pa.record_batch([b.column(c) for c in ("key", "doc_id", "text_crc32", "chunk")] + [pa.array(ids, pa.binary())], names=["key", "doc_id", "text_crc32", "chunk", "ids"])

    def whole(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        return pa.table([t.column("doc_id")[:1], pa.array([b"".join(t.column("ids").to_pylist())], pa.binary()), pa.array([t.num_rows], pa.int32()), t.column("text_crc32")[:1]], names=["doc_id", "ids", "chunks", "text_crc32"])

    traced = parts.join(states, ["key", "chunk"]).select("key", "doc_id", "text_crc32", "chunk", "n", "part", "a", "b").mapInArrow(finish, "key long, doc_id long, text_crc32 long, chunk int, ids binary")
    return few.unionAll(traced.groupBy("key").applyInArrow(whole, out))


def decode(encoded: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, text) of rows that :func:`encode` returned."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(vocabulary)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([lat.decode(np.frombuffer(x, "<u2")) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op5_maxplus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's encoding, and whether decoding it gives the text back."""
    vocabulary = "piece_bpe_32k.model"

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(vocabulary)
        for b in batches:
            raws, crcs = b.column(1).to_pylist(), b.column(3).to_pylist()
            same = [zlib.crc32(lat.decode(np.frombuffer(r, "<u2")).encode()) == c for r, c in zip(raws, crcs)]
            data = [b.column(0), pa.array([len(r) // 2 for r in raws], pa.int64()), pa.array([zlib.crc32(r) for r in raws], pa.int64()), b.column(2), pa.array(same)]
            yield pa.record_batch(data, names=["doc_id", "n_tokens", "ids_crc32", "chunks", "round_trip"])

    found = encode(table(spark, sf_dir, "documents"), vocabulary=vocabulary)
    return found.mapInArrow(digest, "doc_id long, n_tokens long, ids_crc32 long, chunks int, round_trip boolean")
