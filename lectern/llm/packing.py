"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens.  Output is made in windows; in each window the scheduler
serves the queues in turn and gives each a quantum in proportion to its target share.
Tokens can be cut, so a queue is served exactly its quantum, and what is left of it below one
token is its deficit, carried to the next window.  A queue that runs dry leaves its share
to the others, whose quanta grow in proportion.

A deficit counter after w windows is a function of w alone: the tokens served to queue s by
then are floor(C_s(w * window)), C_s being piecewise linear with a bend wherever some
queue runs dry.  So no task has to wait for another: a document that knows how many tokens
stand before it in its queue can tell where each of its tokens goes.  Those counts come
from two-level prefix sums: inside a task while it tokenises, and over (task, queue) totals.

Windows are a multiple of the sequence length, so sequences are full but for the last.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import write_table
from .common import table
from .vocab import byte_level

BROADCAST_ROWS = 1_000_000  # of (task, queue, tokens), some 40 MB
MOST_QUEUES = 500_000  # sources whose names and totals the schedule may hold, some 50 MB
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


class Schedule:
    """How many tokens each queue has been served after any number of output tokens."""

    def __init__(self, tokens: list[int], weights: list[float | Fraction] | None, window: int) -> None:
        """``tokens``: what each queue holds; ``weights``: target shares, by default what they hold."""
        self.tokens, self.window = tokens, window
        share = [Fraction(w) for w in (tokens if weights is None else weights)]
        if any(w <= 0 for w, n in zip(share, tokens) if n):
            raise ValueError("a queue that holds tokens needs a positive weight")
        at, served = Fraction(0), [Fraction(0)] * len(tokens)
        self.phases: list[tuple[Fraction, list[Fraction], list[Fraction]]] = []
        live = [s for s, n in enumerate(tokens) if n]
        if weights is None and live:  # all run dry together
            self.phases.append((at, served, [Fraction(n, sum(tokens)) for n in tokens]))
            live = []
        while live:
            total = sum(share[s] for s in live)
            rate = [Fraction(0)] * len(tokens)
            for s in live:
                rate[s] = share[s] / total
            self.phases.append((at, list(served), rate))
            step = min((tokens[s] - served[s]) / rate[s] for s in live)
            at += step
            served = [x + step * r for x, r in zip(served, rate)]
            live = [s for s in live if served[s] < tokens[s]]
        self.total = sum(tokens)
        self.starts = [p[0] for p in self.phases]
        self.windows = -(-self.total // window)
        self._cache: dict[int, list[int]] = {}
        self._laid: dict[int, tuple[list[int], list[int], list[int]]] = {}

    def served(self, w: int) -> list[int]:
        """Tokens served from each queue in the first ``w`` windows."""
        if w not in self._cache:
            if len(self._cache) > 64:
                self._cache.clear()
            t = min(w * self.window, self.total)
            if t >= self.total:
                self._cache[w] = list(self.tokens)
            else:
                at, base, rate = self.phases[bisect_right(self.starts, t) - 1]
                self._cache[w] = [int(b + (t - at) * r) for b, r in zip(base, rate)]
        return self._cache[w]

    def window_of(self, s: int, x: int) -> int:
        """The window in which token ``x`` of queue ``s`` is served."""
        lo, hi = 0, self.windows  # served(lo)[s] <= x < served(hi)[s]
        for p in range(len(self.phases) - 1, -1, -1):
            at, base, rate = self.phases[p]
            if base[s] <= x and rate[s]:
                guess = int((at + (x - base[s]) / rate[s]) // self.window)
                lo, hi = max(0, guess - 2), min(self.windows, guess + 3)
                break
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.served(mid)[s] <= x else (lo, mid)
        return lo

    def runs(self, s: int, x: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(tokens before it, length, output position) of the runs of tokens x to x + n of queue ``s``."""
        end, done, w = x + n, x, self.window_of(s, x) if n else 0
        while done < end:
            before, after, first = self.laid(w)
            stop = min(end, after[s])
            if stop > done:
                yield done - x, stop - done, first[s] + done - before[s]
                done = stop
            w += 1

    def laid(self, w: int) -> tuple[list[int], list[int], list[int]]:
        """Tokens served before and after window ``w``, and the output position where each queue's part of it begins."""
        if w not in self._laid:
            if len(self._laid) > 64:
                self._laid.clear()
            before, after = self.served(w), self.served(w + 1)
            self._laid[w] = before, after, list(accumulate((b - a for a, b in zip(before, after)), initial=sum(before)))
        return self._laid[w]


def tokenise(docs: DataFrame, id_col: str, text_col: str, source_col: str | None, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, queue, task, before, n, ids): every document's ids with ``end_id``, and the tokens before it in its queue within its task."""
    source = F.lit("") if source_col is None or source_col not in docs.columns else F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), source.alias("queue"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, seen = byte_level(vocabulary), TaskContext.get().partitionId(), {}
        last = np.array([end_id], dtype="<u2").tobytes()
        for b in batches:
            out = []
            for text, queue in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids = bpe.ids(text) + last
                n = len(ids) // 2
                out.append((queue, seen.get(queue, 0), n, ids))
                seen[queue] = seen.get(queue, 0) + n
            if out:
                queue, before, n, ids = zip(*out)
                yield pa.record_batch([b.column(0), pa.array(queue), pa.array([task] * len(out), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "queue", "task", "before", "n", "ids"])

    return rows.mapInArrow(run, "doc_id long, queue string, task int, before long, n long, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", length: int = 1024, weights: dict[str, float] | None = None, vocabulary: str = "byte_bpe_50k", end_id: int = 0) -> DataFrame:
    """Pieces of all documents, placed in sequences of ``length`` tokens.

    ``weights`` are target shares by source; by default each source's share of all tokens, which
    makes every window a sample of the corpus.  Each source is a queue of its own; their totals are
    all that the schedule holds, and more than ``MOST_QUEUES`` of them raise an error.

    A null or empty text is its end token alone; a null source is the queue ""; null ids are
    packed and stay null; repeated rows are packed as often as they come; an empty table
    gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    tokens = write_table(tokenise(docs, id_col, text_col, source_col, vocabulary, end_id), "tokens")
    sums = tokens.groupBy("queue", "task").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = write_table(sums.select("queue", "task", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).cast("long").alias("earlier")), "queue-sums")
    totals = sums.groupBy("queue").agg(F.sum("n").alias("n"))
    if totals.count() > MOST_QUEUES:
        raise ValueError(f"more than {MOST_QUEUES} sources: pack by a coarser column")
    held = {r["queue"]: int(r["n"]) for r in totals.collect()}
    names = sorted(held)
    window = length * max(64, 4 * len(names))
    share = None if weights is None else [weights.get(q, 0) for q in names]
    place = {q: s for s, q in enumerate(names)}
    plan = Schedule([held[q] for q in names], share, window)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, queue, before, n, ids, earlier in zip(*(b.column(c).to_pylist() for c in range(6))):
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
                for start, size, at in plan.runs(place[queue], earlier + before, n):
                    while size:  # cut where sequences end
                        part = min(size, length - at % length)
                        out.append((doc, start, part, zlib.crc32(wide[4 * start : 4 * (start + part)]), n, at // length, at % length, queue))
                        start, size, at = start + part, size - part, at + part
            if out:
                kinds = (*[pa.int64()] * 7, pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"])

    small = sums.select("queue", "task", "earlier")
    small = F.broadcast(small) if small.count() <= BROADCAST_ROWS else small
    joined = tokens.join(small, ["queue", "task"]).select("doc_id", "queue", "before", "n", "ids", "earlier")
    return joined.mapInArrow(run, PIECES)


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
