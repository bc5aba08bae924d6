"""LM scoring: deleted interpolation of n-gram maximum-likelihood estimates.

P(w | v) = l2[b] c(v, w) / c(v) + l1[b] c(w) / N + l0[b] / (V + 1), where b is the bucket of the
context's frequency c(v) (powers of two).  Each bucket's weights are learned by
expectation-maximisation on held-out counts: one fold of the training documents is
deleted from the counts, its tokens are looked up in what is left, and their counts by
(bucket, bigram estimate, unigram estimate) are the data of the iteration.  The final
estimates use all training documents.

Counting and lookup are one plan over blocks (see ``blocks``): a block asks once for each of
its distinct words and bigrams.  A word is known by a 64-bit hash, a bigram by 56 bits of a
mix of two such: of a billion distinct words none or one pair is taken for one, of a billion
distinct bigrams some seven pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import write_table
from .blocks import U4, U8, Words, block_count, mix, pack_counts, pack_keys, range_starts, to_blocks, unpack_counts, unpack_keys
from .common import id_fold, lower_ascii, raw_texts, released, table

LOW = np.uint64(255)  # a bigram's key leaves these bits out
END, START = np.uint64(0x656E64), np.uint64(0x7374617274)  # no word hashes to these but by chance
FINE = 20  # bins of an estimate for each factor of ten

_ASK = "bucket int, block int, one binary, one_all binary, one_cut binary, two binary, two_all binary, two_cut binary"
_TOLD = "block int, bucket int, one_all binary, one_cut binary, two_all binary, two_cut binary, distinct long"
_ROWS = "doc_id long, held_out boolean, train boolean, n_tokens long, n_known long, base_sum double, c1 binary, c2 binary, distinct long, hist binary"


class _Block:
    """Tokens of a block's texts, its distinct words and bigrams, and each token's place among them."""

    def __init__(self, texts: list[bytes]) -> None:
        words = Words([lower_ascii(t) for t in texts])
        self.sizes = words.finals - words.begins + 1
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        total = int(self.sizes.sum())
        tokens = np.full(total, END)
        tokens[np.arange(len(words.hashes)) + np.repeat(np.arange(len(texts)), self.sizes - 1)] = words.hashes
        before = np.empty(total, U8)
        before[1:] = tokens[:-1]
        before[self.starts] = START
        self.ones, self.one_at = np.unique(tokens, return_inverse=True)
        self.twos, self.two_at = np.unique(mix(mix(before) + tokens) & ~LOW, return_inverse=True)


def _flags(folds: np.ndarray, held: int, deleted: int) -> tuple[np.ndarray, np.ndarray]:
    return folds != held, folds == deleted


def _collected(t: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """ids, texts and folds in an order that doesn't depend on how the rows came."""
    rows = sorted(zip(t.column("doc_id").to_pylist(), raw_texts(t.column("text")), t.column("fold").to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return [r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.int64)


def lookups(docs: DataFrame, id_col: str, text_col: str, folds: int, held: int, deleted: int) -> DataFrame:
    """One row for each document with its tokens' training counts, and histograms of the deleted fold."""
    n = block_count(docs, text_col)
    rows = to_blocks(docs, n, id_col, text_col).withColumn("fold", id_fold("doc_id", folds))

    def ask(t: pa.Table) -> pa.Table:
        _, texts, fold = _collected(t)
        b = _Block(texts)
        train, cut = (np.repeat(f, b.sizes) for f in _flags(fold, held, deleted))
        packed = []
        for keys, at, spare in ((b.ones, b.one_at, 0), (b.twos, b.two_at, 8)):
            starts = range_starts(keys, n)
            sent = keys >> np.uint64(spare)
            every, some = (np.bincount(at, weights=f, minlength=len(keys)).astype(np.int64) for f in (train, cut))
            packed.append([[pack_keys(sent[s:e]), pack_counts(every[s:e]), pack_counts(some[s:e])] for s, e in zip(starts[:-1], starts[1:])])
        block = t.column("block")[0].as_py()
        out = [(k, block, *one, *two) for k, (one, two) in enumerate(zip(*packed)) if one[0] or two[0]]
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6)
        return released(pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["bucket", "block", "one", "one_all", "one_cut", "two", "two_all", "two_cut"]))

    def answer(t: pa.Table) -> pa.Table:
        cols = {c: t.column(c).to_pylist() for c in t.column_names}
        order = sorted(range(t.num_rows), key=lambda i: cols["block"][i])
        done: dict[str, list[bytes]] = {}
        owned = [0] * len(order)
        for kind in ("one", "two"):
            keys = [unpack_keys(cols[kind][i]) for i in order]
            sizes = np.array([len(k) for k in keys])
            ends = np.cumsum(sizes)
            _, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            sums = []
            for what in ("all", "cut"):
                counts = np.concatenate([unpack_counts(cols[f"{kind}_{what}"][i], m) for i, m in zip(order, sizes)])
                total = np.bincount(at, weights=counts, minlength=len(first)).astype(np.int64)
                sums.append(total)
                done[f"{kind}_{what}"] = [pack_counts(total[at[e - m : e]]) for e, m in zip(ends, sizes)]
            if kind == "one":  # a distinct training word counts where it comes first
                owner = np.searchsorted(ends, first[sums[0] > 0], side="right")
                owned = np.bincount(owner, minlength=len(order)).tolist()
        data = [pa.array([cols["block"][i] for i in order], pa.int32()), pa.array([cols["bucket"][i] for i in order], pa.int32()), *(pa.array(done[k], pa.binary()) for k in ("one_all", "one_cut", "two_all", "two_cut")), pa.array(owned, pa.int64())]
        return released(pa.table(data, names=["block", "bucket", "one_all", "one_cut", "two_all", "two_cut", "distinct"]))

    def look(t: pa.Table, told: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "train", "n_tokens", "n_known", "base_sum", "c1", "c2", "distinct", "hist"]
        kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        if not t.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        ids, texts, fold = _collected(t)
        b = _Block(texts)
        by = {told.column("bucket")[i].as_py(): i for i in range(told.num_rows)}
        got: dict[str, np.ndarray] = {}
        for kind, keys in (("one", b.ones), ("two", b.twos)):
            starts = range_starts(keys, n)
            for what in ("all", "cut"):
                col = told.column(f"{kind}_{what}")
                got[f"{kind}_{what}"] = np.concatenate([unpack_counts(col[by[k]].as_py(), e - s) for k, (s, e) in enumerate(zip(starts[:-1], starts[1:])) if e > s])
        c1, c2 = got["one_all"][b.one_at], got["two_all"][b.two_at]
        train, cut = _flags(fold, held, deleted)
        logs = np.add.reduceat(np.log10(c1 + 1.0), b.starts)
        known = np.add.reduceat((c1 > 0).astype(np.int64), b.starts)
        # the deleted fold, looked up in the counts without it; -1 stands for the start of a text
        inside = np.repeat(cut, b.sizes)
        left1 = (got["one_all"] - got["one_cut"])[b.one_at]
        left2 = (got["two_all"] - got["two_cut"])[b.two_at]
        context = np.empty_like(left1)
        context[1:] = left1[:-1]
        context[b.starts] = -1
        events = np.stack([context[inside], left2[inside], left1[inside]], axis=1)
        wide, low = np.float64(FINE), np.maximum(events, 1)
        cells = np.stack([np.where(events[:, 0] < 0, -1, np.ceil(np.log2(low[:, 0] + 1.0))), np.where(events[:, 1] > 0, np.rint(wide * (np.log10(low[:, 1] / np.where(events[:, 0] < 0, 1, low[:, 0])))), 10**6), np.where(events[:, 2] > 0, np.rint(wide * np.log10(low[:, 2])), -1)], axis=1).astype(np.int64)
        cells[:, 0] = np.where(events[:, 0] == 0, 0, cells[:, 0])
        bins, times = np.unique(cells, axis=0, return_counts=True)
        hist = np.column_stack([bins, times]).astype("<i8").tobytes()
        m = len(ids)
        kind = U4 if c1.max() < 2**32 else U8
        w1, w2 = c1.astype(kind), c2.astype(kind)
        data = [ids, (~train).tolist(), train.tolist(), b.sizes.tolist(), known.tolist(), logs.tolist(), [w1[s:e].tobytes() for s, e in zip(b.starts, b.ends)], [w2[s:e].tobytes() for s, e in zip(b.starts, b.ends)], [int(sum(told.column("distinct").to_pylist()))] + [0] * (m - 1), [hist] + [None] * (m - 1)]
        return released(pa.table([pa.array(c, k) for c, k in zip(data, kinds)], names=names))

    asked = rows.groupBy("block").applyInArrow(ask, _ASK)
    told = asked.groupBy("bucket").applyInArrow(answer, _TOLD)
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(look, _ROWS)


def learn(bins: np.ndarray, n: int, v: int, starts: int, rounds: int = 40) -> dict[int, tuple[float, float, float]]:
    """bucket -> (l2, l1, l0) by EM; ``bins`` has rows (bucket, bigram bin, unigram bin, times)."""
    out: dict[int, tuple[float, float, float]] = {}
    for bucket in np.unique(bins[:, 0]) if len(bins) else []:
        rows = bins[bins[:, 0] == bucket]
        p2 = np.where(rows[:, 1] == 10**6, 0.0, 10.0 ** (np.where(rows[:, 1] == 10**6, 0, rows[:, 1]) / FINE))
        if bucket == -1:
            p2 = p2 / max(1, starts)
        p1 = np.where(rows[:, 2] < 0, 0.0, 10.0 ** (rows[:, 2] / FINE)) / max(1, n)
        p = np.stack([np.minimum(p2, 1.0), np.minimum(p1, 1.0), np.full(len(rows), 1.0 / (v + 1))])
        times, w = rows[:, 3].astype(float), np.array([0.4, 0.4, 0.2])
        for _ in range(rounds):
            part = w[:, None] * p
            w = (part / part.sum(axis=0) * times).sum(axis=1) / times.sum()
        w = np.maximum(w, 1e-6)  # nothing held out may say never
        out[int(bucket)] = tuple((w / w.sum()).tolist())
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, deleted: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Tokens are the words, A-Z lowered, and one end.  A null or empty text is its end token; a
    null id falls in the fold of the empty text and stays null; repeated rows are counted and
    scored as often as they come; without training rows N and V are 0 and every token is
    unknown; an empty table gives an empty result.  Other columns are not read.
    """
    found = write_table(lookups(docs, id_col, text_col, folds, held, deleted), "lookups")
    cut = F.col("train") & (id_fold("doc_id", folds) == deleted)
    sums = found.agg(F.sum(F.when(F.col("train"), F.col("n_tokens"))).alias("n"), F.sum(F.when(cut, F.col("n_tokens"))).alias("cut"), F.count(F.when(F.col("train"), 1)).alias("docs"), F.count(F.when(cut, 1)).alias("cut_docs"), F.sum("distinct").alias("v")).first()
    n, v, starts = int(sums["n"] or 0), int(sums["v"] or 0), int(sums["docs"])

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                rows = np.frombuffer(raw, "<i8").reshape(-1, 4)
                yield pa.record_batch([pa.array(rows[:, i]) for i in range(4)], names=["b", "p2", "p1", "times"])

    hist = found.filter("hist IS NOT NULL").select("hist").mapInArrow(spread, "b long, p2 long, p1 long, times long").groupBy("b", "p2", "p1").agg(F.sum("times").alias("times"))
    bins = np.array([tuple(r) for r in hist.collect()], dtype=np.int64).reshape(-1, 4)  # buckets x bins x bins at most
    weights = learn(bins, n - int(sums["cut"] or 0), v, starts - int(sums["cut_docs"]))
    usual = weights.get(max(weights, default=0), (0.0, 0.5, 0.5))
    top = max([1, *weights])
    table_of = np.array([weights.get(k) or weights.get(max((x for x in weights if 0 < x < k), default=-2)) or (usual if k else (0.0, 0.5, 0.5)) for k in range(top + 65)])
    first = np.array(weights.get(-1, usual))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw1, raw2, m in zip(b.column("c1").to_pylist(), b.column("c2").to_pylist(), b.column("n_tokens").to_pylist()):
                kind = U4 if len(raw1) == 4 * m else U8
                c1, c2 = np.frombuffer(raw1, kind).astype(float), np.frombuffer(raw2, kind).astype(float)
                context = np.empty(m)
                context[0], context[1:] = starts, c1[:-1]
                bucket = np.where(context > 0, np.ceil(np.log2(np.maximum(context, 1) + 1.0)), 0).astype(int)
                w = table_of[bucket]
                w[0] = first
                p = w[:, 0] * c2 / np.maximum(context, 1) + w[:, 1] * c1 / max(1, n) + w[:, 2] / (v + 1)
                out.append(float(np.log10(p).sum()))
            keep = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(out, pa.float64())], names=[*keep, "score"])

    base = (F.col("base_sum") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score")
    rows = found.select("doc_id", "held_out", "n_tokens", "n_known", base, "c1", "c2")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
