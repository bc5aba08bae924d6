"""SimHash near-dedup by covering locality-sensitive hashing.

A covering family has 2**(r+1) - 2 tables for the radius r.  Every bit position i gets a
non-zero vector phi(i) of r+1 bits; table v reads the positions with <phi(i), v> = 1.  Any
r positions span at most r of the r+1 dimensions, so some v != 0 is orthogonal to all of
them: that table reads none of the differing bits and the pair collides in it for certain.
No pair within the radius is missed, whatever the data.

Only distinct fingerprints enter the tables, so copies cost nothing.  A bucket yields a
spanning forest of its links, at most one row for each fingerprint, instead of its pairs.
The members of a bucket agree on the 32 bits its table reads; one of more than ``WHOLE`` is dealt
again by a second covering family over the 32 bits left, whose tables read 16 of them.  No pair
is lost by that either, and a part holds at most 65,536 fingerprints, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import write_table
from .common import lower_ascii, map_batches, raw_texts, sorted_groups, table, words_of
from .components import components

BITS = 64
STRIP = 64  # fingerprints compared with all others at once
WHOLE = 20_000  # a bucket above this is dealt again before any comparison


def covering_masks(radius: int) -> list[int]:
    """The 64-bit masks of the family's tables, each of 32 bits.

    phi(i) is a one followed by the low ``radius`` bits of i, so the tables' masks are the words of a
    first-order Reed-Muller code: all weigh 32 but the one of all ones, which no differing
    position is orthogonal to and which is left out.
    """
    if not 1 <= radius <= 6:
        raise ValueError("the radius is 1 to 6: 64 positions have no balanced family beyond")
    return _family(range(BITS), radius)


def _family(positions: Sequence[int], radius: int) -> list[int]:
    top = 1 << radius
    return [sum(1 << p for i, p in enumerate(positions) if bin((top | i % top) & v).count("1") % 2) for v in range(1, 2 * top) if v != top]


def finer_masks(mask: int, radius: int) -> list[int]:
    """Masks that read ``mask`` and half of the positions it leaves: any pair within the radius that agrees on
    ``mask`` agrees on one of them.  Beyond a radius of 5 the positions left have no balanced family."""
    return [mask | m for m in _family([i for i in range(BITS) if not mask >> i & 1], radius)] if radius < 6 else [mask]


def covering_keys(fp: str, radius: int = 3) -> Column:
    """The keys of a fingerprint's buckets, one for each covering table: fingerprints within the radius share one for certain."""
    return F.array(*(F.xxhash64(F.lit(t), F.col(fp).bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m))) for t, m in enumerate(covering_masks(radius))))


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> bytes:
    """Eight bytes for each shingle of ``width`` words, or for all words if they are fewer."""
    text = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return digest(text, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    return b"".join([digest(text[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[width - 1 :].tolist())])


def fingerprint(raw: bytes | None, width: int = 3, seed: int = 42, distinct: bool = False) -> int:
    """Majority of the bits of all shingle hashes; zero where there is no word.

    ``distinct`` counts a repeated word once (for width 1)."""
    words = words_of(lower_ascii(raw or b""))
    if distinct:
        words = list(dict.fromkeys(words))
    if not words:
        return 0
    return majority(shingle_hashes(words, width, seed))


def majority(hashes: bytes) -> int:
    """The bits set in over half of the hashes, eight big-endian bytes each."""
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    total, count = np.zeros(BITS, dtype=np.int64), len(rows)
    for at in range(0, count, 8192):
        total += np.unpackbits(rows[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, verify_width: int | None = None) -> DataFrame:
    """(doc_id, fp long, second long, text_key long: a hash of the text) of every row.

    Without ``verify_width`` fp is over shingles of ``width`` words and second is 0; with it fp
    is over the distinct words and second over shingles of ``verify_width`` words.  A null, empty
    or blank text has fingerprint zero; a null id stays null; texts of fewer words than a
    shingle are hashed whole."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw_texts(b.column(1))
        if verify_width is None:
            one, two = [fingerprint(t, width) for t in texts], [0] * len(texts)
        else:
            one, two = [fingerprint(t, 1, distinct=True) for t in texts], [fingerprint(t, verify_width) for t in texts]
        longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (one, two)]
        return pa.record_batch([b.column(0), *longs, b.column(2)], names=["doc_id", "fp", "second", "text_key"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("text_key"))
    return map_batches(rows, run, "doc_id long, fp long, second long, text_key long")


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def _links(x: np.ndarray, y: np.ndarray, radius: int, second_radius: int) -> list[tuple[int, int]]:
    """A link from each place to one that reached it, breadth first; each place is compared
    only with those not reached yet, so a dense group costs little more than its size."""
    left, out = np.arange(len(x)), []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:STRIP], front[STRIP:]
            near = np.bitwise_count(x[now, None] ^ x[None, left]) <= radius
            if second_radius < BITS:
                near &= np.bitwise_count(y[now, None] ^ y[None, left]) <= second_radius
            hit = near.any(axis=0)
            if hit.any():
                new = left[hit]
                out += zip(now[near[:, hit].argmax(axis=0)].tolist(), new.tolist())
                front, left = np.concatenate([front, new]), left[~hit]
    return out


def near_links(nodes: DataFrame, radius: int = 3, second_radius: int = BITS) -> DataFrame:
    """(fu, su, fv, sv): links among the distinct pairs (fp, second) of ``nodes`` that connect exactly
    what a comparison of all pairs would connect."""
    coarse = covering_masks(radius)
    finer = [finer_masks(m, radius) for m in coarse]
    masks = [*coarse, *(m for ms in finer for m in ms)]  # table t, or the parts of its large buckets
    signed = F.array(*(F.lit(m - 2**64 if m >= 2**63 else m) for m in masks))
    key = F.col("fp").bitwiseAND(F.element_at(signed, F.col("t") + 1))
    each = len(finer[0])

    def dealt(rows: DataFrame, tables: Column) -> DataFrame:
        return rows.select("fp", "second", F.explode(tables).alias("t")).withColumn("key", key)

    rows = dealt(nodes, F.sequence(F.lit(0), F.lit(len(coarse) - 1)))
    large = write_table(rows.groupBy("t", "key").agg(F.count("*").alias("m")).filter(F.col("m") > WHOLE).select("t", "key"), "large")
    first = len(coarse) + F.col("t") * each
    rows = rows.join(large, ["t", "key"], "left_anti").unionByName(dealt(rows.join(large, ["t", "key"], "left_semi"), F.sequence(first, first + each - 1)))
    names, masked = ["fu", "su", "fv", "sv"], np.array(masks, dtype=np.uint64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = lambda b: [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        for fp, second, _ in sorted_groups(batches, arrays, lambda x: [x[2], x[0].view(np.uint64) & masked[x[2]]]):
            if found := _links(fp.view(np.uint64), second.view(np.uint64), radius, second_radius):
                at = np.array(found)
                yield pa.record_batch([pa.array(x[at[:, k]]) for k in (0, 1) for x in (fp, second)], names=names)

    met = rows.repartition("t", "key").sortWithinPartitions("t", "key", "fp", "second").select("fp", "second", "t")
    return met.mapInArrow(run, "fu long, su long, fv long, sv long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3, verify_width: int | None = None, verify_radius: int = 12) -> DataFrame:
    """(doc_id, fp, component_id, text_key) for each row of ``docs``.

    Rows are linked if their fingerprints over shingles of ``width`` words differ in at most
    ``radius`` bits.  With ``verify_width`` they are linked if the fingerprints over their
    distinct words differ in at most ``radius`` bits and those over shingles of ``verify_width``
    words in at most ``verify_radius``: single words move far less under an edit than long shingles
    do, so a small covering family finds edited copies, and the second fingerprint tells them
    from texts that merely share their common words.

    ``component_id`` is the smallest id reachable over links.  Null and empty texts share
    fingerprint zero and are linked like any other; rows with a null id count in a component
    but don't name it (null if it has no other); repeated rows are returned as often as they
    come; an empty table gives an empty result.
    """
    fps = fingerprints(docs, id_col, text_col, width, verify_width)
    node = (lambda fp, second: F.col(fp)) if verify_width is None else (lambda fp, second: F.xxhash64(fp, second))
    fps = write_table(fps.withColumn("node", node("fp", "second")), "fingerprints")
    classes = write_table(fps.groupBy("fp", "second").agg(F.min("doc_id").alias("least")), "classes")
    links = near_links(classes, radius, BITS if verify_width is None else verify_radius)
    roots = components(links.select(node("fu", "su").alias("u"), node("fv", "sv").alias("v")))
    of = classes.select(node("fp", "second").alias("node"), "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = write_table(of, "roots")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = write_table(of.join(least, "root").select("node", "component_id"), "named")
    return fps.join(named, "node").select("doc_id", "fp", "component_id", "text_key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that name their component: one document of each near-duplicate group.

    Of rows that share the naming id all in its component stay, as do rows with a null id in a component
    without any id.  ``how`` goes to :func:`near_duplicates`.
    """
    return keep_named(docs, near_duplicates(docs, id_col, text_col, **how), id_col, text_col)


def keep_named(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its own component in ``found`` (doc_id, component_id, text_key)."""
    none = F.lit(-(2**63)).cast("long")
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", none).alias("id"), F.col("text_key").alias("of")).distinct()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(id_col).cast("long"), none).alias("id"), text_key(text_col).alias("of"))
    return whole.join(gone, ["id", "of"], "left_anti").select("row.*")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
