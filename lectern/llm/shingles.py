"""Near duplicates by the Jaccard similarity of shingle sets: candidates by SimHash and MinHash, each link confirmed exactly.

The covering tables of ``simhash`` come first.  Any two texts whose fingerprints over the distinct
shingles differ in three bits or fewer share a bucket there for certain, and meet there alone.
At a similarity of 0.8 some ten bits differ, more than a covering family can
reach, so the minima of 128 multiplicative hashes make 32 bands of four for the rest; two texts
whose fingerprints differ in more bits are candidates if a band is equal.  Such a pair at a similarity of 0.8 shares none
with a probability of (1 - 0.8**4)**32, 5 in 100 million, and a more similar pair with less.  A candidate pair is
linked only if the sets themselves, as 64-bit hashes of the shingles, are similar enough.

Tables and bands are worked alike, the bands with the components that the tables' links made.
In each round a few pivots of a bucket meet its other members, components are formed, and
buckets of one component are done; others lose their pivots, which have met everyone, and go on
with 64 times as many.  So every candidate pair either meets or is already connected.  A large
bucket is dealt in parts, each with all its pivots.
Pairs that meet are first compared by sketches, the parity of the hashes in each of 1024
slots: the bits that differ are never more than the shingles that do, so what this rules out
can't be similar enough.  Only the rest become rows, and the sets decide on them.  Sets are made
from the texts again, for members of open buckets alone: hashes of all shingles are larger than
the texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import write_table
from .common import lower_ascii, map_batches, raw_texts, sorted_groups, words_of
from .components import components
from .simhash import covering_keys, keep_named, majority, shingle_hashes, text_key

BANDS, ROWS, SLOTS = 32, 4, 1024
RADIUS = 3  # bits in which fingerprints of one covering bucket may differ
PART = 512  # members of a bucket that meet its pivots in one task, or four times the pivots
STRIP = 2048  # shingles hashed at once
_random = np.random.default_rng(5)
_ODD = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _random.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _random.integers(0, 2**63, BANDS, dtype=np.uint64)


def shingle_set(raw: bytes | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; of the whole text if it has fewer words, none without a word."""
    words = words_of(lower_ascii(raw or b""))
    return np.unique(np.frombuffer(shingle_hashes(words, width), dtype="<u8")) if words else np.empty(0, dtype="<u8")


def band_keys(grams: np.ndarray) -> np.ndarray:
    """A key for each band; none for an empty set."""
    if not len(grams):
        return np.empty(0, dtype=np.int64)
    low = np.full(len(_ODD), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(grams), STRIP):
        np.minimum(low, (grams[at : at + STRIP, None] * _ODD).min(axis=0), out=low)
    return ((low.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64)


def sketch(grams: np.ndarray) -> bytes:
    """The parity of the number of hashes in each slot."""
    return np.packbits((np.bincount((grams >> np.uint64(54)).astype(np.int64), minlength=SLOTS) & 1).astype(np.uint8)).tobytes()


def _with_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("text_key"))


def _nodes(sets: list[np.ndarray]) -> pa.Array:
    """Equal sets have equal nodes."""
    return pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], dtype=np.uint64).view(np.int64))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, text_key, node, n, fp, bands, sketch) of every row, for the set of its shingles."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in raw_texts(b.column(1))]
        fps = np.array([majority(s.byteswap().tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
        data = [b.column(0), b.column(2), _nodes(sets), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())), pa.array(map(sketch, sets), pa.binary())]
        return pa.record_batch(data, names=["doc_id", "text_key", "node", "n", "fp", "bands", "sketch"])

    return map_batches(_with_text(docs, id_col, text_col), run, "doc_id long, text_key long, node long, n long, fp long, bands array<long>, sketch binary")


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """(node, grams) for the texts whose key is in ``wanted`` (text_key)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in raw_texts(b.column(0))]
        return pa.record_batch([_nodes(sets), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "grams"])

    return map_batches(_with_text(docs, id_col, text_col).join(wanted, "text_key", "left_semi").select("text"), run, "node long, grams binary").dropDuplicates(["node"])


def _meetings(live: DataFrame, share: tuple[int, int], part: int, covered: bool) -> DataFrame:
    """(u, v): pairs of a pivot and another member of its bucket and of another component that sizes and sketches allow,
    with fingerprints within ``RADIUS`` bits if ``covered``, else beyond, as the others met in the covering tables.

    ``live`` has key, node, n, root, pivot, m (members of the bucket), fp and sketch; ``part`` members meet in one task."""
    s, t = share

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(b: pa.RecordBatch) -> list[np.ndarray]:
            bits = np.frombuffer(b"".join(b.column(8).to_pylist()), dtype=np.uint64).reshape(-1, SLOTS // 64)
            return [*(b.column(i).to_numpy(zero_copy_only=False) for i in range(8)), bits]

        for _, _, node, n, root, pivot, home, fp, bits in sorted_groups(batches, arrays, lambda x: x[:2]):
            for p in np.flatnonzero(pivot):
                at = np.flatnonzero(home & (root != root[p]) & ~(pivot & (node <= node[p])) & (t * np.minimum(n, n[p]) >= s * np.maximum(n, n[p])))
                at = at[(np.bitwise_count((fp[at] ^ fp[p]).view(np.uint64)) <= RADIUS) == covered]
                apart = np.bitwise_count(bits[at] ^ bits[p]).sum(axis=1, dtype=np.int64)
                at = at[(t + s) * apart <= (t - s) * (n[at] + n[p])]
                if len(at):
                    yield pa.record_batch([pa.array(np.minimum(node[at], node[p])), pa.array(np.maximum(node[at], node[p]))], names=["u", "v"])

    parts = F.ceil(F.col("m") / part).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    # a pivot goes to every part of its bucket, and is met as a member in its own
    rows = live.withColumn("own", own).withColumn("part", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array("own"))))
    dealt = rows.select("key", "part", "node", "n", "root", "pivot", (F.col("own") == F.col("part")).alias("home"), "fp", "sketch")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(run, "u long, v long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The rows (u, v) of ``pairs`` whose sets have a Jaccard similarity of ``share`` or more."""
    of = lambda node, grams: sets.select(F.col("node").alias(node), F.col("grams").alias(grams))
    both = pairs.join(of("u", "a"), "u").join(of("v", "b"), "v").select("u", "v", "a", "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(s.as_buffer(), dtype="<u8") for s in (x, y))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(share[1] * common >= share[0] * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def _open(members: DataFrame, roots: DataFrame, pivots: int) -> DataFrame:
    """(key, node, n, root, m, pivot) of the members of buckets that hold more than one component; some ``pivots`` of each bucket are so marked."""
    named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_key = named.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("lo"), F.min("root").alias("r"), F.max("root").alias("s"))
    open_ = write_table(of_key.filter("r <> s").select("key", "m", "lo"), "open")
    # nodes are hashes: about as many as asked for lie in the lowest part of their range
    pivot = (F.col("node") == F.col("lo")) | (F.col("node") / 2.0**64 + 0.5 < pivots / F.col("m"))
    return write_table(named.join(open_, "key").select("key", "node", "n", "root", "m", pivot.alias("pivot")), "live")


def similar_links(docs: DataFrame, rows: DataFrame, share: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame | None:
    """(u, v): links that connect what all candidate pairs as similar as ``share`` would connect; None without candidates.

    ``rows`` are the :func:`signatures` of ``docs``."""
    classes = write_table(rows.groupBy("node").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("text_key").alias("text_key"), F.min("sketch").alias("sketch"), F.min("bands").alias("bands")), "classes")
    marks = classes.select("node", "fp", "sketch")
    sets = links = None
    roots = classes.select("node", F.col("node").alias("root")).limit(0)
    for keys, covered in ((covering_keys("fp", RADIUS), True), (F.col("bands"), False)):
        members, pivots = classes.select("node", "n", F.explode(keys).alias("key")), 1
        while not (live := _open(members, roots, pivots)).isEmpty():
            if pivots == 1:
                nodes = live.select("node").distinct()
                lacking = classes.select("node", "text_key").join(nodes if sets is None else nodes.join(sets, "node", "left_anti"), "node")
                found = write_table(_sets(docs, id_col, text_col, width, lacking.select("text_key")), "sets")
                sets = found if sets is None else sets.unionAll(found)
            met = _meetings(live.join(marks, "node"), share, max(PART, 4 * pivots), covered)
            links = write_table(_confirmed(met, sets, share).unionAll(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), "similar")
            roots = components(links)
            members, pivots = live.filter("NOT pivot").select("node", "n", "key"), pivots * 64
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """(doc_id, component_id, text_key) for each row of ``docs``: rows are linked if the sets of their shingles
    of ``width`` words have a Jaccard similarity of ``share`` (a fraction) or more.

    ``component_id`` is the smallest id reachable over links.  Null and empty texts have equal,
    empty sets and are linked; texts of fewer words than a shingle are one shingle; rows with a
    null id count in a component but don't name it (null if it has no other); repeated rows are
    returned as often as they come; an empty table gives an empty result.
    """
    rows = write_table(signatures(docs, id_col, text_col, width), "signatures")
    links = similar_links(docs, rows, share, id_col, text_col, width)
    classes = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    if links is None:
        named = classes.select("node", F.col("least").alias("component_id"))
    else:
        of = write_table(classes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
        named = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return rows.select("doc_id", "node", "text_key").join(write_table(named, "named"), "node").select("doc_id", "component_id", "text_key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that name their component, as :func:`simhash.keep_named` takes them."""
    return keep_named(docs, near_duplicates(docs, id_col, text_col, **how), id_col, text_col)
