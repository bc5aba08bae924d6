"""Exact dedup: tree-merge of sorted digest runs.

Every partition turns its texts into a run of digests sorted by key.  The runs are then
exchanged in rounds over a hypercube of ``fan_in ** rounds`` partitions: in round k the
partitions whose numbers differ in digit k alone trade the parts of their runs, so that
each of them keeps the digests with its own digit k.  After an exchange the parts are
merged in order and equal digests collapse to one row that retains the smallest (or
largest) identifier and the number of rows.  A group that holds a third of all rows is
one row for each partition after the first run and at most ``fan_in`` rows for each merge,
so no task ever gathers it; its answer goes back to its rows by broadcast, those of smaller
groups by a join.

A digest is verified at every level: rows collapse only if SHA-256, byte length and an
independent 64-bit hash all agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import write_table
from .common import partitions, table, with_groups

KEY = ["digest", "bytes", "check"]
_RUN = "digest binary, bytes long, check long, keep long, n long"


def merge_sorted(batches: Iterable[pa.RecordBatch], largest: bool) -> Iterator[pa.RecordBatch]:
    """Collapse equal keys of a sorted stream; memory is one batch and one open row."""
    best = np.maximum if largest else np.minimum
    open_row: tuple | None = None
    schema = pa.schema([("digest", pa.binary()), ("bytes", pa.int64()), ("check", pa.int64()), ("keep", pa.int64()), ("n", pa.int64())])
    for b in batches:
        if not b.num_rows:
            continue
        digest = b.column(0).to_pylist()
        size, check, keep, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
        if open_row is not None:
            digest.insert(0, open_row[0])
            size, check, keep, n = (np.concatenate([[o], a]) for o, a in zip(open_row[1:], (size, check, keep, n)))
        d = np.frombuffer(b"".join(digest), dtype="<u8").reshape(-1, 4)
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]).any(axis=1) | (size[1:] != size[:-1]) | (check[1:] != check[:-1])
        at = np.flatnonzero(new)
        keep, n = best.reduceat(keep, at), np.add.reduceat(n, at)
        size, check = size[at], check[at]
        digest = [digest[i] for i in at]
        open_row = (digest[-1], size[-1], check[-1], keep[-1], n[-1])
        if len(at) > 1:
            yield pa.record_batch([pa.array(digest[:-1], pa.binary()), *(pa.array(x[:-1].astype("i8")) for x in (size, check, keep, n))], schema=schema)
    if open_row is not None:
        yield pa.record_batch([pa.array([open_row[0]], pa.binary()), *(pa.array([int(x)], pa.int64()) for x in open_row[1:])], schema=schema)


def tree_merge(rows: DataFrame, width: int, fan_in: int = 8, largest: bool = False) -> DataFrame:
    """(digest, bytes, check, keep, n) with one row for each key, over at least ``width`` partitions."""
    rounds = 1
    while fan_in**rounds < width:
        rounds += 1
    width = fan_in**rounds

    def merged(df: DataFrame) -> DataFrame:
        return df.sortWithinPartitions(*KEY).mapInArrow(lambda it: merge_sorted(it, largest), _RUN)

    runs = merged(rows)
    home = F.pmod(F.col("check"), F.lit(width)).cast("int")
    for k in range(rounds):
        low = fan_in ** (k + 1)  # digits 0 to k come from the key, the others from where the row is
        at = F.pmod(F.spark_partition_id(), F.lit(width))
        to = (F.pmod(home, F.lit(low)) + F.floor(at / low) * low).cast("int")
        runs = merged(runs.withColumn("to", to).repartitionById(width, F.col("to")).drop("to"))
    return runs


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 8) -> DataFrame:
    """One row for each input row: its group of equal texts and whether it stays.

    Returns ``doc_id, keep_id, group_size, kept, digest`` (SHA-256, binary).  A null text is
    the empty text; all empty texts are one group.  A null id ranks behind every other
    id, so such a row stays only if its whole group has none, and then ``keep_id`` is null.
    Rows that repeat both id and text are indistinguishable: one of them stays.  An empty
    table gives an empty result; columns besides the two named ones are not read.
    Ids are integers other than the two ends of the 64-bit range.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    largest = keep == "largest"
    none = F.lit(-(2**63) if largest else 2**63 - 1).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.xxhash64(text).alias("check"),
        F.coalesce(F.col(id_col).cast("long"), none).alias("id"),
    )
    rows = write_table(rows, "digests")  # the texts are hashed once
    runs = rows.select(*KEY, F.col("id").alias("keep"), F.lit(1).cast("long").alias("n"))
    width = partitions(docs.sparkSession)
    groups = write_table(tree_merge(runs, width, fan_in, largest).filter("n > 1"), "digest-groups")
    seen = rows.groupBy(*KEY, "id").agg(F.count("*").alias("copies"))
    out = with_groups(seen, groups, KEY, F.col("id"), rows.count(), width).withColumn("keep", F.coalesce("keep", "id"))
    thousand = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 1000)))
    out = out.withColumn("thousand", thousand).withColumn("copy", F.explode(F.sequence(F.col("thousand") * 1000 + 1, F.least("copies", F.col("thousand") * 1000 + 1000))))
    return out.select(
        F.nullif(F.col("id"), none).alias("doc_id"),
        F.nullif(F.col("keep"), none).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        ((F.col("id") == F.col("keep")) & (F.col("copy") == 1)).alias("kept"),
        "digest",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that :func:`duplicate_groups` keeps, with all their columns."""
    kept = duplicate_groups(docs, id_col, text_col, keep).filter("kept").select(F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    known = F.coalesce(F.col("id"), F.lit(-(2**63)).cast("long"))
    left = whole.select("row", known.alias("id"), "digest")
    right = kept.select(F.coalesce("k_id", F.lit(-(2**63)).cast("long")).alias("id"), F.col("k_digest").alias("digest"))
    one = left.join(right, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    return one.select("row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the largest id among equal texts."""
    out = duplicate_groups(table(spark, sf_dir, "documents"), keep="largest")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
