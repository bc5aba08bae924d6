"""Incremental change: what to index anew, what to remove, what to defer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import sum_before


def changes(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """``incoming`` (path, content_hash, ...) with ``action``: new, changed or unchanged."""
    known = documents.select("path", F.col("content_hash").alias("_known"))
    action = F.when(F.col("_known").isNull(), "new").when(F.col("_known") != F.col("content_hash"), "changed").otherwise("unchanged")
    return incoming.join(known, "path", "left").withColumn("action", action).drop("_known")


def without_documents(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``table`` less the rows whose ``key`` is in ``gone``."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def cascade(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the documents at ``paths`` and what hangs on them."""
    gone = documents.join(paths.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("document_id"))
    kept_chunks = chunks.join(gone, "document_id", "left_anti")
    gone_chunks = chunks.join(gone, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return documents.join(paths.select("path"), "path", "left_anti"), kept_chunks, vectors.join(gone_chunks, "chunk_id", "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an upsert as a read.  A maximum by a struct, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*").select(*rows.columns)


def put_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and those of ``rows`` whose keys it lacks."""
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti"))


def deferred_documents(chunks: DataFrame, failed_batches: DataFrame, batch: int = 256) -> DataFrame:
    """Documents with a chunk in a failed batch.

    Chunks are numbered over all documents in (document_id, chunk_index) order, ``batch`` to a
    batch.  ``chunks`` has chunk counts by document; the running total gives each document an
    interval of chunk numbers, and a document is deferred if that overlaps a failed batch's.
    """
    spans = sum_before(chunks.groupBy("document_id").agg(F.count("*").alias("n")), "document_id", F.col("n"), "first")
    touched = spans.select("document_id", F.explode(F.sequence(F.floor(F.col("first") / batch), F.floor((F.col("first") + F.col("n") - 1) / batch))).alias("batch"))
    return touched.join(failed_batches.select("batch").distinct(), "batch", "left_semi").select("document_id").distinct()
