"""Shared pieces: tables, hashes of ids, word splitting, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null id: as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def words_of(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes: bytes.split() cuts at exactly those six."""
    return raw.split()


def lower_ascii(raw: bytes) -> bytes:
    """A-Z to a-z; bytes.lower() leaves every other byte alone."""
    return raw.lower()


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def released(out):
    """``out``, with memory that was freed given back to the system: workers live on and are reused."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)
    return out


@lru_cache(maxsize=1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with one output batch for each input batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is not None:
                    yield out
        released(None)

    return df.mapInArrow(run, schema)


def sorted_groups(batches: Iterable[pa.RecordBatch], arrays: Callable[[pa.RecordBatch], list[np.ndarray]], keys: Callable[[list[np.ndarray]], list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """The arrays of each group of two rows or more, of a stream sorted by its keys.  One group is held at a time."""
    held: list[list[np.ndarray]] = []
    last = None

    def ended() -> Iterator[list[np.ndarray]]:
        if sum(len(x[0]) for x in held) > 1:
            yield [np.concatenate(x) for x in zip(*held)] if len(held) > 1 else held[0]

    for b in batches:
        if not b.num_rows:
            continue
        now = arrays(b)
        ks = keys(now)
        change = np.zeros(b.num_rows - 1, bool)
        for k in ks:
            change |= k[1:] != k[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change) + 1, [b.num_rows]])
        if tuple(k[0] for k in ks) != last:
            yield from ended()
            held = []
        held.append([x[: edges[1]] for x in now])
        if len(edges) > 2:
            yield from ended()
            for a, z in zip(edges[1:-2], edges[2:-1]):
                if z - a > 1:
                    yield [x[a:z] for x in now]
            held = [[x[edges[-2] :] for x in now]]
        last = tuple(k[-1] for k in ks)
    yield from ended()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_groups(rows: DataFrame, groups: DataFrame, key: list[str], spread: Column, total: int, width: int) -> DataFrame:
    """``rows`` left-joined to their group: a row of ``groups`` (the key, ``n`` rows in it, ``keep``).

    A group of more than a quarter of a task's fair share of ``total`` rows, of which there are ``4 * width``
    at most, is broadcast.  Its rows go to the other join under keys of their own made from ``spread``, which meet
    nothing: a third of all rows in one group is spread like any other rows.
    """
    hot = F.col("n") > max(1, total // (4 * width))
    big = F.broadcast(groups.filter(hot).withColumnsRenamed({"n": "big_n", "keep": "big_keep"}))
    rest = groups.filter(~hot)
    first = key[0]
    kind = rows.schema[first].dataType
    own = F.concat(F.lit("#"), spread.cast("string")).cast(kind)
    found = rows.join(big, key, "left").withColumn("own", F.col(first)).withColumn(first, F.when(F.col("big_n").isNull(), F.col(first)).otherwise(own))
    found = found.join(rest, key, "left").withColumn(first, F.col("own"))
    return found.withColumns({"n": F.coalesce("big_n", "n"), "keep": F.coalesce("big_keep", "keep")}).drop("big_n", "big_keep", "own")
