"""Exact nearest neighbours over an array column.  Distances are folded in the JVM, and the
k best of each task are merged (TakeOrderedAndProject): no vector is moved but the k best's ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _vector(v: list[float] | Column) -> Column:
    return v if isinstance(v, Column) else F.array(*(F.lit(float(x)) for x in v))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: list[float] | Column) -> Column:
    return _sum(F.zip_with(a, _vector(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2_distance(a: Column, b: list[float] | Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, _vector(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine_distance(a: Column, b: list[float] | Column) -> Column:
    """1 less the cosine; null for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(_vector(b), _vector(b)))
    return F.when(norms > 0, 1 - dot(a, b) / norms)


METRICS = {"l2": l2_distance, "cosine": cosine_distance}


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "chunk_id", vector_col: str = "embedding", metric: str = "l2") -> DataFrame:
    """(id, distance) of the ``k`` nearest, nearest first; equal distances by id.

    Rows whose vector is null or has another dimension are left out.
    """
    near = vectors.filter(F.size(vector_col) == len(query)).select(F.col(id_col).alias("id"), METRICS[metric](F.col(vector_col), query).alias("distance"))
    return near.filter(F.col("distance").isNotNull()).orderBy("distance", "id").limit(k)


def nearest_per_group(vectors: DataFrame, query: list[float], k: int, group_col: str, id_col: str = "chunk_id", vector_col: str = "embedding", metric: str = "l2") -> DataFrame:
    """(group, id, distance, rank): the ``k`` nearest of each group, by competition rank.  The limit is pushed below the exchange."""
    near = vectors.filter(F.size(vector_col) == len(query)).select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), METRICS[metric](F.col(vector_col), query).alias("distance"))
    return near.withColumn("rank", F.rank().over(Window.partitionBy("group").orderBy("distance", "id"))).filter(F.col("rank") <= k)
