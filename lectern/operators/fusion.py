"""Hybrid search: weighted reciprocal-rank fusion of the two candidate lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class EmbeddingRequired(ValueError):
    """The mode needs a query vector."""


@dataclass(frozen=True)
class SearchOptions:
    mode: str = "hybrid"  # hybrid, exact (text alone) or similar (vectors alone)
    limit: int = 10
    vector_weight: float = 0.7
    text_weight: float = 0.3
    rank_constant: int = 60
    heading_step: float = 0.0025

    @property
    def budget(self) -> int:
        """Candidates fetched from each side."""
        return min(3 * self.limit, 1000)


def heading_boost(level: Column | str, step: float = 0.0025) -> Column:
    """1 + (6 - level) * step for levels 1 to 5, else 1: higher headings break near-ties."""
    level = F.col(level) if isinstance(level, str) else level
    return F.when(level.between(1, 5), 1 + (6 - level) * F.lit(step)).otherwise(F.lit(1.0))


def ranked(candidates: DataFrame, by: Column, name: str) -> DataFrame:
    """Competition rank, by the 32-bit value, over at most a thousand candidates."""
    return candidates.withColumn(name, F.rank().over(Window.orderBy(by)))


def fuse(text: DataFrame | None, vectors: DataFrame | None, levels: DataFrame, options: SearchOptions) -> DataFrame:
    """(id, score, text_score, vector_score) from (id, score) and (id, distance), best first.

    A side that lacks a candidate adds nothing for it; ``levels`` is (id, heading_level), looked up
    by the candidates alone.
    """
    if vectors is None and options.mode != "exact":
        raise EmbeddingRequired(options.mode)
    t = None if text is None or options.mode == "similar" else ranked(text.select("id", F.col("score").alias("text_score")), F.desc(F.col("text_score").cast("float")), "text_rank")
    v = None if vectors is None or options.mode == "exact" else ranked(vectors.select("id", F.col("distance").alias("vector_score")), F.asc(F.col("vector_score").cast("float")), "vector_rank")
    none = F.lit(None)
    if t is None:
        both = v.withColumns({"text_rank": none.cast("int"), "text_score": none.cast("double")})
    elif v is None:
        both = t.withColumns({"vector_rank": none.cast("int"), "vector_score": none.cast("double")})
    else:
        both = t.join(v, "id", "full_outer")
    part = lambda rank, weight: F.coalesce(F.lit(weight) / (options.rank_constant + F.col(rank)), F.lit(0.0))
    score = part("vector_rank", options.vector_weight) + part("text_rank", options.text_weight)
    if options.mode != "similar":
        found = levels.join(F.broadcast(both.select("id")), "id", "left_semi").select("id", "heading_level")  # 2000 rows at most
        both = both.join(found, "id", "left")
        score = score * F.coalesce(heading_boost("heading_level", options.heading_step), F.lit(1.0))
    return both.select("id", score.alias("score"), "text_score", "vector_score").orderBy(F.desc("score"), "id")


def resolve(fused: DataFrame, chunks: DataFrame, documents: DataFrame, options: SearchOptions, format_filter: str | None = None) -> DataFrame:
    """Candidates with their chunk and document.  The format filter stands after the candidate
    limit, so it can leave fewer than ``limit`` rows; candidates without chunk or document go."""
    few = F.broadcast(fused)  # 2000 rows at most
    found = chunks.withColumnRenamed("id", "chunk_id").join(few.withColumnRenamed("id", "chunk_id"), "chunk_id")
    docs = documents.select(F.col("id").alias("document_id"), "path", "title", "format")
    found = docs.join(F.broadcast(found), "document_id")
    if format_filter:
        found = found.filter(F.col("format") == format_filter)
    return found.orderBy(F.desc("score"), "chunk_id").limit(options.limit)
