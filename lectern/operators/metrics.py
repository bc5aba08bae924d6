"""Quality of an extraction against a reference: recall of words, order of shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_tokens
from .lexical import in_a_row

BROADCAST_ROWS = 500_000  # hashes with their passage's id: 8 MB


def shingles(tokens: Column, width: int) -> Column:
    """The distinct runs of ``width`` tokens, joined by spaces."""
    rows = F.filter(in_a_row(tokens, width), lambda s: s[str(width - 1)].isNotNull())
    return F.array_distinct(F.transform(rows, lambda s: F.concat_ws(" ", *(s[str(k)] for k in range(width)))))


def shingle_hashes(tokens: Column, width: int) -> Column:
    """A 64-bit hash of each run of ``width`` tokens, and of the shorter runs at the end."""
    return F.transform(in_a_row(tokens, width), lambda s: F.xxhash64(s))


def share_found(wanted: Column, found: Column) -> Column:
    """The share of ``wanted``'s distinct values in ``found``; null if there are none."""
    wanted = F.array_distinct(wanted)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, found)) / F.size(wanted))


def extraction_quality(pairs: DataFrame, got_col: str, wanted_col: str, width: int = 4) -> DataFrame:
    """Adds ``word_recall`` and ``shingle_order`` to pairs of extracted and reference texts."""
    got, wanted = search_tokens(got_col), search_tokens(wanted_col)
    return pairs.withColumns({"word_recall": share_found(wanted, got), "shingle_order": share_found(shingles(wanted, width), shingles(got, width))})


def overlap(rows: DataFrame, passages: DataFrame, id_col: str, item_col: str, width: int = 5, text_col: str = "text") -> DataFrame:
    """(id, item, shared, share): passages that share shingles with rows.

    Pairs are found by an equi-join on the shingles' hashes and counted on the shingles themselves.  The
    passages' hashes are broadcast if they are ``BROADCAST_ROWS`` at most, so that no row's shingles travel;
    more are joined by a shuffle."""
    a = rows.select(F.col(id_col).alias("id"), F.explode(shingle_hashes(search_tokens(text_col), width)).alias("s"))
    p = passages.select(F.col(item_col).alias("item"), F.col(text_col).alias("passage"))
    b = p.select("item", F.explode(shingle_hashes(search_tokens("passage"), width)).alias("s"))
    b = F.broadcast(b) if b.count() <= BROADCAST_ROWS else b
    pairs = a.join(b, "s").select("id", "item").distinct()
    both = pairs.join(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id").join(p, "item")
    both = both.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id", "item")  # few bytes, much work: not one task
    counted = both.select("id", "item", shingles(search_tokens("text"), width).alias("x"), shingles(search_tokens("passage"), width).alias("y"))
    counted = counted.select("id", "item", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"), F.size("y").alias("of"))
    return counted.filter("shared > 0").select("id", "item", "shared", (F.col("shared") / F.col("of")).alias("share"))
