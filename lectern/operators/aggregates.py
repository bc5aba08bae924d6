"""Aggregations and window shapes of document analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import write_table


def corpus_stats(documents: DataFrame, chunks: DataFrame, when_col: str = "indexed_at") -> DataFrame:
    """One row: documents, chunks, the latest time of indexing (0 if there is none)."""
    a = documents.agg(F.count("*").alias("documents"), F.coalesce(F.max(when_col), F.lit(0)).cast("long").alias("last_indexed"))
    return a.join(chunks.agg(F.count("*").alias("chunks")))


def outcome_tally(rows: DataFrame, outcome_col: str, outcomes: tuple[str, ...] = ("indexed", "skipped", "errors", "deferred")) -> DataFrame:
    """One row with a count for each outcome, zeros included."""
    return rows.agg(*(F.count(F.when(F.col(outcome_col) == o, 1)).alias(o) for o in outcomes))


def weighted_mode(rows: DataFrame, group_cols: list[str], value: Column, weight: Column) -> DataFrame:
    """For each group the value with the largest sum of weights; of equals the smallest value."""
    sums = rows.select(*group_cols, value.alias("value"), weight.alias("w")).groupBy(*group_cols, "value").agg(F.sum("w").alias("weight"))
    best = F.max_by(F.struct("value", "weight"), F.struct("weight", (-F.col("value")).alias("small")))
    return sums.groupBy(*group_cols).agg(best.alias("b")).select(*group_cols, F.col("b.value").alias("value"), F.col("b.weight").alias("weight"))


def modal_gap(rows: DataFrame, group_cols: list[str], order_cols: list[str], value_col: str, least: float, most: float, needed: int = 4) -> DataFrame:
    """The commonest rounded step from one row to the next within [least, most]; null below ``needed`` steps."""
    step = F.col(value_col) - F.lag(value_col).over(Window.partitionBy(*group_cols).orderBy(*order_cols))
    gaps = rows.select(*group_cols, F.abs(step).alias("gap")).filter(F.col("gap").between(least, most))
    counted = gaps.groupBy(*group_cols, F.floor(F.col("gap") + 0.5).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    found = counted.groupBy(*group_cols).agg(F.max_by("bucket", F.struct("n", (-F.col("bucket")).alias("small"))).alias("gap"), F.sum("n").alias("samples"))
    return found.select(*group_cols, F.when(F.col("samples") >= needed, F.col("gap")).alias("gap"), "samples")


def level_by_size(rows: DataFrame, group_cols: list[str], size: Column, threshold: Column) -> DataFrame:
    """Distinct sizes from the threshold up, largest first, as levels from 1."""
    sizes = rows.filter(size >= threshold).select(*group_cols, size.alias("size")).distinct()
    return sizes.withColumn("level", F.dense_rank().over(Window.partitionBy(*group_cols).orderBy(F.desc("size"))))


def coverage(rows: DataFrame, group_cols: list[str], low: Column, high: Column, bins: int) -> DataFrame:
    """How many of the intervals [low, high] touch each of ``bins`` equal bins of [0, 1)."""
    clip = lambda x: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(x * bins))).cast("int")
    return rows.select(*group_cols, F.explode(F.sequence(clip(low), clip(high))).alias("bin")).groupBy(*group_cols, "bin").agg(F.count("*").alias("n"))


def sum_before(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows that come earlier by ``order``, whose values differ.

    Rows are dealt in ranges and summed within each; one row a range then gives where it begins, so no task
    sees the whole table.  The ranges are written first, for a range dealt again would cut elsewhere.
    """
    dealt = write_table(rows.withColumn("_v", value.cast("long")).repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    begins = dealt.groupBy("_range").agg(F.sum("_v").alias("_v")).select("_range", F.coalesce(F.sum("_v").over(earlier(Window.orderBy("_range"))), F.lit(0)).alias("_from"))
    inner = F.coalesce(F.sum("_v").over(earlier(Window.partitionBy("_range").orderBy(order))), F.lit(0))
    return dealt.withColumn(name, inner).join(F.broadcast(begins), "_range").withColumn(name, F.col(name) + F.col("_from")).drop("_range", "_v", "_from")


def as_of(rows: DataFrame, ranges: DataFrame, at: str, start: str, keep: list[str]) -> DataFrame:
    """``rows`` with the columns ``keep`` of the last range that starts at or before them.

    Both sides are put in one order and the last range is carried forward: a sort, not a join of
    every row with every range.  For few rows in one partition, e.g. a document's page labels.
    """
    a = rows.select(F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct("*").alias("_row"), *(F.lit(None).cast(ranges.schema[k].dataType).alias(k) for k in [start, *keep]))
    b = ranges.select(F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *(F.col(k) for k in [start, *keep]))
    before = Window.orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_kind") == 0, F.struct(start, *keep)), ignorenulls=True).over(before)
    out = a.unionByName(b).withColumn("_last", last).filter("_kind = 1")
    return out.select("_row.*", *(F.col(f"_last.{k}").alias(k) for k in [start, *keep]))


def nearest_smaller_level(sections: DataFrame, doc_col: str = "document_id") -> DataFrame:
    """Adds ``parent_seq``: the nearest earlier headed section with a smaller level; null at the top.

    For each of the six levels the last section seen so far is a running window; the parent is
    the latest of those above the row's own level.
    """
    before = Window.partitionBy(doc_col).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    headed = F.col("heading").isNotNull()
    seen = [F.last(F.when(headed & (F.col("level") == k), F.col("seq")), ignorenulls=True).over(before) for k in range(1, 7)]
    # a section of a smaller level closes those below it, so only later ones than it count
    parent = F.lit(None).cast("int")
    for k in range(1, 7):
        s = seen[k - 1]
        parent = F.when((F.col("level") > k) & s.isNotNull() & (parent.isNull() | (s > parent)), s).otherwise(parent)
    return sections.withColumn("parent_seq", F.when(headed, parent))
