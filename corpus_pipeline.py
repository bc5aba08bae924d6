"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
All but the last return the columns of ``documents``.  Nulls, empty and long texts, ties,
repeated rows and empty tables are dealt with as each stage's operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import exact_dedup, packing, quality_rules, shingles, substring
from lectern.scratch import write_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of tokeniser fertility rejects."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_duplicates(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: those whose sets of five-word shingles have a
    Jaccard similarity of 0.8 or more, found by MinHash bands and confirmed on the sets."""
    return shingles.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words or more that start in an earlier one."""
    return substring.remove_repeats(docs, window=20)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens, each window in the proportions of the sources."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("substring_dedup", passages), ("packing", pack)]

#: The rules, fingerprints and tokens of three stages have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
