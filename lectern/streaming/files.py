"""New and changed files as a stream: each micro-batch updates a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash, format_of
from ..plans.corpus import Corpus
from ..sources.files import relative_to
from ..sources.ignore import IgnoreRules, walked

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str, rules: IgnoreRules | None = None) -> DataFrame:
    """A streaming table of (path, format, content_hash, content)."""
    rules = rules or IgnoreRules()
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(root)
    rel = files.select(relative_to(root).alias("path"), "content")
    kept = rel.filter(walked("path") & rules.kept_column("path")).withColumn("format", format_of("path")).filter(F.col("format").isNotNull())
    return kept.select("path", "format", content_hash("content").alias("content_hash"), "content")


def keep_indexed(corpus: Corpus, stream: DataFrame, checkpoint: str, provider=None, once: bool = False) -> StreamingQuery:
    """Index every micro-batch.  A batch that runs again finds its files unchanged, so it changes nothing."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: corpus.index_files(df, provider))
    return (writer.trigger(availableNow=True) if once else writer).start()
