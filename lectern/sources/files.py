"""Files as rows: a recursive scan with the walk's filters, formats and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FORMATS, content_hash, format_of
from .ignore import IgnoreRules, walked

IGNORE_FILE = ".lecternignore"
EMPTY_RUN = {"indexed": 0, "skipped": 0, "errors": 0}


def relative_to(root: str) -> Column:
    """The path of a scanned file below ``root``, without scheme."""
    bare = F.regexp_replace(F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/"), "/+", "/")
    prefix = "/" + root.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    return F.when(bare.startswith(prefix), F.substring(bare, len(prefix) + 1, 1 << 30)).otherwise(F.element_at(F.split(bare, "/"), -1))


def load_rules(spark: SparkSession, root: str) -> IgnoreRules:
    """The rules in the root's ignore file; none if there is no such file."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{IGNORE_FILE}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return IgnoreRules()
    lines = spark.read.text(path.toString()).collect()  # one small file
    return IgnoreRules("\n".join(r[0] for r in lines))


def scan_files(spark: SparkSession, root: str, rules: IgnoreRules | None = None) -> DataFrame:
    """(path, format, content_hash, content) of each file below ``root`` that the engine reads.

    Names that begin with a dot, noise directories, other extensions and ignored paths are
    filtered before contents are hashed.  ``root`` may be one file.  Order by ``path`` for the
    walk's order, which is by bytes.
    """
    rules = rules if rules is not None else load_rules(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = files.select(relative_to(root).alias("path"), "content", "length")
    kept = rel.filter(walked("path") & rules.kept_column("path")).withColumn("format", format_of("path")).filter(F.col("format").isNotNull())
    return kept.select("path", "format", content_hash("content").alias("content_hash"), "content")


def one_document(spark: SparkSession, content: bytes, fmt: str, path: str = "-") -> DataFrame:
    """A document that was not read from a file, e.g. from standard input."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    df = spark.createDataFrame([(path, fmt, bytearray(content))], "path string, format string, content binary")
    return df.select("path", "format", content_hash("content").alias("content_hash"), "content")


def spread(scan: DataFrame) -> DataFrame:
    """A scan over all cores, where its files have so few splits that half of the cores would wait.

    For work that costs far more than its input's way over the network: a few files of text.  Only for a plain
    scan, as asking for partitions would run the exchanges of anything else."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() * 2 <= cores else scan
