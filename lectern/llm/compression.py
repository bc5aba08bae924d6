"""Compression classifier: dictionaries of good and of bad text.

Two zstandard dictionaries are built, one from texts labelled good and one from texts
labelled bad.  A text is compressed with each in short independent pieces, so that what a
dictionary saves doesn't fade with length, and the sizes g and b give the normalised
difference (b - g) / (b + g).  A logistic curve fitted on labelled texts that built neither
dictionary turns it into the probability of label 1.

Fitting reads a sample of labelled rows bounded by ``sample_docs`` and ``sample_bytes`` for each
label; scoring reads every text whole, one row at a time, with no exchange.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_fold, raw_texts, table

SCALE = 20.0  # of the difference, to have weights of order one


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    raw: bool  # the dictionaries are plain text: too little to build proper ones
    piece: int
    level: int
    weights: tuple[float, float]

    def compressors(self) -> tuple:
        out = []
        for d in (self.good, self.bad):
            made = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT if self.raw else zstandard.DICT_TYPE_AUTO)
            if len(d):
                made.precompute_compress(level=self.level)
                out.append(zstandard.ZstdCompressor(level=self.level, dict_data=made, write_content_size=False, write_dict_id=False))
            else:
                out.append(zstandard.ZstdCompressor(level=self.level, write_content_size=False))
        return tuple(out)


def difference(raw: bytes, compressors: tuple, piece: int) -> float:
    """Above 0 if the good dictionary saves more; 0 for an empty text."""
    good = bad = 0
    for at in range(0, len(raw), piece):
        part = raw[at : at + piece]
        good += len(compressors[0].compress(part))
        bad += len(compressors[1].compress(part))
    return (bad - good) / (bad + good) if good + bad else 0.0


def _dictionary(texts: list[bytes], size: int, piece: int) -> bytes | None:
    parts = [t[at : at + piece] for t in texts for at in range(0, len(t), piece)]
    try:
        return zstandard.train_dictionary(size, parts, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def fit(texts: list[tuple[bytes, int]], size: int = 112_640, piece: int = 1024, level: int = 3, totals: dict[int, int] | None = None) -> Model:
    """Odd places build the dictionaries, even places fit the curve (all do both if there are few).

    ``totals`` has the number of texts of each label that the sample stands for: the curve's texts
    are weighted to those shares, so that a sample with another balance gives the same probabilities."""
    build, curve = (texts[::2], texts[1::2]) if len(texts) >= 40 else (texts, texts)
    of = {q: [t for t, x in build if x == q] for q in (1, 0)}
    made = {q: _dictionary(of[q], size, piece) for q in of}
    raw = None in made.values()
    if raw:
        made = {q: b"".join(of[q])[-size:] for q in of}
    model = Model(made[1], made[0], raw, piece, level, (0.0, 0.0))
    compressors = model.compressors()
    x = np.array([[1.0, SCALE * difference(t, compressors, piece)] for t, _ in curve]).reshape(-1, 2)
    y = np.array([q for _, q in curve], dtype=float)
    weight = np.ones(len(y))
    if totals:
        share = {q: totals.get(q, 0) / max(1, int((y == q).sum())) for q in (0, 1)}
        weight = np.array([share[int(q)] for q in y])
        weight *= len(y) / max(weight.sum(), 1e-300)
    w = np.zeros(2)
    for _ in range(50):  # Newton's method with a little ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-2 * w
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), slope)
    return Model(made[1], made[0], raw, piece, level, (float(w[0]), float(w[1])))


def _known(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    return labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (id_fold("doc_id", folds) != held))


def totals(labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0) -> dict[int, int]:
    """The number of training labels of each kind, of which :func:`sample` takes some."""
    return {int(r["q"]): r["n"] for r in _known(labels, label, folds, held).groupBy(F.col(label).cast("int").alias("q")).agg(F.count("*").alias("n")).collect()}


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, sample_docs: int = 3000, sample_bytes: int = 12 << 20) -> list[tuple[bytes, int]]:
    """At most ``sample_docs`` texts and about ``sample_bytes`` bytes of each label, in the order of a hash of the id.

    A label ends at the first text that passes its bytes, so long texts are not passed over for short ones."""
    spark = docs.sparkSession
    known = _known(labels, label, folds, held).select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("q"), F.xxhash64(F.col("doc_id").cast("long"), F.lit(1)).alias("h"))
    rows = [r for q in (0, 1) for r in known.filter(F.col("q") == q).orderBy("h", "id").limit(sample_docs).collect()]
    if not rows:
        return []
    few = F.broadcast(spark.createDataFrame(rows, known.schema))  # 2 * sample_docs rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(few, "id").select("h", "id", "q", F.coalesce("text", F.lit("")).alias("text"))
    out, held_bytes = [], {0: 0, 1: 0}
    sized = texts.select("h", "id", "q", F.octet_length("text").alias("n"))
    ids = set()
    for r in sorted(sized.collect()):
        if held_bytes[r["q"]] == 0 or held_bytes[r["q"]] + r["n"] <= sample_bytes:
            ids.add((r["id"], r["q"]))
            held_bytes[r["q"]] += r["n"]
        else:
            held_bytes[r["q"]] = sample_bytes + 1
    chosen = texts.join(F.broadcast(spark.createDataFrame(sorted(ids), "id long, q int")), ["id", "q"], "left_semi") if ids else texts.limit(0)
    for r in sorted(chosen.select("h", "id", "q", "text").collect()):
        out.append((r["text"].encode(), r["q"]))
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row: the probability of label 1.

    A null text scores as the empty text, which has difference 0; a null id stays null;
    repeated rows score alike; an empty table gives an empty result.  Other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        a, b = model.weights
        for batch in batches:
            d = np.array([difference(t or b"", compressors, model.piece) for t in raw_texts(batch.column(1))], dtype=float)
            p = 1 / (1 + np.exp(-np.clip(a + b * SCALE * d, -30, 30)))
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array(d)], names=["doc_id", "score", "difference"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, difference double")


def op2_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = fit(sample(docs, labels), totals=totals(labels))
    out = score(docs, model)
    return out.select("doc_id", (id_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
