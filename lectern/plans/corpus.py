"""A corpus as snapshots of Parquet tables: index, update, search, remove, status.

A snapshot is a manifest that names the data folder of each table.  A write makes new folders for
the tables that change, keeps the others', and takes the next number last, so a reader sees the old
corpus or the new one, and a failed run leaves the old one.  Documents whose vectors could not be
had are deferred: their old rows stay, and the next run tries again.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dictionary import Words, normalize
from ..functions.text import drop_soft_hyphens, repair_controls
from ..operators import fusion, lexical, updates, vector
from ..operators.aggregates import corpus_stats, sum_before
from ..operators.chunk import ChunkOptions, chunk
from ..scratch import write_table
from ..sources.embedder import dimension, embed
from ..sources.files import scan_files
from ..sources.parsers import parse

TABLES = {
    "documents": "id long, path string, format string, title string, content_hash string, metadata string, indexed_at long",
    "chunks": "id long, document_id long, chunk_index int, section_path string, heading string, text string, start_byte long, end_byte long, heading_level int, page_physical int, page_logical int, page_section int, page_roman boolean, source_line int",
    "embeddings": "chunk_id long, embedding array<float>",
    "config": "key string, value string",
    "postings": "term string, id long, tf long, len long",
    "statistics": "chunks long, tokens long",
}
FIELDS = {"text": "text", "heading": "heading", "section_path": "section_path"}
VERSION = "1"


class DocumentNotFound(KeyError):
    pass


@dataclass(frozen=True)
class Tally:
    indexed: int = 0
    skipped: int = 0
    errors: int = 0
    deferred: int = 0

    @property
    def exit_code(self) -> int:
        """1 only if there were errors and nothing was indexed."""
        return 1 if self.errors and not self.indexed else 0


class Corpus:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._Path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: dict[str, str] | None = None) -> Corpus:
        """Open a corpus, made empty if there is none; settings are put in if absent."""
        c = cls(spark, path)
        if c.snapshot() is None:
            empty = {t: spark.createDataFrame([], s) for t, s in TABLES.items()}
            c._commit(empty | {"statistics": spark.createDataFrame([(0, 0)], TABLES["statistics"])})
        seeds = {"schema_version": VERSION} | (config or {})
        if c.table("config").filter(F.col("key").isin(*seeds)).count() < len(seeds):
            c._commit({"config": updates.put_if_absent(c.table("config"), spark.createDataFrame(sorted(seeds.items()), TABLES["config"]), ["key"])})
        return c

    # -- snapshots -----------------------------------------------------------

    def snapshot(self) -> str | None:
        """The newest committed snapshot's folder."""
        root = self._Path(f"{self.path}/snapshots")
        if not self._fs.exists(root):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        done = sorted(n for n in names if not n.startswith("_"))
        return f"{self.path}/snapshots/{done[-1]}" if done else None

    def _read(self, snapshot: str) -> dict[str, str]:
        """Table name -> name of its data folder."""
        stream = self._fs.open(self._Path(f"{snapshot}/manifest.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/data/{self._read(self.snapshot())[name]}")

    def index_of_terms(self) -> lexical.Index:
        """The postings of all chunks, by term; made on the way for a corpus written without them."""
        if "postings" in self._read(self.snapshot()):
            row = self.table("statistics").first()
            return lexical.Index(self.table("postings"), row["chunks"], row["tokens"])
        chunks = self.table("chunks")
        made = write_table(lexical.postings(chunks, list(FIELDS.values()), "id"), "postings")
        return lexical.Index(made, chunks.count(), made.agg(F.sum("tf")).first()[0] or 0)

    def _commit(self, changed: dict[str, DataFrame]) -> None:
        """Write the changed tables, name the folders of the others, and take the next number."""
        old = self.snapshot()
        n = int(old.rsplit("/", 1)[1]) + 1 if old else 0
        manifest = self._read(old) if old else {}
        for name, df in changed.items():
            manifest[name] = f"{name}-{uuid.uuid4().hex}"
            df = df.select(*(c.split(" ")[0] for c in TABLES[name].split(", ")))
            if name == "postings":  # a search reads the row groups of its terms
                df = df.repartitionByRange("term", "id").sortWithinPartitions("term", "id")
            df.write.parquet(f"{self.path}/data/{manifest[name]}")
        temp, final = self._Path(f"{self.path}/snapshots/_{uuid.uuid4().hex}"), self._Path(f"{self.path}/snapshots/{n:012d}")
        stream = self._fs.create(self._Path(f"{temp}/manifest.json"))
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            raise RuntimeError("another writer has committed")

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest snapshots, and data that none of those name (no writer may be at work)."""
        keep = max(keep, 1)
        root, data = self._Path(f"{self.path}/snapshots"), self._Path(f"{self.path}/data")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(root))
        done = [n for n in names if not n.startswith("_")]
        used = {d for n in done[-keep:] for d in self._read(f"{self.path}/snapshots/{n}").values()}
        for n in [*done[:-keep], *(n for n in names if n.startswith("_"))]:
            self._fs.delete(self._Path(f"{self.path}/snapshots/{n}"), True)
        for n in [s.getPath().getName() for s in self._fs.listStatus(data)]:
            if n not in used:
                self._fs.delete(self._Path(f"{self.path}/data/{n}"), True)

    # -- writing -------------------------------------------------------------

    def index(self, root: str, provider=None, options: ChunkOptions | None = None, now: int | None = None, words: Words | None = None) -> Tally:
        """Bring the corpus up to date with the files below ``root``: unchanged ones are skipped
        before they are parsed, changed ones replaced; files that vanished stay.

        Headings and bodies are repaired before they are cut: ligatures, control characters and soft hyphens
        always, split words where a list of words is given."""
        return self.index_files(scan_files(self.spark, root), provider, options, now, words)

    def index_files(self, files: DataFrame, provider=None, options: ChunkOptions | None = None, now: int | None = None, words: Words | None = None) -> Tally:
        dim = dimension(provider) if provider is not None else None
        known = self.config("embedding_dim")
        if dim is not None and known is not None and int(known) != dim:
            raise ValueError(f"the corpus has vectors of {known} numbers, the provider's have {dim}")
        documents, chunks, vectors = (self.table(t) for t in ("documents", "chunks", "embeddings"))
        marked = updates.changes(files, documents)
        todo = marked.filter("action <> 'unchanged'")
        first = documents.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        # ids follow the order of paths; contents stay where they are
        numbered = sum_before(todo.select("path", "content_hash", "format"), "path", F.lit(1), "document_id")
        numbered = write_table(numbered.withColumn("document_id", (F.col("document_id") + F.lit(first + 1)).cast("long")), "numbered")
        mend = lambda c: drop_soft_hyphens(repair_controls(c)) if words is None else normalize(self.spark, c, words)
        parsed = parse(todo.join(numbered.select("path", "document_id"), "path"))
        sections = write_table(parsed.withColumns({"heading": mend("heading"), "content": mend("content")}), "sections")
        heads = sections.groupBy("document_id").agg(F.first("title").alias("title"), F.first(F.to_json("metadata")).alias("metadata"), F.first("error").alias("error"))
        broken = heads.filter("error IS NOT NULL").select("document_id")
        made = chunk(sections.filter("seq IS NOT NULL"), options)
        base = chunks.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        made = write_table(made, "chunks")
        counts = sum_before(made.groupBy("document_id").agg(F.count("*").alias("n")), "document_id", F.col("n"), "first").withColumn("first", F.col("first") + F.lit(base + 1))
        made = write_table(made.join(counts.select("document_id", "first"), "document_id").withColumn("id", (F.col("first") + F.col("chunk_index")).cast("long")).drop("first"), "chunks")
        if provider is not None:
            got = write_table(embed(made.select(F.col("id").alias("chunk_id"), "text"), provider), "vectors")
            deferred = made.join(got.filter("failed").select(F.col("chunk_id").alias("id")), "id", "left_semi").select("document_id").distinct()
        else:
            got, deferred = None, made.select("document_id").limit(0)
        left_out = broken.unionAll(deferred)
        good = write_table(numbered.join(left_out, "document_id", "left_anti"), "good")
        stamp = int(time.time()) if now is None else now
        kept_docs, kept_chunks, kept_vectors = updates.cascade(documents, chunks, vectors, good.select("path"))
        gone = write_table(self._chunks_of(good.select("path")), "gone")
        new_docs = good.join(heads.select("document_id", "title", "metadata"), "document_id", "left").select(F.col("document_id").alias("id"), "path", "format", "title", "content_hash", F.nullif("metadata", F.lit("{}")).alias("metadata"), F.lit(stamp).cast("long").alias("indexed_at"))
        new_chunks = made.join(good.select("document_id"), "document_id", "left_semi")
        changed = {"documents": kept_docs.unionByName(new_docs), "chunks": kept_chunks.select(*chunks.columns).unionByName(new_chunks.select(*chunks.columns))}
        if got is not None:
            changed["embeddings"] = kept_vectors.unionByName(got.filter("NOT failed").join(new_chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").select("chunk_id", "embedding"))
        else:
            changed["embeddings"] = kept_vectors
        posted = write_table(lexical.postings(new_chunks, list(FIELDS.values()), "id"), "postings")
        changed |= self._with_terms(gone, posted, new_chunks.count())
        if dim is not None and known is None:
            changed["config"] = self._with_config("embedding_dim", str(dim))
        tally = Tally(good.count(), marked.filter("action = 'unchanged'").count(), broken.count(), deferred.count())
        self._commit(changed)
        return tally

    def remove(self, path: str) -> None:
        documents = self.table("documents")
        if documents.filter(F.col("path") == path).isEmpty():
            raise DocumentNotFound(path)
        paths = self.spark.createDataFrame([(path,)], "path string")
        kept = dict(zip(("documents", "chunks", "embeddings"), updates.cascade(documents, self.table("chunks"), self.table("embeddings"), paths)))
        self._commit(kept | self._with_terms(write_table(self._chunks_of(paths), "gone"), None, 0))

    def _chunks_of(self, paths: DataFrame) -> DataFrame:
        """Ids of the chunks of the documents at ``paths``."""
        docs = self.table("documents").join(paths.distinct(), "path", "left_semi").select(F.col("id").alias("document_id"))
        return self.table("chunks").join(docs, "document_id", "left_semi").select("id")

    def _with_terms(self, gone: DataFrame, posted: DataFrame | None, n: int) -> dict[str, DataFrame]:
        """Postings and statistics without the chunks ``gone`` and with those of ``n`` new ones."""
        old = self.index_of_terms()
        tokens = lambda t: t.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
        chunks, total = old.rows - gone.count() + n, old.tokens - tokens(old.postings.join(gone, "id", "left_semi"))
        kept = old.postings.join(gone, "id", "left_anti")
        if posted is not None:
            kept, total = kept.unionByName(posted), total + tokens(posted)
        return {"postings": kept, "statistics": self.spark.createDataFrame([(chunks, total)], TABLES["statistics"])}

    def set_config(self, key: str, value: str) -> None:
        self._commit({"config": self._with_config(key, value)})

    def _with_config(self, key: str, value: str) -> DataFrame:
        old = self.table("config").filter(F.col("key") != key)
        return old.unionAll(self.spark.createDataFrame([(key, value)], TABLES["config"]))

    # -- reading -------------------------------------------------------------

    def config(self, key: str) -> str | None:
        row = self.table("config").filter(F.col("key") == key).first()
        return row["value"] if row else None

    def status(self) -> dict:
        return corpus_stats(self.table("documents"), self.table("chunks")).first().asDict()

    def read_chunk(self, chunk_id: int) -> dict | None:
        row = self.table("chunks").filter(F.col("id") == chunk_id).join(self.table("documents").select(F.col("id").alias("document_id"), "path", "title", "format"), "document_id").first()
        return row.asDict() if row else None

    def list_documents(self) -> DataFrame:
        return self.table("documents").orderBy("path")

    def needs_reindex(self, path: str, content_hash: str) -> bool:
        row = self.table("documents").filter(F.col("path") == path).first()
        return row is None or row["content_hash"] != content_hash

    def views(self, prefix: str = "") -> None:
        """Register the tables as temporary views for SQL."""
        for t in TABLES:
            self.table(t).createOrReplaceTempView(prefix + t)

    def search(self, query: str, mode: str = "hybrid", limit: int = 10, provider=None, query_vector: list[float] | None = None, format_filter: str | None = None) -> DataFrame:
        """Ranked chunks.  Hybrid without a provider or vector falls back to exact; similar can't."""
        limit = limit or 10
        mode = mode if mode in ("hybrid", "exact", "similar") else "hybrid"
        if query_vector is None and provider is not None and mode != "exact":
            query_vector = provider.embed([query])[0]
        if query_vector is None and mode == "hybrid":
            mode = "exact"
        o = fusion.SearchOptions(mode=mode, limit=limit)
        chunks, documents = self.table("chunks"), self.table("documents")
        text = None if mode == "similar" else lexical.bm25(chunks, query, FIELDS, "id", o.budget, self.index_of_terms())
        near = None if mode == "exact" or query_vector is None else vector.nearest(self.table("embeddings"), query_vector, o.budget)
        fused = fusion.fuse(text, near, chunks.select("id", "heading_level"), o)
        return fusion.resolve(fused, chunks, documents, o, format_filter)
