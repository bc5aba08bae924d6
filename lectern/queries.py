"""The engine's own queries over the driver's tables, each with the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import aggregates, fusion, lexical, metrics, updates, vector
from .scratch import write_table
from .sources.files import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents"))


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_TOKENS = r"regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')"


def _bm25_sql(match: str, terms: list[str], unscored: str = "0") -> str:
    """``terms``: SQL expressions of a phrase's frequency in the token list t."""
    cols = ", ".join(f"CAST({x} AS DOUBLE) AS n{j}" for j, x in enumerate(terms))
    stat = ", ".join(f"count(*) FILTER (WHERE n{j} > 0) AS d{j}" for j in range(len(terms)))
    idf = lambda j: f"CASE WHEN ln((s.n - s.d{j} + 0.5) / (s.d{j} + 0.5)) > 0 THEN ln((s.n - s.d{j} + 0.5) / (s.d{j} + 0.5)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(j)}) * n{j} * 2.2 / (n{j} + 1.2 * (0.25 + 0.75 * len / s.a))" for j in range(len(terms)))
    return f"""
WITH tok AS (SELECT doc_id, source, lang, {_TOKENS} AS t FROM documents),
c AS (SELECT doc_id, source, lang, CAST(len(t) AS DOUBLE) AS len, {unscored} AS without, {cols} FROM tok),
s AS (SELECT count(*) AS n, avg(len) AS a, {stat} FROM c),
r AS (SELECT doc_id, source, lang, {score} AS score FROM c, s WHERE {match})
SELECT doc_id, source, lang, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 10
"""


def _count(word: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{word}'))"


def _bm25(spark: SparkSession, sf_dir: str, q: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    top = lexical.bm25(docs, q, {"text": "text"}, "doc_id", 10)
    found = docs.select("doc_id", "source", "lang").join(F.broadcast(top), F.col("doc_id") == F.col("id"))  # ten rows
    return found.select("doc_id", "source", "lang", F.round("score", 6).alias("score"))


@query(_bm25_sql("n0 > 0", [_count("tion")]))
def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, "tion")


@query(_bm25_sql("n0 > 0 AND n1 > 0", [_count("with"), _count("from")]))
def bm25_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, "with from")


@query(_bm25_sql("n0 > 0", ["len(list_filter(range(len(t) - 1), lambda i: t[i + 1] = 'of' AND t[i + 2] = 'the'))"]))
def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, '"of the"')


@query(_bm25_sql("n0 > 0 OR n1 > 0", [_count("that"), _count("elle")]))
def bm25_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, "that OR elle")


@query(_bm25_sql("n0 > 0 AND without = 0", [_count("that")], _count("with")))
def bm25_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, "that NOT with")


@query(_bm25_sql("n0 > 0", ["len(list_filter(t, lambda x: starts_with(x, 'worth')))"]))
def bm25_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, "worth*")


def _indexed_bm25(spark: SparkSession, sf_dir: str, q: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    made = write_table(lexical.postings(docs, ["text"], "doc_id"), "postings")
    index = lexical.Index(made, docs.count(), made.agg(F.sum("tf")).first()[0] or 0)
    top = lexical.bm25(docs, q, {"text": "text"}, "doc_id", 10, index)
    found = docs.select("doc_id", "source", "lang").join(F.broadcast(top), F.col("doc_id") == F.col("id"))  # ten rows
    return found.select("doc_id", "source", "lang", F.round("score", 6).alias("score"))


@query(_bm25_sql("n0 > 0 AND without = 0", [_count("that")], _count("with")))
def indexed_bm25_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of single words, from their postings alone."""
    return _indexed_bm25(spark, sf_dir, "that NOT with")


@query(_bm25_sql("n0 > 0", ["len(list_filter(range(len(t) - 1), lambda i: t[i + 1] = 'of' AND t[i + 2] = 'the'))"]))
def indexed_bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase: postings name the texts that are read."""
    return _indexed_bm25(spark, sf_dir, '"of the"')


@query(f"""
WITH tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents), u AS (SELECT doc_id, unnest(t) AS term FROM tok)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM u GROUP BY term""")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequency of every term."""
    return lexical.term_statistics(_texts(spark, sf_dir), ["text"])


def _probe(vectors: DataFrame) -> list[float]:
    return [float(x) for x in vectors.filter("vec_id = 0").first()["embedding"]]


_DIST = {
    "l2": "sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) ** 2)))",
    "cosine": "1 - list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) ** 2))) * sqrt(list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) ** 2))))",
}


def _knn_sql(metric: str) -> str:
    return f"""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
d AS (SELECT e.vec_id, {_DIST[metric]} AS distance FROM embeddings e, q)
SELECT vec_id, abs(round(distance, 6)) AS distance FROM d ORDER BY d.distance, vec_id LIMIT 10"""


@query(_knn_sql("l2"))
def knn_l2_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    return vector.nearest(v, _probe(v), 10, "vec_id").select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query(_knn_sql("cosine"))
def knn_cosine_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    return vector.nearest(v, _probe(v), 10, "vec_id", metric="cosine").select(F.col("id").alias("vec_id"), F.abs(F.round("distance", 6)).alias("distance"))


@query(f"""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
d AS (SELECT e.vec_id, e.label, {_DIST["l2"]} AS distance FROM embeddings e, q),
r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM d)
SELECT label, vec_id, round(distance, 6) AS distance, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 3""")
def knn_per_label_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    near = vector.nearest_per_group(v, _probe(v), 3, "label", "vec_id")
    return near.select(F.col("group").alias("label"), F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def _hybrid_sql(mode: str, only: str | None = None) -> str:
    boost = "1.0" if mode == "similar" else "CASE WHEN level BETWEEN 1 AND 5 THEN 1 + (6 - level) * 0.0025 ELSE 1.0 END"
    sides = {"hybrid": "lr FULL OUTER JOIN vr USING (doc_id)", "exact": "lr LEFT JOIN (SELECT * FROM vr WHERE false) x USING (doc_id)", "similar": "vr LEFT JOIN (SELECT * FROM lr WHERE false) x USING (doc_id)"}[mode]
    return f"""
WITH tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
c AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS len, CAST({_count("that")} AS DOUBLE) AS f FROM tok),
s AS (SELECT count(*) AS n, avg(len) AS a, count(*) FILTER (WHERE f > 0) AS d FROM c),
l AS (SELECT doc_id, (CASE WHEN ln((n - d + 0.5) / (d + 0.5)) > 0 THEN ln((n - d + 0.5) / (d + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / a)) AS score FROM c, s WHERE f > 0 ORDER BY score DESC, doc_id LIMIT 30),
lr AS (SELECT doc_id, rank() OVER (ORDER BY CAST(score AS FLOAT) DESC) AS tr FROM l),
q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
v AS (SELECT e.vec_id AS doc_id, {_DIST["l2"]} AS distance FROM embeddings e, q ORDER BY distance, doc_id LIMIT 30),
vr AS (SELECT doc_id, rank() OVER (ORDER BY CAST(distance AS FLOAT)) AS vr FROM v),
b AS (SELECT doc_id, tr, vr, doc_id % 8 AS level FROM {sides}),
f AS (SELECT doc_id, (coalesce(0.7 / (60 + vr), 0) + coalesce(0.3 / (60 + tr), 0)) * ({boost}) AS score FROM b)
SELECT d.doc_id, d.lang, d.source, round(f.score, 9) AS score FROM f JOIN documents d USING (doc_id)
{f"WHERE d.lang = '{only}'" if only else ""} ORDER BY f.score DESC, d.doc_id LIMIT 10"""


def _hybrid(spark: SparkSession, sf_dir: str, mode: str, only: str | None = None) -> DataFrame:
    docs, v = _texts(spark, sf_dir), _table(spark, sf_dir, "embeddings")
    o = fusion.SearchOptions(mode=mode, limit=10)
    text = None if mode == "similar" else lexical.bm25(docs, "that", {"text": "text"}, "doc_id", o.budget)
    near = None if mode == "exact" else vector.nearest(v, _probe(v), o.budget, "vec_id")
    levels = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 8).alias("heading_level"))
    fused = fusion.fuse(text, near, levels, o)
    chunks = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), "source")
    documents = docs.select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("title"), F.col("lang").alias("format"))
    found = fusion.resolve(fused, chunks, documents, o, only)
    return found.select(F.col("chunk_id").alias("doc_id"), F.col("format").alias("lang"), "source", F.round("score", 9).alias("score"))


@query(_hybrid_sql("hybrid"))
def hybrid_rrf_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, "hybrid")


@query(_hybrid_sql("exact"))
def exact_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, "exact")


@query(_hybrid_sql("similar"))
def similar_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, "similar")


@query(_hybrid_sql("hybrid", "fr"))
def format_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter stands after the candidate limit: fewer rows than the limit."""
    return _hybrid(spark, sf_dir, "hybrid", "fr")


@query("SELECT conv_id, turn, CAST(CASE WHEN turn BETWEEN 1 AND 5 THEN 1 + (6 - turn) * 0.05 ELSE 1.0 END AS DOUBLE) AS boost FROM conversations")
def heading_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", fusion.heading_boost(F.col("turn"), 0.05).cast("double").alias("boost"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM conversations) AS chunks, (SELECT CAST(coalesce(max(n_chars), 0) AS BIGINT) FROM documents) AS last_indexed")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.corpus_stats(_texts(spark, sf_dir), _table(spark, sf_dir, "conversations"), "n_chars").select("documents", "chunks", "last_indexed")


_OUTCOME = "CASE WHEN doc_id % 7 = 0 THEN 'skipped' WHEN doc_id % 11 = 0 THEN 'errors' WHEN doc_id % 13 = 0 THEN 'deferred' ELSE 'indexed' END"


@query(f"WITH o AS (SELECT {_OUTCOME} AS o FROM documents) SELECT " + ", ".join(f"count(*) FILTER (WHERE o = '{x}') AS {x}" for x in ("indexed", "skipped", "errors", "deferred")) + " FROM o")
def outcome_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.outcome_tally(_texts(spark, sf_dir).select(F.expr(_OUTCOME).alias("o")), "o")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as they are, and as an earlier run saw them: every seventh absent, every fifth with other content."""
    docs = _texts(spark, sf_dir).select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), T.content_hash("text").alias("content_hash"), "doc_id")
    old = docs.filter("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"))
    return docs, old


@query("SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS action FROM documents")
def changed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.changes(*_versions(spark, sf_dir)).select("path", "action")


@query("SELECT count(*) AS unchanged FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0")
def unchanged_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.changes(*_versions(spark, sf_dir)).filter("action = 'unchanged'").agg(F.count("*").alias("unchanged"))


@query("""
SELECT 'chunk' AS kind, c.conv_id AS document_id, CAST(c.turn AS BIGINT) AS item FROM conversations c WHERE c.conv_id % 3 <> 0
UNION ALL SELECT 'vector', e.vec_id, CAST(0 AS BIGINT) FROM embeddings e WHERE e.vec_id NOT IN (SELECT conv_id * 1000 + turn FROM conversations WHERE conv_id % 3 = 0)""")
def remove_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, v = _table(spark, sf_dir, "conversations"), _table(spark, sf_dir, "embeddings")
    documents = turns.select(F.col("conv_id").alias("id"), F.concat(F.lit("c/"), F.col("conv_id").cast("string")).alias("path")).distinct()
    chunks = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("document_id"), F.col("turn").cast("long").alias("item"))
    gone = documents.filter("id % 3 = 0").select("path")
    _, kept, vectors = updates.cascade(documents, chunks, v.select(F.col("vec_id").alias("chunk_id")), gone)
    return kept.select(F.lit("chunk").alias("kind"), "document_id", "item").unionAll(vectors.select(F.lit("vector").alias("kind"), F.col("chunk_id").alias("document_id"), F.lit(0).cast("long").alias("item")))


@query("""
WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1),
s AS (SELECT conv_id, n, coalesce(sum(n) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM n),
b AS (SELECT DISTINCT floor(f / 16) AS b FROM (SELECT unnest(range(0, (SELECT count(*) FROM conversations))) AS f) WHERE floor(f / 16) % 5 = 1)
SELECT DISTINCT conv_id AS document_id FROM s JOIN b ON f < (b.b + 1) * 16 AND b.b * 16 < f + n""")
def failed_batch_deferral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a chunk in one of the batches 1, 6, 11, ... of sixteen."""
    chunks = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"))
    failed = spark.range(0, -(-chunks.count() // 16)).select(F.col("id").alias("batch")).filter("batch % 5 = 1")
    return updates.deferred_documents(chunks, failed, 16)


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", T.content_hash("text").alias("content_hash"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, CAST(ceil(octet_length(encode(text)) * 0.25) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", T.utf8_bytes("text").alias("bytes"), T.token_estimate("text").alias("tokens"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), ' ') AS text FROM documents")
def reflow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts have no blank lines, so each is one paragraph."""
    return _texts(spark, sf_dir).select("doc_id", T.reflow("text").alias("text"))


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\n{2,}'), lambda x: NOT regexp_matches(x, '^[ \\t\\r\\n]*$'))) AS BIGINT) AS n FROM documents")
def para_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.size(T.paragraphs("text")).cast("long").alias("n"))


_LINES = "WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM l)"


def _line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.posexplode(T.lines("text")).alias("pos", "line"))


@query(_LINES + " SELECT doc_id, CAST(pos AS BIGINT) AS pos, line FROM u")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_rows(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query(_LINES + ", b AS (SELECT doc_id, pos, octet_length(encode(line)) AS n FROM u) SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(sum(n) OVER w - n AS BIGINT) AS start_byte, CAST(sum(n) OVER w AS BIGINT) AS end_byte FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)")
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("line").cast("long")
    end = F.sum(n).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _line_rows(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), (end - n).alias("start_byte"), end.alias("end_byte"))


def _roman_sql(n: str) -> str:
    spell = lambda place, one, five, ten: "[" + ", ".join(f"'{x}'" for x in ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]) + f"][1 + CAST(floor({n} / {place}) AS INTEGER) % 10]"
    return f"repeat('m', CAST(floor({n} / 1000) AS INTEGER)) || {spell(100, 'c', 'd', 'm')} || {spell(10, 'x', 'l', 'c')} || {spell(1, 'i', 'v', 'x')}"


@query(f"SELECT DISTINCT p_size AS n, {_roman_sql('p_size')} AS roman, p_size AS back FROM part UNION SELECT n_nationkey + 1980, {_roman_sql('(n_nationkey + 1980)')}, n_nationkey + 1980 FROM nation")
def roman_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "part").select(F.col("p_size").alias("n")).unionAll(_table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1980).alias("n"))).distinct()
    kind = n.schema["n"].dataType
    return n.withColumn("roman", T.to_roman("n")).withColumn("back", T.from_roman("roman").cast(kind))


@query("SELECT page_id, nullif(lower(regexp_extract(regexp_replace(url, '[?#].*', ''), '/[^/]*\\.([^./]*)$', 1)), '') AS extension, CASE WHEN page_id % 3 = 0 THEN 'md' WHEN page_id % 3 = 1 THEN 'pdf' END AS format FROM pages")
def format_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*", ""), "^.*(?=/)", "")
    made = F.concat(F.lit("dir.d/f"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, (".MD", ".pdf", ".xyz"))), (F.col("page_id") % 3 + 1).cast("int")))
    return _table(spark, sf_dir, "pages").select("page_id", F.nullif(T.extension(path), F.lit("")).alias("extension"), T.format_of(made).alias("format"))


_SHINGLES = r"list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')))"


@query(f"""
WITH a AS (SELECT doc_id, {_TOKENS} AS t FROM documents), b AS (SELECT item_id, {_TOKENS} AS t FROM benchmark),
sa AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM a), lb AS (SELECT item_id, {_SHINGLES} AS l FROM b), sb AS (SELECT item_id, len(l) AS n, unnest(l) AS s FROM lb)
SELECT doc_id, item_id, count(*) AS shared, round(count(*) / max(n), 6) AS share FROM sa JOIN sb USING (s) GROUP BY 1, 2""")
def shingle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.overlap(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "shared", F.round("share", 6).alias("share"))


@query(f"""
WITH a AS (SELECT doc_id, {_TOKENS} AS t FROM documents), b AS (SELECT item_id, {_TOKENS} AS t FROM benchmark),
sa AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM a), sb AS (SELECT item_id, unnest({_SHINGLES}) AS s FROM b),
p AS (SELECT DISTINCT doc_id, item_id FROM sa JOIN sb USING (s)),
q AS (SELECT doc_id, item_id, a.t AS t, b.t AS w, {_SHINGLES.replace("t[", "a.t[").replace("len(t)", "len(a.t)").replace("- 3", "- 2").replace("i+4", "i+3")} AS ts, {_SHINGLES.replace("t[", "b.t[").replace("len(t)", "len(b.t)").replace("- 3", "- 2").replace("i+4", "i+3")} AS ws FROM p JOIN a USING (doc_id) JOIN b USING (item_id))
SELECT doc_id, item_id, round(len(list_intersect(list_distinct(w), t)) / len(list_distinct(w)), 6) AS word_recall, round(len(list_intersect(ws, ts)) / nullif(len(ws), 0), 6) AS shingle_order FROM q""")
def word_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For documents and benchmark passages that share five words in a row: how many of the passage's words and of its runs of four the document holds."""
    d, b = _texts(spark, sf_dir), _table(spark, sf_dir, "benchmark")
    pairs = metrics.overlap(d, b, "doc_id", "item_id").select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))
    both = pairs.join(d.select("doc_id", F.col("text").alias("got")), "doc_id").join(b.select("item_id", F.col("text").alias("wanted")), "item_id")
    found = metrics.extraction_quality(both, "got", "wanted")
    return found.select("doc_id", "item_id", F.round("word_recall", 6).alias("word_recall"), F.round("shingle_order", 6).alias("shingle_order"))


@query("""
WITH s AS (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS size, sum(CAST(l_linenumber AS BIGINT)) AS weight FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, size) AS n FROM s)
SELECT l_suppkey, size, CAST(weight AS BIGINT) AS weight FROM r WHERE n = 1""")
def dominant_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    best = aggregates.weighted_mode(rows, ["l_suppkey"], F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"))
    return best.select("l_suppkey", F.col("value").alias("size"), "weight")


@query("""
WITH g AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events),
c AS (SELECT user_id, CAST(floor(gap + 0.5) AS BIGINT) AS bucket, count(*) AS n FROM g WHERE gap BETWEEN 4 AND 72 GROUP BY 1, 2),
r AS (SELECT user_id, bucket, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, bucket) AS k, sum(n) OVER (PARTITION BY user_id) AS samples FROM c)
SELECT user_id, CASE WHEN samples >= 4 THEN bucket END AS gap, CAST(samples AS BIGINT) AS samples FROM r WHERE k = 1""")
def modal_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.modal_gap(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 4, 72)


@query("""
WITH d AS (SELECT DISTINCT l_suppkey, CAST(l_quantity AS BIGINT) AS size FROM lineitem WHERE l_quantity >= 45)
SELECT l_suppkey, size, CAST(dense_rank() OVER (PARTITION BY l_suppkey ORDER BY size DESC) AS BIGINT) AS level FROM d""")
def level_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    return aggregates.level_by_size(rows, ["l_suppkey"], F.col("l_quantity").cast("long"), F.lit(45)).select("l_suppkey", "size", F.col("level").cast("long").alias("level"))


@query("SELECT l_suppkey, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY 1")
def median_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.median(F.col("l_extendedprice").cast("double")), 4).alias("median"))


@query("""
WITH x AS (SELECT l_suppkey, l_discount AS lo, l_discount + l_tax AS hi FROM lineitem),
b AS (SELECT l_suppkey, unnest(range(CAST(greatest(0, least(63, floor(CAST(lo AS DOUBLE) * 5 * 64))) AS BIGINT), CAST(greatest(0, least(63, floor(CAST(hi AS DOUBLE) * 5 * 64))) AS BIGINT) + 1)) AS bin FROM x)
SELECT l_suppkey, CAST(bin AS BIGINT) AS bin, count(*) AS n FROM b GROUP BY 1, 2""")
def gutter_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    lo, hi = F.col("l_discount"), F.col("l_discount") + F.col("l_tax")
    found = aggregates.coverage(rows, ["l_suppkey"], lo.cast("double") * 5, hi.cast("double") * 5, 64)
    return found.select("l_suppkey", F.col("bin").cast("long").alias("bin"), "n")


@query("""
WITH p AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS page FROM part), r AS (SELECT CAST(n_nationkey * 3 AS BIGINT) AS start, n_regionkey AS style FROM nation),
j AS (SELECT page, max(start) AS start FROM p JOIN r ON start <= page GROUP BY page)
SELECT p.page, r.start, r.style, p.page - r.start + 1 AS logical FROM p LEFT JOIN j USING (page) LEFT JOIN r ON r.start = j.start""")
def label_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("page")).distinct()
    ranges = _table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 3).cast("long").alias("start"), F.col("n_regionkey").alias("style"))
    return aggregates.as_of(pages, ranges, "page", "start", ["style"]).select("page", "start", "style", (F.col("page") - F.col("start") + 1).alias("logical"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def config_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return updates.latest(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT source, count(*) AS documents, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(sum(ceil(octet_length(encode(text)) * 0.25)) AS BIGINT) AS tokens FROM documents GROUP BY source")
def status_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _texts(spark, sf_dir)
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.sum(T.utf8_bytes("text")).alias("bytes"), F.sum(T.token_estimate("text")).alias("tokens"))


@query("""
WITH q AS (SELECT doc_id, octet_length(encode(text)) AS n, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(text, '[^\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) + 3 * length(regexp_replace(text, '[^\\x{FFFD}]', '', 'g')) AS b FROM documents),
p AS (SELECT doc_id, CASE WHEN n = 0 THEN 100 ELSE floor(a * 100 / n) END AS alpha, CASE WHEN n = 0 THEN 0 ELSE floor(b * 100 / n) END AS bad FROM q)
SELECT doc_id, CAST(alpha AS INTEGER) AS alpha_percent, CAST(bad AS INTEGER) AS bad_percent, CAST(CASE WHEN bad <= 5 THEN 100 WHEN bad >= 33 THEN 0 ELSE 100 - 3 * bad END AS INTEGER) AS cap FROM p""")
def quality_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", T.alpha_percent("text").alias("alpha_percent"), T.bad_percent("text").alias("bad_percent"), T.quality_cap("text").cast("int").alias("cap"))


@query("SELECT doc_id, translate(left(text, 255), chr(10) || chr(9), '  ') AS snippet FROM documents")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", T.snippet("text").alias("snippet"))


@query("SELECT path FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'notes/' || page_id || '.txt' WHEN 1 THEN 'keep.txt' WHEN 2 THEN 'drafts/' || page_id || '.md' WHEN 3 THEN 'sub/build/' || page_id || '.md' ELSE 'build/' || page_id || '.md' END AS path FROM pages) WHERE page_id % 5 IN (1, 3)")
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.ignore import IgnoreRules, walked

    n = F.col("page_id").cast("string")
    made = F.element_at(F.array(F.concat(F.lit("notes/"), n, F.lit(".txt")), F.lit("keep.txt"), F.concat(F.lit("drafts/"), n, F.lit(".md")), F.concat(F.lit("sub/build/"), n, F.lit(".md")), F.concat(F.lit("build/"), n, F.lit(".md"))), (F.col("page_id") % 5 + 1).cast("int"))
    rules = IgnoreRules("*.txt\n!keep.txt\ndrafts/\n/build/\n")
    return _table(spark, sf_dir, "pages").select(made.alias("path")).filter(walked("path") & rules.kept_column("path"))


# -- Python at work: no SQL of their own; the tests hold them against goldens -------------------


def _page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.parsers import parse

    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), F.lit("html").alias("format"), F.col("html").cast("binary").alias("content"))
    return parse(pages)


@query(None)
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_sections(spark, sf_dir).select("document_id", "seq", "parent_seq", "level", "heading", "content", "title")


@query(None)
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's sections, chunked."""
    from .operators.chunk import chunk

    return chunk(_page_sections(spark, sf_dir).filter("seq IS NOT NULL")).select("document_id", "chunk_index", "section_path", "heading", "text", "start_byte", "end_byte", "heading_level")


@query(None)
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.parsers import parse

    docs = _texts(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit("txt").alias("format"), F.col("text").cast("binary").alias("content"))
    return parse(docs).select("document_id", "seq", "level", "heading", "content", "source_line")


@query(None)
def force_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of at most 200 tokens."""
    from .operators.chunk import ChunkOptions, chunk

    docs = _texts(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit(0).alias("seq"), F.lit(None).cast("int").alias("parent_seq"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("heading"), F.col("text").alias("content"))
    return chunk(docs, ChunkOptions(max_tokens=200, min_tokens=20)).select("document_id", "chunk_index", "text", "start_byte", "end_byte")


def _word_list() -> object:
    from .functions.dictionary import Words

    return Words("the and that with for this from are was but not you all have been their which would there about".split(), ["paris", "london"])


@query(None)
def dictionary_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.dictionary import normalize

    return _texts(spark, sf_dir).select("doc_id", normalize(spark, F.col("text"), _word_list()).alias("text"))


@query(None)
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.dictionary import text_quality as quality

    return _texts(spark, sf_dir).select("doc_id", quality(spark, F.col("text"), _word_list()).alias("quality"))


@query(None)
def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.embedder import HashEmbedder, embed

    return embed(_texts(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"), HashEmbedder(16))
