import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.operators import aggregates, fusion, lexical, vector
from lectern.operators.chunk import ChunkOptions, chunk, chunk_sections, split_bytes
from lectern.plans.corpus import Corpus, DocumentNotFound
from lectern.sources import embedder
from lectern.sources.parsers import doc, docx, epub, markdown, nest, parse_bytes, plain_text, rtf
from lectern.sources.parsers import Section


def sections(*rows):
    return [{"seq": i, "parent_seq": p, "level": lv, "heading": h, "content": c} for i, (p, lv, h, c) in enumerate(rows)]


def texts(chunks):
    return [c["raw"].decode() for c in chunks]


def test_chunk_paths():
    made = chunk_sections(sections((None, 1, "Section 1", ""), (0, 2, "Sub A", ""), (1, 3, "Sub Sub X", "text")), ChunkOptions())
    assert [c["section_path"] for c in made] == ["Section 1 > Sub A > Sub Sub X"]
    made = chunk_sections(sections((None, 1, "Overview", "before"), (0, 2, "Details", "after")), ChunkOptions())
    assert [c["section_path"] for c in made] == ["Overview", "Overview > Details"]
    made = chunk_sections(sections((None, 0, None, "bare"), (None, 1, "H", " \n ")), ChunkOptions())
    assert [(c["section_path"], c["heading"]) for c in made] == [("", None)]


def test_chunk_sizes():
    o = ChunkOptions(max_tokens=30, min_tokens=1)
    paragraphs = "\n\n".join("p" * 100 for _ in range(10))
    assert len(chunk_sections(sections((None, 1, "A", paragraphs)), o)) == 10
    parts = chunk_sections(sections((None, 1, "A", "X" * 1000)), o)
    assert len(parts) > 1 and all(o.tokens(c["raw"]) <= 30 for c in parts) and "".join(texts(parts)) == "X" * 1000
    small = chunk_sections(sections(*((None, 1, h, "tiny") for h in "ABCDE")), ChunkOptions())
    assert len(small) == 1 and small[0]["heading"] == "A" and texts(small) == ["\n\n".join(["tiny"] * 5)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?é漢\t", max_size=300), st.integers(8, 60))
def test_split_bytes_keeps_all_and_fits(text, budget):
    raw = text.encode()
    parts = list(split_bytes(raw, budget))
    assert all(len(p) <= budget for p in parts)
    assert b"".join(parts).replace(b" ", b"").replace(b"\t", b"") == raw.replace(b" ", b"").replace(b"\t", b"")
    for p in parts:
        p.decode()


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, 0, None, 1, "A", "one"), (1, 1, None, 1, "B", "x" * 900), (2, 0, None, 1, "C", "é")], "document_id long, seq int, parent_seq int, level int, heading string, content string")
    got = [(r["document_id"], r["chunk_index"], r["start_byte"], r["end_byte"]) for r in chunk(df).orderBy("document_id", "chunk_index").collect()]
    assert got == [(1, 0, 0, 3), (1, 1, 3, 903), (2, 0, 0, 2)]


def test_markdown():
    d = markdown.parse(b"# First Heading\nwrapped\nline\n\nnext\n# Second\n## Sub ##\n")
    assert d.title == "First Heading" and [(s.level, s.heading, s.content, s.parent, s.source_line) for s in d.sections] == [(1, "First Heading", "wrapped line\nnext", None, 1), (1, "Second", "", None, 6), (2, "Sub ##", "", 1, 7)]
    d = markdown.parse(b"\n\n#NoSpace\n###### Level 6\n")
    assert [(s.level, s.heading) for s in d.sections] == [(0, None), (6, "Level 6")] and d.title is None
    assert plain_text(markdown.parse(b"# H\nbody").sections) == "H\nbody\n"


def test_nesting_matches_window(spark):
    levels = [1, 2, 3, 2, 4, 1, 3, 2, 6, 5, 1]
    want = [s.parent for s in nest([Section(x, "h") for x in levels])]
    df = spark.createDataFrame([(1, i, x, "h") for i, x in enumerate(levels)], "document_id long, seq int, level int, heading string")
    assert [r["parent_seq"] for r in aggregates.nearest_smaller_level(df).orderBy("seq").collect()] == want


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


W = 'xmlns:w="http://w"'


def test_docx():
    p = lambda t, s=None, extra="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{s}{chr(34)}/>" if s else ""}</w:pPr><w:r>{extra}<w:t>{t}</w:t></w:r></w:p>'
    body = p("Intro", "Heading1") + p("a &amp; b") + p("Deep", "Heading2", '<w:br w:type="page"/>') + p("after")
    raw = zipped(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "docProps/core.xml": '<c xmlns:dc="http://dc"><dc:title>T</dc:title><dc:creator>Me</dc:creator></c>'})
    d = docx.parse(raw)
    assert d.title == "T" and d.metadata == {"title": "T", "author": "Me"}
    assert [(s.level, s.heading, s.content, s.page_physical, s.parent) for s in d.sections] == [(1, "Intro", "a & b", 1, None), (2, "Deep", "after", 1, 0)]
    assert parse_bytes("docx", b"junk").error and parse_bytes("epub", b"junk").error is None
    assert [docx.heading_level(s) for s in ("Title", "Heading6", "Heading7", "Normal", None)] == [0, 6, None, None, None]


def test_epub():
    raw = zipped(
        **{
            "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>',
            "OPS/p.opf": '<package xmlns:dc="http://dc"><metadata><dc:title>Book</dc:title></metadata><manifest><item id="b" href="b.xhtml"/><item id="a" href="x/a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="zz"/></spine></package>',
            "OPS/x/a.xhtml": "<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><h1>One</h1><p>a <b>x</b> c</p><script>no()</script></body></html>",
            "OPS/b.xhtml": "<html><body><h2>Two</h2><p>first<br>second</body></html>",
        }
    )
    d = epub.parse(raw)
    assert d.title == "Book" and [(s.level, s.heading, s.content) for s in d.sections] == [(1, "One", "a x c"), (2, "Two", "first\nsecond")]


def test_rtf():
    body = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\info{\title My T}{\author Me}}\fs48 Big\par\fs24 caf\'e9 \u8212? dash\par more text here that is long\page\fs48 Next\par\fs24 end of it all}"
    d = rtf.parse(body)
    assert d.title == "My T" and d.metadata["author"] == "Me"
    assert [(s.heading, s.page_physical) for s in d.sections] == [("Big", 1), ("Next", 2)]
    assert d.sections[0].content == "café — dash\nmore text here that is long" and "Arial" not in plain_text(d.sections)


@pytest.mark.parametrize("line,level", [("Chapter 1", 1), ("INTRODUCTION", 1), ("1. Overview", 1), ("1.1 Details", 2), ("2.3.1 Sub-details", 3), ("This is a sentence that goes on.", None)])
def test_doc_headings(line, level):
    assert doc.heading_of(line) == level


def test_doc_clean():
    assert doc.clean("a\rb\x07c\x13 HYPERLINK x\x14shown\x15\r\r\r\rd\x01") == "a\nb\tcshown\n\nd"
    assert parse_bytes("doc", b"junk").sections == []


def test_retries():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise embedder.EmbeddingError("busy", 503)
        return [[1.0]]

    assert embedder.with_retries(call, 1, sleep=waits.append) == [[1.0]] and waits == [0.25, 0.5]
    with pytest.raises(embedder.EmbeddingError):
        embedder.with_retries(lambda: [], 1, sleep=waits.append)
    with pytest.raises(embedder.EmbeddingError):
        embedder.with_retries(lambda: (_ for _ in ()).throw(embedder.EmbeddingError("no", 400)), 1, sleep=lambda _: pytest.fail("waited"))
    assert embedder.vectors_of('{"embeddings": [[1, 2]]}') == [[1, 2]] and embedder.vectors_of('{"data": [{"embedding": [3]}]}') == [[3]]


class Fails:
    """A provider that has no vectors for texts with a word."""

    def available(self):
        return True

    def embed(self, texts):
        if any("broken" in t for t in texts):
            raise embedder.EmbeddingError("bad", 400)
        return embedder.HashEmbedder(8).embed(texts)


def test_corpus(spark, tmp_path):
    docs = tmp_path / "docs"
    (docs / "subdir").mkdir(parents=True)
    (docs / "path with spaces").mkdir()
    (docs / "contract.md").write_text("# Service Agreement\n\n## Indemnification\n\nThe provider shall indemnify and hold harmless.\n\n## Governing Law\n\nThe laws of Utah.\n")
    (docs / "subdir" / "notes.md").write_text("# Notes\n\nmeeting about lunch\n")
    (docs / "path with spaces" / "spaced.md").write_text("# Spaced\n\nanother file\n")
    (docs / "file.xyz").write_text("no")
    (docs / ".hidden.md").write_text("no")
    root = f"file://{docs}"
    c = Corpus.open(spark, f"file://{tmp_path}/db", {"model_name": "m"})
    assert c.index(root, embedder.HashEmbedder(8), now=5) == __import__("lectern.plans.corpus", fromlist=["Tally"]).Tally(3)
    assert [r["path"] for r in c.list_documents().collect()] == ["contract.md", "path with spaces/spaced.md", "subdir/notes.md"]
    assert c.status() == {"documents": 3, "chunks": c.table("chunks").count(), "last_indexed": 5}
    hits = c.search("indemnify", "exact", 1).collect()
    assert len(hits) == 1 and hits[0]["path"] == "contract.md" and c.search("zebra", "exact").count() == 0
    assert c.search("lunch", "hybrid", 2, embedder.HashEmbedder(8)).first()["path"] == "subdir/notes.md"
    assert c.search("lunch", "hybrid", 2).first()["path"] == "subdir/notes.md"
    with pytest.raises(fusion.EmbeddingRequired):
        c.search("lunch", "similar")
    assert c.search("lunch", "exact", format_filter="pdf").count() == 0
    assert c.read_chunk(hits[0]["chunk_id"])["path"] == "contract.md" and c.read_chunk(999) is None
    (docs / "subdir" / "notes.md").write_text("# Notes\n\nmeeting about dinner\n")
    (docs / "contract.md").write_text("# Service Agreement\n\nbroken now\n")
    t = c.index(root, Fails())
    assert t.skipped == 1 and t.deferred >= 1 and t.exit_code == 0
    assert c.search("indemnify", "exact").count() == 1  # the old rows stay
    t = c.index(root, embedder.HashEmbedder(8))
    assert c.search("dinner", "exact").count() == 1 and c.search("lunch", "exact").count() == 0
    c.remove("contract.md")
    assert c.status()["documents"] == 2 and c.search("broken", "exact").count() == 0
    with pytest.raises(DocumentNotFound):
        c.remove("contract.md")
    c.set_config("model_name", "n")
    assert c.config("model_name") == "n" and c.config("schema_version") == "1" and c.config("none") is None
    c.vacuum()
    assert c.status()["documents"] == 2


def test_search_by_postings(spark, tmp_path):
    """A search by postings finds what a scan of all chunks finds, after an index run, an update and a removal."""
    from lectern.plans.corpus import FIELDS

    docs = tmp_path / "docs"
    docs.mkdir()
    for i in range(12):
        (docs / f"f{i}.md").write_text(f"# Part {i}\n\n## Terms\n\nThe party of the {'first' if i % 2 else 'second'} part, clause {i}, party {i % 3}.\n\n## Law\n\nLaw of the land and caf\u00e9 law.\n")
    c = Corpus.open(spark, f"file://{tmp_path}/db")
    assert c.search("law", "exact").count() == 0
    queries = ["party", "law", "first clause", "first OR 3", "law NOT cafe", '"of the"', '"the first" OR law', "cla*", "^law", "heading: law", "NEAR(party part, 3)", "zebra", "zebra OR party", "party party", '"of the fi"*', "(party OR law) NOT (second OR cafe)"]

    def same():
        chunks, index = c.table("chunks"), c.index_of_terms()
        assert index.rows == chunks.count()
        for q in queries:
            want = [(r["id"], round(r["score"], 9)) for r in lexical.bm25(chunks, q, FIELDS, "id", 50).collect()]
            got = [(r["id"], round(r["score"], 9)) for r in lexical.bm25(chunks, q, FIELDS, "id", 50, index).collect()]
            assert got == want, q

    c.index(f"file://{docs}")
    same()
    (docs / "f3.md").write_text("# Part 3\n\nNothing but law, law, law.\n")
    (docs / "f12.md").write_text("# New\n\nThe first party.\n")
    c.index(f"file://{docs}")
    c.remove("f5.md")
    same()


def test_fusion_goldens(spark):
    one = spark.createDataFrame([(1, 2.0)], "id long, score double")
    near = spark.createDataFrame([(1, 0.1)], "id long, distance double")
    none = spark.createDataFrame([], "id long, heading_level int")
    assert abs(fusion.fuse(one, near, none, fusion.SearchOptions()).first()["score"] - 1 / 61) < 1e-9
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, None), (4, [1.0])], "chunk_id long, embedding array<float>")
    got = vector.nearest(v, [0.9, 0.1, 0, 0], 5).collect()
    assert [r["id"] for r in got] == [1, 2]
    ties = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.9)], "id long, distance double")
    levels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, heading_level int")
    assert [r["id"] for r in fusion.fuse(None, ties, levels, fusion.SearchOptions()).collect()] == [2, 1, 3]
    assert [r["id"] for r in fusion.fuse(None, ties, levels, fusion.SearchOptions(mode="similar")).collect()] == [1, 2, 3]


def test_page_labels(spark):
    pages = spark.createDataFrame([(1,), (4,), (5,), (7,)], "page int")
    ranges = spark.createDataFrame([(1, "r", 1), (5, "D", 1)], "start int, style string, first int")
    got = aggregates.as_of(pages, ranges, "page", "start", ["style", "first"]).orderBy("page").collect()
    assert [r["page"] - r["start"] + r["first"] for r in got] == [1, 4, 1, 3] and [r["style"] for r in got] == ["r", "r", "D", "D"]


def test_failed_batches_have_no_end(spark, tmp_path):
    """A turn for each document: those past the 10,000th are deferred like the others."""
    from lectern.queries import failed_batch_deferral

    spark.range(10_105).selectExpr("id AS conv_id", "0 AS turn", "'user' AS role", "'t' AS text").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(r["document_id"] for r in failed_batch_deferral(spark, str(tmp_path)).collect())
    assert got == [i for i in range(10_105) if i // 16 % 5 == 1]
