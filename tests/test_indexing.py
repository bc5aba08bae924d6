import http.server
import threading

import pytest
from pyspark.sql import functions as F

from lectern.__main__ import main
from lectern.functions.dictionary import Words
from lectern.operators import aggregates
from lectern.plans.corpus import Corpus
from lectern.sources import embedder
from lectern.sources.parsers.pdf import part_entries

from .test_corpus import W, zipped


def test_snapshots_metadata_repair_and_dimension(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    core = '<c xmlns:dc="http://dc"><dc:title>T</dc:title><dc:creator>Me</dc:creator></c>'
    (docs / "a.docx").write_bytes(zipped(**{"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>the pro vider ofﬁce</w:t></w:r></w:p></w:body></w:document>", "docProps/core.xml": core}))
    (docs / "b.md").write_text("# Plain\n\nno metadata\n")
    c = Corpus.open(spark, f"file://{tmp_path}/db")
    first = c.snapshot()
    assert Corpus.open(spark, f"file://{tmp_path}/db").snapshot() == first  # opening again writes nothing
    assert c.index(f"file://{docs}", embedder.HashEmbedder(8), words=Words(["the", "provider", "office"])).indexed == 2
    assert [(r["id"], r["path"], r["metadata"]) for r in c.list_documents().collect()] == [(1, "a.docx", '{"title":"T","author":"Me"}'), (2, "b.md", None)]
    assert c.table("chunks").filter("document_id = 1").first()["text"].strip() == "the provider office"
    assert c.config("embedding_dim") == "8"
    with pytest.raises(ValueError, match="8 numbers"):
        c.index(f"file://{docs}", embedder.HashEmbedder(9))
    before = c._read(c.snapshot())
    c.set_config("k", "v")
    after = c._read(c.snapshot())
    assert {t for t in after if after[t] != before[t]} == {"config"}  # the others aren't copied
    c.vacuum(1)
    assert c.status()["documents"] == 2 and len(list((tmp_path / "db" / "data").iterdir())) == 6  # one folder a table


def test_sum_before(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")).repartition(13)
    got = {r["k"]: r["s"] for r in aggregates.sum_before(rows, "k", F.col("v"), "s").collect()}
    assert got == {k: sum(i % 7 for i in range(k)) for k in range(1000)}
    assert aggregates.sum_before(rows.limit(0), "k", F.col("v"), "s").count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Smith v. Jones ........ 12", "Smith v. Jones\n12"),
        ("a . . . . . b", "a\nb"),
        ("an ellipsis .... stays ...", "an ellipsis .... stays ..."),
        ("Cases Brown v. Board", "Cases\nBrown v. Board"),
        ("STATUTES: 42 U.S.C.", "STATUTES:\n42 U.S.C."),
        ("Other Authorities Rules Black", "Other Authorities\nRules\nBlack"),
        ("Cases like these", "Cases like these"),
        ("Casesx Brown", "Casesx Brown"),
    ],
)
def test_part_entries(text, want):
    assert part_entries(text) == want


def test_providers():
    seen = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(self.headers["Authorization"])
            self.rfile.read(int(self.headers["Content-Length"]))
            body = b'{"embeddings": [[1, 2, 3]]}'
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    with http.server.HTTPServer(("127.0.0.1", 0), Answer) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        up = embedder.HttpEmbedder(f"http://127.0.0.1:{server.server_port}/api/embed", "m", key="secret")
        down = embedder.HttpEmbedder("http://127.0.0.1:1/api/embed", "m")
        assert not down.available() and embedder.first_available([down, up]) is up
        assert embedder.dimension(up) == 3 and seen == ["Bearer secret"] and embedder.dimension(down) is None
        server.shutdown()
    chain = embedder.usual_providers("http://h/api/embed", "m", "secret")
    assert [p.url for p in chain] == ["http://h/api/embed", *embedder.DEFAULT_URLS] and [p.key for p in chain] == ["secret", "", ""]
    assert embedder.first_available([]) is None


def test_config_command(tmp_path, capsys):
    path = tmp_path / "p.ini"
    assert main(["config", "search.limit", "7"]) == 2
    assert main(["--project", str(path), "config", "search.limit", "7"]) == 0
    assert main(["--project", str(path), "config", "search.mode", "$MODE"]) == 0
    capsys.readouterr()
    assert main(["--project", str(path), "config", "search.limit"]) == 0
    assert capsys.readouterr().out.strip() == "search.limit = 7  (project)"
    assert "$MODE" in path.read_text()  # references are kept as they were written


def test_extract_and_normalize_commands(spark, tmp_path, capsys):
    words, text, bad = tmp_path / "w", tmp_path / "t.txt", tmp_path / "bad.txt"
    words.write_text("the\nprovider\nmanaged\n")
    text.write_text("the pro vider mis- the")
    bad.write_text("qx zzkw vvbt ghhj ppqw")
    assert main(["normalize", str(text), "--words", str(words)]) == 0
    assert "the provider" in capsys.readouterr().out
    assert main(["extract", str(bad), "--words", str(words)]) == 0
    assert "quality is low" in capsys.readouterr().err
