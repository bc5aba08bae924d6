from lectern.plans.corpus import Corpus
from lectern.streaming.files import keep_indexed, watch


def test_stream_of_files(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# A\nfirst words\n")
    (docs / "b.xyz").write_text("no")
    c = Corpus.open(spark, f"file://{tmp_path}/db")
    root, mark = f"file://{docs}", f"file://{tmp_path}/mark"
    keep_indexed(c, watch(spark, root), mark, once=True).awaitTermination()
    assert c.status()["documents"] == 1 and c.search("first", "exact").count() == 1
    (docs / "c.md").write_text("# C\nother words\n")
    keep_indexed(c, watch(spark, root), mark, once=True).awaitTermination()
    assert [r["path"] for r in c.list_documents().collect()] == ["a.md", "c.md"]
