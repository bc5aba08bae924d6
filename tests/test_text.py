import sqlite3

import pytest
from pyspark.sql import functions as F

from lectern.functions import charset
from lectern.functions import text as T
from lectern.functions.dictionary import Words
from lectern.operators import lexical
from lectern.sources.ignore import IgnoreRules

COMMON = "known unknown mismanaged managed mis twenty four a nobody had to me about at the met homely little punishment what inside spirit poured man aged".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_roman(spark):
    want = {1: "i", 4: "iv", 9: "ix", 14: "xiv", 42: "xlii", 100: "c", 2024: "mmxxiv", 3999: "mmmcmxcix", 0: None, 4000: None}
    df = spark.createDataFrame([(k,) for k in want], "n int").withColumn("r", T.to_roman("n")).withColumn("b", T.from_roman("r"))
    for r in df.collect():
        assert r["r"] == want[r["n"]] and r["b"] == (r["n"] if want[r["n"]] else None)
    assert one(spark, T.from_roman(F.lit("iiii"))) == 4 and one(spark, T.from_roman(F.lit("XIV"))) == 14
    assert one(spark, T.from_roman(F.lit("abc"))) is None and one(spark, T.from_roman(F.lit(""))) is None


@pytest.mark.parametrize(
    "text,want",
    [
        ("spirit.Winston poured", "spirit. Winston poured"),
        ("what,inside the", "what, inside the"),
        ("about 1,000 items", "about 1,000 items"),
        ("costs 3.14 dollars", "costs 3.14 dollars"),
        ("U.S. stock market", "U.S. stock market"),
        ("Arti\x02cial", "Artificial"),
        ("\x01ower o\x03er", "flower offer"),
        ("he\x04llo", "hello"),
        ("ﬁne oﬀer", "fine offer"),
        ("u0001ow", "flow"),
    ],
)
def test_repair_controls(spark, text, want):
    assert one(spark, T.repair_controls(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [("a\nb\n\nc\n", "a b\nc"), ("\n\n a \n\tb\r\n", "a b"), ("", ""), ("a\n\n\n\nb", "a\nb")])
def test_reflow(spark, text, want):
    assert one(spark, T.reflow(F.lit(text))) == want


def test_small_expressions(spark):
    assert one(spark, T.token_estimate(F.lit(""))) == 0 and one(spark, T.token_estimate(F.lit("é"))) == 1 and one(spark, T.token_estimate(F.lit("abcde"))) == 2
    assert one(spark, T.format_of(F.lit("a/b.c/x.PDF"))) == "pdf" and one(spark, T.format_of(F.lit("a.pdf/x"))) is None
    assert one(spark, T.breadcrumb(F.lit("A > B"), F.lit("C"))) == "A > B > C" and one(spark, T.breadcrumb(F.lit(""), F.lit("C"))) == "C"
    assert one(spark, T.dot_leaders(F.lit("Intro . . . . . . 5"))) == "Intro\n5"
    assert one(spark, T.drop_soft_hyphens(F.lit("syl­\nlable"))) == "syllable"
    assert one(spark, T.core_of_word(F.lit("(word),"))) == "word"
    assert one(spark, T.search_tokens(F.lit("Été déjà-vu, Straße 42"))) == ["ete", "deja", "vu", "straße", "42"]
    assert one(spark, T.quality_cap(F.lit("�" * 5 + "ok"))) == 0 and one(spark, T.quality_cap(F.lit("fine"))) == 100


@pytest.mark.parametrize(
    "text,want",
    [
        ("kn own", "known"),
        ("un know n", "unknown"),
        ("to me", "to me"),
        ("a bout", "about"),
        ("mis-managed", "mismanaged"),
        ("mis- managed", "mismanaged"),
        ("mis-man aged", "mismanaged"),
        ("twenty-four", "twenty-four"),
        ("homely lit\ntle punishment", "homely little\npunishment"),
        ("530 U. S. 238", "530 U. S. 238"),
        ("5 F. 3d 1000", "5 F. 3d 1000"),
        ("a nob ody, had", "a nobody, had"),
    ],
)
def test_dictionary_repair(text, want):
    assert Words(COMMON).repair(text) == want


def test_proper_names():
    w = Words(COMMON, ["greenberg"])
    assert w.repair("met Ace Greenbe rg at the") == "met Ace Greenberg at the" and not w.known("greenberg") and w.known("Greenberg")
    assert w.word_percent("known unknown zzz") == 66 and w.word_percent("") == 100


@pytest.mark.parametrize("name", ["cp1252", "iso-8859-5", "koi8-r", "cp874", "mac-roman", "cp1251", "iso-8859-15"])
def test_charsets_byte_by_byte(name):
    for k in range(256):
        assert charset.decode(bytes([k]), name) == bytes([k]).decode(name, "ignore")


def test_charset_detection():
    assert charset.detect("é".encode()) == "utf-8" and charset.detect(b"caf\xe9 ol\xe9") == "cp1252"
    assert charset.decode("héllo".encode("utf-16")) == "héllo" and charset.decode(b"\xfe\xff\x00a", "utf-16le") == "a"
    assert charset.decode("plain text, é".encode("utf-16-le")) == "plain text, é" and charset.decode(b"\xe9", "no-such") == "é"


def test_ignore_rules(spark):
    rules = IgnoreRules("*.txt\n!keep.txt\ndrafts/\n/build/\n")
    kept = ["keep.md", "keep.txt", "sub/build/kept.md", "sub/deep.md"]
    gone = ["notes.txt", "sub/notes.txt", "drafts/plan.md", "sub/drafts/x.md", "build/out.md"]
    assert all(map(rules.kept, kept)) and not any(map(rules.kept, gone))
    df = spark.createDataFrame([(p,) for p in kept + gone], "path string")
    assert sorted(r[0] for r in df.filter(rules.kept_column("path")).collect()) == sorted(kept)
    assert IgnoreRules("/build").matches("build") and not IgnoreRules("/build").matches("build/output.o")
    assert IgnoreRules("file?.txt").matches("file1.txt") and not IgnoreRules("file?.txt").matches("file.txt") and not IgnoreRules("file?.txt").matches("file12.txt")
    assert IgnoreRules("**/foo/*.txt").matches("a/foo/x.txt") and not IgnoreRules("**/foo/*.txt").matches("foo/sub/bar.txt")
    assert IgnoreRules("# no\r\n*.log\r\n").matches("x.log")


TEXTS = ["quantum mechanics of small things", "boil water and salt", "the quantum of solace", "water water everywhere", "mechanics of water in a quantum pipe", "nothing to see", "salt of the earth", "une école déjà vue"]


@pytest.mark.parametrize("query", ["quantum", "water salt", "quantum OR salt", "water NOT salt", '"quantum mechanics"', "mech*", "(boil OR nothing) AND water", "^water", "NEAR(quantum pipe, 3)", "NEAR(mechanics pipe, 2)", "ecole", '"of the"'])
def test_bm25_against_fts5(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text)")
    db.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", list(enumerate(TEXTS, 1)))
    want = db.execute("SELECT rowid, -rank FROM f WHERE f MATCH ? ORDER BY rank, rowid", (query,)).fetchall()
    df = spark.createDataFrame(list(enumerate(TEXTS, 1)), "id long, text string")
    got = [(r["id"], r["score"]) for r in lexical.bm25(df, query, {"text": "text"}, "id", 10).collect()]
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want))


@pytest.mark.parametrize("query", ["", '"open', "a AND", "(a", "nosuch: x", "OR a )"])
def test_bad_queries(query):
    with pytest.raises(lexical.QueryError):
        lexical.parse_query(query, ["text"])


def test_postings_index(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS, 1)), "id long, text string")
    lexical.write_postings(df, ["text"], "id", str(tmp_path))
    for terms in (["water"], ["water", "salt"], ["quantum", "of"]):
        want = [(r["id"], round(r["score"], 9)) for r in lexical.bm25(df, " ".join(terms), {"text": "text"}, "id", 5).collect()]
        assert [(r["id"], round(r["score"], 9)) for r in lexical.search_postings(str(tmp_path), spark, terms, 5).collect()] == want
    assert lexical.search_postings(str(tmp_path), spark, ["zzz"], 5).count() == 0
