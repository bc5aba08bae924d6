"""python -m lectern: index, search, status, list, remove, read, extract, normalize, config."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .functions.text import snippet
from .operators.chunk import ChunkOptions
from .settings import Settings, read_file, save


def _spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.appName("lectern").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lectern")
    p.add_argument("--index", help="the corpus folder")
    p.add_argument("--project", help="a settings file")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "update"):
        sub.add_parser(name).add_argument("path")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--mode")
    s.add_argument("--limit", type=int)
    s.add_argument("--format")
    s.add_argument("--pretty", action="store_true", help="a place, score and snippet for each result")
    sub.add_parser("status")
    sub.add_parser("serve", help="answer JSON-RPC lines on standard input")
    sub.add_parser("list")
    sub.add_parser("remove").add_argument("path")
    sub.add_parser("read").add_argument("chunk", type=int)
    e = sub.add_parser("extract")
    e.add_argument("path", help="a file, or - for standard input")
    e.add_argument("--format")
    e.add_argument("--as", dest="form", choices=("plain", "markdown", "json"), default="plain")
    e.add_argument("--from-page", type=int)
    e.add_argument("--to-page", type=int)
    n = sub.add_parser("normalize", help="print a text with its split words repaired")
    n.add_argument("path", help="a file, or - for standard input")
    for q in (sub.choices["index"], sub.choices["update"], e, n):
        q.add_argument("--words", help="a list of words, one a line; extract tells of text of low quality by it")
    c = sub.add_parser("config", help="settings and where they come from; with a value, put it into the project's file")
    c.add_argument("key", nargs="?")
    c.add_argument("value", nargs="?")
    a = p.parse_args(argv)
    settings = Settings({"index.path": a.index} if a.index else {}, project=a.project)
    if a.command == "config" and a.value is not None:
        if not a.project or "." not in a.key:
            print("a setting is put as section.name into the file that --project names", file=sys.stderr)
            return 2
        save(a.project, read_file(a.project, None) | {a.key: a.value})
        return 0
    if a.command == "config":
        for k in [a.key] if a.key else sorted(settings.all):
            print(f"{k} = {settings.get(k)}  ({settings.source(k)})")
        return 0
    if a.command == "extract":
        return _extract(a)
    if a.command == "normalize":
        from .functions.dictionary import normalize

        spark = _spark()
        text = _bytes(a.path).decode("utf-8", "replace")
        print(spark.createDataFrame([(text,)], "t string").select(normalize(spark, "t", _words(a.words))).first()[0], end="")
        return 0
    from .plans.corpus import Corpus
    from .sources.embedder import first_available, usual_providers

    spark = _spark()
    corpus = Corpus.open(spark, settings.get("index.path") or "lectern-index")
    provider = None
    if a.command in ("index", "update", "search", "serve"):
        provider = first_available(usual_providers(*(settings.get(f"embedding.{k}") for k in ("url", "model", "key"))))
        if provider is None:
            print("no embedding service answers: words alone are indexed and searched", file=sys.stderr)
    if a.command in ("index", "update"):
        options = ChunkOptions(max_tokens=int(settings.get("chunk.max_tokens")), min_tokens=int(settings.get("chunk.min_tokens")))
        tally = corpus.index(a.path, provider, options, words=_words(a.words) if a.words else None)
        print(json.dumps(vars(tally)))
        return tally.exit_code
    if a.command == "search":
        rows = corpus.search(a.query, a.mode or settings.get("search.mode"), a.limit or int(settings.get("search.limit")), provider, format_filter=a.format)
        if a.pretty:
            for i, r in enumerate(rows.withColumn("snippet", snippet("text")).collect(), 1):
                print(f"{i}. {r['path']}  {r['score']:.4f}  {r['section_path'] or ''}\n   {r['snippet']}")
        else:
            print("\n".join(rows.toJSON().collect()))
    elif a.command == "serve":
        from .serve import Server

        Server(corpus, provider).run(sys.stdin, sys.stdout)
    elif a.command == "status":
        print(json.dumps(corpus.status()))
    elif a.command == "list":
        print("\n".join(corpus.list_documents().toJSON().collect()))
    elif a.command == "remove":
        corpus.remove(a.path)
    elif a.command == "read":
        print(json.dumps(corpus.read_chunk(a.chunk)))
    return 0


def pages_between(sections: list, first: int | None, last: int | None) -> list:
    """Sections whose page (logical, else physical, else their place) lies in the range; one that
    doesn't takes those below it along."""
    out, gone = [], set()
    for i, s in enumerate(sections):
        page = s.page_logical or s.page_physical or i + 1
        if s.parent in gone or not (first or 1) <= page <= (last or 1 << 30):
            gone.add(i)
        else:
            out.append(s)
    return out


#: Printed books reach 80 and more.  Fixed value.
LOW_QUALITY = 60


def _bytes(path: str) -> bytes:
    return sys.stdin.buffer.read() if path == "-" else Path(path).read_bytes()


def _words(path: str | None):
    from .functions.dictionary import Words

    words = Path(path).read_text().split() if path else []
    return Words((w for w in words if w[0].islower()), (w for w in words if not w[0].islower()))


def _extract(a: argparse.Namespace) -> int:
    from .functions.text import FORMATS
    from .sources.parsers import parse_bytes, plain_text

    raw = _bytes(a.path)
    fmt = a.format or FORMATS.get(a.path.rsplit(".", 1)[-1].lower())
    if fmt is None:
        print("the format isn't known: use --format", file=sys.stderr)
        return 2
    d = parse_bytes(fmt, raw)
    if d.error:
        print(d.error, file=sys.stderr)
        return 1
    found = pages_between(d.sections, a.from_page, a.to_page)
    if a.words:
        from .functions.dictionary import text_quality

        spark = _spark()
        quality = spark.createDataFrame([(plain_text(d.sections),)], "t string").select(text_quality(spark, "t", _words(a.words))).first()[0]
        if quality < LOW_QUALITY:
            print(f"the text's quality is low: {quality} of 100", file=sys.stderr)
    if a.form == "json":
        print(json.dumps({"title": d.title, "metadata": d.metadata, "sections": [vars(s) for s in found]}, ensure_ascii=False))
    elif a.form == "markdown":
        print("\n\n".join("\n\n".join(x for x in (f"{'#' * max(1, s.level)} {s.heading}" if s.heading else "", s.content) if x) for s in found))
    else:
        print(plain_text(found), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
