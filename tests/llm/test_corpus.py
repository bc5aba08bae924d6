"""Operators that ask the whole corpus, and the archive writer, against plain versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lectern.llm import blocks, interpolation, substring, warc
from lectern.scratch import fresh_path
from tests.llm.conftest import PASSAGE, prose, rows

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def plain_repeats(data, w=20):
    key = lambda i: substring.NONE if i is None else i
    docs = [(key(i), (t or "").encode().split()) for i, t in data]
    first = {}
    for i, ws in sorted(docs, key=lambda d: d[0]):
        for s in range(len(ws) - w + 1):
            k = tuple(ws[s : s + w])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for (i, ws), (doc, _) in zip(docs, data):
        gone = [False] * len(ws)
        for s in range(len(ws) - w + 1):
            if first[tuple(ws[s : s + w])] < (i, s):
                gone[s : s + w] = [True] * w
        out.append((doc, len(ws), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(ws, gone) if not g)).hexdigest()))
    return out


def order(rows_):
    return sorted(rows_, key=lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r))


def test_substring(docs, empty):
    got = [tuple(r) for r in substring.self_repeats(docs, substring._digests, SCHEMA).collect()]
    assert order(got) == order(plain_repeats([(r[0], r[1]) for r in rows()]))
    assert substring.self_repeats(empty, substring._digests, SCHEMA).count() == 0


def test_substring_sql(docs, tmp_path):
    one = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    one.write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    got = [tuple(r) for r in substring.self_repeats(one, substring._digests, SCHEMA).collect()]
    assert sorted(c.sql(substring.OP10_SQL).fetchall()) == sorted(got)


def test_substring_periodic_and_hot(spark):
    line = prose(50, 25)
    data = [(i, (prose(i, 30) + " " if i % 3 else "") + PASSAGE + (" " + line) * (i % 4) + " " + prose(1000 + i % 5, 40)) for i in range(150)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in substring.self_repeats(df, substring._digests, SCHEMA).collect()]
    assert order(got) == order(plain_repeats(data))


def test_substring_hot_minimizers(spark, monkeypatch):
    """Windows of frequent minimizers go one by one; the rows are the same."""
    line = prose(50, 25)
    data = [(i, prose(i % 7, 60) + (" " + PASSAGE if i % 2 else "") + (" " + line) * (i % 5)) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for hot in (2, 20):
        monkeypatch.setattr(substring, "HOT", hot)
        assert order([tuple(r) for r in substring.self_repeats(df, substring._digests, SCHEMA).collect()]) == order(plain_repeats(data))


def test_minimizers_fill_all_shards():
    b = substring._Block([prose(i, 400).encode() for i in range(60)], 20)
    counts = np.bincount((b.run_key >> np.uint64(59)).astype(int), minlength=32)
    assert counts.max() < 2 * counts.mean() and counts.min() > counts.mean() / 2


def test_words_of_a_block():
    texts = [b"", b" a\tb  c\n", "é漢 x\x00y\x1cz".encode(), b"y" * (blocks.LONG + 9) + b" " + b"y" * (blocks.LONG + 9) + b" tail", b"\v", prose(3, 90_000).encode() + b" tail"]
    b = blocks.Words(texts)
    want = [t.split() for t in texts]
    assert [[b.raw[s:e] for s, e in zip(b.starts[x:y], b.ends[x:y])] for x, y in zip(b.begins, b.finals)] == want
    words = [w for ws in want for w in ws]
    assert len(set(b.hashes.tolist())) == len(set(words)) == len(set(zip(words, b.hashes.tolist())))
    assert [b.joined(x, y) for x, y in zip(b.begins, b.finals)] == [b" ".join(ws) for ws in want]


def test_remove_repeats(docs):
    out = substring.remove_repeats(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    assert PASSAGE in got[8]["text"] and PASSAGE not in got[9]["text"] and prose(4, 50) in got[9]["text"]
    assert got[1]["text"] == "" and got[1]["n_chars"] == 0 and got[0]["text"] == rows()[0][1]
    texts = [b"a b  c\nd", b" e\tf\n"]
    assert substring.without(texts, blocks.Words(texts), np.array([False, True, False, True, False, False])) == [b"a c\n", texts[1]]


def test_automaton():
    text = [1, 2, 3, 1, 2, 4, 1, 2, 3, 5]
    a = substring.Automaton()
    for w in text:
        a.add(w)
    state = size = 0
    sizes = []
    for w in [1, 2, 3, 9, 2, 4, 1, 2, 3, 5]:
        state, size = a.step(state, size, w, 99)
        sizes.append(size)
    assert sizes == [1, 2, 3, 0, 1, 2, 3, 4, 5, 6]


def test_against_reference(spark, docs):
    ref = spark.createDataFrame([(PASSAGE,), (None,)], "text string")
    got = sorted(tuple(r) for r in substring.against_reference(docs, ref).collect())
    assert got == [(8, 40, 60), (9, 0, 60)]
    with pytest.raises(ValueError):
        substring.against_reference(docs, ref, max_bytes=10)


def test_interpolation(docs, empty):
    data = rows()
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    tokens = [((r[1] or "").encode().lower().split() + [None]) for r in data]
    c = Counter(t for r, ts in zip(data, tokens) if fold(r[0]) != 2 for t in ts)
    n, v = sum(c.values()), len(c)
    want = [(r[0], fold(r[0]) == 2, len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 6)) for r, ts in zip(data, tokens)]
    got = interpolation.score(docs).collect()
    assert order([(*tuple(r)[:5], round(r["base_score"], 6)) for r in got]) == order(want)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert interpolation.score(empty).count() == 0


def test_interpolation_beats_base(spark):
    data = [(i, prose(i % 40, 80)) for i in range(300)]
    got = interpolation.score(spark.createDataFrame(data, "doc_id long, text string")).collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def plain_scores(data, held=2, deleted=3):
    """Scores by plain dictionaries and an EM over every single held-out token."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    texts = [(fold(i), [*t.lower().split(), None]) for i, t in data]

    def counts(folds):
        some = [ts for f, ts in texts if f in folds]
        ones = Counter(t for ts in some for t in ts)
        return ones, Counter(p for ts in some for p in zip(["<s>", *ts], ts)), len(some)

    c1, c2, starts = counts(set(range(7)) - {held})
    d1, d2, less = counts(set(range(7)) - {held, deleted})
    n, v, m = sum(c1.values()), len(c1), sum(d1.values())
    bucket = lambda c: math.ceil(math.log2(c + 1)) if c else 0
    events = defaultdict(list)
    for f, ts in texts:
        for before, t in zip(["<s>", *ts], ts) if f == deleted else ():
            context = less if before == "<s>" else d1[before]
            p2 = d2[before, t] / context if context else 0.0
            events[-1 if before == "<s>" else bucket(context)].append((min(p2, 1.0), d1[t] / m, 1 / (v + 1)))
    weights = {}
    for b, ps in events.items():
        ps, w = np.array(ps), np.array([0.4, 0.4, 0.2])
        for _ in range(40):
            part = w * ps
            w = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
        w = np.maximum(w, 1e-6)
        weights[b] = w / w.sum()

    def of(b):
        lower = [x for x in weights if 0 < x < b]
        return weights[b] if b in weights else weights[max(lower)] if lower else weights[max(weights)] if b else (0.0, 0.5, 0.5)

    out = {}
    for (i, _), (_, ts) in zip(data, texts):
        total = 0.0
        for before, t in zip(["<s>", *ts], ts):
            context = starts if before == "<s>" else c1[before]
            w = weights[-1] if before == "<s>" else of(bucket(context))
            total += math.log10(w[0] * c2[before, t] / max(1, context) + w[1] * c1[t] / n + w[2] / (v + 1))
        out[i] = total
    return out


def test_interpolation_scores_by_plain_counts(spark):
    """Histogram bins move a weight a little; the scores stay within half a hundredth."""
    draw = np.random.default_rng(5)
    data = [(i, " ".join(f"w{x}" for x in draw.zipf(1.4, 70) % 500)) for i in range(250)]
    want = plain_scores(data)
    got = interpolation.score(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(got) == len(data) and all(abs(r["score"] - want[r["doc_id"]]) <= 0.005 * abs(want[r["doc_id"]]) for r in got)


def test_weights_are_learned():
    bins = np.array([[3, 0, 10, 90], [3, 10**6, 10, 10]])
    l2, l1, l0 = interpolation.learn(bins, 1000, 100, 10)[3]
    assert l2 > 0.8 and abs(l2 + l1 + l0 - 1) < 1e-9


def test_packed_keys_and_counts():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        assert (blocks.unpack_keys(blocks.pack_keys(keys)) == keys).all()
        for ranges in (1, 8):
            starts = blocks.range_starts(keys, ranges)
            assert starts[0] == 0 and starts[-1] == len(keys)
        counts = r.integers(0, 400, n)
        assert (blocks.unpack_counts(blocks.pack_counts(counts), n) == counts).all()


def test_warc(spark):
    big = "<p>" + "same " * 400
    data = [(1, "http://a/1", big), (2, "http://a/2", "small"), (3, None, big), (4, "http://a/4", None), (5, "http://a b/5", "small"), (None, "http://a/n", big), (9, "u", big), (9, "u", big), (7, "u", "é" * 600)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    path = fresh_path(spark, "warc")
    manifest = warc.write_archive(df, path, shard_bytes=3000, roll_bytes=300).collect()
    assert len(manifest) > 2 and sum(r["records"] for r in manifest) == len(data) and len({r["name"] for r in manifest}) == len(manifest)
    got = order(tuple(r) for r in warc.read_archive(spark, path).collect())
    want, seen = [], set()
    for i, _, h in data:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and h == big and (i != 9 or 9 in seen)
        seen.add(i)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert got == order(want)
    again = fresh_path(spark, "warc")
    other = warc.write_archive(df.repartition(5), again, shard_bytes=3000, roll_bytes=300).collect()
    assert sorted((r["name"], r["sha256"]) for r in other) == sorted((r["name"], r["sha256"]) for r in manifest)


def test_warc_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    name = warc.write_archive(df, path).first()["name"]
    raw = bytearray((tmp_path / "w" / name).read_bytes())
    (tmp_path / "w" / name).write_bytes(raw[:-9])
    with pytest.raises(Exception, match="ends within|differs"):
        warc.read_archive(spark, path).collect()


def test_warc_empty(spark):
    path = fresh_path(spark, "warc")
    assert warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path).count() == 0
    assert warc.read_archive(spark, path).count() == 0


def test_pipeline_stages(spark, docs, empty):
    import corpus_pipeline

    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, d, "").write.parquet(path)
        d = spark.read.parquet(path)
        assert d.columns == docs.columns
    ids = defaultdict(int)
    for r in d.collect():
        ids[r["doc_id"]] += 1
    assert set(ids) == {1, 3, 8, 9, 11, 14, 15} and set(ids.values()) == {1}
    pieces = corpus_pipeline.STAGES[-1][1](spark, d, "").collect()
    assert {p["doc_id"] for p in pieces} == set(ids)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
