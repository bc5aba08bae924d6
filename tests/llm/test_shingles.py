import random

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import shingles, simhash
from lectern.llm.components import components
from lectern.scratch import write_table
from tests.llm.conftest import prose, rows
from tests.llm.test_simhash import brute_components


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def plain_components(data):
    sets = [grams(t) for _, t in data]
    return brute_components([i for i, _ in data], sets, lambda a, b: similar(sets[a], sets[b]))


def edited():
    """Copies with words, a block or an end replaced or appended, on both sides of a similarity of 0.8."""
    r, out = random.Random(8), []
    for base in range(40):
        words = prose(2000 + base, r.choice((60, 200, 600))).split()
        out.append(words)
        for k in range(4):
            other = prose(3000 + 10 * base + k, len(words)).split()
            n = max(1, int(len(words) * r.uniform(0.02, 0.2)))
            at = r.randrange(len(words) - n)
            single = [other[i] if i in set(r.sample(range(len(words)), max(1, n // 5))) else w for i, w in enumerate(words)]
            out.append([words + other[:n], words[:at] + other[:n] + words[at + n :], words[:-n], single][k])
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_all_pairs_are_found_and_confirmed(spark):
    data = edited()
    sets = [grams(t) for _, t in data]
    assert 40 < sum(similar(a, b) for i, a in enumerate(sets) for b in sets[:i]) < 400
    want = dict(zip((i for i, _ in data), plain_components(data)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near(spark, df, "").collect())
    assert kept == sorted(set(want.values()))
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(df).collect()} == want


def test_buckets_of_many_components(spark):
    """Texts around one passage: candidates of each other, similar in small groups only."""
    words = prose(77, 150).split()
    data = []
    for g in range(30):
        r = random.Random(g)
        base = [w if r.random() > 0.04 else w + "x" for w in words]
        data += [(10 * g + k, " ".join(base[:-1] + [f"end{k}"])) for k in range(3)]
    want = dict(zip((i for i, _ in data), plain_components(data)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(df).collect()} == want


def test_large_bucket_meets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(shingles, "PART", 7)
    test_buckets_of_many_components(spark)


def test_odd_rows(docs, empty):
    data = rows()
    want = plain_components([r[:2] for r in data])
    order = lambda x: tuple((v is None, v or 0) for v in x)
    got = [tuple(r)[:2] for r in shingles.near_duplicates(docs).collect()]
    assert sorted(got, key=order) == sorted(((r[0], c) for r, c in zip(data, want)), key=order)
    assert shingles.near_duplicates(empty).count() == 0 and shingles.one_of_each(empty).count() == 0
    assert shingles.one_of_each(docs).columns == docs.columns


def within_three_bits(data):
    """Pairs whose fingerprints over their shingle sets differ in three bits or fewer."""
    fps = [simhash.majority(shingles.shingle_set(t.encode()).byteswap().tobytes()) for _, t in data]
    return lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3


def component_of(links, data):
    least = {r["node"]: r["root"] for r in components(links).distinct().collect()} if links is not None else {}
    node = [xxhash.xxh64_intdigest(shingles.shingle_set(t.encode()).tobytes(), 7) for _, t in data]
    node = [n - 2**64 if n >= 2**63 else n for n in node]
    first = {}
    return [first.setdefault(least.get(n, n), i) for n, (i, _) in zip(node, data)]


def test_covering_tables_and_bands_have_pairs_of_their_own(spark, monkeypatch):
    """Without a band the tables link all pairs within three bits that the sets confirm; without the tables the bands link the others alone."""
    data = []
    for g in range(12):
        words = prose(500 + g, 250).split()
        data += [(10 * g + k, " ".join(words[:at] + [f"new{k}"] * (k > 0) + words[at:])) for k, at in enumerate((0, 40, 110, 245))]
    sets, close = [grams(t) for _, t in data], within_three_bits(data)
    confirmed = lambda a, b: similar(sets[a], sets[b])
    of = lambda test: brute_components([i for i, _ in data], sets, test)
    tables, bands = of(lambda a, b: close(a, b) and confirmed(a, b)), of(lambda a, b: not close(a, b) and confirmed(a, b))
    both = of(confirmed)
    assert tables != both and bands != both and len(set(tables)) < len(data)

    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    rows = write_table(shingles.signatures(df), "signatures")
    assert component_of(shingles.similar_links(df, rows.withColumn("bands", F.array().cast("array<bigint>")), (4, 5)), data) == tables
    assert component_of(shingles.similar_links(df, rows, (4, 5)), data) == both
    monkeypatch.setattr(shingles, "covering_keys", lambda fp, radius: F.array().cast("array<bigint>"))
    assert component_of(shingles.similar_links(df, rows, (4, 5)), data) == bands
