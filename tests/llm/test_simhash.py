import random
from collections import Counter

import numpy as np
import xxhash

from lectern.llm import simhash
from tests.llm.conftest import rows


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if len(words) > 2 else [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, near):
    up = list(range(len(ids)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(ids)):
        for b in range(a):
            if near(a, b):
                up[find(a)] = find(b)
    out = {}
    for a in range(len(ids)):
        out.setdefault(find(a), []).append(ids[a])
    least = {r: min((i for i in x if i is not None), default=None) for r, x in out.items()}
    return [least[find(a)] for a in range(len(ids))]


def test_masks_cover_every_pair():
    for radius in (1, 2, 3, 6):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 2 and {bin(m).count("1") for m in masks} == {32}
        r = random.Random(radius)
        for _ in range(2000):
            diff = sum(1 << i for i in r.sample(range(64), radius))
            assert any(diff & m == 0 for m in masks)


def test_fingerprints():
    for r in rows():
        if len(r[1] or "") < 10_000:
            assert simhash.fingerprint((r[1] or "").encode()) == brute_fingerprint(r[1])


def test_near_duplicates(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    data = rows()
    fps = [simhash.fingerprint((r[1] or "").encode()) for r in data]
    want = brute_components([r[0] for r in data], fps, lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3)
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=order) == sorted(((r[0], c) for r, c in zip(data, want)), key=order)
    assert simhash.near_duplicates(empty).count() == 0


def test_links_against_all_pairs(spark):
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(300)]
    for f in list(fps[:100]):
        for _ in range(3):
            fps.append(f ^ sum(1 << i for i in r.sample(range(64), r.randint(1, 5))))
    fps = sorted(set(fps))
    want = brute_components(fps, fps, lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, 0) for f in fps], "fp long, second long")
    links = [(int(np.uint64(x["fu"] % 2**64)), int(np.uint64(x["fv"] % 2**64))) for x in simhash.near_links(df).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
    pairs = {frozenset(x) for x in links}
    assert brute_components(fps, fps, lambda a, b: frozenset((fps[a], fps[b])) in pairs) == want


def test_finer_masks_cover_and_split():
    r = random.Random(9)
    for m in simhash.covering_masks(3):
        finer = simhash.finer_masks(m, 3)
        assert len(finer) == 14 and {bin(x).count("1") for x in finer} == {48} and all(x & m == m for x in finer)
        left = [i for i in range(64) if not m >> i & 1]
        for _ in range(300):  # a pair that agrees on the table's bits
            diff = sum(1 << i for i in r.sample(left, 3))
            assert any(diff & x == 0 for x in finer)


def test_large_bucket_is_dealt_again(spark, monkeypatch):
    """The same components, by fewer comparisons, though one table's bucket holds all fingerprints."""
    r = random.Random(4)
    mask = simhash.covering_masks(3)[0]
    left = [i for i in range(64) if not mask >> i & 1]
    fps = sorted({sum(1 << i for i in left if r.random() < 0.5) for _ in range(600)})
    fps = sorted({*fps, *(f ^ 1 << r.choice(left) ^ 1 << r.choice(left) for f in fps[:200])})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, 0) for f in fps], "fp long, second long")
    want = brute_components(fps, fps, lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3)
    finer = simhash.finer_masks(mask, 3)
    assert sum(n * n for m in finer for n in Counter(f & m for f in fps).values()) < len(fps) ** 2 / 10
    for whole in (10, 10**6):
        monkeypatch.setattr(simhash, "WHOLE", whole)
        pairs = {frozenset(int(np.uint64(v % 2**64)) for v in (x["fu"], x["fv"])) for x in simhash.near_links(df).collect()}
        assert brute_components(fps, fps, lambda a, b: frozenset((fps[a], fps[b])) in pairs) == want


def test_null_ids_and_shared_ids_stay_apart(spark):
    a, b, c = "one text of its own here", "another text, not the same", "third and last of them all"
    df = spark.createDataFrame([(1, a), (None, a), (None, b), (2, c), (3, c), (3, b + " at all")], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.one_of_each(df).collect()) == sorted([a, b, c, b + " at all"])


def test_one_of_each(docs):
    out = simhash.one_of_each(docs, radius=6, verify_width=5, verify_radius=13)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert 0 in kept and 1 not in kept and 2 not in kept and kept.count(3) == 3
