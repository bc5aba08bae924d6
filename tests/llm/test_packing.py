import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from lectern.llm.packing import Schedule, pack
from lectern.llm.vocab import byte_level, piece_ids, sentencepiece_cache, vocabulary_path
from tests.llm.conftest import prose, rows


def check(pieces, texts, length=1024):
    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts}
    at, by = {}, {}
    for p in pieces:
        assert p["doc_tokens"] == len(want[p["doc_id"]])
        ids = np.array(want[p["doc_id"]][p["start"] : p["start"] + p["length"]], dtype="<u4")
        assert zlib.crc32(ids.tobytes()) == p["ids_crc32"]
        by.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        at.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for i, spans in by.items():
        assert sum(n for _, n in spans) == len(want[i])
        end = 0
        for s, n in sorted(spans):
            assert s == end
            end = s + n
    assert sorted(at) == list(range(len(at)))
    for s, spans in at.items():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end = o + n
        assert end == length or s == len(at) - 1


def test_pieces(spark):
    data = {r[0]: r for r in rows() if r[0] is not None}
    df = spark.createDataFrame([(r[0], r[1], r[3]) for r in data.values()], "doc_id long, text string, source string").repartition(3)
    check(pack(df).collect(), [(r[0], r[1]) for r in data.values()])
    with_every_source = df.withColumn("source", df["doc_id"].cast("int"))
    check(pack(with_every_source).collect(), [(r[0], r[1]) for r in data.values()])


def test_windows_of_the_output_keep_proportions(spark):
    """A third of all rows in one source, sources of another type, texts dealt unevenly over partitions."""
    data = [(i, prose(i, 300), 0 if i % 3 == 0 else i % 40) for i in range(900)]
    pieces = pack(spark.createDataFrame(data, "doc_id long, text string, source int").repartitionByRange(5, "source"), length=256).collect()
    total, by = Counter(), {}
    for p in pieces:
        total[p["queue"]] += p["length"]
        window = (p["sequence_id"] * 256 + p["offset"]) // (256 * 160)
        by.setdefault(window, Counter())[p["queue"]] += p["length"]
    n, whole = sum(total.values()), sorted(by)[:-1]
    assert len(total) == 40 and len(whole) >= 8
    for w in whole:  # a piece may reach over a window's end by its own length
        assert all(abs(by[w][q] - 256 * 160 * t / n) <= 256 + 40 for q, t in total.items())


def test_edges(docs, empty):
    assert pack(empty).count() == 0
    out = pack(docs)
    assert out.selectExpr("sum(length)").first()[0] == sum(len(byte_level().ids(r[1] or "")) // 2 + 1 for r in rows())


def test_windows_keep_proportions():
    s = Schedule([5000, 3000, 2000], None, 100)
    for w in range(1, 100):
        a, b = s.served(w - 1), s.served(w)
        assert all(abs(y - x - q) <= 1 for x, y, q in zip(a, b, (50, 30, 20)))
    s = Schedule([100, 1000], [1, 1], 10)  # the first runs dry after 20 windows
    assert s.served(20) == [100, 100] and s.served(30) == [100, 200] and s.served(200) == [100, 1000]
    spots = sorted(p + k for q, n in ((0, 100), (1, 1000)) for _, size, p in s.runs(q, 0, n) for k in range(size))
    assert spots == list(range(1100))
    with pytest.raises(ValueError):
        Schedule([1, 1], [1, 0], 10)


@pytest.mark.parametrize("text", ["", " ", "a b", "a  b", " a", "a ", "a \n b", "a\n \nb", "x  y", "é漢 😀▁ ▁a", "<|endoftext|> a", "don't  we'll 12 3.4"])
def test_cached_ids_are_the_tokenizers(text):
    import sentencepiece

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    assert np.frombuffer(byte_level().ids(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids
    path = vocabulary_path("piece_bpe_32k.model")
    assert piece_ids(sentencepiece_cache(path), text).tolist() == sentencepiece.SentencePieceProcessor(model_file=path).encode(text)
