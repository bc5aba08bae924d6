"""Substring dedup: suffix automata of reference shards, matching statistics of documents.

A suffix automaton recognises every substring of the text it was built from.  Streaming a
document through it gives, for each word, the length of the longest suffix that the
reference contains (matching statistics); wherever that reaches the threshold, the last
``window`` words are a repeat, and the automaton's state tells where they first occurred.

Against a bounded reference (:func:`against_reference`) the automata of the reference's shards
are broadcast and documents stream past them.  A corpus compared with itself
(:func:`self_repeats`) has no bound to broadcast by, and every document against every shard would
be quadratic.  There, each window goes by its minimizer, the least hash among its runs of
``PROBE`` words, to the one shard that can hold its equals: equal windows have equal
minimizers.  Only windows whose minimizer is found at least twice in the corpus travel, in
pieces of text that share one, and equal pieces of one block travel once, with the first place
they occur at.  A shard builds an automaton for each minimizer, adding its pieces in the order of
their places, so that the state of a window names its first occurrence; a piece that meets
no other text has nothing to be streamed against.  The windows of a minimizer found more than
``HOT`` times are dealt one by one, by the hash of all their words: no automaton grows beyond some
``HOT`` pieces, and a passage that a third of all rows hold is one row for each block.

Words are compared as such where pieces meet.  Two windows of different words could only be
taken for one if 64-bit hashes of words agreed within one block of 8 MB: some 1e-9 for a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import U8, Words, block_count, mix, pack_keys, power_of_two, range_starts, to_blocks, unpack_keys
from .common import partitions, raw_texts, released, table

BLOCK_BYTES = 8 << 20
PROBE = 6  # words of a minimizer
HOT = 1024  # occurrences above which a minimizer's windows are dealt one by one
NONE = 2**63 - 1  # stands for a null id: behind all others


class Automaton:
    """Suffix automaton over integer words, online, with the first end of every state's strings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.last = 0
        self.size = 0

    def add(self, word: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[self.last] + 1)
        first.append(self.size)
        self.size += 1
        p = self.last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                c = len(nxt)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p >= 0 and nxt[p].get(word) == q:
                    nxt[p][word] = c
                    p = link[p]
                link[q] = link[cur] = c
        self.last = cur

    def step(self, state: int, size: int, word: int, most: int) -> tuple[int, int]:
        """The longest known suffix, of at most ``most`` words, after one more word."""
        nxt, link, length = self.next, self.link, self.length
        while state and word not in nxt[state]:
            state = link[state]
            size = length[state]
        state = nxt[state].get(word, 0)
        size = size + 1 if state else 0
        if size > most:
            size = most
        if size == most:
            while length[link[state]] >= most:
                state = link[state]
        return state, size


def first_places(stretches: Iterable[tuple[int, int, list[int]]], window: int) -> Iterator[list[tuple[int, int]]]:
    """For (id, start, words) in ascending order: the first (id, start) of each window of each stretch."""
    a = Automaton()
    ids: list[tuple[int, int]] = []  # place of each word in the automaton's text
    mark = -1
    for doc, start, words in stretches:
        state = size = 0
        out: list[tuple[int, int]] = []
        done = -1  # words of this stretch before it are in the automaton's last run
        nxt, link, length = a.next, a.link, a.length
        for i, w in enumerate(words):
            while state and w not in nxt[state]:  # as Automaton.step
                state = link[state]
                size = length[state]
            state = nxt[state].get(w, 0)
            size = size + 1 if state else 0
            at = i - window + 1
            if at < 0:
                continue
            if size >= window:
                size = window
                while length[link[state]] >= window:
                    state = link[state]
            if size == window:
                out.append(ids[a.first[state] - window + 1])
                continue
            out.append((doc, start + at))
            if at > done:  # a sign of its own parts what isn't one stretch
                if a.size:
                    a.add(mark)
                    ids.append((-1, -1))
                    mark -= 1
                done = at
            for k in range(done, i + 1):
                a.add(words[k])
                ids.append((doc, start + k))
            done = i + 1
            state, size = a.last, window
            while a.length[a.link[state]] >= window:
                state = a.link[state]
        yield out


class _Block(Words):
    """Runs of windows with one minimizer, over all texts of a block."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        super().__init__(texts)
        self.window = window
        total = len(self.hashes)
        m = total - window + 1
        if m <= 0:
            self.run_key, self.run_doc, self.run_at, self.run_n, self.run_hits = np.empty(0, U8), *[np.empty(0, np.int64)] * 4
            return
        h = np.zeros(total - PROBE + 1, U8)
        for k in range(PROBE):
            h = mix(h + self.hashes[k : k + len(h)])
        need, have, least = window - PROBE + 1, 1, h
        while have < need:  # the least of `need` hashes in a row, by doubling
            more = min(have, need - have)
            least = np.minimum(least[: len(least) - more], least[more:])
            have += more
        of = np.repeat(np.arange(len(texts), dtype=np.int32), self.finals - self.begins)[:m]
        at = np.flatnonzero(np.arange(window, m + window) <= self.finals[of])
        key, of = least[at], of[at]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        starts = np.flatnonzero(new)
        key, self.run_doc, self.run_at = key[starts], of[starts].astype(np.int64), at[starts]
        self.run_n = np.diff(np.append(starts, len(at)))  # windows of each run
        self.run_key = mix(key)  # least hashes crowd at zero; scrambled they fill all ranges alike
        if not len(starts):
            self.run_hits = np.empty(0, np.int64)
            return
        span = self.run_n + need - 1  # a text can repeat within one run: how often the minimizer comes there
        opens = np.cumsum(span) - span
        places = np.arange(int(span.sum())) - np.repeat(opens - self.run_at, span)
        self.run_hits = np.add.reduceat((h[places] == np.repeat(key, span)).astype(np.int64), opens)

    def pieces(self, told: pa.Table, ranges: int) -> list[tuple[int, int, int, int, bool]]:
        """(key, text, place, windows, whether none of them can repeat within it) of each run of a minimizer found
        more than once, by place; those of a hot minimizer as single windows, by the hash of all their words."""
        keys = np.unique(self.run_key)
        many, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        starts = range_starts(keys, ranges).tolist()
        for bucket, one, two in zip(*(told.column(c).to_pylist() for c in ("bucket", "many", "hot"))):
            s, e = starts[bucket], starts[bucket + 1]
            many[s:e] = np.unpackbits(np.frombuffer(one, np.uint8), count=e - s)
            hot[s:e] = np.unpackbits(np.frombuffer(two, np.uint8), count=e - s)
        where = np.searchsorted(keys, self.run_key)
        r = np.flatnonzero(many[where] & ~hot[where]) if len(keys) else np.empty(0, np.int64)
        cols = [self.run_key[r], self.run_doc[r], self.run_at[r], self.run_n[r], self.run_hits[r] == 1]
        r = np.flatnonzero(hot[where]) if len(keys) else r
        if len(r):
            n = self.run_n[r]
            at = np.repeat(self.run_at[r] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            key = np.zeros(len(at), U8)
            for k in range(self.window):
                key = mix(key + self.hashes[at + k])
            more = [mix(key), np.repeat(self.run_doc[r], n), at, np.ones(len(at), np.int64), np.ones(len(at), bool)]
            cols = [np.concatenate(x) for x in zip(cols, more)]
        order = np.argsort(cols[2], kind="stable")
        return list(zip(*(c[order].tolist() for c in cols)))

    def numbered(self, pieces: list[tuple[int, int, int, int, bool]]) -> list[int]:
        """The number of each piece's content, counted by first occurrence (ids ascend within a block)."""
        seen: dict[tuple[int, bytes], int] = {}
        raw, more = self.hashes.tobytes(), self.window - 1
        return [seen.setdefault((key, raw[8 * at : 8 * (at + n + more)]), len(seen)) for key, _, at, n, _ in pieces]


def _collected(t: pa.Table) -> tuple[pa.Table, list[int], list[bytes]]:
    """The rows by id and text, their ids and their texts."""
    ids = [NONE if i is None else i for i in t.column("doc_id").to_pylist()]
    texts = raw_texts(t.column("text"))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return t.take(pa.array(order, pa.int64())), [ids[i] for i in order], [texts[i] for i in order]


def _table(rows: list[tuple], names: list[str], kinds: tuple[pa.DataType, ...]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


def self_repeats(docs: DataFrame, finish: Callable[[pa.Table, list[bytes], Words, np.ndarray], pa.Table], schema, window: int = 20, id_col: str = "doc_id", text_col: str = "text", rest: list[str] | None = None) -> DataFrame:
    """``finish(rows, texts, words, repeated)`` for the documents of each block, as rows of ``schema``.

    ``rows`` has ``doc_id``, ``text`` and, if ``rest`` names columns, a struct ``rest`` of them.

    ``repeated`` marks the words of every window whose words also start earlier: in a document
    with a smaller id, or earlier in the same one.  Null and empty texts have no words; texts
    shorter than a window repeat nothing; a null id counts as larger than all others; rows
    that share an id are one document, so of two of them a window repeats where it starts later;
    an empty table gives an empty result.
    """
    n = block_count(docs, text_col, BLOCK_BYTES)
    ranges = power_of_two(max(partitions(docs.sparkSession), n // 4))
    rows = to_blocks(docs, n, id_col, text_col, rest)

    def ask(t: pa.Table) -> pa.Table:
        _, _, texts = _collected(t)
        b = _Block(texts, window)
        keys, at = np.unique(b.run_key, return_inverse=True)
        times = np.minimum(np.bincount(at, weights=b.run_hits, minlength=len(keys)), 65535).astype("<u2")
        starts = range_starts(keys, ranges).tolist()
        block = t.column("block")[0].as_py()
        out = [(k, block, pack_keys(keys[s:e]), times[s:e].tobytes()) for k, (s, e) in enumerate(zip(starts, starts[1:])) if e > s]
        return released(_table(out, ["bucket", "block", "keys", "times"], (pa.int32(), pa.int32(), pa.binary(), pa.binary())))

    def answer(t: pa.Table) -> pa.Table:
        keys = [unpack_keys(k) for k in t.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        times = np.frombuffer(b"".join(t.column("times").to_pylist()), "<u2")
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=times)[at]
        ends = np.cumsum(sizes)
        bits = [[np.packbits(x[e - m : e]).tobytes() for e, m in zip(ends, sizes)] for x in (total > 1, total > HOT)]
        return released(pa.table([t.column("block"), t.column("bucket"), *(pa.array(x, pa.binary()) for x in bits)], names=["block", "bucket", "many", "hot"]))

    def send(t: pa.Table, told: pa.Table) -> pa.Table:
        names, kinds = ["shard", "block", "key", "number", "id", "start", "single", "words"], (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        if not t.num_rows:
            return _table([], names, kinds)
        _, known, texts = _collected(t)
        b = _Block(texts, window)
        pieces = b.pieces(told, ranges)
        block, out = t.column("block")[0].as_py(), []
        shift = 65 - ranges.bit_length()
        for (key, doc, at, m, single), number in zip(pieces, b.numbered(pieces)):
            if number == len(out):  # the first piece with this content
                out.append((key >> shift, block, key - 2**63, number, known[doc], at - int(b.begins[doc]), single, b.joined(at, at + m + window - 1)))
        return released(_table(out, names, kinds))

    def compare(t: pa.Table) -> pa.Table:
        """One shard: the first place of each window of each piece, as runs of (windows, id, start)."""
        cols = [t.column(c).to_numpy() for c in ("key", "id", "start", "block", "number")]
        order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
        key, ids, starts = cols[0][order], cols[1][order].tolist(), cols[2][order].tolist()
        words = [t.column("words")[i].as_py() for i in order.tolist()]
        single = t.column("single").to_numpy()[order].tolist()
        edges = np.flatnonzero(np.diff(key)) + 1
        out_places: list[bytes] = []
        for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(key)]):
            first: dict[bytes, int] = {}  # the same piece from several blocks is streamed once
            for i in range(a, z):
                first.setdefault(words[i], i)
            if len(first) == 1 and single[a]:  # nothing else to stream: each window is first where the piece is
                out_places += [np.array([words[a].count(b" ") + 2 - window, ids[a], starts[a]], "<i8").tobytes()] * (z - a)
                continue
            numbers: dict[bytes, int] = {}
            feed = ((ids[i], starts[i], [numbers.setdefault(x, len(numbers)) for x in w.split()]) for w, i in first.items())
            answers: dict[bytes, bytes] = {}
            for w, places in zip(first, first_places(feed, window)):
                runs = []
                for doc, at in places:
                    if runs and runs[-1][1] == doc and runs[-1][2] + runs[-1][0] == at:
                        runs[-1][0] += 1
                    else:
                        runs.append([1, doc, at])
                answers[w] = np.array(runs, "<i8").tobytes()
            out_places += [answers[words[i]] for i in range(a, z)]
        return released(pa.table([pa.array(cols[3][order], pa.int32()), pa.array(cols[4][order], pa.int32()), pa.array(out_places, pa.binary())], names=["block", "number", "places"]))

    def cut(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return finish(t, [], Words([]), np.empty(0, bool))
        ordered, known, texts = _collected(t)
        b = _Block(texts, window)
        many, placed = (told.filter(pc.is_valid(told.column(c))) for c in ("many", "places"))
        pieces = b.pieces(many, ranges)
        places = dict(zip(placed.column("number").to_pylist(), placed.column("places").to_pylist()))
        mark = np.zeros(len(b.hashes) + 1, np.int64)
        for (_, doc, at, _, _), number in zip(pieces, b.numbered(pieces)):
            mine = (known[doc], at - int(b.begins[doc]))
            for count, first_doc, first_at in np.frombuffer(places[number], "<i8").reshape(-1, 3).tolist():
                if (first_doc, first_at) < mine:
                    mark[at] += 1
                    mark[at + count + window - 1] -= 1
                at += count
                mine = (mine[0], mine[1] + count)
        return released(finish(ordered, texts, b, np.cumsum(mark[:-1]) > 0))

    blocks = rows.groupBy("block")
    asked = blocks.applyInArrow(ask, "bucket int, block int, keys binary, times binary")
    told = asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, many binary, hot binary")
    sent = blocks.cogroup(told.groupBy("block")).applyInArrow(send, "shard int, block int, key long, number int, id long, start int, single boolean, words binary")
    compared = sent.groupBy("shard").applyInArrow(compare, "block int, number int, places binary")
    none = F.lit(None).cast("binary")
    both = told.select("block", "bucket", "many", "hot", F.lit(None).cast("int").alias("number"), none.alias("places")).unionAll(
        compared.select("block", F.lit(None).cast("int").alias("bucket"), none.alias("many"), none.alias("hot"), "number", "places")
    )
    return blocks.cogroup(both.groupBy("block")).applyInArrow(cut, schema)


def _spans(gone: np.ndarray, a: int, z: int) -> tuple[list[int], list[int]]:
    """The first words and the ends of the runs of words marked, of words a to z."""
    edge = np.diff(np.concatenate([[0], gone[a:z].view(np.int8), [0]]))
    return (np.flatnonzero(edge == 1) + a).tolist(), (np.flatnonzero(edge == -1) + a).tolist()


def _digests(rows: pa.Table, texts: list[bytes], b: Words, gone: np.ndarray) -> pa.Table:
    kept, removed = [], []
    for a, z in zip(b.begins.tolist(), b.finals.tolist()):
        firsts, ends = _spans(gone, a, z)
        parts = [b.joined(x, y) for x, y in zip([a, *ends], [*firsts, z]) if x < y]
        kept.append(hashlib.sha256(b" ".join(parts)).hexdigest())
        removed.append(sum(ends) - sum(firsts))
    data = [rows.column("doc_id"), pa.array(b.finals - b.begins, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
    return pa.table(data, names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def without(texts: list[bytes], b: Words, gone: np.ndarray) -> list[bytes]:
    """The texts without the words marked, each with the white space after it; what stays keeps its own."""
    out = []
    for text, offset, a, z in zip(texts, b.offsets.tolist(), b.begins.tolist(), b.finals.tolist()):
        firsts, ends = _spans(gone, a, z)
        if firsts:
            place = lambda i: int(b.starts[i]) - offset if i < z else len(text)  # noqa: B023, E731
            opens, stops = [0, *map(place, ends)], [*map(place, firsts), len(text)]
            text = b"".join(text[x:y] for x, y in zip(opens, stops))
        out.append(text)
    return out


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeats of :func:`self_repeats` cut out of the text; every row stays, with its
    other columns (``n_chars``, if there is one, is counted anew).  The id column becomes long."""
    cols = docs.columns
    rest = [c for c in cols if c not in (id_col, text_col)]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields} | {id_col: "bigint", text_col: "string"}
    if "n_chars" in rest:
        kinds["n_chars"] = "bigint"

    def finish(rows: pa.Table, texts: list[bytes], b: Words, gone: np.ndarray) -> pa.Table:
        left = pa.array([t.decode("utf-8", "replace") for t in without(texts, b, gone)], pa.string())
        held = rows.column("rest").combine_chunks() if rest else None
        data = {id_col: rows.column("doc_id"), text_col: left}
        for i, c in enumerate(rest):
            data[c] = pc.utf8_length(left).cast(pa.int64()) if c == "n_chars" else pc.struct_field(held, [i])
        return pa.table([data[c] for c in cols], names=cols)

    return self_repeats(docs, finish, ", ".join(f"`{c}` {kinds[c]}" for c in cols), window, id_col, text_col, rest)


def against_reference(docs: DataFrame, reference: DataFrame, window: int = 20, max_bytes: int = 1 << 20, shard_words: int = 100_000, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text") -> DataFrame:
    """(doc_id, start, length) of each maximal span of at least ``window`` words that a bounded reference contains.

    The reference must be at most ``max_bytes`` of text, which is checked: its shards are broadcast as words
    and their automata built once a task.  They have two states a word at most, some 350 bytes each: with
    the default 100 MB.  Null texts have no words; a null id stays null.
    """
    size = reference.agg(F.sum(F.octet_length(reference_col))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the reference has {size} bytes of text, more than {max_bytes}: use self_repeats on the union")
    texts = [r[0].encode().split() for r in reference.select(F.col(reference_col)).filter(F.col(reference_col).isNotNull()).collect()]
    shared = docs.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        shards, a, mark = [], Automaton(), -1
        for words in shared.value:
            for w in words:
                a.add(number.setdefault(w, len(number)))
            a.add(mark)
            mark -= 1
            if a.size >= shard_words:
                shards.append(a)
                a = Automaton()
        shards.append(a)
        for b in batches:
            out = []
            for doc, raw in zip(b.column(0).to_pylist(), raw_texts(b.column(1))):
                words = [number.get(w, -(2**62)) for w in (raw or b"").split()]
                hit = np.zeros(len(words) + 1, np.int64)
                for a in shards:
                    state = size = 0
                    for i, w in enumerate(words):
                        state, size = a.step(state, size, w, window)
                        if size == window:
                            hit[i - window + 1] += 1
                            hit[i + 1] -= 1
                edge = np.diff(np.concatenate([[0], (np.cumsum(hit[:-1]) > 0).astype(int), [0]]))
                out += [(doc, int(s), int(e - s)) for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "length"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return self_repeats(table(spark, sf_dir, "documents"), _digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s FROM d, unnest(range(1, greatest(1, len(w) - 18))) AS t(p)),
r AS (SELECT doc_id, p, CAST(row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS INTEGER) AS dup FROM win),
m AS (
  SELECT u.doc_id, u.p, u.word, max(coalesce(r.dup, 0)) OVER (PARTITION BY u.doc_id ORDER BY u.p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM u LEFT JOIN r ON u.doc_id = r.doc_id AND u.p = r.p
),
x AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(x.n_removed, 0) AS n_removed, sha256(coalesce(x.kept, '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""
