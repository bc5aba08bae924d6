"""Full-text search: postings, a small query language, BM25 top-k.

At scale a corpus is tokenised once into a postings table (term, id, tf, len), with a
table of lengths; a query then reads only the rows of its terms (``write_postings`` lays the
table out sorted by term, so row groups of other terms are skipped) and aggregates them.
Only three numbers of the corpus and the candidates of one query are ever gathered.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN, search_tokens
from ..scratch import write_table

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Atom:
    """Words in a row in one column (or any); the last may be a prefix; ``first`` ties it to the column's start."""

    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None
    first: bool = False


@dataclass(frozen=True)
class Node:
    """"and", "or", "not" (first without second), "near" or "atom"."""

    kind: str
    parts: tuple = field(default_factory=tuple)
    atom: Atom | None = None
    distance: int = 10


class QueryError(ValueError):
    """The query text has no meaning."""


_LEX = re.compile(r'\s*(?:(?P<text>"(?:[^"]|"")*")|(?P<sign>[(){}:^*+,-])|(?P<word>[^\s"(){}:^*+,-]+))')


def fold(text: str) -> list[str]:
    """Words of a query as :func:`search_tokens` makes them."""
    plain = text.lower().translate(str.maketrans(ACCENTED, PLAIN))
    return re.findall(r"[^\W_]+", plain)


class _Parser:
    """Loosest first: OR, AND (also by standing side by side), NOT, then single phrases."""

    def __init__(self, query: str, columns: list[str]) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        query = query.strip()
        while at < len(query):
            m = _LEX.match(query, at)
            if not m:
                raise QueryError(f"can't read the query at {at}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.columns = 0, columns

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else ("end", "")

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        k, v = self.peek()
        if (kind and k != kind) or (value and v != value) or k == "end":
            raise QueryError(f"expected {value or kind}, found {v or 'the end'}")
        self.at += 1
        return v

    def whole(self) -> Node:
        if not self.tokens:
            raise QueryError("the query is empty")
        out = self.either()
        if self.peek()[0] != "end":
            raise QueryError(f"can't read {self.peek()[1]!r}")
        return out

    def either(self) -> Node:
        parts = [self.both()]
        while self.peek() == ("word", "OR"):
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both(self) -> Node:
        parts = [self.without()]
        while True:
            k, v = self.peek()
            if (k, v) == ("word", "AND"):
                self.take()
            elif k == "end" or (k, v) in (("word", "OR"), ("sign", ")"), ("word", "NOT")):
                break
            parts.append(self.without())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def without(self) -> Node:
        out = self.one()
        while self.peek() == ("word", "NOT"):
            self.take()
            out = Node("not", (out, self.one()))
        return out

    def one(self, column: str | None = None) -> Node:
        k, v = self.peek()
        if (k, v) == ("sign", "("):
            self.take()
            out = self.either()
            self.take("sign", ")")
            return out
        if k == "word" and self.peek(1) == ("sign", ":"):
            if v not in self.columns:
                raise QueryError(f"no such column: {v}")
            self.take()
            self.take()
            return self.one(v)
        if (k, v) == ("word", "NEAR") and self.peek(1) == ("sign", "("):
            self.take()
            self.take()
            atoms = []
            while self.peek() not in (("sign", ")"), ("sign", ",")):
                atoms.append(self.phrase(column))
            distance = 10
            if self.peek() == ("sign", ","):
                self.take()
                distance = int(self.take("word"))
            self.take("sign", ")")
            return Node("near", tuple(atoms), distance=distance)
        return self.phrase(column)

    def phrase(self, column: str | None) -> Node:
        first = self.peek() == ("sign", "^")
        if first:
            self.take()
        words: list[str] = []
        while True:
            k, v = self.peek()
            if k not in ("text", "word"):
                raise QueryError(f"expected a word, found {v or 'the end'}")
            self.take()
            words += fold(v[1:-1].replace('""', '"') if k == "text" else v)
            if self.peek() != ("sign", "+"):
                break
            self.take()
        prefix = self.peek() == ("sign", "*")
        if prefix:
            self.take()
        return Node("atom", atom=Atom(tuple(words), prefix, column, first))


def parse_query(query: str, columns: list[str] | None = None) -> Node:
    """Words side by side are all wanted; AND, OR, NOT, parentheses, "a phrase", a + phrase, prefix*,
    column: x, ^x at a column's start, NEAR(a b, n).  Raises :class:`QueryError`."""
    return _Parser(query, columns or []).whole()


def atoms_of(node: Node, wanted: bool = True) -> list[Atom]:
    """The phrases that add to a score: all but those after NOT."""
    if node.kind == "atom":
        return [node.atom] if wanted and node.atom.words else []
    parts = node.parts[:1] if node.kind == "not" else node.parts
    return [a for p in parts for a in atoms_of(p)]


def in_a_row(tokens: Column, n: int) -> Column:
    """Each token with the n - 1 after it, as structs of fields "0" to "n-1"; null past the end.

    The lambdas over it see one element alone: naming the whole array inside a lambda would have
    the optimizer put its making there, once for each element."""
    return F.arrays_zip(*((tokens if k == 0 else F.slice(tokens, k + 1, 1 << 30)).alias(str(k)) for k in range(n)))


def _places(tokens: Column, atom: Atom) -> Column:
    """Where a phrase starts in an array of tokens, from 0."""
    *exact, last = atom.words

    def here(s: Column, i: Column) -> Column:
        end = s[str(len(exact))]
        ok = end.startswith(last) if atom.prefix else end == F.lit(last)
        for k, w in enumerate(exact):
            ok = ok & (s[str(k)] == F.lit(w))
        return F.when(ok & (i == 0) if atom.first else ok, i)

    return F.filter(F.transform(in_a_row(tokens, len(atom.words)), here), lambda i: i.isNotNull())


def _count(fields: dict[str, Column], atom: Atom) -> Column:
    out = F.lit(0)
    for name, tokens in fields.items():
        if atom.column in (None, name):
            if len(atom.words) == 1 and not atom.first:
                w = atom.words[0]
                hits = F.filter(tokens, lambda x: x.startswith(w) if atom.prefix else x == F.lit(w))
            else:
                hits = _places(tokens, atom)
            out = out + F.size(hits)
    return out


def _near(places: list[Column], sizes: list[int], distance: int) -> Column:
    """Has some occurrence of the first phrase one of each other with at most ``distance`` words between?"""

    def close(i: Column) -> Column:
        ok = F.lit(True)
        for spots, n in zip(places[1:], sizes[1:]):
            ok = ok & F.exists(spots, lambda j: F.when(j > i, j - i - sizes[0]).otherwise(i - j - n) <= distance)
        return ok

    return F.exists(places[0], close)


def _matches(node: Node, fields: dict[str, Column]) -> Column:
    if node.kind == "atom":
        return _count(fields, node.atom) > 0 if node.atom.words else F.lit(False)
    if node.kind == "not":
        return _matches(node.parts[0], fields) & ~_matches(node.parts[1], fields)
    if node.kind == "near":
        found = F.lit(False)
        for tokens in fields.values():
            found = found | _near([_places(tokens, p.atom) for p in node.parts], [len(p.atom.words) for p in node.parts], node.distance)
        return found
    parts = [_matches(p, fields) for p in node.parts]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if node.kind == "and" else (out | p)
    return out


def idf(n: int, df: int) -> float:
    import math

    x = math.log((n - df + 0.5) / (df + 0.5))
    return x if x > 0 else LEAST_IDF


@dataclass(frozen=True)
class Index:
    """Postings (term, id, tf, len) of all rows over the fields searched, the number of rows and of their tokens."""

    postings: DataFrame
    rows: int
    tokens: int


def _all_atoms(node: Node) -> list[Atom]:
    return [node.atom] if node.kind == "atom" else [a for p in node.parts for a in _all_atoms(p)]


def _plain(node: Node) -> bool:
    """Is the query made of single words alone, in any column and place?"""
    if node.kind == "atom":
        a = node.atom
        return len(a.words) < 2 and not (a.prefix or a.column or a.first)
    return node.kind != "near" and all(map(_plain, node.parts))


def _matches_counts(node: Node, counts: dict[Atom, Column]) -> Column:
    """:func:`_matches` of a plain query, from its words' counts."""
    if node.kind == "atom":
        return counts[node.atom] > 0 if node.atom.words else F.lit(False)
    a, *rest = (_matches_counts(p, counts) for p in node.parts)
    for b in rest:
        a = a & ~b if node.kind == "not" else a & b if node.kind == "and" else a | b
    return a


def _counts_of_postings(index: Index, tree: Node, wanted: list[Atom]) -> DataFrame:
    """Lengths, matches and counts for a plain query: its terms' postings are read, no text is."""
    words = list(dict.fromkeys(w for a in _all_atoms(tree) for w in a.words))
    held = index.postings.filter(F.col("term").isin(words) if words else F.lit(False))
    counted = held.groupBy("id").agg(F.max("len").cast("double").alias("len"), *(F.sum(F.when(F.col("term") == w, F.col("tf")).otherwise(0)).cast("double").alias(f"w{i}") for i, w in enumerate(words)))
    counts = {a: F.col(f"w{words.index(a.words[0])}") for a in _all_atoms(tree) if a.words}
    return counted.select("id", "len", _matches_counts(tree, counts).alias("match"), *(counts[a].alias(f"n{j}") for j, a in enumerate(wanted)))


def _candidates(index: Index, wanted: list[Atom]) -> DataFrame:
    """Ids of the rows with a word of each phrase's own: its longest whole one, or what a prefix begins."""
    has = F.lit(False)
    for a in wanted:
        whole = a.words[:-1] if a.prefix else a.words
        has = has | (F.col("term") == max(whole, key=len) if whole else F.col("term").startswith(a.words[0]))
    return index.postings.filter(has).select("id").distinct()


def bm25(rows: DataFrame, query: str, fields: dict[str, Column | str], id_col: str, k: int, index: Index | None = None) -> DataFrame:
    """(id, score) of the ``k`` best rows, best first; equal scores by id.

    A row's length and a phrase's frequency are pooled over the fields; null fields are empty.
    Texts are read once: each row's length and counts go to a table in the shared folder, which gives one
    row of corpus statistics and then the scores of the rows that match.  With an index a query of single words
    reads their postings alone; another reads the texts of the rows that can hold one of its phrases.
    """
    tree = parse_query(query, list(fields))
    wanted = atoms_of(tree)
    if index is not None and _plain(tree):
        counts = _counts_of_postings(index, tree, wanted)
    else:
        rows = rows if index is None else rows.join(_candidates(index, wanted).withColumnRenamed("id", id_col), id_col, "left_semi")
        tokens = rows.select(F.col(id_col).alias("id"), *(F.coalesce(search_tokens(c), F.array().cast("array<string>")).alias(f"f{i}") for i, c in enumerate(fields.values())))
        names = {name: F.col(f"f{i}") for i, name in enumerate(fields)}
        length = sum((F.size(c) for c in names.values()), F.lit(0))
        counts = tokens.select("id", length.cast("double").alias("len"), _matches(tree, names).alias("match"), *(_count(names, a).cast("double").alias(f"n{j}") for j, a in enumerate(wanted)))
    counts = write_table(counts, "counts")
    stats = counts.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *(F.count(F.when(F.col(f"n{j}") > 0, 1)).alias(f"d{j}") for j in range(len(wanted)))).first()
    n, average = (stats["n"], stats["avg"]) if index is None else (index.rows, index.tokens / max(index.rows, 1))
    score = F.lit(0.0)
    for j in range(len(wanted)):
        f = F.col(f"n{j}")
        score = score + F.lit(idf(n, stats[f"d{j}"])) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(average or 1.0)))
    hits = counts.filter("match").select(F.col("id"), score.alias("score"))
    return hits.orderBy(F.desc("score"), "id").limit(k)


def postings(rows: DataFrame, text_cols: list[str], id_col: str) -> DataFrame:
    """(term, id, tf, len): one row for each distinct term of each row.  No shuffle: terms are counted within the row."""
    tokens = F.sort_array(F.concat(*(F.coalesce(search_tokens(c), F.array().cast("array<string>")) for c in text_cols)))
    # where each term's run begins in the sorted tokens, then how long it is
    begins = lambda t: F.filter(F.transform(in_a_row(F.concat(F.array(F.lit("")), t), 2), lambda s, i: F.when(s["0"] != s["1"], F.struct(s["1"].alias("term"), i.alias("at")))), lambda x: x.isNotNull())
    listed = rows.select(F.col(id_col).alias("id"), F.size(tokens).alias("len"), begins(tokens).alias("s")).filter("len > 0")
    nexts = F.concat(F.transform(F.slice("s", 2, F.size("s")), lambda x: x["at"]), F.array(F.col("len")))
    terms = listed.select("id", "len", F.explode(F.arrays_zip(F.col("s").alias("s"), nexts.alias("e"))).alias("x"))
    return terms.select(F.col("x.s.term").alias("term"), "id", (F.col("x.e") - F.col("x.s.at")).cast("long").alias("tf"), F.col("len").cast("long").alias("len"))


def term_statistics(rows: DataFrame, text_cols: list[str]) -> DataFrame:
    """(term, df, cf): rows that hold each term and how often they do, from each row's tokens followed by its distinct ones."""
    tokens = F.concat(*(F.coalesce(search_tokens(c), F.array().cast("array<string>")) for c in text_cols))
    listed = rows.select(tokens.alias("t")).select(F.size("t").alias("n"), F.posexplode(F.concat("t", F.array_distinct("t"))).alias("at", "term"))
    once = F.col("at") >= F.col("n")
    return listed.groupBy("term").agg(F.count(F.when(once, 1)).alias("df"), F.count(F.when(~once, 1)).alias("cf"))


def write_postings(rows: DataFrame, text_cols: list[str], id_col: str, path: str) -> None:
    """Postings sorted by term, and the corpus statistics beside them."""
    postings(rows, text_cols, id_col).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    length = sum((F.size(F.coalesce(search_tokens(c), F.array().cast("array<string>"))) for c in text_cols), F.lit(0))
    rows.agg(F.count("*").alias("n"), F.avg(length.cast("double")).alias("avg_len")).write.mode("overwrite").parquet(f"{path}/stats")


def search_postings(path: str, spark, terms: list[str], k: int, every: bool = True) -> DataFrame:
    """BM25 top-k for plain terms from a written index: reads those terms' rows alone."""
    terms = list(dict.fromkeys(terms))
    stats = spark.read.parquet(f"{path}/stats").first()
    rows = spark.read.parquet(f"{path}/postings").filter(F.col("term").isin(terms))
    df = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row a term
    if not df or (every and len(df) < len(terms)):
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    weight = F.create_map(*(F.lit(x) for t, n in df.items() for x in (t, idf(stats["n"], n))))
    part = weight[F.col("term")] * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(stats["avg_len"])))
    found = rows.groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("terms"))
    if every:
        found = found.filter(F.col("terms") == len(terms))
    return found.select("id", "score").orderBy(F.desc("score"), "id").limit(k)
