"""Quality rules: tokeniser fertility with rejection bands by language or script.

A public SentencePiece vocabulary with byte fallback measures three things of a text:
characters per token, the share of tokens that are byte fallback (line breaks and tabs
aside, which that vocabulary always spells as bytes) and the Shannon entropy of its tokens
in bits.  Each has a band for the text's
language, or for its script where the language has none.  Text the vocabulary has to spell
out, text of symbols, and text that repeats itself fall outside.

The rules read one row at a time: one scan, no exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, raw_texts, table
from .vocab import piece_ids, sentencepiece_cache, vocabulary_path

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\v\f\r"
_NOT_A_WORD_CHAR = _SPACES + bytes(range(0x80, 0xC0))  # white space and UTF-8 continuation bytes


@dataclass(frozen=True)
class Band:
    """Characters per token at least and at most, byte-fallback share at most, bits of entropy at least.

    Entropy grows with length: from ``FEW`` tokens on it is also at least ``usual`` bits at 256 tokens
    and ``doubling`` more for each doubling up to 4096 tokens."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    usual: float = 0.0
    doubling: float = 0.0

    def entropy_floor(self, n: int) -> float:
        return self.least_entropy if n < FEW else max(self.least_entropy, self.usual + self.doubling * (min(np.log2(n), 12) - 8))


#: Tokens below which no labelled text says what entropy is usual.
FEW = 100
#: By language.  Least characters and usual entropy are the 0.5th percentiles of the texts labelled good in
#: the training folds (id_fold 1 to 4 of 5) of the sf0.1 tables, rounded down; ``doubling`` is the slope of
#: their entropy over log2 of their tokens.  No labelled junk lies above the good texts or is spelt as
#: bytes, so the other two stay wide.
LANGUAGES = {
    "en": Band(2.40, 8.0, 0.10, 4.0, 6.00, 0.21),
    "fr": Band(2.08, 8.0, 0.10, 4.0, 5.86, 0.16),
    "de": Band(2.44, 8.0, 0.10, 4.0, 5.93, 0.17),
    "es": Band(2.13, 8.0, 0.10, 4.0, 5.90, 0.18),
}
#: By script, for any other language; no labels, so wide.  Scripts outside the vocabulary are spelt as bytes, three a
#: character, so they allow many.
SCRIPTS = {
    "latin": Band(1.3, 9.0, 0.25, 4.0),
    "greek": Band(0.6, 6.0, 0.60, 3.5),
    "cyrillic": Band(0.8, 8.0, 0.40, 4.0),
    "hebrew": Band(0.5, 6.0, 0.80, 3.5),
    "arabic": Band(0.5, 6.0, 0.80, 3.5),
    "cjk": Band(0.25, 4.0, 0.95, 3.5),
    "hangul": Band(0.25, 4.0, 0.95, 3.5),
    "other": Band(0.25, 9.0, 1.00, 3.5),
}
#: Lead bytes of UTF-8 by script.
LEADS = {"greek": range(0xCD, 0xD0), "cyrillic": range(0xD0, 0xD4), "hebrew": range(0xD6, 0xD8), "arabic": range(0xD8, 0xDC), "cjk": range(0xE3, 0xEA), "hangul": range(0xEA, 0xEE)}
_LATIN = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]


def script_of(raw: bytes) -> str:
    """The script with most letters, by lead bytes; "other" if there is no letter."""
    n = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    count = {"latin": int(n[_LATIN].sum())} | {k: int(n[list(v)].sum()) for k, v in LEADS.items()}
    count["other"] = int(n[0xC3:0xF5].sum()) - sum(count.values()) + int(n[_LATIN].sum() - n[0xC3:0xCA].sum())
    best = max(count, key=count.get)
    return best if count[best] > 0 else "other"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside a window of ``width`` words that occurs at least twice, its first time included.

    Windows are numbers: that of the words before, times the words' number, plus the last word's, told apart anew
    at each width.  So a window costs some bytes and no object, however long the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    windows = ids
    for k in range(1, width):
        windows = windows[: len(ids) - k] * len(number) + ids[k:]
        if k < width - 1 and len(number) ** (k + 2) >= 1 << 63:
            windows = np.unique(windows, return_inverse=True)[1]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    edges = np.zeros(len(words) + 1, np.int32)
    hit = np.flatnonzero(np.isin(windows, twice))
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (len(words), len(raw.translate(None, _NOT_A_WORD_CHAR)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def fertility(ids: np.ndarray, text: str, byte_ids: tuple[int, int]) -> tuple[int, float, float, float]:
    """n_tokens, characters per token, byte-fallback share, bits of entropy."""
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    count = np.bincount(ids)
    lo, hi = byte_ids
    spelt = int(count[lo : hi + 1].sum()) - int(sum(count[lo + c] for c in (9, 10, 13) if lo + c < len(count)))
    p = count[count > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    return n, len(text) / n, spelt / n, entropy


def verdict(band: Band, n: int, chars: float, spelt: float, entropy: float) -> str:
    """The first rule broken, or the empty text."""
    if n == 0:
        return "no_tokens"
    if not band.least_chars <= chars <= band.most_chars:
        return "chars_per_token"
    if spelt > band.most_bytes:
        return "byte_fallback"
    return "entropy" if entropy < band.entropy_floor(n) else ""


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", vocabulary: str = "piece_bpe_32k.model", languages: dict[str, Band] | None = None, scripts: dict[str, Band] | None = None) -> DataFrame:
    """One row of measures and verdicts for each row of ``docs``.

    A null or blank text has no words, so it fails the base rule; a null or unknown language
    falls back to the script's band; a null id stays null; repeated rows give repeated
    results; an empty table gives an empty one.  Text is read whole.  Other columns are not read.
    """
    languages, scripts = languages or LANGUAGES, scripts or SCRIPTS
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "n_tokens": pa.int64(), "chars_per_token": pa.float64(), "byte_share": pa.float64(), "entropy": pa.float64(), "reason": pa.string()}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cache = sentencepiece_cache(vocabulary_path(vocabulary))
        out = []
        for raw, lang in zip(raw_texts(b.column(1)), b.column(2).to_pylist()):
            raw = raw or b""
            base = base_counts(raw)
            failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
            text = raw.decode("utf-8", "replace")
            got = fertility(piece_ids(cache, text), text, (3, 258))
            reason = "base" if failed else verdict(languages.get(lang) or scripts[script_of(raw)], *got)
            out.append((*base, failed, not reason, *got, reason))
        return pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), list(kinds.values())[1:]))], names=list(kinds))

    spark_type = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double", pa.string(): "string"}
    lang = F.lit(None).cast("string") if lang_col is None or lang_col not in docs.columns else F.col(lang_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    return map_batches(rows, run, ", ".join(f"{k} {spark_type[t]}" for k, t in kinds.items()))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects.  One scan: rows travel with their verdict."""
    cols = docs.columns
    schema = docs.schema

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cache = sentencepiece_cache(vocabulary_path("piece_bpe_32k.model"))
        at = cols.index(text_col)
        langs = b.column(cols.index(lang_col)).to_pylist() if lang_col in cols else [None] * b.num_rows
        keep = []
        for raw, lang in zip(raw_texts(b.column(at).cast(pa.string())), langs):
            raw = raw or b""
            words = raw.split()
            if len(words) < 50 or 100 * repeated_words(words) > 50 * len(words):
                keep.append(False)
                continue
            text = raw.decode("utf-8", "replace")
            keep.append(not verdict(LANGUAGES.get(lang) or SCRIPTS[script_of(raw)], *fertility(piece_ids(cache, text), text, (3, 258))))
        return b.filter(pa.array(keep))

    return map_batches(docs, run, schema)


def op1_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))
