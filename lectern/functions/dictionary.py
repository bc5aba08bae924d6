"""Text repair by a word list: rejoining split words, removing line-end hyphens, quality.

The rules are sequential, so they run as an Arrow function over whole texts; the word list is an
input (a set of common words and one of proper names), broadcast once its size is checked.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import drop_soft_hyphens, quality_cap, repair_controls

#: Words of one or two letters that stand alone.  Fixed values.
FUNCTION_WORDS = frozenset("a i am an as at be by do go he if in is it me my no of on or so to up us we".split())
LONGEST = 128
MOST_WORDS = 2_000_000


class Words:
    def __init__(self, common: Iterable[str], proper: Iterable[str] = ()) -> None:
        self.common = frozenset(w.lower() for w in common)
        self.proper = frozenset(w.lower() for w in proper)
        if len(self.common) + len(self.proper) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} words can't be broadcast")

    def known(self, w: str) -> bool:
        """In the list whatever its case; proper names need a capital; no capital after a small letter."""
        if not w or len(w.encode()) > LONGEST or re.search("[a-z][A-Z]", w):
            return False
        return w.lower() in self.common or (w[0].isupper() and w.lower() in self.proper)

    def alone(self, w: str) -> bool:
        """A word that stands by itself: known, and long enough or a function word."""
        return self.known(w) and (len(w.encode()) >= 3 or w.lower() in FUNCTION_WORDS)

    # -- hyphens -----------------------------------------------------------

    def dehyphenate(self, text: str) -> str:
        """``mis- managed`` and ``mis-man aged`` become words again where the list knows them."""
        out, at = [], 0
        for m in re.finditer(r"(?<=[A-Za-z])-( ?)(?=[A-Za-z])", text):
            if m.start() < at:
                continue
            left = re.search(r"[^\s-]*$", text[at : m.start()])[0]
            right = re.match(r"[^\s-]*", text[m.end() :])[0]
            stem, core = re.sub(r"^[^A-Za-z]*", "", left), re.match(r"[A-Za-z']*", right)[0]
            more = re.match(r" ([A-Za-z]+)", text[m.end() + len(core) :]) if core == right else None
            if more and self.known(stem + core + more[1]):
                out.append(text[at : m.start()] + core + more[1])
                at = m.end() + len(core) + more.end()
            elif self.known(stem + core):
                out.append(text[at : m.start()])
                at = m.end()
            elif m[1]:
                out.append(text[at : m.start()] + "-")
                at = m.end()
        return "".join(out) + text[at:]

    # -- split words -------------------------------------------------------

    def rejoin_line(self, line: str) -> str:
        """Neighbours that are a word together, and not both words apart, become one."""
        parts = re.findall(r"[^ -]+|[ -]+", line)
        if sum(1 for p in parts if p[0] not in " -") < 2:
            return line
        lead = parts.pop(0) if parts[0][0] in " -" else ""
        if parts[-1][0] in " -":
            parts.pop()
        words, gaps = parts[::2], ["-" if "-" in g else " " for g in parts[1::2]]
        out, k = [words[0]], 0
        seps: list[str] = []
        for gap, w in zip(gaps, words[1:]):
            left = re.fullmatch(r"([^A-Za-z0-9]*)(.*?)([^A-Za-z0-9]*)", out[-1])
            right = re.fullmatch(r"([^A-Za-z0-9]*)(.*?)([^A-Za-z0-9]*)", w)
            if self._joins(left, right, out[-1], w):
                out[-1] = left[1] + left[2] + right[2] + right[3]
            else:
                seps.append(gap)
                out.append(w)
            k += 1
        joined = out[0] + "".join(s + w for s, w in zip(seps, out[1:]))
        return ("-" if "-" in lead else " " if lead else "") + joined

    def _joins(self, left: re.Match, right: re.Match, a: str, b: str) -> bool:
        l, r = left[2], right[2]
        if not l or not r or (len(a) == 1 and len(b) == 1) or "." in left[3]:
            return False
        if re.fullmatch(r"[0-9.,+-]+", a) or re.fullmatch(r"[0-9.,+-]+", b):
            return False
        return self.known(l + r) and not (self.alone(l) and self.alone(r))

    def rejoin_across(self, text: str) -> str:
        """A word split over a line end moves up to the first line."""
        lines, out, k = text.split("\n"), [], 0
        while k < len(lines):
            line = lines[k]
            if k + 1 < len(lines):
                a, b = re.search(r"[A-Za-z]{2,}$", line), re.match(r"[A-Za-z]{2,}", lines[k + 1])
                if a and b and self.known(a[0] + b[0]) and not (self.known(a[0]) and self.known(b[0])):
                    out += [line + b[0], lines[k + 1][b.end() :].removeprefix(" ")]
                    k += 2
                    continue
            out.append(line)
            k += 1
        return "\n".join(out)

    def repair(self, text: str) -> str:
        """After the character repairs: hyphens, then split words twice, then line ends."""
        text = self.dehyphenate(text)
        for _ in range(2):
            text = "\n".join(self.rejoin_line(x) for x in text.split("\n"))
        return self.rejoin_across(text)

    def word_percent(self, text: str, most: int = 200) -> int:
        """Known words among the first ``most`` runs of three letters or more; 100 if there are none."""
        runs = [w for w in re.findall("[A-Za-z]+", text) if len(w) >= 3][:most]
        return 100 * sum(map(self.known, runs)) // len(runs) if runs else 100


def normalize(spark: SparkSession, text: Column | str, words: Words) -> Column:
    """The full repair of a text column; nulls stay null."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("string")
    def repair(s: pd.Series) -> pd.Series:
        w = shared.value
        return s.map(lambda t: None if t is None else w.repair(t))

    return repair(drop_soft_hyphens(repair_controls(text)))


def text_quality(spark: SparkSession, text: Column | str, words: Words) -> Column:
    """0 to 100: the least of the share of letters, of known words and the cap for bad characters."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("int")
    def share(s: pd.Series) -> pd.Series:
        w = shared.value
        return s.map(lambda t: 100 if t is None else w.word_percent(t)).astype("int32")

    from .text import alpha_percent

    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(text) == 0, 100).otherwise(F.least(alpha_percent(text), share(text), quality_cap(text)))
