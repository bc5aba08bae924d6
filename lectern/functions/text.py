"""Scalar text functions as column expressions: all of them stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that the engine reads, and the parser for each.
FORMATS = {"md": "md", "markdown": "md", "txt": "txt", "docx": "docx", "epub": "epub", "rtf": "rtf", "doc": "doc", "pdf": "pdf"}

TOKENS_PER_BYTE = 0.25


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extension(path: Column | str) -> Column:
    """What follows the last dot of the last path part, in lower case; '' if there is none."""
    return F.lower(F.regexp_extract(_col(path), r"\.([^./]*)$", 1))


def format_of(path: Column | str) -> Column:
    """Format by extension whatever its case; null if it isn't one the engine reads."""
    known = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    return F.element_at(known, extension(path))


def content_hash(content: Column | str) -> Column:
    """SHA-256 of the raw bytes, in hex."""
    return F.sha2(_col(content).cast("binary"), 256)


def utf8_bytes(text: Column | str) -> Column:
    return F.octet_length(_col(text)).cast("long")


def token_estimate(text: Column | str) -> Column:
    """A quarter of the bytes, rounded up; 0 only for an empty text."""
    return F.ceil(F.octet_length(_col(text)) * F.lit(TOKENS_PER_BYTE)).cast("long")


def is_blank(text: Column | str) -> Column:
    """Nothing but spaces, tabs and line ends."""
    return _col(text).rlike(r"^[ \t\r\n]*$")


def breadcrumb(parent: Column | str, heading: Column | str, separator: str = " > ") -> Column:
    """Parent path and heading; an absent or empty part leaves no separator."""
    return F.concat_ws(separator, F.nullif(_col(parent), F.lit("")), F.nullif(_col(heading), F.lit("")))


def snippet(text: Column | str, most: int = 255) -> Column:
    """The first characters on one line: line ends and tabs become spaces."""
    return F.substring(F.translate(_col(text), "\n\t", "  "), 1, most)


def lines(text: Column | str) -> Column:
    """Non-empty lines, in order."""
    return F.filter(F.split(_col(text), "\n"), lambda x: x != "")


def paragraphs(text: Column | str) -> Column:
    """What stands between runs of two or more line feeds, blank ones dropped."""
    return F.filter(F.split(_col(text), "\n{2,}"), lambda x: ~is_blank(x))


def reflow(text: Column | str) -> Column:
    """Trimmed lines of a paragraph joined by a space; a run of blank lines is one line feed."""
    trimmed = F.regexp_replace(_col(text), r"(?<=^|\n)[ \t\r]+|[ \t\r]+(?=\n|$)", "")
    marked = F.regexp_replace(trimmed, "\n{2,}", "\u0000")
    joined = F.replace(marked, F.lit("\n"), F.lit(" "))
    return F.regexp_replace(F.translate(joined, "\u0000", "\n"), r"^[ \n]+|[ \n]+$", "")


LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def expand_ligatures(text: Column | str) -> Column:
    out = _col(text)
    for sign, letters in LIGATURES.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    return out


def repair_controls(text: Column | str) -> Column:
    """Spelt-out and raw control characters back to the ligatures they stood for, the rest dropped;
    a space after a full stop between letters and after a comma, semicolon or colon before one."""
    out = _col(text)
    for code, letters in (("u0001", "fl"), ("u0002", "fi"), ("u0003", "ff"), ("u0006", "ffi")):
        out = F.replace(out, F.lit(code), F.lit(letters))
    out = expand_ligatures(F.regexp_replace(out, "u000[0-9A-Fa-f]", ""))
    for code, letters in (("\u0001", "fl"), ("\u0002", "fi"), ("\u0003", "ff")):
        out = F.replace(out, F.lit(code), F.lit(letters))
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    out = F.regexp_replace(out, r"([a-z])\.(?=[A-Z])", "$1. ")
    return F.regexp_replace(out, r"(;|:|(?<![0-9]),)(?=[A-Za-z])", "$1 ")


def drop_soft_hyphens(text: Column | str) -> Column:
    """A soft hyphen goes, together with the line break it made."""
    return F.regexp_replace(_col(text), "­[\r\n ]*", "")


def dot_leaders(text: Column | str) -> Column:
    """Five or more dots, with blanks among them, become a line feed."""
    return F.regexp_replace(_col(text), r"[ \t]*(?:\.[ \t]*){5,}", "\n")


def core_of_word(word: Column | str) -> Column:
    """A word without what isn't a letter or digit at its two ends."""
    return F.regexp_extract(_col(word), r"^[^\p{L}\p{N}]*(.*?)[^\p{L}\p{N}]*$", 1)


def is_numeric_token(word: Column | str) -> Column:
    return _col(word).rlike(r"^[0-9.,+\-]+$")


_ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def to_roman(n: Column | str) -> Column:
    """Lower-case numeral for 1 to 3999, else null."""
    n = _col(n).cast("int")
    digit = lambda place: F.pmod(F.floor(n / place), F.lit(10)).cast("int")

    def spell(place: int, one: str, five: str, ten: str) -> Column:
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.element_at(F.array(*map(F.lit, forms)), digit(place) + 1)

    whole = F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), spell(100, "c", "d", "m"), spell(10, "x", "l", "c"), spell(1, "i", "v", "x"))
    return F.when(n.between(1, 3999), whole)


def from_roman(text: Column | str) -> Column:
    """A numeral's value whatever its case, also of additive forms such as iiii; null if it has other letters."""
    value = F.create_map(*(F.lit(x) for pair in (("m", 1000), ("d", 500), ("c", 100), ("l", 50), ("x", 10), ("v", 5), ("i", 1)) for x in pair))
    signs = F.filter(F.split(F.lower(_col(text)), ""), lambda x: x != "")
    # from the right: a sign below the largest so far counts against the sum
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("high"))
    step = lambda a, x: F.struct((a["total"] + F.when(value[x] < a["high"], -value[x]).otherwise(value[x])).alias("total"), F.greatest(a["high"], value[x]).alias("high"))
    total = F.aggregate(F.reverse(signs), start, step, lambda a: a["total"])
    return F.when(F.lower(_col(text)).rlike("^[mdclxvi]+$"), total)


#: Latin letters that decompose into an ASCII letter and marks, and those letters.
_PAIRS = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if c == c.lower() and len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii()]
ACCENTED, PLAIN = ("".join(x) for x in zip(*_PAIRS))


def search_tokens(text: Column | str) -> Column:
    """Runs of letters and digits, lower-cased and without diacritics, in order.

    Only tokens that are not ASCII are searched for diacritics."""
    runs = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))
    bare = lambda w: F.regexp_replace(F.translate(w, ACCENTED, PLAIN), r"\p{M}", "")
    return F.filter(F.transform(runs, lambda w: F.when(F.octet_length(w) == F.length(w), w).otherwise(bare(w))), lambda w: w != "")


def alpha_percent(text: Column | str) -> Column:
    """ASCII letters in 100 bytes, rounded down; 100 for an empty text."""
    n = F.octet_length(_col(text))
    letters = F.length(F.regexp_replace(_col(text), "[^A-Za-z]+", ""))
    return F.when(n == 0, F.lit(100)).otherwise(F.floor(letters * 100 / n)).cast("int")


def bad_percent(text: Column | str) -> Column:
    """Control characters and three times the replacement characters in 100 bytes, rounded down."""
    n = F.octet_length(_col(text))
    bad = F.length(F.regexp_replace(_col(text), r"[^\x00-\x08\x0B\x0C\x0E-\x1F]+", "")) + 3 * F.length(F.regexp_replace(_col(text), "[^�]+", ""))
    return F.when(n == 0, F.lit(0)).otherwise(F.floor(bad * 100 / n)).cast("int")


def quality_cap(text: Column | str) -> Column:
    """The most that a text's quality can be for its bad characters."""
    bad = bad_percent(text)
    return F.when(bad <= 5, 100).when(bad >= 33, 0).otherwise(100 - 3 * bad)
