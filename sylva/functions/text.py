"""Scalar functions on text and numbers, all as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that printing in Latin-1 replaces.
LATIN = {
    "•": "-", "‣": "-", "–": "-", "—": "-", "−": "-", "“": '"', "”": '"', "„": '"', "‘": "'", "’": "'",
    "…": "...", "─": "-", "━": "-", "→": "->", "←": "<-", "●": "*", "►": ">",
}
#: Maths as it is typed, and numbered citations.
MATHS = r"\\[a-zA-Z]{2,}|\$[^$]+\$|\$\$|_\{|\^\{|≤|≥|∑|√"
CITATION = r"\[[0-9]+\](?:[-–,]\s*\[?[0-9]+\]?)*"


def _shouted(word: Column) -> Column:
    """All its letters are capitals, and it is longer than one character."""
    return (F.length(word) > 1) & (word == F.upper(word)) & (word != F.lower(word))


def _capital(letter: Column) -> Column:
    return F.when(letter == "ß", "Ss").otherwise(F.upper(letter))


def title_case(text: Column) -> Column:
    """Each word with a capital first, words in capitals as they are."""
    words = F.transform(F.split(text, " ", -1), lambda w: F.when(_shouted(w), w).otherwise(F.concat(_capital(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))))
    return F.array_join(words, " ")


def sentence_case(text: Column) -> Column:
    """Small letters but for each sentence's first letter; words in capitals stay. A sentence begins with the text and
    after each full stop, exclamation or question mark; one that begins with a digit gets no capital."""
    lowered = F.array_join(F.transform(F.split(text, " ", -1), lambda w: F.when(_shouted(w), w).otherwise(F.lower(w))), " ")
    parts = F.split(lowered, r"(?<=[.!?])", -1)
    first = r"(?s)^([^\p{L}\p{Nd}]*)(\p{L}?)(.*)$"
    part = lambda p, i: F.regexp_extract(p, first, i)
    return F.array_join(F.transform(parts, lambda p: F.concat(part(p, 1), F.upper(part(p, 2)), part(p, 3))), "")


def words(text: Column) -> Column:
    """The words between white space of any kind."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def clip(text: Column, most: int) -> Column:
    """(text, truncated): the beginning, and whether anything is missing."""
    return F.struct(F.substring(text, 1, most).alias("text"), (F.length(text) > most).alias("truncated"))


def safe_filename(text: Column, most: int = 80) -> Column:
    kept = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N} _-]", ""))
    return F.when(kept == "", "document").otherwise(F.substring(kept, 1, most))


def latin(text: Column) -> Column:
    """Text that Latin-1 can hold: known signs replaced by near ones, all others by a question mark."""
    known = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LATIN.items(), F.coalesce(text, F.lit("")))
    return F.regexp_replace(known, r"[^\x{0}-\x{FF}]", "?")


def roman(n: Column) -> Column:
    """Roman numerals from 1 to 3999, digit by digit; empty below 1."""

    def place(unit: int, one: str, five: str, ten: str) -> Column:
        d = F.pmod(F.floor(n / unit), F.lit(10)).cast("int")
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.element_at(F.array(*map(F.lit, forms)), d + 1)

    return F.when(n <= 0, "").otherwise(F.concat(place(1000, "M", "", ""), place(100, "C", "D", "M"), place(10, "X", "L", "C"), place(1, "I", "V", "X")))


def alpha(n: Column) -> Column:
    """1 as A, 26 as Z, 27 as AA: letters without a zero, up to 702."""
    letter = lambda k: F.char(F.lit(65) + k.cast("int"))
    last = F.pmod(n - 1, F.lit(26))
    return F.when(n <= 0, "").when(n <= 26, letter(last)).otherwise(F.concat(letter(F.floor((n - 1) / 26) - 1), letter(last)))


def search(text: Column, query: str) -> Column:
    """Every word of the query is in the text, in any order."""
    return reduce(lambda c, w: c & F.contains(F.lower(text), F.lit(w)), query.lower().split(), F.lit(True))


#: How many of a unit make a point: sizes come in halves, rules in eighths, widths in fiftieths of a percent.
UNITS = {"twip": 20, "half": 2, "eighth": 8, "fiftieth": 50}


def to_points(n: Column, unit: str) -> Column:
    return n / UNITS[unit]


def from_points(points: Column, unit: str) -> Column:
    """The nearest whole number of a unit, halves to even."""
    return F.bround(points * UNITS[unit]).cast("long")


def twips_to_points(n: Column) -> Column:
    return to_points(n, "twip")


def strip_numbering(text: Column) -> Column:
    """A reference without the numbers that its author typed before it."""
    return F.trim(F.regexp_replace(text, r"^(\s*(\[[0-9]+\]|\([0-9]+\)|[0-9]+[.)])\s+)+", ""))


def tone_simple(text: Column) -> Column:
    """Plain words for stiff ones."""
    for stiff, plain in (("utilize", "use"), ("facilitate", "help"), ("approximately", "about")):
        text = F.regexp_replace(text, rf"\b{stiff}\b", plain)
    return text
