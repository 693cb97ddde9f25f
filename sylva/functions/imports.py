"""What a paragraph of an imported document is, read off its words and looks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import word_count

#: How captions, named parts, numbered headings and typed maths look, and what references are headed.
CAPTION = r"(?i)^\s*(?:[\[(][^\])]{0,40}?[—–:-]\s*)?(figure|fig|table|tbl|chart|algorithm|listing|scheme|plate)\.?\s*([0-9]+(?:\.[0-9]+)*|[IVXLCDM]+)\s*[.:—–)-]"
NAMED = [("abstract", r"(?i)^abstract\s*[-—–:.]"), ("keywords", r"(?i)^(index\s+terms|keywords?)\s*[-—–:.]")]
SUB_NUMBER = r"^(?:[0-9]+\.[0-9]+|[ABCDEFGHJKLMNOPQRSTUWYZ][.)]\s|[IVXLCDM]+-[A-Z0-9]\b)"
TOP_NUMBER = r"^(?:[IVXLCDM]+|[0-9]+)[.)]\s"
NOT_A_HEADING = r"(?i)^(fig\.|figure|table|eq\.|equation|algorithm|appendix\s+\w+\s*[:.]?\s*\S)"
MATHS_LINE = r"\$|[=≈≤≥±×÷∑∏∫√∞]|\|\||_\{|\^\{|[a-zA-Z]_[a-z0-9]\b"
REFERENCES = ["reference", "bibliography", "works cited"]


def is_caption(text: Column) -> Column:
    line = F.trim(text)
    return (line != "") & (F.length(line) <= 400) & F.rlike(line, F.lit(CAPTION))


def named_part(text: Column) -> Column:
    line, out = F.trim(text), F.lit(None).cast("string")
    for name, pattern in reversed(NAMED):
        out = F.when(F.rlike(line, F.lit(pattern)), name).otherwise(out)
    return out


def heads_references(text: Column) -> Column:
    line = F.lower(F.trim(text))
    return F.contains(line, F.lit(REFERENCES[0])) | F.contains(line, F.lit(REFERENCES[1])) | F.contains(line, F.lit(REFERENCES[2]))


def heading_kind(text: Column, bold: Column, size: Column, default: float) -> Column:
    """heading, subheading or null: short lines without a sentence's end that weight, size or capitals set apart and that
    number themselves, stand out by size or shout."""
    line = F.trim(text)
    sub = F.rlike(line, F.lit(SUB_NUMBER))
    top = F.rlike(line, F.lit(TOP_NUMBER)) & ~sub
    bigger, much = F.coalesce(size >= default + 0.5, F.lit(False)), F.coalesce(size >= default + 2, F.lit(False))
    shouted = (line == F.upper(line)) & (line != F.lower(line)) & (F.length(line) > 3)
    no = (line == "") | (F.length(line) > 90) | (word_count(line) > 14) | F.rlike(line, F.lit(NOT_A_HEADING)) | F.rlike(line, F.lit(MATHS_LINE)) | (F.rlike(line, F.lit(r"[.?!;,]$")) & ~(sub | top))
    apart = F.coalesce(bold, F.lit(False)) | bigger | shouted
    return F.when(no | ~apart | ~(sub | top | bigger | shouted), None).when(sub, "subheading").when(top | much | shouted, "heading").otherwise("subheading")


def style_class(name: Column, in_references: Column) -> Column:
    """The type that a paragraph style's name stands for."""
    n = F.lower(F.trim(name))
    level = F.coalesce(F.regexp_extract(n, r"^heading\s*([0-9]+)$", 1).try_cast("int"), F.lit(1))
    return (
        F.when(F.startswith(n, F.lit("title")), "heading").when(F.startswith(n, F.lit("heading")), F.when(level <= 1, "heading").otherwise("subheading")).when(F.contains(n, F.lit("caption")), "caption")
        .when(in_references, "reference").when(F.contains(n, F.lit("footnote")), "footnote").otherwise("body")
    )


def relative_date(day: Column, today: Column) -> Column:
    n = F.datediff(today, day)
    return F.when(n <= 0, "Today").when(n == 1, "Yesterday").otherwise(F.concat(n.cast("string"), F.lit(" days ago")))
