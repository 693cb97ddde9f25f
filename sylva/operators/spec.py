"""Numbering, captions and layout of composed documents, and the data of their charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alpha, roman
from .commands import once


def up_to():
    """The blocks of a document up to each."""
    return Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def heading_numbers(headings: DataFrame) -> DataFrame:
    """h1, h2, h3 of headings (doc_id, pos, level): deeper counters begin anew below a shallower heading."""
    level = F.greatest(F.lit(1), F.least(F.lit(3), F.col("level")))
    rows = headings.withColumn("level", level).withColumn("h1", F.sum((level == 1).cast("int")).over(up_to()))
    in_1 = Window.partitionBy("doc_id", "h1").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("h2", F.sum((F.col("level") == 2).cast("int")).over(in_1))
    in_2 = Window.partitionBy("doc_id", "h1", "h2").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("h3", F.sum((F.col("level") == 3).cast("int")).over(in_2))


def heading_label(scheme: str) -> Column:
    level, h1, h2, h3 = (F.col(c) for c in ("level", "h1", "h2", "h3"))
    if scheme == "none":
        return F.lit("")
    if scheme == "roman_alpha":
        return F.when(level == 1, F.concat(roman(h1), F.lit(". "))).when(level == 2, F.concat(alpha(h2), F.lit(". "))).otherwise(F.concat(h3.cast("string"), F.lit(") ")))
    one, two, three = h1.cast("string"), h2.cast("string"), h3.cast("string")
    return F.when(level == 1, F.concat(one, F.lit(". "))).when(level == 2, F.concat(one, F.lit("."), two, F.lit(" "))).otherwise(F.concat(one, F.lit("."), two, F.lit("."), three, F.lit(" ")))


def caption_numbers(blocks: DataFrame, has_data: Column) -> DataFrame:
    """Each block's number among those of its type; a figure with nothing to draw takes none."""
    rows = blocks.where((F.col("type") != "figure") | has_data)
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("pos")))


def caption(prefix: str, separator: str, number: Column, title: Column, style: str = "arabic") -> Column:
    shown = roman(number) if style == "roman" else number.cast("string")
    label = F.concat(F.lit(prefix), shown)
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(label, F.lit(separator), title)).otherwise(label)


#: Edge widths in eighths of a point for each border convention.
BORDERS = {
    "none": {"top": None, "bottom": None, "left": None, "right": None, "insideH": None, "insideV": None},
    "grid": {"top": 4, "bottom": 4, "left": 4, "right": 4, "insideH": 4, "insideV": 4},
    "horizontal": {"top": 8, "bottom": 8, "left": None, "right": None, "insideH": 4, "insideV": None},
}


def border_edges(convention: Column) -> Column:
    edges = lambda kind: F.create_map(*[x for e, w in BORDERS[kind].items() for x in (F.lit(e), F.lit(w).cast("int"))])
    return F.when(convention == "none", edges("none")).when(convention == "grid", edges("grid")).otherwise(edges("horizontal"))


def one_top_heading(sections: DataFrame) -> DataFrame:
    """Headings (doc_id, section, pos, level) where each section's first has level 1 and all others less."""
    first = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("pos")) == 1
    return sections.withColumn("level", F.when(first, 1).otherwise(F.greatest(F.lit(2), F.col("level"))))


def padded_rows(rows: Column, width: Column) -> Column:
    """Ragged table rows cut or filled up with empty cells."""
    return F.transform(rows, lambda r: F.transform(F.sequence(F.lit(1), width), lambda i: F.coalesce(F.try_element_at(r, i), F.lit(""))))


def list_items(items: Column, ordered: Column) -> Column:
    return F.transform(items, lambda t, i: F.concat(F.when(ordered, F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("• "), t))


def code_parts(lines: Column, per_part: int) -> Column:
    """The lines of a listing in parts of at most ``per_part``."""
    parts = F.ceil(F.size(lines) / per_part).cast("int")
    return F.when(F.size(lines) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.slice(lines, k * per_part + 1, per_part)))


def fit_chart(labels: Column, values: Column) -> Column:
    """(labels, values) trimmed to one length; labels made up where there are none; null for fewer than two values."""
    made = F.transform(F.sequence(F.lit(1), F.size(values)), lambda i: F.concat(F.lit("Item "), i.cast("string")))
    n = F.least(F.size(labels), F.size(values))
    good = F.when(n > 0, F.struct(F.slice(labels, 1, n).alias("labels"), F.slice(values, 1, n).alias("values"))).otherwise(F.struct(made.alias("labels"), values.alias("values")))
    return F.when(F.size(values) >= 2, good)


def safe_chart(labels: Column, values: Column) -> Column:
    """Labels if there are enough, else made up; three values where there are none."""
    n = F.size(values)
    made = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("Item "), i.cast("string")))
    empty = F.array().cast("array<string>")
    return F.struct(
        F.when(n == 0, empty).when((F.size(labels) > 0) & (F.size(labels) >= n), F.slice(labels, 1, n)).otherwise(made).alias("labels"),
        F.when(n == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).otherwise(values).alias("values"),
    )


def scatter_x(own: Column, labels: Column, values: Column) -> Column:
    """The x of each value: its own if there are enough, else labels that are all numbers, else 0, 1, 2 ..."""
    numbers = F.transform(labels, lambda t: t.try_cast("double"))
    n, usable = F.size(values), ~F.exists(numbers, lambda v: v.isNull())
    counted = F.when(n == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i.cast("double")))
    return F.when(F.size(own) >= n, F.slice(own, 1, n)).when(usable & (F.size(labels) >= n), F.slice(numbers, 1, n)).otherwise(counted)


def majority(rows: DataFrame, value: str, weight: Column) -> DataFrame:
    """The value of each document that carries most weight, the first seen on ties; null if no row speaks."""
    said = rows.where(F.col(value).isNotNull()).groupBy("doc_id", value).agg(F.sum(weight).alias("w"), F.min("sort_path").alias("first"))
    best = said.groupBy("doc_id").agg(F.min_by(value, F.struct(-F.col("w"), F.col("first"))).alias(value))
    return rows.select("doc_id").distinct().join(best, "doc_id", "left")


def merged_runs(runs: Column) -> Column:
    """Neighbouring runs (text, bold) of equal style as one; empty ones go. The work is linear in the runs: where a run begins
    is found first, and each stretch is joined once."""
    same = lambda r, i: F.get(r, i - 2)["bold"].eqNullSafe(F.get(r, i - 1)["bold"])
    begins = lambda r: F.when(F.size(r) > 0, F.filter(F.sequence(F.lit(1), F.size(r)), lambda i: (i == 1) | ~same(r, i))).otherwise(F.array().cast("array<int>"))

    def stretches(r: Column, at: Column) -> Column:
        text = lambda b, k: F.array_join(F.transform(F.slice(r, b, F.coalesce(F.get(at, k + 1), F.size(r) + 1) - b), lambda x: x["text"]), "")
        return F.transform(at, lambda b, k: F.struct(text(b, k).alias("text"), F.get(r, b - 1)["bold"].alias("bold")))

    # read as lambdas' variables: plain columns would be made anew for each run
    return once(F.filter(runs, lambda r: r["text"] != ""), lambda r: F.when(r.isNotNull(), once(begins(r), lambda at: stretches(r, at))))


#: The headings offered for each kind of document (words of the kind, headings), and for any other.
OUTLINES = [
    (["paper", "thesis", "literature", "research"], ["Introduction", "Related Work", "Method", "Results", "Discussion", "Conclusion"]),
    (["report", "case study", "white paper"], ["Executive Summary", "Background", "Findings", "Analysis", "Recommendations"]),
    (["proposal", "grant"], ["Summary", "Problem", "Proposed Approach", "Timeline", "Budget", "Expected Outcomes"]),
    (["assignment", "essay"], ["Introduction", "Discussion", "Conclusion"]),
    (["memo", "brief"], ["Purpose", "Background", "Recommendation", "Next Steps"]),
]
OTHER_OUTLINE = ["Introduction", "Body", "Conclusion"]


def outline(kind: Column) -> Column:
    """The headings for the first kind of which a word stands in the text."""
    out = F.array(*map(F.lit, OTHER_OUTLINE))
    for words, heads in reversed(OUTLINES):
        out = F.when(F.rlike(F.lower(kind), F.lit("|".join(words))), F.array(*map(F.lit, heads))).otherwise(out)
    return out
