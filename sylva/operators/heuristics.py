"""Plain instructions as action rows: what the words alone ask for, with all parameters, for a whole table of commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import commands as C
from .actions import HIGHLIGHT, SIDES
from .commands import once, whole

#: What asks for a list, for other words, for characters to go, for a table's rules.
WANTS_A_LIST = (
    r"\bbullet(?:s|ed|ted|-?point(?:s|ed)?)?\b"
    r"|\b(?:numbered|ordered|unordered|bulleted)\s+list\b"
    r"|\b(?:as|in|into)\s+(?:a\s+)?(?:numbered\s+|bulleted\s+)?list\b"
    r"|\blist(?:ed)?\s+(?:them|these|it|form|format)\b"
    r"|\bitemi[sz]e[ds]?\b|\bdot\s?points?\b|\bpoint\s+form\b"
    r"|\bnumber\s+(?:the|these|those|all|each|every|them)\b"
)
ABOUT_CHARACTERS = (
    r"\bspaces?\b|\bwhitespace\b|\bblank\b|\btabs?\b|\bduplicate\b"
    r"|\bextra\b|\btypos?\b|\bcommas?\b|\bfull stops?\b|\bpunctuation\b"
)
TABLE_CONTEXT = r"\b(?:tables?|header\s+rows?|cells?|columns?|grid)\b"
ABOUT_BORDERS = r"\bborders?\b|\bgridlines?\b" r"|\b(?:lines?|rules?)\b(?=.*" + TABLE_CONTEXT + r")" r"|" + TABLE_CONTEXT + r"(?=.*\b(?:lines?|rules?)\b)"
#: The edges by the words for them, in order; what turns a sentence from keeping to taking away; widths.
SIDE_WORDS = [
    ("header", r"\bheader\s*(?:row|cells?|line|rule|border)?\b|\bunder\s+the\s+head"),
    ("top", r"\b(top|upper|above)\b"),
    ("bottom", r"\b(bottom|lower|below|last)\b"),
    ("left", r"\bleft\b"),
    ("right", r"\bright\b"),
    ("outside", r"\b(outer|outside|around|perimeter)\b"),
    ("inside", r"\b(inner|inside|internal|between)\b"),
    ("inside_h", r"\b(horizontal|rows)\b"),
    ("inside_v", r"\b(vertical|columns?)\b"),
]
TURNS = r"\b(?:remov\w*|delet\w*|drop\w*|hid\w*|without|except|but\s+not|minus|no|none|clear\w*|off)\b"
HEAVY_WORDS, HEAVY_LINE, THIN_LINE = r"\b(bold|thick|heavy|strong|double|dark)\b", 1.5, 0.5
#: Typefaces that a request may name.
FONT_NAMES = ["times new roman", "times", "arial", "calibri", "helvetica", "cambria", "georgia", "garamond", "verdana", "courier new", "courier", "palatino", "book antiqua", "computer modern"]
NO_ALIGNMENT_TARGETS = ["table", "table_cell", "table_header"]

#: What an action row has besides its command's columns.
FIELDS = [
    "type", "target", "kind", "alignment", "color", "highlight", "bold", "italic", "underline", "font_family", "find", "put", "size", "delta", "scale",
    "line", "after_pt", "sides", "width", "instruction",
]


def _has(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit("(?i)" + pattern))


def _any(text: Column, *words: str) -> Column:
    """Whether any of the words stands in the text, be it within another word."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _sides_in(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_has(text, p), side) for side, p in SIDE_WORDS]))


def expanded(sides: Column) -> Column:
    """The edges that a list of names means: outside and inside each mean several."""
    pair = lambda *s: F.array(*map(F.lit, s))
    return F.flatten(F.transform(sides, lambda s: F.when(s == "outside", pair("top", "bottom", "left", "right")).when(s == "inside", pair("inside_h", "inside_v")).otherwise(F.array(s))))


def borders(command: Column) -> Column:
    """(sides, width) that a request about a table's edges asks for; no sides mean all of them.

    The sentence is cut at the word that turns it. Sides named before are kept, those and no others; with sides named
    behind it only, all but these stay; a turn without any side takes all edges away.
    """
    return once(F.lower(command), lambda text: once(F.split(text, "(?i)" + TURNS, 2), lambda cut: _edges(text, cut)))


def _edges(text: Column, cut: Column) -> Column:
    head, tail, turns = F.get(cut, F.lit(0)), F.coalesce(F.get(cut, F.lit(1)), F.lit("")), F.size(cut) > 1
    none = F.array().cast("array<string>")

    def of(keep: Column, drop: Column) -> Column:
        holds = lambda *s: F.size(F.array_intersect(keep, F.array(*map(F.lit, s)))) == len(s)
        more = F.when(holds("inside_h") & _has(head, r"\bhorizontal\b"), F.array(F.lit("top"), F.lit("bottom"))).when(holds("top", "bottom") & _has(head, r"\b(all|every|each)\b"), F.array(F.lit("inside_h")))
        kept = once(more, lambda m: F.when(m.isNotNull(), F.array_sort(F.array_union(keep, m))).otherwise(keep))
        others = F.array_except(F.array(*map(F.lit, SIDES[:6])), expanded(drop))
        width = F.when(_has(text, HEAVY_WORDS), HEAVY_LINE).otherwise(THIN_LINE)
        return F.struct(
            F.when(F.size(keep) > 0, kept).when(F.size(drop) > 0, others).otherwise(none).alias("sides"),
            F.when(F.size(keep) > 0, width).when(F.size(drop) > 0, THIN_LINE).when(turns, 0.0).otherwise(width).alias("width"),
        )

    return once(_sides_in(head), lambda keep: once(_sides_in(tail), lambda drop: of(keep, drop)))


def font(command: Column) -> Column:
    """The typeface that a request names."""
    asked = _has(command, r"\b(font|typeface|typeset|set)\b")
    known = F.coalesce(*[F.when(F.contains(F.lower(command), F.lit(n)), n) for n in FONT_NAMES])
    other = F.regexp_extract(command, r"(?i)\bfont\s+(?:to|as|into)\s+([A-Za-z][A-Za-z ]{2,28})", 1)
    return F.when(asked, F.initcap(F.coalesce(known, F.when(other != "", F.trim(other)))))


def actions(commands: DataFrame, text: str = "command") -> DataFrame:
    """The commands with the action that the words of each ask for (FIELDS; what an action does not need is null).

    Rules stand in a fixed order, and the first that fits claims the command: letter case, spacing, a table's edges, a
    list, highlighting, taking away, alignment, size, style, selecting; anything else is left to be rewritten. A phrase that the
    command names decides the scope as much as its target. A null command asks for nothing and has no row.
    """
    c = F.lower(F.col(text))
    rows = commands.where(F.col(text).isNotNull()).withColumns({
        "_target": C.target(F.col(text)), "_phrase": C.phrase(F.col(text)), "_case": C.letter_case(c), "_spacing": whole(C.spacing(c)), "_borders": borders(c),
        "_align": C.alignment(c), "_color": C.color(c), "_font": font(F.col(text)), "_size": whole(C.size(c)), "_style": whole(C.emphasis(c)),
    })
    target, phrase = F.col("_target"), F.col("_phrase")
    scoped = F.coalesce(target, F.when(phrase.isNotNull(), "document"))
    styled = F.col("_color").isNotNull() | F.col("_font").isNotNull() | F.col("_style.bold").isNotNull() | F.col("_style.italic").isNotNull() | F.col("_style.underline").isNotNull()
    gone = F.coalesce(target, F.when(_any(c, "line", "rule"), "horizontal_rule").otherwise("figure"))
    spaced = F.col("_spacing.line").isNotNull() | F.col("_spacing.after_pt").isNotNull()
    sized = F.col("_size.absolute").isNotNull() | F.col("_size.factor").isNotNull() | F.col("_size.step").isNotNull()
    rule = (
        F.when(F.col("_case").isNotNull(), "case").when(spaced, "spacing").when(_has(c, ABOUT_BORDERS), "border").when(_has(c, WANTS_A_LIST), "list")
        .when(_any(c, "highlight"), F.when(_any(c, "remove", "delete", "clear", "no highlight", "without"), "unlight").otherwise("highlight"))
        .when(_any(c, "remove", "delete"), F.when(target.isNull() & _has(c, ABOUT_CHARACTERS), "characters").when(phrase.isNotNull(), "cut").when(gone.isin("paragraph", "body"), "words").otherwise("delete"))
        .when(F.col("_align").isNotNull(), "align").when(sized, "resize").when(styled, "format").when(_any(c, "select", "find", "show", "list"), "select").otherwise("rewrite")
    )
    rows = rows.withColumn("_rule", rule)
    r = F.col("_rule")
    kind = F.when(r == "unlight", "format").when(r.isin("characters", "words"), "rewrite").when(r == "cut", "replace").otherwise(r)
    aim = (
        F.when(r == "case", F.coalesce(target, F.lit("document"))).when(r == "spacing", F.coalesce(F.when(target != "horizontal_rule", target), F.lit("body")))
        .when(r == "border", F.when(target.isin(NO_ALIGNMENT_TARGETS), target).otherwise("table")).when(r.isin("highlight"), F.coalesce(target, F.lit("document")))
        .when(r.isin("unlight", "cut"), F.coalesce(scoped, F.lit("document"))).when(r == "characters", "document").when(r.isin("words", "delete"), gone)
        .when(r == "format", F.coalesce(scoped, F.lit("heading"))).when(r == "select", F.coalesce(target, F.lit("heading"))).otherwise(F.coalesce(target, F.lit("body")))
    )
    step, factor = F.col("_size.step"), F.col("_size.factor")
    listing = F.when(_any(c, "remove", "delete", "un-bullet", "unbullet"), "none").when(_has(c, C.NUMBERING), "number").otherwise("bullet")
    on = lambda rules, value: F.when(r.isin(rules), value)
    found = {
        "type": kind, "target": aim, "kind": F.when(r == "case", F.col("_case")).when(r == "list", listing), "alignment": on(["align"], F.col("_align")),
        "color": F.when(r == "highlight", HIGHLIGHT).when(r == "format", F.col("_color")), "highlight": on(["unlight"], F.lit("")),
        **{f: on(["format"], F.col(f"_style.{f}")) for f in ("bold", "italic", "underline")}, "font_family": on(["format"], F.col("_font")),
        "find": on(["highlight", "unlight", "cut", "format"], phrase), "put": on(["cut"], F.lit("")),
        "size": on(["resize"], F.when(step.isNull() & factor.isNull(), F.col("_size.absolute"))), "delta": on(["resize"], step), "scale": on(["resize"], F.when(step.isNull(), factor)),
        "line": on(["spacing"], F.col("_spacing.line")), "after_pt": on(["spacing"], F.col("_spacing.after_pt")), "sides": on(["border"], F.col("_borders.sides")),
        "width": on(["border"], F.col("_borders.width")), "instruction": on(["rewrite", "characters", "words"], F.trim(F.col(text))),
    }
    return rows.select(*commands.columns, *[found[f].alias(f) for f in FIELDS])


def lowered(actions: DataFrame, doc_id: str = "doc_id", seq: str = "seq") -> DataFrame:
    """The actions as stored rows that ``structure.replay`` runs: edges become widths, and a highlight that is to go becomes a
    normalisation. What asks for new words has no row, as it has to be resolved first; nor has what styles a phrase within
    nodes (``spans.style_phrase``)."""
    known = F.col("type").isin("case", "spacing", "border", "list", "highlight", "delete", "replace", "align", "resize", "format", "select")
    whole = F.col("find").isNull() | F.col("type").isin("replace")
    sides = F.when(F.size("sides") > 0, expanded(F.col("sides"))).otherwise(F.array(*map(F.lit, SIDES)))
    widths = F.when(F.col("type") == "border", F.map_from_arrays(F.array_distinct(sides), F.transform(F.array_distinct(sides), lambda _: F.col("width"))))
    kind = F.when((F.col("type") == "format") & F.col("highlight").isNotNull(), "normalize").otherwise(F.col("type"))
    return actions.where(known & whole).select(
        F.col(doc_id).alias("doc_id"), F.col(seq).alias("seq"), F.lit(0).alias("i"), kind.alias("type"),
        *[c for c in ("target", "kind", "alignment", "color", "bold", "italic", "underline", "find", "put", "size", "delta", "scale", "line", "after_pt")], widths.alias("sides"),
    )
