"""What a batch did, in one plain sentence, and where a batch without a place belongs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .commands import target as target_of

#: What each target and each type of node is called, one and many.
THINGS = {
    "heading": ("heading", "headings"), "subheading": ("subheading", "subheadings"), "title": ("title", "titles"), "body": ("paragraph", "paragraphs"), "paragraph": ("paragraph", "paragraphs"),
    "caption": ("caption", "captions"), "reference": ("reference", "references"), "footnote": ("footnote", "footnotes"), "table": ("table", "tables"), "table_cell": ("cell", "cells"),
    "table_header": ("table header cell", "table header cells"), "figure": ("figure", "figures"), "image": ("image", "images"), "header": ("page header", "page headers"), "footer": ("page footer", "page footers"),
    "horizontal_rule": ("line", "lines"), "document": ("place", "places"),
}
TYPE_NAMES = {k: v for k, v in THINGS.items() if k not in ("title", "table_header", "document")} | {"table_row": ("row", "rows")}
ALIGNMENT_VERBS = {"center": "centred", "left": "left-aligned", "right": "right-aligned", "justify": "justified"}
CASE_NAMES = {"upper": "capitals", "lower": "lower case", "title": "title case", "sentence": "sentence case"}
NO_LIST = ["none", "off", "remove", "plain", "paragraph"]
#: What an action says of itself; fields that a table lacks count as null.
FIELDS = {
    "type": "string", "target": "string", "n_ids": "int", "kind": "string", "alignment": "string", "bold": "boolean", "italic": "boolean", "underline": "boolean", "color": "string", "font_family": "string",
    "find": "string", "spans": "array<string>", "size": "double", "delta": "double", "scale": "double", "line": "double", "before_pt": "double", "after_pt": "double", "sides": "array<string>", "widths": "map<string,double>", "width": "double", "drawn": "boolean",
}


def _map(table: dict) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])


def _join(items: Column) -> Column:
    """a, b and c."""
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, items[0]).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(items, -1)))


def _number(x: Column) -> Column:
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def _some(*pairs) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), said) for test, said in pairs]))


def _quoted(text: Column) -> Column:
    """As a quoted literal: single quotes, but double ones around a text that has only single ones."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    one, two = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    return F.when(one & ~two, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _what() -> Column:
    """The things that an action touched: words by themselves, else what changed by its commonest type, else what was aimed at."""
    spans, find = F.filter(F.coalesce("spans", F.array().cast("array<string>")), lambda s: s != ""), F.trim(F.coalesce("find", F.lit("")))
    first = F.transform(F.slice(spans, 1, 3), lambda s: F.concat(F.lit("“"), s, F.lit("”")))
    more = F.size(F.coalesce("spans", F.array().cast("array<string>"))) - F.size(first)
    words = F.when(more > 0, F.concat(F.array_join(first, ", "), F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(_join(first))
    changed = F.coalesce("_changed", F.lit(0)) > 0
    name = lambda k: F.when(changed, F.coalesce(F.element_at(_map({t: v[k] for t, v in TYPE_NAMES.items()}), F.col("_kind")), F.lit(("node", "nodes")[k]))).otherwise(
        F.coalesce(F.element_at(_map({t: v[k] for t, v in THINGS.items()}), F.col("target")), F.lit(("node", "nodes")[k])))
    count = F.when(changed, F.col("_changed")).otherwise(F.coalesce("n_ids", F.lit(0)))
    counted = F.when(count == 1, F.concat(F.lit("1 "), name(0))).when(count > 0, F.concat(count.cast("string"), F.lit(" "), name(1))).otherwise(name(1))
    return F.when(F.size(F.coalesce("spans", F.array().cast("array<string>"))) > 0, words).when(find != "", F.concat(F.lit("“"), find, F.lit("”"))).otherwise(counted)


def _style() -> Column:
    given = lambda *c: F.coalesce(*[F.col(x).cast("string") for x in c]).isNotNull()
    said = _some(
        (F.col("bold"), F.lit("bolded")), (F.col("italic"), F.lit("italicised")), (F.col("underline"), F.lit("underlined")), (F.coalesce("color", F.lit("")) != "", F.lit("coloured")),
        (F.coalesce("font_family", F.lit("")) != "", F.concat(F.lit("set "), "font_family", F.lit(" on"))), (~F.col("bold"), F.lit("unbolded")), (~F.col("italic"), F.lit("un-italicised")), (~F.col("underline"), F.lit("removed the underline from")),
    )
    verb = F.when(F.size(said) > 0, _join(said)).otherwise("formatted")
    return F.concat(F.when(given("bold", "italic", "underline", "color", "font_family"), verb).otherwise("formatted"), F.lit(" "), F.col("_what"))


def _borders() -> Column:
    mapped = F.coalesce(F.size(F.map_keys("widths")), F.lit(0)) > 0
    drawn = F.when(mapped, F.array_sort(F.map_keys(F.map_filter("widths", lambda _, w: F.coalesce(w, F.lit(0.0)) > 0)))).otherwise(F.coalesce("sides", F.array().cast("array<string>")))
    said = F.transform(drawn, lambda s: F.replace(F.replace(F.replace(F.replace(s, F.lit("inside_h"), F.lit("inner horizontal")), F.lit("inside_v"), F.lit("inner vertical")), F.lit("header"), F.lit("header-row")), F.lit("_"), F.lit(" ")))
    width = F.when(mapped, F.greatest(F.coalesce("width", F.lit(0.0)), F.array_max(F.transform(F.map_values("widths"), lambda w: F.coalesce(w, F.lit(0.0)))))).otherwise(F.coalesce("width", F.when(F.size(drawn) > 0, 0.5).otherwise(0.0)))
    heavy = F.when(width >= 1.0, "heavy").otherwise("thin")
    what = F.col("_what")
    return F.when(width == 0, F.concat(F.lit("took the borders off "), what)).when(F.size(said) > 0, F.concat(F.lit("drew "), heavy, F.lit(" "), _join(said), F.lit(" borders on "), what, F.lit(", and no others"))).otherwise(F.concat(F.lit("drew "), heavy, F.lit(" borders on "), what))


def phrase() -> Column:
    """What one action did, from its fields and ``_what``; the empty text if there is nothing to tell."""
    kind, what = F.col("type"), F.col("_what")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    sized = lambda up: F.when(up, "larger").otherwise("smaller")
    step = F.col("delta")
    resized = F.when(F.coalesce(step, F.lit(0.0)) != 0, said("made ", what, " ", _number(F.abs(step)), " pt ", sized(step > 0))).when(F.coalesce("size", F.lit(0.0)) != 0, said("set ", what, " to ", _number(F.col("size")), " pt")).otherwise(
        said("made ", what, " ", sized(F.when(F.coalesce("scale", F.lit(0.0)) == 0, 1.0).otherwise(F.col("scale")) > 1)))
    wanted = F.lower(F.coalesce("kind", F.lit("bullet")))
    listed = F.when(wanted.isin(NO_LIST), said("took the bullets off ", what)).when(F.startswith(wanted, F.lit("num")), said("numbered ", what)).otherwise(said("bulleted ", what))
    line = F.col("line")
    lines = F.when(line == 1.0, "single spacing").when(line == 1.5, "one-and-a-half spacing").when(line == 2.0, "double spacing").otherwise(said(_number(line), " line spacing"))
    gaps = _some((line.isNotNull(), lines), (F.col("before_pt").isNotNull(), said(_number(F.col("before_pt")), " pt above")), (F.col("after_pt").isNotNull(), said(_number(F.col("after_pt")), " pt below")))
    rules = {
        "format": _style(), "highlight": said("highlighted ", what), "align": F.lower(said(F.coalesce(F.element_at(_map(ALIGNMENT_VERBS), F.coalesce("alignment", F.lit(""))), F.lit("aligned")), " ", what)), "justify": said("justified ", what),
        "resize": resized, "list": listed, "border": _borders(), "case": said("set ", what, " in ", F.coalesce(F.element_at(_map(CASE_NAMES), F.coalesce("kind", F.lit(""))), F.lit("another case"))),
        "spacing": F.when(F.size(gaps) > 0, said("gave ", what, " ", _join(gaps))).otherwise(said("respaced ", what)), "delete": said("deleted ", what), "replace": said("replaced ", _quoted(F.coalesce("find", F.lit("the text"))), " in ", what),
        "rewrite": said("rewrote ", what), "render_maths": F.when(F.coalesce("drawn", F.lit(True)), "drew the equations as mathematics").otherwise("put the equations back as they were typed"), "insert": F.lit("added a paragraph"), "select": said("selected ", what),
    }
    out = F.lit("")
    for name, column in rules.items():
        out = F.when(kind == name, column).otherwise(out)
    return out


def describe(actions: DataFrame, changed: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """(batch, sentence) of every batch of actions (batch, i and FIELDS).

    ``changed`` (batch, pos, type) are the nodes that changed, in order: things are called what most of them are, the first of
    equals. ``sections`` (batch, section): where, if the sentence does not say so already. A batch with nothing to tell has
    the empty sentence.
    """
    have = set(actions.columns)
    rows = actions.select("batch", "i", *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()])
    kinds = changed.groupBy("batch", "type").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    most = kinds.groupBy("batch").agg(F.sum("n").alias("_changed"), F.min_by("type", F.struct((-F.col("n")).alias("n"), "first")).alias("_kind"))
    told = rows.join(most, "batch", "left").withColumn("_what", _what()).withColumn("said", phrase())
    batches = told.groupBy("batch").agg(F.array_sort(F.collect_list(F.when(F.col("said") != "", F.struct("i", "said")))).alias("all")).withColumn("sentence", _join(F.transform("all", lambda s: s["said"])))
    if sections is not None:
        batches = batches.join(sections.select("batch", "section"), "batch", "left")
        new = (F.coalesce("section", F.lit("")) != "") & ~F.contains(F.lower("sentence"), F.lower(F.coalesce("section", F.lit(""))))
        batches = batches.withColumn("sentence", F.when((F.col("sentence") != "") & new, F.concat("sentence", F.lit(" in "), "section")).otherwise(F.col("sentence")))
    whole = F.concat(F.upper(F.substring("sentence", 1, 1)), F.expr("substring(sentence, 2)"), F.lit("."))
    return batches.select("batch", F.when(F.col("sentence") != "", whole).otherwise("").alias("sentence"))


def place(actions: DataFrame, located: DataFrame) -> DataFrame:
    """The actions (batch, i, type, target, node_ids, command) with those that have no place yet put into the section that their
    command names: ``located`` (batch, ids) has its nodes. Batches of more than two actions, actions that name nodes or
    just the target that the command names, and borders, which belong to a table wherever it is, stay as they are."""
    sizes = actions.groupBy("batch").agg(F.count("*").alias("_n"))
    rows = actions.join(sizes, "batch").join(located.select("batch", "ids"), "batch", "left")
    named = F.coalesce(F.col("target") == target_of(F.col("command")), F.lit(False))
    free = (F.coalesce(F.size("node_ids"), F.lit(0)) < 1) & (F.col("type") != "border") & ~named & (F.col("_n") <= 2) & F.col("ids").isNotNull()
    return rows.withColumns({"node_ids": F.when(free, F.col("ids")).otherwise(F.col("node_ids")), "target": F.when(~free, F.col("target"))}).select(actions.columns)
