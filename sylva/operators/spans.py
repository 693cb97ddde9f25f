"""Formatting of words within nodes: runs with offsets, cut at the edges of matches.

A run is a row (doc_id, node_id, start, end, style), in characters from 0, the end exclusive; the runs of a node cover its text.
A node without rows is one plain run. Styles of runs say only what differs from the node's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import STYLE, STYLE_DDL

NODE = ("doc_id", "node_id")
RUN = f"struct<start: int, end: int, style: {STYLE_DDL}>"


def _plain() -> Column:
    return F.lit(None).cast(STYLE_DDL)


def plain_runs(nodes: DataFrame) -> DataFrame:
    """Every text as one run without a style of its own; empty texts have none."""
    return nodes.where("content <> ''").select(*NODE, F.lit(0).alias("start"), F.length("content").alias("end"), _plain().alias("style"))


def current_runs(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs that still cover their node's text from end to end; nodes whose runs do not, and those without any, are one
    plain run: ``runs`` carries the words that it formatted in ``text``, and other words have no use for it."""
    told = runs.groupBy(*NODE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda r: r["text"]), "").alias("_said"))
    fresh = nodes.join(told, list(NODE), "left").withColumn("_fresh", F.coalesce(F.col("_said") == F.col("content"), F.lit(False)))
    kept = runs.join(fresh.where("_fresh").select(*NODE), list(NODE), "left_semi").select(*NODE, "start", "end", "style")
    return kept.unionByName(plain_runs(fresh.where("not _fresh")))


def matches(nodes: DataFrame, needle: Column, *which: str) -> DataFrame:
    """Where the words of ``needle`` (a column of the nodes; blanks around it do not count) stand, whatever their letters' case:
    (doc_id, node_id, start, end), from left to right and none within another. A node may stand once for each value of
    the columns ``which``."""
    sought = F.lower(F.trim(needle))
    quoted = F.concat(F.lit("\\Q"), F.replace(sought, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    low = F.lower(F.col("content"))
    found = nodes.where((F.coalesce(sought, F.lit("")) != "") & F.contains(low, sought))
    gaps = F.transform(F.split(low, quoted, -1), F.length)
    each = found.select(*NODE, *which, F.length(sought).alias("_n"), F.posexplode(F.slice(gaps, F.lit(1), F.size(gaps) - 1)).alias("_k", "_gap"))
    so_far = Window.partitionBy(*NODE, *which).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    end = (F.sum(F.col("_gap") + F.col("_n")).over(so_far)).cast("int")
    return each.withColumn("end", end).select(*NODE, (F.col("end") - F.col("_n")).alias("start"), "end")


def overlay(runs: DataFrame, spans: DataFrame, **patch) -> DataFrame:
    """The runs with the patch's style fields on what the spans cover, cut at the spans' edges; neighbours that are alike
    are one run again. Spans may overlap, and parts of a span outside all runs are left out.

    A sweep: the edges of runs and spans in order, and between two of them the run that began last and whether any span
    is open. One shuffle by node, however many spans there are.
    """
    edge = lambda at, run, open_: F.struct(F.col(at).alias("at"), run.cast(RUN).alias("run"), F.lit(open_).alias("open"))
    none = F.lit(None)
    of_runs = runs.select(*NODE, F.explode(F.array(edge("start", F.struct("start", "end", "style"), 0), edge("end", none, 0))).alias("_e"))  # read once for both ends
    of_spans = spans.where(F.col("start") < F.col("end")).select(*NODE, F.explode(F.array(edge("start", none, 1), edge("end", none, -1))).alias("_e"))
    all_edges = of_runs.unionByName(of_spans).select(*NODE, F.col("_e.at").alias("_at"), F.col("_e.run").alias("_run"), F.col("_e.open").alias("_open"))
    order = Window.partitionBy(*NODE).orderBy("_at")
    so_far = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)  # edges at one place count together; the last of them opens a piece
    pieces = all_edges.select(*NODE, F.col("_at").alias("start"), F.lead("_at").over(order).alias("end"), F.last("_run", True).over(so_far).alias("_run"), (F.sum("_open").over(so_far) > 0).alias("_on")).where("start < end")
    inside = pieces.where(F.col("_run").isNotNull() & (F.col("end") <= F.col("_run.end")))
    fields = [F.when(F.col("_on") & F.lit(f in patch and patch[f] is not None), F.lit(patch.get(f)).cast(t)).otherwise(F.col(f"_run.style.{f}")).alias(f) for f, t in STYLE.items()]
    return joined(inside.select(*NODE, "start", "end", F.struct(*fields).alias("style")))


def joined(runs: DataFrame) -> DataFrame:
    """Neighbouring runs of one style as one; a style that says nothing is null."""
    said = F.lit(False)
    for f in STYLE:
        said = said | F.col(f"style.{f}").isNotNull()
    rows = runs.withColumn("style", F.when(said, F.col("style")))
    order = Window.partitionBy(*NODE).orderBy("start")
    fresh = ~(F.lag("style").over(order).eqNullSafe(F.col("style")) & F.coalesce(F.lag("end").over(order) == F.col("start"), F.lit(False)))
    # the first and the last run of each stretch, and the first with the end of the last
    edges = rows.withColumn("_first", fresh).withColumn("_last", F.coalesce(F.lead("_first").over(order), F.lit(True))).where("_first or _last")
    end = F.when(F.col("_last"), F.col("end")).otherwise(F.lead("end").over(order))
    return edges.withColumn("end", end).where("_first").select(*NODE, "start", "end", "style")


def with_text(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs with the words that they format."""
    return runs.join(nodes.select(*NODE, "content"), list(NODE)).withColumn("text", F.expr("substring(content, start + 1, end - start)")).drop("content")


def style_phrase(nodes: DataFrame, runs: DataFrame, needle: Column, **patch) -> DataFrame:
    """The runs after formatting just the words of ``needle`` wherever they stand in the nodes."""
    return overlay(runs, matches(nodes, needle), **patch)


def style_spans(nodes: DataFrame, runs: DataFrame, asked: DataFrame, **patch) -> DataFrame:
    """The runs after formatting the words that ``asked`` (doc_id, node_id, text) names, each in its own node only."""
    sought = asked.groupBy(*NODE).agg(F.collect_set("text").alias("_needles"))
    named = nodes.select(*NODE, "content").join(sought, list(NODE)).select(*NODE, "content", F.explode("_needles").alias("_needle"))
    return overlay(runs, matches_each(named, "_needle"), **patch)


def matches_each(named: DataFrame, needle: str) -> DataFrame:
    """``matches`` where a node may stand once for each of several needles."""
    return matches(named.withColumn("_which", F.xxhash64(needle)), F.col(needle), "_which").select(*NODE, "start", "end")


def format_nodes(runs: DataFrame, scope: DataFrame, *fields: str) -> DataFrame:
    """The runs after the given style fields were set on whole nodes (doc_id, node_id of ``scope``): what runs said of these
    fields goes, all else they say stays."""
    hit = scope.select(*NODE, F.lit(True).alias("_hit")).distinct()
    rows = runs.join(hit, list(NODE), "left")
    cleared = F.struct(*[F.when(F.col("_hit") & F.lit(f in fields), F.lit(None).cast(t)).otherwise(F.col(f"style.{f}")).alias(f) for f, t in STYLE.items()])
    return joined(rows.withColumn("style", cleared).drop("_hit"))


def resolved(nodes: DataFrame, runs: DataFrame, default_size: float = 11.0) -> DataFrame:
    """The runs as an export writes them: (doc_id, node_id, start, end, text, and every style field), what a run does not say
    being its node's and what neither says the default: ``default_size`` points, not bold, italic or underlined."""
    whole = with_text(nodes, runs).join(nodes.select(*NODE, F.col("style").alias("_own")), list(NODE))
    last = {"font_size": F.lit(default_size), "bold": F.lit(False), "italic": F.lit(False), "underline": F.lit(False)}
    fields = [F.coalesce(F.col(f"style.{f}"), F.col(f"_own.{f}"), *([last[f]] if f in last else [])).alias(f) for f in STYLE]
    return whole.select(*NODE, "start", "end", "text", *fields)
