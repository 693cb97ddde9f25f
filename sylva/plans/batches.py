"""Edit batches as rows: one action a row (batch, i, type, target, node_ids, alignment, size, kind, confirm, style, sides).

Checking and rewriting batches are DataFrame steps, so a corpus of batches is handled like any other table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TARGETS

#: What an action may aim at besides the classes of nodes, and the actions that need an aim.
ALL_TARGETS = [*TARGETS, "title", "table_header"]
NEED_SCOPE = ["format", "highlight", "align", "justify", "resize", "case", "spacing", "border", "list", "delete", "replace", "merge", "split", "normalize"]


def errors(actions: DataFrame) -> DataFrame:
    """The actions with ``errors``: everything that speaks against running them, in a fixed order."""
    at = F.concat(F.lit("action["), F.col("i").cast("string"), F.lit("]: "))
    aimless = F.col("target").isNull() & (F.coalesce(F.size("node_ids"), F.lit(0)) < 1)
    kind = F.col("type")
    checks = [
        (F.col("target").isNotNull() & ~F.col("target").isin(ALL_TARGETS), F.concat(F.lit("unknown target "), F.col("target"))),
        (kind.isin(NEED_SCOPE) & aimless, F.concat(kind, F.lit(" needs a target or node_ids"))),
        ((kind == "align") & ~F.coalesce(F.col("alignment").isin("left", "center", "right", "justify"), F.lit(False)), F.lit("align needs left, center, right or justify")),
        ((kind == "resize") & F.col("size").isNull(), F.lit("resize needs a size, a step or a factor")),
        ((kind == "case") & ~F.coalesce(F.col("kind").isin("upper", "lower", "title", "sentence"), F.lit(False)), F.lit("case needs upper, lower, title or sentence")),
        ((kind == "delete") & F.col("target").isin("paragraph", "body") & (F.coalesce(F.size("node_ids"), F.lit(0)) < 1) & ~F.coalesce("confirm", F.lit(False)), F.concat(F.lit("deleting every "), F.col("target"), F.lit(" needs confirm"))),
    ]
    return actions.withColumn("errors", F.array_compact(F.array(*[F.when(test, F.concat(at, said)) for test, said in checks])))


def merge_borders(actions: DataFrame) -> DataFrame:
    """Border actions of a batch on the same aim as one map of sides, the later width of a side winning."""
    rows = actions.where("type = 'border'").select("batch", "i", "target", F.explode("sides").alias("side", "width"))
    last = rows.groupBy("batch", "target", "side").agg(F.max_by("width", "i").alias("width"))
    return last.groupBy("batch", "target").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("side", "width")))).alias("sides"))


def rules_are_not_type(actions: DataFrame, command: Column) -> DataFrame:
    """Drops what would only embolden text where the command's bold, thick, heavy or strong means a border."""
    has_border = F.max((F.col("type") == "border").cast("int")).over(Window.partitionBy("batch")) == 1
    drop = has_border & F.rlike(command, F.lit(r"(?i)\b(bold|thick|heavy|strong)\b")) & (F.col("type") == "format") & F.coalesce(F.col("style") == "bold", F.lit(False))
    return actions.withColumn("_drop", drop).where("not _drop").drop("_drop")


def atomic(nodes: DataFrame, result: DataFrame, failed: DataFrame) -> DataFrame:
    """The result of a batch, but the nodes as they were in the documents (doc_id) where some action of it failed."""
    return result.join(failed.select("doc_id"), "doc_id", "left_anti").unionByName(nodes.join(failed.select("doc_id"), "doc_id", "left_semi"))


def outcome(reached: Column, changed: Column) -> Column:
    """What to tell of a batch: how much changed, or why nothing did."""
    return F.when(changed > 0, F.concat(changed.cast("string"), F.lit(" changed"))).when(reached > 0, "the document already looks that way").otherwise("nothing matched, so nothing changed")
