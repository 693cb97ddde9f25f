"""Stored action rows, replayed: the log of a corpus is a table, and each document follows its own rows.

One join brings every node the actions of its document since the checkpoint, in order; a fold inside the JVM applies them to
the node's style and content. The plan has the same size however many actions there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentence_case, title_case
from ..operators.actions import HIGHLIGHT, LEAST, MOST
from ..schema import STYLE, TARGETS

#: What a stored action has besides doc_id, seq (its version) and i (its place in the version).
ACTION = {
    "type": "string", "target": "string", "node_ids": "array<string>", "alignment": "string", "color": "string", "size": "double", "delta": "double",
    "scale": "double", "kind": "string", "find": "string", "put": "string", "bold": "boolean", "italic": "boolean", "underline": "boolean",
}
#: The actions that touch one node at a time; those that move, join or cut nodes are functions of operators.actions.
REPLAYED = ["format", "highlight", "align", "justify", "resize", "case", "normalize", "replace"]


def since_checkpoint(actions: DataFrame, versions: DataFrame) -> DataFrame:
    """The actions that follow the last checkpoint of their document: what its newest version is replayed from, and never
    more than the versions between two checkpoints."""
    bases = versions.where("is_checkpoint").groupBy("doc_id").agg(F.max("seq").alias("_base"))
    return actions.join(bases, "doc_id").where(F.col("seq") > F.col("_base")).drop("_base")


def _hit(a: Column) -> Column:
    named = F.lit(False)
    for target, types in TARGETS.items():
        named = named | ((a["target"] == target) & F.col("type").isin(types))
    return F.coalesce(named, F.lit(False)) | F.coalesce(F.array_contains(a["node_ids"], F.col("node_id")), F.lit(False))


def _step(default: float):
    def step(state: Column, a: Column) -> Column:
        style, content, hit, kind = state["style"], state["content"], _hit(a), a["type"]
        on = lambda *kinds: hit & kind.isin(*kinds)
        given = lambda field, test: F.when(test & a[field].isNotNull(), a[field]).otherwise(style[field])
        size = F.when(a["size"] >= 5, a["size"]).otherwise(
            F.bround(F.greatest(F.least(F.coalesce(style["font_size"], F.lit(default)) * F.coalesce(F.when(a["delta"].isNull() & a["size"].isNull(), a["scale"]), F.lit(1.0)) + F.coalesce(a["delta"], a["size"], F.lit(0.0)), F.lit(MOST)), F.lit(LEAST)), 1)
        )
        new = {
            **{f: given(f, on("format")) for f in ("bold", "italic", "underline", "color")},
            "font_size": F.when(on("resize"), size).otherwise(style["font_size"]),
            "alignment": F.when(on("align"), F.coalesce(a["alignment"], F.lit("left"))).when(on("justify"), "justify").otherwise(style["alignment"]),
            "highlight": F.when(on("highlight"), F.coalesce(a["color"], F.lit(HIGHLIGHT))).when(on("normalize"), F.lit(None).cast("string")).otherwise(style["highlight"]),
        }
        cased = F.when(a["kind"] == "lower", F.lower(content)).when(a["kind"] == "title", title_case(content)).when(a["kind"] == "sentence", sentence_case(content)).otherwise(F.upper(content))
        swapped = F.when(F.length(a["find"]) > 0, F.replace(content, a["find"], F.coalesce(a["put"], F.lit("")))).otherwise(content)
        known = F.when(kind.isin(REPLAYED), F.when(on("case"), cased).when(on("replace"), swapped).otherwise(content)).otherwise(
            F.raise_error(F.concat(F.lit("no action of single nodes: "), F.coalesce(kind, F.lit("null")))).cast("string")
        )
        return F.struct(F.struct(*[new.get(f, style[f]).cast(t).alias(f) for f, t in STYLE.items()]).alias("style"), known.alias("content"))

    return step


def replay(nodes: DataFrame, actions: DataFrame, default: float = 11.0) -> DataFrame:
    """The node table of the checkpoint with each document's actions applied in order of (seq, i).

    Documents without actions stay as they are, actions of unknown documents and on targets that nothing belongs to do
    nothing, repeated rows apply again, and an action of another kind than REPLAYED raises. Columns of ACTION that are missing count as null.
    """
    have = set(actions.columns)
    row = F.struct("seq", "i", *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in ACTION.items()])
    logs = actions.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("_log"))
    joined = nodes.join(logs, "doc_id", "left")
    zero = F.struct(F.struct(*[F.col(f"style.{f}").cast(t).alias(f) for f, t in STYLE.items()]).alias("style"), F.col("content").alias("content"))
    state = F.when(F.col("_log").isNotNull(), F.aggregate("_log", zero, _step(default)))
    done = joined.withColumn("_state", F.element_at(F.array(state), 1))
    return done.withColumns({c: F.when(F.col("_log").isNotNull(), F.col(f"_state.{c}")).otherwise(F.col(c)) for c in ("style", "content")}).select(nodes.columns)
