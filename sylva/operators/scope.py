"""Which nodes an action means: targets, sections, tables and their descendants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import HEADINGS, NOT_A_TITLE, TARGETS, TITLE_CHARS, is_type

def in_document():
    """Document order within each document."""
    return Window.partitionBy("doc_id").orderBy("sort_path")


def siblings():
    return Window.partitionBy("doc_id", "parent_id").orderBy("sort_path")


#: The types whose words a rewrite may touch.
REWRITABLE = ["heading", "subheading", "body", "paragraph", "caption", "reference", "footnote", "table_cell"]


def preorder(nodes: DataFrame) -> DataFrame:
    """The nodes with ``pos``, their place in a walk that visits a node before its children."""
    return nodes.withColumn("pos", F.row_number().over(in_document()))


def of_types(nodes: DataFrame, types: list[str]) -> DataFrame:
    return nodes.where(is_type(types))


def parents(nodes: DataFrame) -> DataFrame:
    """node_id with its parent's type; children of the root have ``document``."""
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("type").alias("parent_type"))
    return nodes.join(up, ["doc_id", "parent_id"], "left").withColumn("parent_type", F.coalesce("parent_type", F.lit("document")))


def header_cells(nodes: DataFrame) -> DataFrame:
    """The cells of the rows that are header rows."""
    rows = nodes.where((F.col("type") == "table_row") & F.col("meta.header_row")).select("doc_id", F.col("node_id").alias("parent_id"))
    return nodes.where("type = 'table_cell'").join(rows, ["doc_id", "parent_id"], "left_semi")


def titles(nodes: DataFrame) -> DataFrame:
    """Each document's title: the first node with text of a type that can be one, if it is a heading or short enough."""
    first = nodes.where(~is_type(NOT_A_TITLE) & (F.trim("content") != ""))
    first = first.groupBy("doc_id").agg(F.min_by(F.struct("node_id", "type", "content"), F.col("sort_path")).alias("t"))
    return first.where(F.col("t.type").isin(HEADINGS) | (F.length("t.content") <= TITLE_CHARS)).select("doc_id", "t.*")


def resolve(nodes: DataFrame, target: str) -> DataFrame:
    """The nodes that a target means; an unknown target means none."""
    if target == "table_header":
        return header_cells(nodes)
    if target == "title":
        return nodes.join(titles(nodes).select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi")
    return nodes.where(is_type(TARGETS[target])) if target in TARGETS else nodes.limit(0)


def section_head(nodes: DataFrame) -> DataFrame:
    """The nodes with ``head``: the heading among their siblings that they stand under (null before the first). A
    section ends at the next heading of either kind."""
    heads = F.when(is_type(HEADINGS), F.col("node_id"))
    before = siblings().rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("head", F.last(heads, True).over(before))


def sections_of(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """The nodes below the given headings, up to the next heading, without the headings."""
    chosen = heads.select("doc_id", F.col("node_id").alias("head"))
    return section_head(nodes).where("head <> node_id").join(chosen, ["doc_id", "head"], "left_semi")


def with_descendants(nodes: DataFrame, scope: DataFrame) -> DataFrame:
    """The scope with tables, rows and figures replaced by what they contain that is neither table nor row (a figure
    also stays itself). Ancestors are found by an equi-join on the beginnings of the path."""
    containers = ["table", "table_row", "figure"]
    plain = scope.where(~is_type(containers) | (F.col("type") == "figure")).select("doc_id", "node_id")
    roots = scope.where(is_type(containers)).select("doc_id", F.col("sort_path").alias("prefix"))
    below = nodes.where(~is_type(["table", "table_row"]) & (F.col("depth") > 1)).select(
        "doc_id", "node_id", F.explode(F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda n: F.slice("sort_path", 1, n))).alias("prefix")
    )
    ids = plain.union(below.join(roots, ["doc_id", "prefix"], "left_semi").select("doc_id", "node_id")).distinct()
    return nodes.join(ids, ["doc_id", "node_id"], "left_semi")


def tables_of(nodes: DataFrame, hops: int = 6) -> DataFrame:
    """Each node's nearest table among itself's ancestors, at most ``hops`` up."""
    up = nodes.where("depth > 1").select(
        "doc_id", "node_id", "depth", F.explode(F.transform(F.sequence(F.greatest(F.lit(1), F.col("depth") - hops), F.col("depth") - 1), lambda n: F.slice("sort_path", 1, n))).alias("prefix")
    )
    tables = nodes.where("type = 'table'").select("doc_id", F.col("sort_path").alias("prefix"), F.col("node_id").alias("table_id"))
    return up.join(tables, ["doc_id", "prefix"]).groupBy("doc_id", "node_id").agg(F.max_by("table_id", F.size("prefix")).alias("table_id"))


def introduces_list(nodes: DataFrame) -> DataFrame:
    """The nodes that end with a colon while some later one of the scope does not."""
    colon = F.endswith(F.rtrim(F.col("content")), F.lit(":"))
    later = F.max((~colon).cast("int")).over(in_document().rowsBetween(1, Window.unboundedFollowing))
    return nodes.withColumn("introduces", colon & (F.coalesce(later, F.lit(0)) == 1)).where("introduces").drop("introduces")


def rewritable(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_type(REWRITABLE) & (F.trim("content") != ""))


def keep_known(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked (doc_id, node_id) that exist."""
    return asked.join(nodes.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi")


def valid_edits(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Of the edits (doc_id, node_id, text) those that can be made: of known nodes, with words, and other than the words that
    are there. The same edit stands once."""
    have = nodes.select("doc_id", "node_id", F.col("content").alias("_have"))
    return edits.join(have, ["doc_id", "node_id"]).where((F.trim("text") != "") & (F.col("text") != F.col("_have"))).select(edits.columns).distinct()


def valid_spans(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """Of the spans (doc_id, node_id, text) those whose words, without blanks around them, stand in their node as they are."""
    have = nodes.select("doc_id", "node_id", F.col("content").alias("_have"))
    named = spans.withColumn("text", F.trim("text")).join(have, ["doc_id", "node_id"])
    return named.where((F.col("text") != "") & F.contains("_have", F.col("text"))).select(spans.columns)


def scope(nodes: DataFrame, actions: DataFrame) -> DataFrame:
    """What each action (doc_id, i, node_ids, target) would work on: (doc_id, i, node_id). Ids come before the target, and ids
    that nothing has are passed over; an unknown target means nothing."""
    ids = actions.where("size(node_ids) > 0").select("doc_id", "i", F.explode(F.array_distinct("node_ids")).alias("node_id")).join(nodes.select("doc_id", "node_id"), ["doc_id", "node_id"])
    aimed = actions.where("node_ids is null or size(node_ids) < 1").where("target is not null").select("doc_id", "i", "target")
    plain = F.explode(F.array_compact(F.array(*[F.when(is_type(types), F.lit(t)) for t, types in TARGETS.items()])))
    named = nodes.select("doc_id", "node_id", plain.alias("target"))
    for special, found in (("title", titles(nodes)), ("table_header", header_cells(nodes))):
        named = named.unionByName(found.select("doc_id", "node_id", F.lit(special).alias("target")))
    return ids.select("doc_id", "i", "node_id").unionByName(aimed.join(named, ["doc_id", "target"]).select("doc_id", "i", "node_id"))


def visible_to(documents: DataFrame, owner: Column | None) -> DataFrame:
    """Documents of the owner, and those without one; no owner, no check."""
    return documents if owner is None else documents.where(F.col("owner_id").isNull() | (F.col("owner_id") == owner))
