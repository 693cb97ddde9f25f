"""Structural summaries of documents: inventories, sections, conventions and what kind of document it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CITATION, MATHS, word_count
from ..schema import FIGURES, HEADINGS, TEXT, is_type
from .commands import once
from .scope import in_document

PARTS = {
    "paragraphs": TEXT, "headings": ["heading"], "subheadings": ["subheading"], "tables": ["table"], "figures": FIGURES,
    "captions": ["caption"], "references": ["reference"], "footnotes": ["footnote"],
}
SECTION_IDS = 30
#: How headings number themselves, in the order in which the ways are tried.
SCHEMES = [
    ("roman numerals (I., II., III.)", r"^[IVXLCDM]+[.)]\s"), ("decimal (1.1, 1.2)", r"^[0-9]+\.[0-9]+"),
    ("numbered (1., 2., 3.)", r"^[0-9]+[.)]\s"), ("chapters", r"(?i)^chapter\s+[0-9]+"),
]


def inventory(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id").agg(*[F.count_if(is_type(types)).alias(name) for name, types in PARTS.items()])


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def maths_in(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.rlike("content", F.lit(MATHS))).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def scheme_of(content: Column) -> Column:
    text, found = F.trim(content), F.lit(None).cast("string")
    for name, pattern in reversed(SCHEMES):
        found = F.when(F.rlike(text, F.lit(pattern)), name).otherwise(found)
    return found


def _conventions() -> list[Column]:
    """The first heading that numbers itself says how headings are numbered; any citation says how sources are cited."""
    scheme = F.when(is_type(HEADINGS), scheme_of(F.col("content")))
    return [
        F.min_by(scheme, F.when(scheme.isNotNull(), F.col("sort_path"))).alias("heading_numbering"),
        F.when(F.max(F.rlike("content", F.lit(CITATION))), "numbered, [n]").alias("citation_style"),
    ]


def conventions(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id").agg(*_conventions())


def _kind_signs() -> list[Column]:
    """How a document opens (its first twelve nodes by ``_n``), whether a heading names a chapter, whether there are references."""
    opening = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= 12, F.struct("_n", F.substring("content", 1, 200).alias("t"))))), lambda x: x["t"]), " "))
    chapter = F.max((is_type(HEADINGS) & F.contains(F.lower("content"), F.lit("chapter"))).cast("int")) == 1
    refs = F.max((F.col("type") == "reference").cast("int")) == 1
    return [opening.alias("_o"), chapter.alias("_c"), refs.alias("_r")]


def _kind() -> Column:
    paper = F.rlike("_o", F.lit(r"^\s*abstract\b|abstract—|abstract-")) | F.contains("_o", F.lit("index terms"))
    return F.when(paper, "research paper").when(F.col("_c"), "thesis or book").when(F.col("_r"), "report with references").otherwise("document").alias("kind")


def kinds(nodes: DataFrame) -> DataFrame:
    """Paper, thesis, report or document, by the first twelve nodes, the headings and whether there are references."""
    return nodes.withColumn("_n", F.row_number().over(in_document())).groupBy("doc_id").agg(*_kind_signs()).select("doc_id", _kind())


def sections(nodes: DataFrame) -> DataFrame:
    """The top level cut at headings and at nodes that name their own role; what stands before the first cut belongs to
    no section. Maths counts wherever it stands below a top-level node."""
    top = nodes.where("depth = 1")
    maths = nodes.where(F.rlike("content", F.lit(MATHS))).select("doc_id", F.col("sort_path")[0].alias("_top")).distinct().withColumn("_maths", F.lit(True))
    top = top.withColumn("_top", F.col("sort_path")[0]).join(maths, ["doc_id", "_top"], "left")
    role = F.col("meta.role")
    starts = is_type(HEADINGS) | role.isNotNull()
    top = top.withColumn("_s", F.sum(starts.cast("int")).over(in_document().rowsBetween(Window.unboundedPreceding, 0))).where("_s > 0")
    inside = ~starts | role.isNotNull()
    body = F.struct("sort_path", "node_id")
    count = lambda c: F.count_if(inside & c)
    holds = {
        "paragraphs": count(is_type(TEXT)), "tables": count(F.col("type") == "table"), "figures": count(is_type(FIGURES)),
        "captions": count(F.col("type") == "caption"), "references": count(F.col("type") == "reference"), "maths": count(F.coalesce("_maths", F.lit(False))),
    }
    got = top.groupBy("doc_id", "_s").agg(
        F.first(F.when(starts, F.col("node_id")), True).alias("node_id"),
        F.first(F.when(starts, F.coalesce(F.initcap(role), F.substring("content", 1, 80))), True).alias("heading"),
        F.first(F.when(starts, F.when(role.isNotNull() | (F.col("type") == "heading"), 1).otherwise(2)), True).alias("level"),
        (F.first(F.when(starts, F.col("meta.page_index")), True) + 1).alias("page"),
        F.coalesce(F.sum(F.when(inside, word_count(F.col("content")))), F.lit(0)).alias("words"),
        F.array_sort(F.collect_list(F.when(inside, body))).alias("_ids"), *[v.alias(f"_{k}") for k, v in holds.items()],
    )
    return got.select(
        "doc_id", F.col("_s").cast("int").alias("section"), "node_id", "heading", "level", "page", F.col("words").cast("long").alias("words"),
        F.map_filter(F.create_map(*[x for k in holds for x in (F.lit(k), F.col(f"_{k}"))]), lambda _, v: v > 0).alias("holds"),
        F.concat(F.array("node_id"), F.slice(F.transform("_ids", lambda x: x["node_id"]), 1, SECTION_IDS)).alias("node_ids"),
    )


def tops(nodes: DataFrame) -> DataFrame:
    """(doc_id, top): each document's top-level nodes in order, as (type, role, content), in one row."""
    node = F.struct("sort_path", "type", F.col("meta.role").alias("role"), "content")
    return nodes.where("depth = 1").groupBy("doc_id").agg(F.sort_array(F.collect_list(node)).alias("top"))


def read_sections(top: Column) -> Column:
    """The sections (section, heading, about) of a document's ``top``, cut as in ``sections``, with what they are about: here
    all texts in them. It is worked out within the document's row: a task holds one document, however many it has."""
    starts = lambda x: x["type"].isin(HEADINGS) | x["role"].isNotNull()
    inside = lambda x: ~x["type"].isin(HEADINGS) | x["role"].isNotNull()

    def section(top: Column, at: Column, a: Column, k: Column) -> Column:
        head, own = F.get(top, a), F.slice(top, a + 1, F.coalesce(F.get(at, k + 1), F.size(top)) - a)
        heading = F.coalesce(F.initcap(head["role"]), F.substring(head["content"], 1, 80))
        about = F.array_join(F.transform(F.filter(own, inside), lambda x: x["content"]), " ")
        return F.struct((k + 1).alias("section"), heading.alias("heading"), about.alias("about"))

    begins = lambda top: F.array_compact(F.transform(top, lambda x, i: F.when(starts(x), i)))
    return once(top, lambda top: once(begins(top), lambda at: F.transform(at, lambda a, k: section(top, at, a, k))))


def brief(nodes: DataFrame) -> DataFrame:
    """One row a document: kind, inventory, number of sections, conventions. The nodes are read and shuffled once."""
    begins = (F.col("depth") == 1) & (is_type(HEADINGS) | F.col("meta.role").isNotNull())
    parts = [F.count_if(is_type(types)).alias(name) for name, types in PARTS.items()]
    ranked = nodes.withColumn("_n", F.row_number().over(in_document()))
    got = ranked.groupBy("doc_id").agg(*parts, *_kind_signs(), *_conventions(), F.count_if(begins).alias("sections"))
    return got.select("doc_id", *PARTS, _kind(), "heading_numbering", "citation_style", "sections")


def outline(nodes: DataFrame, most: int = 40) -> DataFrame:
    """The first headings of each document, clipped."""
    n = F.row_number().over(in_document())
    return nodes.where(is_type(HEADINGS)).select("doc_id", n.alias("n"), "type", F.substring("content", 1, 60).alias("text")).where(F.col("n") <= most)


def top_sections(nodes: DataFrame, most: int = 25) -> DataFrame:
    """The first sections, and how many are left out."""
    found = sections(nodes).withColumn("total", F.count("*").over(Window.partitionBy("doc_id")))
    return found.where(F.col("section") <= most).select("doc_id", "section", "heading", "words", F.greatest(F.col("total") - most, F.lit(0)).alias("omitted"))


def section_ranks(found: DataFrame) -> DataFrame:
    """Sections with their place by words in their document (the most first, equals share one), their quarter, and how many
    words more they have than the section before and the mean of their neighbours."""
    size, order = Window.partitionBy("doc_id").orderBy(F.desc("words")), Window.partitionBy("doc_id").orderBy("section")
    near = F.avg("words").over(order.rowsBetween(-1, 1))
    return found.select(
        "doc_id", "section", "words", F.rank().over(size).alias("rank"), F.ntile(4).over(Window.partitionBy("doc_id").orderBy(F.desc("words"), "section")).alias("quarter"),
        (F.col("words") - F.lag("words").over(order)).alias("more"), F.lead("section").over(order).alias("next"), F.round(F.col("words") - near, 6).alias("over"),
    )


def passes(nodes: DataFrame, budget: int = 5000) -> DataFrame:
    """Rewritable texts dealt greedily into passes: a new one begins when the running size would exceed the budget. The
    state is carried by a fold over each document's sizes, in document order."""
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("sort_path", F.length("content").alias("n"), "node_id"))), lambda x: F.struct(x["node_id"].alias("node_id"), x["n"].alias("n")))
    got = nodes.groupBy("doc_id").agg(sizes.alias("items"))
    zero = F.struct(F.lit(1).alias("bin"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("bins"))

    def step(acc: Column, item: Column) -> Column:
        new = (acc["used"] > 0) & (acc["used"] + item["n"] > budget)
        number = F.when(new, acc["bin"] + 1).otherwise(acc["bin"])
        return F.struct(number.alias("bin"), F.when(new, item["n"]).otherwise(acc["used"] + item["n"]).alias("used"), F.concat(acc["bins"], F.array(number)).alias("bins"))

    dealt = got.withColumn("bins", F.aggregate("items", zero, step, lambda acc: acc["bins"]))
    return dealt.select("doc_id", F.explode(F.arrays_zip("items", "bins")).alias("x")).select("doc_id", F.col("x.items.node_id").alias("node_id"), F.col("x.bins").alias("pass"))
