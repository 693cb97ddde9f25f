"""The shelf of documents: lists, searches, unions and look-ups of styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import STYLE, TARGETS


def newest(documents: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest documents, ties by id, with their rank."""
    top = documents.orderBy(F.desc("created_at"), "doc_id").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("created_at"), "doc_id")))


def union(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Documents of several sources under one schema; blank titles read Untitled."""
    rows = None
    for name, frame in sources:
        part = frame.withColumn("source", F.lit(name)).withColumn("title", F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "Untitled").otherwise(F.col("title")))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows


def source_counts(documents: DataFrame) -> DataFrame:
    """Documents of each source, and of all."""
    return documents.rollup("source").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("all")).alias("source"), "n")


def version_counts(documents: DataFrame, versions: DataFrame) -> DataFrame:
    n = versions.groupBy("doc_id").agg(F.count("*").alias("n_versions"))
    return documents.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n_versions", F.lit(0)).alias("n_versions"))


def resolve_style(requests: DataFrame, wanted: Column, builtin: DataFrame, custom: DataFrame, aliases: DataFrame, default: str) -> DataFrame:
    """The style that each request means: a built-in id, else a custom id, else a custom name, else an alias, else the
    default. The look-up tables have at most a few thousand rows; joins are left to the optimiser."""
    key = F.lower(F.trim(wanted))
    rows = requests.withColumn("_key", key)
    rows = rows.join(builtin.select(F.col("id").alias("_key"), F.col("id").alias("_builtin")), "_key", "left")
    rows = rows.join(custom.select(F.col("id").alias("_key"), F.col("id").alias("_by_id")), "_key", "left")
    by_name = custom.groupBy(F.lower("name").alias("_key")).agg(F.min("id").alias("_by_name"))
    rows = rows.join(by_name, "_key", "left").join(aliases.select(F.col("alias").alias("_key"), F.col("id").alias("_alias")), "_key", "left")
    return rows.withColumn("style_id", F.coalesce("_builtin", "_by_id", "_by_name", "_alias", F.lit(default))).drop("_key", "_builtin", "_by_id", "_by_name", "_alias")


def append_new(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """The rows of the source that the target has not, to be appended."""
    return source.join(target.select(key), key, "left_anti")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last written row of each key: an upsert as reading the newest."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def apply_named(nodes: DataFrame, asked: DataFrame, styles: DataFrame) -> DataFrame:
    """The nodes with the style that their document asks for by name (doc_id, name; letters' case does not count) laid over
    those of its ``target`` class: ``styles`` (name, target, style), where a field that is null leaves what is there. Of
    styles of one name and target the last by name as written holds; unknown names change nothing."""
    one = styles.groupBy(F.lower("name").alias("_name"), "target").agg(F.max_by("style", "name").alias("_over"))
    classes = F.explode(F.array_compact(F.array(*[F.when(F.col("target") == t, F.array(*map(F.lit, types))) for t, types in TARGETS.items()])))
    wanted = asked.select("doc_id", F.lower("name").alias("_name")).distinct().join(one, "_name").select("doc_id", classes.alias("_types"), "_over").select("doc_id", F.explode("_types").alias("type"), "_over")
    merged = F.struct(*[F.coalesce(F.col(f"_over.{f}"), F.col(f"style.{f}")).cast(t).alias(f) for f, t in STYLE.items()])
    joined = nodes.join(wanted.groupBy("doc_id", "type").agg(F.first("_over").alias("_over")), ["doc_id", "type"], "left")
    return joined.withColumn("style", F.when(F.col("_over").isNotNull(), merged).otherwise(F.struct(*[F.col(f"style.{f}").cast(t).alias(f) for f, t in STYLE.items()]))).select(nodes.columns)
