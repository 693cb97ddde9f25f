"""Version logs: append-only rows (doc_id, seq, ts, label, is_checkpoint) and pointers that follow them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVERY = 10


def by_seq():
    return Window.partitionBy("doc_id").orderBy("seq")


def is_checkpoint(forced: Column | None = None) -> Column:
    return (F.col("seq") % EVERY == 0) | (forced if forced is not None else F.lit(False))


def from_log(log: DataFrame) -> DataFrame:
    """Rows (doc_id, ts, order, label) numbered into versions; version 0 and every tenth is a checkpoint."""
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("ts", "order")) - 1
    rows = log.select("doc_id", seq.alias("seq"), "ts", "label")
    return rows.withColumn("is_checkpoint", is_checkpoint()).withColumn("parent_seq", F.when(F.col("seq") > 0, F.col("seq") - 1))


def next_seq(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """The number of each document's next version; 0 for one without any."""
    last = versions.groupBy("doc_id").agg(F.max("seq").alias("last"))
    return documents.select("doc_id").join(last, "doc_id", "left").select("doc_id", F.coalesce(F.col("last") + 1, F.lit(0)).alias("seq"))


def replay_base(versions: DataFrame) -> DataFrame:
    """The checkpoint from which each version is replayed, and how many batches follow it: an as-of lookup in one
    window, not a walk from parent to parent."""
    base = F.max(F.when(F.col("is_checkpoint"), F.col("seq"))).over(by_seq())
    return versions.select("doc_id", "seq", base.alias("base"), (F.col("seq") - base).alias("batches"))


def history(versions: DataFrame, pointers: DataFrame) -> DataFrame:
    """All versions in order with is_checkpoint and is_current."""
    return versions.join(pointers.select("doc_id", "current"), "doc_id", "left").select("doc_id", "seq", "label", "is_checkpoint", (F.col("seq") == F.col("current")).alias("is_current"))


def pointers(versions: DataFrame) -> DataFrame:
    return versions.groupBy("doc_id").agg(F.max("seq").alias("current")).withColumn("redo", F.lit(None).cast("int"))


def undo(at: DataFrame) -> DataFrame:
    """To the parent, remembering what was left for one redo; the first version stays."""
    can = F.col("current") > 0
    return at.select("doc_id", F.when(can, F.col("current") - 1).otherwise(F.col("current")).alias("current"), F.when(can, F.col("current")).otherwise(F.col("redo")).alias("redo"))


def redo(at: DataFrame) -> DataFrame:
    return at.select("doc_id", F.coalesce("redo", "current").alias("current"), F.lit(None).cast("int").alias("redo"))


def rewind(at: DataFrame, seq: int) -> DataFrame:
    """To the given version where there is one; nothing is left to redo."""
    return at.select("doc_id", F.least(F.lit(seq), F.col("current")).alias("current"), F.lit(None).cast("int").alias("redo"))


def commit(versions: DataFrame, label: Column, ts: Column, forced: bool = False) -> DataFrame:
    """The log with one more version of every document."""
    new = versions.groupBy("doc_id").agg((F.max("seq") + 1).alias("seq"))
    new = new.select("doc_id", "seq", ts.alias("ts"), F.substring(label, 1, 60).alias("label"), is_checkpoint(F.lit(forced)).alias("is_checkpoint"), (F.col("seq") - 1).alias("parent_seq"))
    return versions.unionByName(new)


def restore(versions: DataFrame, seq: int, ts: Column) -> DataFrame:
    """A new version, always a checkpoint, that is the old one again."""
    have = versions.where(F.col("seq") == seq).select("doc_id")
    return versions.join(have, "doc_id", "left_anti").unionByName(commit(versions.join(have, "doc_id", "left_semi"), F.lit(f"restore→{seq}"), ts, True))


def as_of(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked rows (doc_id, ts) with ``seq``, the version that was current then: the last one up to that time, null before the
    first. One window over both tables, no join on ranges."""
    have = asked.columns
    both = asked.withColumns({"_seq": F.lit(None).cast("long"), "_asks": F.lit(1)}).unionByName(
        versions.select("doc_id", F.col("ts").cast(asked.schema["ts"].dataType).alias("ts"), F.col("seq").cast("long").alias("_seq"), F.lit(0).alias("_asks")), allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("ts", "_asks", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("seq", F.last("_seq", True).over(order)).where("_asks = 1").select(*have, "seq")


def drop_documents(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("doc_id"), "doc_id", "left_anti")


def materialise(snapshot: DataFrame, batches: list[list[Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """The snapshot with the batches after it replayed in order; ids are deterministic, so a replay gives the same ones.
    The plan grows by at most the batches between two checkpoints."""
    for batch in batches:
        for action in batch:
            snapshot = action(snapshot)
    return snapshot
