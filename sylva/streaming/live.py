"""Commands as a stream: numbered versions, what they do told as events, and sinks that a restart neither repeats nor skips."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.versions import is_checkpoint
from ..plans.structure import _hit
from ..shared import shared_path


class Numbering(StatefulProcessor):
    """A document's commands in the order in which they come (by time within a micro-batch), with the next numbers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        got = pd.concat(list(rows)).sort_values(["ts", "order"], kind="stable")
        begin = self.next.get()[0] if self.next.exists() else 0
        self.next.update((begin + len(got),))
        yield got.assign(seq=range(begin, begin + len(got)))[["doc_id", "seq", "ts", "order", "command"]]

    def close(self) -> None:
        pass


def versions(commands: DataFrame) -> DataFrame:
    """The stream of version rows, one for each command (doc_id, ts, order, command): numbered without gaps, every tenth a
    checkpoint. The numbers are state by document, so a restart goes on where the last committed micro-batch ended."""
    numbered = commands.select("doc_id", "ts", "order", "command").groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=Numbering(), outputStructType="doc_id long, seq long, ts timestamp, `order` long, command string", outputMode="Append", timeMode="None"
    )
    return numbered.withColumns({"is_checkpoint": is_checkpoint(), "parent_seq": F.when(F.col("seq") > 0, F.col("seq") - 1)})


def each_batch(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda rows: rows, keep: bool = False) -> StreamingQuery:
    """Starts the stream and writes what ``work`` makes of each micro-batch under the batch's own number. A batch that is run
    again after a failure has the same rows and replaces what it wrote the first time. ``keep``: the batch is held while
    ``work`` reads it more than once; else the stream's state and Python run again for each reading."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist() if keep else batch
        try:
            work(held).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            if keep:
                held.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(stream: DataFrame, name: str, schema: str, work: Callable[[DataFrame], DataFrame] = lambda rows: rows, keep: bool = False) -> DataFrame:
    """What the stream has written once it has read all that is there."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    each_batch(stream, f"{path}/rows", f"{path}/checkpoint", work, keep).awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    return rows.drop("batch")


#: What the events of an action are called, by its kind; all others are formats.
FAMILIES = {"select": "selection", "copy": "selection", "delete": "delete", "insert": "insert", "move": "move", "replace": "replace"}
ITEMS = {"selection": "selection_item", "delete": "delete_item", "insert": "insert_item", "move": "move_item", "replace": "replace_item"}


def _changes(kind: Column) -> Column:
    """Whether an action does anything to a node that it means."""
    content = F.col("content")
    cased = F.when(F.col("a.kind") == "lower", F.lower(content)).otherwise(F.upper(content))
    found = (F.length("a.find") > 0) & F.contains(content, F.col("a.find"))
    return F.when(kind == "case", cased != content).when(kind == "replace", F.coalesce(found, F.lit(False))).otherwise(F.lit(True))


def told(nodes: DataFrame, actions: DataFrame) -> DataFrame:
    """What running the actions (doc_id, seq, i, type, target, node_ids, kind, find) tells its watchers, as rows (doc_id, seq, i,
    n, event, node_id, total): that a version starts, for each action its start with the nodes it means, each node that it
    changes in document order, and its end; that the version has ended. n counts within (doc_id, seq)."""
    have = set(actions.columns)
    kinds = {"target": "string", "node_ids": "array<string>", "kind": "string", "find": "string"}
    rows = actions.select("doc_id", "seq", F.struct("i", "type", *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]).alias("a"))
    kind = F.col("a.type")
    meant = rows.join(nodes.select("doc_id", "node_id", "type", "sort_path", "content"), "doc_id").where(_hit(F.col("a"), F.lit(False)))
    family = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), kind), F.lit("format"))
    item = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ITEMS.items() for x in kv]), family), F.lit("format_progress"))
    at = ("doc_id", "seq", "i")
    nothing = F.lit(None).cast("string")
    spread = rows.select("doc_id", "seq", F.col("a.i").alias("i"), family.alias("family"))
    total = meant.groupBy("doc_id", "seq", F.col("a.i").alias("i")).agg(F.count("*").alias("total"))
    ends = spread.join(total, list(at), "left").withColumn("total", F.coalesce("total", F.lit(0)))
    items = meant.where(_changes(kind)).select("doc_id", "seq", F.col("a.i").alias("i"), F.lit(1).alias("_step"), "sort_path", item.alias("event"), "node_id", F.lit(None).cast("long").alias("total"))
    path = F.array().cast("array<int>")
    starts = ends.select(*at, F.lit(0).alias("_step"), path.alias("sort_path"), F.concat("family", F.lit("_started")).alias("event"), nothing.alias("node_id"), "total")
    stops = ends.select(*at, F.lit(2).alias("_step"), path.alias("sort_path"), F.concat("family", F.lit("_finished")).alias("event"), nothing.alias("node_id"), "total")
    whole = spread.groupBy("doc_id", "seq").agg(F.count("*").alias("total"))
    edge = lambda place, name: whole.select("doc_id", "seq", F.lit(place).alias("i"), F.lit(0).alias("_step"), path.alias("sort_path"), F.lit(name).alias("event"), nothing.alias("node_id"), "total")
    both = items.unionByName(starts).unionByName(stops).unionByName(edge(-1, "batch_started")).unionByName(edge((1 << 31) - 1, "batch_finished"))
    n = F.row_number().over(Window.partitionBy("doc_id", "seq").orderBy("i", "_step", "sort_path")) - 1
    return both.select("doc_id", "seq", F.when(F.col("i").between(0, (1 << 31) - 2), F.col("i")).alias("i"), n.alias("n"), "event", "node_id", "total")
