"""Live edit events: one stream, rooms by document, a short replay buffer for late joiners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUFFER, HORIZON, ROOMS = 40, 120, 50


def event_stream(spark, path: str, schema) -> DataFrame:
    """Events as they arrive in a folder; the time column becomes one that a watermark accepts."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def counts(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Events by window and name, for batches and streams alike; events later than ``late`` are left out of a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(span.alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a room's events without a longer gap."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy("doc_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def replay_buffer(events: DataFrame, joins: DataFrame) -> DataFrame:
    """What a late joiner (doc_id, joined) gets: the room's last BUFFER events of the last HORIZON seconds."""
    seen = events.join(joins, "doc_id").where((F.col("ts") <= F.col("joined")) & (F.col("ts") >= F.col("joined") - F.expr(f"INTERVAL {HORIZON} SECONDS")))
    n = F.row_number().over(Window.partitionBy("doc_id", "joined").orderBy(F.desc("ts"), F.desc("order")))
    return seen.withColumn("n", n).where(F.col("n") <= BUFFER).withColumn("replayed", F.lit(True))


def kept_rooms(events: DataFrame, most: int = ROOMS) -> DataFrame:
    """The rooms that stay buffered when only ``most`` may: those opened last."""
    opened = events.groupBy("doc_id").agg(F.min(F.struct("ts", "order")).alias("opened"))
    return opened.orderBy(F.desc("opened"), "doc_id").limit(most).select("doc_id", F.col("opened.ts").alias("opened"))


def append_versions(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends the commands of a micro-batch to a version log; a batch that is run again after
    a failure replaces what it wrote the first time."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def command_log(commands: DataFrame, path: str, checkpoint: str):
    """Starts the stream that turns commands into version rows."""
    return commands.writeStream.foreachBatch(append_versions(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
