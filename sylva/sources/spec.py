"""Sources and sinks of documents that other programs write: specs and drafts as JSON, packed snapshots."""

from __future__ import annotations

import base64
import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPEC_DDL = "struct<title: string, blocks: array<struct<type: string, level: int, text: string, items: array<string>, columns: array<string>, rows: array<array<string>>, caption: string>>, references: array<string>>"


def spec_blocks(specs: DataFrame, column: str = "spec") -> DataFrame:
    """(doc_id, pos, type, level, text, items, columns, rows, caption) of spec texts; what is no JSON gives no block."""
    parsed = specs.select("doc_id", F.from_json(column, SPEC_DDL).alias("s"))
    return parsed.select("doc_id", F.posexplode("s.blocks").alias("i", "b")).select("doc_id", (F.col("i") + 1).alias("pos"), "b.*")


def usable_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that say something: headings and paragraphs with text, lists with items, tables with columns or rows."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    ok = (F.col("type").isin("heading", "paragraph", "equation", "code") & (F.trim("text") != "")) | ((F.col("type") == "list") & some("items")) | ((F.col("type") == "table") & (some("columns") | some("rows"))) | (F.col("type") == "page_break")
    return blocks.where(F.coalesce(ok, F.lit(False)))


def drafts(spark: SparkSession, path: str, most: int = 10) -> DataFrame:
    """The newest draft files of a folder, by when they were written."""
    rows = spark.read.option("multiLine", True).json(path, pathGlobFilter="*.draft.json").select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("written"))
    return rows.orderBy(F.desc("written"), "file").limit(most)


def in_small_batches(texts: DataFrame, rows: int = 200) -> DataFrame:
    """The same rows; their session hands Python workers so many whole texts at a time at most, as a worker holds a batch several
    times over while it packs."""
    spark = texts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))))
    return texts


@F.pandas_udf(StringType())
def pack(text: pd.Series) -> pd.Series:
    """gz: and the base64 of the compressed text."""
    return text.map(lambda t: None if t is None else "gz:" + base64.b64encode(gzip.compress(t.encode(), 6, mtime=0)).decode())


@F.pandas_udf(StringType())
def unpack(text: pd.Series) -> pd.Series:
    """What was packed; a text without the prefix is what it is."""
    return text.map(lambda t: gzip.decompress(base64.b64decode(t[3:])).decode() if t and t.startswith("gz:") else t)


def strip_emphasis(text: Column) -> Column:
    """Typed emphasis taken off, outer marks first; signs that stand alone or within words stay."""
    for _ in range(3):
        text = F.regexp_replace(text, r"(?<![\w*`])(\*\*\*|\*\*|__|\*|_|`)(?=\S)((?:(?!\1).)+?)(?<=\S)\1(?![\w*`])", "$2")
    return text
