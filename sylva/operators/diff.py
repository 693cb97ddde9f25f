"""What two versions of node tables differ in."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import clip
from ..schema import STYLE

CLIP = 2000
_TOKENS = re.compile(r"\s+|\S+")


def _opcodes(a: list[str], b: list[str]) -> list[tuple]:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


@F.pandas_udf(ArrayType(StructType([StructField("op", StringType()), StructField("text", StringType())])))
def word_segments(before: pd.Series, after: pd.Series) -> pd.Series:
    """Runs of equal, deleted and inserted words; equal and deleted ones spell ``before``, equal and inserted ones
    ``after``."""
    out = []
    for x, y in zip(before, after):
        a, b = _TOKENS.findall(x or ""), _TOKENS.findall(y or "")
        found: list[list[str]] = []
        for tag, i1, i2, j1, j2 in _opcodes(a, b):
            for op, text in (("equal", a[i1:i2]),) if tag == "equal" else (("delete", a[i1:i2]), ("insert", b[j1:j2])):
                if text and found and found[-1][0] == op:
                    found[-1][1] += "".join(text)
                elif text:
                    found.append([op, "".join(text)])
        out.append([{"op": o, "text": t} for o, t in found])
    return pd.Series(out)


@F.pandas_udf(StructType([StructField("added", IntegerType()), StructField("removed", IntegerType())]))
def words_changed(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """How many words were inserted and deleted, over whole texts. Of long ones only what lies between their common
    beginning and end is compared."""
    out = []
    for x, y in zip(before, after):
        x, y = x or "", y or ""
        a, b = _TOKENS.findall(x), _TOKENS.findall(y)
        if max(len(x), len(y)) > CLIP:
            least = min(len(a), len(b))
            begin = next((k for k in range(least) if a[k] != b[k]), least)
            end = next((k for k in range(least - begin) if a[-1 - k] != b[-1 - k]), least - begin)
            a, b = a[begin:len(a) - end], b[begin:len(b) - end]
        words = lambda tokens: sum(not t.isspace() for t in tokens)
        cuts = [(words(b[j1:j2]), words(a[i1:i2])) for tag, i1, i2, j1, j2 in _opcodes(a, b) if tag != "equal"]
        out.append((sum(i for i, _ in cuts), sum(d for _, d in cuts)))
    return pd.DataFrame(out, columns=["added", "removed"])


def _same_style() -> Column:
    same = F.lit(True)
    for name in STYLE:
        same = same & F.col(f"a.style.{name}").eqNullSafe(F.col(f"b.style.{name}"))
    return same


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row for each node that was added, removed or changed: kind, type, text_changed, style_changed and both texts.
    A full outer join on (doc_id, node_id); unchanged nodes are dropped at once."""
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.node_id") == F.col("b.node_id"))
    both = before.alias("a").join(after.alias("b"), on, "full_outer")
    added, removed = F.col("a.node_id").isNull(), F.col("b.node_id").isNull()
    text = ~added & ~removed & ~F.col("a.content").eqNullSafe(F.col("b.content"))
    looks = ~added & ~removed & ~_same_style()
    rows = both.select(
        F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), F.coalesce("a.node_id", "b.node_id").alias("node_id"), F.coalesce("b.type", "a.type").alias("type"),
        F.when(added, "added").when(removed, "removed").when(text | looks, "changed").alias("kind"), text.alias("text_changed"), looks.alias("style_changed"),
        F.col("a.content").alias("before"), F.col("b.content").alias("after"),
    )
    return rows.where("kind is not null")


def style_fields(before: DataFrame, after: DataFrame) -> DataFrame:
    """The style fields that differ, one row each, with both values as text."""
    both = before.alias("a").join(after.alias("b"), ["doc_id", "node_id"])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.style.{f}").cast("string").alias("before"), F.col(f"b.style.{f}").cast("string").alias("after")) for f in sorted(STYLE)])
    rows = both.select("doc_id", "node_id", F.explode(F.filter(pairs, lambda p: ~p["before"].eqNullSafe(p["after"]))).alias("p"))
    return rows.select("doc_id", "node_id", "p.field", "p.before", "p.after")


def segments(diff: DataFrame) -> DataFrame:
    """The word segments of the changed texts, compared on what is kept of long ones."""
    changed = diff.where("text_changed")
    return changed.withColumn("segments", word_segments(clip(F.col("before"), CLIP)["text"], clip(F.col("after"), CLIP)["text"]))


def summary(diff: DataFrame) -> DataFrame:
    """Counts a document: added, removed, changed, text_changed, style_changed, words_added, words_removed,
    the words over whole texts."""
    counts = diff.groupBy("doc_id").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "changed")], F.count_if("text_changed").alias("text_changed"), F.count_if("style_changed").alias("style_changed")
    )
    words = diff.where("text_changed").select("doc_id", words_changed("before", "after").alias("w"))
    words = words.groupBy("doc_id").agg(F.sum("w.added").alias("words_added"), F.sum("w.removed").alias("words_removed"))
    return counts.join(words, "doc_id", "left").fillna(0, ["words_added", "words_removed"])


def changed_ids(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids in exactly one of both, and those whose text or style differ."""
    return compare(before, after).select("doc_id", "node_id")


def outcome_kind(diff: DataFrame) -> DataFrame:
    """The commonest type among a document's changed nodes, ties by the first in order of ids."""
    n = diff.where("kind = 'changed'").groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.min("node_id").alias("first"))
    return n.groupBy("doc_id").agg(F.min_by("type", F.struct(-F.col("n"), F.col("first"))).alias("type"), F.max("n").alias("n"))


def only_in_one(before: DataFrame, after: DataFrame) -> DataFrame:
    """The nodes (doc_id, node_id) of either table that the other does not have, with the side that has them: one
    aggregation over both, repeated rows counting once."""
    both = before.select("doc_id", "node_id", F.lit(1).alias("side")).unionByName(after.select("doc_id", "node_id", F.lit(2).alias("side")))
    sides = both.groupBy("doc_id", "node_id").agg(F.min("side").alias("least"), F.max("side").alias("most"))
    return sides.where("least = most").select("doc_id", "node_id", F.when(F.col("least") == 1, "removed").otherwise("added").alias("kind"))
