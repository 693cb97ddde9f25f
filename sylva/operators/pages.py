"""Pages filled with nodes, long texts cut over two of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines that both halves of a cut text keep, and the types whose texts may be cut.
MIN_LINES = 2
SPLITTABLE = ["body", "paragraph", "reference", "footnote", "caption"]
OUT = "doc_id long, node_id string, part string, page int, text string"


def cut_at(content: str, lines: int, chars: int) -> int:
    """The blank at or before what fits into so many lines; 0 if there is none or all of it fits."""
    best = lines * chars
    return max(0, content.rfind(" ", 0, best + 1)) if 0 < best < len(content) else 0


def fill(nodes: DataFrame, height: float = 700.0, chars: int = 80, line: float = 14.0, gap: float = 14.0) -> DataFrame:
    """The top-level nodes (doc_id, node_id, type, sort_path, content and, if they have them, starts_page and breaks) on pages of
    ``height``: a row (doc_id, node_id, part, page, text) for each, and two, ~a and ~b, for a text that is cut.

    A text has a line of ``line`` for each ``chars`` characters and a ``gap`` behind it. One too tall for what is left of its
    page is cut at a blank if both halves keep two lines; else it begins a page, and one taller than a page owns it. A page
    break ends its page, ``breaks`` of them leave empty ones, and is on none itself; ``starts_page`` begins a page.

    Documents are dealt out and sorted; a task goes through its nodes once and keeps a page's state, not a document.
    """
    have = set(nodes.columns)
    rows = nodes.where("depth = 1").select(
        "doc_id", "node_id", "type", "sort_path", F.coalesce("content", F.lit("")).alias("content"),
        (F.coalesce("starts_page", F.lit(False)) if "starts_page" in have else F.lit(False)).alias("starts"), (F.coalesce("breaks", F.lit(1)) if "breaks" in have else F.lit(1)).cast("int").alias("breaks"),
    )
    dealt = rows.repartition("doc_id").sortWithinPartitions("doc_id", "sort_path").drop("sort_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, page, used, some = None, 1, 0.0, False
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if r["doc_id"] != doc:
                    doc, page, used, some = r["doc_id"], 1, 0.0, False
                if r["type"] == "page_break":
                    page, used, some = page + max(1, r["breaks"]), 0.0, False
                    continue
                if r["starts"] and some:
                    page, used, some = page + 1, 0.0, False
                text = r["content"]
                own = max(1, -(-len(text) // chars)) * line
                tall = own + gap
                if tall <= height - used:
                    out.append((doc, r["node_id"], "", page, text))
                    used, some = used + tall, True
                    continue
                budget = height - used - gap
                if r["type"] in SPLITTABLE and budget >= line * MIN_LINES and tall - budget >= line * MIN_LINES and (at := cut_at(text, int(budget // line), chars)):
                    head, tail = text[:at].rstrip(), text[at:].lstrip()
                    if head and tail:
                        out += [(doc, r["node_id"], "~a", page, head), (doc, r["node_id"], "~b", page + 1, tail)]
                        page, used, some = page + 1, min(tall - budget, height), True
                        continue
                page += some
                out.append((doc, r["node_id"], "", page, text))
                used, some = tall, True
                if tall >= height:
                    page, used, some = page + 1, 0.0, False
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()))], ["doc_id", "node_id", "part", "page", "text"])

    return dealt.mapInArrow(run, OUT)
