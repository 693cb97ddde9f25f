"""Ranked lexical search: postings sorted by document within shards, merged a stretch of documents at a time.

A shard is some megabytes of texts of one task. For each of its terms it stores a row with the documents that hold it, in
ascending order of id, as gaps and counts in variable-length bytes. A search sends the query terms' postings of a shard to
one group: there the cursors of an item's terms lie in a heap by the next stretch of documents that they reach, a stretch is
scored once all cursors that stand there are taken off, and a bounded heap keeps the best. The shards' best merge last.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BYTES, coded_words, discard, small_batches, stored, strings, tidy

#: Fixed values of the score and the terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNIT, TF_STEP, LENGTH_STEP, PERCENT, LENGTH_PERCENT, WEIGHT = 1_000_000_000, 1000, 8, 100, 75, 1000
#: Documents that a cursor's step covers.
STRETCH = 1024
#: A null id in a shard: the last of all.
NO_ID = np.iinfo(np.int64).max
INDEX = "shard long, term string, n long, words long, postings binary, lengths binary"


def to_varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values (not negative) as bytes of seven bits each, the last without the top bit; and the bytes of each value."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        more = values >= np.uint64(1 << bits)
        if not more.any():
            break
        width += more
    at = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    for j in range(int(width.max(initial=0))):
        has = width > j
        part = (values[has] >> np.uint64(7 * j)).astype(np.uint8) & 127
        out[at[has] + j] = part | ((width[has] - 1 > j) << 7).astype(np.uint8)
    return out, width


def from_varints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    start = np.append(0, np.flatnonzero(b < 128)[:-1] + 1)
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), start)


def _shard(number: int, ids: np.ndarray, texts: pa.Array) -> pa.RecordBatch | None:
    """The rows of one shard: first its documents that have terms (ids and numbers of terms), then a row for each term."""
    terms, codes, of_text = coded_words(texts, WORD_BYTES != 0, WORD_BYTES)
    counts = np.diff(of_text)
    some = np.flatnonzero(counts)
    if not len(some):
        return None
    order = some[np.argsort(ids[some], kind="stable")]
    place = np.zeros(len(ids), np.int64)
    place[order] = np.arange(len(order))
    key, tf = np.unique(codes * len(order) + np.repeat(place, counts), return_counts=True)
    term, doc = np.divmod(key, len(order))
    begin = np.append(0, np.flatnonzero(np.diff(term)) + 1)
    gap = np.diff(doc, prepend=0)
    gap[begin] = doc[begin]
    data, width = to_varints(np.stack([gap, tf], 1).ravel())
    ends = np.cumsum(width)[1::2]
    bounds = np.append(ends[begin] - width[2 * begin] - width[2 * begin + 1], len(data)).astype(np.int64)
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).cast(pa.binary())
    df = np.diff(np.append(begin, len(term)))
    names = terms.take(pa.array(term[begin])).cast(pa.large_string()).cast(pa.string())
    none = pa.nulls(len(begin), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(begin) + 1, number)), pa.concat_arrays([pa.nulls(1, pa.string()), names]), pa.array(np.append(len(order), df)),
            pa.concat_arrays([pa.array([int(counts.sum())], pa.int64()), none]), pa.concat_arrays([pa.array([ids[order].tobytes()], pa.binary()), held]),
            pa.concat_arrays([pa.array([counts[order].astype(np.int64).tobytes()], pa.binary()), pa.nulls(len(begin), pa.binary())]),
        ],
        names=["shard", "term", "n", "words", "postings", "lengths"],
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 16 << 20) -> DataFrame:
    """The index of all rows, stored in the shared folder (``discard`` removes it).

    A row without a term (null: no postings columns but ``postings``, the ids, and ``lengths``) heads each shard; the others are
    (shard, term, n documents, postings). ``shard_bytes``: bytes of text of a shard; a longer text makes a shard of its own.
    Every row is a document of its own, repeated ones too. Null and empty texts, and texts without terms, are in no shard.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        made, held, size = 0, [], 0
        base = TaskContext.get().partitionId() << 32

        def close():
            ids = np.concatenate([h[0] for h in held])
            return _shard(base + made, ids, pa.concat_arrays([h[1] for h in held]))

        for batch in batches:
            texts, ids = strings(batch.column(1)), batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.append(0, np.asarray(pa.compute.binary_length(texts), np.int64)))
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + shard_bytes - size, side="right")) - 1)
                held, size = [*held, (ids[at:stop], texts.slice(at, stop - at))], size + int(ends[stop] - ends[at])
                at = stop
                if size >= shard_bytes or at < len(texts):
                    if (out := close()) is not None:
                        yield from (out.slice(k, 20_000) for k in range(0, len(out), 20_000))
                    made, held, size = made + 1, [], 0
        if held and (out := close()) is not None:
            yield from (out.slice(k, 20_000) for k in range(0, len(out), 20_000))

    return stored(rows.mapInArrow(tidy(run), INDEX), "search-index")


def merge_item(cursors: list[tuple[np.ndarray, np.ndarray, list, int]], k: int, documents: int) -> list[tuple[int, int]]:
    """(score, -place) of the ``k`` best documents of a shard, as a heap. A cursor: places, impacts, stretches as (stretch, from,
    to) and how often the term stands in the item."""
    heap = [(c[2][0][0], j, 0) for j, c in enumerate(cursors)]
    heapq.heapify(heap)
    best: list[tuple[int, int]] = []
    while heap:
        stretch = heap[0][0]
        scores = np.zeros(min(STRETCH, documents - stretch * STRETCH), np.int64)
        while heap and heap[0][0] == stretch:
            _, j, at = heap[0]
            places, impacts, steps, times = cursors[j]
            _, low, high = steps[at]
            scores[places[low:high] - stretch * STRETCH] += times * impacts[low:high]
            if at + 1 < len(steps):
                heapq.heapreplace(heap, (steps[at + 1][0], j, at + 1))
            else:
                heapq.heappop(heap)
        found = np.flatnonzero(scores > (best[0][0] if len(best) == k else 0))  # an equal score comes too late: its id is larger
        if len(found) > k:
            found = found[np.lexsort((found, -scores[found]))[:k]]
        for p in found:
            entry = (int(scores[p]), -int(p + stretch * STRETCH))
            if len(best) < k:
                heapq.heappush(best, entry)
            else:
                heapq.heappushpop(best, entry)
    return best


def _search_shard(total: int, length: int, k: int, out: pa.Schema):
    """For applyInArrow: the postings of a shard's query terms to the best of each item there."""

    def run(key, table):
        of = {name: table.column(name).to_pylist() for name in ("term", "weight", "postings", "lengths", "items")}
        head = of["term"].index(None)
        ids = np.frombuffer(of["postings"][head], np.int64)
        m = PERCENT - LENGTH_PERCENT + LENGTH_PERCENT * np.frombuffer(of["lengths"][head], np.int64) * total // length
        by_item: dict[tuple, list] = {}
        for term, weight, postings, items in zip(of["term"], of["weight"], of["postings"], of["items"]):
            if term is None:
                continue
            pairs = from_varints(postings)
            places, tf = np.cumsum(pairs[::2]), pairs[1::2]
            impacts = weight * (UNIT * tf // (TF_STEP * tf + LENGTH_STEP * m[places]))
            stretches = places // STRETCH
            begin = np.append(0, np.flatnonzero(np.diff(stretches)) + 1)
            steps = list(zip(stretches[begin].tolist(), begin.tolist(), np.append(begin[1:], len(places)).tolist()))
            for item in items:
                by_item.setdefault((item["item_id"], item["copy"]), []).append((places, impacts, steps, item["times"]))
        rows = [(*item, ids[-p], score) for item, cursors in by_item.items() for score, p in merge_item(cursors, k, len(ids))]
        columns = list(zip(*rows)) or [[]] * 4
        return pa.table([pa.array(columns[0], out.field(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], schema=out)

    return run


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 10, block_items: int = 512, broadcast_pairs: int = 200_000) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of the highest score above 0 for each item, equal scores by ascending
    doc_id (null ids last).

    Weights and lengths count all documents of the index. Items go through in blocks of about ``block_items`` beside each
    other, so a group holds one shard's postings of one block's terms. The items' terms are broadcast if they are at most
    ``broadcast_pairs`` (term, item) pairs, else joined by a shuffle. Repeated items count once; different texts under
    one item_id are ranked each for itself; a null or empty text has no terms and so no rows.
    """
    head = index.where("term is null").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    total, length = head["n"] or 0, head["words"] or 1
    asked = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    blocks = max(1, -(-asked.count() // block_items))
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    pairs = (
        asked.select("item_id", F.md5(F.col("text").cast("binary")).alias("copy"), F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"), F.explode(terms).alias("term"))
        .groupBy("block", "item_id", "copy", "term").agg(F.count("*").alias("times"))
    )
    small = pairs.count() <= broadcast_pairs
    near = F.broadcast if small else (lambda x: x)
    asked_terms = pairs.groupBy("term", "block").agg(F.collect_list(F.struct("item_id", "copy", "times")).alias("items"))
    postings = index.where("term is not null")
    df = postings.join(near(pairs.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(float(WEIGHT)) * F.log((F.lit(2.0 * total + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked_terms.join(near(df), "term").select("term", "block", weight.alias("weight"), "items")
    hits = postings.join(near(weighted), "term").select("shard", "block", "term", "weight", "postings", "lengths", "items")
    heads = index.where("term is null").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "term", F.lit(None).cast("long").alias("weight"), "postings", "lengths", F.lit(None).cast(weighted.schema["items"].dataType).alias("items"))
    kind = weighted.schema["items"].dataType.elementType["item_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("item_id", to_arrow_type(kind)), ("copy", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())])
    found = hits.unionByName(heads).groupBy("shard", "block").applyInArrow(_search_shard(total, length, k, schema), f"item_id {kind.simpleString()}, copy string, doc_id long, score long")
    by = Window.partitionBy("item_id", "copy").orderBy(F.desc("score"), "doc_id")
    best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.select("item_id", "rank", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, shard_bytes: int = 16 << 20) -> DataFrame:
    """``search`` over an index of ``docs`` that is built for it and removed once the ranks are stored."""
    small_batches(docs.sparkSession)
    index = build_index(docs, shard_bytes=shard_bytes)
    ranks = stored(search(index, items, k=k), "search-ranks")
    discard(index)
    return ranks
