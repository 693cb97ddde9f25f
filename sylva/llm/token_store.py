"""Token-id output by bit-plane shuffling.

Texts are encoded with a public tokenizer and stored in document order. A chunk holds whole documents; its ids are cut
into blocks of fixed size, each block is transposed into planes (the k-th byte, or bit, of all its ids) and every plane
is compressed by zstandard. The chunk index (shard, chunk, first id, number of ids, documents and their lengths) is
stored beside the planes, so that a reader finds any document from the index columns alone.

The files are Parquet with one row a chunk: Spark's commit protocol makes them whole even when executors are lost, and
any store that Spark reaches can hold them.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import flat_bytes, slices, tidy
from .pieces import PieceMemory

class Encoder:
    """ids of whole texts, as the tokenizers library gives them.

    A byte-level pre-tokenizer never joins text across a space between two other visible characters to what stands before
    it, so texts are cut there and each different piece is encoded by the library once.
    """

    def __init__(self, path: str, limit: int = 400_000, longest: int = 256):
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), PieceMemory(self.pieces, limit, longest)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        #: Whether a token's first byte is a space, which byte-level vocabularies write as U+0120.
        self.opens = np.array([n.startswith("\u0120") for n in names])

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """See PieceMemory. Pieces whose only space stands before a visible character, and that end with one, are encoded
        side by side in one text: each begins at the one token that opens with its space."""
        inner, edge, got, counts = [], [], [], []
        for p in pieces:
            (inner if p.rfind(" ") == 0 and len(p) > 1 and not p[1].isspace() and not p[-1].isspace() else edge).append(p)
        done: list[str] = []
        for s in range(0, len(inner), 4096):
            part = inner[s : s + 4096]
            ids = self.library(["".join(part)])[0]
            begin = np.flatnonzero(self.opens[ids])
            if len(begin) != len(part):
                edge += part
                continue
            done += part
            got.append(ids)
            counts.append(np.diff(np.r_[begin, len(ids)]))
        for s in range(0, len(edge), 4096):
            own = self.library(edge[s : s + 4096])
            got += own
            counts.append(np.array([len(x) for x in own], np.int64))
        return done + edge, np.concatenate(got), np.concatenate(counts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (a large_string array), one after the other, and how many each text has."""
        raw, offsets = flat_bytes(texts)
        at = np.sort(np.r_[cuts(raw), offsets], kind="stable")
        at = at[np.r_[True, at[1:] != at[:-1]]]
        flat, places = self.memory.gather(raw, at)
        return flat, np.diff(places[np.searchsorted(at, offsets)])


def cuts(raw: np.ndarray) -> np.ndarray:
    """Positions of the spaces that surely stand between two visible characters. Where that is hard to tell from the
    bytes next to a space (white space beyond ASCII begins with C2, E1, E2 or E3), it is not taken."""
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    ascii_ = (raw > 32) & (raw < 127)
    two = (raw >= 0xC3) & (raw <= 0xDF)
    after = ascii_ | two | (raw >= 0xE4)
    before = ascii_.copy()
    before[1:] |= two[:-1]
    at = np.flatnonzero(raw[1:-1] == 32) + 1
    return at[before[at - 1] & after[at + 1]]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def to_planes(ids: np.ndarray, kind: str, pack) -> list[bytes]:
    """The compressed planes of a block of uint32 ids, lowest first; an empty plane stands for zeros alone."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        bits = np.unpackbits(rows, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, i]) for i in range(32)]
    else:
        planes = [np.ascontiguousarray(rows[:, i]) for i in range(4)]
    return [pack(p) if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str, unpack) -> np.ndarray:
    if kind == "bit":
        bits = np.zeros((n, 32), np.uint8)
        for i, p in enumerate(planes):
            if p:
                bits[:, i] = np.unpackbits(np.frombuffer(unpack(p), np.uint8), count=n)
        rows = np.packbits(bits, axis=1, bitorder="little")
    else:
        rows = np.zeros((n, 4), np.uint8)
        for i, p in enumerate(planes):
            if p:
                rows[:, i] = np.frombuffer(unpack(p), np.uint8)
    return rows.reshape(-1).view("<u4")


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0,
    plane: str = "byte", block: int = 1 << 16, chunk: int = 1 << 18, level: int = 3,
) -> None:
    """Writes the ids of all texts to ``path``, in ascending order of ``id_col`` (nulls first, ties by a hash of the text).

    ``plane``: ``byte`` or ``bit``. ``block``: ids that are transposed together. ``chunk``: a chunk is closed at so
    many ids; a document is never split over chunks. Null texts count as empty and consist of ``end_id`` alone;
    repeated rows are stored as often as they come. An empty table gives an empty store. Other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ids = rows.schema["id"].dataType.simpleString()
    rows = rows.withColumns({"h": F.xxhash64("text"), "n": F.monotonically_increasing_id()})  # one id may hold very many rows
    rows = rows.repartitionByRange("id", "h", "n").sortWithinPartitions("id", "h", "n").select("id", "text")
    out = f"shard int, chunk int, first long, n_ids long, ids array<{ids}>, lengths array<long>, kind string, block int, planes array<array<binary>>"

    def run(batches):
        enc, pack = encoder(tokenizer_path), zstandard.ZstdCompressor(level=level).compress
        end = np.array([] if end_id is None else [end_id], np.uint32)
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        held, names, counts, waiting, schema = [], [], [], 0, None

        def close():
            nonlocal number, first, held, names, counts, waiting
            flat = np.concatenate(held)
            planes = [to_planes(flat[s : s + block], plane, pack) for s in range(0, len(flat), block)]
            row = [[shard], [number], [first], [len(flat)], [pa.concat_arrays(names).to_pylist()], [np.concatenate(counts).tolist()], [plane], [block], [planes]]
            number, first, held, names, counts, waiting = number + 1, first + len(flat), [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, schema)], ["shard", "chunk", "first", "n_ids", "ids", "lengths", "kind", "block", "planes"])

        for whole in batches:
            schema = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(whole.schema.field("id").type), pa.list_(pa.int64()), pa.string(), pa.int32(), pa.list_(pa.list_(pa.binary()))]
            for batch, texts in slices(whole, "text", 3 << 20):
                flat, n = enc.encode(texts)
                if len(end):
                    flat, n = np.insert(flat, np.cumsum(n), end), n + 1
                ends, keys, begin = np.cumsum(n), batch.column("id"), 0
                while begin < len(n):  # a chunk is closed behind the document that fills it
                    done = int(ends[begin - 1]) if begin else 0
                    stop = min(int(np.searchsorted(ends, done + chunk - waiting)) + 1, len(n))
                    held.append(flat[done : ends[stop - 1]])
                    names.append(keys.slice(begin, stop - begin))
                    counts.append(n[begin:stop])
                    waiting += int(ends[stop - 1]) - done
                    begin = stop
                    if waiting >= chunk:
                        yield close()
        if names:
            yield close()
        enc.memory.forget(8)  # between tasks only the pieces that come often are remembered

    rows.mapInArrow(tidy(run), out).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per stored document: its id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked
    for, ids (array of int). Shards follow each other in order, so only their totals are summed up in one place."""
    chunks = spark.read.parquet(path)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    key = chunks.schema["ids"].dataType.elementType.simpleString()
    out = f"{id_col} {key}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pydict()
                kind, block, n = row["kind"][0], row["block"][0], row["n_ids"][0]
                parts = [from_planes(p, min(block, n - k * block), kind, unpack) for k, p in enumerate(row["planes"][0])]
                flat = np.concatenate(parts) if parts else np.zeros(0, "<u4")
                lengths = np.asarray(row["lengths"][0], np.int64)
                ends = np.cumsum(lengths)
                start = ends - lengths
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(start, ends)]
                columns = [batch.column("ids").slice(i, 1).flatten(), pa.array(start + (row["before"][0] + row["first"][0])), pa.array(lengths), pa.array(crc, pa.int64())]
                names = [id_col, "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return chunks.join(before, "shard").select("first", "n_ids", "ids", "lengths", "kind", "block", "planes", "before").mapInArrow(tidy(run), out)
