"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one full-dimensional codeword from each codebook. The codebooks are fitted on the
residuals of a bounded sample; a beam search picks the codewords of every vector, and the norm of the sum is stored beside
the codes. A query scores all codes from a table of its inner products with all codewords, and the best are ranked
exactly on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, shared_path, tidy


def usable(batch: pa.RecordBatch, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, matrix) of the vectors of column ``v`` that take part: not null, not zero, all components finite (and
    of ``dim`` components, if given)."""
    column = batch.column("v")
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    dim = dim or int(lengths.max(initial=0))
    at = np.flatnonzero((lengths == dim) & (dim > 0))
    if not len(at):
        return at, np.zeros((0, dim or 0))
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(flat).all(1) & flat.any(1)
    return at[good], flat[good]


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (centres**2).sum(1) - 2 * x @ centres.T
        of = near.argmin(1)
        n = np.bincount(of, minlength=k)
        order, used = np.argsort(of, kind="stable"), np.flatnonzero(n)
        sums = np.add.reduceat(x[order], (np.cumsum(n) - n)[used], axis=0)
        centres = x[rng.integers(0, len(x), k)]
        centres[used] = sums / n[used, None]
    return centres


class Quantiser:
    """``books``: array of codebooks x codewords x dimension, float32."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)

    @staticmethod
    def fit(x: np.ndarray, books: int = 32, words: int = 256, rounds: int = 6, beam: int = 4, seed: int = 5) -> Quantiser:
        """Codebook after codebook on what the best partial sums so far leave over of the sample."""
        rng, found = np.random.default_rng(seed), []
        state = Beam(x)
        for _ in range(books):
            found.append(kmeans(state.residual[:, 0], words, rounds, rng).astype(np.float32))
            state.extend(found[-1], beam)
        return Quantiser(np.stack(found))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(codes.shape[1]))

    def encode(self, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Codes (uint8) and norms of the decoded vectors; the beam keeps the ``beam`` best partial sums."""
        out = np.zeros((len(x), len(self.books)), np.uint8)
        for s in range(0, len(x), 512):
            state = Beam(x[s : s + 512])
            for book in self.books:
                state.extend(book, beam)
            out[s : s + 512] = state.codes[:, 0]
        return out, (self.decode(out) ** 2).sum(1) if len(x) else np.zeros(0, np.float32)


class Beam:
    """The best partial sums of some vectors, best first: their codes, residuals and squared errors."""

    def __init__(self, x: np.ndarray):
        self.residual = x.astype(np.float32)[:, None, :]
        self.codes = np.zeros((len(x), 1, 0), np.uint8)
        self.error = (self.residual**2).sum(2)

    def extend(self, book: np.ndarray, beam: int, chunk: int = 1024) -> None:
        """Every partial sum with every codeword; the ``beam`` best stay."""
        k, norms, kept = len(book), (book**2).sum(1), []
        for s in range(0, len(self.residual), chunk):
            residual, codes = self.residual[s : s + chunk], self.codes[s : s + chunk]
            flat = (self.error[s : s + chunk, :, None] - 2 * residual @ book.T + norms).reshape(len(residual), -1)
            width, rows = min(beam, flat.shape[1]), np.arange(len(residual))[:, None]
            pick = np.argpartition(flat, width - 1, 1)[:, :width]
            pick = np.take_along_axis(pick, np.take_along_axis(flat, pick, 1).argsort(1, kind="stable"), 1)
            kept.append((
                residual[rows, pick // k] - book[pick % k],
                np.concatenate([codes[rows, pick // k], (pick % k).astype(np.uint8)[:, :, None]], 2), flat[rows, pick],
            ))
        self.residual, self.codes, self.error = (np.concatenate(x) for x in zip(*kept))


def fit_index(vectors: DataFrame, id_col: str, vector_col: str, sample: int = 8192, **shape) -> Quantiser | None:
    """Codebooks fitted on at most ``sample`` vectors, those with the smallest hash; None if no vector takes part."""
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.withColumn("size", F.size("v"))
    most = rows.groupBy("size").agg(F.count("*").alias("n")).agg(F.max_by("size", F.struct("n", "size")).alias("dim")).first()
    if most["dim"] is None:
        return None
    dim = most["dim"]
    rows = rows.where(F.col("size") == dim).withColumn("text", F.concat_ws(",", F.transform("v", lambda c: c.cast("string"))))
    x = np.array([r["v"] for r in bounded_sample(rows, "size", sample) if None not in r["v"]], float).reshape(-1, dim)
    x = x[np.isfinite(x).all(1) & x.any(1)]
    return Quantiser.fit(x, **shape) if len(x) else None


def search(
    vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, shortlist: int = 128, beam: int = 4, sample: int = 8192,
    codes_per_block: int = 4096, queries_per_block: int = 128, stripes: int | None = None, books: int = 32, words: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of every row for which ``is_query`` (a Column) holds.

    Nearness is the Euclidean distance in double precision on the original vectors, ties to the smaller id; a row is no
    neighbour of itself. Rows whose id or vector is null, and vectors that are zero, hold null or non-finite components
    or have another dimension than most, take no part. With fewer than ``k`` other rows all are returned. Every row is
    indexed; the ``shortlist`` best codes of each query are ranked exactly. Results name ids: of rows that repeat an id the
    nearest counts, so an id stands at most once beside a query's, and a row with the query's own id never does.

    Codes are dealt over ``stripes`` (by default as many as shuffle partitions) in blocks of bounded size. In each
    stripe a block of queries meets one block of codes after the other and hands on one shortlist for all of them, so
    what is gathered for a query grows with the stripes and not with the rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    base = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    quantiser = fit_index(vectors, id_col, vector_col, sample, books=books, words=words)
    if quantiser is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    dim = quantiser.books.shape[2]
    stripes = stripes or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches):
        number = TaskContext.get().partitionId() * 7919
        for whole in batches:
            at, x = usable(whole, dim)
            ids = whole.column("id").take(pa.array(at)).to_numpy(zero_copy_only=False)
            by_id = np.argsort(ids, kind="stable")  # so that a block's repeated ids stand beside each other
            ids, x = ids[by_id], x[by_id]
            for s in range(0, len(at), codes_per_block):
                codes, norms = quantiser.encode(x[s : s + codes_per_block], beam)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([number % stripes], pa.int32()), pa.array([ids[s : s + codes_per_block].astype(np.int64)], pa.list_(pa.int64())), pa.array([codes.tobytes()], pa.binary()), pa.array([norms.tobytes()], pa.binary())], ["stripe", "ids", "codes", "norms"])

    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            at, x = usable(whole, dim)
            ids = whole.column("id").take(pa.array(at)).to_numpy(zero_copy_only=False)
            for s in range(0, len(at), queries_per_block):
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids[s : s + queries_per_block].astype(np.int64)], pa.list_(pa.int64())), pa.array([x[s : s + queries_per_block].astype(np.float32).tobytes()], pa.binary())], ["block", "q_ids", "q"])

    index = shared_path(spark, "ann-index")
    base.mapInArrow(tidy(encode), "stripe int, ids array<long>, codes binary, norms binary").write.parquet(index)
    blocks = spark.read.parquet(index)
    queries = base.where("q").select("id", "v").repartition(stripes).mapInArrow(tidy(pack), "block long, q_ids array<long>, q binary")
    queries = queries.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))

    def meet(batches):
        now, q_ids, table, best_near, best_id = None, None, None, None, None

        def hand_on():
            good = np.isfinite(best_near)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, good.sum(1))), pa.array(best_id[good]), pa.array(best_near[good])], ["query_id", "vec_id", "near"])

        for batch in batches:
            for row in (r for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()):
                if (key := (row["stripe"], row["block"])) != now:
                    if now is not None:
                        yield hand_on()
                    now, q_ids = key, np.asarray(row["q_ids"])
                    q = np.frombuffer(row["q"], np.float32).reshape(len(q_ids), -1)
                    table = np.einsum("qd,mkd->mqk", q, quantiser.books, optimize=True)
                    best_near, best_id = np.zeros((len(q_ids), 0), np.float32), np.zeros((len(q_ids), 0), np.int64)
                ids = np.asarray(row["ids"])
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                near = np.broadcast_to(np.frombuffer(row["norms"], np.float32), (len(q_ids), len(ids))).copy()
                for m in range(codes.shape[1]):
                    near -= 2 * table[m][:, codes[:, m]]
                near[q_ids[:, None] == ids] = np.inf
                if (new := np.append(True, ids[1:] != ids[:-1])).sum() < len(ids):  # of a repeated id the nearest counts
                    near, ids = np.minimum.reduceat(near, np.flatnonzero(new), 1), ids[new]
                if best_id.shape[1]:
                    place = np.minimum(np.searchsorted(ids, best_id), len(ids) - 1)
                    r, c = np.nonzero((ids[place] == best_id) & np.isfinite(best_near))
                    near[r, place[r, c]] = np.minimum(near[r, place[r, c]], best_near[r, c])
                    best_near[r, c] = np.inf
                near, ids = np.concatenate([best_near, near], 1), np.concatenate([best_id, np.broadcast_to(ids, near.shape)], 1)
                width = min(shortlist, near.shape[1])
                pick = np.argpartition(near, width - 1, 1)[:, :width]
                last = np.take_along_axis(near, pick, 1).max(1)
                for r in np.flatnonzero((near <= last[:, None]).sum(1) > width):  # ties at the cut: the smaller ids go on
                    pick[r] = np.lexsort((ids[r], near[r]))[:width]
                best_near, best_id = np.take_along_axis(near, pick, 1), np.take_along_axis(ids, pick, 1)
        if now is not None:
            yield hand_on()

    met = queries.join(blocks, "stripe").select("stripe", "block", "ids", "codes", "norms", "q_ids", "q").mapInArrow(tidy(meet), "query_id long, vec_id long, near float")
    first = Window.partitionBy("query_id").orderBy("near", "vec_id")
    short = met.groupBy("query_id", "vec_id").agg(F.min("near").alias("near")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= shortlist).select("query_id", "vec_id")
    plain = base.select("id", "v")
    paired = short.join(plain.select(F.col("id").cast("long").alias("vec_id"), F.col("v").alias("v")), "vec_id").join(base.where("q").select(F.col("id").cast("long").alias("query_id"), F.col("v").alias("w")), "query_id")

    def exact(batches):
        for batch in batches:
            for s in range(0, len(batch), 4096):
                part = batch.slice(s, 4096)
                both = [part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1) for c in ("v", "w")]
                yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("vec_id"), pa.array(np.sqrt(((both[0] - both[1]) ** 2).sum(1)))], ["query_id", "vec_id", "score"])

    ranked = paired.mapInArrow(tidy(exact), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query_id").cast(kind), F.col("rank").cast("int"), F.col("vec_id").cast(kind), "score")
