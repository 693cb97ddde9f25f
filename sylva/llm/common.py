"""Helpers that several operators share: table access, Arrow batches as flat numpy text, word grams."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = np.uint64(0x9E3779B97F4A7C15)
GRAM = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows in this session, since a row here may hold a long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidy(run):
    """The function for mapInArrow, giving unused memory back to the machine when its task ends: Python workers live on after
    a task, and what they keep would add up over the stages of a job."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library than glibc
            pass

    return tidied


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set a local session gets one under the warehouse; on a
    cluster that is an error, as a folder of one machine would not do."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array with 64-bit offsets, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a large_string array, one after the other, and the n + 1 offsets of its texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash depends on every other."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E6C63D0676A9A99)
    return x ^ (x >> np.uint64(32))


def _word_bytes() -> np.ndarray:
    """Lower-cased byte for a-z, A-Z, 0-9 and every byte of a non-ASCII character; 0 for all others."""
    lut = np.zeros(256, np.uint8)
    lut[48:58] = np.arange(48, 58)
    lut[97:123] = np.arange(97, 123)
    lut[65:91] = np.arange(97, 123)
    lut[128:] = np.arange(128, 256)
    return lut


WORD_BYTES = _word_bytes()


class Words:
    """The words of a batch of texts: start and end byte, 64-bit hash, and the first word of each text.

    A word is a longest run of ASCII letters (lower-cased), digits and non-ASCII characters.
    """

    def __init__(self, texts: pa.Array):
        raw, self.offsets = flat_bytes(texts)
        low = WORD_BYTES[raw]
        inside = low != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(low))]
        first[edges] |= inside[edges]
        last[edges - 1] |= inside[edges - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of_text = np.searchsorted(self.start, self.offsets)  # of_text[i]:of_text[i + 1] are the words of text i
        power = np.full(len(low) + 1, BASE, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        total = np.zeros(len(low) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:-1] * inside, out=total[1:])
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        back = np.full(len(low) + 1, inverse, np.uint64)
        back[0] = 1
        np.cumprod(back, out=back)
        self._total, self._back = total, back
        self.hash = mix((total[self.end] - total[self.start]) * back[self.start])

    def prefixes(self, length: int) -> np.ndarray:
        """64-bit hash of the first ``length`` bytes of each word; 0 for shorter words."""
        stop = np.minimum(self.start + length, self.end)
        return np.where(self.end - self.start >= length, mix((self._total[stop] - self._total[self.start]) * self._back[self.start] ^ BASE), np.uint64(0))

    def counts(self) -> np.ndarray:
        return np.diff(self.of_text)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word within the text, hash) of all runs of k words that lie in one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            empty = np.zeros(0, np.int64)
            return empty, empty, np.zeros(0, np.uint64)
        h, power = np.zeros(n, np.uint64), 1
        for j in range(k):
            h += self.hash[j : j + n] * np.uint64(power)
            power = power * int(GRAM) % (1 << 64)
        text = np.repeat(np.arange(len(self.of_text) - 1), self.counts())
        whole = text[:n] == text[k - 1 :]
        at = np.arange(n)[whole]
        return text[at], at - self.of_text[text[at]], mix(h[whole])


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """The batch cut into runs of rows with about ``limit`` bytes of text each, so that memory stays bounded."""
    texts = strings(batch.column(column))
    if not len(texts):
        return
    offsets = flat_bytes(texts)[1]
    begin = 0
    while begin < len(texts):
        stop = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        stop = min(max(stop, begin + 1), len(texts))
        yield batch.slice(begin, stop - begin), texts.slice(begin, stop - begin)
        begin = stop


def bounded_sample(rows: DataFrame, by: str, sample: int, text_col: str = "text") -> list:
    """At most ``sample`` rows of each value of ``by`` (which has few values): those whose text has the smallest hash, on the
    driver.

    Two passes: about how many different texts each class has, then the rows under a hash bound that lets about 1.5 times the
    sample through, copies of a text once. So what reaches the driver grows with classes x sample only, and it is the same
    for every partitioning.
    """
    rows = rows.where(F.col(by).isNotNull() & F.col(text_col).isNotNull())
    h = F.pmod(F.xxhash64(text_col), F.lit(1 << 40))
    sizes = {r[by]: max(1, r["n"]) for r in rows.groupBy(by).agg(F.approx_count_distinct(h).alias("n")).collect()}
    if not sizes:
        return []
    bound = F.lit(False)
    for value, count in sizes.items():
        share = min(1.0, (1.5 * sample + 50) / count)
        bound = bound | ((F.col(by) == F.lit(value)) & (h < F.lit(int(share * (1 << 40)) + 1)))
    got = sorted(rows.where(bound).withColumn("_h", h).dropDuplicates([by, "_h"]).collect(), key=lambda r: (r["_h"], r[text_col]))
    kept, taken = [], dict.fromkeys(sizes, 0)
    for r in got:
        if taken[r[by]] < sample:
            taken[r[by]] += 1
            kept.append(r)
    return kept


def some_texts(rows: DataFrame, sample: int, text_col: str = "text") -> DataFrame:
    """About 1.5 times ``sample`` rows with different texts, those whose text has the smallest hash; all if there are fewer."""
    h = F.pmod(F.xxhash64(text_col), F.lit(1 << 40))
    count = rows.agg(F.approx_count_distinct(h).alias("n")).first()["n"] or 1
    share = min(1.0, (1.5 * sample + 50) / count)
    return rows.withColumn("_h", h).where(F.col("_h") < F.lit(int(share * (1 << 40)) + 1)).dropDuplicates(["_h"]).drop("_h")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared checkpoint folder and read again, which cuts their lineage."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out.stored_at = path
    return out


def discard(rows: DataFrame) -> None:
    """Deletes what ``stored`` has written, once nothing will read it any more."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(rows.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


SALTS = 32

def parts_held() -> Column:
    """Aggregate: the values of _salt (0 to SALTS - 1) in a group, as bits."""
    return F.expr("bit_or(shiftleft(1L, _salt)) AS _parts")


def with_group(rows: DataFrame, key: str, member: str, *whole: Column, keep: str | None = None) -> DataFrame:
    """The rows with aggregates over all rows of the same ``key`` beside them; ``keep``: a condition on the aggregates.

    A key's rows are spread over up to SALTS parts by a hash of ``member``, and the key's aggregates go to those parts
    only, so no task gets all rows of a frequent key. Rows with a null key are left out.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(member), F.lit(SALTS)).cast("int"))
    sums = salted.groupBy(key).agg(*whole, parts_held())
    if keep:
        sums = sums.where(keep)
    return salted.join(at_parts(sums), [key, "_salt"]).drop("_salt")


def at_parts(sums: DataFrame) -> DataFrame:
    """One row for each part (``_salt``) that the bits of ``_parts`` name."""
    parts = F.expr(f"explode(filter(sequence(0, {SALTS - 1}), i -> (shiftright(_parts, i) & 1) = 1))")
    return sums.withColumn("_salt", parts).drop("_parts")


def perhaps(rows: DataFrame, keys: DataFrame, *columns: str, bits: int = 23) -> DataFrame:
    """The rows with ``_perhaps``: false only if no row of ``keys`` has the same values in ``columns``.

    A bitmap of ``bits`` address bits (1 MB as set, whatever the number of keys) is broadcast, so wide rows that have no
    partner need no shuffle. With very many keys it lets most rows through, which an exact join then sorts out.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(1 << bits))
    marked = keys.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    at = rows.withColumn("_place", place)
    at = at.withColumns({"_bucket": F.bitmap_bucket_number("_place"), "_bit": F.bitmap_bit_position("_place")}).join(F.broadcast(marked), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.expr("shiftright({b}, cast(_bit % 8 as int)) & 1 = 1".format(b="_byte"))
    return at.withColumn("_byte", byte).withColumn("_perhaps", F.coalesce(held, F.lit(False))).drop("_place", "_bucket", "_bit", "_bits", "_byte")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) is connected with.

    Every round each node hooks to the neighbour of the least priority, if that is below its own, and to what that one
    hooks to; edges between what is hooked together vanish and the others go on between the hooks. Priorities are hashes
    that change with the round, so at most about half of the nodes are left, whatever the graph and its names: rounds grow
    with the logarithm of the nodes. It ends when no edge is left, and raises if one is after ``rounds``. Labels meet their
    nodes in salted parts, as one component may hold very many of them.
    """
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = stored(edges.where("a <> b").select(*pair("a", "b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        if len(steps) == rounds:
            raise RuntimeError(f"components: edges are left after {rounds} rounds")
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(left.select("b", "a"))
        hook = ends.groupBy("node").agg(F.min(rank("near")).alias("least")).select("node", F.least("least", rank("node"))["x"].alias("to"))
        hooks = stored(hook.join(hook.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")), "hooks")
        at = lambda c: hooks.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: B023, E731
        rest = stored(left.join(at("a"), "a").join(at("b"), "b").where("a_to <> b_to").select(*pair("a_to", "b_to")).distinct(), "edges")
        discard(left)
        left, steps = rest, [*steps, hooks]
    if not steps:
        return stored(left.select(F.col("a").alias("node"), F.col("a").alias("label")), "components")
    labels = steps[-1].select("node", F.col("to").alias("label"))
    for hooks in reversed(steps[:-1]):  # from the last round back: where a hook's end went afterwards
        salted = hooks.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        jump = salted.groupBy("to").agg(parts_held()).join(labels.withColumnRenamed("node", "to"), "to", "left")
        labels = salted.join(at_parts(jump), ["to", "_salt"]).select("node", F.coalesce("label", "to").alias("label"))
    labels = stored(labels, "labels")
    named = stored(with_group(labels, "label", "node", F.min("node").alias("least")).select("node", F.col("least").alias("label")), "components")
    for old in (left, labels, *steps):
        discard(old)
    return named


def coded_words(texts: pa.Array, inside: np.ndarray, written: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a batch of texts as numbers: the different words, each word's number, and the first word of each text.

    A word is a longest run of bytes that ``inside`` marks (256 booleans); ``written``: what each byte counts as. Words are
    told apart by their bytes, not by hashes. of_text[i]:of_text[i + 1] are the words of text i.
    """
    raw, offsets = flat_bytes(texts)
    within = inside[raw]
    first = within.copy()
    first[1:] &= ~within[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] |= within[edges]
    start = np.flatnonzero(first)
    data = np.ascontiguousarray((raw if written is None else written[raw])[within])
    bounds = np.append(np.cumsum(within, dtype=np.int64)[start] - 1, len(data)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(start, offsets)
