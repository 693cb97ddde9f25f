"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of word k-grams. Equal sets become one class at once. Classes whose MinHash signatures agree in some band
are candidates; each candidate pair's MinHash values are compared a few at a time, and the pair is dropped as soon as the
posterior probability that its similarity reaches the threshold falls below the tolerance. The pairs that survive are
verified exactly on the sets of k-grams.

Signatures meet first: the classes of one band's bucket, a large bucket in blocks, each pair of blocks a piece of work of
its own. The pairs that survive the pruning there form groups, so classes that merely share a band do not chain up. Then the
sets of k-grams meet, within these groups only and in blocks again. What leaves a piece grows with its classes: each
one's number of links, and one edge to the next class that it hangs together with. So a bucket or group of any size is
spread over tasks, no pair is written out, and no link is lost.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, Words, at_parts, components, discard, mix, parts_held, perhaps, slices, stored, tidy, with_group

SEED = 99


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """The sorted different k-gram hashes of each text. A text of fewer words has one, of all its words; one without
    words has none."""
    of, _, h = words.grams(k)
    cuts = np.searchsorted(of, np.arange(len(words.of_text)))
    counts, out = words.counts(), []
    for i, n in enumerate(counts):
        if n >= k:
            out.append(np.unique(h[cuts[i] : cuts[i + 1]]))
        elif n:
            own = words.hash[words.of_text[i] : words.of_text[i + 1]]
            out.append(mix(np.array([sum(int(x) * (31**j) for j, x in enumerate(own)) + int(n) & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> str:
    """128 bits of the set, whatever its order."""
    with np.errstate(over="ignore"):
        return f"{int(mix(shingles).sum(dtype=np.uint64)):016x}{int(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)):016x}"


def coefficients(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, hashes, dtype=np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for s in range(0, len(h), 4096):
        least = np.minimum(least, (a[:, None] * h[None, s : s + 4096] + b[:, None]).min(1))
    return least


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` values of each signature."""
    bands = signatures.reshape(len(signatures), -1, rows).astype(np.uint64)
    key = np.zeros(bands.shape[:2], np.uint64)
    for j in range(rows):
        key = key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, j] + np.uint64(1)
    return mix(key + np.arange(key.shape[1], dtype=np.uint64))


def least_matches(hashes: int, step: int, threshold: float, tolerance: float) -> dict[int, int]:
    """After n compared values, the fewest matches at which the posterior probability of reaching the threshold, under a
    uniform prior, is not below the tolerance."""
    out = {}
    for n in range(step, hashes + 1, step):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def pruned(sigs: np.ndarray, i: np.ndarray, j: np.ndarray, needed: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose posterior probability never falls below the tolerance: a few values more are compared each time,
    for the pairs that are left."""
    same, done = np.zeros(len(i), np.int32), 0
    for n, least in needed.items():
        same += (sigs[i, done:n] == sigs[j, done:n]).sum(1, dtype=np.int32)
        ok = same >= least
        i, j, same, done = i[ok], j[ok], same[ok], n
    return i, j


def links_of(sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, rows: int, threshold: float, needed: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) among left x right (each pair once if both are the same)."""
    keys = band_keys(sigs, rows)
    share = np.zeros((len(left), len(right)), bool)
    for k in range(keys.shape[1]):
        share |= keys[left, k][:, None] == keys[right, k][None, :]
    if left is right:
        share = np.triu(share, 1)
    i, j = np.nonzero(share)
    i, j = left[i], right[j]
    size = np.array([len(s) for s in sets])
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    ok = small >= threshold * large - 1e-9
    i, j = pruned(sigs, i[ok], j[ok], needed)
    if not len(i):
        return i, j
    if len(i) <= 48:
        both = np.array([len(np.intersect1d(sets[a], sets[b], True)) for a, b in zip(i, j)])
    else:
        both = _intersections(sets, i, j)
    ok = both >= threshold * (size[i] + size[j] - both) - 1e-9
    return i[ok], j[ok]


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, part: int = 1 << 20) -> np.ndarray:
    """Sizes of the intersections of many pairs: products of 0/1 matrices over the k-grams that at least two sets have, in
    ranges of hashes with about ``part`` k-grams each, so that memory does not grow with the texts."""
    members = np.unique(np.r_[i, j])
    row = np.zeros(len(sets), np.int64)
    row[members] = np.arange(len(members))
    ranges = -(-sum(len(sets[m]) for m in members) // part) or 1
    bounds = np.array([(1 << 64) * k // ranges for k in range(1, ranges)], np.uint64)
    cuts = [np.r_[0, np.searchsorted(sets[m], bounds), len(sets[m])] for m in members]
    total, step = np.zeros((len(members), len(members)), np.float32), max(1, (4 << 20) // len(members))
    for k in range(ranges):
        parts = [sets[m][c[k] : c[k + 1]] for m, c in zip(members, cuts)]
        flat = np.concatenate(parts)
        owner = np.repeat(np.arange(len(members), dtype=np.int32), [len(x) for x in parts])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        first = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.zeros(0, bool)
        code = np.cumsum(first) - 1
        shared = np.bincount(code)[code] > 1 if len(flat) else first
        owner, first = owner[shared], first[shared]
        column = np.cumsum(first) - 1
        for s in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            low, high = np.searchsorted(column, [s, s + step])
            x = np.zeros((len(members), step), np.float32)
            x[owner[low:high], column[low:high] - s] = 1
            total += x @ x.T
    return np.rint(total[row[i], row[j]]).astype(np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest connected number of each of n, by passing minima along the pairs."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == old).all():
            return root


def chained(root: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``at`` in the order of their roots, each with the next one of its root (the last with itself): as many edges
    as rows, and none has more than two."""
    order = at[np.argsort(root[at], kind="stable")]
    following = np.r_[order[1:], order[-1:]]
    return order, np.where(root[following] == root[order], following, order)


def blocks_of(column: pa.Array) -> list[np.ndarray]:
    """The values of a binary column as arrays of 64-bit numbers, copied out of the batch."""
    return [np.frombuffer(v.as_buffer(), np.uint64).copy() for v in column]


class Pieces:
    """Rows of an Arrow stream, ordered by their first three columns, as one piece per value of these."""

    def __init__(self, columns: dict):
        self.columns = columns

    def __call__(self, batches):
        now, held = None, None
        for batch in batches:
            if not len(batch):
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "left", "right"))))
            begin = 0
            while begin < len(keys):
                stop = begin + 1
                while stop < len(keys) and keys[stop] == keys[begin]:
                    stop += 1
                if keys[begin] != now:
                    if now is not None:
                        yield now, held
                    now, held = keys[begin], {c: [] for c in self.columns}
                part = batch.slice(begin, stop - begin)
                for c, read in self.columns.items():
                    held[c] += read(part.column(c))
                begin = stop
        if now is not None:
            yield now, held


def survivors(batches, needed: dict[int, int], pairs: int = 1 << 18):
    """(a, b) edges that connect, within each piece of a bucket, the classes whose signatures survive the pruning.
    Pieces are taken together until they make up ``pairs`` pairs."""
    names: list = []
    sigs: list[np.ndarray] = []
    lefts, rights, waiting = [], [], 0

    def connect():
        both = np.concatenate(sigs).reshape(len(names), -1)
        i, j = pruned(both, np.concatenate(lefts), np.concatenate(rights), needed)
        if not len(i):
            return None
        order, following = chained(_roots(len(names), i, j), np.unique(np.r_[i, j]))
        edge = order != following
        take = lambda x: pa.array([names[k] for k in x[edge]], pa.string())
        return pa.RecordBatch.from_arrays([take(order), take(following)], ["a", "b"])

    read = Pieces({"set": lambda c: c.to_pylist(), "own": lambda c: c.to_pylist(), "sig": lambda c: [np.frombuffer(v.as_buffer(), np.uint32) for v in c]})
    for (_, left, right), held in read(batches):
        n, at = len(held["set"]), len(names)
        if left == right:
            i, j = np.triu_indices(n, 1)
        else:
            own = np.array(held["own"])
            a, b = np.flatnonzero(own == left), np.flatnonzero(own == right)
            i, j = np.repeat(a, len(b)), np.tile(b, len(a))
        if not len(i):
            continue
        names += held["set"]
        sigs += held["sig"]
        lefts.append(i + at)
        rights.append(j + at)
        waiting += len(i)
        if waiting >= pairs:
            if (out := connect()) is not None:
                yield out
            names, sigs, lefts, rights, waiting = [], [], [], [], 0
    if waiting and (out := connect()) is not None:
        yield out


def in_blocks(rows: DataFrame, key: str, blocks: str, *columns: str) -> DataFrame:
    """Every row once for each pair of blocks that its own block is in: key, left, right, set, own and ``columns``."""
    own = F.pmod(F.xxhash64("set"), F.col(blocks)).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    pieces = rows.select(F.col(key).alias("key"), F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "set", "own", *columns)
    return pieces.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "set")


def similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 4,
    tolerance: float = 1e-6, step: int = 16, block: int = 512, block_grams: int = 2 << 20,
) -> DataFrame:
    """One row per input row: id_col, class_id, copy_id, n_copies, n_links, n_text_links.

    ``copy_id``: smallest id of the texts with the same set of word k-grams, ``n_copies`` of them; ``class_id``: smallest
    id of the texts that links connect; ``n_links``: other rows whose similarity is ``threshold`` or more, copies
    included; ``n_text_links``: different sets of k-grams among those.

    Words are lower-cased runs of letters and digits. A text of fewer than ``k`` words counts as one gram of all its
    words; null texts and texts without words link with nothing, not even each other, and are classes of their own.
    Rows with a null id are left out, as nothing could name them; repeated rows count as copies.
    A pair at the threshold is missed with probability (1 - threshold ** rows) ** bands, 3e-6 as set, plus ``tolerance``.
    ``block`` classes, or as many as have about ``block_grams`` k-grams, make up a block. The result is written to the
    shared folder; everything on the way there is deleted.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("h", F.xxhash64("text"))
    a, b = coefficients(bands * rows)
    needed = least_matches(bands * rows, step, threshold, tolerance)

    def featurise(batches):
        for whole in batches:
            for batch, texts in slices(whole, "text"):
                sets = shingle_sets(Words(texts), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc"), batch.column("h"), pa.array([set_key(s) if len(s) else None for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([signature(s, a, b).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc", "h", "set", "grams", "sig"],
                )

    features = stored(source.select("doc", "h", "text").mapInArrow(tidy(featurise), f"doc {kind}, h long, set string, grams long, sig binary"), "features")
    features_at = features.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    classes = stored(
        features_at.where("set is not null").groupBy("set").agg(
            F.min(F.struct("doc", "h")).alias("rep"), F.count("*").alias("copies"), F.max("grams").alias("n_grams"), F.first("sig").alias("sig"), parts_held(),
        ), "classes",
    )

    def cut_bands(batches):
        for batch in batches:
            if len(batch):
                sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(len(batch), -1)
                keys = band_keys(sigs, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("set").take(pa.array(np.repeat(np.arange(len(batch)), keys.shape[1]))), pa.array(keys.reshape(-1))], ["set", "key"])

    banded = classes.select("set", "sig").mapInArrow(tidy(cut_bands), "set string, key long")
    buckets = with_group(banded, "key", "set", F.count("*").alias("n"), keep="n > 1")
    buckets = buckets.select("set", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")).join(classes.select("set", "sig"), "set")
    near = in_blocks(buckets, "key", "blocks", "sig").mapInArrow(tidy(lambda batches: survivors(batches, needed)), "a string, b string")
    groups = components(near)

    members = classes.select("set", "rep.doc", "rep.h", "copies", "sig", "n_grams").join(groups.select(F.col("node").alias("set"), "label"), "set")
    members = with_group(members, "label", "set", F.count("*").alias("size"), F.sum("n_grams").alias("total"))
    parts = F.ceil(F.greatest(F.col("size") / block, F.col("total") / block_grams)).cast("int")
    members = stored(members.select("doc", "h", "set", "copies", "sig", "label", parts.alias("blocks")), "members")
    texts = perhaps(source, members, "doc", "h").where("_perhaps").dropDuplicates(["doc", "h"]).join(members, ["doc", "h"]).select("set", "copies", "sig", "label", "blocks", "text")

    def with_sets(batches):
        for whole in batches:
            for batch, part in slices(whole, "text"):
                sets = shingle_sets(Words(part), k)
                yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, pa.array([s.tobytes() for s in sets], pa.binary())], ["set", "copies", "sig", "label", "blocks", "grams"])

    carried = texts.mapInArrow(tidy(with_sets), "set string, copies long, sig binary, label string, blocks int, grams binary")

    def work(batches):
        listed = lambda c: c.to_pylist()
        read = Pieces({"set": listed, "own": listed, "copies": listed, "sig": lambda c: [np.frombuffer(v.as_buffer(), np.uint32).copy() for v in c], "grams": blocks_of})
        for (_, first, second), held in read(batches):
            once = [i for i, s in enumerate(held["set"]) if not i or s != held["set"][i - 1]]  # a representative may be a repeated row
            held = {c: [v[i] for i in once] for c, v in held.items()}
            n = len(once)
            sigs, which, weight, name = np.stack(held["sig"]), np.array(held["own"]), np.array(held["copies"]), held["set"]
            left = np.flatnonzero(which == first)
            right = left if first == second else np.flatnonzero(which == second)
            i, j = links_of(sigs, held["grams"], left, right, rows, threshold, needed)
            if not len(i):
                continue
            texts = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
            count = np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
            order, following = chained(_roots(n, i, j), np.flatnonzero(texts))
            take = lambda x: pa.array([name[y] for y in x], pa.string())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([take(order), take(following), pa.array(texts[order]), pa.array(count[order].astype(np.int64))], ["a", "b", "texts", "links"])

    found = stored(in_blocks(carried, "label", "blocks", "copies", "sig", "grams").mapInArrow(tidy(work), "a string, b string, texts long, links long"), "links")
    linked = found.groupBy(F.col("a").alias("set")).agg(F.sum("texts").alias("texts"), F.sum("links").alias("links"))
    joined = components(found.select("a", "b"))
    per_class = classes.select("set", F.col("rep.doc").alias("copy_id"), "copies", "_parts").join(linked, "set", "left").join(joined.withColumnRenamed("node", "set"), "set", "left")
    per_class = per_class.select("set", "copy_id", "copies", "_parts", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "set").alias("label"))
    named = with_group(per_class, "label", "set", F.min("copy_id").alias("class_id")).drop("label")
    alone = features.where("set is null").select(F.col("doc").alias(id_col), F.col("doc").alias("class_id"), F.col("doc").alias("copy_id"), F.lit(1).cast("long").alias("n_copies"), *[F.lit(0).cast("long").alias(c) for c in ("n_links", "n_text_links")])
    out = features_at.where("set is not null").select("doc", "set", "_salt").join(at_parts(named), ["set", "_salt"])
    out = out.select(F.col("doc").alias(id_col), "class_id", "copy_id", F.col("copies").alias("n_copies"), (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("texts").alias("n_text_links"))
    result = stored(out.unionByName(alone), "similar")
    for old in (features, classes, groups, members, found, joined):
        discard(old)
    return result


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows whose id is the smallest of their class of near duplicates, all columns as they were. Rows with a null id
    stay; of rows that share an id all stay if it is their class's."""
    classes = similar(docs, id_col, text_col, **options)
    goes = classes.groupBy(id_col).agg(F.max((F.col(id_col) == F.col("class_id")).cast("int")).alias("_first")).where("_first = 0").select(id_col)
    named = perhaps(docs.where(F.col(id_col).isNotNull()), goes, id_col)  # most rows stay for sure and need not be shuffled
    asked = named.where("_perhaps").drop("_perhaps").join(goes, id_col, "left_anti")
    return named.where("not _perhaps").select(docs.columns).unionByName(asked.select(docs.columns)).unionByName(docs.where(F.col(id_col).isNull()))
