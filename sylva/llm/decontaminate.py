"""Benchmark decontamination by CGK embedding.

The CGK random walk reads a string from left to right; at step j it writes the character it stands on and moves on by
one or not, as a random function of j and the character says. Strings within a small edit distance come out with a small
Hamming distance, so sampling a few of the written characters is a locality-sensitive hash for edit distance. Item-sized
windows of the documents and of the benchmark items are embedded by several such walks; a window whose sample equals one of
an item's proposes a place, and the exact edit distance between the item and the text at that place decides.

Windows begin where a word begins and its first ANCHOR characters also begin a word of some item: all of an item's
words count, so an edited item keeps most of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORD_BYTES, Words, flat_bytes, mix, slices, strings, tidy

ANCHOR = 8
#: Walk lengths by the characters that an item has left after the window's beginning, and characters sampled. The shorter
#: windows are for items that have few of the longer ones.
CLASSES = [(72, 16), (28, 9), (12, 4)]


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts in lower case, anything but letters and digits as single zero bytes, none before the first word of a text
    and one after its last; and the n + 1 offsets. A text without words takes no bytes."""
    raw, offsets = flat_bytes(pc.binary_join_element_wise(texts, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())))
    low = WORD_BYTES[raw]
    inside = low != 0
    keep = inside.copy()
    keep[1:] = inside[1:] | inside[:-1]
    counts = np.add.reduceat(keep, offsets[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    return low[keep], np.r_[0, np.cumsum(counts)]


def word_starts(flat: np.ndarray) -> np.ndarray:
    begin = flat != 0
    begin[1:] &= flat[:-1] == 0
    return np.flatnonzero(begin)


def grams_at(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ANCHOR bytes from each position on, as one number."""
    padded = np.r_[flat, np.zeros(ANCHOR, np.uint8)]
    out = np.zeros(len(at), np.uint64)
    for j in range(ANCHOR):
        out |= padded[at + j].astype(np.uint64) << np.uint64(8 * j)
    return out


class Walks:
    """``repeats`` random walks for windows of ``steps`` steps; each samples ``sampled`` of the steps after the anchor."""

    def __init__(self, steps: int, sampled: int, repeats: int, seed: int):
        r = np.random.default_rng(seed)
        self.steps = steps
        self.moves = r.integers(0, 2, (repeats, steps, 256)).astype(np.int8)
        self.moves[:, :, 0] |= r.integers(0, 2, (repeats, steps)).astype(np.int8)
        self.samples = [np.sort(r.choice(np.arange(ANCHOR, steps), sampled, replace=False)) for _ in range(repeats)]

    def hashes(self, flat: np.ndarray, at: np.ndarray, repeat: int) -> np.ndarray:
        """The sampled characters of the walks that begin at the positions ``at``, hashed."""
        padded, where, out = np.r_[flat, np.zeros(self.steps + 1, np.uint8)], at.copy(), np.full(len(at), 1 + repeat, np.uint64)
        wanted = set(self.samples[repeat].tolist())
        for j in range(int(self.samples[repeat][-1]) + 1):
            c = padded[where]
            if j in wanted:
                out = out * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)
            where += self.moves[repeat, j][c]
        return mix(out)


class Items:
    """A block of benchmark items, ready to be looked up. ``keys``: sorted window hashes, each with its item and where
    its window begins in it."""

    def __init__(self, ids: list, texts: list[str], repeats: int, seed: int = 17):
        self.ids, self.repeats, self._pieces = ids, repeats, {}
        flat, offsets = normalised(strings(pa.array(texts, pa.string())))
        self.texts = [flat[a:b].tobytes().rstrip(b"\0") for a, b in zip(offsets[:-1], offsets[1:])]
        starts = word_starts(flat)
        of = np.searchsorted(offsets, starts, side="right") - 1
        length = np.array([len(t) for t in self.texts], np.int64)
        inside = starts - offsets[of] if len(of) else starts
        left = length[of] - inside if len(of) else starts
        self.walks, self.tables, grams = [], [], []
        for n, (steps, sampled) in enumerate(CLASSES):
            walks = Walks(steps, sampled, repeats, seed + n)
            mine = left >= steps
            if n:  # short windows only where an item has too few long ones
                mine &= length[of] < 2 * CLASSES[n - 1][0] if len(of) else mine
            at = starts[mine]
            keys, item, begin = [], [], []
            for r in range(repeats):
                keys.append(walks.hashes(flat, at, r))
                item.append(of[mine])
                begin.append(inside[mine])
            keys, item, begin = (np.concatenate(x) for x in (keys, item, begin))
            order = np.argsort(keys, kind="stable")
            self.walks.append(walks)
            self.tables.append((keys[order], item[order], begin[order]))
            g = np.unique(grams_at(flat, at))
            seen = np.zeros(1 << 24, bool)
            seen[mix(g) >> np.uint64(40)] = True
            grams.append((g, np.packbits(seen)))
        self.grams = grams
        covered = set(np.concatenate([t[1] for t in self.tables]).tolist())
        #: Items too short for a window: all their words, found exactly.
        self.short: dict[int, tuple[np.ndarray, list[int]]] = {}
        by_size: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(self.texts):
            if t and i not in covered:
                words = Words(strings(pa.array([t.replace(b"\0", b" ").decode("utf-8", "replace")])))
                n = len(words.hash)
                by_size.setdefault(n, []).append((int(words.grams(n)[2][0]), i))
        for n, pairs in by_size.items():
            pairs.sort()
            self.short[n] = (np.array([p[0] for p in pairs], np.uint64), [p[1] for p in pairs])

    def pieces(self, item: int, most: int) -> list[bytes]:
        """The item in most + 1 pieces: after at most ``most`` edits one of them is still whole."""
        if (got := self._pieces.get(item)) is None:
            t, n = self.texts[item], most + 1
            got = self._pieces[item] = [t[len(t) * k // n : len(t) * (k + 1) // n] for k in range(n)]
        return got

    def candidates(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sorted different rows (text, item, begin of the item in the flat array, rounded)."""
        starts, found = word_starts(flat), []
        grams = grams_at(flat, starts)
        slot = mix(grams) >> np.uint64(40)
        for (known, seen), walks, (keys, item, begin) in zip(self.grams, self.walks, self.tables):
            if not len(known):
                continue
            maybe = np.flatnonzero((seen[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)) & 1)
            at = np.minimum(np.searchsorted(known, grams[maybe]), len(known) - 1)
            where = starts[maybe[known[at] == grams[maybe]]]
            for r in range(self.repeats):
                h = walks.hashes(flat, where, r)
                low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
                hit = np.flatnonzero(high > low)
                n = high[hit] - low[hit]
                entry = np.repeat(low[hit] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                place = np.repeat(where[hit], n)
                text = np.searchsorted(offsets, place, side="right") - 1
                found.append(np.stack([text, item[entry], (place - begin[entry]) // 16], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def best_distance(pattern: bytes, text: bytes, most: int) -> int:
    """The smallest edit distance between the pattern and any part of the text, or most + 1: columns of the dynamic
    programme as bit vectors of vertical differences."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        x = eq | down
        diag = ((((eq & up) + up) ^ up) | eq)
        plus = down | (~(diag | up) & full)
        minus = up & diag
        score += 1 if plus & top else -1 if minus & top else 0
        best = min(best, score)
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | (~(x | plus) & full)
        down = plus & x
    return best if best <= most else most + 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", tolerance: float = 0.15, repeats: int = 8, item_bytes: int = 4 << 20) -> DataFrame:
    """The input with ``leaks``: an array of (item, edits), sorted, of the benchmark items that stand in the text.

    An item stands in a text if some part of it is within ``tolerance`` times the item's length of edits, both in lower
    case and with anything but letters and digits as single spaces. Items of fewer than 12 bytes, shorter than any window, must
    stand there word for word, and repeated benchmark rows count once; items without words, and empty or null texts, never match. Repeated rows each get the same
    leaks. ``repeats``: walks; each catches a window with its own chance, so more of them raise recall. Benchmarks of any
    size are taken in blocks of about ``item_bytes``, each of which is sent to the executors in a pass of its own.
    """
    docs = docs.drop("leaks").withColumn(text_col, F.col(text_col).cast("string"))
    kind = benchmark.schema[item_id].dataType.simpleString()
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")).where(F.col("text").isNotNull()).dropDuplicates()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = -(-total // item_bytes) or 1
    out = docs.withColumn("leaks", F.array().cast(f"array<struct<item:{kind},edits:int>>"))
    for n in range(passes):
        block = sorted(items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == n).collect(), key=lambda r: (str(r["item"]), r["text"]))  # about item_bytes
        if block:
            out = _one_pass(out, text_col, Items([r["item"] for r in block], [r["text"] for r in block], repeats), tolerance)
    return out.withColumn("leaks", F.array_sort("leaks")) if passes > 1 else out


def _one_pass(docs: DataFrame, text_col: str, items: Items, tolerance: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    names, at = docs.columns, docs.columns.index("leaks")

    def run(batches):
        items = shared.value
        for whole in batches:
            for batch, texts in slices(whole, text_col):
                flat, offsets = normalised(texts)
                found: dict[int, dict[int, int]] = {}
                for i, item, near in items.candidates(flat, offsets).tolist():
                    pattern = items.texts[item]
                    most = int(tolerance * len(pattern))
                    if (have := found.get(i, {}).get(item)) == 0:
                        continue
                    begin = near * 16
                    low, high = max(int(offsets[i]), begin - most - 16), min(int(offsets[i + 1]), begin + 32 + len(pattern) + most)
                    region = flat[low:high].tobytes()
                    if not any(piece in region for piece in items.pieces(item, most)):
                        continue
                    edits = best_distance(pattern, region, most)
                    if edits <= most and (have is None or edits < have):
                        found.setdefault(i, {})[item] = edits
                if items.short:
                    words = Words(texts)
                    for n, (keys, which) in items.short.items():
                        of, _, h = words.grams(n)
                        for j in np.flatnonzero(np.isin(h, keys)).tolist():
                            for e in range(np.searchsorted(keys, h[j]), np.searchsorted(keys, h[j], side="right")):
                                found.setdefault(int(of[j]), {})[which[e]] = 0
                columns = list(batch.columns)
                if found:
                    old = columns[at].to_pylist()
                    for i, pairs in found.items():
                        old[i] = sorted([*((x["item"], x["edits"]) for x in old[i]), *((items.ids[k], e) for k, e in pairs.items())], key=lambda x: (x[0] is not None, x[0], x[1]))
                        old[i] = [{"item": a, "edits": b} for a, b in old[i]]
                    columns[at] = pa.array(old, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(tidy(run), StructType(list(docs.schema.fields)))
