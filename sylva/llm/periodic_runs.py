"""Periodic runs of words: stretches that repeat a period, found from the tandem repeats of a suffix tree.

The words of a slice of texts are one sequence of numbers, each text ending in a number of its own, so nothing repeats
across texts. Its Lempel-Ziv blocks give a leftmost occurrence of some rotation of every tandem repeat; suffix links lead from
each to its next rotations elsewhere, until no new one comes up; the repeats' occurrences are looked up in the tree and
merge into runs. The tree is held as a suffix array: a node is an interval of it, a suffix link goes to the interval of
the same string without its first word. All steps work on the whole slice at once.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import coded_words, slices, tidy

#: What stands between words: fixed values.
APART = [0x20, *range(0x09, 0x0E)]


class Suffixes:
    """The suffixes of a sequence whose last number stands nowhere else, in order, with classes of equal beginnings.

    ``same_as[k][i]`` is the first place in the order of a suffix that begins with the same 2**k numbers as suffix i.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        kind = np.int32 if n < 1 << 31 else np.int64
        sizes = np.bincount(codes)
        rank = (np.cumsum(sizes) - sizes)[codes].astype(kind)
        self.n, self.same_as = n, [rank]
        shared, width = np.flatnonzero(sizes[codes] > 1), 1
        while len(shared):
            key = rank[shared].astype(np.int64) * (n + 1) + rank[shared + width]
            order = np.argsort(key)
            shared, key = shared[order], key[order]
            old = rank[shared]
            at = np.arange(len(shared))
            new_key = np.append(True, key[1:] != key[:-1])
            new_old = np.append(True, old[1:] != old[:-1])
            first = np.maximum.accumulate(np.where(new_key, at, 0))
            rank = rank.copy()
            rank[shared] = old + (first - np.maximum.accumulate(np.where(new_old, at, 0))).astype(kind)
            alone = new_key & np.append(new_key[1:], True)
            shared, width = np.sort(shared[~alone]), 2 * width
            self.same_as.append(rank)
        self.rank = rank
        self.order = np.empty(n, kind)
        self.order[rank] = np.arange(n, dtype=kind)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i and from j on (i <> j) are equal."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.same_as) - 1, -1, -1):
            out += (self.same_as[k][i + out] == self.same_as[k][j + out]).astype(np.int64) << k
        return out

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers up to i and up to j (i <> j, both included) are equal; 0 where one is -1."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.same_as) - 1, -1, -1):
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            fits = (a >= 0) & (b >= 0)
            out += (fits & (self.same_as[k][np.maximum(a, 0)] == self.same_as[k][np.maximum(b, 0)])).astype(np.int64) << k
        return out

    def alike(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ``length`` numbers from i and from j on are equal."""
        out = np.zeros(len(i), bool)
        level = np.frexp(length.astype(np.float64))[1] - 1
        for k in np.unique(level):
            at, own = np.flatnonzero(level == k), self.same_as[min(int(k), len(self.same_as) - 1)]
            if k >= len(self.same_as):  # so many are equal nowhere but in one place
                out[at] = i[at] == j[at]
                continue
            rest = length[at] - (1 << int(k))
            out[at] = (own[i[at]] == own[j[at]]) & (own[np.minimum(i[at] + rest, self.n - 1)] == own[np.minimum(j[at] + rest, self.n - 1)])
        return out

    def node(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the order, ends included, of the suffixes that begin with the ``length`` numbers from i on."""
        here = self.rank[i].astype(np.int64)
        low, high = np.zeros(len(i), np.int64), here.copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            fits = self.alike(self.order[mid].astype(np.int64), i, length)
            high, low = np.where(open_ & fits, mid, high), np.where(open_ & ~fits, mid + 1, low)
        first = low
        low, high = here.copy(), np.full(len(i), self.n - 1)
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            fits = self.alike(self.order[mid].astype(np.int64), i, length)
            low, high = np.where(open_ & fits, mid, low), np.where(open_ & ~fits, mid - 1, high)
        return first, low

    def below(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, code: np.ndarray) -> np.ndarray:
        """A suffix of the node (low, high) whose number after ``length`` is of class ``code``; -1 if there is none."""
        stop = high + 1
        low, high = low.copy(), stop.copy()
        letters = self.same_as[0]
        while (open_ := low < high).any():
            mid = np.minimum((low + high) // 2, self.n - 1)
            less = letters[np.minimum(self.order[mid] + length, self.n - 1)] < code
            low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
        at = np.minimum(low, stop - 1)
        found = (low < stop) & (letters[np.minimum(self.order[at] + length, self.n - 1)] == code)
        return np.where(found, self.order[at].astype(np.int64), -1)

    def run(self, i: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one place of the run of ``period`` in which i stands."""
        return i - self.back(i - 1, i + period - 1), i + period + self.ahead(i, i + period)


def _smaller_before(a: np.ndarray) -> np.ndarray:
    """For each place the last place before it with a smaller value; -1 if there is none."""
    n = len(a)
    before = np.arange(n) - 1
    left = np.flatnonzero((before >= 0) & (a[np.maximum(before, 0)] > a))
    for _ in range(24):
        if not len(left):
            return before
        before[left] = before[before[left]]
        left = left[(before[left] >= 0) & (a[np.maximum(before[left], 0)] > a[left])]
    lows = [a]  # long chains are left: lows[k][x] is the least of 2**k values from x on
    while 2 << (len(lows) - 1) <= n:
        half = 1 << (len(lows) - 1)
        lows.append(np.minimum(lows[-1][:-half], lows[-1][half:]))
    stop = left.copy()
    for k in range(len(lows) - 1, -1, -1):
        begin = stop - (1 << k)
        larger = (begin >= 0) & (lows[k][np.clip(begin, 0, len(lows[k]) - 1)] > a[left])
        stop = np.where(larger, begin, stop)
    before[left] = stop - 1
    return before


def lz_blocks(s: Suffixes) -> np.ndarray:
    """Where blocks begin: each is the longest beginning of the rest that also begins earlier, or one new number."""
    order, longest = s.order.astype(np.int64), np.zeros(s.n, np.int64)
    ahead = _smaller_before(order)
    behind = s.n - 1 - _smaller_before(order[::-1])[::-1]
    for near in (ahead, behind):
        at = np.flatnonzero((near >= 0) & (near < s.n))
        at = at[s.same_as[0][order[at]] == s.same_as[0][order[near[at]]]]
        longest[order[at]] = np.maximum(longest[order[at]], s.ahead(order[at], order[near[at]]))
    step, begins, i = np.maximum(longest, 1).tolist(), [], 0
    while i < s.n:
        begins.append(i)
        i += step[i]
    return np.array(begins)


def covering_runs(s: Suffixes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last plus one, period) of stretches of tandem repeats that reach over a block's border: among them is, up to
    rotation, the leftmost occurrence of every tandem repeat."""
    n, letters = s.n, s.same_as[0]
    of = np.searchsorted(begins, np.arange(n), side="right") - 1
    ends = np.append(begins[1:], n)
    x = np.arange(n)
    end = ends[of]
    x1 = x[(end < n) & (letters[x] == letters[np.minimum(end, n - 1)])]  # repeats that begin in a block and end in the next one
    pairs = [(ends[of[x1]], x1, np.zeros(len(x1), bool))]
    for back in (0, 1):  # repeats around a block's beginning, their period up to the end of the next block
        h = begins[np.maximum(of - back, 0)]
        x2 = x[(of >= back) & (x > h) & (h > 0) & (letters[x] == letters[h])]
        pairs.append((begins[of[x2] - back], x2, np.ones(len(x2), bool)))
    b = np.arange(2, len(begins))
    pairs.append((begins[b - 2], begins[b], np.ones(len(b), bool)))
    h, x, around = (np.concatenate(p) for p in zip(*pairs))
    fits = (letters[h] == letters[x]) & (~around | ((h > 0) & (letters[h - 1] == letters[x - 1])))
    h, x = h[fits], x[fits]
    period = np.abs(h - x)
    reach, before = s.ahead(h, x), s.back(h - 1, x - 1)
    held = reach + before >= period
    low = np.minimum(h, x)[held]
    return _each_once(s, low - before[held], low + period[held] + reach[held], period[held])


def _each_once(s: Suffixes, first: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every stretch once, with its least period."""
    by = np.lexsort((period, stop, first))
    first, stop, period = first[by], stop[by], period[by]
    new = np.append(True, (first[1:] != first[:-1]) | (stop[1:] != stop[:-1]))[: len(first)]
    return first[new], stop[new], period[new]


def complete(s: Suffixes, first: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches, and those that suffix links lead to from the last repeat of each: the node of its rotation, if the
    tree has one."""
    known = [(first, stop, period)]
    seen = np.sort(first * (s.n + 1) + period)
    while len(first):
        part = stop - first < 3 * period - 1  # else it has all rotations itself
        last, q = (stop - 2 * period)[part], period[part]
        length = 2 * q - 1
        low, high = s.node(last + 1, length)
        j = s.below(low, high, length, s.same_as[0][last])
        q, j = q[j >= 0], j[j >= 0]
        first, stop = s.run(j, q)
        key, at = np.unique(first * (s.n + 1) + q, return_index=True)
        at = at[~np.isin(key, seen)]
        first, stop, period = first[at], stop[at], q[at]
        known.append((first, stop, period))
        seen = np.union1d(seen, key)
    return tuple(np.concatenate(k) for k in zip(*known))


def runs_of(codes: np.ndarray, least: int = 6, exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a sequence whose last number stands nowhere else: stretches with least period q
    and length >= max(``least``, ``exponent`` * q) that no neighbour prolongs. ``exponent`` is 3 at least: such a run has
    every rotation of its repeat, so one rotation of each stretch finds them all."""
    if exponent < 3:
        raise ValueError("runs_of: exponent has to be 3 at least")
    s = Suffixes(codes)
    first, stop, period = complete(s, *covering_runs(s, lz_blocks(s)))
    if not len(first):
        return first, stop, period
    low, high = s.node(first, 2 * period)
    at = np.unique(low * (s.n + 1) + period, return_index=True)[1]
    low, high, period = low[at], high[at], period[at]
    many = high - low + 1
    period = np.repeat(period, many)
    places = s.order[np.arange(len(period)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)].astype(np.int64)
    first, stop = s.run(places, period)
    long = stop - first >= np.maximum(least, exponent * period)
    first, stop, period = _each_once(s, first[long], stop[long], period[long])
    return first, stop - first, period


def _best(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The place of the run with the greatest length / period; of equal ones the first start, then the least period."""
    about = length / period
    near = np.flatnonzero(about >= about.max() * (1 - 1e-9))
    return int(min(near, key=lambda k: (-Fraction(int(length[k]), int(period[k])), start[k], period[k])))


OUT = "row_id {id}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string{more}"


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: Column | None = None, least: int = 6, exponent: int = 4, texts: bool = False,
    slice_bytes: int = 2 << 20,
) -> DataFrame:
    """One row per input row: n_runs; start, length, period and exponent_milli of the run with the greatest length / period
    (null without a run); runs_sha256 and collapsed_sha256. With ``texts`` also runs, an array of (start, length, period), and
    collapsed, the text without the words that a run repeats.

    Words are numbered from 0. A word goes from the collapsed text if a run has it after its first period. ``planted``: an
    unsigned number h for each row, from which a text is made to repeat itself before the search: if h % 10 = 0, with g =
    h div 10, its n words from a = g % n on go round with period 1 + (n - a) div (3 + g % 8). Null: nothing is planted.

    Null, empty and blank texts have no words and no runs, their digests are those of the empty text. Repeated rows and rows
    with null ids each get a row, an empty table gives none, and other columns are not looked at.
    """
    spark_id = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"), (F.lit(None) if planted is None else planted).cast("long").alias("h"))
    inside = np.ones(256, bool)
    inside[APART] = False

    def run(batches):
        for whole in batches:
            for batch, part in slices(whole, "text", slice_bytes):
                words, codes, of_text = coded_words(part, inside)
                seeds = batch.column("h").to_pylist()
                for t, h in enumerate(seeds):
                    low, n = of_text[t], int(of_text[t + 1] - of_text[t])
                    if h is not None and h % 10 == 0 and n:
                        g = h // 10
                        a = g % n
                        codes[low + a : low + n] = codes[low + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))]
                yield _found(batch.column("row_id"), words, codes, of_text, least, exponent, texts)

    more = ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if texts else ""
    found = rows.mapInArrow(tidy(run), OUT.format(id=spark_id, more=more))
    return found.withColumnRenamed("row_id", id_col)


def _found(ids: pa.Array, words: pa.Array, codes: np.ndarray, of_text: np.ndarray, least: int, exponent: int, texts: bool) -> pa.RecordBatch:
    n_texts = len(of_text) - 1
    closed = np.insert(codes, of_text[1:], len(words) + np.arange(n_texts))  # each text's words, then its own end
    begin = of_text + np.arange(n_texts + 1)
    start, length, period = runs_of(closed, least, exponent)
    by = np.lexsort((period, start))
    start, length, period = start[by], length[by], period[by]
    bounds = np.searchsorted(start, begin)
    text = np.searchsorted(begin, start, side="right") - 1
    steps = np.zeros(len(codes) + 1, np.int64)
    np.add.at(steps, start + period - text, 1)
    np.add.at(steps, start + length - text, -1)
    kept = np.cumsum(steps[:-1]) == 0
    start = start - begin[text]
    spaced = pa.compute.binary_join_element_wise(words, pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    left = spaced.take(pa.array(codes[kept]))
    at = np.frombuffer(left.buffers()[1], np.int64)[left.offset : left.offset + len(left) + 1]
    data, first_kept = memoryview(left.buffers()[2] or b""), np.append(0, np.cumsum(kept))[of_text]
    out: dict[str, list] = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed")}
    for t in range(n_texts):
        own = slice(bounds[t], bounds[t + 1])
        a, n, q = start[own], length[own], period[own]
        says = "".join(f"{x},{y},{z}\n" for x, y, z in zip(a.tolist(), n.tolist(), q.tolist()))
        low, high = at[first_kept[t]], at[first_kept[t + 1]]
        collapsed = data[low : max(low, high - 1)]
        best = [None] * 4
        if len(a):
            k = _best(a, n, q)
            best = [int(a[k]), int(n[k]), int(q[k]), 1000 * int(n[k]) // int(q[k])]
        row = (len(a), *best, hashlib.sha256(says.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())
        for name, value in zip(out, row):
            out[name].append(value)
        if texts:
            out["runs"].append([{"start": x, "length": y, "period": z} for x, y, z in zip(a.tolist(), n.tolist(), q.tolist())])
            out["collapsed"].append(bytes(collapsed).decode())
    arrays = {name: pa.array(v, pa.string() if "sha256" in name else pa.int64()) for name, v in out.items() if name not in ("runs", "collapsed")}
    if texts:
        triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        arrays |= {"runs": pa.array(out["runs"], pa.list_(triple)), "collapsed": pa.array(out["collapsed"], pa.string())}
    return pa.RecordBatch.from_arrays([ids, *arrays.values()], names=["row_id", *arrays])
