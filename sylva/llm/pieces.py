"""Texts as numbered pieces: each different piece is encoded once, and the ids of texts are gathered by piece number."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class PieceMemory:
    """The ids of pieces, as ``encode`` gives them: a function from a list of pieces to (the pieces in the order that it took
    them, all their ids one after the other, how many ids each has).

    Up to ``limit`` different pieces of up to ``longest`` bytes are remembered from batch to batch; longer ones are encoded
    whenever they come.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], limit: int = 400_000, longest: int = 256):
        self.encode, self.limit, self.longest = encode, limit, longest
        self.known: dict[str, int] = {}  # piece -> its number
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0  # the ids of all pieces, one after the other
        self.begin = np.zeros(1, np.int64)  # number -> where its ids begin; one more than pieces
        self.hits = np.zeros(0, np.int32)  # number -> batches that it came in

    def forget(self, share: int = 2) -> None:
        """Keeps the pieces that came at least twice, in up to one ``share``-th of the space, those that came most first."""
        kept = np.flatnonzero(self.hits >= 2)
        kept = np.sort(kept[np.argsort(-self.hits[kept], kind="stable")][: self.limit // share])
        names, n = list(self.known), np.diff(self.begin)[kept]
        ends = np.cumsum(n)
        flat = self.ids[np.repeat(self.begin[:-1][kept] - (ends - n), n) + np.arange(n.sum())]
        self.known = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.ids, self.used = np.r_[flat, np.zeros(1 << 16, np.uint32)], len(flat)
        self.begin, self.hits = np.r_[0, ends], self.hits[kept] // 2

    def learn(self, pieces: list[str]) -> None:
        if not pieces:
            return
        order, flat, n = self.encode(pieces)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.r_[self.ids[: self.used], np.zeros(max(len(flat), len(self.ids)), np.uint32)]
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin = np.r_[self.begin, self.used + np.cumsum(n)]
        self.hits = np.r_[self.hits, np.zeros(len(n), np.int32)]
        self.known.update(zip(order, range(len(self.known), len(self.known) + len(n))))
        self.used += len(flat)

    def gather(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces raw[at[0]:at[1]], raw[at[1]:at[2]], ... of UTF-8 bytes, one after the other, and the
        len(at) places where the pieces begin and end among them."""
        if len(self.known) > self.limit:
            self.forget()
        if len(at) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        pieces = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        different = pieces.dictionary.to_numpy(zero_copy_only=False)
        number = np.array([self.known.get(p, -1) for p in different], np.int64)
        new = np.flatnonzero((number < 0) & (pc.binary_length(pieces.dictionary).to_numpy() <= self.longest))
        self.learn(fresh := different[new].tolist())
        number[new] = [self.known[p] for p in fresh]
        remembered = number[number >= 0]
        ids, begin, count = self.ids, self.begin[np.maximum(number, 0)], np.zeros(len(number), np.int64)
        count[number >= 0] = self.begin[remembered + 1] - self.begin[remembered]
        self.hits[remembered] += 1
        if len(long := np.flatnonzero(number < 0)):
            own = [self.encode([different[i]])[1] for i in long]
            count[long] = [len(x) for x in own]
            begin[long] = self.used + np.r_[0, np.cumsum(count[long])[:-1]]
            ids = np.concatenate([self.ids[: self.used], *own])
        code = pieces.indices.to_numpy()
        n = count[code]
        ends = np.cumsum(n)
        return ids[np.repeat(begin[code] - (ends - n), n) + np.arange(ends[-1])], np.r_[0, ends]
