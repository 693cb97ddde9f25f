"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

The encoding of a text under a merge list has this shape: if the encoding of a prefix ends with token a, then appending
the symbols of token b gives that encoding followed by b exactly if the pair (a, b) on its own encodes to (a, b). So the
transducer keeps, for each of the last few positions, only the last token of the encoding of the prefix that ends there.
A position can still change the past only while a later token may begin at it, that is for as many symbols as the longest
token has; tokens that all such live positions share are stable and are emitted. The merge list's sufficient lookahead bounds
how far back the past can change at all, and with it what is held. Decoding is a state machine that takes one token after
the other and gives out text as soon as its bytes form whole characters.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import flat_bytes, slices, tidy
from .pieces import PieceMemory

END = "</w>"
#: str.split() takes these for white space, the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = regex.compile(r"[\t-\r \x85\p{Z}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, every other byte for the next character from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = [], 256
    for b in range(256):
        if b in own:
            table.append(chr(b))
        else:
            table.append(chr(spare))
            spare += 1
    return table


class Transducer:
    """Encodes the symbols of one word after the other; tokens come out as soon as they are stable."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.vocab, self.end = vocab, end
        self.rank = {pair: i for i, pair in enumerate(merges)}
        inner = [t for t in vocab if not (end and t.endswith(end))]
        self.longest = max((len(t.removesuffix(end)) if end else len(t) for t in vocab), default=1)
        self.inner = {t: vocab[t] for t in inner if len(t) <= self.longest}
        self.final = {t.removesuffix(end): i for t, i in vocab.items() if end and t.endswith(end)} if end else self.inner
        self.pairs: dict[tuple[str, str, bool], bool] = {}
        self.follows: dict[str, tuple[dict[int, bool], dict[int, bool]]] = {}
        self.begins: dict[str, tuple[str, int, int]] = {}  # what the transducer holds for the last symbol of a word's beginning
        self.heads: dict[str, list] = {}  # and for all symbols of a short word's
        #: For the last three symbols that were read: the lengths of the tokens that end with them, longest first.
        self.lengths: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
        self._tails: tuple[dict[str, set[int]], dict[str, set[int]]] = ({}, {})
        for tails, tokens in zip(self._tails, (self.inner, self.final)):
            for t in tokens:
                if len(t) > 2:
                    tails.setdefault(t[-3:], set()).add(len(t))
        #: Symbols after which every token is certainly stable: merges times the longest token, the published bound.
        self.sufficient_lookahead = max(1, len(merges)) * self.longest

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain merging in order of rank, for a handful of symbols."""
        rank, none = self.rank.get, 1 << 60
        ranks = [rank(pair, none) for pair in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def stays(self, a: str, b: str, last: bool) -> bool:
        """Whether tokens a and b (at the word's end, if last) side by side encode to themselves; a may be empty."""
        key = (a, b, last)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            self.pairs[key] = known = self._stays(a, b, last)
        return known

    def _stays(self, a: str, b: str, last: bool) -> bool:
        symbols = list(a + b)
        want = [a, b] if a else [b]
        if last and self.end:
            symbols[-1] += self.end
            want[-1] += self.end
        return self.merge(symbols) == want

    def stream(self, word, emit) -> int:
        """Encodes the symbols of ``word`` (an iterable), calls ``emit`` with each token's id once it is stable, and
        returns the largest number of positions it ever held.

        Every 32 symbols the tokens that all live positions share go out. Whatever the text, a token that ends more than
        ``sufficient_lookahead`` symbols back is stable and goes out too, so no more positions than that bound, the longest
        token and 32 are ever held.
        """
        if isinstance(word, str) and len(word) <= 32:
            return self._short(word, emit)
        live: dict[int, tuple[str, int, int]] = {0: ("", -1, -1)}  # position -> last token, its id, where it begins
        window, done, held, at, longest = "", 0, 1, 0, self.longest
        inner, final, pairs, lengths, begins = self.inner, self.final, self.pairs, self.lengths, self.begins
        if len(begins) > 300_000:
            begins.clear()
        symbols = iter(word)
        ahead = next(symbols, None)
        while ahead is not None:
            c, ahead = ahead, next(symbols, None)
            window = window + c if at < longest else window[1 - longest :] + c if longest > 1 else c
            at += 1
            last = ahead is None
            opening = at <= 12 and at <= longest and not last  # words have their beginnings in common
            if opening and (step := begins.get(window)) is not None:
                live[at] = step
                continue
            tokens, tail = (final if last else inner), window[-3:]
            if (sizes := lengths[last].get(tail)) is None:
                sizes = self._sizes(tail, last)
            for n in sizes:  # the longest token that ends here and stays beside the one before it
                if n <= at and (i := tokens.get(t := window[-n:])) is not None and (before := live.get(at - n)) is not None:
                    key = (before[0], t, last)
                    if pairs[key] if key in pairs else self.stays(*key):
                        live[at] = step = (t, i, at - n)
                        if opening:
                            begins[window] = step
                        break
            else:
                raise ValueError(f"no token ends at symbol {at}: the vocabulary lacks {c!r}")
            if not last and at % 32:
                continue
            heads = {at} if last else set(range(max(0, at - longest + 1), at + 1))
            while len(heads) > 1 and max(heads) > done:  # the position through which all live ones go
                top = max(heads)
                if at - top > self.sufficient_lookahead:
                    heads = {top}
                    break
                heads.remove(top)
                heads.add(live[top][2])
            stable = [p := max(heads)]
            while p > done:
                p = live[p][2]
                stable.append(p)
            for p in reversed(stable):
                if p > done:
                    emit(live[p][1])
            held = max(held, len(live))
            if stable[0] > done:
                done = stable[0]
                live = {p: x for p, x in live.items() if p >= done}
        return held

    def _short(self, word: str, emit) -> int:
        """``stream`` for a word that ends before its first tokens would go out: the same steps, the positions in a list. What
        words that begin alike have in common is remembered up to four and up to eight symbols."""
        size = len(word)
        if not size:
            return 1
        inner, lengths, heads, follows = self.inner, self.lengths[False], self.heads, self.follows
        if len(heads) > 100_000 or len(follows) > 30_000:
            heads.clear()
            follows.clear()
        live = heads.get(word[:8]) if size > 8 else None
        if live is None:
            live = heads.get(word[:4]) if size > 4 else None
        live = live.copy() if live is not None else [("", -1, -1, self._follow(""))]
        for at in range(len(live), size):
            tail = word[at - 3 : at] if at > 3 else word[:at]
            if (sizes := lengths.get(tail)) is None:
                sizes = self._sizes(tail, False)
            for n in sizes:
                if n <= at and (i := inner.get(t := word[at - n : at])) is not None:
                    before = live[at - n]
                    if (fits := before[3][0].get(i)) is None:
                        fits = before[3][0][i] = self._stays(before[0], t, False)
                    if fits:
                        live.append((t, i, at - n, follows.get(t) or self._follow(t)))
                        break
            else:
                raise ValueError(f"no token ends at symbol {at}: the vocabulary lacks {word[at - 1]!r}")
            if at == 4 or at == 8:
                heads[word[:at]] = live.copy()
        for n in self.lengths[True].get(word[-3:]) or self._sizes(word[-3:], True):
            if n <= size and (i := self.final.get(t := word[size - n :])) is not None:
                before = live[size - n]
                if (fits := before[3][1].get(i)) is None:
                    fits = before[3][1][i] = self._stays(before[0], t, True)
                if fits:
                    break
        else:
            raise ValueError(f"no token ends at symbol {size}: the vocabulary lacks {word[-1]!r}")
        ids, at = [i], size - n
        while at:
            _, i, at, _ = live[at]
            ids.append(i)
        for i in reversed(ids):
            emit(i)
        return size + 1

    def _follow(self, token: str) -> tuple[dict[int, bool], dict[int, bool]]:
        """Which tokens are known to stay behind the token, within a word and at its end."""
        self.follows[token] = row = ({}, {})
        return row

    def _sizes(self, tail: str, last: bool) -> list[int]:
        tokens = self.final if last else self.inner
        sizes = self._tails[last].get(tail, set()) | {n for n in (1, 2) if tail[-n:] in tokens}
        self.lengths[last][tail] = out = sorted(sizes, reverse=True)
        return out

    def word(self, word: str) -> list[int]:
        """The ids of one word."""
        ids: list[int] = []
        self.stream(word, ids.append)
        return ids


class WordBpe:
    """A tokenizer of the word-end kind, read from its public file: NFC, white space as separator, lower case, words cut
    by the file's pattern, bytes as symbols, the last one marked. ``limit``: pieces that are remembered."""

    def __init__(self, path: str, limit: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.transducer = Transducer(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.alphabet = byte_alphabet()
        self.tokens: list[str] = [""] * (max([*model["vocab"].values(), *self.special.values()], default=-1) + 1)
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.tokens[i] = t
        self.raw = [t.encode() for t in self.tokens]
        self.table = str.maketrans({chr(b): c for b, c in enumerate(self.alphabet)})
        self.limit, self.memory = limit, PieceMemory(self.pieces, limit)
        self.known: dict[str, list[int]] = {}

    def _word(self, word: str) -> list[int]:
        if (ids := self.known.get(word)) is None:
            ids = self.transducer.word(word.encode("utf-8").decode("latin-1").translate(self.table))
            if len(word) <= 32:
                if len(self.known) >= self.limit // 2:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def _plain(self, text: str) -> list[int]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() knows a final sigma, the file's rule doesn't
        text = text.lower()
        parts = _WHITE.split(text) if _SEPARATORS.search(text) else text.split()
        return [i for p in parts for w in self.words(p) for i in self._word(w)]

    def _ids(self, text: str) -> list[int]:
        if self.cut is None or "<|" not in text:
            return self._plain(text)
        return [i for t in self.cut.split(text) for i in ([self.special[t]] if t in self.special else self._plain(t))]

    def pieces(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """See PieceMemory."""
        got = [self._ids(p) for p in pieces]
        return pieces, np.array([i for g in got for i in g], np.uint32), np.array([len(g) for g in got], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all whole texts (a large_string array), one after the other, and how many each has. Texts are cut at
        ASCII white space, which nothing that the tokenizer does reaches across."""
        raw, offsets = flat_bytes(texts)
        seen = (raw != 32) & ((raw < 9) | (raw > 13))
        upto = np.r_[0, np.cumsum(seen)]
        first = seen.copy()
        first[1:] &= ~seen[:-1]
        at = np.sort(np.r_[upto[:-1][first], upto[offsets]], kind="stable")
        at = at[np.r_[True, at[1:] != at[:-1]]]
        collects = gc.isenabled()
        gc.disable()  # many small objects and no cycles: looking for some took a third of the time
        try:
            flat, places = self.memory.gather(raw[seen], at)
        finally:
            if collects:
                gc.enable()
        return flat, np.diff(places[np.searchsorted(at, upto[offsets])])

    def rest(self) -> None:
        """Between tasks only the pieces that come often are remembered."""
        self.memory.forget(8)
        self.known.clear()
        self.transducer.begins.clear()
        self.transducer.heads.clear()
        if len(self.transducer.follows) > 10_000:
            self.transducer.follows.clear()
        if len(self.transducer.pairs) > 100_000:
            self.transducer.pairs.clear()

    def decoder(self, plain: bool = True) -> Decoder:
        return Decoder(self, plain)


class Decoder:
    """Tokens in, text out: a state machine that holds the bytes of a character that is not whole yet, and whether a space is
    due before what comes next.

    ``plain``: the text itself; the mark of a word's end makes a space due. Otherwise what the library's decode gives
    for a tokenizer file without a decoder: the tokens as they are named, a space due after each.
    """

    def __init__(self, bpe: WordBpe, plain: bool = True):
        self.bpe, self.plain, self.back = bpe, plain, {c: b for b, c in enumerate(bpe.alphabet)}
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")
        self.gap = False

    def feed(self, *ids: int) -> str:
        return self.feed_bytes(ids).decode()

    def feed_bytes(self, ids) -> bytes:
        """The text of the next tokens, in UTF-8."""
        if not self.plain:
            text = b" ".join(map(self.bpe.raw.__getitem__, ids))
            text, self.gap = (b" " + text if self.gap and len(ids) else text), self.gap or len(ids) > 0
            return text
        out = []
        for token in map(self.bpe.tokens.__getitem__, ids):
            special, ends = token in self.bpe.special, token.endswith(END)
            raw = token.encode() if special else bytes(self.back[c] for c in token.removesuffix(END))
            out.append((" " if self.gap else "") + self.bytes.decode(raw))
            self.gap = special or ends
        return "".join(out).encode()

    def flush(self) -> str:
        return self.bytes.decode(b"", True)


@lru_cache(2)
def word_bpe(path: str, limit: int = 400_000) -> WordBpe:
    return WordBpe(path, limit)


def encode_texts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", with_ids: bool = True, digest: bool = False, slice_bytes: int = 3 << 20, remembered: int = 400_000) -> DataFrame:
    """The input without its text, with n_tokens and, as asked, ids (array of int) and the digests ids_sha256 (of the ids
    as little-endian unsigned 32-bit integers) and decoded_sha256 (of the tokens with spaces between, in UTF-8).

    A null or empty text has no tokens. Texts of any length are encoded whole, and every word goes through the transducer,
    which holds a bounded number of positions; ids are decoded by the state machine, some thousands at a time. Repeated
    rows each get a row; input columns of these names are replaced. A task encodes about ``slice_bytes`` of text at once:
    smaller slices hold less memory and take some more time, and give the same rows; so do fewer ``remembered`` pieces.
    """
    kept = docs.drop("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    names = [c for c in kept.columns if c != text_col]
    schema = StructType([kept.schema[c] for c in names]).add("n_tokens", "long")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    if digest:
        schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string")
    kept = kept.withColumn(text_col, F.col(text_col).cast("string"))

    def run(batches):
        bpe, sha = word_bpe(tokenizer_path, remembered), hashlib.sha256

        def decoded(bpe, ids):
            state, digest = bpe.decoder(plain=False), sha()
            for s in range(0, len(ids), 8192):
                digest.update(state.feed_bytes(ids[s : s + 8192].tolist()))
            return digest.hexdigest()

        for whole in batches:
            for batch, texts in slices(whole, text_col, slice_bytes):
                flat, n = bpe.encode(texts)
                ends = np.cumsum(n)
                columns = [batch.column(c) for c in names] + [pa.array(n)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat.astype(np.int32))))
                if digest:
                    parts = [flat[b - k : b] for b, k in zip(ends.tolist(), n.tolist())]
                    columns += [pa.array([sha(p.astype("<u4").tobytes()).hexdigest() for p in parts], pa.string()), pa.array([decoded(bpe, p) for p in parts], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
        bpe.rest()

    return kept.mapInArrow(tidy(run), schema)
