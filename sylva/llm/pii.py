"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns find spans of four kinds. The network is trained in numpy on windows of a bounded sample of texts, with the
patterns' spans as labels, and adds spans that look alike in shape and surroundings. Texts are decoded in overlapping
windows; a span that touches a window's edge counts only if a neighbouring window's span continues it, so that the
result does not depend on where windows begin. A span of any kind holds a digit or an at sign, so windows without
either cannot add one and are not decoded.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import slices, some_texts, tidy

#: Kinds and patterns, in the order in which ties are listed.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What an email's name may hold, and the forms in which the patterns are looked for: a place is read a bounded number of
#: times, however long an unbroken run is, and the matches are those of PATTERNS.
_LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(PATTERNS["phone"])
_PART = re.compile(r"[0-9]+")
_DIGITS = re.compile(r"[^0-9]")
_TRIGGER = re.compile(r"[0-9@]")
WINDOW, STRIDE = 96, 48
TAGS = 1 + 2 * len(KINDS)  # outside; first and further character of each kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _holds(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    if kind == "card":
        digits = _DIGITS.sub("", text)
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(_DIGITS.sub("", text)) <= 15
    return True


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        width, begin = 64, at
        while True:  # back to where the run of a name's characters begins
            low = max(done, at - width)
            begin = low + len(text[low:at].rstrip(_LOCAL))
            if begin > low or low == done:
                break
            width *= 4
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str):
    for run in _DOTTED.finditer(text):
        parts = [m.span() for m in _PART.finditer(text, *run.span())]
        for k in range(0, len(parts) - 3, 4):
            yield parts[k][0], parts[k + 3][1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' matches that hold, by start, then kind. Takes time in proportion to the
    text, whatever stands in it."""
    if not _TRIGGER.search(text):
        return []
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(s, 1, e) for s, e in _addresses(text) if _holds("ip", text[s:e])]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() > 13 and _holds("card", m.group())]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if _holds("phone", m.group())]
    return [(s, e, KINDS[r]) for s, r, e in sorted(found)]


def _classes() -> np.ndarray:
    """Class of each code point below 128: 0 is padding; digits, lower and upper case are one class each, the signs that
    personal data holds one each, then other signs; 19 stands for all other characters."""
    lut = np.full(128, 18, np.int8)
    lut[48:58], lut[97:123], lut[65:91] = 1, 2, 3
    for i, c in enumerate("@.+-() \n_%/:,"):
        lut[ord(c)] = 4 + i
    return lut


_CLASS = _classes()


def encode_chars(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], 19).astype(np.int8)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Parameters p: input tables x and recurrent weights u of both directions, output layer w and b, CRF transitions t and
    starts s."""

    def __init__(self, hidden: int = 20, seed: int = 11):
        r = np.random.default_rng(seed)
        self.h = hidden
        small = lambda *shape: (r.standard_normal(shape) * 0.15).astype(np.float32)
        self.p = {"x": small(2, 20, 4 * hidden), "u": small(2, hidden, 4 * hidden), "w": small(2 * hidden, TAGS), "b": np.zeros(TAGS, np.float32), "t": small(TAGS, TAGS), "s": np.zeros(TAGS, np.float32)}
        self.p["x"][:, :, hidden : 2 * hidden] += 1.0  # forget gates start open

    def emissions(self, chars: np.ndarray, keep: bool = False):
        """Scores (step, window, tag); with ``keep`` also what the gradient needs. Both directions go side by side, the second
        from the end."""
        n, steps, h, x, u = len(chars), chars.shape[1], self.h, self.p["x"], self.p["u"]
        hid, cell = np.zeros((2, n, h), x.dtype), np.zeros((2, n, h), x.dtype)
        out, saved = np.zeros((steps, n, 2 * h), x.dtype), []
        for k in range(steps):
            z = hid @ u
            z[0] += x[0][chars[:, k]]
            z[1] += x[1][chars[:, steps - 1 - k]]
            gates = _sigmoid(z[:, :, : 3 * h])
            i, f, o, g = gates[:, :, :h], gates[:, :, h : 2 * h], gates[:, :, 2 * h :], np.tanh(z[:, :, 3 * h :])
            before, last = cell, hid
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            hid = o * squashed
            out[k, :, :h], out[steps - 1 - k, :, h:] = hid[0], hid[1]
            if keep:
                saved.append((i, f, o, g, before, squashed, last))
        scores = out @ self.p["w"] + self.p["b"]
        return (scores, out, saved) if keep else scores

    def loss_and_gradient(self, chars: np.ndarray, tags: np.ndarray):
        """Mean negative log-likelihood of the tags, and its gradient."""
        e, both, saved = self.emissions(chars, True)
        steps, n, k = e.shape
        h, t, s = self.h, self.p["t"], self.p["s"]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)

        def lse(x, axis):
            top = x.max(axis, keepdims=True)
            return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

        alpha[0] = s + e[0]
        for i in range(1, steps):
            alpha[i] = lse(alpha[i - 1][:, :, None] + t, 1) + e[i]
        for i in range(steps - 2, -1, -1):
            beta[i] = lse(t + (e[i + 1] + beta[i + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        at, order = np.arange(n), np.arange(steps)
        gold = s[tags[:, 0]] + e[order[:, None], at, tags.T].sum(0) + t[tags[:, :-1], tags[:, 1:]].sum(1)
        de = np.exp(alpha + beta - z[:, None])
        de[order[:, None], at, tags.T] -= 1
        de /= n
        pairs = np.exp(alpha[:-1][:, :, :, None] + t + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
        pairs -= np.bincount((tags[:, :-1] * k + tags[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
        g = {"s": de[0].sum(0), "t": pairs / n, "w": both.reshape(-1, 2 * h).T @ de.reshape(-1, k), "b": de.sum((0, 1))}
        dh = de @ self.p["w"].T
        hot = np.eye(20, dtype=e.dtype)[chars]  # window, step, class
        gx, gu, u = np.zeros_like(self.p["x"]), np.zeros_like(self.p["u"]), self.p["u"].transpose(0, 2, 1)
        hid, cell = np.zeros((2, n, h), e.dtype), np.zeros((2, n, h), e.dtype)
        for step in range(steps - 1, -1, -1):
            i, f, o, c, before, squashed, last = saved[step]
            hid[0] += dh[step, :, :h]
            hid[1] += dh[steps - 1 - step, :, h:]
            cell += hid * o * (1 - squashed**2)
            dz = np.concatenate([cell * c * i * (1 - i), cell * before * f * (1 - f), hid * squashed * o * (1 - o), cell * i * (1 - c**2)], 2)
            gx[0] += hot[:, step].T @ dz[0]
            gx[1] += hot[:, steps - 1 - step].T @ dz[1]
            gu += last.transpose(0, 2, 1) @ dz
            hid, cell = dz @ u, cell * f
        g["x"], g["u"] = gx, gu
        return float((z - gold).mean()), g

    def train(self, chars: np.ndarray, tags: np.ndarray, steps: int = 600, batch: int = 48, rate: float = 0.02, seed: int = 3) -> float:
        """Adam for ``steps`` batches, however many windows there are; the rate falls to a tenth on the way. A tenth of the
        characters outside spans becomes a letter, a space or another sign at random, so that the network does not hold on to the
        words that happen to stand around the spans of the sample."""
        rng = np.random.default_rng(seed)
        m, v, loss, order = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0.0, np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            while len(order) < batch:
                order = np.r_[order, rng.permutation(len(chars))]
            part, order = order[:batch], order[batch:]
            seen, noise = chars[part], rng.choice(np.array([2, 3, 10, 18, 19], chars.dtype), (batch, chars.shape[1]))
            seen = np.where((rng.random(seen.shape) < 0.1) & (tags[part] == 0) & (seen > 0), noise, seen)
            loss, g = self.loss_and_gradient(seen, tags[part])
            norm = np.sqrt(sum(float((x.astype(np.float64) ** 2).sum()) for x in g.values()))
            for k, x in g.items():
                x = x * min(1.0, 5 / max(norm, 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.999 * v[k] + 0.001 * x * x
                self.p[k] -= (rate * 0.1 ** (step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(self.p[k].dtype)
        return loss

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window."""
        e = self.emissions(chars)
        steps, n, _ = e.shape
        best, back = self.p["s"] + e[0], np.zeros((steps, n, TAGS), np.int8)
        for i in range(1, steps):
            scores = best[:, :, None] + self.p["t"]
            back[i] = scores.argmax(1)
            best = scores.max(1) + e[i]
        tags = np.zeros((n, steps), np.int8)
        tags[:, -1] = best.argmax(1)
        for i in range(steps - 1, 0, -1):
            tags[:, i - 1] = back[i][np.arange(n), tags[:, i]]
        return tags


def window_starts(text: str) -> list[int]:
    """Beginnings of the windows that hold a digit or an at sign; the last window reaches the text's end."""
    starts: set[int] = set()
    last = max(0, (len(text) - WINDOW + STRIDE - 1) // STRIDE)
    for m in _TRIGGER.finditer(text):
        at = m.start() // STRIDE
        starts.update(k for k in (at - 1, at) if 0 <= k <= last)
        if at > last:
            starts.add(last)
    return sorted(k * STRIDE for k in starts)


def tag_window(spans: list[tuple[int, int, str]], start: int) -> np.ndarray:
    tags = np.zeros(WINDOW, np.int8)
    for s, e, kind in reversed(spans):
        a, b = max(s - start, 0), min(e - start, WINDOW)
        if a < b:
            k = KINDS.index(kind)
            tags[a:b] = 2 + 2 * k
            if s >= start:
                tags[a] = 1 + 2 * k
    return tags


def _spans_of(tags: np.ndarray, start: int, length: int) -> list[tuple[int, int, int, bool, bool]]:
    """(start, end, kind, cut on the left, cut on the right) of a tagged window: whether it touches an edge of the window
    beyond which the text goes on."""
    found, i, n = [], 0, min(WINDOW, length - start)
    while i < n:
        if tags[i]:
            k, j = (tags[i] - 1) // 2, i + 1
            while j < n and tags[j] == 2 + 2 * k:
                j += 1
            found.append((start + i, start + j, int(k), i == 0 and start > 0, j == n and start + n < length))
            i = j
        else:
            i += 1
    return found


def reconcile(found: list[tuple[int, int, int, bool, bool]], text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans of all windows as one list: overlapping ones of a kind unite, and an end counts as cut only if no window
    shows it whole; cut spans go, of overlapping kinds the longer stays, and none overlaps a base span or lacks digits and
    at sign."""
    united: list[list] = []
    for s, e, k, left, right in sorted(found, key=lambda x: (x[2], x[0], x[1])):
        if united and united[-1][2] == k and s < united[-1][1]:
            u = united[-1]
            u[3] = u[3] and left if s == u[0] else u[3]
            u[4] = right if e > u[1] else u[4] and right if e == u[1] else u[4]
            u[1] = max(u[1], e)
        else:
            united.append([s, e, k, left, right])
    taken = [(s, e) for s, e, _ in base]
    kept = []
    for s, e, k, left, right in sorted(united, key=lambda x: (x[0] - x[1], x[0], x[2])):
        if not left and not right and _TRIGGER.search(text, s, e) and all(e <= a or b <= s for a, b in taken):
            taken.append((s, e))
            kept.append((s, e, KINDS[k]))
    return sorted(kept, key=lambda x: (x[0], KINDS.index(x[2])))


def find_added(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, str]]], batch: int = 512) -> list[list[tuple[int, int, str]]]:
    """The spans that the network adds to each text's base spans."""
    found: list[list] = [[] for _ in texts]
    held: list[tuple[int, int, np.ndarray]] = []

    def run():
        tags = tagger.decode(np.stack([c for _, _, c in held]))
        for (i, start, _), t in zip(held, tags):
            if t.any():
                found[i] += _spans_of(t, start, len(texts[i]))
        held.clear()

    for i, text in enumerate(texts):
        for start in window_starts(text):
            c = encode_chars(text[start : start + WINDOW])
            held.append((i, start, np.pad(c, (0, WINDOW - len(c)))))
            if len(held) >= batch:
                run()
    if held:
        run()
    return [reconcile(f, t, b) if f else [] for f, t, b in zip(found, texts, base)]


def fit_tagger(docs: DataFrame, text_col: str = "text", sample: int = 2000, windows: int = 6, steps: int = 600) -> Tagger:
    """Trains on at most ``sample`` windows of about 1.5 times as many texts that hold a digit or an at sign, at most ``windows``
    of each; the texts are chosen by hash, and only these windows reach the driver. Base spans are the labels. Null texts
    take no part, copies count once, ties are settled by the windows themselves. Without such texts the network stays
    silent."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))

    def cut(batches):
        for whole in batches:
            for _, part in slices(whole, "text"):
                rows = []
                for t in part.to_pylist():
                    spans, starts = base_spans(t), window_starts(t)
                    key = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                    step = max(1, len(starts) // windows)
                    for s in starts[key % step :: step][:windows]:
                        rows.append((t[s : s + WINDOW], tag_window(spans, s).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["text", "tags"])

    got = {r["text"]: r["tags"] for r in some_texts(texts, sample).mapInArrow(tidy(cut), "text string, tags binary").orderBy("text", "tags").collect()}  # at most windows x 1.5 sample
    got = sorted(got.items(), key=lambda r: (hashlib.blake2b(r[0].encode("utf-8", "surrogatepass")).digest(), r[0]))[:sample]
    tagger = Tagger()
    if not got:
        tagger.p["b"][0] = 1e3
        return tagger
    chars = np.stack([np.pad(c := encode_chars(t), (0, WINDOW - len(c))) for t, _ in got])
    tags = np.stack([np.frombuffer(b, np.int8) for _, b in got]).astype(np.int64)
    tagger.train(chars, tags, steps)
    return tagger


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_pii(docs: DataFrame, tagger: Tagger, text_col: str = "text", mask: bool = False) -> DataFrame:
    """The input with n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as kind:start:end in code
    points) and, if ``mask``, the text with every span replaced by its kind in brackets.

    Whole texts are searched; a null or empty text has no spans (and is left as it is by ``mask``). Repeated rows get
    the same result each; input columns of the new names are replaced.
    """
    docs = docs.drop("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").withColumn(text_col, F.col(text_col).cast("string"))
    schema = StructType(list(docs.schema.fields))
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for batch, part in slices(whole, text_col):
                texts = part.to_pylist()
                base = [base_spans(t) for t in texts]
                added = find_added(tagger, texts, base)
                spans = [sorted(x + y, key=lambda s: (s[0], KINDS.index(s[2]))) if y else x for x, y in zip(base, added)]
                columns = list(batch.columns)
                if mask and any(spans):
                    columns[at] = pa.array([_masked(t, s) if s else o for t, s, o in zip(texts, spans, batch.column(text_col).to_pylist())], columns[at].type)
                columns += [pa.array([sum(x[2] == k for x in s) for s in base], pa.int64()) for k in KINDS]
                columns += [pa.array([hashlib.sha256(listed(s).encode()).hexdigest() for s in base]), pa.array([listed(s) for s in spans], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(tidy(run), schema)


def _masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in spans:
        if e > at:
            out += [text[at : max(s, at)], f"[{kind.upper()}]"]
            at = e
    return "".join(out) + text[at:]
