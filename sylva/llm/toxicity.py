"""Toxicity by weak supervision.

Many voters (word lists, phrases, writing patterns, and word lists mined from labelled rows) vote on every text. A
generative label model, fitted by expectation maximisation on the counts of vote combinations over all texts, estimates
the accuracy of each voter and how far voters repeat each other; its posteriors are the training labels of a sparse
linear classifier on word and word-beginning features, and that classifier scores the texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Words, bounded_sample, flat_bytes, slices, some_texts, strings, tidy

#: Word lists, one voter each.
LEXICONS = {
    "person": "idiot moron loser clown imbecile fool jerk dunce coward freak pig rat",
    "quality": "stupid pathetic worthless useless dumb ridiculous ugly lazy ignorant",
    "disgust": "disgusting scum trash garbage filth filthy vermin vile repulsive",
    "profane": "damn crap bastard bitch asshole shit shitty fuck fucking bullshit",
    "threat": "kill murder strangle exterminate",
    "spanish": "idiota estúpido estúpida imbécil basura asqueroso asquerosa inútil mierda escoria",
    "french": "idiot imbécile crétin crétine débile dégoûtant ordure merde minable connard",
    "german": "idiot dumm dummkopf abschaum widerlich wertlos scheiße arschloch versager trottel",
}
#: Phrases, one voter.
PHRASES = ["shut up", "hate you", "kill you", "kill yourself", "go die", "you idiot", "you moron", "piece of shit", "get lost"]
MINED = 4
PREFIXES = (4, 6)
LEVELS = (1, 2, 4)
VOTERS = [*LEXICONS, "phrases", "shouting", *(f"mined{i}" for i in range(MINED))]
BITS = 20
SIZE = len(LEVELS) << BITS


def hashes(words: list[str]) -> np.ndarray:
    return Words(strings(pa.array(words))).hash if words else np.zeros(0, np.uint64)


def _per_text(words: Words, hit: np.ndarray) -> np.ndarray:
    """How many of the words of each text are hit."""
    return np.diff(np.r_[0, np.cumsum(hit)][words.of_text])


def _phrase_hits(words: Words, texts: int) -> np.ndarray:
    found = np.zeros(texts, np.int64)
    for k in {len(p.split()) for p in PHRASES}:
        wanted = np.array([g for p in PHRASES if len(p.split()) == k for g in Words(strings(pa.array([p]))).grams(k)[2]], np.uint64)
        of, _, h = words.grams(k)
        found += np.bincount(of[np.isin(h, wanted)], minlength=texts)
    return found


def features(words: Words) -> np.ndarray:
    """For each word its features: the word itself and its beginnings, as numbers below 2 ** BITS (0: none)."""
    shift = np.uint64(64 - BITS)
    return np.stack([np.maximum(words.hash >> shift, np.uint64(1)), *(words.prefixes(k) >> shift for k in PREFIXES)], 1).astype(np.int32)


def counted(words: Words, feats: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, numbered feature) without repeats. A feature that stands in a text at least LEVELS[k] times also counts as
    feature number k * 2 ** BITS + itself. ``wanted``: a table of the features to look at, or None for all."""
    word, column = np.nonzero(feats if wanted is None else wanted[feats])
    text = np.searchsorted(words.of_text, word, side="right") - 1
    pairs, n = np.unique(text.astype(np.int64) << 32 | feats[word, column], return_counts=True)
    text, f = pairs >> 32, pairs & 0xFFFFFFFF
    at = [n >= least for least in LEVELS]
    return np.concatenate([text[m] for m in at]), np.concatenate([f[m] + (k << BITS) for k, m in enumerate(at)])


def per_text(of: np.ndarray, f: np.ndarray, texts: int) -> list[np.ndarray]:
    order = np.argsort(of, kind="stable")
    return np.split(f[order].astype(np.int32), np.cumsum(np.bincount(of, minlength=texts))[:-1])


def base_table(numbers: np.ndarray) -> np.ndarray:
    """Which features below 2 ** BITS are meant by the numbered ones."""
    table = np.zeros(1 << BITS, bool)
    table[numbers & ((1 << BITS) - 1)] = True
    table[0] = False
    return table


@dataclass
class Model:
    """``weights`` and ``bias`` of the linear classifier; ``accuracy``: P(vote | toxic) and P(vote | not) of each voter;
    ``correlation``: of each pair of voters, the larger one of both classes; ``mined``: feature numbers of the mined
    voters."""

    weights: np.ndarray
    bias: float
    mined: list[np.ndarray] = field(default_factory=list)
    accuracy: np.ndarray | None = None
    correlation: np.ndarray | None = None
    prior: float = 0.0


def votes(texts: pa.Array, words: Words, mined: list[np.ndarray], feats: np.ndarray) -> np.ndarray:
    """Each text's votes as a number, bit j for VOTERS[j]."""
    n, bits, j = len(texts), np.zeros(len(texts), np.int64), 0
    for lexicon in LEXICONS.values():
        bits |= (_per_text(words, np.isin(words.hash, hashes(lexicon.split()))) > 0).astype(np.int64) << j
        j += 1
    bits |= (_phrase_hits(words, n) > 0).astype(np.int64) << j
    raw, offsets = flat_bytes(texts)
    count = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][offsets])
    upper, lower = count((raw >= 65) & (raw <= 90)), count((raw >= 97) & (raw <= 122))
    bits |= ((upper > 20) & (upper > 2 * lower)).astype(np.int64) << (j + 1)
    j += 2
    if any(map(len, mined)):
        table = np.zeros(SIZE, np.uint8)
        for i, numbers in enumerate(mined):
            table[numbers] |= 1 << i
        of, f = counted(words, feats, base_table(np.concatenate(mined)))
        for i in range(len(mined)):
            bits |= (np.bincount(of, (table[f] >> i) & 1, minlength=n) > 0).astype(np.int64) << (j + i)
    return bits


def mine(samples: list[tuple[np.ndarray, int]], least: int = 3, precision: float = 0.85, most: int = 1024) -> list[np.ndarray]:
    """MINED groups of the features that mark toxic labelled texts: in at least ``least`` of them, and in others so
    seldom that the share of toxic ones, each class counted as if of one size, is ``precision`` or more."""
    toxic, clean = np.zeros(SIZE), np.zeros(SIZE)
    for f, y in samples:
        (toxic if y else clean)[f] += 1
    n1, n0 = max(1, sum(y for _, y in samples)), max(1, sum(1 - y for _, y in samples))
    rate1, rate0 = toxic / n1, (clean + 0.5) / n0
    z = (rate1 - clean / n0) / np.sqrt((toxic + clean + 1) / (n1 + n0) / n1)
    good = np.flatnonzero((toxic >= least) & (rate1 / (rate1 + rate0) >= precision) & (toxic / (toxic + clean + 0.5) >= 0.5) & (z >= 4))
    good = good[np.argsort(-z[good], kind="stable")][:most]
    return [np.sort(good[i::MINED]) for i in range(MINED)]


def label_model(patterns: list[tuple[int, int, float]], prior: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float, dict[int, float]]:
    """Expectation maximisation over (votes, label or -1, count).

    Returns P(vote | class) for both classes (row 1: toxic), the correlations of the voters within the classes, the
    prior and the posterior of each vote combination. A voter's log-likelihood ratio is divided by one plus its summed
    positive correlations, so voters that repeat each other count once.
    """
    m = len(VOTERS)
    v = np.array([p[0] for p in patterns], np.int64)
    y = np.array([p[1] for p in patterns])
    c = np.array([p[2] for p in patterns], float)
    x = ((v[:, None] >> np.arange(m)) & 1).astype(float)
    p = np.where(y >= 0, y, np.where(x.any(1), 0.7, prior / 2)).astype(float)
    rate, discount = np.zeros((2, m)), np.ones(m)
    correlation = np.eye(m)
    for _ in range(rounds):
        for k, q in ((1, p * c), (0, (1 - p) * c)):
            rate[k] = (q @ x + (0.05 if k == 0 else 0.2)) / (q.sum() + 1.0)
        rate = np.clip(rate, 1e-5, 1 - 1e-5)
        rate[1] = np.maximum(rate[1], rate[0])  # a voter speaks for toxicity or not at all
        for k, q in ((1, p * c), (0, (1 - p) * c)):
            d = x - rate[k]
            cov = (d * q[:, None]).T @ d / max(q.sum(), 1.0)
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            cor = np.abs(cov / np.outer(scale, scale)) * (np.minimum.outer(np.diag(cov), np.diag(cov)) > 1e-4)
            correlation = cor if k == 1 else np.maximum(correlation, cor)
        np.fill_diagonal(correlation, 1.0)
        discount = 1 / (1 + np.maximum(correlation - np.eye(m), 0).sum(0))
        on, off = np.log(rate[1] / rate[0]) * discount, np.log((1 - rate[1]) / (1 - rate[0])) * discount
        z = np.log(prior / (1 - prior)) + x @ on + (1 - x) @ off
        p = np.where(y >= 0, 0.1 / (1 + np.exp(-z)) + 0.9 * y, 1 / (1 + np.exp(-z)))
        prior = float(np.clip((p * c).sum() / max(c.sum(), 1.0), 1e-4, 0.5))
    return rate, correlation, prior, {int(a): float(1 / (1 + np.exp(-b))) for a, b in zip(v, z)}


def fit_linear(samples: list[np.ndarray], target: np.ndarray, trust: np.ndarray, support: int = 4, most: int = 8192, epochs: int = 40, l2: float = 2e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logistic regression on the presence of features, by averaged Adagrad; target: a probability for each text; trust: how much
    it weighs.

    Only the ``most`` features that are in ``support`` texts or more and differ most between the classes get a weight.
    """
    df, on = np.zeros(SIZE), np.zeros(SIZE)
    for f, t, c in zip(samples, target, trust):
        df[f] += c
        on[f] += c * t
    base = (target * trust).sum() / trust.sum()
    z = (on - df * base) / np.sqrt(df * base * (1 - base) + 1.0)
    z[df < support] = 0
    z[0] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:most]
    chosen = chosen[np.abs(z[chosen]) > 3]
    slot = np.full(SIZE, -1)
    slot[chosen] = np.arange(len(chosen))
    rows = [(s := slot[f])[s >= 0] for f in samples]
    w, b = np.zeros(len(chosen)), float(np.log(base / (1 - base)))
    gw, gb, rng = np.full(len(chosen), 1e-6), 1e-6, np.random.default_rng(seed)
    balance = np.where(target > 0.5, min(10.0, 0.5 / max(base, 0.01)), 1.0) * trust
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            g = (1 / (1 + np.exp(-np.clip(w[r].sum() + b, -30, 30))) - target[i]) * balance[i]
            d = g + l2 * w[r]
            gw[r] += d * d
            w[r] -= 0.3 * d / np.sqrt(gw[r])
            gb += g * g
            b -= 0.1 * g / np.sqrt(gb)
    weights = np.zeros(SIZE, np.float32)
    weights[chosen] = w
    return weights, b


def with_label(p: float, y: int, trust: float = 0.97) -> float:
    """The posterior of a labelled text: its label is one more voter, right with probability ``trust``."""
    odds = p / max(1 - p, 1e-9) * (trust / (1 - trust) if y else (1 - trust) / trust)
    return odds / (1 + odds)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 3000, unlabelled: float = 0.5) -> Model:
    """Fits everything on ``docs`` (texts that may be learned from) and ``labels`` (id_col, toxic).

    Bound: the mined voters are fitted on at most ``sample`` labelled texts of each class, the classifier on these and on about
    half of ``sample`` texts without a label, whose target is the label model's posterior alone; all are chosen by hash, and
    only their feature numbers and votes reach the driver. A label counts as one more voter, and
    a text without one weighs ``unlabelled`` of one with. The label model is fitted on
    the counts of vote combinations (at most 2 to the number of voters rows) over all texts of ``docs``.

    Labels other than 0 and 1 and null ids are passed over; of several labels of one id the largest counts, and repeated
    rows of a text each count. Null texts count as empty. Ties are settled by the features, so the model is the same for
    every partitioning. Without any text the model holds everything for clean.
    """
    labels = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull())
    per_class = labels.groupBy("_id").agg(F.max("toxic").alias("toxic")).withColumn("text", F.col("_id").cast("string"))
    chosen = {r["_id"]: r["toxic"] for r in bounded_sample(per_class, "toxic", sample)}
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    near = F.broadcast(spark.createDataFrame([(k, int(v)) for k, v in chosen.items()], f"_id {texts.schema['_id'].dataType.simpleString()}, toxic int"))  # about 3 x sample rows

    def numbers(batches):
        for whole in batches:
            for batch, part in slices(whole, "text"):
                words = Words(part)
                feats = features(words)
                rows = per_text(*counted(words, feats), len(part))
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(votes(part, words, [], feats)), pa.array([r.tobytes() for r in rows], pa.binary())], ["toxic", "votes", "f"])

    labelled = texts.join(near, "_id", "left").select(F.coalesce("toxic", F.lit(-1)).alias("toxic"), "text")
    learn = labelled.where("toxic >= 0").union(some_texts(labelled.where("toxic < 0"), sample // 3)).mapInArrow(tidy(numbers), "toxic int, votes long, f binary").collect()
    learn = sorted(((np.frombuffer(r["f"], np.int32), r["toxic"], r["votes"]) for r in learn), key=lambda s: (s[1], len(s[0]), s[0].tobytes()))
    mined = mine([(f, y) for f, y, _ in learn if y >= 0])
    first = len(VOTERS) - MINED
    known = [v | sum(int(np.isin(f, m).any()) << (first + i) for i, m in enumerate(mined)) for f, _, v in learn]

    def count_votes(batches):
        for whole in batches:
            for batch, part in slices(whole, "text"):
                words = Words(part)
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(votes(part, words, mined, features(words)))], ["toxic", "votes"])

    patterns = [(r["votes"], r["toxic"], float(r["n"])) for r in labelled.mapInArrow(tidy(count_votes), "toxic int, votes long").groupBy("votes", "toxic").agg(F.count("*").alias("n")).orderBy("votes", "toxic").collect()]
    if not patterns:
        return Model(np.zeros(SIZE, np.float32), -3.0, mined)
    prior = float(np.clip(per_class.agg(F.avg("toxic")).first()[0] or 0.05, 0.005, 0.5)) if any(y >= 0 for _, y, _ in patterns) else 0.05
    rate, correlation, prior, posterior = label_model(patterns, prior)
    target = np.array([with_label(posterior.get(v, prior), y) if y >= 0 else posterior.get(v, prior) for (_, y, _), v in zip(learn, known)])
    weights, bias = fit_linear([f for f, _, _ in learn], target, np.array([1.0 if y >= 0 else unlabelled for _, y, _ in learn]))
    return Model(weights, bias, mined, rate, correlation, prior)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input with score (probability of toxic) and predicted (1 if score >= 0.5).

    Every whole text is scored, each feature counting once a text; a null or empty text gets the score of no features.
    Repeated rows get the same score; input columns of these names are replaced.
    """
    docs = docs.drop("score", "predicted").withColumn(text_col, F.col(text_col).cast("string"))
    schema = StructType(list(docs.schema.fields)).add("score", "double").add("predicted", "integer")
    spark = docs.sparkSession
    used = np.flatnonzero(model.weights)
    numbers, weights, bias = used, model.weights[used].astype(float), model.bias
    shared = spark.sparkContext.broadcast((numbers, weights))  # at most ``most`` numbers of fit_linear

    def run(batches):
        numbers, weights = shared.value
        full = np.zeros(SIZE, np.float32)
        full[numbers] = weights
        wanted = base_table(numbers)
        for whole in batches:
            for batch, part in slices(whole, text_col):
                words = Words(part)
                of, f = counted(words, features(words), wanted)
                z = bias + np.bincount(of, full[f], minlength=len(part))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema.names)

    return docs.mapInArrow(tidy(run), schema)
