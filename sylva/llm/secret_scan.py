"""Secret scans with DataFrame functions alone: patterns, and entropy in sliding windows over candidate strings.

Three patterns give the base spans. Besides, every longer run of key characters is a candidate: a window slides over it,
counts of its characters go up and down by what enters and leaves, and the Shannon entropy follows from them. Windows
above the limit of the candidate's character class make a span, unless an allow-list knows the string.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def either_case(words: str) -> str:
    """The pattern with a class of both cases for each ASCII letter: what Java and RE2 take for the other case differs."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: Kinds of base spans in their order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # of AKIA[A-Z0-9]+ those with 18 characters: a shorter run holds no longer one
HEX = r"[0-9a-f]{16,}"  # of [0-9a-f]+ those with 16 characters, as a match is a whole run
ASSIGN_VALUE = 12

#: What the method adds is called so.
ADDED = "entropy"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: (class, what a candidate has to match, least entropy of a window in bits): the first that fits holds.
CLASSES = [
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 2.9),
    ("alnum", r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z]+$", 3.7),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+$", 3.9),
]
#: Strings that look random and are no secrets, anywhere in a candidate.
ALLOWED = [
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",  # a UUID
    r"^sha(?:1|256|384|512)-",  # a digest that says so
    r"(?i:example|sample|dummy|placeholder|changeme|your[_-]|xxxx)",
    r"(?i:abcdef|bcdefg)|0123456|1234567|9876543",  # counted out
]
UNIT = 10**9


def scaled(window: int) -> list[int]:
    """c * log2(c) for counts of 0 to ``window``, in whole units, so that sums of differences are exact."""
    return [0] + [round(UNIT * c * math.log2(c)) for c in range(1, window + 1)]


def high_windows(candidate: Column, limit: Column, window: int) -> Column:
    """(first, last) of the characters (from 0) that windows of ``window`` characters with at least ``limit`` bits cover.

    One fold over the candidate. Its state are the counts by character and the sum of c log2 c, which two counts change per
    step; a window's entropy is log2(window) less that sum / window. (null, null) if no window reaches the limit.
    """
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    table = F.array(*[F.lit(v).cast("long") for v in scaled(window)])
    most = (F.lit(window * math.log2(window)) - F.lit(window) * limit) * UNIT
    state = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("at"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )

    def step(s: Column, moved: Column) -> Column:
        came, went = moved["came"], moved["went"]
        up, down = s["counts"][came], s["counts"][went]
        of = lambda n: F.get(table, n)
        gained = of(up + 1) - of(up) + F.when(went > 0, of(down - 1) - of(down)).otherwise(0)
        total = s["sum"] + F.when(came == went, 0).otherwise(gained)
        counts = F.transform(s["counts"], lambda v, j: v + F.when(j == came, 1).otherwise(0) - F.when((j == went) & (went > 0), 1).otherwise(0))
        at = s["at"] + 1
        high = (at >= window) & (total <= most)
        return F.struct(
            counts.alias("counts"), total.alias("sum"), at.alias("at"),
            F.coalesce(s["first"], F.when(high, at - window)).alias("first"), F.when(high, at).otherwise(s["last"]).alias("last"),
        )

    moves = F.zip_with(codes, F.concat(F.array_repeat(F.lit(0), window), codes), lambda came, went: F.struct(came.alias("came"), F.coalesce(went, F.lit(0)).alias("went")))
    return F.aggregate(F.filter(moves, lambda m: m["came"].isNotNull()), state, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _gaps(text: Column, pattern: str, found: Column) -> Column:
    """Characters before each match, from the match before it. The text is only split where there is a match."""
    return F.when(F.size(found) > 0, F.transform(F.split(text, pattern, -1), F.length))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, classes: list[tuple[str, str, float]] | None = None, allowed: list[str] | None = None,
) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``window``: characters of a window, and the least of a candidate. ``classes``: see CLASSES. ``allowed``: patterns that
    suppress a candidate. ``spans``: kind:start:end of all spans in code points, the end exclusive, by start, then kind as
    listed (assign, access, hex, entropy), comma-joined. An added span never overlaps a base span, and base spans stay
    whatever the allow-list says.

    A null or empty text has no spans; repeated rows, and rows with null ids, each get a row; an empty table gives none.
    Other columns are not looked at.
    """
    classes, allowed = classes or CLASSES, ALLOWED if allowed is None else allowed
    candidates = f"[{ALPHABET[:-1]}-]{{{window},}}"
    patterns = [ASSIGN, ACCESS, HEX, candidates]
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    matched = rows.select("*", *[_matches(F.col("text"), p).alias(f"m{k}") for k, p in enumerate(patterns)])
    values = F.when(F.size("m0") > 0, _matches(F.col("text"), ASSIGN, 2))
    cut = matched.select("id", "row", *[f"m{k}" for k in range(4)], values.alias("values"), *[_gaps(F.col("text"), p, F.col(f"m{k}")).alias(f"g{k}") for k, p in enumerate(patterns)])

    def parts(k: int) -> Column:
        """The matches of a kind with what stands before each; the text itself only of candidates."""
        kept = F.lit(None).cast("string")
        zipped = F.zip_with(f"m{k}", f"g{k}", lambda m, g: F.struct(F.lit(k).alias("kind"), F.length(m).alias("len"), g.alias("gap"), m.alias("string") if k == 3 else kept.alias("string")))
        return F.coalesce(F.filter(zipped, lambda x: x["len"].isNotNull()), F.array().cast("array<struct<kind:int,len:int,gap:int,string:string>>"))

    long_enough = F.transform("values", lambda v: F.length(v) >= ASSIGN_VALUE)
    each = cut.select("id", "row", F.concat(*[parts(k) for k in range(4)]).alias("parts"), long_enough.alias("fits")).select("id", "row", "fits", F.posexplode_outer("parts").alias("pos", "part"))
    limit = F.coalesce(*[F.when(F.col("part.string").rlike(p), F.lit(bits)) for _, p, bits in classes])
    for p in allowed:
        limit = F.when(~F.col("part.string").rlike(p), limit)
    judged = each.select(
        "id", "row", "pos", "part.kind", "part.len", "part.gap", "part.string", limit.alias("limit"),
        F.when(F.col("part.kind") == 0, F.get("fits", F.col("pos"))).otherwise(True).alias("fits"),  # the kind comes first in parts
    ).withColumn("high", F.when(F.col("limit").isNotNull(), high_windows(F.col("string"), F.col("limit"), window))).drop("string", "limit")
    so_far = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.sum(F.col("gap") + F.col("len")).over(so_far) - F.col("len")
    spans = judged.withColumn("begin", begin).select(
        "id", "row", "kind",
        F.when(F.col("kind") < 3, F.col("fits")).otherwise(F.col("high.first").isNotNull()).alias("holds"),
        F.when(F.col("kind") < 3, F.col("begin")).otherwise(F.col("begin") + F.col("high.first")).alias("start"),
        F.when(F.col("kind") < 3, F.col("begin") + F.col("len")).otherwise(F.col("begin") + F.col("high.last")).alias("end"),
    )
    in_row = Window.partitionBy("row").orderBy("start", "kind")
    base = F.col("holds") & (F.col("kind") < 3)
    before = F.max(F.when(base, F.col("end"))).over(in_row.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(in_row.rowsBetween(0, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    told = spans.withColumn("told", F.col("holds") & (base | free))
    listed = told.groupBy("row").agg(
        F.first("id").alias("id"), *[F.count(F.when(base & (F.col("kind") == k), True)).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sort_array(F.collect_list(F.when(F.col("told"), F.struct("start", "kind", "end")))).alias("list"),
    )
    names = F.array(*[F.lit(n) for n in (*KINDS, ADDED)])
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    return listed.select(
        F.col("id").alias(id_col), *[f"n_{name}" for name in KINDS],
        F.sha2(say(F.filter("list", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), say(F.col("list")).alias("spans"),
    )
