"""URL filters by association rules, with DataFrame functions alone.

Explicit rules on host and path label the urls that they fit. Spark's FP-growth mines token combinations that go with a
label; rules pruned by confidence and support are indexed by their rarest token, and every other url looks its tokens up
in that inverted index and takes the verdict of the strongest rule whose tokens it has.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, host and path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and the beginning of the path. Null if none does."""
    tests = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        tests.append(F.when(((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest)), F.lit(rule)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Scheme, last label, last two labels, first label, every path segment, file ending, every query key, whether there is a
    query, whether there is a fragment."""
    labels = F.split(host, r"\.")
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    asked = F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(asked, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.substring_index(x, "=", 1)))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), x))
    parts = [
        F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
        F.concat(F.lit("tld:"), F.element_at(labels, -1)),
        F.concat(F.lit("domain:"), F.substring_index(host, ".", -2)),
        F.when(F.size(labels) > 2, F.concat(F.lit("sub:"), labels[0])),
        F.when(ending != "", F.concat(F.lit("ending:"), F.lower(ending))),
        F.when(F.contains(url, F.lit("?")), F.lit("query")),
        F.when(F.contains(url, F.lit("#")), F.lit("fragment")),
    ]
    return F.array_distinct(F.concat(F.array_compact(F.array(*parts)), segments, keys))


def token_groups(labelled: DataFrame, min_support: float) -> DataFrame:
    """(item, members, freq): the frequent tokens, those that stand in the very same urls as one item, named by its first.

    Such tokens say the same, and all combinations of them are as frequent as they are: taken one by one, the segments of
    one long path that a few urls share would give 2 ** segments frequent sets. Two tokens stand in the same urls if as many
    urls have them and two sums of the urls' hashes agree.
    """
    total = labelled.count()
    h = lambda salt: F.pmod(F.xxhash64(F.lit(salt), F.array_sort("tokens")), F.lit(1 << 31))
    each = labelled.select(h(1).alias("_a"), h(2).alias("_b"), F.explode(F.array_distinct("tokens")).alias("token"))
    tokens = each.groupBy("token").agg(F.count("*").alias("freq"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).where(F.col("freq") >= min_support * total)
    return tokens.groupBy("freq", "_a", "_b").agg(F.array_sort(F.collect_set("token")).alias("members")).select(F.col("members")[0].alias("item"), "members", "freq")


def mine_rules(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8, min_domains: int = 3) -> DataFrame:
    """(verdict, groups, antecedent, confidence, support, token, wide) from rows (tokens, verdict).

    Tokens that always stand together are one group (``token_groups``), and rules are mined over groups: with any tokens of
    each of its groups a rule is as good as with all of them (``antecedent``). ``wide``: the rule holds for labelled urls of
    ``min_domains`` registered domains (last two labels) at least; what one host's paths go with says nothing about
    other hosts, so other rules need a token that names a domain. At most the urls' number of tokens / ``min_support``
    tokens can be frequent, whatever the size of the input. ``token``: the first token of the rarest group, which keys the
    index.
    """
    groups = token_groups(labelled, min_support)
    domain = F.get(F.filter("tokens", lambda t: F.startswith(t, F.lit("domain:"))), F.lit(0))
    numbered = labelled.withColumns({"_row": F.monotonically_increasing_id(), "domain": domain})
    known = numbered.select("_row", "verdict", "domain", F.explode_outer("tokens").alias("token")).join(F.broadcast(groups.select(F.explode("members").alias("token"), "item")), "token", "left")
    baskets = known.groupBy("_row").agg(F.collect_set("item").alias("own"), F.first("verdict").alias("verdict"), F.first("domain").alias("domain"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets.select(F.concat("own", F.array(F.concat(F.lit("="), "verdict"))).alias("items")))
    rules = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit("=")))
    rules = rules.where(~F.exists("antecedent", lambda t: F.startswith(t, F.lit("="))))
    rules = rules.select(F.substr(F.col("consequent")[0], F.lit(2)).alias("verdict"), F.array_sort("antecedent").alias("items"), "confidence", "support")
    whole = rules.select("*", F.explode("items").alias("item")).join(F.broadcast(groups), "item")  # a few tokens a url / min_support
    keyed = whole.groupBy("verdict", "items", "confidence", "support").agg(F.array_sort(F.collect_list("members")).alias("groups"), F.min_by("item", F.struct("freq", "item")).alias("token"))
    seen = baskets.select("verdict", "domain", "own", F.explode("own").alias("token")).join(F.broadcast(keyed.select("verdict", "items", "token")), ["token", "verdict"])  # no more than the mined rules
    seen = seen.where(F.size(F.array_except("items", "own")) == 0).groupBy("verdict", "items", "domain").agg(F.lit(1).alias("one"))
    domains = seen.groupBy("verdict", "items").agg(F.count("domain").alias("domains"))
    told = keyed.join(F.broadcast(domains), ["verdict", "items"], "left").withColumn("wide", F.coalesce(F.col("domains"), F.lit(0)) >= min_domains)
    antecedent = F.array_sort(F.flatten("groups"))
    return told.where(F.col("wide") | F.exists(antecedent, lambda t: F.startswith(t, F.lit("domain:")))).select("verdict", "groups", antecedent.alias("antecedent"), "confidence", "support", "token", "wide")


def judge(
    pages: DataFrame, rules: list[tuple[str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url",
    min_support: float = 0.01, min_confidence: float = 0.8, min_domains: int = 3,
) -> DataFrame:
    """One row per input row: id_col, host, path, rule, verdict, mined (tokens of the mined rule that decided, else
    null) and confidence.

    Null urls and urls without ``://`` have empty host and path, fit no rule and get ``default``, as do urls that no
    mined rule fits. A mined rule fits a url that has a token of each of its groups. With no labelled url nothing is mined. Ties between mined rules: higher confidence, then support,
    more tokens, then verdict and tokens in order. Repeated rows each get a row; other columns are left out.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    verdict = F.lit(None).cast("string")
    for v, r in rules:
        verdict = F.when(F.col("rule") == r, v).otherwise(verdict)
    rows = rows.withColumn("given", verdict)
    index = mine_rules(rows.where(F.col("given").isNotNull()).select("tokens", F.col("given").alias("verdict")), min_support, min_confidence, min_domains)
    keys = F.get(F.filter("groups", lambda g: F.array_contains(g, F.col("token"))), F.lit(0))
    index = index.select(F.explode(keys).alias("token"), F.struct("confidence", "support", "verdict", "groups", "wide").alias("found")).groupBy("token").agg(F.collect_list("found").alias("rules"))
    open_rows = rows.withColumn("row", F.monotonically_increasing_id())
    looked = open_rows.withColumn("token", F.explode_outer(F.when(F.col("given").isNull(), F.col("tokens")))).join(F.broadcast(index), "token", "left")  # bounded: see mine_rules
    held = lambda r: F.transform(r["groups"], lambda g: F.array_intersect(g, F.col("tokens")))
    told = F.transform("rules", lambda r: F.struct(r.alias("rule"), held(r).alias("held")))
    named = lambda x: x["rule"]["wide"] | F.exists(F.flatten(x["held"]), lambda t: F.startswith(t, F.lit("domain:")))
    fitting = F.filter(told, lambda x: F.forall(x["held"], lambda h: F.size(h) > 0) & named(x))
    own = lambda x: F.array_sort(F.flatten(x["held"]))
    fits = F.transform(fitting, lambda x: F.struct(x["rule"]["confidence"].alias("confidence"), x["rule"]["support"].alias("support"), F.size(own(x)).alias("size"), x["rule"]["verdict"].alias("verdict"), own(x).alias("antecedent")))
    best = looked.withColumn("best", F.array_max(fits)).groupBy("row").agg(
        *[F.first(c).alias(c) for c in (id_col, "host", "path", "rule", "given")], F.max("best").alias("best")
    )
    return best.select(
        id_col, "host", "path", "rule", F.coalesce("given", F.col("best.verdict"), F.lit(default)).alias("verdict"),
        F.array_join("best.antecedent", " ").alias("mined"), F.col("best.confidence").alias("confidence"),
    )
