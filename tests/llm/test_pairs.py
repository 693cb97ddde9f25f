"""Operators that search or join: against brute force on small tables, and the hard cases."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

VOCAB = [f"w{i}" for i in range(400)]


def _words(r, n):
    return [r.choice(VOCAB) for _ in range(n)]


def _brute(rows, k=5, threshold=0.8):
    sets = {}
    for i, (d, t) in enumerate(rows):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    classes = {}
    for i, (d, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(d)
    return sorted((d, min(classes[find(i)]), links[i]) for i, (d, _) in enumerate(rows))


def test_join_against_brute_force(spark):
    from sylva.llm.ngram_join import keep_one, similar

    r = random.Random(4)
    rows, base = [], [_words(r, 60) for _ in range(12)]
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 6])):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(_words(r, 40))) for i in range(30)]
    rows += [(300, None), (301, ""), (302, "two words"), (303, "Two, WORDS"), (304, "..."), (305, " ".join(base[0] * 300)), (0, rows[0][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"set": F.lit(1), "label": F.lit("x"), "h": F.lit(2)})
    for block in (512, 7):  # one block a group, and many
        got = sorted((x.doc_id, x.class_id, x.n_links) for x in similar(table, block=block).collect())
        assert got == _brute(rows)
    kept = keep_one(table)
    assert sorted({x.doc_id for x in kept.collect()}) == sorted({c for _, c, _ in _brute(rows)}) and kept.columns == table.columns
    assert similar(table.limit(0)).count() == 0 and keep_one(table.limit(0)).count() == 0
    with_null = table.union(spark.createDataFrame([(None, "no id", 1, "x", 2)], table.schema))
    assert keep_one(with_null).where("doc_id is null").count() == 1


def test_pruning_bound():
    from sylva.llm.ngram_join import least_matches

    needed = least_matches(96, 16, 0.8, 1e-6)
    assert list(needed) == list(range(16, 97, 16)) and all(0 < needed[n] < 0.8 * n for n in needed) and needed[96] > 40


def test_components(spark):
    from sylva.llm.common import components

    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("900", "901"), ("903", "901"), ("950", "950")]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert {got[f"{i:03}"] for i in range(61)} == {"000"} and {got[x] for x in ("900", "901", "903")} == {"900"} and "950" not in got


def test_components_of_shuffled_chains(spark):
    from sylva.llm.common import components

    r = random.Random(3)
    names = [f"{x:06}" for x in r.sample(range(10**6), 6000)]
    chains = [names[:4000], names[4000:5500], names[5500:]]  # names in no order along a chain, as with hashes
    edges = [e for c in chains for e in zip(c, c[1:])]
    r.shuffle(edges)
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a string, b string").repartition(7)).collect()}
    assert got == {n: min(c) for c in chains for n in c}
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(edges, "a string, b string"), rounds=2)


def test_join_of_a_chain_of_versions(spark):
    from sylva.llm.ngram_join import similar

    r = random.Random(8)
    words = [f"v{i}" for i in range(700 * 5 + 60)]
    chain = [(i, " ".join(words[i * 5 : i * 5 + 60])) for i in range(700)]  # 56 grams, 51 shared with the next
    order = r.sample(range(700), 700)
    rows = [(order[i], t) for i, t in chain]
    got = {x.doc_id: (x.class_id, x.n_links) for x in similar(spark.createDataFrame(rows, "doc_id long, text string"), block=64).collect()}
    assert got == {order[i]: (0, 1 if i in (0, 699) else 2) for i in range(700)}


def test_neighbours(spark):
    from sylva.llm.ann import search

    r = np.random.default_rng(0)
    x = r.standard_normal((600, 16)).astype(np.float32)
    x[5] = x[100]
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)]
    bad = [(1000, None, 0), (1100, [0.0] * 16, 0), (1200, [float("nan")] * 16, 0), (1300, [float("inf")] + [1.0] * 15, 0), (1400, [1.0, None] + [1.0] * 14, 0), (1500, [1.0] * 7, 0), (None, [1.0] * 16, 0)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("stripe", F.lit("clash"))
    got = search(table, F.col("vec_id") % 100 == 0, books=8, words=32, shortlist=300, codes_per_block=100, queries_per_block=3).collect()
    by = {}
    for g in got:
        by.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    assert sorted(by) == [0, 100, 200, 300, 400, 500]
    hits = 0
    for q, found in by.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(600), d))[:10]
        assert [f[0] for f in sorted(found)] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in found) and [f[2] for f in sorted(found)] == sorted(f[2] for f in found)
        hits += len({v for _, v, _ in found} & set(best.tolist()))
    assert hits >= 54 and sorted(by[100])[0][1:] == (5, 0.0)
    # repeated ids stand once, and of more equal vectors than the shortlist holds the smallest ids come
    again = table.union(table.where("vec_id in (5, 7, 100)")).union(table.where("vec_id = 5"))
    twice = [(g.rank, g.vec_id, g.score) for g in search(again, F.col("vec_id") == 100, books=8, words=32, shortlist=300).collect()]
    assert sorted(twice) == sorted(by[100])
    same = spark.createDataFrame([(i, [1.0, 2.0, float(i < 1)]) for i in range(500)], "vec_id long, embedding array<double>")
    assert [g.vec_id for g in sorted(search(same, F.col("vec_id") == 0, books=2, words=2, shortlist=20, codes_per_block=64).collect(), key=lambda g: g.rank)] == list(range(1, 11))
    # repeated ids at the heads of the queries' blocks, and copies that would fill the shortlist
    heads = table.where("vec_id in (100, 200, 300)")
    many = table
    for _ in range(6):
        many = many.union(heads)
    for _ in range(40):
        many = many.union(table.where("vec_id = 5"))
    for stripes, block in ((1, 2), (2, 2), (3, 1)):
        crowded = search(many.coalesce(1), F.col("vec_id") % 100 == 0, books=8, words=32, shortlist=40, codes_per_block=64, queries_per_block=block, stripes=stripes).collect()
        for q in (0, 100, 200, 300, 400, 500):
            found = sorted((g.rank, g.vec_id) for g in crowded if g.query_id == q)
            d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
            d[q] = np.inf
            assert [f[0] for f in found] == list(range(1, 11)) and len({f[1] for f in found} & set(np.argsort(d)[:10].tolist())) >= 8
    few = search(table.where("vec_id < 4"), F.col("vec_id") % 100 == 0, books=2, words=4).collect()
    assert len(few) == 3
    assert search(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert search(table.where("vec_id = 1000"), F.lit(True)).count() == 0


def test_edit_distance():
    from sylva.llm.decontaminate import best_distance

    r = random.Random(1)
    for _ in range(800):
        p, t = bytes(r.choices(b"abc", k=r.randint(1, 12))), bytes(r.choices(b"abc", k=r.randint(0, 20)))
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
            row = new
        assert best_distance(p, t, 99) == min(row)
        assert best_distance(p, t, 1) == min(min(row), 2)


def test_leaks(spark):
    from sylva.llm.decontaminate import find_leaks

    r = random.Random(9)
    letters = "abcdefghilmnoprstu"
    prose = lambda n: " ".join("".join(r.choices(letters, k=r.randint(2, 8))) for _ in range(n))
    items = [(i, prose(40)) for i in range(20)] + [(50, "tiny item"), (51, ""), (52, None), (53, prose(8)), (54, "the quick brown fox jumps"), (54, "the quick brown fox jumps")]
    rows, expected = [], set()
    for i in range(60):
        text = prose(120)
        if i % 2:
            k, passage = items[i % 20]
            s = list(passage.upper() if i % 3 else passage)
            for _ in range(i % 5 * 2):
                s[r.randrange(len(s))] = r.choice(letters)
            text = text[:200] + ", " + "".join(s) + ". " + text[200:]
            expected.add((i, k))
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "a Tiny, item!"), (103, "tiny b item"), (104, items[23][1]), (105, items[3][1][: len(items[3][1]) // 2]), (106, "so: the quick brown foz jumps on"), (107, "the quick blue dog ran")]
    expected |= {(102, 50), (104, 53), (106, 54)}
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("leaks", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (4 << 20, 900):  # one pass, and several
        found = find_leaks(table, bench, item_bytes=size)
        assert found.count() == len(rows)
        assert {(x.doc_id, l.item) for x in found.collect() for l in x.leaks} == expected
    assert find_leaks(table.limit(0), bench).count() == 0
    assert find_leaks(table, bench.limit(0)).where(F.size("leaks") > 0).count() == 0


def test_urls(spark):
    from sylva.llm.url_filter import RULES, judge, mine_rules, tokens_of

    urls = [f"https://www.s{i % 9}.example.com/{'en' if i % 2 else 'de'}/{i}" for i in range(200)] + [f"http://s{i % 5}.example.net/{l}/{i}.html" for i in range(80) for l in ("es", "fr", "de")]
    urls += [None, "", "no scheme", "HTTPS://WWW.Example.COM/en/x?q#f", "http://example.com", "http://notexample.com/en/", "ftp://a.net/fr/#x", "x://y://z.net/es/1", "http://x.org/it/1"] + ["http://x.org/it/1"]
    table = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({"row": F.lit(1), "token": F.lit("clash")})
    got = {r.page_id: r for r in judge(table).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            host, path = m.group(1).lower(), m.group(2)
        fit = [(len(rule), v, rule) for v, rule in RULES if (host == rule.split("/", 1)[0] or host.endswith("." + rule.split("/", 1)[0])) and path.startswith("/" + rule.split("/", 1)[1])]
        best = max(fit, default=(0, None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[2])
        assert got[i].verdict == best[1] if best[1] else got[i].verdict in ("allow", "block")
    # the mined rules are those of counting by hand, and an unlabelled url gets the strongest that it fits
    labelled = spark.createDataFrame([(["a", "b"], "block")] * 9 + [(["a"], "allow")] * 1 + [(["b", "c"], "allow")] * 10, "tokens array<string>, verdict string")
    rules = {(tuple(r.antecedent), r.verdict): (round(r.confidence, 6), r.token) for r in mine_rules(labelled, 0.05, 0.8, min_domains=0).collect()}
    assert rules[(("a", "b"), "block")] == (1.0, "a") and rules[(("a",), "block")][0] == 0.9 and rules[(("c",), "allow")] == (1.0, "c") and (("b",), "allow") not in rules
    # what only one domain's paths go with is no rule for others; what five domains' paths go with is
    hosts = [f"https://h{i % 3}.one.com/en/{i}" for i in range(60)] + [f"https://x.d{i % 5}.net/es/{i}" for i in range(60)] + [f"https://x.d{i % 5}.com/a/{i}" for i in range(60)] + ["https://z.org/en/1", "https://z.org/es/1"]
    rules_of = [("block", "one.com/en/"), ("block", "net/es/"), ("allow", "com/")]
    verdicts = {r.path: (r.verdict, r.mined) for r in judge(spark.createDataFrame(list(enumerate(hosts)), "page_id long, url string"), rules_of).where("host = 'z.org'").collect()}
    assert verdicts["/en/1"] == ("allow", None) and verdicts["/es/1"][0] == "block" and "path:es" in verdicts["/es/1"][1]
    # six urls that share a path of 30 segments, which have 2 ** 30 combinations; a url with some of them is judged by those
    path = "/".join(f"seg{k}" for k in range(30))
    shared = hosts + [f"https://long{i}.net/es/{path}/{i}" for i in range(6)] + ["https://other.org/seg3/seg7/x", "https://other.org/seg3/x"]
    deep = {r.path: (r.verdict, r.mined) for r in judge(spark.createDataFrame(list(enumerate(shared)), "page_id long, url string"), rules_of).where("host = 'other.org'").collect()}
    assert deep["/seg3/seg7/x"][0] == deep["/seg3/x"][0] == "block" and {"path:seg3", "path:seg7"} <= set(deep["/seg3/seg7/x"][1].split()) and not {"path:seg4", "path:seg7"} & set(deep["/seg3/x"][1].split())
    # ties go to the rule of more tokens, repeated rows each get theirs
    twice = judge(spark.createDataFrame([(i, u) for i, u in enumerate(hosts)] + [(181, hosts[181])], "page_id long, url string"), rules_of).where("page_id = 181").collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    assert judge(table.limit(0)).count() == 0
    assert judge(table.where("url is null")).first().verdict == "allow"
    row = spark.createDataFrame([("https://a.b.example.com/x/y.html?q=1#z",)], "u string").select(tokens_of(F.col("u"), F.lit("a.b.example.com"), F.lit("/x/y.html")).alias("t")).first().t
    assert sorted(row) == ["domain:example.com", "ending:html", "fragment", "key:q", "path:x", "path:y.html", "query", "scheme:https", "sub:a", "tld:com"]


def test_pipeline_against_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as C

    r = random.Random(3)
    docs, labels = [], []
    benchmark = [(0, " ".join(_words(r, 40)))]
    for i in range(240):
        t = " ".join(_words(r, 60))
        if i % 4 == 0:
            t = "you stupid idiot " + t
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int(i % 4 == 0)))
    docs.append((500, docs[1][1], "en", "s", 9))
    docs.append((501, docs[2][1] + " " + benchmark[0][1], "en", "s", 9))
    docs.append((502, docs[3][1][:100] + " mail me at a.b@c.example.com now", "en", "s", 9))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: x for x in C.run(spark, str(tmp_path)).collect()}
    clean = {i for i in range(240) if i % 4} | {502}
    assert set(got) == clean
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    masked = C.personal_data(spark, read, str(tmp_path)).where("doc_id = 502").first()
    assert masked.text.endswith("mail me at [EMAIL] now") and masked.n_chars == len(masked.text)
    assert got[502].n_tokens == len(got[502].ids) > 0


def test_perhaps(spark):
    """The bitmap lets every partner through, and with few keys little else."""
    from sylva.llm.common import perhaps

    rows = spark.range(20000).select(F.col("id").alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    keys = rows.where("a % 50 = 3").union(rows.limit(1)).withColumn("x", F.lit(1))
    got = {(r.a, r.b): r._perhaps for r in perhaps(rows, keys, "a", "b").collect()}
    want = {(r.a, r.b) for r in keys.collect()}
    assert len(got) == 20000 and all(got[k] for k in want) and sum(got.values()) < len(want) + 30
    assert not any(r._perhaps for r in perhaps(rows, keys.limit(0), "a").collect())
    small = {r.a: r._perhaps for r in perhaps(rows, keys, "a", bits=4).collect()}
    assert all(small[a] for a, _ in want)


def test_pipeline_on_hard_tables(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, columns named like the stages' own, and tables without rows."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as C

    r = random.Random(4)
    long = " ".join(_words(r, 80))
    docs = [(1, long, "en", "s", 9), (1, long, "en", "s", 9), (2, None, None, None, None), (3, "", "en", "s", 0), (None, " ".join(_words(r, 30)), "en", None, 5), (4, " ".join(_words(r, 70)), None, "s", None), (5, " ".join(_words(r, 70)), "en", "s", 1), (6, " \n ", "en", "s", 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {c: F.lit(c) for c in ("score", "predicted", "leaks", "spans", "base_sha256", "n_email", "set", "label", "class_id", "_perhaps_not", "row", "features")}

    def write(name, rows, labels, benchmark):
        d = tmp_path / name
        spark.createDataFrame(rows, kind).withColumns(clash).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        return str(d)

    d = write("hard", docs, [(1, 1, 0), (5, None, None), (None, 1, 1), (4, 0, 0)], [(1, None), (2, ""), (3, "quite unlike all of these texts in every word of it")])
    got = sorted(((x.doc_id, x.n_tokens) for x in C.run(spark, d).collect()), key=str)
    assert [g[0] for g in got] == sorted([1, 1, 2, 3, None, 4, 5, 6], key=str)
    assert {g[0] for g in got if g[1] == 0} == {2, 3, 6}
    docs_now = spark.read.parquet(d + "/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs_now, d).columns == docs_now.columns
    assert C.run(spark, write("none", [], [], [])).count() == 0
    assert C.run(spark, write("bare", docs[:1], [], [])).count() == 1
