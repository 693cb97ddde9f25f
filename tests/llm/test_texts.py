"""Operators on texts: the same hard cases for each, and brute force where there is one."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
LONG = "word by word the text grows long and longer still " * 3000
ROWS = [(1, "Plain words stand here."), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (6, "Ça été naïve — 漢字 😀 ß İ Σας"), (7, "Plain words stand here."), (None, "No id at all."), (1, "Plain words stand here.")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"lang": F.lit("x"), "score": F.lit(7), "spans": F.lit("clash"), "row": F.lit(1), "gram": F.lit(2), "n_tokens": F.lit("clash")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_license_base_against_brute_force(spark, docs, empty):
    from sylva.llm.license_scan import PHRASES, scan_licenses

    more = spark.createDataFrame([
        (10, "the MIT license; the mit-license, and the GNU  General\npublic LICENSE"), (11, "submit license"), (12, "licensed under the Apache License, Version 2.0"),
        (13, "CC BY 4.0 or cc-by"), (14, "Permission is hereby granted, free of charge, to any kind person obtaining a copy of this software and associated documentation files"),
        (15, "apache"), (16, " license"),
    ], "doc_id long, text string")
    for table in (docs.select("doc_id", "text"), more):
        texts = [(r.doc_id, r.text or "") for r in table.collect()]
        got = scan_licenses(table).collect()
        assert len(got) == len(texts)
        low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        expected = []
        for i, t in texts:
            w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(low))
            at = [(k, lab) for p, lab in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
            expected.append((i, len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({b for _, b in at}))))
        key = lambda r: str(r)
        assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(expected, key=key)
    by = {r.doc_id: r for r in scan_licenses(more).collect()}
    assert by[14].labels == "mit" and by[14].n_base == 0 and 0.6 <= by[14].score <= 1  # a word slipped in, two diagonals
    assert by[11].labels == "" and by[12].labels == "apache"
    assert scan_licenses(empty).count() == 0 and scan_licenses(docs).count() == len(ROWS)


def test_language(spark, docs, empty):
    from sylva.llm.langid import identify, learn_dictionaries

    english = "the cat and the dog were with the other animals in the house of the old man " * 4
    french = "le chat et le chien dans la maison avec les autres animaux du vieux monsieur " * 4
    rows = [(i, english, "en") if i % 2 else (i, french, "fr") for i in range(40)] + [(90, None, "en"), (91, french, None)]
    known = learn_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(known) == ["en", "fr"]
    got = {r.doc_id: r for r in identify(spark.createDataFrame([(1, "the dog and the cat in the house"), (2, "le chien et le chat dans la maison"), (3, "12 + 3"), (4, None), (5, "² ① Ⅷ"), (6, "² ① Ⅷ the cat")], "doc_id long, text string"), known).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6)] == ["en", "fr", "und", "und", "und", "en"] and got[3].rejected and got[4].score == 0
    out = identify(docs, known)
    assert out.count() == len(ROWS) and {r.lang_pred for r in out.where("text is null or trim(text) = ''").collect()} == {"und"}
    assert identify(empty, known).count() == 0 and learn_dictionaries(empty) == {}
    assert {r.lang_pred for r in identify(docs, {}).collect()} == {"und"}


def _library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.path(name)))
    t.no_truncation()
    t.no_padding()
    return t


FUZZ_SIGNS = list("ab cd  \n\t.,!'s're 12½²ÉéßΣσİ\x1c\x85\xa0́漢😀ABCxyz__") + ["<|endoftext|>"]


def _fuzz(n):
    r = np.random.default_rng(5)
    return ["".join(r.choice(FUZZ_SIGNS, r.integers(0, 50))) for _ in range(n)] + ["x" * 3000, "abcab" * 900, " " * 5, "a  ", "<|startoftext|>x y"]


def test_token_store_against_library(spark, docs, empty, tmp_path):
    from sylva.llm.token_store import Encoder, read_tokens, write_tokens

    path = str(P.path("byte_bpe_50k.json"))
    library = _library("byte_bpe_50k.json")
    texts = _fuzz(1500)
    texts += [t.replace(" ", s) for t in texts[:200] for s in (" \u00a0 ", " \u3000", "\u2009 ", "é à ", " é", " “", "… ")] + ["", " ", "", "x", "a b " * 200, "long" * 100 + " b"]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for few in (Encoder(path), Encoder(path, limit=50, longest=8)):  # with all pieces remembered, and with few
        for s in range(0, len(texts), 400):
            flat, n = few.encode(pa.array(texts[s : s + 400], pa.large_string()))
            assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == expected[s : s + 400]
    for plane, block in (("byte", 1000), ("bit", 37)):
        where = str(tmp_path / plane)
        write_tokens(docs, where, path, plane=plane, block=block, chunk=500)
        got = sorted(read_tokens(spark, where).collect(), key=lambda r: r.start)
        order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        start = 0
        for r, (i, t) in zip(got, order, strict=True):
            ids = library.encode(t or "", add_special_tokens=False).ids + [0]
            assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (i, start, len(ids), ids)
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
            start += len(ids)
    write_tokens(empty, str(tmp_path / "none"), path)
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_planes_round_trip():
    import zstandard

    from sylva.llm.token_store import from_planes, to_planes

    r = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = r.integers(0, 1 << int(r.integers(1, 32)), n).astype("<u4")
        for kind in ("byte", "bit"):
            planes = to_planes(ids, kind, zstandard.ZstdCompressor().compress)
            assert (from_planes(planes, n, kind, zstandard.ZstdDecompressor().decompress) == ids).all()


def test_bpe_against_library(spark, docs, empty):
    from sylva.llm.bpe import WordBpe, encode_texts

    path = str(P.path("word_bpe_49k.json"))
    bpe, library = WordBpe(path), _library("word_bpe_49k.json")
    texts = _fuzz(1500) + ["", "", " ", "é" * 500, "a\u0301 \u0301b", "x\u3000y\u2003z"]
    expected = library.encode_batch(texts, add_special_tokens=False)
    for few in (bpe, WordBpe(path, limit=50)):
        flat, n = few.encode(pa.array(texts, pa.large_string()))
        for t, got, e in zip(texts, np.split(flat, np.cumsum(n)[:-1]), expected, strict=True):
            assert got.tolist() == e.ids, t
            decoder = few.decoder(plain=False)
            assert decoder.feed(*e.ids[:3]) + decoder.feed() + decoder.feed(*e.ids[3:]) + decoder.flush() == library.decode(e.ids, skip_special_tokens=False)
    out = sorted(encode_texts(docs, path, digest=True).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    expected = sorted(((i or 0, library.encode(t or "", add_special_tokens=False).ids) for i, t in ROWS), key=lambda r: (r[0], len(r[1])))
    for r, (i, ids) in zip(out, expected, strict=True):
        assert (r.doc_id or 0, r.n_tokens, list(r.ids)) == (i, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
    small = encode_texts(docs, path, digest=True, slice_bytes=50)
    assert sorted(small.collect(), key=lambda r: (r.doc_id or 0, r.n_tokens)) == out
    assert encode_texts(empty, path).count() == 0


def test_transducer_holds_little():
    from sylva.llm.bpe import WordBpe

    bpe, library = WordBpe(str(P.path("word_bpe_49k.json"))), _library("word_bpe_49k.json")
    t = bpe.transducer
    for word in ("abcab" * 3000, "a" * 5000, "the" * 2000):
        ids: list[int] = []
        held = t.stream(iter(word), ids.append)
        assert ids == library.encode(word, add_special_tokens=False).ids and held <= 4 * t.longest + 64 < t.sufficient_lookahead
    decoder = bpe.decoder()
    ids = bpe.encode(pa.array(["naïve 漢字 text"], pa.large_string()))[0].tolist()
    assert "".join(decoder.feed(i) for i in ids) + decoder.flush() == "naïve 漢字 text"


def test_lookahead_bounds_what_is_held():
    """A merge list in which the past stays open: without the bound all positions would be held."""
    from sylva.llm.bpe import Transducer

    t = Transducer({"a": 0, "aa": 1}, [("a", "a")])
    for n in (1000, 1001):  # pairs from the left, and one over
        ids: list[int] = []
        held = t.stream(iter("a" * n), ids.append)
        assert ids == [1] * (n // 2) + [0] * (n % 2) and held <= t.sufficient_lookahead + t.longest + 64


def test_personal_data(spark, docs, empty):
    from sylva.llm.pii import PATTERNS, Tagger, _holds, base_spans, encode_chars, find_pii, fit_tagger, tag_window

    texts = [
        "Write to ann.b+c@mail.example.org or call +1 (524) 555-7373 today.", "Host 108.51.216.133 is up, 300.1.1.1 is not.", "Card 4111 1111 1111 1111, not 4111 1111 1111 1112.",
        "a@b", "é" * 70 + " x@y.example.com " + "é" * 70, "+49 170 1234567, 10.0.0.1",
    ]
    for t in texts:
        assert base_spans(t) == sorted(((m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, t) if _holds(k, m.group())), key=lambda s: (s[0], list(PATTERNS).index(s[2])))
    assert [k for *_, k in base_spans(texts[2])] == ["card"]
    r = np.random.default_rng(4)
    for _ in range(4000):  # the linear forms against the patterns themselves
        t = "".join(r.choice(list("0123456789999..@@++-- ()ab_"), r.integers(1, 60)))
        assert base_spans(t) == sorted(((m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, t) if _holds(k, m.group())), key=lambda s: (s[0], list(PATTERNS).index(s[2])))
    sample = spark.createDataFrame([(i, f"{'word ' * (i % 7)}mail user{i}@host{i}.example.com or +1 (52{i % 10}) 555-73{i % 10}3, 10.0.{i % 200}.7 {'end ' * (i % 5)}") for i in range(240)], "doc_id long, text string")
    tagger = fit_tagger(sample, sample=240)
    held = "Please ask user77x@host9.example.com for 10.9.8.7 now."
    chars = np.stack([np.pad(c := encode_chars(held), (0, 96 - len(c)))])
    agreed = (tagger.decode(chars)[0] > 0) == (tag_window(base_spans(held), 0) > 0)
    assert agreed[: len(held)].mean() > 0.9
    again = fit_tagger(sample.repartition(7), sample=240)
    assert all((again.p[k] == tagger.p[k]).all() for k in tagger.p)  # the same for every partitioning
    assert tagger.emissions(chars).shape[0] == 96
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in find_pii(table, tagger).collect()}
    for i, t in enumerate(texts):
        base = ",".join(f"{k}:{s}:{e}" for s, e, k in base_spans(t))
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(rows[i].spans.split(","))
    masked = find_pii(table, tagger, mask=True).where("doc_id = 0").first().text
    assert "[EMAIL]" in masked and "[PHONE]" in masked and "@" not in masked
    out = find_pii(docs, tagger)
    assert out.count() == len(ROWS) and out.where("spans <> ''").count() == 0 and find_pii(empty, tagger).count() == 0
    assert find_pii(table, fit_tagger(empty)).count() == len(texts)
    assert isinstance(tagger, Tagger)


def test_long_runs_take_linear_time():
    import time

    from sylva.llm.pii import base_spans

    began = time.process_time()
    for run in ("7" * 1_000_000, "a" * 1_000_000 + "@x.org", "1." * 500_000, "4 " * 500_000, "+1" + " " * 1_000_000, "a@" * 500_000, "+1 2" * 250_000, "a.b@c-d." * 120_000):
        base_spans(run)
    assert base_spans("a" * 1_000_000 + "@x.org") == [(0, 1_000_006, "email")]
    assert time.process_time() - began < 20


def test_spans_across_windows():
    from sylva.llm.pii import KINDS, reconcile

    text = "x" * 40 + "1" * 100 + "x" * 60
    phone = KINDS.index("phone")
    pieces = [(40, 96, phone, False, True), (48, 140, phone, True, False), (96, 140, phone, True, False)]
    assert reconcile(pieces, text, []) == [(40, 140, "phone")]
    assert reconcile(pieces[:1], text, []) == [] and reconcile(pieces[1:], text, []) == []
    assert reconcile([(40, 140, phone, False, False)], text, [(50, 60, "card")]) == []


def test_tagger_gradient():
    from sylva.llm.pii import TAGS, Tagger

    r = np.random.default_rng(2)
    t = Tagger(hidden=3)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    chars, tags = r.integers(1, 20, (2, 6)), r.integers(0, TAGS, (2, 6))
    _, g = t.loss_and_gradient(chars, tags)
    for name in t.p:
        flat, at = t.p[name].reshape(-1), int(r.integers(0, t.p[name].size))
        old, losses = flat[at], []
        for d in (1e-3, -1e-3):
            flat[at] = old + d
            losses.append(t.loss_and_gradient(chars, tags)[0])
        flat[at] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - g[name].reshape(-1)[at]) < 1e-3, name


def test_toxicity(spark, docs, empty):
    from sylva.llm.toxicity import VOTERS, fit, label_model, score

    calm = "people walk along the river and talk about the weather of the day"
    rows = [(i, f"{calm} you are a {'stupid idiot and a loser' if i % 3 == 0 else 'good friend and a helper'} number {i}") for i in range(300)] + [(900, None), (901, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 240)] + [(None, 1), (5000, None), (3, 1)], "doc_id long, toxic int")
    model = fit(table, labels)
    got = {r.doc_id: r for r in score(table, model).collect()}
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(240, 300))
    assert got[900].predicted == got[901].predicted == 0 and 0 <= got[901].score <= 1
    assert score(docs, model).count() == len(ROWS) and score(empty, model).count() == 0
    assert {r.predicted for r in score(docs, fit(empty.select("doc_id", "text"), labels.limit(0))).collect()} == {0}
    # two voters that always agree count as little more than one
    both = [(3, -1, 100.0), (0, -1, 900.0), (3, 1, 30.0), (0, 0, 200.0), (4, 1, 10.0), (4, -1, 20.0)]
    rate, correlation, prior, posterior = label_model(both, 0.1)
    assert rate.shape == (2, len(VOTERS)) and correlation[0, 1] > 0.9 and posterior[3] > posterior[0] and 0 < prior < 0.5


def test_dictionaries_of_short_long_and_copied_texts(spark):
    from sylva.llm.langid import Classifier, learn_dictionaries

    short = [(f"hus bil vei fjord nummer {'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]} ligger ved sjoen", "no") for i in range(40)]
    long = [("the same opening " * 100 + f"casa perro gato {'xyzw'[i % 4]} montana " * 60, "es") for i in range(4)]
    copied = [(f"different text {'abcdefghij'[i % 10]}{'kl'[i // 10]}", "en") for i in range(20)] * 500
    got = learn_dictionaries(spark.createDataFrame(short + long + copied + [("12 34", "zz")], "text string, lang string"))
    assert sorted(got) == ["en", "es", "no"] and b"casa perro gato" in got["es"]
    assert len(got["en"].split(b"\n")) == 20
    assert Classifier(got, 5, 4096).classify("bil ligger ved sjoen og vei fjord nummer")[0] == "no"


def test_language_against_a_plain_loop(spark):
    """Predictions are those of compressing every block with every dictionary, ties going to the first name."""
    import random

    import zstandard

    from sylva.llm.langid import UNKNOWN, evenly, identify

    rng = random.Random(8)
    syllables = {"aa": "ka lo mi ne", "bb": "tre zan vol qui", "cc": "ka lo mi ne"}  # the first and the last are alike
    dictionaries = {lang: " ".join(rng.choice(s.split()) * rng.randrange(1, 3) for _ in range(800)).encode() for lang, s in syllables.items()}
    dictionaries["cc"] = dictionaries["aa"]
    texts = [" ".join(rng.choice(syllables[rng.choice("ab") * 2].split()) for _ in range(rng.choice([1, 3, 40, 3000]))) for _ in range(60)] + ["", None, "12 ... 34", "Ka-LO!! mi"]
    got = {r.i: (r.lang_pred, r.score, r.rejected) for r in identify(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), dictionaries).collect()}
    for i, text in enumerate(texts):
        low = re.sub(r"[\W\d_]+", " ", (text or "").lower())
        if not re.search(r"[^\W\d_]", low):
            assert got[i] == (UNKNOWN, 0.0, True)
            continue
        raw, sizes = low.encode(), []
        for lang in sorted(dictionaries):
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append((sum(len(zstandard.ZstdCompressor(level=5, dict_data=d, write_content_size=False).compress(raw[s : s + 4096])) for s in range(0, len(raw), 4096)), lang))
        best, second = sorted(sizes)[:2]
        assert got[i][0] == best[1] and abs(got[i][1] - (1 - best[0] / second[0])) < 1e-12 and got[i][2] == (1 - best[0] / second[0] < 0.02), text
    assert {g[0] for g in got.values()} >= {"aa", "bb", UNKNOWN} and "cc" not in {g[0] for g in got.values()}
    assert evenly(["a" * 10, "b"], 100) == ["a" * 10, "b"] and evenly([], 5) == []
    cut = evenly(["a" * 100, "é" * 100, "c"], 60)
    assert cut[2] == "c" and len(cut[0]) == 28 and cut[1] == "é" * 13 or cut[1] == "é" * 14
    assert sum(len(t.encode()) + 1 for t in cut) <= 60


def test_every_word_goes_through_the_transducer():
    import public_tokenizers

    from sylva.llm.bpe import WordBpe

    bpe = WordBpe(str(public_tokenizers.path("word_bpe_49k.json")))
    seen, stream = [], bpe.transducer.stream
    bpe.transducer.stream = lambda word, emit: (seen.append(word), stream(word, emit))[1]
    words = ["the", "and", "transducer", "x", "zzyzx"]
    bpe.encode(pa.array([" ".join(words)], pa.large_string()))
    assert sorted(seen) == sorted(words)


def brute_licenses(text, k=3, drift=3, coverage=0.6):
    """All matches of k words, gathered by diagonal; neighbouring diagonals whose places follow each other are one run."""
    from sylva.llm.license_scan import TEMPLATES

    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    words, labels, best = split(text or ""), set(), 0.0
    for label, notice in TEMPLATES:
        notice = split(notice)
        diagonals = {}
        for p in range(len(words) - k + 1):
            for q in range(len(notice) - k + 1):
                if words[p : p + k] == notice[q : q + k]:
                    diagonals.setdefault(p - q, []).append((p, q))
        run, last = [], None
        runs = []
        for d, hits in sorted(diagonals.items(), key=lambda x: (min(x[1])[0], x[0])):
            first = min(hits)[0]
            if last is not None and (abs(d - last[0]) > drift or first - last[1] > drift + k):
                runs.append(run)
                run = []
            run = run + hits
            last = (d, max(hits)[0])
        for hits in [*runs, run] if run else []:
            share = len({q + j for _, q in hits for j in range(k)}) / len(notice)
            if share >= coverage:
                labels.add(label)
                best = max(best, share)
    return labels, best


def test_licenses_against_all_diagonals(spark):
    import random

    from sylva.llm.license_scan import PHRASES, TEMPLATES, scan_licenses

    rng = random.Random(12)
    texts = []
    for i in range(160):
        words = [rng.choice("lorem ipsum dolor sit amet the software of".split()) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            notice = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                spot = rng.randrange(len(notice))
                notice[spot : spot + 1] = rng.choice([[], ["other"], [notice[spot], "new", "words"]])
            if rng.random() < 0.3:
                notice = notice[: max(3, len(notice) * 2 // 3)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        texts.append(" ".join(words).upper() if i % 7 == 0 else " ".join(words))
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    alone = 0
    for i, text in enumerate(texts):
        labels, best = brute_licenses(text)
        base = set(got[i].base_labels.split(",")) - {""}
        assert set(got[i].labels.split(",")) - {""} == labels | base, text
        assert abs(got[i].score - (1.0 if base else best)) < 1e-12
        alone += bool(labels - base)
    assert alone > 20 and set(PHRASES.values()) < {label for label, _ in TEMPLATES}
