"""Runs of words against a character-by-character account."""

import random

from pyspark.sql import functions as F

from sylva.operators import spans as S
from sylva.schema import STYLE_DDL

NODES = "doc_id long, node_id string, content string"


def marks(text, needle):
    """The characters that a search from left to right covers, whatever the case."""
    low, sought, at, out = text.lower(), (needle or "").strip().lower(), 0, set()
    while sought and (at := low.find(sought, at)) >= 0:
        out |= set(range(at, at + len(sought)))
        at += len(sought)
    return out


def runs_of(text, styles):
    out = []
    for i in range(len(text)):
        if out and out[-1][2] == styles[i]:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1, styles[i]])
    return [tuple(r) for r in out]


def test_phrases_one_after_the_other(spark):
    rng = random.Random(3)
    texts = ["", "abab aba", "The results of the Results, THE RESULTS", "a.b*c \\E a.b", "ééAé é", "no such words", None]
    texts += ["".join(rng.choice("ab cA.") for _ in range(rng.randrange(40))) for _ in range(80)]
    nodes = spark.createDataFrame([(i % 7, f"n{i}", t) for i, t in enumerate(texts)], NODES)
    steps = [("aba", {"bold": True}), (" b", {"color": "#111111"}), ("a.B", {"bold": False, "italic": True}), ("results", {"underline": True}), ("\\E", {"bold": True}), ("", {"bold": True}), ("é", {"italic": True})]
    runs, want = S.plain_runs(nodes), {f"n{i}": [{} for _ in t] for i, t in enumerate(texts) if t}
    for needle, patch in steps:
        runs = S.style_phrase(nodes, runs, F.lit(needle), **patch)
        for i, t in enumerate(texts):
            for k in marks(t or "", needle):
                want[f"n{i}"][k] = want[f"n{i}"][k] | patch
    got = {}
    for r in runs.collect():
        style = {k: v for k, v in r.style.asDict().items() if v is not None} if r.style else {}
        got.setdefault(r.node_id, []).append((r.start, r.end, style))
    assert {k: sorted(v, key=lambda r: r[0]) for k, v in got.items()} == {f"n{i}": runs_of(t, want[f"n{i}"]) for i, t in enumerate(texts) if t}


def test_described_spans_and_whole_nodes(spark):
    nodes = spark.createDataFrame([(1, "a", "one two one"), (1, "b", "one two"), (2, "a", "two"), (2, "c", "")], NODES)
    asked = spark.createDataFrame([(1, "a", "one"), (1, "a", "one t"), (1, "a", "gone"), (2, "a", " TWO "), (9, "a", "one"), (2, "c", "x"), (1, "a", "one"), (1, "b", None)], "doc_id long, node_id string, text string")
    runs = S.style_spans(nodes, S.plain_runs(nodes), asked, bold=True)
    show = lambda rows: sorted((r.doc_id, r.node_id, r.start, r.end, r.style and r.style.bold, r.style and r.style.color) for r in rows.collect())
    assert show(runs) == [(1, "a", 0, 5, True, None), (1, "a", 5, 8, None, None), (1, "a", 8, 11, True, None), (1, "b", 0, 7, None, None), (2, "a", 0, 3, True, None)]
    red = S.style_phrase(nodes, runs, F.lit("two"), color="red")
    assert ((1, "a", 4, 5, True, "red") in show(red)) and ((1, "a", 5, 7, None, "red") in show(red))
    cleared = S.format_nodes(red, nodes.where("node_id = 'a'"), "bold")
    assert show(cleared) == [(1, "a", 0, 4, None, None), (1, "a", 4, 7, None, "red"), (1, "a", 7, 11, None, None), (1, "b", 0, 4, None, None), (1, "b", 4, 7, None, "red"), (2, "a", 0, 3, None, "red")]


def test_stale_runs_are_dropped(spark):
    nodes = spark.createDataFrame([(1, "a", "one two"), (1, "b", "one two"), (1, "c", "new")], NODES)
    runs = S.with_text(nodes, S.style_phrase(nodes, S.plain_runs(nodes), F.lit("two"), bold=True))
    later = spark.createDataFrame([(1, "a", "one two"), (1, "b", "one TWO"), (1, "c", "newer")], NODES)
    got = sorted((r.node_id, r.start, r.end, bool(r.style and r.style.bold)) for r in S.current_runs(later, runs).collect())
    assert got == [("a", 0, 4, False), ("a", 4, 7, True), ("b", 0, 7, False), ("c", 0, 5, False)]
    none = spark.createDataFrame([], f"doc_id long, node_id string, start int, end int, style {STYLE_DDL}")
    assert S.overlay(none, S.matches(nodes, F.lit("two")), bold=True).count() == 0 and S.joined(none).count() == 0


def test_runs_are_read_once(spark):
    """A sweep reads the runs once for both their ends, so that sweeps after one another do not double what came before."""
    read = spark.sparkContext.accumulator(0)

    def counted(start):
        read.add(1)
        return start

    nodes = spark.createDataFrame([(1, f"n{k}", "one two one") for k in range(20)], NODES)
    runs = S.plain_runs(nodes).withColumn("start", F.udf(counted, "int")("start"))
    assert S.style_phrase(nodes, runs, F.lit("two"), bold=True).count() == 60 and read.value == 20
