"""Small operators against rows counted by hand."""

from datetime import datetime

from pyspark.sql import functions as F

from sylva.functions import text as T
from sylva.operators import actions as A
from sylva.operators import brief as B
from sylva.operators import diff as D
from sylva.operators import library as L
from sylva.operators import scope as S
from sylva.operators import spans as P
from sylva.operators import versions as H
from sylva.schema import STYLE_DDL
from sylva.sources.corpus import nodes_of_lines

TEXT = "Head\nx | y\nsome body text that is long enough to be the body of it\nSub"


def nodes_of(spark):
    return nodes_of_lines(spark.createDataFrame([(1, TEXT), (2, "One")], "doc_id long, text string"))


def test_scopes(spark):
    rows = [(1, 0, ["1.1", "gone", "1.1", "1.2.1.1"], "body"), (1, 1, [], "heading"), (1, 2, None, "title"), (1, 3, None, "nonsense"), (1, 4, None, None), (1, 5, None, "body"), (2, 0, ["1.1"], None), (9, 0, None, "body")]
    got = S.scope(nodes_of(spark), spark.createDataFrame(rows, "doc_id long, i int, node_ids array<string>, target string"))
    by = {}
    for r in got.collect():
        by.setdefault((r.doc_id, r.i), []).append(r.node_id)
    assert {k: sorted(v) for k, v in by.items()} == {(1, 0): ["1.1", "1.2.1.1"], (1, 1): ["1.1", "1.4"], (1, 2): ["1.1"], (1, 5): ["1.3"]}
    assert S.scope(nodes_of(spark).limit(0), spark.createDataFrame(rows, "doc_id long, i int, node_ids array<string>, target string")).count() == 0


def test_edits_and_spans(spark):
    rows = [(1, "1.1", "New"), (1, "1.1", "New"), (1, "1.1", "Head"), (1, "1.1", " "), (1, "1.1", None), (1, "9", "New"), (2, "1.1", "New"), (None, "1.1", "x")]
    edits = spark.createDataFrame(rows, "doc_id long, node_id string, text string")
    assert [tuple(r) for r in S.valid_edits(nodes_of(spark), edits).collect()] == [(1, "1.1", "New")]
    spans = spark.createDataFrame([(1, "1.3", " body "), (1, "1.3", "Body"), (1, "1.1", "body"), (1, "1.3", ""), (1, "1.3", None), (7, "1.3", "body")], "doc_id long, node_id string, text string")
    assert [tuple(r) for r in S.valid_spans(nodes_of(spark), spans).collect()] == [(1, "1.3", "body")]


def test_versions_as_of(spark):
    at = lambda d: datetime(2024, 1, d)
    versions = spark.createDataFrame([(1, 0, at(2)), (1, 1, at(4)), (1, 2, at(4)), (2, 0, at(1))], "doc_id long, seq long, ts timestamp")
    asked = spark.createDataFrame([(1, at(1), "a"), (1, at(2), "b"), (1, at(3), "c"), (1, at(4), "d"), (1, at(9), "e"), (2, at(1), "f"), (3, at(5), "g"), (1, at(9), "e"), (1, None, "n")], "doc_id long, ts timestamp, who string")
    got = sorted((r.who, r.seq) for r in H.as_of(versions, asked).collect() if r.who != "n")
    assert got == [("a", None), ("b", 0), ("c", 0), ("d", 2), ("e", 2), ("e", 2), ("f", 0), ("g", None)]
    assert H.as_of(versions.limit(0), asked).where("seq is not null").count() == 0


def test_ranks_and_sides(spark):
    found = spark.createDataFrame([(1, 1, 10), (1, 2, 30), (1, 3, 30), (1, 4, 5), (2, 1, 7)], "doc_id long, section int, words long")
    got = {(r.doc_id, r.section): (r["rank"], r.quarter, r.more, r["next"], r.over) for r in B.section_ranks(found).collect()}
    assert got == {(1, 1): (3, 3, None, 2, -10.0), (1, 2): (1, 1, 20, 3, round(30 - 70 / 3, 6)), (1, 3): (1, 2, 0, 4, round(30 - 65 / 3, 6)), (1, 4): (4, 4, -25, None, -12.5), (2, 1): (1, 1, None, None, 0.0)}
    a = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], "doc_id long, node_id string")
    b = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, node_id string")
    assert sorted(map(tuple, D.only_in_one(a, b).collect())) == [(1, "b", "removed"), (2, "b", "added")]
    assert [(r.node_id, r.place) for r in A.copied(nodes_of(spark).where("doc_id = 1"), F.col("type") == "heading").orderBy("place").collect()] == [("1.1", 0), ("1.4", 1)]


def test_units(spark):
    row = spark.createDataFrame([(3.0,)], "n double").select(*[T.to_points(F.col("n"), u).alias(u) for u in T.UNITS], *[T.from_points(F.col("n") / 16, u).alias(f"{u}s") for u in T.UNITS]).first()
    assert [row[u] for u in T.UNITS] == [3 / 20, 1.5, 3 / 8, 3 / 50] and [row[f"{u}s"] for u in T.UNITS] == [4, 0, 2, 9]


def test_runs_for_export(spark):
    nodes = spark.createDataFrame([(1, "a", "one two", (None, 14.0, True, None, None, "#111111", None, None, None)), (1, "b", "x", None), (1, "c", "", None)], f"doc_id long, node_id string, content string, style {STYLE_DDL}")
    runs = P.style_phrase(nodes, P.plain_runs(nodes), F.lit("two"), bold=False, color="red")
    got = sorted((r.node_id, r.start, r.text, r.font_size, r.bold, r.italic, r.color) for r in P.resolved(nodes, runs).collect())
    assert got == [("a", 0, "one ", 14.0, True, False, "#111111"), ("a", 4, "two", 14.0, False, False, "red"), ("b", 0, "x", 11.0, False, False, None)]


def test_styles_by_name(spark):
    over = lambda **f: tuple(f.get(x) for x in ("font_family", "font_size", "bold", "italic", "underline", "color", "highlight", "alignment", "vertical_align"))
    styles = spark.createDataFrame([("Paper", "heading", over(font_size=20.0)), ("PAPER", "body", over(italic=True)), ("paper", "body", over(underline=True)), ("Other", "heading", over(color="red"))], f"name string, target string, style {STYLE_DDL}")
    asked = spark.createDataFrame([(1, "pAPER"), (1, "paper"), (2, "unknown"), (7, "paper")], "doc_id long, name string")
    nodes = nodes_of(spark)
    before = {r.node_id: r.style for r in nodes.collect()}
    for r in L.apply_named(nodes, asked, styles).collect():
        was = before[r.node_id]
        big, lined = r.doc_id == 1 and r.type == "heading", r.doc_id == 1 and r.type in ("body", "paragraph")
        assert r.style.font_size == (20.0 if big else was.font_size) and r.style.underline == (True if lined else was.underline) and r.style.italic == was.italic and r.style.color == was.color
