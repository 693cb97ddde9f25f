"""Replay from stored actions, edits out of replies, phrases and spelled-out terms on small cases."""

from pyspark.sql import functions as F

from sylva.functions import markup as M
from sylva.operators import commands as C
from sylva.operators import terms as V
from sylva.plans.replay import replay
from sylva.plans.replies import edits_of
from sylva.schema import style


def test_replay_follows_each_document(spark):
    rows = [("a", "a1", "heading", "One and two"), ("a", "a2", "body", "x and y"), ("b", "b1", "heading", "Still")]
    nodes = spark.createDataFrame(rows, "doc_id string, node_id string, type string, content string").withColumn("style", style(font_size=10.0))
    log = spark.createDataFrame(
        [("a", 2, 0, "resize", "heading", None, None, 2.0, None, None), ("a", 1, 0, "resize", "heading", None, 2.0, None, None, None),
         ("a", 3, 1, "align", None, ["a2"], None, None, None, None), ("a", 3, 0, "replace", "document", None, None, None, "and", "&"),
         ("a", 4, 0, "case", "heading", None, None, None, None, None), ("z", 1, 0, "highlight", "heading", None, None, None, None, None)],
        "doc_id string, seq int, i int, type string, target string, node_ids array<string>, scale double, delta double, find string, put string",
    )
    got = {r.node_id: (r.style.font_size, r.style.alignment, r.content) for r in replay(nodes, log).collect()}
    assert got == {"a1": (22.0, None, "ONE & TWO"), "a2": (10.0, "left", "x & y"), "b1": (10.0, None, "Still")}


def test_edits_of_cut_replies(spark):
    whole = '{"edits":[{"id":"n1","text":"one {braces} \\"quoted\\"\\n"},{ "id": "n2", "text": "two"}]}'
    cases = [(1, whole), (2, "Sure:\n```json\n" + whole[:-12]), (3, '{"edits":[{"id":"n1"},{"id":"n2","text":"t"}'), (4, "no"), (5, None), (6, "")]
    got = [(r.pass_id, r.pos, r.id, r.text) for r in edits_of(spark.createDataFrame(cases, "pass_id int, reply string")).orderBy("pass_id", "pos").collect()]
    assert got == [(1, 1, "n1", 'one {braces} "quoted"\n'), (1, 2, "n2", "two"), (2, 1, "n1", 'one {braces} "quoted"\n'), (3, 1, "n2", "t")]


def test_phrases(spark):
    cases = {
        "bold the word Midlands wherever it appears": "Midlands", 'italicise the phrase "per parcel" in the captions': "per parcel", "underline every mention of LOSO in the text": "LOSO",
        "bold the term leave one out, please": "leave one out", "make the headings bold": None, "highlight the word a b c d e f g h i": None, "": None,
    }
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", C.phrase(F.col("c")).alias("p")).collect()
    assert {r.c: r.p for r in rows} == cases


def test_terms_spelled_out(spark):
    docs = [
        (1, "We train a subject-independent classifier (SIC) on the raw signal. The SIC is compared with a feature-independent classifier (FIC). SIC beats FIC on every subject."),
        (2, "It is evaluated under subject-independent Leave-One-Subject-Out (LOSO) runs; LOSO and nothing (XYZ)."), (3, None), (4, ""),
    ]
    got = [(r.doc_id, r.said) for r in V.vocabulary(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id", "rank").collect()]
    assert got == [(1, "subject-independent classifier (SIC)"), (1, "feature-independent classifier (FIC)"), (2, "Leave-One-Subject-Out (LOSO)"), (2, "XYZ")]


def test_maths_and_emphasis(spark):
    maths = {
        "Let $x$ be $$\n y^2 $$ so.": [("text", "Let "), ("inline", "x"), ("text", " be "), ("display", "y^2"), ("text", " so.")],
        r"costs \$5 and $a_1$": [("text", r"costs \$5 and "), ("inline", "a_1")], "$ open": [("text", "$ open")], "": [], None: None,
    }
    rows = spark.createDataFrame([(t,) for t in maths], "t string").select("t", M.split_maths(F.col("t")).alias("x")).collect()
    assert {r.t: r.x if r.x is None else [tuple(p) for p in r.x] for r in rows} == maths
    runs = {
        "A **b** _c_ __d__*e*": [("A ", False, False), ("b", True, False), (" ", False, False), ("c", False, True), (" ", False, False), ("d", True, False), ("e", False, True)],
        "**a* b": [("*a", False, True), (" b", False, False)], "2 * 3": [("2 * 3", False, False)], "": [], None: None,
    }
    rows = spark.createDataFrame([(t,) for t in runs], "t string").select("t", M.emphasis_runs(F.col("t")).alias("x")).collect()
    assert {r.t: r.x if r.x is None else [tuple(p) for p in r.x] for r in rows} == runs
