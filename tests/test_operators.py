"""Operators on small documents whose results can be read off."""

import difflib
import re
import time

import pytest
from pyspark.sql import functions as F

from sylva import queries as core
from sylva import queries_rest  # noqa: F401  registers snk_snapshot
from sylva.functions import text as T
from sylva.operators import actions as A
from sylva.operators import brief as B
from sylva.operators import commands as C
from sylva.operators import diff as D
from sylva.operators import scope as S
from sylva.operators import spec as P
from sylva.operators import terms as V
from sylva.operators import versions as H
from sylva.schema import HEADINGS, META_DDL, STYLE_DDL, is_type
from sylva.sources.corpus import nodes_of_lines, tops_of_lines
from sylva.streaming import hub

DDL = f"doc_id long, node_id string, parent_id string, type string, sort_path array<int>, depth int, content string, style {STYLE_DDL}, meta {META_DDL}"
STYLE0 = {"font_family": None, "font_size": None, "bold": None, "italic": None, "underline": None, "color": None, "highlight": None, "alignment": None, "vertical_align": None}
META0 = {"header_row": None, "list_kind": None, "list_level": None, "line_spacing": None, "space_before_pt": None, "space_after_pt": None, "borders": None, "page_index": None, "role": None}


def make(spark, items, doc=1):
    """items: (type, content) or (type, content, style) at the top level; a table's content is a list of rows of cells,
    the first of which is its header row."""
    rows = []
    for i, item in enumerate(items, 1):
        kind, content, style = (*item, {})[:3]
        rows.append((doc, f"{doc}.{i}", str(doc), kind, [i], 1, "" if kind == "table" else content, {**STYLE0, **style}, META0))
        if kind == "table":
            for r, cells in enumerate(content, 1):
                rows.append((doc, f"{doc}.{i}.{r}", f"{doc}.{i}", "table_row", [i, r], 2, "", STYLE0, {**META0, "header_row": r == 1 or None}))
                rows += [(doc, f"{doc}.{i}.{r}.{c}", f"{doc}.{i}.{r}", "table_cell", [i, r, c], 3, x, STYLE0, META0) for c, x in enumerate(cells, 1)]
    return spark.createDataFrame(rows, DDL)


PAPER = [
    ("body", "A Lightweight Classifier for Joint Fall Detection", {"bold": True, "font_size": 12.0}),
    ("body", "Abstract— the study reports 96.1 per cent accuracy.", {"font_size": 10.0}),
    ("heading", "I. Introduction", {"font_size": 12.0}),
    ("body", "Falls are a major cause of injury among older adults.", {"font_size": 10.0}),
    ("body", "The contributions are: a benchmark; a feature set; and a protocol.", {"font_size": 10.0}),
    ("subheading", "A. Scope", {"font_size": 11.0}),
    ("body", "The scope is limited to wrist-worn sensors.", {"font_size": 10.0}),
    ("horizontal_rule", ""),
    ("table", [["Component", "Configuration"], ["MLP dropout", "0.3"], ["Optimizer", "Adam"]]),
    ("caption", "Table 1. Model configuration."), ("caption", "Figure 2: Accuracy against volume."),
    ("body", r"Unit cost is $C = \frac{F + vQ}{Q}$ per parcel [1], [2].", {"font_size": 10.0}),
    ("heading", "V. References", {"font_size": 12.0}),
    ("reference", "[1] Office for Statistics, London, 2025."), ("reference", "[2] Department for Transport, 2024."),
]


@pytest.fixture(scope="module")
def paper(spark):
    return make(spark, PAPER).cache()


def texts(nodes, where="depth = 1"):
    return [r.content for r in nodes.where(where).orderBy("doc_id", "sort_path").collect()]


def sizes(nodes, kind):
    return [r.s for r in nodes.where(F.col("type") == kind).orderBy("sort_path").select(F.col("style.font_size").alias("s")).collect()]


def test_resize(paper):
    heading = F.col("type") == "heading"
    assert sizes(A.resize(paper, heading, size=2.0), "heading") == [14.0, 14.0]
    assert sizes(A.resize(paper, heading, delta=-2.0), "heading") == [10.0, 10.0]
    assert sizes(A.resize(paper, F.col("type") == "subheading", scale=1.25), "subheading") == [13.8]
    assert sizes(A.resize(paper, F.col("type") == "reference", size=9.0), "reference") == [9.0, 9.0]
    assert sizes(A.resize(paper, heading, scale=100.0), "heading") == [96.0, 96.0]


def test_unset_is_not_false(paper):
    out = A.format_nodes(paper, F.col("type") == "heading", bold=False)
    assert [r.b for r in out.where("type = 'heading'").select(F.col("style.bold").alias("b")).collect()] == [False, False]
    assert out.where("type = 'caption' and style.bold is null").count() == 2


def test_borders():
    assert A.border_widths(["upper", "lower"], heavy=True) == {"top": 1.5, "bottom": 1.5, "left": 0.0, "right": 0.0, "inside_h": 0.0, "inside_v": 0.0, "header": 0.0}
    assert A.border_widths(None, off=True) == dict.fromkeys(A.SIDES, 0.0) and A.border_widths(["header"])["header"] == 0.5
    assert A.border_widths({"top": 2.0, "upper": 3.0, "inside_h": 0.25})["top"] == 2.0 and A.border_widths({"upper": 3.0})["top"] == 0.5
    assert A.border_widths(["outside"])["left"] == 0.5 and A.border_widths(["outside"])["inside_v"] == 0.0


def test_case(spark, paper):
    assert texts(A.change_case(paper, F.col("type") == "caption", "sentence"), "type = 'caption'") == ["Table 1. Model configuration.", "Figure 2: accuracy against volume."]
    frame = spark.createDataFrame([("the results of MobiAct and LOSO. is it? yes! 3 ways. ß",)], "t string")
    row = frame.select(T.sentence_case(F.col("t")).alias("s"), T.title_case(F.col("t")).alias("u")).first()
    assert row.s == "The results of mobiact and LOSO. Is it? Yes! 3 ways. SS" and row.u.startswith("The Results Of Mobiact And LOSO.")


def test_lists(paper, spark):
    out = A.make_list(paper, F.lit(True))
    items = [(r.content, r.k) for r in out.where("depth = 1").orderBy("sort_path").select("content", F.col("meta.list_kind").alias("k")).collect()]
    assert items[4:8] == [("The contributions are:", None), ("A benchmark", "bullet"), ("A feature set", "bullet"), ("And a protocol.", "bullet")]
    assert sum(k == "bullet" for _, k in items) == 3  # only what enumerates
    cut = {
        "The contributions are: (i) a benchmark; (ii) a feature set; and (iii) a protocol.": ("The contributions are:", ["A benchmark", "A feature set", "A protocol."]),
        "We do three things. 1. Propose. 2. Release. 3. Evaluate.": ("We do three things.", ["Propose.", "Release.", "Evaluate."]),
        "We make three contributions: a benchmark; a feature set; a protocol.": ("We make three contributions:", ["A benchmark", "A feature set", "A protocol."]),
        "This paper (see Section 2) presents a study of falls.": ("", []), "Figure 1 shows the results.": ("", []), "": ("", []),
    }
    for r in spark.createDataFrame([(t,) for t in cut], "content string").select("content", A.split_items(F.col("content")).alias("x")).collect():
        assert (r.x.lead, list(r.x["items"])) == cut[r.content]
    plain = make(spark, [("body", "The aims are:"), ("body", "One."), ("body", "Two.")])
    got = [r.k for r in A.make_list(plain, F.lit(True), "number").orderBy("sort_path").select(F.col("meta.list_kind").alias("k")).collect()]
    assert got == [None, "number", "number"]
    assert [r.sort_path for r in out.where("type = 'table_cell'").orderBy("sort_path").limit(1).collect()] == [[12, 1, 1]]


def test_structure(paper, spark):
    assert texts(A.delete(paper, F.col("type") == "table"), "depth > 1") == []
    assert texts(A.replace(paper, F.lit(True), "Adam", "SGD"), "type = 'table_cell'")[-1] == "SGD"
    merged = A.merge(paper, F.col("type") == "reference")
    assert texts(merged, "type = 'reference'") == [PAPER[13][1] + " " + PAPER[14][1]]
    cut = A.split(make(spark, [("body", "One. Two. . Three"), ("body", "whole")]), F.lit(True))
    assert texts(cut) == ["One", "Two", "Three", "whole"]
    new = A.insert(paper, paper.where("type = 'heading'"), "body", "New.", "e1")
    assert texts(new)[3] == "New." and new.select("node_id").distinct().count() == new.count()
    again = A.insert(paper, paper.where("type = 'heading'"), "body", "New.", "e1")
    assert sorted(r.node_id for r in new.collect()) == sorted(r.node_id for r in again.collect())  # a replay gives the same ids
    assert texts(A.paste(paper, paper.where("type = 'caption'")))[-2:] == [PAPER[9][1], PAPER[10][1]]
    assert texts(A.move_to_end(paper, F.col("type") == "table"))[-1] == "" and A.move_to_end(paper, F.col("type") == "table").where("sort_path[0] = 15").count() == 10
    assert texts(A.rewrite(paper, spark.createDataFrame([(1, "1.4", "Short."), (1, "1.5", " "), (1, "9.9", "x")], "doc_id long, node_id string, text string")))[3:5] == ["Short.", PAPER[4][1]]
    one = make(spark, [("body", "only")])
    assert texts(A.merge(one, F.lit(True))) == ["only"]


def test_scopes(paper):
    assert [r.content for r in S.resolve(paper, "table_header").orderBy("sort_path").collect()] == ["Component", "Configuration"]
    assert S.titles(paper).first().content == PAPER[0][1]
    under = S.sections_of(paper, paper.where("node_id = '1.3'"))
    assert texts(under) == [PAPER[3][1], PAPER[4][1]]
    assert S.with_descendants(paper, paper.where("type = 'table'")).count() == 6
    assert {r.table_id for r in S.tables_of(paper).collect()} == {"1.9"}
    assert S.resolve(paper, "nothing").count() == 0
    assert texts(S.introduces_list(paper.where("depth = 1"))) == []


def test_brief(paper):
    row = B.brief(paper).first()
    assert row.kind == "research paper" and row.headings == 2 and row.tables == 1 and row.references == 2
    assert row.heading_numbering == "roman numerals (I., II., III.)" and row.citation_style == "numbered, [n]"
    got = {r.heading: r for r in B.sections(paper).collect()}
    assert set(got) == {"I. Introduction", "A. Scope", "V. References"}
    assert got["A. Scope"].holds == {"paragraphs": 2, "tables": 1, "captions": 2, "maths": 1} and got["A. Scope"].level == 2
    assert {r.type for r in B.maths_in(paper).collect()} == {"body"}


def test_diff(spark):
    before = make(spark, [("body", "We used a rigorous approach."), ("body", "Dropped later.")])
    after = make(spark, [("body", "We used a careful approach.")]).unionByName(make(spark, [("body", "x"), ("body", "y"), ("body", "Brand new.")]).where("node_id = '1.3'"))
    row = D.summary(D.compare(before, after)).first().asDict()
    assert row == {"doc_id": 1, "added": 1, "removed": 1, "changed": 1, "text_changed": 1, "style_changed": 0, "words_added": 1, "words_removed": 1}
    long = " ".join(f"word{k}" for k in range(3000))
    row = D.summary(D.compare(make(spark, [("body", long)]), make(spark, [("body", long.replace("word2500 ", "other more ") + " edited")]))).first()
    assert (row.words_added, row.words_removed) == (3, 1)  # far behind what segments show of a text
    pairs = [("the quick brown fox", "the slow brown fox"), ("", "new"), ("same", "same"), ("a  b\tc", "a b c d")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    for r in frame.select("a", "b", D.word_segments("a", "b").alias("s")).collect():
        assert "".join(s.text for s in r.s if s.op != "insert") == r.a and "".join(s.text for s in r.s if s.op != "delete") == r.b
        x, y = re.findall(r"\s+|\S+", r.a), re.findall(r"\s+|\S+", r.b)
        kept = sum(n for *_, n in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        assert kept == sum(len(re.findall(r"\s+|\S+", s.text)) for s in r.s if s.op == "equal")
    assert [s.op for s in frame.select(D.word_segments("a", "b").alias("s")).first().s] == ["equal", "delete", "insert", "equal"]


def test_versions(spark):
    log = spark.createDataFrame([(1, f"2024-01-01 00:00:{i:02}", i, f"edit {i}") for i in range(13)], "doc_id long, ts string, order long, label string").withColumn("ts", F.to_timestamp("ts"))
    v = H.from_log(log)
    base = {r.seq: (r.base, r.batches) for r in H.replay_base(v).collect()}
    assert base[7] == (0, 7) and base[10] == (10, 0) and base[12] == (10, 2)
    at = H.undo(H.pointers(v))
    assert at.first()[1:] == (11, 12) and H.redo(at).first()[1:] == (12, None) and H.undo(H.undo(at)).first()[1:] == (9, 10)
    assert H.redo(H.redo(at)).first().current == 12 and H.rewind(at, 3).first().current == 3
    last = H.restore(v, 3, F.current_timestamp()).orderBy(F.desc("seq")).first()
    assert last.seq == 13 and last.is_checkpoint and last.label == "restore→3"
    first = H.undo(H.undo(H.pointers(H.from_log(log.limit(1))))).first()
    assert first.current == 0 and first.redo is None


def test_replay_is_direct(paper):
    batches = [[lambda x: A.resize(x, is_type(HEADINGS), delta=1.0)], [lambda x: A.highlight(x, F.lit(True))], [lambda x: A.normalise(x, F.lit(True))]]
    direct = A.normalise(A.highlight(A.resize(paper, is_type(HEADINGS), delta=1.0), F.lit(True)), F.lit(True))
    assert D.compare(H.materialise(paper, batches), direct).count() == 0
    assert D.compare(paper, A.format_nodes(paper, F.lit(False), bold=True)).count() == 0


def test_terms(spark):
    docs = [
        (1, "We train a subject-independent classifier (SIC) on the raw signal. The SIC is compared with a feature-independent classifier (FIC). SIC beats FIC on every subject."),
        (2, "One mention of XYZ."), (3, "THE AND PDF IEEE THE AND PDF IEEE"), (4, "MobiAct and MobiAct, ÜSE ÜSE"), (5, None), (6, ""),
    ]
    got = {}
    for r in V.document_terms(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id", "rank").collect():
        got.setdefault(r.doc_id, []).append(r.term)
    assert got == {1: ["SIC", "FIC"], 4: ["MobiAct"]}


def test_locate(spark):
    sections = spark.createDataFrame(
        [(d, i, h, a) for d in range(1, 7) for i, (h, a) in enumerate([("I. INTRODUCTION", "motivates automated fall detection"), ("III. RESULTS", "reports 89.01% accuracy on held-out subjects"), ("II. METHOD", "describes feature extraction per bin")], 1)],
        "doc_id long, section int, heading string, about string",
    )
    commands = spark.createDataFrame(
        [(1, "Make the section that reports the accuracy bold"), (2, "tighten the section on feature extraction"), (3, "make every heading bold"), (4, "convert all latex equations"), (5, "the section"), (6, "make the results bold")],
        "doc_id long, command string",
    )
    assert {r.doc_id: r.section for r in V.locate(sections, commands).collect()} == {1: 2, 2: 3, 6: 2}


def test_commands(spark):
    rows = ["undo", "Undo.", "undo it", "rewind to version 4", "compare versions 2 and 9", "centre the table 1 caption", "make the headings in the table bold", "the green transition", "not bold", "line spacing of 1.15"]
    frame = spark.createDataFrame([(r,) for r in rows], "c string")
    c = F.col("c")
    got = frame.select(C.control(c).alias("k"), C.target(c).alias("t"), C.alignment(c).alias("a"), C.color(c).alias("o"), C.emphasis(c).alias("e"), C.line_spacing(c).alias("l")).collect()
    assert [r.k.op for r in got[:5]] == ["undo", "undo", None, "rewind", "compare"] and got[4].k.b == 9 and got[3].k.a == 4
    assert got[5].t == "caption" and got[5].a == "center" and got[6].t == "table_header" and got[7].o is None and got[8].e.bold is False and got[9].l == 1.15


def test_numbers(spark):
    frame = spark.createDataFrame([(n,) for n in (0, 1, 2, 4, 9, 14, 27, 52, 53, 702, 1994)], "n long")
    got = {r.n: (r.r, r.a) for r in frame.select("n", T.roman(F.col("n")).alias("r"), T.alpha(F.col("n")).alias("a")).collect()}
    assert [got[n][0] for n in (0, 1, 4, 9, 14, 1994)] == ["", "I", "IV", "IX", "XIV", "MCMXCIV"]
    assert [got[n][1] for n in (0, 1, 2, 27, 52, 53, 702)] == ["", "A", "B", "AA", "AZ", "BA", "ZZ"]
    levels = spark.createDataFrame([(1, i, l) for i, l in enumerate([1, 2, 3, 3, 2, 1, 3, 9])], "doc_id long, pos int, level int")
    labels = [r.x for r in P.heading_numbers(levels).orderBy("pos").select(P.heading_label("decimal").alias("x")).collect()]
    assert labels == ["1. ", "1.1 ", "1.1.1 ", "1.1.2 ", "1.2 ", "2. ", "2.0.1 ", "2.0.2 "]


def test_charts(spark):
    frame = spark.createDataFrame([(["a", "b", "c"], [1.0, 2.0]), ([], [1.0, 2.0]), (["a"], [1.0]), (["1", "2"], [5.0, 6.0]), ([], [])], "l array<string>, v array<double>")
    got = frame.select(P.fit_chart(F.col("l"), F.col("v")).alias("f"), P.safe_chart(F.col("l"), F.col("v")).alias("s"), P.scatter_x(F.array().cast("array<double>"), F.col("l"), F.col("v")).alias("x")).collect()
    assert [r.f and list(r.f.labels) for r in got] == [["a", "b"], ["Item 1", "Item 2"], None, ["1", "2"], None]
    assert [list(r.s.labels) for r in got] == [["a", "b"], ["Item 1", "Item 2"], ["a"], ["1", "2"], []] and list(got[4].s["values"]) == [1.0, 2.0, 3.0]
    assert [list(r.x) for r in got[:4]] == [[0.0, 1.0], [0.0, 1.0], [0.0], [1.0, 2.0]]


def test_lines(spark):
    nodes = nodes_of_lines(spark.createDataFrame([(1, "Head\n\na | b | c\nx"), (2, None), (3, "")], "doc_id long, text string"))
    assert [(r.type, r.content) for r in nodes.where("doc_id = 1").orderBy("sort_path").collect()] == [("heading", "Head"), ("page_break", ""), ("table", ""), ("table_row", ""), ("table_cell", "a"), ("table_cell", "b"), ("table_cell", "c"), ("heading", "x")]
    assert nodes.where("doc_id = 2").count() == 0 and nodes.where("doc_id = 3").count() == 1


def test_stream(spark, tmp_path):
    rows = [(i % 3, f"2024-01-01 00:{i:02}:00", i, "edit" if i % 2 else "view") for i in range(60)]
    events = spark.createDataFrame(rows, "doc_id long, ts string, order long, event string").withColumn("ts", F.to_timestamp("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = hub.event_stream(spark, str(tmp_path / "in"), events.schema)
    q = hub.command_log(stream, str(tmp_path / "log"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 60
    c = hub.counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    c.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, hub.counts(events).collect()))
    late = hub.replay_buffer(events, spark.createDataFrame([(0, "2024-01-01 00:30:00")], "doc_id long, joined string").withColumn("joined", F.to_timestamp("joined")))
    assert [r.order for r in late.orderBy("n").collect()] == [30]


def test_corpus(spark, tmp_path):
    from sylva.corpus import Corpus

    corpus = Corpus.of_texts(spark.createDataFrame([(1, "Head\nA longer line of ordinary text that is a body."), (2, "Other head")], "doc_id long, text string"))
    bold = corpus.run(lambda n: A.format_nodes(n, is_type(HEADINGS), italic=True), label="italic headings")
    assert corpus.diff(bold).count() == 2 and bold.undo().diff(corpus).count() == 0 and bold.undo().redo() is bold and corpus.undo() is corpus
    many = corpus
    for i in range(12):
        many = many.run(lambda n: A.resize(n, F.lit(True), delta=1.0), label=f"step {i}", checkpoint=str(tmp_path / "log"))
    assert len(many.batches) == 2 and [v for v, _, c in many.history() if c] == [0, 10]
    direct = A.resize(corpus.nodes, F.lit(True), delta=12.0)
    assert D.compare(many.nodes, direct).count() == 0
    many.views("c_")
    assert spark.sql("select count(*) from c_nodes where path = '1'").first()[0] == 2 and many.brief().count() == 2


def test_children_of_any_node_stay(spark):
    """A moved, pasted-over or inserted-behind node keeps what lies below it, table or not."""
    from sylva.operators import actions as A
    from sylva.sources.corpus import nodes

    n = nodes(spark, "/root/testdata/sf0.001").where("doc_id < 3 and depth = 1 and sort_path[0] <= 4 and type <> 'table'")
    child = n.where("sort_path[0] = 2").withColumns({"depth": F.lit(2).cast(n.schema["depth"].dataType), "sort_path": F.array(F.lit(2), F.lit(1)).cast(n.schema["sort_path"].dataType), "node_id": F.concat("node_id", F.lit("c"))})
    both = n.unionByName(child)
    assert child.count() > 0
    ids = {r.node_id for r in both.collect()}
    moved = A.move_to_end(both, F.col("sort_path")[0] == 2)
    assert {r.node_id for r in moved.collect()} == ids
    tops = {(r.doc_id, r.sort_path[0]) for r in moved.where("depth = 1").collect()}
    assert all((r.doc_id, r.sort_path[0]) in tops and r.sort_path[0] == max(k for d, k in tops if d == r.doc_id) for r in moved.where("depth = 2").collect())


def test_runs_of_many_words(spark):
    """The work is in proportion to the words: 30,000 of them that are never alike took minutes."""
    words = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(F.when(i % 5 == 0, "").otherwise(i.cast("string")).alias("text"), (F.floor(i / 2) % 2 == 0).alias("bold")))
    began = time.time()
    rows = spark.createDataFrame([(0,), (3,), (30000,)], "n int").select(P.merged_runs(F.when(F.col("n") > 0, words).otherwise(F.slice(words, 1, 0))).alias("r")).collect()
    assert time.time() - began < 30
    assert rows[0].r == [] and [(x.text, x.bold) for x in rows[1].r] == [("1", True), ("23", False)]
    want = [(str(i), i // 2 % 2 == 0) for i in range(1, 30001) if i % 5]
    assert "".join(x.text for x in rows[2].r) == "".join(t for t, _ in want) and len(rows[2].r) == 1 + sum(a[1] != b[1] for a, b in zip(want, want[1:]))


def test_only_the_words_of_a_command_leave_their_section(spark):
    """Words of sections that a command does not name are neither dealt out nor joined."""
    sections = spark.createDataFrame([(1, 1, "Alpha", "beta gamma"), (1, 2, "Delta", "beta alpha"), (2, 1, "Alpha", None)], "doc_id long, section int, heading string, about string")
    commands = spark.createDataFrame([(1, "shorten the section on gamma alpha"), (2, "the part on omega")], "doc_id long, command string")
    got = V.locate(sections, commands)
    assert [tuple(r) for r in got.collect()] == [(1, 1, 4.0)]
    assert not re.search(r"hashpartitioning\([^)]*word", got._jdf.queryExecution().executedPlan().toString())


def test_snapshots_are_packed_in_small_batches(spark, tmp_path):
    """A Python worker holds a bounded number of whole texts at a time."""
    spark.range(10).select(F.col("id").alias("doc_id"), F.repeat(F.lit("text "), 10).alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    default = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        rows = core.QUERIES["snk_snapshot"](spark, str(tmp_path)).collect()
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500 and {r.text for r in rows} == {"text " * 10}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", default)


def test_words_are_counted_within_their_document(spark, tmp_path):
    """Neither lines nor words of several documents are sorted, joined or gathered: a task's memory does not grow with them."""
    docs = spark.createDataFrame([(1, "Alpha beta\n" + "gamma beta gamma " * 3 + "\nbeta\nthe of"), (2, ""), (3, None), (4, "Beta")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = core.QUERIES["agg_spread"](spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [(1, "alpha", 1), (1, "beta", 2), (1, "gamma", 1), (4, "beta", 1)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Sort|Window|Aggregate|Join", plan) and "hashpartitioning(doc_id" in plan


def test_sections_read_from_texts_and_from_nodes(spark):
    texts = ["Title\nOne | two | three\nshort\n\n" + "A long line that is no heading, as it has more than forty characters.\nsee the License, which is a footnote of some length here\n" * k for k in range(9)]
    docs = spark.createDataFrame([*enumerate([*texts, "", "|", None])], "doc_id long, text string")
    rows = lambda tops: tops.select("doc_id", F.inline(F.transform("top", lambda x: F.struct(x["type"], x["role"], x["content"]))))
    texts, table = rows(tops_of_lines(docs)), rows(B.tops(nodes_of_lines(docs)))
    assert texts.count() == table.count() > 100 and texts.exceptAll(table).isEmpty() and table.exceptAll(texts).isEmpty()
    top = spark.createDataFrame(
        [(1, [("body", None, "before"), ("heading", None, "One"), ("body", None, "a"), ("table", None, ""), ("subheading", None, "Two"), ("paragraph", "abstract", "b"), ("body", None, "c")]), (2, [("body", None, "x")])],
        "doc_id long, top array<struct<type: string, role: string, content: string>>",
    )
    got = top.select("doc_id", F.inline(B.read_sections(F.col("top")))).collect()
    assert [tuple(r) for r in got] == [(1, 1, "One", "a "), (1, 2, "Two", ""), (1, 3, "Abstract", "b c")]
