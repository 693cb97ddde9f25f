"""Commands and what each of them has to do, down to the document."""

import pytest
from pyspark.sql import functions as F

from sylva.operators import heuristics as HE
from sylva.plans import batches, structure
from sylva.sources.corpus import nodes_of_lines

ALL = {"top", "bottom", "left", "right", "inside_h", "inside_v", "header"}
#: command, and the fields of its action; what is not named is null.
MATRIX = [
    ("make all the headings bold", {"type": "format", "target": "heading", "bold": True}),
    ("italicise the references", {"type": "format", "target": "reference", "italic": True}),
    ("underline the captions", {"type": "format", "target": "caption", "underline": True}),
    ("make the headings bold and italic", {"type": "format", "target": "heading", "bold": True, "italic": True}),
    ("make the headings blue", {"type": "format", "target": "heading", "color": "#1f4e79"}),
    ("colour the captions green", {"type": "format", "target": "caption", "color": "#2e7d32"}),
    ("highlight the captions", {"type": "highlight", "target": "caption", "color": "#fff59d"}),
    ("centre every caption", {"type": "align", "target": "caption", "alignment": "center"}),
    ("right align the references", {"type": "align", "target": "reference", "alignment": "right"}),
    ("align the captions to the left", {"type": "align", "target": "caption", "alignment": "left"}),
    ("justify the body text", {"type": "align", "target": "body", "alignment": "justify"}),
    ("center align the document title", {"type": "align", "target": "title", "alignment": "center"}),
    ("change the references to font size 9", {"type": "resize", "target": "reference", "size": 9.0}),
    ("increase the headings by 2", {"type": "resize", "target": "heading", "delta": 2.0}),
    ("select all headings increase font by 2 units", {"type": "resize", "target": "heading", "delta": 2.0}),
    ("make the headings 2 points smaller", {"type": "resize", "target": "heading", "delta": -2.0}),
    ("reduce the headings by 1", {"type": "resize", "target": "heading", "delta": -1.0}),
    ("bump the headings +2", {"type": "resize", "target": "heading", "delta": 2.0}),
    ("make the subheadings larger", {"type": "resize", "target": "subheading", "scale": 1.25}),
    ("put the contributions in bullets", {"type": "list", "target": "body", "kind": "bullet"}),
    ("number the introduction", {"type": "list", "target": "body", "kind": "number"}),
    ("itemise the scope", {"type": "list", "target": "body", "kind": "bullet"}),
    ("change table style to only upper and lower borders bold", {"type": "border", "target": "table", "sides": ["top", "bottom"], "width": 1.5}),
    ("remove all borders from the table", {"type": "border", "target": "table", "sides": [], "width": 0.0}),
    ("no vertical lines in the table", {"type": "border", "target": "table", "sides": ["top", "bottom", "left", "right", "inside_h"], "width": 0.5}),
    ("only the outer border of the table", {"type": "border", "target": "table", "sides": ["outside"], "width": 0.5}),
    ("change the table layout only keep top and bottom borders bold remove the rest", {"type": "border", "target": "table", "sides": ["top", "bottom"], "width": 1.5}),
    ("keep all the top and bottom borders", {"type": "border", "target": "table", "sides": ["bottom", "inside_h", "top"], "width": 0.5}),
    ("top and bottom borders, no verticals", {"type": "border", "target": "table", "sides": ["top", "bottom"], "width": 0.5}),
    ("make the table borders thin", {"type": "border", "target": "table", "sides": [], "width": 0.5}),
    ("add a rule under the header row", {"type": "border", "target": "table", "sides": ["header"], "width": 0.5}),
    ("bold the header row border and the last bottom one", {"type": "border", "target": "table", "sides": ["header", "bottom"], "width": 1.5}),
    ("bold the word Adam wherever it appears", {"type": "format", "target": "document", "bold": True, "find": "Adam"}),
    ('italicise the phrase "older adults"', {"type": "format", "target": "document", "italic": True, "find": "older adults"}),
    ("remove the horizontal lines", {"type": "delete", "target": "horizontal_rule"}),
    ("make the headings uppercase", {"type": "case", "target": "heading", "kind": "upper"}),
    ("make the header cells capitalized", {"type": "case", "target": "header", "kind": "title"}),
    ("capitalise the captions", {"type": "case", "target": "caption", "kind": "title"}),
    ("sentence case the captions", {"type": "case", "target": "caption", "kind": "sentence"}),
    ("double space the document", {"type": "spacing", "target": "body", "line": 2.0}),
    ("set the line spacing to 1.5", {"type": "spacing", "target": "body", "line": 1.5}),
    ("single space the references", {"type": "spacing", "target": "reference", "line": 1.0}),
    ("increase the space between paragraphs", {"type": "spacing", "target": "paragraph", "after_pt": 12.0}),
    ("no space between paragraphs", {"type": "spacing", "target": "paragraph", "after_pt": 0.0}),
    ("set the body font to Arial", {"type": "format", "target": "body", "font_family": "Arial"}),
    ("change the references font to Times New Roman", {"type": "format", "target": "reference", "font_family": "Times New Roman"}),
    ("set the body font to Fira Code", {"type": "format", "target": "body", "font_family": "Fira Code"}),
    ('delete the phrase "Adam"', {"type": "replace", "target": "document", "find": "Adam", "put": ""}),
    ("remove the highlighting", {"type": "format", "target": "document", "highlight": ""}),
    ("make the headings in the table bold", {"type": "format", "target": "table_header", "bold": True}),
    ("remove the double spaces", {"type": "rewrite", "target": "document", "instruction": "remove the double spaces"}),
    ("delete the second paragraph", {"type": "rewrite", "target": "paragraph", "instruction": "delete the second paragraph"}),
    ("show me the figures", {"type": "select", "target": "figure"}),
    ("make the notation consistent with the appendix", {"type": "rewrite", "target": "body", "instruction": "make the notation consistent with the appendix"}),
    ("convert the equations", {"type": "rewrite", "target": "body", "instruction": "convert the equations"}),
    ("the headings are not bold", {"type": "format", "target": "heading", "bold": False}),
    ("unbullet the list", {"type": "select", "target": "heading"}),
    ("", {"type": "rewrite", "target": "body", "instruction": ""}),
]


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(k, c) for k, (c, _) in enumerate(MATRIX)] + [(1000, None)]
    return HE.actions(spark.createDataFrame(rows, "id long, command string")).cache()


def test_each_command(asked):
    got = {r["id"]: r for r in asked.collect()}
    assert len(got) == len(MATRIX)  # a null command asks for nothing
    wrong = {}
    for k, (command, want) in enumerate(MATRIX):
        have = {f: got[k][f] for f in HE.FIELDS if got[k][f] is not None}
        if have != want:
            wrong[command] = (have, want)
    assert not wrong


def test_rows_are_accepted_and_run(spark, asked):
    """Every lowered row passes the check of batches and does what it says to a document."""
    stored = HE.lowered(asked.where("type is not null").withColumn("doc_id", F.col("id")).withColumn("seq", F.lit(1)))
    checked = batches.errors(stored.withColumn("batch", F.col("doc_id")).withColumn("node_ids", F.array().cast("array<string>")).withColumn("confirm", F.lit(False)).withColumn("size", F.coalesce("size", "delta", "scale")))
    assert [r.errors for r in checked.where("size(errors) > 0").collect()] == []
    text = "A heading line\nfirst Adam text that is long enough to be body text\n\nCell | Adam\nmail@example.com is a reference that is quite long enough to be one\nSub"
    n = len(MATRIX)
    nodes = nodes_of_lines(spark.createDataFrame([(k, text) for k in range(n)], "doc_id long, text string"))
    done = {}
    for r in structure.replay(nodes, stored).collect():
        done.setdefault(MATRIX[r.doc_id][0], []).append(r)
    of = lambda command, kind: [r for r in done[command] if r.type == kind]
    assert all(r.style.bold for r in of("make all the headings bold", "heading"))
    assert [r.style.font_size for r in of("make the headings 2 points smaller", "heading")] == [12.0] * len(of("make the headings bold and italic", "heading"))
    edges = lambda command: {k for k, v in of(command, "table")[0].meta.borders.items() if v}
    assert edges("no vertical lines in the table") == ALL - {"inside_v", "header"} and edges("only the outer border of the table") == {"top", "bottom", "left", "right"}
    assert edges("remove all borders from the table") == set() and edges("make the table borders thin") == ALL
    assert of("change table style to only upper and lower borders bold", "table")[0].meta.borders["top"] == 1.5
    assert all(r.meta.line_spacing == 2.0 for r in of("double space the document", "body"))
    assert not any("Adam" in r.content for r in done['delete the phrase "Adam"']) and any("Adam" in r.content for r in done["show me the figures"])
    assert all(r.content == r.content.upper() for r in of("make the headings uppercase", "heading"))
    assert all(r.style.highlight is None for r in done["remove the highlighting"] if r.type not in ("table", "table_row"))


def test_what_a_command_is_read_by_is_worked_out_once(spark):
    """Readers of a request's parts share them; the sentence about edges was cut anew for each of some hundred patterns."""
    frame = spark.createDataFrame([("keep the top border, no verticals",)], "command string")
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    edges = plan(frame.select(HE.borders(F.col("command")).alias("b")).select("b.sides", "b.width"))
    assert edges.count("split(") == 1 and edges.upper().count("RLIKE") < 25
    sizes = plan(HE.actions(frame))
    assert sizes.count("increase|decrease|raise") == 1 and sizes.count("single[- ]?spac") == 1
