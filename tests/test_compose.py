"""Specs as node tables, against nodes made by hand."""

import json

import pytest

from sylva.plans.compose import spec_nodes

FRACTION = r"d = \frac{a - b}{\sqrt{c}}"


@pytest.fixture
def made(spark):
    def build(blocks, meta=None, references=None, **spec):
        text = json.dumps({"meta": {"title": "T", "style": "assignment", **(meta or {})}, "blocks": blocks, "references": references or [], **spec})
        rows = sorted(spec_nodes(spark.createDataFrame([(1, text)], "doc_id long, spec string")).collect(), key=lambda r: r.sort_path)
        assert all(r.node_id == "1." + ".".join(map(str, r.sort_path)) and r.depth == len(r.sort_path) for r in rows)
        assert all(r.parent_id == ("1." + ".".join(map(str, r.sort_path[:-1])) if r.depth > 1 else "1") for r in rows)
        return [(tuple(r.sort_path), r.type, r.content, {k: v for k, v in r.style.asDict().items() if v is not None}, dict(r.props)) for r in rows]

    return build


TITLE = ((1,), "heading", "T", {"bold": True, "alignment": "center"}, {"level": "0", "role": "title"})


def test_headings_and_paragraphs(made):
    got = made([{"type": "heading", "level": 1, "text": "One"}, {"type": "heading", "level": 2, "text": "Two"}, {"type": "heading", "level": 9, "text": "Deep"}, {"type": "heading", "text": "Plain"}, {"type": "paragraph", "text": "x", "style": {"bold": True, "size_pt": 9}}, {"type": "paragraph", "text": ""}])
    assert got == [
        TITLE, ((2,), "heading", "One", {}, {"level": "1"}), ((3,), "subheading", "Two", {}, {"level": "2"}), ((4,), "subheading", "Deep", {}, {"level": "3"}), ((5,), "heading", "Plain", {}, {"level": "1"}),
        ((6,), "body", "x", {"bold": True, "italic": False, "underline": False, "font_size": 9.0}, {}), ((7,), "body", "", {}, {}),
    ]


def test_front_matter(made):
    meta = {"authors": [{"name": "A", "email": "a@b.c"}, {"name": ""}, {"affiliation": "U"}], "title_page": True, "title_page_lines": ["Course: X", "  "], "abstract": "Short.", "keywords": ["k", "l"]}
    centred = {"alignment": "center"}
    assert made([{"type": "paragraph", "text": "body"}], meta, ["[1] B. Author, Title, 2014.", "", "(3) 4. Other"]) == [
        TITLE, ((2,), "body", "A, a@b.c", centred, {}), ((3,), "body", "U", centred, {}), ((4,), "body", "Course: X", centred, {}), ((5,), "page_break", "", {}, {"breaks": "1"}),
        ((6,), "heading", "Abstract", {}, {"level": "1"}), ((7,), "body", "Short.", {}, {}), ((8,), "body", "Keywords: k, l", {"italic": True}, {}), ((9,), "body", "body", {}, {}),
        ((10,), "reference", "[1] B. Author, Title, 2014.", {}, {}), ((11,), "reference", "[3] Other", {}, {}),
    ]


def test_tables_keep_their_shape(made):
    got = made([{"type": "table", "caption": "Results", "columns": ["Case", "Result"], "rows": [["1", "pass"], ["2"], ["3", "x", "y"]]}, {"type": "table"}, {"type": "table", "rows": [["a", "b"], ["c", "d"]]}], {"title": ""})
    bold = {"bold": True}
    assert got[0] == ((1,), "table", "", {}, {"rows": "4", "cols": "2", "caption": "Results"})
    assert got[1:4] == [((1, 1), "table_row", "", {}, {"header": "true"}), ((1, 1, 1), "table_cell", "Case", bold, {}), ((1, 1, 2), "table_cell", "Result", bold, {})]
    assert [(p, c) for p, t, c, *_ in got if t == "table_cell" and p[0] == 1][2:] == [((1, 2, 1), "1"), ((1, 2, 2), "pass"), ((1, 3, 1), "2"), ((1, 3, 2), ""), ((1, 4, 1), "3"), ((1, 4, 2), "x")]
    assert got[13] == ((1, 5), "caption", "Results", {}, {})
    assert [(p, t, c) for p, t, c, *_ in got[14:]] == [((2,), "table", ""), ((2, 1), "table_row", ""), ((2, 1, 1), "table_cell", "a"), ((2, 1, 2), "table_cell", "b"), ((2, 2), "table_row", ""), ((2, 2, 1), "table_cell", "c"), ((2, 2, 2), "table_cell", "d")]


def test_lists_and_listings(made):
    got = made([{"type": "list", "ordered": True, "items": ["first", "second"]}, {"type": "list", "items": ["x"]}, {"type": "list", "items": []}, {"type": "code", "language": "py", "text": "a = 1\n\nc = 3\n", "filename": "f.py", "caption": "what it does"}, {"type": "code", "text": "  "}, {"type": "code", "text": "z"}], {"title": ""})
    assert got[:5] == [
        ((1,), "paragraph", "", {}, {"list": "true", "ordered": "true"}), ((1, 1), "body", "1. first", {}, {"list_item": "true"}), ((1, 2), "body", "2. second", {}, {"list_item": "true"}),
        ((2,), "paragraph", "", {}, {"list": "true", "ordered": "false"}), ((2, 1), "body", "• x", {}, {"list_item": "true"}),
    ]
    line = {"font_family": "Courier New"}
    assert got[5:] == [
        ((3,), "paragraph", "", {}, {"kind": "code", "language": "py", "code": "a = 1\n\nc = 3\n"}), ((3, 1), "caption", "Listing 1. f.py — what it does", {}, {}),
        *[((3, k), "body", t, line, {"code_line": "true"}) for k, t in ((2, "a = 1"), (3, " "), (4, "c = 3"))], ((4,), "paragraph", "", {}, {"kind": "code", "language": "", "code": "z"}), ((4, 1), "body", "z", line, {"code_line": "true"}),
    ]


def test_pictures_stand_for_their_data(made):
    chart = {"kind": "bar", "labels": ["A", "B"], "values": [3.0, 5.0]}
    blocks = [
        {"type": "figure", "caption": "Nothing", "chart": {"kind": "bar", "labels": ["A"], "values": []}}, {"type": "figure", "caption": "Values", "chart": chart}, {"type": "figure", "chart": chart}, {"type": "figure", "caption": "No chart"},
        {"type": "equation", "text": FRACTION}, {"type": "equation", "text": "y = mx + c"}, {"type": "equation", "text": "y = mx + c", "render": "image"}, {"type": "equation", "text": FRACTION, "render": "text"},
        {"type": "code", "language": "cpp", "text": "int main(){}", "render": "image", "filename": "g.cpp"},
    ]
    for style, label in (("assignment", "Figure 2. Values"), ("apa", "Figure 2\nValues"), ("acm", "Figure 2: Values"), ("ieee", "Figure 2.Values")):
        got = made(blocks, {"title": "", "style": style})
        assert got[0] == ((1,), "figure", "", {}, {"kind": "chart", "number": "2"}) and got[1][:3] == ((1, 1), "image", "Values") and json.loads(got[1][4]["chart"]) == chart and got[2] == ((1, 2), "caption", label, {}, {})
    assert got[3] == ((2,), "figure", "", {}, {"kind": "chart", "number": "3"}) and got[4][:3] == ((2, 1), "image", "")
    assert [(p, t, c, m.get("kind"), m.get("number")) for p, t, c, _, m in got[5:]] == [
        ((3,), "figure", "", "equation", "1"), ((3, 1), "image", FRACTION, None, "1"), ((4,), "body", "y = mx + c", "equation", "2"), ((5,), "figure", "", "equation", "3"), ((5, 1), "image", "y = mx + c", None, "3"),
        ((6,), "body", FRACTION, "equation", "4"), ((7,), "figure", "", "code_screenshot", "1"), ((7, 1), "image", "g.cpp", None, None), ((7, 2), "caption", "Listing 1. g.cpp", None, None),
    ]


def test_hard_cases(spark):
    rows = [(1, None), (2, "no json"), (3, "{}"), (4, '{"blocks": null, "meta": null}'), (5, '{"blocks": [{"type": "nonsense"}, {"type": "heading"}, null, {"type": "paragraph", "text": "kept"}]}'), (5, '{"blocks": [{"type": "paragraph", "text": "kept"}]}'), (None, '{"meta": {"title": "No id"}}')]
    got = spec_nodes(spark.createDataFrame(rows, "doc_id long, spec string")).collect()
    assert sorted(((r.doc_id, tuple(r.sort_path), r.content) for r in got), key=str) == sorted([(5, (1,), "kept"), (5, (1,), "kept"), (None, (1,), "No id")], key=str)
    assert spec_nodes(spark.createDataFrame([], "doc_id long, spec string")).count() == 0
