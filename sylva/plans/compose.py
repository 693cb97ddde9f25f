"""Specs as node tables: what a composed document is made of, block by block, with what stands below each block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_numbering
from ..operators.spec import padded_rows
from ..schema import META_DDL, STYLE

_STYLE_JSON = "struct<bold: boolean, italic: boolean, underline: boolean, size_pt: double, font: string, color: string, alignment: string>"
SPEC_DDL = (
    "struct<meta: struct<title: string, style: string, authors: array<struct<name: string, affiliation: string, email: string>>, title_page: boolean,"
    " title_page_lines: array<string>, abstract: string, keywords: array<string>>, blocks: array<struct<type: string, level: int, text: string, ordered: boolean,"
    f" items: array<string>, columns: array<string>, rows: array<array<string>>, caption: string, render: string, language: string, filename: string, style: {_STYLE_JSON},"
    " chart: struct<kind: string, labels: array<string>, values: array<double>, series: array<struct<name: string, values: array<double>>>>>>, `references`: array<string>>"
)
#: What captions of figures begin with in each style (others as "report" but for base), and of listings.
FIGURE_PREFIX = {"acm": "Figure {num}: ", "report": "Figure {num}. ", "assignment": "Figure {num}.", "apa": "Figure {num}"}
FIGURE_SEPARATOR = {"acm": "", "report": "", "assignment": " ", "apa": "\n"}
LISTING_PREFIX, LISTING_FONT, JOINT = "Listing {num}.", "Courier New", " — "
#: Markup that only mathematics has.
MATH_MARKUP = (
    r"\\(?:frac|sqrt|sum|prod|int|lim|partial|infty|cdot|times|pm|leq|geq|neq|approx"
    r"|alpha|beta|gamma|delta|theta|lambda|mu|sigma|tau|phi|omega|bar|hat|vec|mathrm"
    r"|left|right|begin|text)\b"
    r"|[_^]\{|[_^][A-Za-z0-9]"
)
NODE = "struct<path: array<int>, type: string, content: string, style: struct<{}>, props: map<string,string>>".format(", ".join(f"{k}: {v}" for k, v in STYLE.items()))
NODES = f"array<{NODE}>"


def _style(**given) -> Column:
    return F.struct(*[(given[f] if f in given else F.lit(None)).cast(t).alias(f) if isinstance(given.get(f), Column) or f not in given else F.lit(given[f]).cast(t).alias(f) for f, t in STYLE.items()])


def _node(path, type_, content, style: Column | None = None, **props) -> Column:
    path = path if isinstance(path, Column) else F.array(*map(F.lit, path))
    said = F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]) if props else F.create_map()
    text = content if isinstance(content, Column) else F.lit(content)
    return F.struct(
        path.cast("array<int>").alias("path"), F.lit(type_).alias("type"), text.cast("string").alias("content"), (style if style is not None else _style()).alias("style"),
        F.map_filter(said.cast("map<string,string>"), lambda _, v: v.isNotNull()).alias("props"),
    ).cast(NODE)


def _own(b: Column) -> Column:
    """The style that a block states; one that states none leaves all unset."""
    s = b["style"]
    flag = lambda f: F.when(s.isNotNull(), F.coalesce(s[f], F.lit(False)))
    return _style(bold=flag("bold"), italic=flag("italic"), underline=flag("underline"), font_size=s["size_pt"], font_family=s["font"], color=s["color"], alignment=s["alignment"])


def _some(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def front_matter(m: Column) -> Column:
    """Title, authors, lines of the title page and its break, abstract and keywords, as far as a spec has them: lists of nodes."""
    centred = _style(alignment="center")
    line = lambda a: F.array_join(F.filter(F.array(a["name"], a["affiliation"], a["email"]), lambda x: _text(x) != ""), ", ")
    none = F.array().cast(f"array<{NODES}>")
    some = lambda test, *nodes: F.when(F.coalesce(test, F.lit(False)), F.array(*[F.array(n) for n in nodes])).otherwise(none)
    lines = lambda texts: F.coalesce(F.transform(F.filter(texts, lambda t: F.trim(_text(t)) != ""), lambda t: F.array(_node([], "body", t, centred))), none)
    return F.concat(
        some(_text(m["title"]) != "", _node([], "heading", m["title"], _style(bold=True, alignment="center"), level="0", role="title")),
        lines(F.transform(m["authors"], line)), lines(m["title_page_lines"]), some(m["title_page"], _node([], "page_break", "", breaks="1")),
        some(_text(m["abstract"]) != "", _node([], "heading", "Abstract", level="1"), _node([], "body", m["abstract"])),
        some(_some(m["keywords"]), _node([], "body", F.concat(F.lit("Keywords: "), F.array_join(m["keywords"], ", ")), _style(italic=True))),
    )


def _table(b: Column) -> Column:
    columns = F.when(_some(b["columns"]), b["columns"]).otherwise(F.get(b["rows"], F.lit(0)))
    head = _some(b["columns"])
    bold = _style(bold=True)
    rows = F.concat(F.when(head, F.array(b["columns"])).otherwise(F.array().cast("array<array<string>>")), padded_rows(F.coalesce(b["rows"], F.array().cast("array<array<string>>")), F.size(columns)))
    is_head = lambda i: head & (i == 0)
    row = lambda r, i: F.concat(
        F.array(_node(F.array(i + 1), "table_row", "", header=F.when(is_head(i), "true"))),
        F.transform(r, lambda c, j: _node(F.array(i + 1, j + 1), "table_cell", _text(c), _style(bold=F.when(is_head(i), True)))),
    )
    caption = F.when(_text(b["caption"]) != "", F.array(_node(F.array(F.size(rows) + 1), "caption", b["caption"]))).otherwise(F.array().cast(NODES))
    whole = F.concat(F.array(_node([], "table", "", rows=F.size(rows).cast("string"), cols=F.size(columns).cast("string"), caption=_text(b["caption"]))), F.flatten(F.transform(rows, row)), caption)
    return F.when(_some(columns), whole)


def _list(b: Column) -> Column:
    ordered = F.coalesce(b["ordered"], F.lit(False))
    item = lambda t, i: _node(F.array(i + 1), "body", F.concat(F.when(ordered, F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("• "), _text(t)), _own(b), list_item="true")
    return F.when(_some(b["items"]), F.concat(F.array(_node([], "paragraph", "", list="true", ordered=ordered.cast("string"))), F.transform(b["items"], item)))


def _code(b: Column, number: Column) -> Column:
    caption = F.array_join(F.filter(F.array(b["filename"], b["caption"]), lambda x: _text(x) != ""), JOINT)
    label = F.concat(F.replace(F.lit(LISTING_PREFIX), F.lit("{num}"), number.cast("string")), F.lit(" "), caption)
    none = F.array().cast(NODES)
    # splitting at the ends of lines leaves an empty piece behind the last one, which is no line
    lines = F.split(F.regexp_replace(b["text"], r"(\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029])$", ""), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", -1)
    titled = F.when(caption != "", 1).otherwise(0)
    listing = F.concat(
        F.array(_node([], "paragraph", "", kind="code", language=_text(b["language"]), code=b["text"])), F.when(caption != "", F.array(_node([1], "caption", label))).otherwise(none),
        F.transform(lines, lambda t, i: _node(F.array(i + 1 + titled), "body", F.when(t == "", " ").otherwise(t), _style(font_family=LISTING_FONT), code_line="true")),
    )
    picture = F.concat(
        F.array(_node([], "figure", "", kind="code_screenshot", number=number.cast("string"), language=_text(b["language"]), code=b["text"]), _node([1], "image", caption, is_figure="true")),
        F.when(caption != "", F.array(_node([2], "caption", label))).otherwise(none),
    )
    return F.when(F.trim(_text(b["text"])) != "", F.when(b["render"] == "image", picture).otherwise(listing))


def _figure(b: Column, number: Column, style: Column) -> Column:
    """A figure stands for its chart's data; one without data is left out."""
    chart = b["chart"]
    data = _some(chart["values"]) | F.coalesce(F.exists(chart["series"], lambda s: _some(s["values"])), F.lit(False))
    pick = lambda table, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), style), F.lit(other))
    label = F.concat(F.replace(pick(FIGURE_PREFIX, "Figure {num}."), F.lit("{num}"), number.cast("string")), pick(FIGURE_SEPARATOR, ""), b["caption"])
    titled = _text(b["caption"]) != ""
    whole = F.array(_node([], "figure", "", kind="chart", number=number.cast("string")), _node([1], "image", _text(b["caption"]), is_figure="true", chart=F.to_json(chart)))
    return F.when(data, F.concat(whole, F.when(titled, F.array(_node([2], "caption", label))).otherwise(F.array().cast(NODES))))


def _equation(b: Column, number: Column) -> Column:
    render = F.coalesce(b["render"], F.lit("auto"))
    drawn = (render == "image") | ((render == "auto") & F.rlike(_text(b["text"]), F.lit(MATH_MARKUP)))
    picture = F.array(_node([], "figure", "", kind="equation", equation=b["text"], number=number.cast("string")), _node([1], "image", b["text"], is_figure="true", equation=b["text"], number=number.cast("string")))
    plain = F.array(_node([], "body", b["text"], _style(italic=True, alignment="center"), kind="equation", equation=b["text"], number=number.cast("string")))
    return F.when(b["text"].isNotNull(), F.when(drawn, picture).otherwise(plain))


def _block(b: Column, number: Column, style: Column) -> Column:
    """The nodes of a block, the first of them its top; null if it has nothing to show."""
    level = F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce(b["level"], F.lit(1))))
    heading = lambda kind, n: F.array(_node([], kind, b["text"], _own(b), level=n))
    return (
        F.when((b["type"] == "heading") & b["text"].isNotNull(), F.when(level == 1, heading("heading", level.cast("string"))).otherwise(heading("subheading", level.cast("string"))))
        .when((b["type"] == "paragraph") & b["text"].isNotNull(), F.array(_node([], "body", b["text"], _own(b)))).when(b["type"] == "list", _list(b))
        .when(b["type"] == "page_break", F.array(_node([], "page_break", "", breaks="1"))).when(b["type"] == "table", _table(b))
        .when(b["type"] == "figure", _figure(b, number, style)).when(b["type"] == "code", _code(b, number)).when(b["type"] == "equation", _equation(b, number))
    )


def spec_nodes(specs: DataFrame, column: str = "spec") -> DataFrame:
    """The node table of spec texts (doc_id, JSON): a node table's columns and ``props``, what else a node says (its kind, level,
    number, source).

    Front matter comes first, then the blocks, then the references with running numbers. Figures, listings and equations
    count each for themselves, those too that have nothing to show and are left out. A table has a row of nodes for each
    row and its caption last; lists and listings have a node for each item and line. Pictures are not drawn: an image node
    has the data that it would show. A spec is one row, so nothing is shuffled. What is no JSON gives no nodes, and so does a null; repeated rows repeat their nodes.
    """
    parsed = specs.select("doc_id", F.from_json(column, SPEC_DDL).alias("s")).where("s is not null")
    said = F.filter(F.transform(F.coalesce("s.references", F.array().cast("array<string>")), strip_numbering), lambda r: r.isNotNull())
    listed = F.filter(F.transform(said, lambda r, i: F.struct(r.alias("r"), (i + 1).alias("i"))), lambda x: x["r"] != "")
    references = F.transform(listed, lambda x: F.array(_node([], "reference", F.concat(F.lit("["), x["i"].cast("string"), F.lit("] "), x["r"]))))
    blocks, style = F.coalesce("s.blocks", F.array().cast(_blocks())), F.coalesce("s.meta.style", F.lit("report"))
    number = lambda b, i: F.size(F.filter(F.slice(blocks, F.lit(1), i + 1), lambda x: x["type"] == b["type"]))
    made = F.filter(F.transform(blocks, lambda b, i: _block(b, number(b, i), style)), lambda n: n.isNotNull())
    tops = F.concat(front_matter(F.col("s.meta")), made, references)
    rows = parsed.select("doc_id", F.posexplode(tops).alias("_i", "nodes")).select("doc_id", (F.col("_i") + 1).alias("_top"), F.explode("nodes").alias("n"))
    path = F.concat(F.array("_top"), F.col("n.path"))
    named = lambda p: F.concat_ws(".", F.col("doc_id").cast("string"), F.transform(p, lambda x: x.cast("string")))
    meta = F.from_json(F.to_json(F.struct(F.when(F.col("n.props")["header"] == "true", True).alias("header_row"), F.col("n.props")["role"].alias("role"))), META_DDL)
    return rows.select(
        "doc_id", named(path).alias("node_id"), F.when(F.size(path) > 1, named(F.slice(path, F.lit(1), F.size(path) - 1))).otherwise(F.col("doc_id").cast("string")).alias("parent_id"),
        F.col("n.type").alias("type"), path.alias("sort_path"), F.size(path).alias("depth"), F.col("n.content").alias("content"), F.col("n.style").alias("style"), meta.alias("meta"), F.col("n.props").alias("props"),
    )


def _blocks() -> str:
    inner = SPEC_DDL[SPEC_DDL.index("blocks: ") + len("blocks: ") : SPEC_DDL.index(", `references`")]
    return inner
