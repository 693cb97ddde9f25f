"""Tables of the document graph, and the closed sets that validate them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Node types.
NODE_TYPES = [
    "document", "paragraph", "heading", "subheading", "body", "image", "figure", "caption", "table", "table_row",
    "table_cell", "horizontal_rule", "page_break", "header", "footer", "reference", "footnote",
]
#: The node types that each target of an action means.
TARGETS = {
    "heading": ["heading"],
    "subheading": ["subheading"],
    "paragraph": ["paragraph", "body"],
    "body": ["body", "paragraph"],
    "table": ["table"],
    "table_cell": ["table_cell"],
    "figure": ["figure", "image"],
    "image": ["image"],
    "caption": ["caption"],
    "reference": ["reference"],
    "horizontal_rule": ["horizontal_rule"],
    "page_break": ["page_break"],
    "header": ["header"],
    "footer": ["footer"],
    "footnote": ["footnote"],
    "document": ["heading", "subheading", "body", "paragraph", "caption", "table_cell", "reference", "footnote", "header", "footer"],
}
HEADINGS = ["heading", "subheading"]
TEXT = ["body", "paragraph"]
FIGURES = ["figure", "image"]
#: Types that cannot be a document's title, and the longest title that is not a heading.
NOT_A_TITLE = ["header", "footer", "page_break", "horizontal_rule", "table", "table_row", "table_cell", "figure", "image", "caption", "footnote"]
TITLE_CHARS = 250
STYLE = {
    "font_family": "string", "font_size": "double", "bold": "boolean", "italic": "boolean", "underline": "boolean",
    "color": "string", "highlight": "string", "alignment": "string", "vertical_align": "string",
}
STYLE_DDL = "struct<" + ", ".join(f"{k}: {v}" for k, v in STYLE.items()) + ">"
META_DDL = "struct<header_row: boolean, list_kind: string, list_level: int, line_spacing: double, space_before_pt: double, space_after_pt: double, borders: map<string, double>, page_index: int, role: string>"


def style(**given) -> Column:
    """A style struct with the given fields (Columns or values); the others are unset, which is not the same as false."""
    fields = []
    for name, kind in STYLE.items():
        v = given.get(name)
        fields.append((v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name))
    return F.struct(*fields)


def is_type(types: list[str]) -> Column:
    return F.col("type").isin(types)
