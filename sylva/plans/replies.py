"""What can be taken out of replies that are whole, cut off or partly wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edits_of(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """One row (the other columns, pos, id, text) for every edit object that a reply finished, in order from 1; what stands around
    the objects does not matter. A last object that was cut off is left out, not repaired: half a paragraph is no edit. Null
    replies and those without an object have no rows."""
    pieces = F.slice(F.split(reply, r'\{\s?(?="id")', -1), 2, 1 << 30)
    objects = F.transform(pieces, lambda p: F.from_json(F.concat(F.lit("{"), p), "id string, text string"))
    whole = F.filter(objects, lambda o: o["id"].isNotNull() & o["text"].isNotNull())
    others = [c for c in replies.columns if c != reply]
    return replies.select(*others, F.posexplode(whole).alias("pos", "edit")).select(*others, (F.col("pos") + 1).alias("pos"), "edit.id", "edit.text")


def whole_object(reply: Column) -> Column:
    """The object that begins at the first brace of a reply, if the reply holds it to its end; else null.

    One scan: the signs that can matter (quotes, escapes, braces) are split off, and a fold over the pieces keeps how many
    braces are open and whether a text is. What stands behind the object does not matter.
    """
    text = F.substr(reply, F.instr(reply, "{"))
    signs = F.regexp_extract_all(text, F.lit(r'(?s)\\.|["{}\[\]]'), F.lit(0))
    gaps = F.transform(F.split(text, r'(?s)\\.|["{}\[\]]', -1), F.length)
    steps = F.zip_with(signs, F.slice(gaps, F.lit(1), F.size(signs)), lambda s, g: F.struct(s.alias("sign"), g.alias("gap")))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("open"), F.lit(False).alias("quoted"), F.lit(None).cast("int").alias("end"))

    def step(s: Column, x: Column) -> Column:
        sign, at = x["sign"], s["at"] + x["gap"] + F.length(x["sign"])
        plain = ~s["quoted"]
        depth = s["open"] + F.when(plain & sign.isin("{", "["), 1).when(plain & sign.isin("}", "]"), -1).otherwise(0)
        closed = plain & sign.isin("}", "]") & (depth == 0)
        return F.struct(at.alias("at"), depth.alias("open"), F.when(sign == '"', plain).otherwise(s["quoted"]).alias("quoted"), F.coalesce(s["end"], F.when(closed, at)).alias("end"))

    end = F.aggregate(steps, zero, step, lambda s: s["end"])
    return F.when(F.contains(reply, F.lit("{")), F.substr(text, F.lit(1), end))


def strict(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """The replies with ``edits``, an array of (id, text), if their object is whole and valid; null otherwise: a reply that was
    cut off is not repaired, as a paragraph that ends in mid-sentence would pass for one that was meant."""
    found = replies.withColumn("_object", whole_object(F.col(reply)))
    valid = F.try_parse_json(F.col("_object")).isNotNull()
    edits = F.from_json("_object", "edits array<struct<id: string, text: string>>")["edits"]
    return found.withColumn("edits", F.when(valid, F.coalesce(edits, F.array().cast("array<struct<id:string,text:string>>")))).drop("_object")


#: What a block needs to be one: fields of these kinds; those with a star have to be there.
BLOCKS = {
    "heading": {"*text": "STRING", "level": "BIGINT"}, "paragraph": {"*text": "STRING"}, "list": {"items": "ARRAY<STRING>", "ordered": "BOOLEAN"}, "equation": {"*text": "STRING", "render": "STRING"},
    "table": {"columns": "ARRAY<STRING>", "rows": "ARRAY<ARRAY<STRING>>", "caption": "STRING"}, "figure": {"caption": "STRING", "chart": "OBJECT"}, "code": {"text": "STRING", "caption": "STRING", "language": "STRING", "filename": "STRING"}, "page_break": {},
}
META = {"title": "STRING", "abstract": "STRING", "style": "STRING", "page_header": "STRING", "keywords": "ARRAY<STRING>", "title_page_lines": "ARRAY<STRING>", "authors": "ARRAY<OBJECT>", "title_page": "BOOLEAN"}


def _kind(value: Column, field: str) -> Column:
    """The kind of a field of a parsed object; null if it is not there."""
    return F.schema_of_variant(F.variant_get(value, f"$.{field}", "variant"))


def _fits(value: Column, fields: dict[str, str]) -> Column:
    """Whether the fields that a parsed object has are of the kinds that they have to be. An empty list is a list of anything."""
    out = F.lit(True)
    for name, want in fields.items():
        said = _kind(value, name.strip("*"))
        if want == "OBJECT":
            ok = F.startswith(said, F.lit("OBJECT"))
        elif want == "ARRAY<OBJECT>":
            ok = F.startswith(said, F.lit("ARRAY<OBJECT")) | (said == "ARRAY<VOID>")
        elif want == "ARRAY<ARRAY<STRING>>":
            ok = said.isin("ARRAY<ARRAY<STRING>>", "ARRAY<ARRAY<VOID>>", "ARRAY<VOID>")
        elif want.startswith("ARRAY"):
            ok = said.isin(want, "ARRAY<VOID>")
        else:
            ok = said == want
        out = out & F.coalesce(ok, F.lit(not name.startswith("*")))
    return out


def good_block(block: Column) -> Column:
    """Whether the text of a block is one that can be set."""
    value = F.try_parse_json(block)
    kind = F.try_variant_get(value, "$.type", "string")
    ok = F.lit(False)
    for name, fields in BLOCKS.items():
        ok = F.when(kind == name, _fits(value, fields)).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def salvage(specs: DataFrame, column: str = "spec") -> DataFrame:
    """The specs with what of them can be kept: ``stage``, ``kept`` (JSON with meta, blocks and references) and ``dropped`` blocks.

    Blocks that are wrong go. Then the first of these holds: 1 all else as it is; 2 without references; 3 meta and blocks
    alone; 4 blocks alone. A spec without a good block, and what is no JSON object, has stage and kept null.
    """
    raw = F.from_json(column, "meta string, blocks array<string>, references string, visualization_plan string, resolved string")
    rows = specs.withColumn("_raw", F.element_at(F.array(raw), 1)).withColumn("_good", F.filter("_raw.blocks", good_block))
    parsed = lambda c: F.try_parse_json(F.col(f"_raw.{c}"))
    kind = lambda c: F.schema_of_variant(parsed(c))
    absent = lambda c: F.col(f"_raw.{c}").isNull()
    meta = absent("meta") | F.coalesce(F.startswith(kind("meta"), F.lit("OBJECT")) & _fits(parsed("meta"), META), F.lit(False))
    references = absent("references") | F.coalesce(kind("references").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
    rest = (absent("resolved") | F.col("_raw.resolved").isin("true", "false")) & (absent("visualization_plan") | F.coalesce(F.startswith(kind("visualization_plan"), F.lit("ARRAY<OBJECT")) | (kind("visualization_plan") == "ARRAY<VOID>"), F.lit(False)))
    some = F.coalesce(F.size("_good"), F.lit(0)) > 0
    stage = F.when(~some, None).when(meta & references & rest, 1).when(meta & rest, 2).when(meta, 3).otherwise(4)
    rows = rows.withColumn("stage", stage.cast("int"))
    field = lambda name, c, test: F.when(test & F.col(f"_raw.{c}").isNotNull(), F.concat(F.lit(f'"{name}":'), F.col(f"_raw.{c}")))
    kept = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(
        field("meta", "meta", F.col("stage") <= 3), F.concat(F.lit('"blocks":['), F.array_join("_good", ","), F.lit("]")), field("references", "references", F.col("stage") == 1),
    )), ","), F.lit("}"))
    return rows.withColumns({"kept": F.when(F.col("stage").isNotNull(), kept), "dropped": F.when(F.col("_raw.blocks").isNotNull(), F.size("_raw.blocks") - F.size("_good"))}).drop("_raw", "_good")
