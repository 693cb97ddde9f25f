"""Whole version logs replayed, those actions too that insert, move, join, cut or take away nodes.

Every document follows its own stored rows, all documents at once. A node's place is a key that admits insertion: a list of
integers for each level, so what comes after a sibling gets that sibling's list with more numbers behind, and no other key
changes. Actions of single nodes between two structural ones are one fold; the n-th structural action of every
document is the n-th wave. All steps are windows and joins by document, so the nodes are dealt out once and stay where they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.actions import SIDES, border_widths, new_id, split_items
from ..schema import HEADINGS, NODE_TYPES, STYLE, TARGETS, TEXT, is_type
from ..shared import cut
from . import replay as R

#: What a stored action has besides doc_id, seq (its version), i (its place in the version) and the fields of replay.ACTION.
ACTION = R.ACTION | {
    "node_type": "string", "content": "string", "after_id": "string", "to_id": "string", "separator": "string", "level": "int", "line": "double",
    "before_pt": "double", "after_pt": "double", "sides": "array<struct<key:string,value:double>>", "edits": "array<struct<key:string,value:string>>",
}
#: Actions of single nodes, and those that need the document around them.
SINGLE = [*R.REPLAYED, "spacing", "select", "copy", "rewrite"]
STRUCTURAL = ["delete", "insert", "move", "merge", "split", "list", "border", "paste"]
#: Behind all other siblings, and before all later ones of a node.
LAST, LEAST = (1 << 31) - 1, -(1 << 31)
#: What a list is called.
NUMBERED, PLAIN = ["number", "numbered", "ordered", "numeric"], ["none", "off", "remove", "plain", "paragraph"]
KEY = "array<array<int>>"


def logs(actions: DataFrame) -> DataFrame:
    """One row for each document and wave: ``single``, the actions of single nodes that come first, in order, and ``x``, the
    structural action that follows (null after the last one). An unknown action raises.

    Of a version that may fail, ``begins`` marks the wave of its first action, ``may_fail`` the action that can, and ``last`` the
    last such action: until then a copy of the document is kept.
    """
    have = set(actions.columns)
    known = F.when(F.col("type").isin(SINGLE + STRUCTURAL), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown action: "), F.coalesce("type", F.lit("null")))).cast("string"))
    given = lambda c: F.lit(None) if c not in have else F.map_entries(c) if actions.schema[c].dataType.typeName() == "map" else F.col(c)
    rows = actions.withColumn("type", known).select("doc_id", "seq", F.col("i").cast("int").alias("i"), *[(given(c) if c != "type" else F.col(c)).cast(t).alias(c) for c, t in ACTION.items()])
    structural = F.col("type").isin(STRUCTURAL)
    may_fail = (F.col("type") == "merge") | ((F.col("type") == "insert") & ~F.coalesce("node_type", F.lit("body")).isin(NODE_TYPES))
    order = Window.partitionBy("doc_id").orderBy("seq", "i")
    version = Window.partitionBy("doc_id", "seq")
    waves = rows.select(
        "*", may_fail.alias("may_fail"), F.coalesce(F.col("seq") != F.lag("seq").over(order), F.lit(True)).alias("opens"),
        (F.sum(structural.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - structural.cast("int")).alias("wave"),
        F.max(F.when(may_fail, F.col("i"))).over(version).alias("_last"),
    )
    row = F.struct("seq", "i", "opens", *ACTION)
    return waves.groupBy("doc_id", "wave").agg(
        F.array_sort(F.collect_list(F.when(~structural, row))).alias("single"), F.first(F.when(structural, row), True).alias("x"),
        F.max(F.col("opens") & F.col("_last").isNotNull()).alias("begins"), F.max(F.when(structural, F.col("_last").isNotNull())).alias("risky"),
        F.max(F.when(structural, F.col("may_fail"))).alias("may_fail"), F.max(F.when(structural, F.col("may_fail") & (F.col("i") == F.col("_last")))).alias("last"),
    )


def _behind(key: Column, *more) -> Column:
    """The key of a sibling that comes right after the one of the given key."""
    last = F.concat(F.element_at(key, -1), F.array(*[(m if isinstance(m, Column) else F.lit(m)).cast("int") for m in more]))
    return F.concat(F.slice(key, F.lit(1), F.size(key) - 1), F.array(last))


#: The node types of each target, as one literal.
_TYPES = "map(" + ", ".join(f"'{t}', array({', '.join(repr(k) for k in kinds)})" for t, kinds in TARGETS.items()) + ")"


def _aim(a, selected: Column) -> Column:
    """The ids that an action names; one that aims at nothing works on what is selected."""
    named = F.coalesce(F.size(a["node_ids"]), F.lit(0)) > 0
    own = F.when(selected, F.array("node_id")).otherwise(F.array().cast("array<string>"))
    return F.when(named, a["node_ids"]).when(a["target"].isNotNull(), F.array().cast("array<string>")).otherwise(own)


def _hit(a, selected: Column) -> Column:
    """Ids come before the target, and the target before the selection."""
    ids = _aim(a, selected)
    return F.when(F.size(ids) > 0, F.array_contains(ids, F.col("node_id"))).otherwise(F.coalesce(F.array_contains(F.try_element_at(F.expr(_TYPES), a["target"]), F.col("type")), F.lit(False)))


def _single_step(default: float):
    style_step = R._step(default)

    def step(s: Column, a: Column) -> Column:
        selected = s["sel"] & ~a["opens"]
        hit, kind = _hit(a, selected), a["type"]
        own = kind.isin(R.REPLAYED) & hit
        plain = {f: a[f] for f in R.ACTION} | {"type": F.when(own, kind).otherwise("format"), "target": F.lit(None).cast("string"), "node_ids": F.when(own, F.array("node_id"))}
        done = style_step({"style": s["style"], "content": s["content"]}, plain)
        new = F.get(F.filter(a["edits"], lambda e: e["key"] == F.col("node_id")), F.lit(0))["value"]
        rewritten = (kind == "rewrite") & F.coalesce(F.trim(new) != "", F.lit(False))
        spaced = hit & (kind == "spacing")
        given = (("line_spacing", "line"), ("space_before_pt", "before_pt"), ("space_after_pt", "after_pt"))
        meta = F.when(spaced, _with_meta(s["meta"], **{f: F.coalesce(a[g], s["meta"][f]) for f, g in given})).otherwise(s["meta"])
        return F.struct(
            done["style"].alias("style"), F.when(rewritten, new).otherwise(done["content"]).alias("content"), meta.alias("meta"),
            F.when(kind == "rewrite", rewritten).otherwise(hit).alias("sel"),
        )

    return step


def _whole_style() -> Column:
    return F.struct(*[F.col(f"style.{f}").cast(t).alias(f) for f, t in STYLE.items()])


def _folded(default: float) -> tuple[Column, Column]:
    """Which rows have actions of single nodes to take, and their state after them. A version that failed is passed over, and
    the kept copy of a document does not follow the version that may fail."""
    passed = lambda a: ~a["seq"].eqNullSafe(F.col("_skip")) & ~(F.col("_old") & F.coalesce("risky", F.lit(False)) & a["seq"].eqNullSafe(F.col("x.seq")))
    zero = F.struct(_whole_style().alias("style"), F.col("content").alias("content"), F.col("meta").alias("meta"), F.col("_sel").alias("sel"))
    any_ = F.coalesce(F.size("single"), F.lit(0)) > 0
    return any_, F.element_at(F.array(F.when(any_, F.aggregate(F.filter("single", passed), zero, _single_step(default)))), 1)


def _ends(key: Column) -> Column:
    """The least key behind everything below a node."""
    return _behind(key, LEAST)


class Steps:
    """What is done to a wave's rows, written down once: waves with the same kinds of actions take the same steps, and building
    their expressions takes longer than running them on small documents."""

    def __init__(self, schema):
        self.schema, self.taken = schema, []

    def __getattr__(self, name):
        def take(*args, **options):
            self.taken.append((name, args, options))
            return self

        return take

    def __call__(self, rows: DataFrame) -> DataFrame:
        for name, args, options in self.taken:
            rows = getattr(rows, name)(*args, **options)
        return rows


def _structure(rows: Steps, kinds: set[str], columns: list[str]) -> Steps:
    """The wave's structural action of every document. Only what the wave's ``kinds`` need is in the plan."""
    x, kind, key, wave = F.col("x"), F.col("x.type"), F.col("_key"), F.col("wave")
    live = ~F.col("_old") & ~F.coalesce(x["seq"].eqNullSafe(F.col("_skip")), F.lit(False)) & x.isNotNull()
    document = Window.partitionBy("doc_id")
    order = Window.partitionBy("doc_id", "_old").orderBy("_key")
    so_far, all_rows = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("doc_id", "_old")
    rows = rows.withColumn("_sel", F.col("_sel") & ~F.coalesce(x["opens"], F.lit(False)))
    rows = rows.withColumn("_hit", F.coalesce(live & kind.isin(STRUCTURAL) & _hit(x, F.col("_sel")), F.lit(False)))
    hit = F.col("_hit")
    rows = rows.withColumns({"_nth": F.sum(hit.cast("int")).over(so_far), "_hits": F.sum(hit.cast("int")).over(document)})
    new, more = {"_sel": F.when(kind.isin("delete", "split", "insert"), False).when(kind.isin("merge"), hit & (F.col("_nth") == 1)).when(kind.isin("move", "list", "border"), hit).otherwise(F.col("_sel"))}, []
    gone, moved = F.lit(False), None
    failing = F.lit(False)

    if kinds & {"insert", "paste", "move"}:
        anchor = F.when(kind == "insert", F.coalesce(x["after_id"], F.get(x["node_ids"], F.lit(0)))).when(kind == "paste", x["after_id"]).when(kind == "move", x["to_id"])
        rows = rows.withColumn("_anchor", F.max(F.when(live & (F.col("node_id") == anchor), key)).over(all_rows))
        rows = rows.withColumn("_tail", live & F.lead(F.lit(1)).over(order).isNull())
    if kinds & {"delete", "move", "merge"}:
        taken = hit & (kind.isin("delete", "move") | ((kind == "merge") & (F.col("_nth") > 1)))
        rows = rows.withColumn("_over", F.max(F.when(taken, F.struct(_ends(key).alias("ends"), key.alias("root")))).over(so_far))
        below = F.coalesce(F.col("_over.ends") > key, F.lit(False))
        gone = live & kind.isin("delete", "merge") & below
        if "move" in kinds:
            at_root = x["to_id"] == F.col("doc_id").cast("string")
            target = F.when(at_root, F.array().cast(KEY)).otherwise(F.col("_anchor"))
            inside = F.max(F.when(live & (F.col("node_id") == x["to_id"]) & below, True)).over(all_rows)
            rows = rows.withColumns({"_to": F.when(kind == "move", target), "_inside": F.coalesce(inside, F.lit(False))})
            first = F.last(F.when(hit & (F.col("_over.root") == key), F.col("_nth")), True).over(so_far)
            rows = rows.withColumn("_place", first)
            moved = live & (kind == "move") & below & F.col("_to").isNotNull() & ~F.col("_inside")
            slot = F.array(F.array(F.lit(LAST), wave.cast("int"), F.col("_place").cast("int")))
            new["_key"] = F.when(moved, F.concat(F.col("_to"), slot, F.slice(key, F.size("_over.root") + 1, F.lit(1 << 30)))).otherwise(key)
            new["parent_id"] = F.when(moved & (F.col("_over.root") == key), x["to_id"]).otherwise(F.col("parent_id"))
    if "merge" in kinds:
        failing = failing | ((kind == "merge") & (F.col("_hits") < 2))
    if "insert" in kinds:
        failing = failing | ((kind == "insert") & ~F.coalesce(x["node_type"], F.lit("body")).isin(NODE_TYPES))
    if "border" in kinds:
        tables = F.coalesce(F.max(hit & (F.col("type") == "table")).over(document), F.lit(False))
        following = F.first(F.when(hit, key), True).over(order.rowsBetween(0, Window.unboundedFollowing))
        rows = rows.withColumns({"_tables": tables, "_next": following})
        bordered = live & (kind == "border") & (F.col("type") == "table") & F.when(F.col("_tables"), hit).otherwise(F.coalesce(F.col("_next") < _ends(key), F.lit(False)))
        new["meta"] = F.when(bordered, _with_meta(borders=_borders(x))).otherwise(F.col("meta"))
        new["_sel"] = F.when(kind == "border", bordered).otherwise(new["_sel"])
    if "split" in kinds:
        parts = F.filter(F.split("content", F.regexp_replace(F.coalesce(x["separator"], F.lit(". ")), r"([^\p{L}\p{N}\s])", r"\\$1"), -1), lambda p: F.trim(p) != "")
        rows = rows.withColumn("_parts", F.when(hit & (kind == "split"), F.transform(parts, lambda p: F.trim(p))))
        several = F.coalesce(F.size("_parts") >= 2, F.lit(False))
        new["content"] = F.when(several, F.get("_parts", F.lit(0))).otherwise(F.col("content"))
        made = lambda p, k: _node(_behind(key, -wave - 1, k + 1), new_id(F.lit("replay"), _edit(), F.col("node_id"), (k + 1).cast("string")), F.col("parent_id"), F.col("type"), p, _whole_style(), None, True)
        more.append(F.when(several, F.transform(F.slice("_parts", 2, 1 << 30), made)))
    if "list" in kinds:
        rows, listed, pieces, stays = _listed(rows, order, document)
        named = F.when(F.lower(F.coalesce(x["kind"], F.lit("bullet"))).isin(NUMBERED), "number").when(F.lower(x["kind"]).isin(PLAIN), F.lit(None).cast("string")).otherwise("bullet")
        level = F.least(F.greatest(F.coalesce(x["level"], F.lit(0)), F.lit(0)), F.lit(8))
        marked = _with_meta(list_kind=named, list_level=F.when(named.isNotNull(), level))
        plain = _with_meta(list_kind=F.lit(None).cast("string"), list_level=F.lit(None).cast("int"))
        cutting = listed & (F.size(pieces) > 0)
        leads = cutting & (stays != "")
        new["content"] = F.when(leads, stays).when(cutting, F.get(pieces, F.lit(0))).otherwise(new.get("content", F.col("content")))
        new["meta"] = F.when(leads, plain).when(listed, marked).otherwise(new.get("meta", F.col("meta")))
        new["_sel"] = F.when(kind == "list", listed).otherwise(new["_sel"])
        rest = F.when(leads, pieces).otherwise(F.slice(pieces, 2, 1 << 30))
        empty = F.lit(None).cast(rows.schema["meta"].dataType)
        item = lambda t, k: _node(_behind(key, -wave - 1, k + 1), new_id(F.lit("replay"), _edit(), F.col("node_id"), (k + 1).cast("string")), F.col("parent_id"), F.lit("body"), t, _whole_style(), _with_meta(empty, list_kind=named, list_level=level), True)
        more.append(F.when(cutting, F.transform(rest, item)))
    if "insert" in kinds:
        here = live & (kind == "insert") & ~failing & F.when(F.col("_anchor").isNotNull(), key == F.col("_anchor")).otherwise(F.col("_tail"))
        follows = F.col("_anchor").isNotNull()
        style = F.struct(*[(x[f] if f in ("bold", "italic", "underline", "color") else F.lit(None)).cast(t).alias(f) for f, t in STYLE.items()])
        born = _node(
            F.when(follows, _behind(key, -wave - 1, 1)).otherwise(F.array(F.array(F.lit(LAST), wave.cast("int"), F.lit(1)))), new_id(F.lit("replay"), _edit()),
            F.when(follows, F.col("parent_id")).otherwise(F.col("doc_id").cast("string")), F.coalesce(x["node_type"], F.lit("body")), F.coalesce(x["content"], F.lit("")), style, None, True,
        )
        more.append(F.when(here, F.array(born)))
    if "paste" in kinds:
        rows = rows.withColumn("_copy", F.sum(F.when(live & (kind == "paste") & F.col("_sel"), 1).otherwise(0)).over(so_far))
        copied = live & (kind == "paste") & F.col("_sel")
        place = F.when(F.col("_anchor").isNotNull(), _behind(F.col("_anchor"), -wave - 1, F.col("_copy"))).otherwise(F.array(F.array(F.lit(LAST), wave.cast("int"), F.col("_copy").cast("int"))))
        rows = rows.withColumn("_beside", F.max(F.when(live & (key == F.col("_anchor")), F.col("parent_id"))).over(all_rows))
        copy = _node(place, new_id(F.lit("replay"), _edit(), F.col("node_id")), F.coalesce("_beside", F.col("doc_id").cast("string")), F.col("type"), F.col("content"), _whole_style(), F.col("meta"), False)
        more.append(F.when(copied, F.array(copy)))

    keep = {c: new.get(c, F.col(c)) for c in columns}
    self = F.struct(*[v.alias(c) for c, v in keep.items() if c in _MADE])
    # where an action fails, the copy takes the document's place and the rest of the version is passed over
    if kinds & {"merge", "insert"}:
        skipped = x["seq"].eqNullSafe(F.col("_skip"))
        fails = F.coalesce(failing & F.col("may_fail") & ~skipped, F.lit(False))
        done = F.coalesce("last", F.lit(False))
        gone = F.when(fails, ~F.col("_old")).otherwise(gone | (done & F.col("_old")))
        rows = rows.withColumns({"_old": F.col("_old") & ~fails & ~done, "_skip": F.when(fails, x["seq"]).otherwise(F.col("_skip")), "_gone": gone})
        gone = F.col("_gone")
    pieces = F.concat(F.when(gone, F.array().cast(_array_of(rows))).otherwise(F.array(self.cast(_struct_of(rows)))), *[F.coalesce(m.cast(_array_of(rows)), F.array().cast(_array_of(rows))) for m in more])
    if "merge" in kinds:  # the texts of what merges, under the first node
        joined = F.col("_hits") >= 2
        rows = rows.withColumn("_texts", F.when(hit & (kind == "merge") & joined, F.col("content")))
        return _merged(rows, pieces, columns, hit & (kind == "merge") & joined)
    return rows.select(*[c for c in columns if c not in _MADE], F.explode(pieces).alias("_p")).select(*[f"_p.{c}" if c in _MADE else c for c in columns])


def _merged(rows: Steps, pieces: Column, columns: list[str], merging: Column) -> Steps:
    """The pieces, the nodes that merge being one group of their document, whose text is all of theirs in order."""
    out = rows.select(
        "doc_id", "_old", "_skip", F.when(merging, F.lit(None).cast(KEY)).otherwise(F.col("_key")).alias("_group"),
        F.col("_key").alias("_at"), F.when(merging, F.col("content")).alias("_text"), (merging & (F.col("_nth") == 1)).alias("_first"), pieces.alias("_pieces"),
    ).where((F.size("_pieces") > 0) | F.col("_text").isNotNull())
    grouped = out.groupBy("doc_id", "_old", "_skip", "_group").agg(
        F.min_by("_pieces", F.struct(~F.col("_first"), "_at")).alias("_pieces"), F.max("_first").alias("_first"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_text").isNotNull(), F.struct("_at", "_text")))), lambda t: t["_text"]), " ")).alias("_text"),
    )
    told = F.when(F.col("_first"), F.transform("_pieces", lambda p: p.withField("content", F.col("_text")))).otherwise(F.col("_pieces"))
    return grouped.select("doc_id", "_old", "_skip", F.explode(told).alias("_p")).select(*[f"_p.{c}" if c in _MADE else c for c in columns])


#: The columns of a node that an action may make.
_MADE = ["_key", "node_id", "parent_id", "type", "content", "style", "meta", "_sel"]


def _struct_of(rows: Steps) -> str:
    kinds = {c: rows.schema[c].dataType.simpleString() for c in _MADE if c != "style"} | {"style": "struct<" + ",".join(f"{f}:{t}" for f, t in STYLE.items()) + ">"}
    return "struct<" + ",".join(f"{c}:{kinds[c]}" for c in _MADE) + ">"


def _array_of(rows: Steps) -> str:
    return f"array<{_struct_of(rows)}>"


def _node(key, node_id, parent_id, kind, content, style, meta, selected: bool) -> Column:
    return F.struct(
        key.cast(KEY).alias("_key"), node_id.alias("node_id"), parent_id.alias("parent_id"), kind.alias("type"), content.alias("content"), style.alias("style"),
        (F.lit(None) if meta is None else meta).alias("meta"), F.lit(selected).alias("_sel"),
    )


def _edit() -> Column:
    return F.concat_ws(".", F.col("doc_id").cast("string"), F.col("x.seq").cast("string"), F.col("x.i").cast("string"))


def _with_meta(of: Column | None = None, **fields) -> Column:
    """The node's metadata (or ``of``) with the given fields; a node without any gets them alone."""
    base = F.col("meta") if of is None else of
    names = ["header_row", "list_kind", "list_level", "line_spacing", "space_before_pt", "space_after_pt", "borders", "page_index", "role"]
    kinds = ["boolean", "string", "int", "double", "double", "double", "map<string,double>", "int", "string"]
    return F.struct(*[(fields[n] if n in fields else base[n]).cast(k).alias(n) for n, k in zip(names, kinds)])


def _borders(x: Column) -> Column:
    """The widths of all edges: the named ones and no others, or all of one width."""
    even = F.create_map(*[F.lit(v) for s in border_widths([]) for v in (s, 0.5)])
    named = F.map_from_entries(F.array(*[F.struct(F.lit(s).alias("k"), F.coalesce(F.get(F.filter(x["sides"], lambda e: e["key"] == s), F.lit(0))["value"], F.lit(0.0)).alias("v")) for s in SIDES]))  # noqa: B023
    return F.when(F.coalesce(F.size(x["sides"]), F.lit(0)) > 0, named).otherwise(even)


def _listed(rows: Steps, order, document) -> tuple[Steps, Column, Column, Column]:
    """Which nodes of the wave's lists become items, what they are cut into, and what leads in."""
    x = F.col("x")
    making = F.col("x.type") == "list"
    off = F.coalesce(F.lower(x["kind"]).isin(PLAIN), F.lit(False))
    aimed = F.col("_hit") & making & ~is_type(["table", "table_row"])
    rows = rows.withColumns({"_aimed": aimed, "_other": F.coalesce(F.max(aimed & ~is_type(HEADINGS)).over(document), F.lit(False))})
    siblings = Window.partitionBy("doc_id", "_old", "parent_id").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_under", F.last(F.when(is_type(HEADINGS), F.col("_aimed")), True).over(siblings) & ~is_type(HEADINGS))
    rows = rows.withColumn("_aimed", F.when(F.col("_other"), F.col("_aimed")).otherwise(F.coalesce("_under", F.lit(False)) & making & ~F.col("_old") & ~F.coalesce(x["seq"].eqNullSafe(F.col("_skip")), F.lit(False))))
    text = F.col("_aimed") & ~off & is_type(TEXT)
    rows = rows.withColumns({"_text": text, "_cut": F.element_at(F.array(F.when(text, split_items(F.col("content")))), 1)})
    has = F.coalesce(F.size("_cut.items") > 0, F.lit(False))
    rows = rows.withColumn("_any", F.coalesce(F.max(has).over(document), F.lit(False)))
    colon = F.endswith(F.rtrim(F.col("content")), F.lit(":"))
    later = F.coalesce(F.max(F.col("_text") & ~colon).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(False))
    rows = rows.withColumn("_announces", F.col("_text") & colon & later)
    listed = F.when(off, F.col("_aimed")).otherwise(F.col("_text") & F.when(F.col("_any"), has).otherwise(~F.col("_announces")))
    items = F.when(listed & has & ~off, F.col("_cut.items")).otherwise(F.array().cast("array<string>"))
    return rows, F.coalesce(listed, F.lit(False)), items, F.coalesce("_cut.lead", F.lit(""))


def numbered(rows: DataFrame, levels: int) -> DataFrame:
    """Keys made plain paths again: 1, 2, 3 ... among siblings, on every level."""
    order = Window.partitionBy("doc_id").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.size("_key")
    counted = rows.withColumns({f"_c{n}": F.sum((depth == n).cast("int")).over(order) for n in range(1, levels + 1)})
    begun = counted.withColumns({f"_b{n}": F.last(F.when(depth < n, F.col(f"_c{n}")), True).over(order) for n in range(1, levels + 1)})
    path = F.array(*[(F.col(f"_c{n}") - F.coalesce(f"_b{n}", F.lit(0))).cast("int") for n in range(1, levels + 1)])
    checked = F.when(depth > levels, F.raise_error(F.lit("nodes lie deeper than the levels that are numbered")).cast("int")).otherwise(depth)
    return begun.withColumns({"sort_path": F.slice(path, F.lit(1), checked), "depth": depth})


def replay(nodes: DataFrame, actions: DataFrame, default: float = 11.0, waves_per_job: int = 3) -> DataFrame:
    """The node table with every document's stored actions applied in order of (seq, i).

    An action works on its ``node_ids``, else its ``target``, else on what the action before it in its version selected or
    touched. A version in which an action fails (a merge of fewer than two nodes, an insert of an unknown type) leaves its
    document as it was before that version. What is inserted after a node that does not exist comes last, and so does what
    is pasted; what moves (``to_id``: the new parent, the document's id for the top) comes last among the parent's children with
    all below it, and stays where it is if the parent does not exist or moves along. Of nodes that merge the first stays.
    Ids of new nodes are hashes of document, version, place and source.

    ``waves_per_job``: after so many structural actions the nodes are written to the checkpoint folder.

    Documents without nodes or without actions stay as they are, actions of unknown documents do nothing, repeated rows
    apply again and columns of ACTION that are missing count as null. Other columns than a node table's go.
    """
    waves = cut(logs(actions))  # read once for every wave, and else worked out anew each time
    plan = waves.groupBy("wave").agg(F.collect_set("x.type").alias("kinds"), F.max(F.size("single") > 0).alias("single"), F.max("begins").alias("begins")).collect()  # a row for each wave
    columns = ["doc_id", "_key", "node_id", "parent_id", "type", "content", "style", "meta", "_sel", "_old", "_skip"]
    # documents without actions are not dealt out
    marked = nodes.join(waves.select("doc_id").distinct().withColumn("_logged", F.lit(True)), "doc_id", "left")
    logged = marked.where("_logged").drop("_logged")
    levels = logged.agg(F.max("depth")).first()[0] or 1
    start = {"_key": F.transform("sort_path", lambda n: F.array(n.cast("int"))), "_sel": F.lit(False), "_old": F.lit(False), "_skip": F.lit(None).cast("long"), "style": _whole_style()}
    rows = logged.withColumns(start).select(columns).repartition("doc_id")
    any_single, state = _folded(default)
    ended: list[DataFrame] = []
    steps: dict[frozenset, Steps] = {}
    moves_below = waves.where("x.type = 'move' and x.to_id <> cast(doc_id as string)").limit(1).count() > 0
    for done, wave in enumerate(sorted(plan, key=lambda r: r["wave"])):
        if done and done % waves_per_job == 0:
            rows = cut(rows)
            # documents whose log has ended leave here
            more = waves.where(F.col("wave") >= wave["wave"]).select("doc_id").distinct()
            ended.append(numbered(rows.join(more, "doc_id", "left_anti").where("not _old"), levels))
            rows = rows.join(more, "doc_id", "left_semi")
        kinds = set(wave["kinds"])
        rows = rows.join(waves.where(F.col("wave") == wave["wave"]), "doc_id", "left")
        if wave["begins"]:
            both = F.when(F.coalesce("begins", F.lit(False)) & ~F.col("_old"), F.array(F.lit(False), F.lit(True))).otherwise(F.array("_old"))
            rows = rows.select(*[c for c in rows.columns if c != "_old"], F.explode(both).alias("_old"))
        if wave["single"]:
            rows = rows.withColumn("_state", state)
            rows = rows.withColumns({c: F.when(any_single, F.col(f"_state.{c.strip('_')}")).otherwise(F.col(c)) for c in ("style", "content", "meta", "_sel")})
        if kinds:
            if (key := frozenset(kinds)) not in steps:
                steps[key] = _structure(Steps(rows.schema), kinds, columns)
            rows = steps[key](rows)
        else:
            rows = rows.select(columns)
        levels *= 2 if "move" in kinds and moves_below else 1
    out = [c for c in ("doc_id", "node_id", "parent_id", "type", "sort_path", "depth", "content", "style", "meta") if c in nodes.columns]
    whole = numbered(rows.where("not _old"), levels).select(out)
    for part in ended:
        whole = whole.unionByName(part.select(out))
    return whole.unionByName(marked.where("_logged is null").withColumn("style", _whole_style()).select(out))
