"""Registered queries over the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import actions as A
from .operators import brief as B
from .operators import scope as S
from .schema import HEADINGS, TARGETS, is_type
from .sources.corpus import NODES_SQL, nodes, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def path_text():
    return F.array_join(F.transform("sort_path", lambda x: x.cast("string")), ".")


N = NODES_SQL


def query(name: str, sql: str | None = None, *, with_nodes: bool = True):
    """Registers a function of the node table (or of session and folder) under a name, with its SQL."""

    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(nodes(spark, sf_dir))) if with_nodes else f
        if sql:
            ORACLE_SQL[name] = (N + sql) if with_nodes else sql
        return f

    return add


def show(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("doc_id", path_text().alias("path"), *more)


def _in(types: list[str]) -> str:
    return "(" + ", ".join(f"'{t}'" for t in types) + ")"


# ---- scopes -------------------------------------------------------------------------------------------------------

query("walk", "SELECT doc_id, path, row_number() OVER (PARTITION BY doc_id ORDER BY p1, p2, p3) AS pos, type FROM nodes")(lambda n: show(S.preorder(n), "pos", "type"))
query("nodes_no_root", "SELECT doc_id, path, type, depth FROM nodes")(lambda n: show(n, "type", "depth"))
query("get_by_id", "SELECT doc_id, path, type, content FROM nodes WHERE path = '1' OR path = '2'")(lambda n: show(n.where(path_text().isin("1", "2")), "type", "content"))
query(
    "parent_of",
    "SELECT n.doc_id, n.path, n.type, coalesce(p.type, 'document') AS parent_type FROM nodes n LEFT JOIN nodes p ON p.doc_id = n.doc_id AND p.p1 = n.p1 AND ((n.depth = 2 AND p.depth = 1) OR (n.depth = 3 AND p.depth = 2))",
)(lambda n: show(S.parents(n), "type", "parent_type"))
query("find_by_types", f"SELECT doc_id, path, type FROM nodes WHERE type IN {_in(HEADINGS)}")(lambda n: show(S.of_types(n, HEADINGS), "type"))
query("table_header_cells", "SELECT c.doc_id, c.path, c.content FROM nodes c JOIN nodes r ON r.doc_id = c.doc_id AND r.p1 = c.p1 AND r.type = 'table_row' WHERE c.type = 'table_cell' AND r.header_row")(lambda n: show(S.resolve(n, "table_header"), "content"))
QUERIES["target_table_header"], ORACLE_SQL["target_table_header"] = QUERIES.pop("table_header_cells"), ORACLE_SQL.pop("table_header_cells")
_TITLE = """SELECT doc_id, path, type, content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p1, p2, p3) AS rn FROM nodes
 WHERE type NOT IN ('header', 'footer', 'page_break', 'horizontal_rule', 'table', 'table_row', 'table_cell', 'figure', 'image', 'caption', 'footnote') AND trim(content) <> '')
 WHERE rn = 1 AND (type IN ('heading', 'subheading') OR length(content) <= 250)"""
query("target_title", _TITLE)(lambda n: show(S.resolve(n, "title"), "type", "content"))


def _all_targets(n: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.array(*map(F.lit, types)).alias("types")) for t, types in TARGETS.items()]))
    return n.select("doc_id", "type", pairs.alias("p")).where(F.array_contains("p.types", F.col("type"))).groupBy("doc_id", F.col("p.target").alias("target")).agg(F.count("*").alias("n"))


query(
    "target_types",
    "SELECT doc_id, target, count(*) AS n FROM nodes JOIN (VALUES " + ", ".join(f"('{t}', '{x}')" for t, xs in TARGETS.items() for x in xs) + ") AS m(target, mtype) ON mtype = type GROUP BY 1, 2",
)(_all_targets)
query("resolve_target", "SELECT doc_id, path, type FROM nodes WHERE type IN ('body', 'paragraph')")(lambda n: show(S.resolve(n, "body"), "type"))
def _aims(n: DataFrame) -> DataFrame:
    """Actions of every document: ids (one of them unknown), classes, the title, the tables' heads, and one without an aim."""
    name = lambda path: F.concat_ws(".", F.col("doc_id").cast("string"), F.lit(path))
    ids = F.array(name("1"), name("3"), F.lit("nobody"), name("1"))
    none = F.lit(None).cast("array<string>")
    rows = [F.struct(F.lit(i).alias("i"), (ids if i == 0 else none).alias("node_ids"), F.lit(t).cast("string").alias("target")) for i, t in enumerate([None, "body", "title", "table_header", "nonsense", None])]
    return n.select("doc_id").distinct().select("doc_id", F.explode(F.array(*rows)).alias("a")).select("doc_id", "a.*")


query(
    "scope",
    """, t AS (SELECT doc_id, path, type, content, row_number() OVER (PARTITION BY doc_id ORDER BY p1, p2, p3) AS rn FROM nodes WHERE trim(content) <> '' AND type NOT IN ('header', 'footer', 'page_break', 'horizontal_rule', 'table', 'table_row', 'table_cell', 'figure', 'image', 'caption', 'footnote'))
 SELECT doc_id, 0 AS i, doc_id || '.' || path AS node_id FROM nodes WHERE path IN ('1', '3') UNION ALL SELECT doc_id, 1, doc_id || '.' || path FROM nodes WHERE type IN ('body', 'paragraph')
 UNION ALL SELECT doc_id, 2, doc_id || '.' || path FROM t WHERE rn = 1 AND (type IN ('heading', 'subheading') OR length(content) <= 250) UNION ALL SELECT doc_id, 3, doc_id || '.' || path FROM nodes WHERE type = 'table_cell' AND p1 % 2 = 1""",
)(lambda n: S.scope(n, _aims(n)))
query("known_ids_filter", "SELECT doc_id, path FROM nodes WHERE path IN ('1', '2')")(
    lambda n: S.keep_known(n, n.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.concat_ws(".", F.col("doc_id").cast("string"), F.lit(x)) for x in ("1", "2", "99999")])).alias("node_id"))).select("doc_id", F.substring_index("node_id", ".", -1).alias("path"))
)
query(
    "text_scope",
    "SELECT doc_id, path, type FROM nodes WHERE (depth = 1 AND type NOT IN ('table')) OR type = 'table_cell'",
)(lambda n: show(S.with_descendants(n, n.where("depth = 1")), "type"))
_HEAD = "last_value(CASE WHEN type IN ('heading', 'subheading') THEN p1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
query("section_under", f"SELECT doc_id, path, head FROM (SELECT doc_id, path, p1, {_HEAD}::VARCHAR AS head FROM nodes WHERE depth = 1) WHERE head IS NOT NULL AND head <> path")(
    lambda n: show(S.section_head(n.where("depth = 1")).where("head <> node_id"), "head").withColumn("head", F.substring_index("head", ".", -1))
)
query("expand_headings", f"SELECT doc_id, path, type FROM (SELECT doc_id, path, p1, type, {_HEAD}::VARCHAR AS head FROM nodes WHERE depth = 1) WHERE head = '1' AND path <> '1'")(
    lambda n: show(S.sections_of(n, n.where((path_text() == "1") & is_type(HEADINGS))), "type")
)
query("table_of", "SELECT doc_id, path, p1::VARCHAR AS table_path FROM nodes WHERE depth > 1")(
    lambda n: show(S.tables_of(n).join(n.select("doc_id", "node_id", "sort_path"), ["doc_id", "node_id"]), "table_id").select("doc_id", "path", F.substring_index("table_id", ".", -1).alias("table_path"))
)
query(
    "introduces_list",
    "SELECT doc_id, path FROM (SELECT doc_id, path, p1, rtrim(content) LIKE '%:' AS colon, max(CASE WHEN rtrim(content) LIKE '%:' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p1, p2, p3 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM nodes) WHERE colon AND later = 1",
)(lambda n: show(S.introduces_list(n)))
query("rewritable", f"SELECT doc_id, path, type FROM nodes WHERE type IN {_in(S.REWRITABLE)} AND trim(content) <> ''")(lambda n: show(S.rewritable(n), "type"))

# ---- actions ------------------------------------------------------------------------------------------------------

query("act_select", "SELECT doc_id, path, type, row_number() OVER (PARTITION BY doc_id ORDER BY p1, p2, p3) - 1 AS index, substr(content, 1, 80) AS preview FROM nodes WHERE type IN ('body', 'paragraph')")(
    lambda n: A.selected(n, is_type(TARGETS["body"])).join(n.select("doc_id", "node_id", "sort_path"), ["doc_id", "node_id"]).select("doc_id", path_text().alias("path"), "type", "index", "preview")
)
query("act_format", "SELECT doc_id, path, CASE WHEN type IN ('heading', 'subheading') THEN true ELSE italic END AS italic, CASE WHEN type IN ('heading', 'subheading') THEN false ELSE bold END AS bold, color FROM nodes")(
    lambda n: show(A.format_nodes(n, is_type(HEADINGS), italic=True, bold=False), "style.italic", "style.bold", "style.color")
)
query("fmt_apply_style", "SELECT doc_id, path, font_size, '#c00000' AS color, coalesce(bold, NULL) AS bold FROM nodes WHERE type = 'caption'")(
    lambda n: show(A.format_nodes(n, F.lit(True), color="#c00000").where("type = 'caption'"), "style.font_size", "style.color", "style.bold")
)
query("act_highlight", "SELECT doc_id, path, CASE WHEN type IN ('body', 'paragraph') THEN '#fff59d' ELSE highlight END AS highlight FROM nodes")(lambda n: show(A.highlight(n, is_type(TARGETS["body"])), "style.highlight"))
query("act_align", "SELECT doc_id, path, CASE WHEN type = 'caption' THEN 'center' ELSE alignment END AS alignment FROM nodes")(lambda n: show(A.align(n, F.col("type") == "caption", "center"), "style.alignment"))
query("act_justify", "SELECT doc_id, path, CASE WHEN type IN ('body', 'paragraph') THEN 'justify' ELSE alignment END AS alignment FROM nodes")(lambda n: show(A.align(n, is_type(TARGETS["body"]), "justify"), "style.alignment"))
query("act_resize", "SELECT doc_id, path, CASE WHEN type IN ('heading', 'subheading') THEN 12.0 ELSE font_size END::DOUBLE AS font_size FROM nodes")(lambda n: show(A.resize(n, is_type(HEADINGS), size=12.0), "style.font_size"))
query("act_resize_step", "SELECT doc_id, path, least(greatest(coalesce(font_size, 11.0) + 2, 4), 96)::DOUBLE AS font_size FROM nodes")(lambda n: show(A.resize(n, F.lit(True), size=2.0), "style.font_size"))
query("act_resize_scale", "SELECT doc_id, path, round_even(least(greatest(coalesce(font_size, 11.0) * 1.25, 4), 96), 1)::DOUBLE AS font_size FROM nodes")(lambda n: show(A.resize(n, F.lit(True), scale=1.25), "style.font_size"))
query("act_case", "SELECT doc_id, path, CASE WHEN type = 'heading' THEN upper(replace(content, 'ß', 'ss')) WHEN type = 'subheading' THEN lower(content) ELSE content END AS content FROM nodes")(
    lambda n: show(A.change_case(A.change_case(n, F.col("type") == "heading", "upper"), F.col("type") == "subheading", "lower"), "content")
)
query(
    "act_case_title",
    "SELECT doc_id, path, array_to_string(list_transform(string_split(content, ' '), lambda w: CASE WHEN length(w) > 1 AND w = upper(replace(w, 'ß', 'ss')) AND w <> lower(w) THEN w ELSE CASE WHEN substr(w, 1, 1) = 'ß' THEN 'Ss' ELSE upper(substr(w, 1, 1)) END || lower(substr(w, 2)) END), ' ') AS content FROM nodes WHERE type IN ('heading', 'subheading')",
)(lambda n: show(A.change_case(n, is_type(HEADINGS), "title").where(is_type(HEADINGS)), "content"))
_LOWERED = "array_to_string(list_transform(string_split(content, ' '), lambda w: CASE WHEN length(w) > 1 AND w = upper(replace(w, 'ß', 'ss')) AND w <> lower(w) THEN w ELSE lower(w) END), ' ')"
query(
    "act_case_sentence",
    rf"""SELECT doc_id, path, array_to_string(list_transform(regexp_extract_all({_LOWERED}, '[^.!?]*[.!?]|[^.!?]+$'),
  lambda s: regexp_extract(s, '^([^\pL\p{{Nd}}]*)', 1) || replace(upper(replace(regexp_extract(s, '^[^\pL\p{{Nd}}]*(\pL?)', 1), 'ß', 'ss')), 'ẞ', 'SS') || regexp_extract(s, '(?s)^[^\pL\p{{Nd}}]*\pL?(.*)$', 1)), '') AS content FROM nodes WHERE type IN ('heading', 'subheading')""",
)(lambda n: show(A.change_case(n, is_type(HEADINGS), "sentence").where(is_type(HEADINGS)), "content"))
query("act_spacing", "SELECT doc_id, path, CASE WHEN type IN ('body', 'paragraph') THEN 2.0 ELSE line_spacing END::DOUBLE AS line_spacing, CASE WHEN type IN ('body', 'paragraph') THEN 12.0 END::DOUBLE AS space_after_pt FROM nodes")(
    lambda n: show(A.spacing(n, is_type(TARGETS["body"]), line=2.0, after=12.0), "meta.line_spacing", "meta.space_after_pt")
)
query("act_border", "SELECT doc_id, path, 1.5::DOUBLE AS top, 1.5::DOUBLE AS bottom, 0.0::DOUBLE AS inside_v, 0.0::DOUBLE AS header FROM nodes WHERE type = 'table'")(
    lambda n: A.border(n, F.lit(True), sides=["upper", "lower"], heavy=True).where("type = 'table'").select("doc_id", path_text().alias("path"), *[F.col("meta.borders")[s].alias(s) for s in ("top", "bottom", "inside_v", "header")])
)
query("act_normalize", "SELECT doc_id, path, CASE WHEN type IN ('body', 'paragraph') THEN NULL ELSE highlight END AS highlight FROM nodes")(lambda n: show(A.normalise(n, is_type(TARGETS["body"])), "style.highlight"))
query("act_replace", "SELECT doc_id, path, CASE WHEN type IN ('body', 'paragraph') THEN replace(content, 'the', 'THE') ELSE content END AS content FROM nodes")(lambda n: show(A.replace(n, is_type(TARGETS["body"]), "the", "THE"), "content"))
query("act_rewrite", "SELECT doc_id, path, CASE WHEN p1 % 3 = 0 AND depth = 1 AND trim(content) <> '' THEN upper(replace(content, 'ß', 'ss')) ELSE content END AS content FROM nodes")(
    lambda n: show(A.rewrite(n, n.where((F.col("depth") == 1) & (F.col("sort_path")[0] % 3 == 0)).select("doc_id", "node_id", F.upper("content").alias("text"))), "content")
)
query("act_delete", "SELECT n.doc_id, n.path, n.type FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes t WHERE t.doc_id = n.doc_id AND t.p1 = n.p1 AND t.type IN ('table', 'caption') AND t.depth = 1)")(
    lambda n: show(A.delete(n, F.col("type").isin("table", "caption")), "type")
)
query("act_copy", "SELECT doc_id, path, row_number() OVER (PARTITION BY doc_id ORDER BY p1, p2, p3) - 1 AS place FROM nodes WHERE type = 'heading'")(lambda n: show(A.copied(n, F.col("type") == "heading"), "place"))
_TOP = "row_number() OVER (PARTITION BY doc_id ORDER BY {}) AS ord"
query("act_insert", f"SELECT doc_id, ord, type, content FROM (SELECT doc_id, type, content, {_TOP.format('p1, k')} FROM (SELECT doc_id, p1, 0 AS k, type, content FROM nodes WHERE depth = 1 UNION ALL SELECT doc_id, p1, 1, 'body', 'Inserted.' FROM nodes WHERE depth = 1 AND type = 'heading'))")(
    lambda n: A.insert(n, n.where("type = 'heading'"), "body", "Inserted.", "q").where("depth = 1").select("doc_id", F.col("sort_path")[0].alias("ord"), "type", "content")
)
query("act_paste", f"SELECT doc_id, ord, type, content FROM (SELECT doc_id, type, content, {_TOP.format('k, p1')} FROM (SELECT doc_id, p1, 0 AS k, type, content FROM nodes WHERE depth = 1 UNION ALL SELECT doc_id, p1, 1, type, content FROM nodes WHERE type = 'heading'))")(
    lambda n: A.paste(n, n.where("type = 'heading'")).where("depth = 1").select("doc_id", F.col("sort_path")[0].alias("ord"), "type", "content")
)
query("act_move", f"SELECT doc_id, ord, type, content FROM (SELECT doc_id, type, content, {_TOP.format('m, p1')} FROM (SELECT doc_id, p1, CASE WHEN type = 'reference' THEN 1 ELSE 0 END AS m, type, content FROM nodes WHERE depth = 1))")(
    lambda n: A.move_to_end(n, F.col("type") == "reference").where("depth = 1").select("doc_id", F.col("sort_path")[0].alias("ord"), "type", "content")
)
query(
    "act_merge",
    """, part AS (SELECT doc_id, min(p1) AS f, count(*) AS c, trim(string_agg(content, ' ' ORDER BY p1)) AS t FROM nodes WHERE type IN ('heading', 'subheading') GROUP BY 1)
 SELECT n.doc_id, path, type, CASE WHEN c > 1 AND p1 = f AND depth = 1 THEN t ELSE content END AS content FROM nodes n LEFT JOIN part USING (doc_id)
 WHERE c IS NULL OR c < 2 OR type NOT IN ('heading', 'subheading') OR p1 = f""",
)(lambda n: show(A.merge(n, is_type(HEADINGS)), "type", "content"))
query(
    "act_split",
    """, cut AS (SELECT doc_id, p1, type, content, list_transform(list_filter(string_split(content, '. '), lambda x: trim(x) <> ''), lambda x: trim(x)) AS parts FROM nodes WHERE depth = 1),
 parts AS (SELECT doc_id, p1, type, CASE WHEN type IN ('body', 'paragraph') AND len(parts) >= 2 THEN parts ELSE [content] END AS parts FROM cut),
 rows AS (SELECT doc_id, p1, type, unnest(parts) AS content, generate_subscripts(parts, 1) AS k FROM parts)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p1, k) AS ord, type, content FROM rows""",
)(lambda n: A.split(n, is_type(TARGETS["body"])).where("depth = 1").select("doc_id", F.col("sort_path")[0].alias("ord"), "type", "content"))
query("act_list")(lambda n: A.make_list(n, F.lit(True)).where("depth = 1").select("doc_id", F.col("sort_path")[0].alias("ord"), "type", "content", "meta.list_kind"))
query("act_batch_fused", "SELECT doc_id, path, CASE WHEN type IN ('heading', 'subheading') THEN round_even(least(greatest(coalesce(font_size, 11.0) * 1.25, 4), 96), 1) ELSE font_size END::DOUBLE AS font_size, CASE WHEN type IN ('heading', 'subheading') THEN '#1f4e79' ELSE color END AS color, CASE WHEN type IN ('body', 'paragraph') THEN 'justify' ELSE alignment END AS alignment FROM nodes")(
    lambda n: show(A.align(A.format_nodes(A.resize(n, is_type(HEADINGS), scale=1.25), is_type(HEADINGS), color="#1f4e79"), is_type(TARGETS["body"]), "justify"), "style.font_size", "style.color", "style.alignment")
)

# ---- briefs -------------------------------------------------------------------------------------------------------

_CNT = ", ".join(f"count(*) FILTER (WHERE type IN {_in(t)}) AS {k}" for k, t in B.PARTS.items())
query("agg_inventory", f"SELECT doc_id, {_CNT} FROM nodes GROUP BY 1")(B.inventory)
query("agg_type_counts", "SELECT doc_id, type, count(*) AS n FROM nodes GROUP BY 1, 2")(B.type_counts)
_MATHS = r"'\\[a-zA-Z]{2,}|\$[^$]+\$|\$\$|_\{|\^\{|≤|≥|∑|√'"
query("agg_maths_in", f"SELECT doc_id, type, count(*) AS n FROM nodes WHERE regexp_matches(content, {_MATHS}) GROUP BY 1, 2")(B.maths_in)
_SCHEME = r"""CASE WHEN type NOT IN ('heading', 'subheading') THEN NULL WHEN regexp_matches(trim(content), '^[IVXLCDM]+[.)]\s') THEN 'roman numerals (I., II., III.)' WHEN regexp_matches(trim(content), '^[0-9]+\.[0-9]+') THEN 'decimal (1.1, 1.2)'
 WHEN regexp_matches(trim(content), '^[0-9]+[.)]\s') THEN 'numbered (1., 2., 3.)' WHEN regexp_matches(trim(content), '(?i)^chapter\s+[0-9]+') THEN 'chapters' END"""
_CONV = rf"SELECT doc_id, arg_min(scheme, (p1, p2, p3)) FILTER (WHERE scheme IS NOT NULL) AS heading_numbering, CASE WHEN bool_or(regexp_matches(content, '\[[0-9]+\]')) THEN 'numbered, [n]' END AS citation_style FROM (SELECT *, {_SCHEME} AS scheme FROM nodes) GROUP BY 1"
query("agg_conventions", _CONV)(B.conventions)
_KIND = r"""SELECT doc_id, CASE WHEN regexp_matches(o, '^\s*abstract\b|abstract—|abstract-') OR contains(o, 'index terms') THEN 'research paper' WHEN c THEN 'thesis or book' WHEN r THEN 'report with references' ELSE 'document' END AS kind FROM (
 SELECT doc_id, lower(string_agg(CASE WHEN rn <= 12 THEN substr(content, 1, 200) END, ' ' ORDER BY rn)) AS o, bool_or(type IN ('heading', 'subheading') AND contains(lower(content), 'chapter')) AS c, bool_or(type = 'reference') AS r
 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p1, p2, p3) AS rn FROM nodes) GROUP BY 1)"""
query("agg_kind", _KIND)(B.kinds)
_SECTIONS = f""", m AS (SELECT DISTINCT doc_id, p1 FROM nodes WHERE regexp_matches(content, {_MATHS})),
 s AS (SELECT n.*, m.p1 IS NOT NULL AS maths, n.type IN ('heading', 'subheading') AS st, sum(CASE WHEN n.type IN ('heading', 'subheading') THEN 1 ELSE 0 END) OVER (PARTITION BY n.doc_id ORDER BY n.p1) AS sec FROM nodes n LEFT JOIN m ON m.doc_id = n.doc_id AND m.p1 = n.p1 WHERE depth = 1),
 sections AS (SELECT doc_id, sec::INTEGER AS section, max(CASE WHEN st THEN substr(content, 1, 80) END) AS heading, max(CASE WHEN st THEN CASE WHEN type = 'heading' THEN 1 ELSE 2 END END) AS level, max(CASE WHEN st THEN page_index END) + 1 AS page,
  coalesce(sum(CASE WHEN NOT st THEN len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) END), 0)::BIGINT AS words,
  count(*) FILTER (WHERE NOT st AND type IN ('body', 'paragraph')) AS paragraphs, count(*) FILTER (WHERE NOT st AND type = 'table') AS tables, count(*) FILTER (WHERE NOT st AND maths) AS maths,
  least(1 + count(*) FILTER (WHERE NOT st), 31) AS n_ids FROM s WHERE sec > 0 GROUP BY 1, 2)
"""
query("agg_sections", _SECTIONS + "SELECT * FROM sections")(
    lambda n: B.sections(n).select("doc_id", "section", "heading", "level", "page", "words", *[F.coalesce(F.col("holds")[k], F.lit(0)).alias(k) for k in ("paragraphs", "tables", "maths")], F.size("node_ids").alias("n_ids"))
)
query("topk_sections", _SECTIONS + "SELECT doc_id, section, heading, words, greatest(total - 25, 0) AS omitted FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM sections) WHERE section <= 25")(B.top_sections)
query("topk_outline", "SELECT doc_id, n, type, text FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p1) AS n, type, substr(content, 1, 60) AS text FROM nodes WHERE type IN ('heading', 'subheading')) WHERE n <= 40")(B.outline)
query(
    "document_brief",
    f", inv AS (SELECT doc_id, {_CNT} FROM nodes GROUP BY 1), k AS ({_KIND}), c AS ({_CONV}), sx AS (SELECT doc_id, count(*) AS sections FROM nodes WHERE depth = 1 AND type IN ('heading', 'subheading') GROUP BY 1) SELECT inv.*, k.kind, c.heading_numbering, c.citation_style, coalesce(sx.sections, 0) AS sections FROM inv JOIN k USING (doc_id) JOIN c USING (doc_id) LEFT JOIN sx USING (doc_id)",
)(B.brief)
query(
    "win_passes",
    """, items AS (SELECT doc_id, path, length(content) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY p1, p2, p3) AS rn FROM nodes),
 fold AS (SELECT doc_id, path, rn, n AS used, 1 AS pass FROM items WHERE rn = 1 UNION ALL
  SELECT i.doc_id, i.path, i.rn, CASE WHEN f.used > 0 AND f.used + i.n > 5000 THEN i.n ELSE f.used + i.n END, CASE WHEN f.used > 0 AND f.used + i.n > 5000 THEN f.pass + 1 ELSE f.pass END FROM fold f JOIN items i ON i.doc_id = f.doc_id AND i.rn = f.rn + 1)
 SELECT doc_id, path, pass FROM fold""",
)(lambda n: B.passes(n).select("doc_id", F.expr("substring(node_id, length(string(doc_id)) + 2)").alias("path"), "pass"))
ORACLE_SQL["win_passes"] = ORACLE_SQL["win_passes"].replace("WITH lines", "WITH RECURSIVE lines", 1)
query("win_section_id", "SELECT doc_id, path, sum(CASE WHEN type IN ('heading', 'subheading') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p1) AS section FROM nodes WHERE depth = 1")(
    lambda n: show(n.where("depth = 1").withColumn("section", F.sum(F.when(is_type(HEADINGS), 1).otherwise(0)).over(S.in_document())), "section")
)
query("win_preorder", "SELECT doc_id, path, row_number() OVER (PARTITION BY doc_id ORDER BY p1, p2, p3) AS pos FROM nodes")(lambda n: show(S.preorder(n), "pos"))
query("win_in_references", "SELECT doc_id, path, coalesce(max(CASE WHEN type = 'reference' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p1, p2, p3 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS in_references FROM nodes")(
    lambda n: show(n.withColumn("in_references", F.coalesce(F.max((F.col("type") == "reference").cast("int")).over(S.in_document().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1), "in_references")
)
