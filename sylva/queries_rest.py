"""The remaining registered queries: imports, specs, batches, page filling, more commands and functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import imports as I
from .functions import markup as M
from .operators import actions as A
from .operators import brief as B
from .operators import commands as C
from .operators import heuristics as HE
from .operators import library as L
from .operators import scope as S
from .operators import spec as PP
from .operators import terms as V
from .plans import batches as P
from .plans.replay import replay, since_checkpoint
from .plans.replies import edits_of
from .queries import N, ORACLE_SQL, _in, _SECTIONS, path_text, query, show
from .queries_more import _events, _log
from .schema import HEADINGS, TARGETS, is_type
from .shared import spread
from .sources import spec as X
from .sources.corpus import nodes, read

# ---- sources and sinks --------------------------------------------------------------------------------------------


def _specs(s, d) -> DataFrame:
    """Specs made of documents: a heading, a paragraph, an empty paragraph, a list and a table."""
    text = F.col("text")
    block = lambda kind, level=None, said=None, items=None, rows=None: F.struct(
        F.lit(kind).alias("type"), F.lit(level).cast("int").alias("level"), (said if said is not None else F.lit(None).cast("string")).alias("text"),
        (items if items is not None else F.lit(None).cast("array<string>")).alias("items"), F.lit(None).cast("array<string>").alias("columns"),
        (rows if rows is not None else F.lit(None).cast("array<array<string>>")).alias("rows"), F.lit(None).cast("string").alias("caption"),
    )
    spec = F.struct(F.col("source").alias("title"), F.array(
        block("heading", 1, F.substring(text, 1, 20)), block("paragraph", None, F.substr(text, F.lit(21))), block("paragraph", None, F.lit(" ")),
        block("list", None, None, F.array(F.col("lang"), F.col("source"))), block("table", None, None, None, F.array(F.array(F.col("lang"), F.col("source")))),
    ).alias("blocks"))
    return read(s, d, "documents").select("doc_id", F.to_json(spec).alias("spec"))


_SPEC = "SELECT doc_id, 1 AS pos, 'heading' AS type, substr(text, 1, 20) AS text FROM documents UNION ALL SELECT doc_id, 2, 'paragraph', substr(text, 21) FROM documents UNION ALL SELECT doc_id, 3, 'paragraph', ' ' FROM documents UNION ALL SELECT doc_id, 4, 'list', NULL FROM documents UNION ALL SELECT doc_id, 5, 'table', NULL FROM documents"
query("src_spec", _SPEC, with_nodes=False)(lambda s, d: X.spec_blocks(_specs(s, d)).select("doc_id", "pos", "type", "text"))
query("salvage_blocks", f"SELECT * FROM ({_SPEC}) WHERE type IN ('list', 'table') OR trim(text) <> ''", with_nodes=False)(lambda s, d: X.usable_blocks(X.spec_blocks(_specs(s, d))).select("doc_id", "pos", "type", "text"))
for _name in ("src_snapshot", "snk_snapshot"):
    query(_name, "SELECT doc_id, text, 'gz:' AS prefix FROM documents", with_nodes=False)(
        lambda s, d: X.in_small_batches(read(s, d, "documents")).select("doc_id", X.pack("text").alias("packed")).select("doc_id", X.unpack("packed").alias("text"), F.substring("packed", 1, 3).alias("prefix"))
    )
_BARE = "trim(translate(text, '*_`' || chr(9) || chr(10), ''))"  # emphasis marks within a text would be stripped as well
query("emp_strip", f"SELECT doc_id, {_BARE} AS t FROM documents WHERE {_BARE} <> ''", with_nodes=False)(
    lambda s, d: read(s, d, "documents").withColumn("t", F.trim(F.translate("text", "*_`\t\n", ""))).where("t <> ''").select("doc_id", X.strip_emphasis(F.concat(F.lit("**"), "t", F.lit("**"))).alias("t"))
)
query("lst_split_items")(lambda n: n.where("depth = 1 and type in ('body', 'paragraph')").select("doc_id", path_text().alias("path"), A.split_items(F.col("content")).alias("x")).select("doc_id", "path", "x.lead", F.size("x.items").alias("n")))
query("join_spans", "SELECT n.doc_id, n.path, coalesce(c, 0) AS spans FROM nodes n LEFT JOIN (SELECT doc_id, path, count(*) AS c FROM (SELECT doc_id, path, unnest(regexp_extract_all(content, '[0-9]+')) FROM nodes) GROUP BY 1, 2) x ON x.doc_id = n.doc_id AND x.path = n.path")(
    lambda n: show(n.join(n.select("doc_id", "node_id", F.explode(F.regexp_extract_all("content", F.lit("[0-9]+"), F.lit(0))).alias("text")).groupBy("doc_id", "node_id").agg(F.collect_list("text").alias("s")), ["doc_id", "node_id"], "left").withColumn("spans", F.greatest(F.coalesce(F.size("s"), F.lit(0)), F.lit(0))), "spans")
)

# ---- pages --------------------------------------------------------------------------------------------------------

PAGE = 700


def _height(content: Column) -> Column:
    return (F.ceil(F.length(content) / 80).cast("int") + 1) * 14


def _fill(n: DataFrame) -> DataFrame:
    """Top-level nodes dealt to pages by height; a page break ends its page."""
    items = F.array_sort(F.collect_list(F.struct("sort_path", (F.col("type") == "page_break").alias("brk"), _height(F.col("content")).alias("h"))))
    got = n.where("depth = 1").groupBy("doc_id").agg(items.alias("items"))
    zero = F.struct(F.lit(1).alias("page"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc, i):
        full = (acc["used"] > 0) & (acc["used"] + i["h"] > PAGE)
        page = F.when(full, acc["page"] + 1).otherwise(acc["page"])
        return F.struct(F.when(i["brk"], page + 1).otherwise(page).alias("page"), F.when(i["brk"], 0).when(full, i["h"]).otherwise(acc["used"] + i["h"]).alias("used"), F.concat(acc["out"], F.array(page)).alias("out"))

    got = got.withColumn("out", F.aggregate("items", zero, step, lambda acc: acc["out"]))
    return got.select("doc_id", F.explode(F.arrays_zip("items", "out")).alias("x")).select("doc_id", F.col("x.items.sort_path").alias("sort_path"), F.col("x.out").alias("page"))


query(
    "win_page_fill",
    f""", items AS (SELECT doc_id, path, type = 'page_break' AS brk, (ceil(length(content) / 80)::INTEGER + 1) * 14 AS h, row_number() OVER (PARTITION BY doc_id ORDER BY p1) AS rn FROM nodes WHERE depth = 1),
 fold AS (SELECT doc_id, path, rn, 1 AS page, CASE WHEN brk THEN 2 ELSE 1 END AS nxt, CASE WHEN brk THEN 0 ELSE h END AS used FROM items WHERE rn = 1 UNION ALL
  SELECT i.doc_id, i.path, i.rn, f.nxt + CASE WHEN f.used > 0 AND f.used + i.h > {PAGE} THEN 1 ELSE 0 END, f.nxt + CASE WHEN f.used > 0 AND f.used + i.h > {PAGE} THEN 1 ELSE 0 END + CASE WHEN i.brk THEN 1 ELSE 0 END,
   CASE WHEN i.brk THEN 0 WHEN f.used > 0 AND f.used + i.h > {PAGE} THEN i.h ELSE f.used + i.h END FROM fold f JOIN items i ON i.doc_id = f.doc_id AND i.rn = f.rn + 1)
 SELECT doc_id, path, page FROM fold""",
)(lambda n: show(_fill(n), "page"))
ORACLE_SQL["win_page_fill"] = ORACLE_SQL["win_page_fill"].replace("WITH lines", "WITH RECURSIVE lines", 1)


def _assign(s, d) -> DataFrame:
    """Each line's page by its first 24 characters: the first page from the current one on that holds them."""
    docs = read(s, d, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"), F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 1500)), lambda k: F.substr(F.col("text"), k * 1500 + 1, F.lit(1524))).alias("pages"))
    zero = F.struct(F.lit(1).alias("page"), F.array().cast("array<int>").alias("out"))

    def step(acc, line):
        probe = F.substring(line, 1, 24)
        hit = F.filter(F.sequence(acc["page"], F.size("pages")), lambda k: F.contains(F.element_at("pages", k), probe))
        page = F.coalesce(F.try_element_at(hit, F.lit(1)), acc["page"])
        return F.struct(page.alias("page"), F.concat(acc["out"], F.array(page)).alias("out"))

    return docs.select("doc_id", F.posexplode(F.aggregate("lines", zero, step, lambda acc: acc["out"])).alias("i", "page")).select("doc_id", (F.col("i") + 1).alias("pos"), "page")


for _name in ("win_page_assign", "join_page_probe"):
    query(
        _name,
        """WITH RECURSIVE docs AS (SELECT doc_id, string_split(text, chr(10)) AS lines, list_transform(range(0, (length(text) - 1) // 1500 + 1), lambda k: substr(text, k * 1500 + 1, 1524)) AS pages FROM documents),
 fold AS (SELECT doc_id, 0 AS pos, 1::BIGINT AS page FROM docs UNION ALL SELECT f.doc_id, f.pos + 1, coalesce(list_filter(range(f.page, len(d.pages) + 1), lambda k: contains(d.pages[k], substr(d.lines[f.pos + 1], 1, 24)))[1], f.page) FROM fold f JOIN docs d ON d.doc_id = f.doc_id WHERE f.pos < len(d.lines))
 SELECT doc_id, pos, page FROM fold WHERE pos > 0""",
        with_nodes=False,
    )(_assign)

# ---- batches ------------------------------------------------------------------------------------------------------

_TYPES = ["align", "resize", "case", "delete", "border", "format", "select"]
_AIMS = ["body", "heading", "nonsense", None, "table"]
_pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
_sql = lambda values: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _actions(s, d) -> DataFrame:
    e, i = read(s, d, "events"), F.col("event_id")
    return e.select(
        F.floor(i / 4).alias("batch"), (i % 4).cast("int").alias("i"), _pick(_TYPES, i % 7).alias("type"), _pick(_AIMS, i % 5).alias("target"), F.array().cast("array<string>").alias("node_ids"),
        F.when(i % 3 == 0, "left").alias("alignment"), F.when(i % 2 == 0, 12.0).alias("size"), F.when(i % 3 == 1, "upper").alias("kind"), (i % 11 == 0).alias("confirm"),
        F.when(i % 2 == 1, "bold").alias("style"), F.create_map(_pick(["top", "bottom", "left"], i % 3), (i % 5).cast("double")).alias("sides"),
    )


_ACT = f"WITH a AS (SELECT event_id // 4 AS batch, event_id % 4 AS i, {_sql(_TYPES)}[event_id % 7 + 1] AS type, {_sql(_AIMS)}[event_id % 5 + 1] AS target, event_id AS e FROM events) "
query(
    "validate_batch",
    _ACT + "SELECT batch, i::INTEGER AS i, (CASE WHEN target = 'nonsense' THEN 1 ELSE 0 END + CASE WHEN type <> 'select' AND target IS NULL THEN 1 ELSE 0 END + CASE WHEN type = 'align' AND e % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN type = 'resize' AND e % 2 <> 0 THEN 1 ELSE 0 END + CASE WHEN type = 'case' AND e % 3 <> 1 THEN 1 ELSE 0 END + CASE WHEN type = 'delete' AND target = 'body' AND e % 11 <> 0 THEN 1 ELSE 0 END)::INTEGER AS n FROM a",
    with_nodes=False,
)(lambda s, d: P.errors(_actions(s, d)).select("batch", "i", F.size("errors").alias("n")))
query("agg_merge_borders", _ACT + ", b AS (SELECT batch, target, ['top', 'bottom', 'left'][e % 3 + 1] AS side, (e % 5)::DOUBLE AS width, i FROM a WHERE type = 'border') SELECT batch, target, side, arg_max(width, i) AS width FROM b GROUP BY 1, 2, 3", with_nodes=False)(
    lambda s, d: P.merge_borders(_actions(s, d)).select("batch", "target", F.explode("sides").alias("side", "width"))
)
query("cmd_rules_not_type", _ACT + "SELECT batch, i::INTEGER AS i, type FROM (SELECT *, bool_or(type = 'border') OVER (PARTITION BY batch) AS b FROM a) WHERE NOT (b AND type = 'format' AND e % 2 = 1)", with_nodes=False)(
    lambda s, d: P.rules_are_not_type(_actions(s, d), F.lit("keep the borders bold")).select("batch", "i", "type")
)
query("fmt_style_source", _ACT + "SELECT batch, i::INTEGER AS i, coalesce(CASE WHEN e % 2 = 1 THEN 'bold' END, CASE WHEN e % 3 = 1 THEN 'upper' END, 'unset') AS patch FROM a WHERE type = 'format'", with_nodes=False)(
    lambda s, d: _actions(s, d).where("type = 'format'").select("batch", "i", F.coalesce("style", "kind", F.lit("unset")).alias("patch"))
)
query(
    "exec_atomic",
    """, f AS (SELECT doc_id, count(*) FILTER (WHERE type = 'caption') < 2 AS failed, min(p1) FILTER (WHERE type = 'caption') AS first, trim(string_agg(CASE WHEN type = 'caption' THEN content END, ' ' ORDER BY p1)) AS t FROM nodes GROUP BY 1)
 SELECT n.doc_id, path, CASE WHEN NOT failed AND type = 'caption' THEN t ELSE content END AS content, CASE WHEN NOT failed AND type = 'heading' THEN 'center' ELSE alignment END AS alignment FROM nodes n JOIN f USING (doc_id) WHERE failed OR type <> 'caption' OR p1 = first""",
)(
    lambda n: show(P.atomic(n, A.merge(A.align(n, F.col("type") == "heading", "center"), F.col("type") == "caption"), n.groupBy("doc_id").agg(F.count_if(F.col("type") == "caption").alias("c")).where("c < 2")), "content", "style.alignment")
)
query("exec_stream", "SELECT doc_id, 0 AS action, 'format_progress' AS event, count(*) AS n FROM nodes WHERE type IN ('heading', 'subheading') GROUP BY 1 UNION ALL SELECT doc_id, 1, 'format_progress', count(*) FROM nodes WHERE type = 'caption' GROUP BY 1")(
    lambda n: n.where(is_type([*HEADINGS, "caption"])).groupBy("doc_id", F.when(is_type(HEADINGS), 0).otherwise(1).alias("action"), F.lit("format_progress").alias("event")).agg(F.count("*").alias("n"))
)
query("scope_of", "SELECT doc_id, count(*) AS n FROM nodes WHERE type = 'table_cell' GROUP BY 1")(lambda n: S.resolve(n, "table_cell").groupBy("doc_id").agg(F.count("*").alias("n")))
query("act_render_maths", "SELECT doc_id, true AS render_maths FROM nodes GROUP BY 1 HAVING bool_or(contains(content, '$'))")(lambda n: n.groupBy("doc_id").agg(F.max(F.contains("content", F.lit("$"))).alias("render_maths")).where("render_maths"))
query(
    "cmd_outcome",
    "SELECT doc_id, CASE WHEN c > 0 THEN c || ' changed' WHEN r > 0 THEN 'the document already looks that way' ELSE 'nothing matched, so nothing changed' END AS outcome FROM (SELECT doc_id, count(*) FILTER (WHERE type = 'subheading') AS r, count(*) FILTER (WHERE type = 'subheading' AND coalesce(alignment, '') <> 'left') AS c FROM nodes GROUP BY 1)",
)(
    lambda n: n.groupBy("doc_id").agg(F.count_if(F.col("type") == "subheading").alias("r"), F.count_if((F.col("type") == "subheading") & ~F.col("style.alignment").eqNullSafe(F.lit("left"))).alias("c")).select("doc_id", P.outcome(F.col("r"), F.col("c")).alias("outcome"))
)

# ---- more commands ------------------------------------------------------------------------------------------------

_SIZED = """CASE p_partkey % 8 WHEN 0 THEN 'increase the headings by ' || p_size WHEN 1 THEN 'make the headings ' || p_size || ' points smaller' WHEN 2 THEN 'bump the captions +' || p_size WHEN 3 THEN 'change the references to font size ' || p_size
 WHEN 4 THEN 'set the ' || p_name || ' labels to ' || p_size || ' pt' WHEN 5 THEN 'make the ' || p_name || ' labels stand out' WHEN 6 THEN 'the ' || p_name || ' label is ' || p_size || ' units larger' ELSE 'reduce the ' || p_name || ' by ' || p_size || '.5 units' END"""
query(
    "cmd_size",
    """SELECT p_partkey AS event_id, CASE WHEN p_partkey % 8 IN (3, 4) THEN p_size END::DOUBLE AS absolute, CASE WHEN p_partkey % 8 = 5 THEN CASE WHEN p_name LIKE 'large %' THEN 1.25 WHEN p_name LIKE 'small %' THEN 0.8 END END::DOUBLE AS factor,
 CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 1 THEN -p_size WHEN 2 THEN p_size WHEN 6 THEN p_size WHEN 7 THEN -(p_size + 0.5) END::DOUBLE AS step FROM part""",
    with_nodes=False,
)(lambda s, d: read(s, d, "part").select(F.col("p_partkey").alias("event_id"), F.expr(_SIZED).alias("command")).select("event_id", C.size(F.col("command")).alias("x")).select("event_id", "x.*"))
_NAMED = "CASE p_partkey % 4 WHEN 0 THEN 'bold the word ' || p_name || ' wherever it appears' WHEN 1 THEN 'italicise the phrase \"' || p_name || '\" in the captions' WHEN 2 THEN 'underline every mention of ' || split_part(p_name, ' ', 1) || ' in the text' ELSE 'make the headings bold' END"
query(
    "cmd_phrase",
    rf"""WITH c AS (SELECT p_partkey, {_NAMED} AS command FROM part), f AS (SELECT p_partkey, trim(regexp_extract(command, '["“'']([^"”'']{{1,80}})["”'']', 1)) AS quoted,
 trim(string_split_regex(regexp_extract(command, '(?i)\b({"|".join(C.NAMING)})s?\s+([A-Za-z0-9].*)', 2), '(?i)\s+({"|".join(C.GOES_ON)})\b|[,.;:]')[1]) AS named,
 trim(string_split_regex(regexp_extract(command, '(?i)\bevery\s+({"|".join(C.MENTIONS)})\s+of\s+(.+)', 2), '(?i)\s+in\b|[,.;:]')[1]) AS every FROM c)
 SELECT p_partkey, coalesce(CASE WHEN quoted <> '' AND len(string_split_regex(quoted, '\s+')) <= 8 THEN quoted END, CASE WHEN named <> '' AND length(named) <= {C.PHRASE_CHARS} AND len(string_split_regex(named, '\s+')) <= 8 THEN named END,
 CASE WHEN every <> '' AND length(every) <= {C.PHRASE_CHARS} AND len(string_split_regex(every, '\s+')) <= 8 THEN every END) AS phrase FROM f""",
    with_nodes=False,
)(lambda s, d: read(s, d, "part").select("p_partkey", F.expr(_NAMED).alias("command")).select("p_partkey", C.phrase(F.col("command")).alias("phrase")))
#: Requests about a table's edges, with the sides and the width that each means.
_EDGED = [
    ("change table style to only upper and lower borders bold", ["top", "bottom"], 1.5), ("remove all borders from the table", [], 0.0), ("only the outer border of the table", ["outside"], 0.5),
    ("make the table borders thin", [], 0.5), ("remove the table gridlines", [], 0.0), ("no vertical lines in the table", ["top", "bottom", "left", "right", "inside_h"], 0.5),
    ("keep only the top and bottom borders, removing the left and right", ["top", "bottom"], 0.5), ("keep all the top and bottom borders", ["bottom", "inside_h", "top"], 0.5),
    ("top and bottom borders, no verticals", ["top", "bottom"], 0.5), ("add a rule under the header row", ["header"], 0.5), ("bold the header row border and the last bottom one", ["header", "bottom"], 1.5),
    ("heavy horizontal borders", ["bottom", "inside_h", "top"], 1.5), ("draw the inner lines and the left edge of the table", ["left", "inside"], 0.5), ("borders without the outside", ["inside_h", "inside_v"], 0.5),
]
query(
    "cmd_borders",
    f"SELECT p_partkey, {'[' + ', '.join(str(sides) for _, sides, _ in _EDGED) + ']'}[p_partkey % {len(_EDGED)} + 1]::VARCHAR[] AS sides, {[w for *_, w in _EDGED]}[p_partkey % {len(_EDGED)} + 1]::DOUBLE AS width FROM part",
    with_nodes=False,
)(lambda s, d: spread(read(s, d, "part")).select("p_partkey", HE.borders(F.concat(F.lit("For the "), "p_name", F.lit(" table, please: "), _pick([c for c, *_ in _EDGED], F.col("p_partkey") % len(_EDGED)))).alias("b")).select("p_partkey", "b.sides", "b.width"))
_SIZED_NAME = "split_part(p_name, ' ', 1) IN ('small', 'large')"
#: Commands about a part's name, with what each asks for: SQL over part that says so.
_ASKED = [
    ("'make all the headings bold'", {"type": "'format'", "target": "'heading'", "bold": "true"}),
    (  # a word for more or less in the name asks for a size, which comes before a style
        "'bold the word ' || p_name || ' wherever it appears'",
        {"type": f"CASE WHEN {_SIZED_NAME} THEN 'resize' ELSE 'format' END", "target": f"CASE WHEN {_SIZED_NAME} THEN 'body' ELSE 'document' END", "bold": f"CASE WHEN NOT {_SIZED_NAME} THEN true END",
         "find": f"CASE WHEN NOT {_SIZED_NAME} THEN p_name END", "scale": "CASE split_part(p_name, ' ', 1) WHEN 'small' THEN 0.8 WHEN 'large' THEN 1.25 END"},
    ),
    ("'delete the phrase \"' || p_name || '\"'", {"type": "'replace'", "target": "'document'", "find": "p_name", "put": "''"}),
    ("'highlight every mention of ' || p_name || ' in the text'", {"type": "'highlight'", "target": "'document'", "find": "p_name", "color": "'#fff59d'"}),
    ("'remove the highlighting'", {"type": "'format'", "target": "'document'", "highlight": "''"}),
    (
        "'colour the ' || p_name || ' captions'",
        {"type": "CASE WHEN split_part(p_name, ' ', 1) IN ('small', 'large') THEN 'resize' WHEN split_part(p_name, ' ', 1) IN ('red', 'blue') THEN 'format' ELSE 'rewrite' END", "target": "'caption'",
         "color": "CASE split_part(p_name, ' ', 1) WHEN 'red' THEN '#c00000' WHEN 'blue' THEN '#1f4e79' END", "scale": "CASE split_part(p_name, ' ', 1) WHEN 'small' THEN 0.8 WHEN 'large' THEN 1.25 END",
         "instruction": "CASE WHEN split_part(p_name, ' ', 1) NOT IN ('small', 'large', 'red', 'blue') THEN 'colour the ' || p_name || ' captions' END"},
    ),
    ("'sentence case the captions'", {"type": "'case'", "target": "'caption'", "kind": "'sentence'"}),
    ("'double space the document'", {"type": "'spacing'", "target": "'body'", "line": "2.0"}),
    ("'increase the space between paragraphs to ' || p_size || ' pt'", {"type": "'spacing'", "target": "'paragraph'", "after_pt": "p_size"}),
    ("'no vertical lines in the table'", {"type": "'border'", "target": "'table'", "sides": "['top', 'bottom', 'left', 'right', 'inside_h']", "width": "0.5"}),
    ("'remove the horizontal lines'", {"type": "'delete'", "target": "'horizontal_rule'"}),
    ("'number the introduction'", {"type": "'list'", "target": "'body'", "kind": "'number'"}),
    ("'put the contributions in bullets'", {"type": "'list'", "target": "'body'", "kind": "'bullet'"}),
    ("'remove the double spaces'", {"type": "'rewrite'", "target": "'document'", "instruction": "'remove the double spaces'"}),
    ("'delete the second paragraph'", {"type": "'rewrite'", "target": "'paragraph'", "instruction": "'delete the second paragraph'"}),
    ("'align the captions to the left'", {"type": "'align'", "target": "'caption'", "alignment": "'left'"}),
    ("'make the headings ' || p_size || ' points smaller'", {"type": "'resize'", "target": "'heading'", "delta": "-p_size"}),
    ("'change the references font to Times New Roman'", {"type": "'format'", "target": "'reference'", "font_family": "'Times New Roman'"}),
    ("'make the headings in the table bold'", {"type": "'format'", "target": "'table_header'", "bold": "true"}),
    ("'show me the figures'", {"type": "'select'", "target": "'figure'"}),
    ("'make the notation of ' || p_brand || ' consistent'", {"type": "'rewrite'", "target": "'body'", "instruction": "'make the notation of ' || p_brand || ' consistent'"}),
]
_HAS = {"type": "VARCHAR", "target": "VARCHAR", "kind": "VARCHAR", "alignment": "VARCHAR", "color": "VARCHAR", "highlight": "VARCHAR", "bold": "BOOLEAN", "font_family": "VARCHAR", "find": "VARCHAR", "put": "VARCHAR", "delta": "DOUBLE", "scale": "DOUBLE", "line": "DOUBLE", "after_pt": "DOUBLE", "sides": "VARCHAR[]", "width": "DOUBLE", "instruction": "VARCHAR"}
_asked_sql = lambda f: " ".join(f"WHEN {k} THEN {said[f]}" for k, (_, said) in enumerate(_ASKED) if f in said)
query("cmd_heuristic", "SELECT p_partkey, " + ", ".join(f"(CASE p_partkey % {len(_ASKED)} {_asked_sql(f)} END)::{t} AS {f}" for f, t in _HAS.items()) + " FROM part", with_nodes=False)(
    lambda s, d: HE.actions(spread(read(s, d, "part")).select("p_partkey", F.expr(f"CASE p_partkey % {len(_ASKED)} " + " ".join(f"WHEN {k} THEN {c}" for k, (c, _) in enumerate(_ASKED)) + " END").alias("command"))).select("p_partkey", *_HAS)
)
#: Other names of styles.
ALIASES = {"ieee conference": "ieee", "ieeetran": "ieee", "homework": "assignment", "coursework": "assignment", "lab report": "assignment", "formal": "assignment"}
query("style_alias", "SELECT c_custkey, CASE ['ieeetran', ' Homework ', 'apa', 'formal'][c_custkey % 4 + 1] WHEN 'ieeetran' THEN 'ieee' WHEN 'apa' THEN 'apa' ELSE 'assignment' END AS style FROM customer", with_nodes=False)(
    lambda s, d: read(s, d, "customer").withColumn("k", F.lower(F.trim(_pick(["ieeetran", " Homework ", "apa", "formal"], F.col("c_custkey") % 4)))).select("c_custkey", F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[F.col("k")], F.col("k")).alias("style"))
)

# ---- composition --------------------------------------------------------------------------------------------------

query("spec_equation", r"SELECT doc_id, path, row_number() OVER (PARTITION BY doc_id ORDER BY p1, p2, p3) AS number FROM nodes WHERE contains(content, '$')")(
    lambda n: n.where(F.contains("content", F.lit("$"))).select("doc_id", path_text().alias("path"), F.row_number().over(S.in_document()).alias("number"))
)
query("spec_figure", "SELECT doc_id, path, number FROM (SELECT doc_id, path, content, row_number() OVER (PARTITION BY doc_id ORDER BY p1) AS number FROM nodes WHERE type = 'figure') WHERE length(content) > 80")(
    lambda n: n.where("type = 'figure'").withColumn("number", F.row_number().over(S.in_document())).where(F.length("content") > 80).select("doc_id", path_text().alias("path"), "number")
)
query("spec_code", "SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))", with_nodes=False)(
    lambda s, d: read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("pos"), "line")
)
query("spec_sections", _SECTIONS + "SELECT doc_id, section, CASE WHEN section = 2 THEN 'Replaced' ELSE heading END AS heading FROM sections")(lambda n: B.sections(n).select("doc_id", "section", F.when(F.col("section") == 2, "Replaced").otherwise(F.col("heading")).alias("heading")))
_OKINDS = ["Research paper", "a report", "grant", "essay", "memo", "poem"]


query("spec_outline", f"SELECT p_partkey, {[o for _, o in PP.OUTLINES] + [PP.OTHER_OUTLINE]}[p_partkey % 6 + 1] AS outline FROM part", with_nodes=False)(
    lambda s, d: read(s, d, "part").select("p_partkey", PP.outline(_pick(_OKINDS, F.col("p_partkey") % 6)).alias("outline"))
)


def palette_score(text: Column, needle: str) -> Column:
    """How well the needle's letters stand in the text, in order: three for one that begins a word, one for others, and
    more for shorter texts; nothing if one is missing. Each letter is looked for after the one before."""
    t = F.lower(text)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("points"), F.lit(True).alias("ok"))
    acc = zero
    for c in needle.lower().replace(" ", ""):
        at = F.instr(F.substr(t, acc["at"] + 1), c)
        place = acc["at"] + at
        begins = (place == 1) | (F.substr(t, place - 1, F.lit(1)) == " ")
        acc = F.struct(place.alias("at"), (acc["points"] + F.when(begins, 3.0).otherwise(1.0)).alias("points"), (acc["ok"] & (at > 0)).alias("ok"))
    return F.when(acc["ok"], acc["points"] + F.greatest(F.lit(0.0), 20 - F.length(t) / 4)).otherwise(0.0)


query(
    "sort_palette",
    """WITH a AS (SELECT item_id, lower(text) AS t, instr(lower(text), 'e') AS p FROM benchmark), b AS (SELECT *, instr(substr(t, p + 1), 'n') AS q FROM a) SELECT item_id, CASE WHEN p > 0 AND q > 0 THEN CASE WHEN p = 1 OR substr(t, p - 1, 1) = ' ' THEN 3.0 ELSE 1.0 END + CASE WHEN substr(t, p + q - 1, 1) = ' ' THEN 3.0 ELSE 1.0 END + greatest(0, 20 - length(t) / 4) ELSE 0 END::DOUBLE AS score FROM b""",
    with_nodes=False,
)(lambda s, d: read(s, d, "benchmark").select("item_id", palette_score(F.col("text"), "e n").alias("score")))

# ---- import heuristics --------------------------------------------------------------------------------------------

_FIG = "CASE p1 % 5 WHEN 0 THEN 'Figure 1. ' || content WHEN 1 THEN 'Figure 1 shows ' || content WHEN 2 THEN '[PLACEHOLDER — Fig. 2: ' || content WHEN 3 THEN 'Abstract— ' || content ELSE 'Keywords: ' || content END"
_fig = lambda: _pick(["Figure 1. ", "Figure 1 shows ", "[PLACEHOLDER — Fig. 2: ", "Abstract— ", "Keywords: "], F.col("sort_path")[0] % 5)
query("fn_is_caption", f"SELECT doc_id, path, p1 % 5 IN (0, 2) AND length(trim({_FIG})) <= 400 AS caption FROM nodes WHERE type = 'body'")(lambda n: n.where("type = 'body'").select("doc_id", path_text().alias("path"), I.is_caption(F.concat(_fig(), "content")).alias("caption")))
query("fn_named_part", "SELECT doc_id, path, CASE p1 % 5 WHEN 3 THEN 'abstract' WHEN 4 THEN 'keywords' END AS part FROM nodes WHERE type = 'body'")(lambda n: n.where("type = 'body'").select("doc_id", path_text().alias("path"), I.named_part(F.concat(_fig(), "content")).alias("part")))
query("fn_reference_hint", "SELECT doc_id, path FROM nodes WHERE contains(lower(content || CASE WHEN p1 % 9 = 0 THEN ' References' ELSE '' END), 'reference') OR contains(lower(content), 'bibliography') OR contains(lower(content), 'works cited')")(
    lambda n: show(n.where(I.heads_references(F.concat("content", F.when(F.col("sort_path")[0] % 9 == 0, " References").otherwise("")))))
)
_HK = r"""SELECT doc_id, path, CASE WHEN no OR NOT (coalesce(bold, false) OR bigger OR shouted) OR NOT (sub OR tp OR bigger OR shouted) THEN NULL WHEN sub THEN 'subheading' WHEN tp OR much OR shouted THEN 'heading' ELSE 'subheading' END AS kind FROM (
 SELECT *, line = '' OR length(line) > 90 OR len(list_filter(string_split_regex(line, '\s+'), lambda w: w <> '')) > 14 OR regexp_matches(line, '(?i)^(fig\.|figure|table|eq\.|equation|algorithm|appendix\s+\w+\s*[:.]?\s*\S)') OR regexp_matches(line, '\$|[=≈≤≥±×÷∑∏∫√∞]|\|\||_\{|\^\{|[a-zA-Z]_[a-z0-9]\b') OR (regexp_matches(line, '[.?!;,]$') AND NOT (sub OR tp)) AS no FROM (
 SELECT *, regexp_matches(line, '^([0-9]+\.[0-9]+|[ABCDEFGHJKLMNOPQRSTUWYZ][.)]\s|[IVXLCDM]+-[A-Z0-9]\b)') AS sub, regexp_matches(line, '^([IVXLCDM]+|[0-9]+)[.)]\s') AND NOT regexp_matches(line, '^([0-9]+\.[0-9]+|[ABCDEFGHJKLMNOPQRSTUWYZ][.)]\s|[IVXLCDM]+-[A-Z0-9]\b)') AS tp,
  coalesce(font_size >= 10.5, false) AS bigger, coalesce(font_size >= 12, false) AS much, replace(line, 'ß', 'ss') = upper(replace(line, 'ß', 'ss')) AND line <> lower(line) AND NOT contains(line, 'ß') AND length(line) > 3 AS shouted FROM (
 SELECT *, trim(CASE p1 % 4 WHEN 0 THEN 'II. ' || content WHEN 1 THEN '2.1 ' || content WHEN 2 THEN upper(replace(content, 'ß', 'ss')) ELSE content END) AS line FROM nodes WHERE depth = 1)))"""
query("fn_heading_kind", _HK)(
    lambda n: n.where("depth = 1").withColumn("p", F.col("sort_path")[0] % 4).withColumn("line", F.when(F.col("p") == 0, F.concat(F.lit("II. "), "content")).when(F.col("p") == 1, F.concat(F.lit("2.1 "), "content")).when(F.col("p") == 2, F.upper("content")).otherwise(F.col("content"))).select("doc_id", path_text().alias("path"), I.heading_kind(F.col("line"), F.col("style.bold"), F.col("style.font_size"), 10.0).alias("kind"))
)
_STY = ["Title", "Heading 1", "heading 3", "Caption", "Footnote Text", "Normal"]
query("fn_style_class", f"SELECT p_partkey, CASE ['t', 'h', 's', 'c', 'f', 'n'][p_partkey % 6 + 1] WHEN 't' THEN 'heading' WHEN 'h' THEN 'heading' WHEN 's' THEN 'subheading' WHEN 'c' THEN 'caption' WHEN 'f' THEN CASE WHEN p_partkey % 4 = 0 THEN 'reference' ELSE 'footnote' END ELSE CASE WHEN p_partkey % 4 = 0 THEN 'reference' ELSE 'body' END END AS kind FROM part", with_nodes=False)(
    lambda s, d: read(s, d, "part").select("p_partkey", I.style_class(_pick(_STY, F.col("p_partkey") % 6), F.col("p_partkey") % 4 == 0).alias("kind"))
)
query("fn_relative_date", "SELECT o_orderkey, CASE WHEN n <= 0 THEN 'Today' WHEN n = 1 THEN 'Yesterday' ELSE n || ' days ago' END AS shown FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') AS n FROM orders)", with_nodes=False)(
    lambda s, d: read(s, d, "orders").select("o_orderkey", I.relative_date(F.to_date("o_orderdate"), F.lit("1998-08-02").cast("date")).alias("shown"))
)
query("fn_drop_nulls", "SELECT doc_id, path, (CASE WHEN color IS NULL THEN 0 ELSE 1 END + CASE WHEN alignment IS NULL THEN 0 ELSE 1 END)::INTEGER AS n FROM nodes")(
    lambda n: n.select("doc_id", path_text().alias("path"), F.size(F.map_filter(F.create_map(F.lit("color"), F.col("style.color"), F.lit("alignment"), F.col("style.alignment")), lambda _, v: v.isNotNull())).alias("n"))
)

# ---- events -------------------------------------------------------------------------------------------------------

query("str_room_fanout", "SELECT user_id AS doc_id, count(*) AS delivered FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1", with_nodes=False)(
    lambda s, d: _events(s, d).join(read(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("long").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("delivered"))
)
query("str_progress", ORACLE_SQL["win_passes"].replace("SELECT doc_id, path, pass FROM fold", "SELECT doc_id, pass, max(max(pass)) OVER (PARTITION BY doc_id) AS total, count(*) AS ids FROM fold GROUP BY 1, 2").removeprefix(N))(
    lambda n: B.passes(n).groupBy("doc_id", "pass").agg(F.count("*").alias("ids")).withColumn("total", F.max("pass").over(Window.partitionBy("doc_id")))
)
ORACLE_SQL["str_progress"] = ORACLE_SQL["win_passes"].replace("SELECT doc_id, path, pass FROM fold", "SELECT doc_id, pass, max(max(pass)) OVER (PARTITION BY doc_id) AS total, count(*) AS ids FROM fold GROUP BY 1, 2")
query("str_command_log", "SELECT user_id AS doc_id, event_type AS label, count(*) AS n FROM events GROUP BY 1, 2", with_nodes=False)(lambda s, d: _events(s, d).groupBy("doc_id", F.col("event").alias("label")).agg(F.count("*").alias("n")))

# ---- replay from stored actions, replies, spelled-out terms ---------------------------------------------------------


def _stored_actions(s, d) -> DataFrame:
    """An action for every event of a user, who stands for a document: its kind follows from its version and document."""
    k = (F.col("seq") + F.col("doc_id")) % 5
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), k.cast("int") + 1)
    no = None
    return _log(s, d).select(
        "doc_id", "seq", F.lit(0).alias("i"), pick("resize", "align", "replace", "resize", "highlight").alias("type"), pick("heading", "body", "document", "document", "subheading").alias("target"),
        pick(1.25, no, no, no, no).alias("scale"), pick(no, no, no, 2.0, no).alias("delta"), pick(no, "right", no, no, no).alias("alignment"), pick(no, no, "and", no, no).alias("find"), pick(no, no, "&", no, no).alias("put"),
    )


_DOCUMENT = _in(TARGETS["document"])
query(
    "ver_replay",
    N.replace("WITH lines", "WITH RECURSIVE lines", 1) + f""", v AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events), b AS (SELECT doc_id, max(seq) // 10 * 10 AS base FROM v GROUP BY 1),
 l AS (SELECT doc_id, seq - base AS k, (seq + doc_id) % 5 AS what FROM v JOIN b USING (doc_id) WHERE seq > base),
 r AS (SELECT doc_id, path, type, font_size, alignment, highlight, content, 0::BIGINT AS k FROM nodes UNION ALL
 SELECT r.doc_id, path, type, CASE WHEN what = 0 AND type = 'heading' THEN round_even(least(greatest(coalesce(font_size, 11.0) * 1.25, 4), 96), 1) WHEN what = 3 AND type IN {_DOCUMENT} THEN round_even(least(greatest(coalesce(font_size, 11.0) + 2, 4), 96), 1) ELSE font_size END::DOUBLE,
 CASE WHEN what = 1 AND type IN ('body', 'paragraph') THEN 'right' ELSE alignment END, CASE WHEN what = 4 AND type = 'subheading' THEN '{A.HIGHLIGHT}' ELSE highlight END,
 CASE WHEN what = 2 AND type IN {_DOCUMENT} THEN replace(content, 'and', '&') ELSE content END, r.k + 1 FROM r JOIN l ON l.doc_id = r.doc_id AND l.k = r.k + 1)
 SELECT doc_id, path, font_size::DOUBLE AS font_size, alignment, highlight, content FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY k DESC) = 1""",
    with_nodes=False,
)(lambda s, d: show(replay(nodes(s, d), since_checkpoint(_stored_actions(s, d), _log(s, d))), "style.font_size", "style.alignment", "style.highlight", "content"))

query(
    "salvage_edits",
    "SELECT doc_id, 1 AS pos, doc_id || '.1' AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, CASE WHEN text IS NULL THEN 1 ELSE 2 END, doc_id || '.2', 'say \"{' || lang || '}\"' FROM documents WHERE doc_id % 2 = 0 AND lang IS NOT NULL",
    with_nodes=False,
)(lambda s, d: edits_of(_replies(s, d)))


def _replies(s, d) -> DataFrame:
    """Replies with two edits of each document; those of odd documents are cut off in the second one."""
    edit = lambda n, said: F.to_json(F.struct(F.concat("doc_id", F.lit(n)).alias("id"), said.alias("text")))
    second = edit(".2", F.concat(F.lit('say "{'), "lang", F.lit('}"')))
    end = F.when(F.col("doc_id") % 2 == 0, F.concat(second, F.lit("]}\n```"))).otherwise(F.expr("substring(_second, 1, length(_second) - 2)"))
    return read(s, d, "documents").withColumn("_second", second).select("doc_id", F.concat(F.lit('Here:\n```json\n{"edits": ['), edit(".1", F.col("text")), F.lit(", "), end).alias("reply"))


_SPELLED = "'We hold that a ' || CASE p_partkey % 2 WHEN 0 THEN p_name ELSE replace(p_name, ' ', '-') END || ' (' || CASE p_partkey % 3 WHEN 0 THEN 'XQ' ELSE upper(substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) END || ') is best.'"
query(
    "fn_spelled_out",
    rf"""WITH t AS (SELECT p_partkey AS doc_id, {_SPELLED} AS text FROM part), m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{V.INTRODUCED}', 1)) AS said, unnest(regexp_extract_all(text, '{V.INTRODUCED}', 2)) AS term FROM t),
 w AS (SELECT doc_id, term, string_split_regex(said, '\s+') AS l FROM m), k AS (SELECT doc_id, term, l, unnest(range(1, least(len(l), length(term)) + 1)) AS k FROM w), x AS (SELECT doc_id, term, k, l[len(l) - k + 1:] AS tail FROM k)
 SELECT doc_id, term, arg_min(array_to_string(tail, ' '), k) AS long FROM x WHERE upper(array_to_string(list_transform(string_split(array_to_string(tail, '-'), '-'), lambda y: substr(y, 1, 1)), '')) = upper(term) GROUP BY 1, 2""",
    with_nodes=False,
)(lambda s, d: V.spelled_out(read(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_SPELLED).alias("text"))))

# ---- marked-up texts: every document's whole text, with marks put around numbers, capitals and ends of sentences ---------

_is = lambda field, value: lambda piece: piece[field] == value
query(
    "fn_split_maths",
    r"""WITH t AS (SELECT doc_id, replace(regexp_replace(text, '([0-9]+)', '$ \1 $', 'g'), '. ', ' $$z$$ ') AS text FROM (SELECT doc_id, replace(text, '$', '') AS text FROM documents)),
 x AS (SELECT doc_id, string_split_regex(text, '\$\$(?:[^$])+?\$\$|\$[^$\n]+?\$') AS p, regexp_extract_all(text, '\$\$(?:[^$])+?\$\$|\$[^$\n]+?\$') AS m FROM t)
 SELECT doc_id, len(list_filter(p, lambda y: y <> '')) AS texts, len(list_filter(m, lambda y: starts_with(y, '$$'))) AS displays, list_transform(list_filter(m, lambda y: NOT starts_with(y, '$$')), lambda y: trim(replace(y, '$', ''))) AS inline FROM x""",
    with_nodes=False,
)(
    lambda s, d: read(s, d, "documents").withColumn("text", F.replace(F.regexp_replace(F.replace("text", F.lit("$"), F.lit("")), "([0-9]+)", r"\$ $1 \$"), F.lit(". "), F.lit(" $$z$$ ")))
    .select("doc_id", M.split_maths(F.col("text")).alias("x"))
    .select("doc_id", *[F.size(F.filter("x", _is("kind", k))).alias(n) for k, n in (("text", "texts"), ("display", "displays"))], F.transform(F.filter("x", _is("kind", "inline")), lambda y: y["value"]).alias("inline"))
)
_STARS = r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(translate(text, '*_', ''), '([A-Z])', '**\1**', 'g'), '([0-9]+)', '_\1_', 'g') AS text FROM documents)"""
query(
    "emp_runs",
    _STARS + r""" SELECT doc_id, list_transform(regexp_extract_all(text, '\*\*[A-Z]\*\*'), lambda y: replace(y, '*', '')) AS bold, list_transform(regexp_extract_all(text, '_[0-9]+_'), lambda y: replace(y, '_', '')) AS italic,
 len(list_filter(string_split_regex(text, '\*\*[A-Z]\*\*|_[0-9]+_'), lambda y: y <> '')) AS plain FROM t""",
    with_nodes=False,
)(
    lambda s, d: read(s, d, "documents").withColumn("text", F.regexp_replace(F.regexp_replace(F.translate("text", "*_", ""), "([A-Z])", "**$1**"), "([0-9]+)", "_$1_"))
    .select("doc_id", M.emphasis_runs(F.col("text")).alias("x"))
    .select("doc_id", *[F.transform(F.filter("x", _is(k, True)), lambda y: y["text"]).alias(k) for k in ("bold", "italic")], F.size(F.filter("x", lambda y: ~y["bold"] & ~y["italic"])).alias("plain"))
)
