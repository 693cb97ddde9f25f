"""More registered queries: whole logs replayed, streams with state, spans, commands as rows, specs as nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import queries_rest  # noqa: F401  registers what the SQL here builds on
from .functions import markup as M
from .operators import actions as A
from .operators import brief as B
from .operators import describe, pages, spans
from .operators import library as L
from .operators import terms as V
from .operators import versions as H
from .plans import replies, structure
from .plans.compose import spec_nodes
from .plans.replay import since_checkpoint
from .queries import _SECTIONS, N, ORACLE_SQL, path_text, query
from .queries_more import _LOC, _commands, _log, _read_sections
from .schema import TARGETS, style
from .shared import shared_path
from .sources.corpus import nodes, nodes_of_lines, read
from .streaming import live, rooms

# ---- replay of logs with structural actions -------------------------------------------------------------------------


def _versions_of_all_kinds(s, d) -> DataFrame:
    """A version for every event of a user, who stands for a document: what it does follows from its number and document.
    Kinds 3 and 6 are two actions; 3 fails in documents with fewer than two headings."""
    what = ((F.col("seq") + F.col("doc_id")) % 8).cast("int")
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), what + 1)
    no = None
    first = _log(s, d).select(
        "doc_id", "seq", F.lit(0).alias("i"), pick("resize", "split", "insert", "highlight", "delete", "move", "select", "border").alias("type"),
        pick("heading", "body", no, "heading", "table", "subheading", "heading", "table").alias("target"), F.when(what == 0, 1.25).alias("scale"),
        F.when(what == 2, "Put in.").alias("content"), F.when(what == 2, "caption").alias("node_type"), F.when(what == 2, F.concat(F.col("doc_id").cast("string"), F.lit(".1"))).alias("after_id"),
        F.when(what == 5, F.col("doc_id").cast("string")).alias("to_id"), F.when(what == 7, F.expr("map('top', 1.5D)")).alias("sides"),
    )
    again = first.where(what.isin(3, 6)).select("doc_id", "seq", F.lit(1).alias("i"), F.when(what == 3, "merge").otherwise("paste").alias("type"))
    return first.unionByName(again, allowMissingColumns=True)


def _replayed_sql(versions: int) -> str:
    """Each version of every document as one step over all nodes; a key is a list of lists."""
    steps = [
        """v AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events), b AS (SELECT doc_id, max(seq) // 10 * 10 AS base FROM v GROUP BY 1),
 l AS (SELECT doc_id, seq - base AS k, (seq + doc_id) % 8 AS what FROM v JOIN b USING (doc_id) WHERE seq > base),
 n0 AS MATERIALIZED (SELECT doc_id, CASE depth WHEN 1 THEN [[p1::INT]] WHEN 2 THEN [[p1::INT], [p2::INT]] ELSE [[p1::INT], [p2::INT], [p3::INT]] END AS key, doc_id || '.' || path AS id, type, content, font_size, highlight, NULL::DOUBLE AS top FROM nodes)"""
    ]
    for k in range(1, versions + 1):
        steps.append(f"""s{k} AS MATERIALIZED (SELECT n.*, what, coalesce(CASE what WHEN 0 THEN type = 'heading' WHEN 1 THEN type IN ('body', 'paragraph') WHEN 3 THEN type = 'heading' WHEN 4 THEN type = 'table' WHEN 5 THEN type = 'subheading' WHEN 6 THEN type = 'heading' WHEN 7 THEN type = 'table' END, false) AS hit
   FROM n{k - 1} n LEFT JOIN l ON l.doc_id = n.doc_id AND l.k = {k}),
 w{k} AS MATERIALIZED (SELECT *, sum(hit::INT) OVER (PARTITION BY doc_id ORDER BY key) AS nth, sum(hit::INT) OVER (PARTITION BY doc_id) AS hits, bool_or(hit) OVER (PARTITION BY doc_id, key[1]) AS below,
   list_transform(list_filter(string_split(content, '. '), lambda x: trim(x) <> ''), lambda x: trim(x)) AS parts FROM s{k}),
 t{k} AS MATERIALIZED (SELECT doc_id, trim(string_agg(content, ' ' ORDER BY key)) AS joined FROM s{k} WHERE hit AND what = 3 GROUP BY 1),
 a{k} AS MATERIALIZED (SELECT doc_id, max(key) FILTER (WHERE id = doc_id || '.1') AS anchor FROM s{k} WHERE what = 2 GROUP BY 1),
 n{k} AS MATERIALIZED (
  SELECT w.doc_id, CASE WHEN what = 5 AND hit THEN [[2147483647, {k}, nth::INT]] ELSE key END AS key, id, type, CASE WHEN what = 3 AND hit AND hits > 1 AND nth = 1 THEN joined WHEN what = 1 AND hit AND len(parts) > 1 THEN parts[1] ELSE content END AS content,
   CASE WHEN what = 0 AND hit THEN round_even(least(greatest(coalesce(font_size, 11.0) * 1.25, 4), 96), 1) ELSE font_size END::DOUBLE AS font_size, CASE WHEN what = 3 AND hit AND hits > 1 THEN '{A.HIGHLIGHT}' ELSE highlight END AS highlight, CASE WHEN what = 7 AND hit THEN 1.5 ELSE top END AS top
  FROM w{k} w LEFT JOIN t{k} t ON t.doc_id = w.doc_id WHERE NOT coalesce(what = 4 AND below, false) AND NOT coalesce(what = 3 AND hit AND hits > 1 AND nth > 1, false)
  UNION ALL SELECT doc_id, [list_concat(key[1], [-{k}, j::INT])], '', type, part, font_size, highlight, NULL FROM (SELECT *, unnest(parts[2:]) AS part, generate_subscripts(parts[2:], 1) AS j FROM w{k} WHERE what = 1 AND hit AND len(parts) > 1)
  UNION ALL SELECT doc_id, CASE WHEN anchor IS NULL THEN [[2147483647, {k}, 1]] ELSE [list_concat(anchor[1], [-{k}, 1])] END, '', 'caption', 'Put in.', NULL, NULL, NULL FROM a{k}
  UNION ALL SELECT doc_id, [[2147483647, {k}, nth::INT]], '', type, content, font_size, highlight, top FROM w{k} WHERE what = 6 AND hit)""")
    return N + ", " + ",\n ".join(steps) + f""", r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY key[1]) AS place FROM n{versions})
 SELECT doc_id, array_to_string(list_concat([place], list_transform(key[2:], lambda x: x[1])), '.') AS path, type, content, font_size, highlight, top FROM r"""


query("ver_replay_all", _replayed_sql(9), with_nodes=False)(
    lambda s, d: structure.replay(nodes(s, d), since_checkpoint(_versions_of_all_kinds(s, d), _log(s, d))).select("doc_id", path_text().alias("path"), "type", "content", "style.font_size", "style.highlight", F.col("meta.borders")["top"].alias("top"))
)

# ---- streams with state: each reads the table as a stream to its end ------------------------------------------------------


def _stream(s, d, name: str) -> DataFrame:
    """The table as a stream, be it a file or a folder: the path is a pattern, as a plain one would have to be a folder."""
    return s.readStream.schema(s.read.parquet(f"{d}/{name}.parquet").schema).parquet(f"{d}/{name}.parque[t]")


def _rooms(e: DataFrame, rooms: int | None = None) -> DataFrame:
    """Events as messages of rooms: a user's own, or one of so many rooms."""
    room = F.col("user_id") if rooms is None else F.col("user_id") % rooms
    return e.select(room.alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("order"), F.col("event_type").alias("event"))


def _replay_live(s, d) -> DataFrame:
    """Views join one of ten rooms, all other events are messages; two hours count as recent."""
    rooms.with_state(s)
    e = lambda: _rooms(_stream(s, d, "events"), 10)
    heard = rooms.replayed(e().where("event <> 'view'"), e().where("event = 'view'"), horizon=7200)
    return live.finished(heard, "replay", rooms.HEARD).select("doc_id", F.unix_micros("joined").alias("joined"), "viewer", "order", "event", "n")


query(
    "str_replay_live",
    """WITH e AS (SELECT user_id % 10 AS doc_id, ts, event_id, event_type FROM events), m AS (SELECT j.doc_id, j.event_id AS viewer, j.ts AS joined, m.event_id, m.event_type, m.ts FROM e j JOIN e m ON m.doc_id = j.doc_id AND m.ts <= j.ts AND m.ts >= j.ts - INTERVAL 7200 SECONDS WHERE j.event_type = 'view' AND m.event_type <> 'view')
 SELECT doc_id, epoch_us(joined) AS joined, viewer, event_id AS "order", event_type AS event, n FROM (SELECT *, row_number() OVER (PARTITION BY viewer ORDER BY ts DESC, event_id DESC) AS n FROM m) WHERE n <= 40""",
    with_nodes=False,
)(_replay_live)


def _doors_live(s, d) -> DataFrame:
    """Two streams, one behind the other: rooms as they open, and which of them stay."""
    rooms.with_state(s)
    opened = live.finished(rooms.openings(_rooms(_stream(s, d, "events"))), "openings", "doc_id long, ts timestamp, order long")
    path = shared_path(s, "opened")
    opened.repartition(4).write.parquet(path)
    moves = live.finished(rooms.doors(s.readStream.schema(opened.schema).parquet(path)), "doors", "doc_id long, ts timestamp, order long, kept boolean")
    return rooms.still_open(moves).select("doc_id")


query("str_room_eviction_live", "SELECT doc_id FROM (SELECT user_id AS doc_id, row_number() OVER (ORDER BY min((ts, event_id)) DESC, user_id) AS n FROM events GROUP BY 1) WHERE n <= 50", with_nodes=False)(_doors_live)


def _fan_out_live(s, d) -> DataFrame:
    """A view opens a visit of its room for as many minutes as its value says; the other events are messages."""
    e = lambda: _stream(s, d, "events")
    gone = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 60_000_000).cast("long"))
    visits = e().where("event_type = 'view'").select(F.col("event_id").alias("visit"), F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("joined"), gone.alias("gone"))
    heard = rooms.fan_out(_rooms(e()).where("event <> 'view'"), visits)
    return live.finished(heard, "fan-out", "doc_id long, order long, visit long, ts timestamp").select("doc_id", "order", "visit")


query(
    "str_room_fanout_live",
    """WITH v AS (SELECT event_id AS visit, user_id AS room, epoch_us(ts) AS joined, epoch_us(ts) + round(value * 60000000)::BIGINT AS gone FROM events WHERE event_type = 'view')
 SELECT e.user_id AS doc_id, e.event_id AS "order", visit FROM events e JOIN v ON room = e.user_id AND epoch_us(e.ts) >= joined AND epoch_us(e.ts) < gone WHERE event_type <> 'view'""",
    with_nodes=False,
)(_fan_out_live)


def _versions_live(s, d) -> DataFrame:
    rooms.with_state(s)
    commands = _rooms(_stream(s, d, "events")).withColumnRenamed("event", "command")
    return live.finished(live.versions(commands), "versions", "doc_id long, seq long, order long, command string, is_checkpoint boolean, parent_seq long")


query("str_command_log_live", "SELECT user_id AS doc_id, seq, event_id AS \"order\", event_type AS command, seq % 10 = 0 AS is_checkpoint, CASE WHEN seq > 0 THEN seq - 1 END AS parent_seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events)", with_nodes=False)(_versions_live)


def _lowered(versions: DataFrame) -> DataFrame:
    """One action for each version: what the event's name stands for here, on the nodes that it means."""
    pick = lambda **kv: F.element_at(F.create_map(*[F.lit(x) for kv_ in kv.items() for x in kv_]), F.col("command"))
    return versions.select(
        "doc_id", "seq", F.lit(0).alias("i"), pick(view="select", click="highlight", signup="delete", purchase="replace", error="resize").alias("type"),
        pick(view="heading", click="body", signup="table", purchase="document", error="subheading").alias("target"), F.lit("the").alias("find"),
    )


def _exec_live(s, d) -> DataFrame:
    """Commands come as a stream, are numbered and lowered, and what they do to the stored nodes is told batch by batch."""
    rooms.with_state(s)
    commands = _rooms(_stream(s, d, "events")).withColumnRenamed("event", "command")
    work = lambda batch: live.told(nodes(s, d), _lowered(batch))
    told = live.finished(live.versions(commands), "told", "doc_id long, seq long, i int, n int, event string, node_id string, total long", work, keep=True)
    return told.groupBy("doc_id", "seq", "event").agg(F.count("*").alias("rows"), F.max("total").alias("total"), F.min("n").alias("first"), F.min_by("node_id", "n").alias("node_id"))


_NAMES = "CASE event_type WHEN 'view' THEN 'selection' WHEN 'click' THEN 'format' WHEN 'signup' THEN 'delete' WHEN 'purchase' THEN 'replace' ELSE 'format' END"
query(
    "exec_stream_live",
    f""", v AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_type, {_NAMES} AS family FROM events),
 m AS (SELECT v.doc_id, v.seq, family, event_type, n.doc_id || '.' || path AS node_id, p1, p2, p3, content FROM v JOIN nodes n ON n.doc_id = v.doc_id AND CASE event_type WHEN 'view' THEN type = 'heading' WHEN 'click' THEN type IN ('body', 'paragraph') WHEN 'signup' THEN type = 'table' WHEN 'purchase' THEN type IN ({", ".join(f"'{t}'" for t in TARGETS["document"])}) ELSE type = 'subheading' END),
 t AS (SELECT v.doc_id, v.seq, family, count(node_id) AS total FROM v LEFT JOIN m USING (doc_id, seq, family) GROUP BY 1, 2, 3),
 c AS (SELECT doc_id, seq, family, count(*) AS rows, arg_min(node_id, (p1, p2, p3)) AS node_id FROM m WHERE event_type <> 'purchase' OR contains(content, 'the') GROUP BY 1, 2, 3)
 SELECT doc_id, seq, 'batch_started' AS event, 1 AS rows, 1 AS total, 0 AS first, NULL AS node_id FROM t
 UNION ALL SELECT doc_id, seq, family || '_started', 1, total, 1, NULL FROM t
 UNION ALL SELECT doc_id, seq, CASE WHEN family = 'format' THEN 'format_progress' ELSE family || '_item' END, rows, NULL, 2, node_id FROM c
 UNION ALL SELECT t.doc_id, t.seq, t.family || '_finished', 1, total, 2 + coalesce(rows, 0), NULL FROM t LEFT JOIN c USING (doc_id, seq, family)
 UNION ALL SELECT t.doc_id, t.seq, 'batch_finished', 1, 1, 3 + coalesce(rows, 0), NULL FROM t LEFT JOIN c USING (doc_id, seq, family)""",
    with_nodes=False,
)(_exec_live)
ORACLE_SQL["exec_stream_live"] = N + ORACLE_SQL["exec_stream_live"]


def _progress_live(s, d) -> DataFrame:
    """Documents come in as a stream and are read in passes; what a watcher is told of each pass."""
    work = lambda batch: B.passes(nodes_of_lines(batch)).groupBy("doc_id", "pass").agg(F.count("*").alias("ids"))
    told = live.finished(_stream(s, d, "documents"), "progress", "doc_id long, pass int, ids long", work)
    return told.withColumn("total", F.max("pass").over(Window.partitionBy("doc_id")))


query("str_progress_live", ORACLE_SQL["str_progress"], with_nodes=False)(_progress_live)

# ---- formatting of words within nodes -------------------------------------------------------------------------------------


def _styled(n: DataFrame) -> DataFrame:
    """Every "the" bold, then every "he a" coloured, across the edges of the bold words."""
    bold = spans.style_phrase(n, spans.plain_runs(n), F.lit(" The "), bold=True)
    return spans.style_phrase(n, bold, F.lit("he a"), color="#c00000")


query(
    "fmt_style_span_runs",
    """, c AS (SELECT doc_id, path, lower(content) AS low, unnest(range(1, length(content) + 1)) AS i FROM nodes WHERE content <> ''),
 f AS (SELECT doc_id, path, i, substr(low, i, 3) = 'the' OR (i > 1 AND substr(low, i - 1, 3) = 'the') OR (i > 2 AND substr(low, i - 2, 3) = 'the') AS bold,
  substr(low, i, 4) = 'he a' OR (i > 1 AND substr(low, i - 1, 4) = 'he a') OR (i > 2 AND substr(low, i - 2, 4) = 'he a') OR (i > 3 AND substr(low, i - 3, 4) = 'he a') AS red FROM c),
 g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, path, bold, red ORDER BY i) AS island FROM f)
 SELECT doc_id, doc_id || '.' || path AS node_id, (min(i) - 1)::INTEGER AS start, max(i)::INTEGER AS "end", CASE WHEN bold THEN true END AS bold, CASE WHEN red THEN '#c00000' END AS color FROM g GROUP BY doc_id, path, bold, red, island""",
)(lambda n: _styled(n).select("doc_id", "node_id", "start", "end", "style.bold", "style.color"))


def _described(n: DataFrame) -> DataFrame:
    """The words that were picked out of each text: its first and its last word, in its own node only."""
    words = F.split(F.trim("content"), " ")
    asked = n.where("trim(content) <> ''").select("doc_id", "node_id", F.explode(F.array(words[0], F.element_at(words, -1))).alias("text"))
    return spans.style_spans(n, spans.plain_runs(n), asked, italic=True)


query(
    "join_spans_runs",
    """, w AS (SELECT doc_id, path, content, lower(content) AS low, lower(string_split(trim(content), ' ')[1]) AS a, lower(string_split(trim(content), ' ')[-1]) AS b FROM nodes WHERE trim(content) <> ''),
 d AS (SELECT DISTINCT doc_id, path, low, unnest([a, b]) AS needle FROM w),
 p AS (SELECT doc_id, path, needle, unnest(string_split(low, needle)[:-2]) AS gap, generate_subscripts(string_split(low, needle)[:-2], 1) AS k FROM d),
 m AS (SELECT doc_id, path, length(needle) AS n, sum(length(gap) + length(needle)) OVER (PARTITION BY doc_id, path, needle ORDER BY k) AS stop FROM p),
 u AS (SELECT doc_id, path, stop - n AS start, stop, max(stop) OVER (PARTITION BY doc_id, path ORDER BY stop - n, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
 i AS (SELECT *, sum(CASE WHEN start <= before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, path ORDER BY start, stop) AS island FROM u)
 SELECT doc_id, doc_id || '.' || path AS node_id, min(start)::INTEGER AS start, max(stop)::INTEGER AS "end" FROM i GROUP BY doc_id, path, island""",
)(lambda n: _described(n).where("style.italic").select("doc_id", "node_id", "start", "end"))

# ---- specs as node tables -------------------------------------------------------------------------------------------------


def _composed(s, d) -> DataFrame:
    """A spec of every document: its text as a listing and its words as blocks of every kind; figures of odd documents have no data."""
    null = lambda kind: F.lit(None).cast(kind)
    words = F.slice(F.split("text", " ", -1), 1, 3)

    def block(kind: str, **given):
        fields = {"level": "int", "text": "string", "ordered": "boolean", "items": "array<string>", "columns": "array<string>", "rows": "array<array<string>>", "caption": "string", "render": "string", "filename": "string", "chart": "struct<kind:string,labels:array<string>,values:array<double>>"}
        return F.struct(F.lit(kind).alias("type"), *[given.get(f, null(t)).cast(t).alias(f) for f, t in fields.items()])

    values = F.when(F.col("doc_id") % 2 == 0, F.array(F.col("n_chars").cast("double"))).otherwise(F.array().cast("array<double>"))
    chart = F.struct(F.lit("bar").alias("kind"), F.array("lang").alias("labels"), values.alias("values"))
    blocks = F.array(
        block("heading", level=F.col("doc_id") % 4, text=words[0]), block("figure", chart=chart, caption=F.col("lang")), block("list", ordered=F.col("doc_id") % 3 == 0, items=words), block("figure", chart=F.struct(F.lit("pie").alias("kind"), F.array("lang").alias("labels"), F.array(F.lit(1.0)).alias("values"))),
        block("table", columns=F.array("lang", "source"), rows=F.array(words), caption=F.col("source")), block("equation", text=F.concat(words[0], F.lit("_{2}"))), block("equation", text=F.lit("y = 2")), block("code", text=F.col("text"), caption=F.col("lang")),
    )
    meta = F.struct(F.col("source").alias("title"), F.lit("apa").alias("style"), F.array("lang", "source").alias("keywords"))
    return read(s, d, "documents").select("doc_id", F.to_json(F.struct(meta.alias("meta"), blocks.alias("blocks"), F.array(F.concat(F.lit("[7] "), "source")).alias("references"))).alias("spec"))


query(
    "spec_to_nodes",
    r"""WITH b AS (SELECT *, string_split(text, ' ')[1:3] AS w, doc_id % 2 = 0 AS even, 0 AS z FROM documents),
 o AS (SELECT *, CASE WHEN even THEN 1 ELSE 0 END AS f, string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS code FROM b),
 x AS (
  SELECT doc_id, '1' AS path, 'heading' AS type, source AS content, NULL AS number FROM o UNION ALL SELECT doc_id, '2', 'body', 'Keywords: ' || lang || ', ' || source, NULL FROM o
  UNION ALL SELECT doc_id, '3', CASE WHEN doc_id % 4 < 2 THEN 'heading' ELSE 'subheading' END, w[1], NULL FROM o
  UNION ALL SELECT doc_id, '4', 'figure', '', '1' FROM o WHERE even UNION ALL SELECT doc_id, '4.1', 'image', lang, NULL FROM o WHERE even UNION ALL SELECT doc_id, '4.2', 'caption', 'Figure 1' || chr(10) || lang, NULL FROM o WHERE even
  UNION ALL SELECT doc_id, (4 + f)::VARCHAR, 'paragraph', '', NULL FROM o
  UNION ALL SELECT doc_id, (4 + f) || '.' || k, 'body', CASE WHEN doc_id % 3 = 0 THEN k || '. ' ELSE '• ' END || c, NULL FROM (SELECT *, unnest(w) AS c, generate_subscripts(w, 1) AS k FROM o)
  UNION ALL SELECT doc_id, (5 + f)::VARCHAR, 'figure', '', '2' FROM o UNION ALL SELECT doc_id, (5 + f) || '.1', 'image', '', NULL FROM o
  UNION ALL SELECT doc_id, (6 + f)::VARCHAR, 'table', '', NULL FROM o UNION ALL SELECT doc_id, (6 + f) || '.1', 'table_row', '', NULL FROM o UNION ALL SELECT doc_id, (6 + f) || '.1.1', 'table_cell', lang, NULL FROM o UNION ALL SELECT doc_id, (6 + f) || '.1.2', 'table_cell', source, NULL FROM o
  UNION ALL SELECT doc_id, (6 + f) || '.2', 'table_row', '', NULL FROM o UNION ALL SELECT doc_id, (6 + f) || '.2.1', 'table_cell', coalesce(w[1], ''), NULL FROM o UNION ALL SELECT doc_id, (6 + f) || '.2.2', 'table_cell', coalesce(w[2], ''), NULL FROM o UNION ALL SELECT doc_id, (6 + f) || '.3', 'caption', source, NULL FROM o
  UNION ALL SELECT doc_id, (7 + f)::VARCHAR, 'figure', '', '1' FROM o UNION ALL SELECT doc_id, (7 + f) || '.1', 'image', w[1] || '_{2}', '1' FROM o UNION ALL SELECT doc_id, (8 + f)::VARCHAR, 'body', 'y = 2', '2' FROM o
  UNION ALL SELECT doc_id, (9 + f)::VARCHAR, 'paragraph', '', NULL FROM o UNION ALL SELECT doc_id, (9 + f) || '.1', 'caption', 'Listing 1. ' || lang, NULL FROM o
  UNION ALL SELECT doc_id, (9 + f) || '.' || (k + 1), 'body', CASE WHEN c = '' THEN ' ' ELSE c END, NULL FROM (SELECT *, unnest(code) AS c, generate_subscripts(code, 1) AS k FROM o)
  UNION ALL SELECT doc_id, (10 + f)::VARCHAR, 'reference', '[1] ' || source, NULL FROM o)
 SELECT * FROM x""",
    with_nodes=False,
)(lambda s, d: spec_nodes(_composed(s, d)).select("doc_id", path_text().alias("path"), "type", "content", F.col("props")["number"].alias("number")))

# ---- pages with cut texts -------------------------------------------------------------------------------------------------

query(
    "win_page_fill_cut",
    """, items AS (SELECT doc_id, path, type, content, length(content) AS n, (greatest(1, ceil(length(content) / 80)::INTEGER) + 1) * 14 AS h, row_number() OVER (PARTITION BY doc_id ORDER BY p1) AS rn FROM nodes WHERE depth = 1),
 fold AS (
  SELECT doc_id, 0::BIGINT AS rn, 1 AS page, 0 AS used, false AS filled, NULL::VARCHAR AS path, 0 AS cut, 1 AS onto, NULL::VARCHAR AS content FROM (SELECT DISTINCT doc_id FROM items)
  UNION ALL SELECT doc_id, rn, CASE WHEN type = 'page_break' THEN page + 1 WHEN fits THEN page WHEN cut > 0 THEN page + 1 ELSE page + filled::INTEGER + CASE WHEN h >= 700 THEN 1 ELSE 0 END END,
   CASE WHEN type = 'page_break' THEN 0 WHEN fits THEN used + h WHEN cut > 0 THEN least(h - budget, 700) WHEN h >= 700 THEN 0 ELSE h END, CASE WHEN type = 'page_break' THEN false WHEN fits OR cut > 0 THEN true ELSE h < 700 END,
   CASE WHEN type <> 'page_break' THEN path END, CASE WHEN fits OR type = 'page_break' THEN 0 ELSE cut END, CASE WHEN fits OR cut > 0 THEN page ELSE page + filled::INTEGER END, content
  FROM (SELECT *, CASE WHEN raw > 0 AND trim(substr(content, 1, raw)) <> '' AND trim(substr(content, raw + 1)) <> '' THEN raw ELSE 0 END AS cut FROM (
   SELECT i.*, f.page, f.used, f.filled, i.h <= 700 - f.used AS fits, 700 - f.used - 14 AS budget, CASE WHEN i.type IN ('body', 'paragraph', 'reference', 'footnote', 'caption') AND 700 - f.used - 14 >= 28 AND i.h - (700 - f.used - 14) >= 28 AND i.n > (700 - f.used - 14) // 14 * 80
     AND contains(substr(i.content, 1, ((700 - f.used - 14) // 14 * 80 + 1)::BIGINT), ' ') THEN length(substr(i.content, 1, ((700 - f.used - 14) // 14 * 80 + 1)::BIGINT)) - strpos(reverse(substr(i.content, 1, ((700 - f.used - 14) // 14 * 80 + 1)::BIGINT)), ' ') ELSE 0 END AS raw
   FROM fold f JOIN items i ON i.doc_id = f.doc_id AND i.rn = f.rn + 1)))
 SELECT doc_id, doc_id || '.' || path AS node_id, '' AS part, onto AS page, content AS text FROM fold WHERE path IS NOT NULL AND cut = 0
 UNION ALL SELECT doc_id, doc_id || '.' || path, '~a', onto, regexp_replace(substr(content, 1, cut::BIGINT), '\\s+$', '') FROM fold WHERE cut > 0
 UNION ALL SELECT doc_id, doc_id || '.' || path, '~b', onto + 1, regexp_replace(substr(content, cut::BIGINT + 1), '^\\s+', '') FROM fold WHERE cut > 0""",
)(lambda n: pages.fill(n))
ORACLE_SQL["win_page_fill_cut"] = ORACLE_SQL["win_page_fill_cut"].replace("WITH lines", "WITH RECURSIVE lines", 1)

# ---- maths as typed, replies, salvage -------------------------------------------------------------------------------------

query(
    "fn_typed_maths",
    r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(translate(text, '$^_{}\', ''), '([0-9]+)', '$x_{\1}^2$', 'g'), '([A-Z])', '$\1^$', 'g') AS text FROM documents),
 x AS (SELECT doc_id, regexp_extract_all(text, '\$x_\{[0-9]+\}\^2\$') AS m, string_split_regex(text, '\$x_\{[0-9]+\}\^2\$|\$[A-Z]\^\$') AS p, regexp_extract_all(text, '\$[A-Z]\^\$') AS bad FROM t)
 SELECT doc_id, list_transform(m, lambda y: y[2:-2]) AS maths, (len(list_filter(p, lambda y: y <> '')) + len(bad))::INTEGER AS texts FROM x""",
    with_nodes=False,
)(
    lambda s, d: read(s, d, "documents").withColumn("text", F.regexp_replace(F.regexp_replace(F.translate("text", "$^_{}\\", ""), "([0-9]+)", r"\$x_{$1}^2\$"), "([A-Z])", r"\$$1^\$"))
    .select("doc_id", M.typed_maths(F.col("text")).alias("x"))
    .select("doc_id", F.transform(F.filter("x", lambda p: p["kind"] == "maths"), lambda p: p["value"]).alias("maths"), F.size(F.filter("x", lambda p: p["kind"] == "text")).alias("texts"))
)


def _whole_and_cut(s, d) -> DataFrame:
    """Replies around an edit of each text; those of odd documents are cut in the middle of it."""
    edits = F.to_json(F.struct(F.array(F.struct(F.concat("doc_id", F.lit(".1")).alias("id"), "text")).alias("edits")))
    rows = read(s, d, "documents").withColumn("_e", edits)
    cut = F.expr("substring(_e, 1, length(_e) - 3 - length(lang))")
    return rows.select("doc_id", F.concat(F.lit("Here is } what [you] asked: "), F.when(F.col("doc_id") % 2 == 0, F.concat("_e", F.lit(" and {more}"))).otherwise(cut)).alias("reply"))


query("rewrite_strict", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id || '.1' END AS id, CASE WHEN doc_id % 2 = 0 THEN text END AS text FROM documents", with_nodes=False)(
    lambda s, d: replies.strict(_whole_and_cut(s, d)).select("doc_id", F.get("edits", F.lit(0))["id"].alias("id"), F.get("edits", F.lit(0))["text"].alias("text"))
)


def _sloppy(s, d) -> DataFrame:
    """Specs with a good block and a heading without a text; by document, the references, the flags or the metadata are wrong."""
    k = F.col("doc_id") % 5
    text = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)
    blocks = F.concat(F.lit('[{"type":"heading"},{"type":"paragraph","text":'), F.when(k == 4, F.lit("null")).otherwise(text), F.lit("}]"))
    meta = F.when(k == 3, '{"title":7}').otherwise('{"title":"T"}')
    references = F.when(k == 1, '"one"').otherwise('["one"]')
    resolved = F.when(k == 2, '"maybe"').otherwise("true")
    return read(s, d, "documents").select("doc_id", F.concat(F.lit('{"meta":'), meta, F.lit(',"blocks":'), blocks, F.lit(',"references":'), references, F.lit(',"resolved":'), resolved, F.lit("}")).alias("spec"))


query("salvage_ladder", "SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN doc_id % 5 + 1 END::INTEGER AS stage, CASE WHEN doc_id % 5 < 4 THEN 1 ELSE 2 END AS dropped, CASE WHEN doc_id % 5 < 4 THEN text END AS text FROM documents", with_nodes=False)(
    lambda s, d: replies.salvage(_sloppy(s, d)).select("doc_id", "stage", "dropped", F.from_json("kept", "blocks array<struct<text: string>>")["blocks"][0]["text"].alias("text"))
)

# ---- what was done, and where ---------------------------------------------------------------------------------------------


def _done(s, d) -> tuple[DataFrame, DataFrame]:
    """A batch of one action for each document by its id, and the nodes that it changed: those of its target."""
    n = nodes(s, d)
    k = (F.col("doc_id") % 6).cast("int")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), k + 1)
    docs = n.select("doc_id").distinct()
    actions = docs.select(
        F.col("doc_id").alias("batch"), F.lit(0).alias("i"), pick("format", "delete", "align", "list", "resize", "border").alias("type"), pick("heading", "table", "caption", "body", "subheading", "table").alias("target"),
        (k == 0).alias("bold"), F.when(k == 2, "center").alias("alignment"), F.when(k == 3, "number").alias("kind"), F.when(k == 4, -2.0).alias("delta"), F.when(k == 5, F.array(F.lit("top"), F.lit("inside_v"))).alias("sides"), F.when(k == 5, 1.5).alias("width"),
    ).withColumn("bold", F.when(F.col("bold"), True))
    hit = n.withColumn("k", k).where("(k = 0 and type = 'heading') or (k in (1, 5) and type = 'table') or (k = 2 and type = 'caption') or (k = 3 and type in ('body', 'paragraph')) or (k = 4 and type = 'subheading')")
    return actions, hit.select(F.col("doc_id").alias("batch"), F.col("sort_path").alias("pos"), "type")


_COUNTED = "CASE WHEN n = 1 THEN '1 ' || one WHEN n > 0 THEN n || ' ' || one || 's' ELSE one || 's' END"
query(
    "cmd_describe",
    f""", k AS (SELECT doc_id, doc_id % 6 AS k, ['heading', 'table', 'caption', 'paragraph', 'subheading', 'table'][doc_id % 6 + 1] AS one FROM documents),
 c AS (SELECT k.doc_id, k, one, count(nodes.doc_id) AS n FROM k LEFT JOIN nodes ON nodes.doc_id = k.doc_id AND (type = one OR one = 'paragraph' AND type = 'body') GROUP BY 1, 2, 3)
 SELECT doc_id AS batch, CASE k WHEN 0 THEN 'Bolded ' || {_COUNTED} WHEN 1 THEN 'Deleted ' || {_COUNTED} WHEN 2 THEN 'Centred ' || {_COUNTED} WHEN 3 THEN 'Numbered ' || {_COUNTED} WHEN 4 THEN 'Made ' || {_COUNTED} || ' 2 pt smaller'
  ELSE 'Drew heavy top and inner vertical borders on ' || {_COUNTED} || ', and no others' END || '.' AS sentence FROM c""",
    with_nodes=False,
)(lambda s, d: describe.describe(*_done(s, d)))
ORACLE_SQL["cmd_describe"] = N + ORACLE_SQL["cmd_describe"]


def _placed(s, d) -> DataFrame:
    """A command for each document, located in its sections; by document, its action is free, a border, or has its nodes."""
    n, k = nodes(s, d), F.col("doc_id") % 3
    located = V.locate(_read_sections(n), _commands(s, d)).join(B.sections(n).select("doc_id", "section", "node_ids"), ["doc_id", "section"]).select(F.col("doc_id").alias("batch"), F.col("node_ids").alias("ids"))
    actions = _commands(s, d).select(F.col("doc_id").alias("batch"), F.lit(0).alias("i"), F.when(k == 1, "border").otherwise("rewrite").alias("type"), F.lit("body").alias("target"), F.when(k == 2, F.array(F.lit("x"))).alias("node_ids"), "command")
    return describe.place(actions, located)


query(
    "cmd_place",
    _LOC + """, best AS (SELECT doc_id, section FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, section) AS rn FROM sc) WHERE rn = 1 AND score >= 2)
 SELECT d.doc_id AS batch, CASE WHEN d.doc_id % 3 = 1 THEN 'border' ELSE 'rewrite' END AS type, CASE WHEN d.doc_id % 3 = 0 AND n_ids IS NOT NULL THEN NULL ELSE 'body' END AS target, CASE d.doc_id % 3 WHEN 2 THEN 1 WHEN 0 THEN n_ids END::INTEGER AS n_ids
 FROM documents d LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN sections ON sections.doc_id = best.doc_id AND sections.section = best.section""",
    with_nodes=False,
)(lambda s, d: _placed(s, d).select("batch", "type", "target", F.when(F.col("node_ids").isNotNull(), F.size("node_ids")).alias("n_ids")))
ORACLE_SQL["cmd_place"] = N + ORACLE_SQL["cmd_place"]

# ---- lists: SQL without look-behind, where a sign after every separator stands for what it would look at -------------------

_MARKS = r"\x01(?:\((?:[ivxlcdm]+|[a-z]|[0-9]{1,2})\)|(?:[ivxlcdm]+|[a-z]|[0-9]{1,2})[.)]|[•‣●▪⁃])(?:\s\x01)+"
_ITEMS = rf""", x AS (SELECT doc_id, path, p1, type, content, trim(content) AS body FROM nodes WHERE depth = 1),
 m AS (SELECT *, string_split_regex(chr(1) || regexp_replace(body, '([\s:;,])', '\1' || chr(1), 'g'), '(?i){_MARKS}') AS parts, instr(body, ':') AS colon, length(body) - length(replace(body, ';', '')) AS semis FROM x),
 s AS (SELECT *, colon > 0 AND trim(substr(body, colon + 1)) <> '' AS led FROM m),
 r AS (SELECT *, list_filter(string_split(CASE WHEN led THEN substr(body, colon + 1) ELSE body END, ';'), lambda p: trim(p) <> '') AS clauses FROM s),
 w AS (SELECT *, CASE WHEN len(parts) >= 3 THEN list_transform(parts[2:], lambda p: replace(p, chr(1), '')) WHEN semis >= 2 AND len(clauses) >= 2 THEN clauses ELSE [] END AS raw, CASE WHEN len(parts) >= 3 THEN trim(replace(parts[1], chr(1), '')) WHEN led THEN trim(substr(body, 1, colon)) ELSE '' END AS before FROM r),
 t AS (SELECT *, list_filter(list_transform(raw, lambda p: regexp_replace(trim(p), '(?i)[\s;,]*(and|or)?[\s;,]*$', '')), lambda p: p <> '') AS tidy FROM w),
 cut AS (SELECT doc_id, path, p1, type, content, CASE WHEN len(tidy) >= 2 THEN before ELSE '' END AS lead, CASE WHEN len(tidy) >= 2 THEN list_transform(tidy, lambda p: upper(replace(p[1], 'ß', 'SS')) || substr(p, 2)) ELSE [] END AS items FROM t)
"""
ORACLE_SQL["lst_split_items"] = N + _ITEMS + "SELECT doc_id, path, lead, len(items)::INTEGER AS n FROM cut WHERE type IN ('body', 'paragraph')"
ORACLE_SQL["act_list"] = N + _ITEMS + """, a AS (SELECT *, type IN ('body', 'paragraph') AS b, max(CASE WHEN type IN ('body', 'paragraph') AND len(items) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) = 1 AS enumerated,
  max(CASE WHEN type IN ('body', 'paragraph') AND NOT rtrim(content) LIKE '%:' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p1 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) = 1 AS later FROM cut),
 p AS (SELECT doc_id, p1, type, CASE WHEN b AND len(items) > 0 THEN CASE WHEN lead <> '' THEN [{'t': lead, 'k': NULL}] ELSE [] END || list_transform(items, lambda i: {'t': i, 'k': 'bullet'})
  ELSE [{'t': content, 'k': CASE WHEN b AND NOT enumerated AND NOT (rtrim(content) LIKE '%:' AND coalesce(later, false)) THEN 'bullet' END}] END AS pieces FROM a),
 e AS (SELECT doc_id, p1, type, unnest(pieces) AS x, generate_subscripts(pieces, 1) AS k FROM p)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p1, k) AS ord, type, x.t AS content, x.k AS list_kind FROM e"""

# ---- versions as of a time, sections by size --------------------------------------------------------------------------------


def _asked_times(s, d) -> DataFrame:
    """Each order's customer asks, a moment after midnight of some day, for the version of the document of the same number."""
    day = F.expr("timestamp '2024-01-01 00:00:07' + make_dt_interval(cast(o_orderkey % 40 as int) - 2)")
    return read(s, d, "orders").select(F.col("o_custkey").cast("long").alias("doc_id"), day.alias("ts"), "o_orderkey")


query(
    "join_as_of",
    """WITH v AS (SELECT user_id AS doc_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
 q AS (SELECT o_custkey::BIGINT AS doc_id, TIMESTAMP '2024-01-01 00:00:07' + INTERVAL 1 DAY * (o_orderkey % 40 - 2) AS ts, o_orderkey FROM orders)
 SELECT q.o_orderkey, v.seq FROM q ASOF LEFT JOIN v ON v.doc_id = q.doc_id AND v.ts <= q.ts""",
    with_nodes=False,
)(lambda s, d: H.as_of(_log(s, d), _asked_times(s, d)).select("o_orderkey", "seq"))
query(
    "win_section_ranks",
    _SECTIONS + """SELECT doc_id, section, words, rank() OVER (PARTITION BY doc_id ORDER BY words DESC) AS rank, ntile(4) OVER (PARTITION BY doc_id ORDER BY words DESC, section) AS quarter, words - lag(words) OVER w AS more, lead(section) OVER w AS next,
 round(words - avg(words) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS over FROM sections WINDOW w AS (PARTITION BY doc_id ORDER BY section)""",
)(lambda n: B.section_ranks(B.sections(n)))


# ---- runs for export, styles by name ----------------------------------------------------------------------------------------

query(
    "snk_docx_runs",
    """, p AS (SELECT doc_id, path, content, font_size, bold, string_split(lower(content), 'the') AS l FROM nodes WHERE content <> ''),
 e AS (SELECT doc_id, path, content, font_size, bold, unnest(l) AS gap, generate_subscripts(l, 1) AS k, len(l) AS n FROM p),
 o AS (SELECT *, (sum(length(gap) + 3) OVER (PARTITION BY doc_id, path ORDER BY k) - 3)::BIGINT AS stop FROM e),
 r AS (SELECT doc_id, path, content, font_size, bold, stop - length(gap) AS a, stop AS b, false AS hit FROM o WHERE gap <> '' UNION ALL SELECT doc_id, path, content, font_size, bold, stop, stop + 3, true FROM o WHERE k < n),
 i AS (SELECT *, sum(CASE WHEN hit AND coalesce(ph, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, path ORDER BY a) AS island FROM (SELECT *, lag(hit) OVER (PARTITION BY doc_id, path ORDER BY a) AS ph FROM r))
 SELECT doc_id, doc_id || '.' || path AS node_id, min(a)::INTEGER AS start, substr(any_value(content), (min(a) + 1)::BIGINT, (max(b) - min(a))::BIGINT) AS text, coalesce(any_value(font_size), 11.0)::DOUBLE AS font_size, any_value(hit) OR coalesce(any_value(bold), false) AS bold FROM i GROUP BY doc_id, path, island""",
)(lambda n: spans.resolved(n, spans.style_phrase(n, spans.plain_runs(n), F.lit("the"), bold=True)).select("doc_id", "node_id", "start", "text", "font_size", "bold"))


def _named_styles(s, d) -> tuple[DataFrame, DataFrame]:
    """Styles named like parts, for headings or body texts, their size that of the part; each document asks for one, in capitals."""
    part = read(s, d, "part")
    bold = F.when(F.col("p_partkey") % 3 == 0, True)
    styles = part.select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_partkey") % 2 == 0, "heading").otherwise("body").alias("target"), style(font_size=F.col("p_size").cast("double"), bold=bold).alias("style"))
    asked = part.select(F.col("p_partkey").alias("doc_id"), F.upper(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))).alias("name"))
    return asked, styles


query(
    "fmt_style_named",
    "SELECT doc_id, path, CASE WHEN p_partkey % 2 = 0 AND type = 'heading' OR p_partkey % 2 = 1 AND type IN ('body', 'paragraph') THEN p_size ELSE font_size END::DOUBLE AS font_size, CASE WHEN p_partkey % 3 = 0 AND (p_partkey % 2 = 0 AND type = 'heading' OR p_partkey % 2 = 1 AND type IN ('body', 'paragraph')) THEN true ELSE bold END AS bold, color FROM nodes LEFT JOIN part ON p_partkey = doc_id",
    with_nodes=False,
)(lambda s, d: L.apply_named(nodes(s, d), *_named_styles(s, d)).select("doc_id", path_text().alias("path"), "style.font_size", "style.bold", "style.color"))
ORACLE_SQL["fmt_style_named"] = N + ORACLE_SQL["fmt_style_named"]
