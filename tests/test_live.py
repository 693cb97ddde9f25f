"""Streams with state: the rows of the batch forms, also after restarts and runs that were killed."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sylva.sources.corpus import nodes_of_lines
from sylva.streaming import hub, live, rooms

BEGIN = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    rooms.with_state(spark)


@pytest.fixture(scope="module")
def rows():
    """Events in order of time, a third of them joins, some at the same time; the last ones only bring the time forward."""
    rng = random.Random(4)
    at, out = BEGIN, []
    for k in range(300):
        at += timedelta(seconds=rng.choice([0, 1, 5, 20, 60]))
        out.append((rng.randrange(4), at, k, rng.choice(["join", "say", "tell"])))
    return [*out, (99, at + timedelta(hours=2), 300, "say")]


SCHEMA = "doc_id long, ts timestamp, `order` long, event string"


def files(spark, tmp_path, rows, parts):
    """Writes the rows as files, one after the other; gives a function that puts the next one into the watched folder."""
    size = -(-len(rows) // parts)
    (tmp_path / "in").mkdir()

    def put(k):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        one = next((tmp_path / f"part{k}").glob("*.parquet"))
        one.rename(tmp_path / "in" / f"{k}.parquet")

    return put


def source(spark, tmp_path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(stream, tmp_path, work=lambda rows: rows):
    live.each_batch(stream, str(tmp_path / "out"), str(tmp_path / "cp"), work).awaitTermination()


def test_late_joiners_after_restarts(spark, tmp_path, rows):
    put = files(spark, tmp_path, rows, 5)
    for k in range(5):
        put(k)
        if k in (0, 2, 4):  # three runs; each goes on from the checkpoint
            e = source(spark, tmp_path)
            run(rooms.replayed(e.where("event <> 'join'"), e.where("event = 'join'"), late="2 seconds", buffer=5), tmp_path)  # rows of one time may lie in two files
    table = spark.createDataFrame(rows, SCHEMA)
    joins = table.where("event = 'join'").select("doc_id", F.col("ts").alias("joined")).distinct()
    viewers = table.where("event = 'join'").select("doc_id", F.col("ts").alias("joined"), F.col("order").alias("viewer"))
    want = hub.replay_buffer(table.where("event <> 'join'"), joins).where("n <= 5").join(viewers, ["doc_id", "joined"]).select("doc_id", "joined", "viewer", "ts", "order", "event", "n")
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert got.count() == got.distinct().count() > 50
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_one_timer_for_all_that_wait():
    """However many rows wait, a room has one timer for them; the blocks in which they leave cut nothing."""

    class State:
        def __init__(self):
            self.rows = []

        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)
        put = lambda self, rows: setattr(self, "rows", list(rows))
        appendList = lambda self, rows: self.rows.extend(rows)  # noqa: E731,N815
        clear = lambda self: setattr(self, "rows", [])

    class Handle:
        timers: list[int] = []
        getListState = lambda self, name, schema: State()  # noqa: E731,N815
        registerTimer = lambda self, ms: self.timers.append(ms)  # noqa: E731,N815

    class Now:
        getCurrentWatermarkInMs = lambda self: 700_000  # noqa: E731,N815

    room = rooms.Room(buffer=3, horizon=60, block=7)
    room.init(Handle())
    at = [k * 1_000_000 for k in range(900)]
    part = pd.DataFrame({"ts": pd.Series(at).astype("datetime64[us]"), "order": range(900), "event": ["say"] * 900, "joins": [k % 2 == 1 for k in range(900)]})
    list(room.handleInputRows((1,), iter([part[:500], part[500:]]), None))
    assert Handle.timers == [0]
    got = pd.concat(list(room.handleExpiredTimer((1,), Now(), None)))
    want = [(v, m, n) for v in range(1, 701, 2) for n, m in enumerate(range(v - 1, max(v - 7, -1), -2), 1)]
    assert list(got[["viewer", "order", "n"]].astype(int).itertuples(index=False, name=None)) == want
    assert Handle.timers == [0, 701_000, 760_001]  # the first that still waits, and the ring's end


def test_too_late(spark, tmp_path):
    """What comes after the watermark has passed it is left out."""
    at = lambda s: BEGIN + timedelta(seconds=s)
    put = files(spark, tmp_path, [(1, at(0), 0, "say"), (1, at(50), 1, "join"), (9, at(500), 2, "say"), (1, at(10), 3, "say"), (1, at(510), 4, "join"), (9, at(900), 5, "say")], 3)
    for k in range(3):
        put(k)
        e = source(spark, tmp_path)
        run(rooms.replayed(e.where("event <> 'join'"), e.where("event = 'join'"), horizon=600), tmp_path)
    got = spark.read.parquet(str(tmp_path / "out")).select("joined", "order", "n")
    assert sorted(map(tuple, got.collect())) == [(at(50), 0, 1), (at(510), 0, 1)]


def test_rooms_put_out(spark, tmp_path, rows):
    rows = [(r[2] % 37, *r[1:]) for r in rows]
    put = files(spark, tmp_path, rows, 3)
    for k in range(3):
        put(k)
        run(rooms.openings(source(spark, tmp_path)), tmp_path)
        opened = spark.read.parquet(str(tmp_path / "out")).drop("batch")
        seen = spark.createDataFrame(rows[: (k + 1) * -(-len(rows) // 3)], SCHEMA)
        assert opened.count() == seen.select("doc_id").distinct().count()
        path = str(tmp_path / f"opened{k}")
        opened.write.parquet(path)
        live.each_batch(rooms.doors(spark.readStream.schema(opened.schema).parquet(path), most=5, shards=3), str(tmp_path / f"moves{k}"), str(tmp_path / f"cp{k}")).awaitTermination()
        moves = spark.read.parquet(str(tmp_path / f"moves{k}")).drop("batch")
        assert list(map(tuple, rooms.still_open(moves, 5).collect())) == list(map(tuple, hub.kept_rooms(seen, 5).collect()))
        kept = moves.groupBy("doc_id").agg(F.min("kept").alias("kept")).where("kept")
        assert kept.count() <= 15


def test_who_hears_what(spark, tmp_path, rows):
    put = files(spark, tmp_path, rows, 3)
    visits = lambda e: e.where("event = 'join'").select(F.col("order").alias("visit"), "doc_id", F.col("ts").alias("joined"), (F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("gone"))
    for k in range(3):
        put(k)
        e = source(spark, tmp_path)
        run(rooms.fan_out(e.where("event <> 'join'"), visits(source(spark, tmp_path))), tmp_path)
    table = spark.createDataFrame(rows, SCHEMA)
    want = rooms.fan_out(table.where("event <> 'join'"), visits(table))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50


def test_a_killed_stream_has_neither_gaps_nor_doubles(spark, tmp_path, rows):
    put = files(spark, tmp_path, rows, 4)
    for k in range(4):
        put(k)
    commands = lambda: live.versions(source(spark, tmp_path).withColumnRenamed("event", "command"))
    runs = []

    def dies(batch):
        runs.append(batch.count())
        if len(runs) == 3:
            batch.limit(7).write.mode("overwrite").parquet(str(tmp_path / "out" / "batch=2"))  # half written
            raise RuntimeError("killed")
        return batch

    with pytest.raises(Exception, match="killed"):
        run(commands(), tmp_path, dies)
    run(commands(), tmp_path)
    run(commands(), tmp_path)  # nothing is left to do
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()
    assert len(got) == len(rows) == len({r.order for r in got})
    want, count = [], {}
    for doc, ts, order, event in sorted(rows, key=lambda r: (r[1], r[2])):
        seq = count[doc] = count.get(doc, -1) + 1
        want.append((doc, seq, ts, order, event, seq % 10 == 0, seq - 1 if seq else None))
    assert sorted(map(tuple, got)) == sorted(want)


def test_what_is_told(spark):
    nodes = nodes_of_lines(spark.createDataFrame([(1, "Head\nx | y\nthe text the\nSub"), (2, "One")], "doc_id long, text string"))
    actions = spark.createDataFrame(
        [(1, 5, 0, "highlight", "document", None, None), (1, 5, 1, "replace", "document", None, "the"), (1, 6, 0, "case", "heading", None, None), (2, 1, 0, "delete", "table", None, None), (2, 2, 0, "select", None, ["2.1", "gone"], None), (3, 1, 0, "select", "heading", None, None)],
        "doc_id long, seq long, i int, type string, target string, node_ids array<string>, find string",
    )
    got = {}
    for r in sorted(live.told(nodes, actions).collect(), key=lambda r: (r.doc_id, r.seq, r.n)):
        assert r.n == len(got.setdefault((r.doc_id, r.seq), []))
        got[r.doc_id, r.seq].append((r.i, r.event, r.node_id, r.total))
    texts = [(r.node_id, r.content) for r in sorted(nodes.collect(), key=lambda r: r.sort_path) if r.doc_id == 1 and r.type not in ("table", "table_row", "page_break", "figure")]
    assert got[1, 5] == [
        (None, "batch_started", None, 2), (0, "format_started", None, len(texts)), *[(0, "format_progress", i, None) for i, _ in texts], (0, "format_finished", None, len(texts)),
        (1, "replace_started", None, len(texts)), *[(1, "replace_item", i, None) for i, t in texts if "the" in t], (1, "replace_finished", None, len(texts)), (None, "batch_finished", None, 2),
    ]
    assert got[2, 1] == [(None, "batch_started", None, 1), (0, "delete_started", None, 0), (0, "delete_finished", None, 0), (None, "batch_finished", None, 1)]
    assert got[2, 2][1:3] == [(0, "selection_started", None, 1), (0, "selection_item", "2.1", None)]
    assert got[3, 1][1] == (0, "selection_started", None, 0)


def test_a_kept_batch_is_worked_out_once(spark, tmp_path):
    """A batch that its work reads twice takes its way through the stream once."""
    files(spark, tmp_path, [(1, BEGIN, k, "say") for k in range(10)], 1)(0)
    seen = spark.sparkContext.accumulator(0)

    def counted(order):
        seen.add(1)
        return order

    stream = source(spark, tmp_path).select(F.udf(counted, "long")("order").alias("order"))
    twice = lambda b: b.join(b.groupBy("order").agg(F.count("*").alias("n")), "order")
    live.each_batch(stream, str(tmp_path / "out"), str(tmp_path / "cp"), twice, keep=True).awaitTermination()
    assert seen.value == 10 and spark.read.parquet(str(tmp_path / "out")).count() == 10
