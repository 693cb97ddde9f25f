"""Rooms as streams with state: what a late joiner missed, which rooms stay buffered, and who hears a message."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .hub import BUFFER, HORIZON, ROOMS

#: The state store that arbitrary state needs; a session sets it before its streams start.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HEARD = "doc_id long, joined timestamp, viewer long, ts timestamp, `order` long, event string, n int"


def with_state(spark) -> None:
    """Sets the session's state store, on which state and timers by key rest."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _us(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy("datetime64[us]").astype("int64")


def _columns(state, n: int) -> list[np.ndarray]:
    """The columns of what a list state holds in pieces: times, numbers, texts, and flags if there are so many."""
    pieces = list(state.get()) if state.exists() else []
    kinds = ("int64", "int64", object, bool)[:n]
    return [np.concatenate([np.array([], kind), *[np.array(p[k], kind) for p in pieces]]) for k, kind in enumerate(kinds)]


class Room(StatefulProcessor):
    """One room: what still waits for its turn, and the ring of its last messages.

    Rows wait until the watermark has passed them, so that they take their turns in order of time however they arrived. Then
    a message goes into the ring, and who joins is given what the ring holds of the last ``horizon`` seconds. One timer stands at
    the first row that waits, and takes all that are due; another clears a room of which nothing is left to hear. Rows wait as
    columns, a micro-batch's Arrow batch in one piece, and what is heard leaves in blocks of ``block`` joins.
    """

    def __init__(self, buffer: int, horizon: int, block: int = 5000):
        self.buffer, self.horizon, self.block = buffer, horizon, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts array<long>, order array<long>, event array<string>, joins array<boolean>")
        self.ring = handle.getListState("ring", "ts array<long>, order array<long>, event array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        first = []
        for part in rows:
            got = part[part["ts"].notna()]
            if len(got):
                ts = _us(got["ts"])
                event = got["event"].astype(object).where(got["event"].notna(), None)
                self.waiting.appendList([(ts.tolist(), got["order"].astype("int64").tolist(), event.tolist(), got["joins"].astype(bool).tolist())])
                first.append(int(ts.min()) // 1000)
        if first:
            self.handle.registerTimer(min(first))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        now = timerValues.getCurrentWatermarkInMs()
        ts, order, event, joins = _columns(self.waiting, 4)
        due = ts // 1000 <= now
        late = ~due
        heard = _columns(self.ring, 3)
        ts_, order_, event_, joins_ = (np.concatenate(both) for both in zip((*heard, np.zeros(len(heard[0]), bool)), (c[due] for c in (ts, order, event, joins))))
        turns = np.lexsort((order_, joins_, ts_))  # a message comes before who joins at the same time
        joined, said = turns[joins_[turns]], turns[~joins_[turns]]
        times = ts_[said]
        ends = np.cumsum(~joins_[turns])[joins_[turns]]
        begins = np.maximum(ends - self.buffer, np.searchsorted(times, ts_[joined] - self.horizon * 1_000_000))
        many = np.maximum(ends - begins, 0)
        last = said[-self.buffer:]
        last = last[ts_[last] // 1000 + self.horizon * 1000 >= now]
        for state, mask, columns in ((self.waiting, late, (ts, order, event, joins)), (self.ring, last, (ts_, order_, event_))):
            kept = tuple(c[mask].tolist() for c in columns)
            state.put([kept]) if kept[0] else state.clear()
        if late.any():
            self.handle.registerTimer(int(ts[late].min()) // 1000)
        if len(last):
            self.handle.registerTimer(int(ts_[last[-1]]) // 1000 + self.horizon * 1000 + 1)
        for k in range(0, len(joined), self.block):
            of = np.repeat(np.arange(k, min(k + self.block, len(joined))), many[k:k + self.block])
            n = np.arange(len(of)) - np.repeat(np.cumsum(many[k:k + self.block]) - many[k:k + self.block], many[k:k + self.block]) + 1
            message, viewer = said[ends[of] - n], joined[of]
            if len(of):
                yield pd.DataFrame({
                    "doc_id": key[0], "joined": ts_[viewer].astype("datetime64[us]"), "viewer": order_[viewer], "ts": ts_[message].astype("datetime64[us]"),
                    "order": order_[message], "event": event_[message], "n": n.astype("int32"),
                })
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def replayed(messages: DataFrame, joins: DataFrame, late: str = "0 seconds", buffer: int = BUFFER, horizon: int = HORIZON) -> DataFrame:
    """The stream of what late joiners get: for each join (doc_id, ts, order: the
    ``viewer``) the room's last ``buffer`` messages (doc_id, ts, order,
    event) of the last ``horizon`` seconds, the latest first. The same rows as ``hub.replay_buffer`` gives of tables, for all joins that
    the watermark has passed; rows that come when the
    watermark, ``late`` behind the latest time, has reached them are left out."""
    both = messages.select("doc_id", "ts", "order", "event", F.lit(False).alias("joins")).union(joins.select("doc_id", "ts", "order", F.lit(None).cast("string"), F.lit(True)))
    return both.withWatermark("ts", late).groupBy("doc_id").transformWithStateInPandas(statefulProcessor=Room(buffer, horizon), outputStructType=HEARD, outputMode="Append", timeMode="EventTime")


class Doors(StatefulProcessor):
    """The rooms of a shard that stay buffered: at most ``most``. A room that opens puts the one opened first out."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "doc_id long", "ts timestamp, order long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        rooms = {k[0]: tuple(v) for k, v in self.open.iterator()}
        out = []
        got = sorted((r for part in rows for r in part[["ts", "order", "doc_id"]].itertuples(index=False, name=None)), key=lambda r: (r[0], r[1]))
        for ts, order, room in got:
            ts, order, room = pd.Timestamp(ts).to_pydatetime(), int(order), int(room)
            rooms[room] = (ts, order)
            self.open.updateValue((room,), (ts, order))
            out.append((room, ts, order, True))
            if len(rooms) > self.most:
                first = min(rooms, key=lambda r: (rooms[r], -r))
                out.append((first, *rooms.pop(first), False))
                self.open.removeKey((first,))
        yield pd.DataFrame(out, columns=["doc_id", "ts", "order", "kept"]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


class Opening(StatefulProcessor):
    """Lets a room's first message through."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "ts timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        first = min((r for part in rows for r in part[["ts", "order"]].itertuples(index=False, name=None)), key=lambda r: (r[0], r[1]))
        if self.known.exists():
            yield pd.DataFrame()
            return
        ts = pd.Timestamp(first[0]).to_pydatetime()
        self.known.update((ts,))
        yield pd.DataFrame([(key[0], ts, int(first[1]))], columns=["doc_id", "ts", "order"])

    def close(self) -> None:
        pass


def openings(messages: DataFrame) -> DataFrame:
    """The stream of rooms as they open: each room's first message. Its state is one time a room."""
    return messages.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=Opening(), outputStructType="doc_id long, ts timestamp, `order` long", outputMode="Append", timeMode="None")


def doors(opened: DataFrame, most: int = ROOMS, shards: int = 16) -> DataFrame:
    """The stream of rooms that are buffered (kept) and put out again (not kept), from the stream of openings. Each shard
    of rooms holds its own latest ``most``, so the latest ``most`` of all are among them."""
    shard = opened.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    return shard.groupBy("shard").transformWithStateInPandas(statefulProcessor=Doors(most), outputStructType="doc_id long, ts timestamp, `order` long, kept boolean", outputMode="Append", timeMode="None")


def still_open(moves: DataFrame, most: int = ROOMS) -> DataFrame:
    """The rooms that stay, from the rows that ``doors`` has written so far: at most ``most`` of each shard take part."""
    last = moves.groupBy("doc_id").agg(F.max(F.struct("ts", "order")).alias("opened"), F.min("kept").alias("kept")).where("kept")
    return last.orderBy(F.desc("opened"), "doc_id").limit(most).select("doc_id", F.col("opened.ts").alias("opened"))


def fan_out(messages: DataFrame, visits: DataFrame, late: str = "10 minutes", longest: str = "1 day") -> DataFrame:
    """The stream of who hears what: each message (doc_id, ts, order) with every visit (visit, doc_id, joined, gone) of its room at
    that time, joined <= ts < gone. Both sides have a watermark and visits have a longest time, so messages and visits that
    can meet nothing any more leave the state. Works on tables too."""
    m = messages.select("doc_id", "ts", "order")
    v = visits.select("visit", F.col("doc_id").alias("room"), "joined", "gone")
    if messages.isStreaming:
        m, v = m.withWatermark("ts", late), v.withWatermark("gone", late)
    heard = (F.col("doc_id") == F.col("room")) & (F.col("ts") >= F.col("joined")) & (F.col("ts") < F.col("gone")) & (F.col("ts") >= F.col("gone") - F.expr(f"INTERVAL {longest}"))
    return m.join(v, heard).select("doc_id", "order", "visit", "ts")
