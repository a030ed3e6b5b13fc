"""Streams whose state is kept by key and forgotten again: ordered records of fragments, sessions that end."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start within it keep their state in RocksDB, as timers and state of several kinds need.

    They run no batches without data: one whose state may expire would else ask for another for ever, and never be drained.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def is_record(line: str) -> bool:
    """Whether a line is JSON that says something."""
    if line in ("", "[]", "{}"):
        return False
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


#: Fragments that wait are kept by blocks of this many numbers, one entry of the state each.
BLOCK = 256
#: One of more characters has an entry of its own, so that a block stays small.
LONG = 256


class Fragments(StatefulProcessor):
    """Lines of a stream whose fragments are numbered from 0. One that comes early is held until those before it are there."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # since: when it came. Other fragments of its block, written later, don't keep it longer.
        self.held = handle.getMapState("held", "block long", "seqs array<long>, fragments array<string>, lasts array<boolean>, since array<long>", self.ttl_ms)
        self.long = handle.getMapState("long", "seq long", "fragment string", self.ttl_ms)
        self.place = handle.getValueState("place", "seq long, n long, buffer string, waiting long", self.ttl_ms)

    def waiting_in(self, block: int, seq: int, now: int) -> dict[int, tuple]:
        """Of a block's fragments from seq on that are still kept, by number: fragment (null if long), last, since. It is the one block in memory."""
        if block != self.block:
            self.keep()
            found = self.held.getValue((block,))
            rows = zip(*found, strict=True) if found else ()
            self.block, self.there = block, {at: (*row, since) for at, *row, since in rows if at >= seq and (self.ttl_ms <= 0 or since + self.ttl_ms > now)}
        return self.there

    def keep(self) -> None:
        """Writes the block that is in memory, if fragments came to it. Of one they only left, those below the stream's place are passed over when it is read."""
        if self.came:
            self.held.updateValue((self.block,), tuple(map(list, zip(*((at, *row) for at, row in self.there.items()), strict=True))))
        self.block, self.there, self.came = None, {}, False

    def hold(self, at: int, text: str | None, last: bool, seq: int, now: int) -> bool:
        """Whether a fragment is held: of two with one number the first is."""
        there = self.waiting_in(at // BLOCK, seq, now)
        if at in there:
            return False
        text = text or ""
        if len(text) > LONG:
            self.long.updateValue((at,), (text,))
            text = None
        there[at], self.came = (text, last, now), True
        return True

    def taken(self, seq: int, now: int) -> tuple | None:
        """Fragment and last of the number seq, if it is held. A block goes with the last that waits in it."""
        there = self.waiting_in(seq // BLOCK, seq, now)
        if seq not in there:
            return None
        text, last, _ = there.pop(seq)
        if text is None:
            text = self.long.getValue((seq,))[0]
            self.long.removeKey((seq,))
        if not there:
            self.held.removeKey((self.block,))
            self.came = False
        return text, last

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        seq, n, buffer, waiting = self.place.get() or (0, 0, "", 0)
        self.block, self.there, self.came = None, {}, False
        for b in rows:  # a part of the key's rows; no more of them are in memory
            found = []
            for at, text, last in sorted(zip(b["seq"].tolist(), b["fragment"].tolist(), b["last"].tolist(), strict=True), key=itemgetter(0)):
                if at > seq:
                    waiting += self.hold(at, text, last, seq, now)
                coming = (text, last) if at == seq else None  # if not, it waits, or came before
                while coming:
                    text, last = coming
                    seq += 1
                    *whole, buffer = (buffer + (text or "")).split("\n")
                    if last:
                        whole, buffer = [*whole, buffer], ""
                    for line in map(str.strip, whole):
                        if is_record(line):
                            found.append((key[0], n, line))
                            n += 1
                    coming = self.taken(seq, now) if waiting else None
                    waiting -= coming is not None
            self.keep()
            if found:
                yield pd.DataFrame(found, columns=["stream_id", "n", "record"])
        self.place.update((seq, n, buffer, waiting))

    def close(self) -> None:
        pass


def ordered_records(fragments: DataFrame, ttl_seconds: float = 86_400) -> DataFrame:
    """stream_id, n (from 0), record: the JSON lines of each stream, in the order of its fragments, however they arrive.

    fragments: stream_id, seq (0, 1, 2, ...), fragment, last (nothing follows: what is left is a line). A number that comes
    again is passed over, as is a null one; null text is empty; blank, empty and broken lines are left out. What a stream has
    kept, its place and the fragments that wait for one before them, is forgotten ttl_seconds after it was last written.
    """
    rows = fragments.select(*(fragments[c].cast(t).alias(c) for c, t in (("stream_id", "long"), ("seq", "long"), ("fragment", "string"), ("last", "boolean")))).where("seq IS NOT NULL")
    how = {"outputMode": "append", "timeMode": "ProcessingTime"}
    return rows.groupBy("stream_id").transformWithStateInPandas(Fragments(int(ttl_seconds * 1000)), "stream_id long, n long, record string", **how)


class Sessions(StatefulProcessor):
    """Turns and topic of a session; a timer in event time ends it."""

    def __init__(self, ttl_us: float):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "n int, topic string, last double, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, topic, last, timer = self.state.get() if self.state.exists() else (0, None, None, None)
        turns = pd.concat(list(rows)).sort_values("t")
        out = []
        for t, said in zip(turns["t"].tolist(), turns["topic"].tolist(), strict=True):
            if last is not None and t - last > self.ttl_us:
                n, topic = 0, None
            n, last = n + 1, t if last is None else max(t, last)
            topic = said if isinstance(said, str) else topic
            out.append((key[0], t, n, topic))
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = int((last + self.ttl_us) // 1000) + 1
        self.handle.registerTimer(timer)
        self.state.update((n, topic, last, timer))
        yield pd.DataFrame(out, columns=["session", "t", "n", "topic"]).astype({"n": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"session": [], "t": [], "n": [], "topic": []}).astype({"session": "object", "t": "float64", "n": "int32", "topic": "object"})

    def close(self) -> None:
        pass


def session_state(turns: DataFrame, ttl: float = 3600e6) -> DataFrame:
    """session, t, n, topic: how many turns a session has had and the topic it carries on, as of each turn.

    turns: session, t (microseconds), topic, and the column of the stream's watermark. A turn without a topic carries on the
    last one; after `ttl` microseconds without a turn a session starts anew. Its state goes once the watermark says that no
    turn of it can come any more.
    """
    how = {"outputMode": "append", "timeMode": "EventTime"}
    return turns.groupBy("session").transformWithStateInPandas(Sessions(ttl), "session string, t double, n int, topic string", **how)
