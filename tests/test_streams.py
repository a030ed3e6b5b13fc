"""Streams in several micro-batches: order, repeats, expiry of state."""

from __future__ import annotations

import random
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues

from tests.oracle import differences
from tidemark.plans import streams
from tidemark.streaming import jobs, stateful

FRAGMENT = "stream_id long, seq long, fragment string, last boolean"
TURN = "session string, t double, topic string, ts timestamp"


@pytest.fixture
def play(spark, tmp_path):
    """Runs a stream over lists of rows, one micro-batch each, and gives what each batch put out."""

    def run(schema, batches, make, between=0.0):
        at, out = str(tmp_path / "in"), []
        for part in [str(tmp_path / "state")]:
            for rows in batches:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
                stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at))
                with stateful.state_store(spark):
                    q = stream.writeStream.outputMode("append").foreachBatch(lambda b, n: out.append(sorted(map(tuple, b.collect()))))
                    q.option("checkpointLocation", part).trigger(availableNow=True).start().awaitTermination(120)
                time.sleep(between)
        return out

    return run


def test_fragments_in_any_order(play):
    batches = [
        [(1, 3, 'd"}\n[]\n', False), (1, 1, '"x', False), (2, 0, "7\n8", False)],
        [(1, 0, '{"k": ', False), (1, 1, "again", False), (2, 1, "9\n", False), (3, 1, "late", False)],
        [(1, 2, "bc", False), (2, 0, "old", False), (2, 2, "  \nbroken{\n5", True), (1, 4, None, False)],
    ]
    got = play(FRAGMENT, batches, stateful.ordered_records)
    assert got == [[(2, 0, "7")], [(2, 1, "89")], [(1, 0, '{"k": "xbcd"}'), (2, 2, "5")]]


def test_fragments_without_a_number(play):
    batches = [[(1, None, "x\n", False), (1, 1, "2\n", False)], [(1, 0, "1\n", False), (1, None, "3\n", False)]]
    assert play(FRAGMENT, batches, stateful.ordered_records) == [[], [(1, 0, "1"), (1, 1, "2")]]


def test_fragments_are_forgotten(play):
    """The first fragment of stream 1 has expired when the second comes, which then waits in vain."""
    batches = [[(1, 0, "1\n2", False)], [(1, 1, "3\n", False)]]
    assert play(FRAGMENT, batches, lambda s: stateful.ordered_records(s, ttl_seconds=0.5), between=2.0) == [[(1, 0, "1")], []]


def test_waiting_fragments_share_entries(spark, tmp_path):
    """1,000 fragments that wait are a few entries of the state, not one each; a long one has its own."""
    text = {i: f'{{"id": {i}}}\n' if i != 501 else f'{{"id": "{"x" * 5000}"}}\n' for i in range(2000)}
    at, entries, got = str(tmp_path / "in"), [], []
    for part in (1, 0):
        rows = [(7, i, text[i], False) for i in range(part, 2000, 2)]
        spark.createDataFrame(rows, FRAGMENT).coalesce(1).write.mode("append").parquet(at)
        with stateful.state_store(spark):
            q = stateful.ordered_records(spark.readStream.schema(FRAGMENT).parquet(at)).writeStream.foreachBatch(lambda b, n: got.extend(map(tuple, b.collect())))
            q = q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination(120)
        entries.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sorted(got) == [(7, i, text[i].strip()) for i in range(2000)]
    assert entries[0] <= 20 and entries[1] == 1


class Kept(dict):
    """State of a stream, as a processor sees it."""

    def get(self):
        return self.getValue(())

    def update(self, value):
        self[()] = value

    getValue = dict.get
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__


def fragments(ttl_ms):
    f = stateful.Fragments(ttl_ms)
    f.held, f.long, f.place = Kept(), Kept(), Kept()
    play = lambda now, *parts: [tuple(r) for d in f.handleInputRows((1,), (pd.DataFrame(p, columns=["seq", "fragment", "last"]) for p in parts), TimerValues(now)) for r in d.itertuples(index=False)]
    return f, play


def test_fragment_is_forgotten_by_its_own_time():
    """One that came to its block later keeps an earlier one no longer."""
    f, play = fragments(100)
    assert play(0, [(2, "2\n", False)]) == play(60, [(3, "3\n", False)]) == []
    assert play(110, [(0, "0\n", False), (1, "1\n", False)]) == [(1, 0, "0"), (1, 1, "1")]
    assert play(120, [(2, "9\n", False)]) == [(1, 2, "9"), (1, 3, "3")]
    assert not f.held


@pytest.mark.parametrize("seed", range(20))
def test_fragments_in_blocks(seed, monkeypatch):
    """Any order, repeats and long fragments, in batches of parts; nothing is left in the state."""
    monkeypatch.setattr(stateful, "BLOCK", 4)
    monkeypatch.setattr(stateful, "LONG", 3)
    rng = random.Random(seed)
    text = {i: rng.choice(["1", "2\n", "34567\n", None, "8\n9\n", ""]) for i in range(60)}
    order = [i for i in text for _ in range(rng.choice([1, 1, 1, 3]))]
    rng.shuffle(order)
    order += [-1, 0, 59]
    f, play = fragments(10**6)
    got = []
    while order:
        parts = []
        for _ in range(rng.randint(1, 3)):
            part, order = order[: (k := rng.randint(1, 9))], order[k:]
            if part:
                parts.append([(i, text.get(i, "5\n"), False) for i in part])
        got += play(len(order), *parts)
    want = [x for x in "".join(t or "" for t in text.values()).split("\n")[:-1] if x]
    assert got == [(1, n, x) for n, x in enumerate(want)]
    assert not f.held and not f.long
    assert f.place.get()[0] == 60 and f.place.get()[3] == 0


def test_ordered_records_in_more_files(spark, sf_dir, monkeypatch):
    """Files follow the rows; the second fragments are one batch, the others the next."""
    monkeypatch.setattr(streams, "ROWS_PER_TASK", 200, raising=False)
    made, real = [], streams.fresh_path
    monkeypatch.setattr(streams, "fresh_path", lambda spark: made.append(real(spark)) or made[-1])
    assert differences(streams.stream_ordered_records, streams.SQL["stream_ordered_records"], spark, sf_dir) == ""
    assert len(list(Path(made[0].removeprefix("file:")).glob("*.parquet"))) == 10


def test_sessions_end(spark, play):
    """A session's state goes when the watermark has passed its end, whether or not it has another turn."""
    at = lambda s: F.timestamp_seconds(F.lit(s))
    row = lambda k, s, topic: (k, s * 1e6, topic, spark.range(1).select(at(s)).first()[0])
    batches = [
        [row("a", 10, "x"), row("a", 5, "y"), row("b", 10, "z")],
        [row("a", 60, None), row("c", 500, None)],
        [row("c", 505, "w")],
        [row("b", 510, None)],
    ]
    make = lambda s: stateful.session_state(s.withWatermark("ts", "1 second"), ttl=100e6)
    got = play(TURN, batches, make)
    assert got[0] == [("a", 5e6, 1, "y"), ("a", 10e6, 2, "x"), ("b", 10e6, 1, "z")]
    assert got[1] == [("a", 60e6, 3, "x"), ("c", 500e6, 1, None)]
    assert got[-1] == [("b", 510e6, 1, None)]


def test_settings_are_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with pytest.raises(ZeroDivisionError), stateful.state_store(spark):
        assert spark.conf.get(key) == stateful.ROCKS
        1 / 0
    assert spark.conf.get(key, None) == before


def test_records(spark):
    assert [stateful.is_record(x) for x in ("", "{}", "[]", '{"a": 1}', "nope", "3")] == [False, False, False, True, False, True]
    assert jobs.is_record is stateful.is_record
