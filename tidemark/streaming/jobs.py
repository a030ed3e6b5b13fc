"""Streams: counts by window, sessions, sliding failures, records from fragments, a circuit breaker with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.storage import fresh_path
from tidemark.streaming.stateful import is_record, state_store


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files; ts as a timestamp, late by at most two days."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A bounded number of files at a time, and so bounded rows of a key.
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/event[s].parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 days")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there, into a table in the shared folder, and reads that.

    Every batch has a folder of its own, which it overwrites, so that a batch that is tried again leaves its rows once; in
    complete mode each batch holds the whole result and takes the place of the last.
    """
    spark = stream.sparkSession
    at = fresh_path(spark)
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/batch=-1")  # a stream without rows leaves an empty table

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch={0 if mode == 'complete' else n}")

    with state_store(spark):
        query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", at).parquet(at).select(*stream.columns)


def counts_by_hour(events: DataFrame) -> DataFrame:
    w = F.window("ts", "1 hour")
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def sliding_failures(events: DataFrame) -> DataFrame:
    w = F.window("ts", "1 day", "12 hours")
    return events.where("event_type = 'error'").groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("failures")).select(
        F.col("w.start").alias("start"), "user_id", "failures"
    )


def sessions(events: DataFrame) -> DataFrame:
    w = F.session_window("ts", "1 day")
    return events.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), "events")


def records(fragments: DataFrame) -> DataFrame:
    """stream_id, record from stream_id, seq, fragment, last: the buffer of each stream is state; `last` flushes it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = state.get[0] if state.exists else ""
        rows = pd.concat([b for b in batches if len(b)]).sort_values("seq")
        out = []
        for text, last in zip(rows["fragment"], rows["last"], strict=True):
            *whole, buffer = (buffer + text).split("\n")
            if last:
                whole, buffer = [*whole, buffer], ""
            out += [(key[0], line) for line in map(str.strip, whole) if is_record(line)]
        state.update((buffer,))
        yield pd.DataFrame(out, columns=["stream_id", "record"])

    return fragments.groupBy("stream_id").applyInPandasWithState(
        run, "stream_id long, record string", "buffer string", "append", GroupStateTimeout.NoTimeout
    )


def breaker(calls: DataFrame, limit: int = 5, cool: float = 60.0) -> DataFrame:
    """service, t, state from service, t (seconds), bad: `limit` failures in a row open a breaker for `cool` seconds."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, since = state.get if state.exists else (0, -1.0)
        rows = pd.concat([b for b in batches if len(b)]).sort_values("t")
        out = []
        for t, bad in zip(rows["t"], rows["bad"], strict=True):
            if since >= 0 and t - since < cool:
                out.append((key[0], t, "open"))
                continue
            half = since >= 0
            n = n + 1 if bad else 0
            if bad and (half or n >= limit):
                n, since = 0, float(t)
                out.append((key[0], t, "open"))
            else:
                since = -1.0
                out.append((key[0], t, "half_open" if half else "closed"))
        state.update((n, since))
        yield pd.DataFrame(out, columns=["service", "t", "state"])

    return calls.groupBy("service").applyInPandasWithState(
        run, "service string, t double, state string", "n int, since double", "append", GroupStateTimeout.NoTimeout
    )
