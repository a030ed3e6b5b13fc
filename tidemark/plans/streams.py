"""Queries: streams over the events table, run until they have caught up; pages as paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.inputs import ROWS_PER_TASK
from tidemark.plans.logs import BREAKER_SQL
from tidemark.sources import html
from tidemark.sources.storage import fresh_path, written
from tidemark.sources.tables import table
from tidemark.streaming import jobs, stateful


def stream_hour_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.drained(jobs.counts_by_hour(jobs.events_stream(spark, sf)), "complete")
    return out.select(F.col("start").cast("long").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding_failures(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.drained(jobs.sliding_failures(jobs.events_stream(spark, sf)), "complete")
    return out.select(F.col("start").cast("long").alias("start"), "user_id", "failures")


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.drained(jobs.sessions(jobs.events_stream(spark, sf)), "complete")
    return out.select(F.col("start").cast("long").alias("start"), "user_id", "events")


def stream_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each event is an object in two fragments of its user's stream."""
    e = jobs.events_stream(spark, sf)
    whole = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit("}\n"))
    parts = F.explode(F.array(F.struct((F.col("event_id") * 2).alias("seq"), F.substring(whole, 1, 5).alias("fragment")), F.struct((F.col("event_id") * 2 + 1).alias("seq"), F.substring(whole, F.lit(6), F.lit(99)).alias("fragment"))))
    rows = e.select(F.col("user_id").alias("stream_id"), parts.alias("x")).select("stream_id", "x.seq", "x.fragment", F.lit(False).alias("last"))
    out = jobs.drained(jobs.records(rows), "append")
    return out.select("stream_id", F.get_json_object("record", "$.id").cast("long").alias("event_id"))


def stream_breaker(spark: SparkSession, sf: str) -> DataFrame:
    e = jobs.events_stream(spark, sf)
    calls = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("service"), F.col("event_id").cast("double").alias("t"), (F.col("event_type") == "error").alias("bad"))
    return jobs.drained(jobs.breaker(calls, limit=1, cool=500.0), "append")


def stream_session_state(spark: SparkSession, sf: str) -> DataFrame:
    """Users as sessions that forget after a day; purchases and visits are topics."""
    e = jobs.events_stream(spark, sf)
    topic = F.when(F.col("event_type").isin("purchase", "view"), F.col("event_type"))
    turns = e.select(F.col("user_id").cast("string").alias("session"), F.unix_micros("ts").cast("double").alias("t"), topic.alias("topic"), "ts")
    return jobs.drained(stateful.session_state(turns, ttl=86_400e6), "append")


def stream_ordered_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events are lines of one stream, in three fragments each. The second fragments of all arrive first."""
    e, at = table(spark, sf, "events"), fresh_path(spark)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    line = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit("}\n"))
    cut = ((0, 1, 4), (1, 5, 4), (2, 9, 99))
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.substring(line, a, k).alias("fragment")) for i, a, k in cut)))
    lines = e.select("user_id", "event_id", n.alias("n"))  # numbered before a line becomes three rows
    rows = lines.select("user_id", "n", parts.alias("x")).select(F.col("user_id").alias("stream_id"), (F.col("n") * 3 + F.col("x.i")).cast("long").alias("seq"), "x.fragment")
    rows = written(rows.withColumn("last", F.lit(False)))
    files = max(2, -(-rows.count() // (3 * ROWS_PER_TASK)))  # of the second fragments, and as many of the others: a batch each
    for second in (True, False):
        rows.where((F.col("seq") % 3 == 1) == second).repartition(files).write.mode("append").parquet(at)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(at)
    out = jobs.drained(stateful.ordered_records(stream), "append")
    return out.select("stream_id", "n", F.get_json_object("record", "$.id").cast("long").alias("event_id"))


def html_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    p = html.paragraphs(table(spark, sf, "pages"))
    return p.select(F.col("id").alias("page_id"), "n", "path", F.md5("text").alias("digest"))


QUERIES = {f.__name__: f for f in (stream_hour_counts, stream_sliding_failures, stream_sessions, stream_records, stream_ordered_records, stream_breaker, stream_session_state, html_paragraphs)}

SQL = {
    "stream_hour_counts": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding_failures": """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) // 43200 AS h FROM events WHERE event_type = 'error')
  SELECT (h - k) * 43200 AS start, user_id, count(*) AS failures FROM e, (VALUES (0), (1)) t(k) GROUP BY ALL""",
    "stream_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
  SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS start, user_id, count(*) AS events FROM s GROUP BY user_id, n""",
    "stream_session_state": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session, CAST(epoch_us(ts) AS DOUBLE) AS t, CASE WHEN event_type IN ('purchase', 'view') THEN event_type END AS topic FROM events),
  g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session ORDER BY t) <= 86400e6 THEN 0 ELSE 1 END AS new FROM e), r AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY t) AS run FROM g)
  SELECT session, t, CAST(row_number() OVER w AS INTEGER) AS n, last_value(topic IGNORE NULLS) OVER w AS topic FROM r WINDOW w AS (PARTITION BY session, run ORDER BY t)""",
    "stream_breaker": BREAKER_SQL.format(service="'u' || user_id", bad="event_type = 'error'", limit=1, cool=500) + "SELECT service, CAST(t AS DOUBLE) AS t, state FROM w WHERE i > 0",
    "stream_ordered_records": "SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, event_id FROM events",
    "stream_records": "SELECT user_id AS stream_id, event_id FROM events",
}
