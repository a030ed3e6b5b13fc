"""Queries: feedback, entities, versions, calls, caches, traces and small sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import logs as lg
from tidemark.operators import retrieval as rt
from tidemark.operators import state as st
from tidemark.plans.inputs import given, plain
from tidemark.sources.tables import table

#: Ratings of messages.
FEEDBACK = """
SELECT event_id AS feedback_id, CAST(user_id % 20 AS BIGINT) AS session_id, CAST(event_id % 60 AS BIGINT) AS message_id, CASE WHEN event_id % 3 = 0 THEN 'up' ELSE 'down' END AS rating,
  CASE WHEN event_id % 4 = 0 THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN event_id % 5 = 0 THEN event_type END AS correction FROM {events}"""


def _triaged(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    # A message's number: conversations have fewer than a thousand turns.
    messages = c.select(F.col("conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "role", "content", F.split(F.lit("a.md||b.md|a.md"), r"\|").alias("sources"))
    f = given(spark, sf, FEEDBACK).withColumn("message_id", F.col("message_id") * 1000 + 1)
    return st.triaged(f, messages).join(f.select("feedback_id", "correction"), "feedback_id")


def feedback_triage(spark: SparkSession, sf: str) -> DataFrame:
    return _triaged(spark, sf).select("feedback_id", "state", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


def badcase_samples(spark: SparkSession, sf: str) -> DataFrame:
    cases = _triaged(spark, sf).where("state = 'to_classify'").withColumn("kind", F.when(F.col("feedback_id") % 2 == 0, "hallucination"))
    return st.badcase_samples(cases).select("id", F.md5("question").alias("question"), "ground_truth", F.array_join("docs", ",").alias("docs"), "question_type")


TRIAGE_SQL = f"""
WITH m AS (SELECT conv_id * 1000 + turn AS message_id, text AS answer, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations),
f AS (SELECT * REPLACE (message_id * 1000 + 1 AS message_id) FROM ({plain(FEEDBACK)}) WHERE status = 'pending'),
t AS (SELECT f.*, CASE WHEN rating = 'down' THEN 'to_classify' ELSE 'rejected' END AS state, CASE WHEN m.message_id IS NOT NULL THEN coalesce(question, '') END AS question, answer FROM f LEFT JOIN m USING (message_id) WHERE rating <> 'down' OR m.message_id IS NOT NULL)
"""

CATEGORIES = {"error": ("error", "err"), "buy": ("purch", "purchase"), "visit": ("view", "click")}
COMPANIES = ("sign", "chase", "up")


def entity_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.array_join(st.entities(F.col("event_type"), CATEGORIES, COMPANIES), ",").alias("entities"))


def memory_trigger(spark: SparkSession, sf: str) -> DataFrame:
    idle = F.col("event_id") % 100
    why, sure = st.trigger(F.col("event_type"), ("error",), ("sign",), F.when(F.col("user_id") % 2 == 0, F.array(F.lit("purch"))), ("vie",), F.when(F.col("event_id") % 7 != 0, idle))
    return table(spark, sf, "events").select("event_id", why.alias("why"), sure.alias("sure"))


#: Groups of versions and what happened to them.
VERSIONS = "SELECT o_custkey AS grp, 'v' || (o_orderkey % 4) AS version, o_orderkey AS seq, CASE o_orderkey % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'activate' WHEN 2 THEN 'delete' ELSE 'create' END AS action FROM {orders}"


def version_changes(spark: SparkSession, sf: str) -> DataFrame:
    changes = given(spark, sf, VERSIONS).withColumnRenamed("grp", "group")
    start = changes.select("group").distinct().select("group", F.lit("v0").alias("version"), F.lit(True).alias("active"))
    return st.versions_after(start, changes).withColumnRenamed("group", "grp")


VERSIONS_SQL = f"""
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY seq) AS i FROM ({plain(VERSIONS)})),
w AS (SELECT DISTINCT grp, 0::BIGINT AS i, ['v0'] AS have, 'v0' AS now FROM c
  UNION ALL SELECT c.grp, c.i,
    CASE WHEN action = 'create' THEN list_distinct(list_append(have, version)) WHEN action = 'delete' AND version <> now THEN list_filter(have, lambda x: x <> version) ELSE have END,
    CASE WHEN action = 'create' OR (action = 'activate' AND list_contains(have, version)) THEN version ELSE now END
  FROM w JOIN c ON c.grp = w.grp AND c.i = w.i + 1),
e AS (SELECT grp, have, now FROM w QUALIFY row_number() OVER (PARTITION BY grp ORDER BY i DESC) = 1)
SELECT grp, version, version = now AS active FROM (SELECT grp, now, unnest(have) AS version FROM e)"""


def call_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = st.call_stats(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", "value", last=10)
    return s.withColumn("mean_latency", F.round("mean_latency", 4))


def cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    log = lg.ttl_hits(table(spark, sf, "events"), ["user_id", "event_type"], "ts", 86_400)
    return st.cache_stats(log, "event_type")


def cache_trend(spark: SparkSession, sf: str) -> DataFrame:
    """By minute, of the last seven days before the end of January 2024."""
    at = F.window(F.col("ts").cast("timestamp"), "1 minute").start
    e = table(spark, sf, "events").where(F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz"))
    return e.groupBy(at.cast("long").alias("at")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def trace_page(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("name"), F.col("ts").alias("created_at"), F.when(F.col("user_id") % 2 == 0, "ok").otherwise("error").alias("status"))
    found = st.trace_filter(e, status="ok", name="i", since="2024-01-03", until="2024-01-20")
    return st.page_of(found, [F.desc("created_at"), F.desc("event_id")], 2, 20).select("event_id", "name")


def answer_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(st.tokens_of(F.col("text"))).alias("n", "token")).groupBy("conv_id", "turn").agg(
        F.count("*").alias("tokens"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x.token), "|")).alias("digest")
    )


def value_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    f = st.frequencies(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")
    return f.select("o_orderpriority", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",").alias("counts"))


def metric_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics that either of two runs has."""
    e = table(spark, sf, "events")
    return e.where("user_id % 2 = 0").select("event_type").union(e.where("user_id % 2 = 1").select("event_type")).distinct()


def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["'), "event_type", F.lit('","x"]'))).when(F.col("event_id") % 3 == 1, F.lit("not json"))
    return table(spark, sf, "events").select("event_id", F.array_join(st.decoded(said, "array<string>"), ",").alias("items"))


def containment_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "nation").select(F.concat(F.replace(F.col("n_name"), F.lit(" "), F.lit("_")), F.lit(".md")).alias("doc"))
    hits = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("hit"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.replace(F.col("n_name"), F.lit(" "), F.lit("_")), F.lit(".md"))).otherwise(F.concat(F.lit("the "), "n_name", F.lit(" act"))).alias("source")
    )
    return st.contained(docs, hits)


def regulation_markdown(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = c.select("r_name", "n_nationkey", F.col("n_name").alias("title"), F.concat(F.lit("body "), "n_name").alias("body"), F.create_map(F.lit("key"), F.col("n_nationkey").cast("string"), F.lit("area"), F.col("r_name")).alias("meta"))
    return st.markdown_regulation(c, "r_name", "n_nationkey", {"regulation": "r_name"})


def rerank_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of each order with a model's scores: by score, those without one last, ties in the order they came."""
    hits = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey") % 10 / 10).alias("score"))
    scored = hits.withColumn("score", F.coalesce("score", F.lit(-1.0)))
    return rt.top_per_query(scored, 3).select("query_id", "id.l_linenumber", "id.l_partkey", "id.l_suppkey", "rank")


def answer_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of a conversation as records of a stream, and that it is done."""
    c = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.md5("text").alias("record"))
    return st.with_done(c, "conv_id", "turn", "record")


def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", tx.cache_key(F.lit("retrieval"), F.col("text")).alias("key"))


QUERIES = {f.__name__: f for f in (
    feedback_triage, badcase_samples, entity_extraction, memory_trigger, version_changes, call_stats, cache_stats, cache_trend, trace_page, answer_tokens,
    value_frequencies, metric_keys, json_fields, containment_join, regulation_markdown, rerank_apply, answer_stream, cache_keys,
)}

SQL = {
    "answer_stream": "SELECT conv_id, turn, md5(text) AS record FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, max(turn) + 1, '{\"type\": \"done\"}' FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
    "cache_keys": "SELECT item_id, 'retrieval:' || sha256('retrieval:' || text) AS key FROM benchmark",
    "feedback_triage": TRIAGE_SQL + "SELECT feedback_id, state, md5(question) AS question, md5(answer) AS answer FROM t",
    "badcase_samples": TRIAGE_SQL + "SELECT 'bc_' || feedback_id AS id, md5(question) AS question, coalesce(correction, '') AS ground_truth, 'a.md,b.md' AS docs, CASE WHEN feedback_id % 2 = 0 THEN 'hallucination' ELSE 'factual' END AS question_type FROM t WHERE state = 'to_classify' AND question <> ''",
    "entity_extraction": """SELECT event_id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN contains(event_type, 'error') THEN 'error' WHEN contains(event_type, 'err') THEN 'err' END, CASE WHEN contains(event_type, 'purch') THEN 'purch' WHEN contains(event_type, 'purchase') THEN 'purchase' END,
  CASE WHEN contains(event_type, 'view') THEN 'view' WHEN contains(event_type, 'click') THEN 'click' END, CASE WHEN contains(event_type, 'sign') THEN 'sign' END, CASE WHEN contains(event_type, 'chase') THEN 'chase' END, CASE WHEN contains(event_type, 'up') THEN 'up' END], lambda x: x IS NOT NULL))), ',') AS entities FROM events""",
    "memory_trigger": """WITH e AS (SELECT event_id, CASE WHEN contains(event_type, 'error') THEN 'keyword' WHEN contains(event_type, 'sign') THEN 'company' WHEN user_id % 2 = 0 AND contains(event_type, 'purch') THEN 'entity' WHEN contains(event_type, 'vie') THEN 'topic'
  WHEN event_id % 7 = 0 OR event_id % 100 >= 60 THEN 'interval' ELSE 'skip' END AS why FROM events)
SELECT event_id, why, CASE why WHEN 'keyword' THEN 0.9::DOUBLE WHEN 'company' THEN 0.85 WHEN 'entity' THEN 0.7 WHEN 'topic' THEN 0.6 WHEN 'interval' THEN 0.5 ELSE 0 END AS sure FROM e""",
    "version_changes": VERSIONS_SQL,
    "call_stats": """WITH r AS (SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10), m AS (SELECT user_id, avg(value) AS mean FROM r GROUP BY user_id)
SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures, round((count(*) FILTER (event_type <> 'error'))::DOUBLE / count(*), 4) AS success_rate, round(any_value(mean), 4) AS mean_latency FROM events JOIN m USING (user_id) GROUP BY user_id""",
    "cache_stats": """WITH h AS (SELECT event_type, coalesce(CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 86400, false) AS hit FROM events)
SELECT event_type, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END), 4) AS rate FROM h GROUP BY ROLLUP (event_type)""",
    "cache_trend": "SELECT CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS at, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY ALL",
    "trace_page": "SELECT event_id, event_type AS name FROM events WHERE user_id % 2 = 0 AND contains(event_type, 'i') AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-21' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20",
    "answer_tokens": "WITH t AS (SELECT conv_id, turn, i, substring(text, i, 4) AS token FROM (SELECT conv_id, turn, text, unnest(generate_series(1, length(text), 4)) AS i FROM conversations WHERE length(text) > 0)) SELECT conv_id, turn, count(*) AS tokens, md5(string_agg(token, '|' ORDER BY i)) AS digest FROM t GROUP BY ALL",
    "value_frequencies": "WITH n AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderpriority, string_agg(o_orderstatus || '=' || n, ',' ORDER BY o_orderstatus) AS counts FROM n GROUP BY o_orderpriority",
    "metric_keys": "SELECT DISTINCT event_type FROM events",
    "json_fields": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || ',x' ELSE '' END AS items FROM events",
    "containment_join": """WITH d AS (SELECT replace(n_name, ' ', '_') || '.md' AS doc, replace(replace(replace(n_name, ' ', '_') || '.md', '.md', ''), '_', '') AS name FROM nation),
h AS (SELECT s_suppkey AS hit, CASE WHEN s_suppkey % 3 = 0 THEN replace(n_name, ' ', '_') || '.md' ELSE 'the ' || n_name || ' act' END AS source FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT DISTINCT doc, hit FROM d JOIN h ON doc = source OR contains(source, name)""",
    "regulation_markdown": """SELECT r_name, '---' || chr(10) || 'regulation: ' || r_name || chr(10) || '---' || chr(10) || chr(10) || string_agg('## ' || n_name || chr(10) || chr(10) || '> **元数据**: area=' || r_name || ' | key=' || n_nationkey || chr(10) || chr(10) || 'body ' || n_name, chr(10) || chr(10) ORDER BY n_nationkey) || chr(10) AS text
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "rerank_apply": """SELECT l_orderkey AS query_id, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_partkey % 4 <> 0 THEN l_partkey % 10 / 10.0::DOUBLE ELSE -1 END DESC, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS rank
FROM lineitem QUALIFY rank <= 3""",
}
