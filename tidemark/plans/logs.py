"""Queries: conversations, memory, cache, versions, observability, changing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import logs as lg
from tidemark.sources.tables import table

BY_TURN = (["conv_id"], ["turn"])


def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with the number of their messages, those without any included."""
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"), "c_name")
    m = table(spark, sf, "conversations").withColumnRenamed("conv_id", "session_id")
    return s.join(m, "session_id", "left").groupBy("session_id", "c_name").agg(F.count("turn").alias("messages"))


def session_search_page(spark: SparkSession, sf: str) -> DataFrame:
    """Second page of ten of a case-insensitive search, with the total."""
    found = table(spark, sf, "customer").where(F.col("c_name").ilike("%customer#%1%"))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("c_name", "c_custkey").offset(10).limit(10).join(F.broadcast(total)).select("c_custkey", "c_name", "total")


def prior_user_question(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    q = lg.last_before(F.col("text"), F.col("role") == "user", *BY_TURN)
    return c.select("conv_id", "turn", "role", F.md5(q).alias("question")).where("role = 'assistant'").drop("role")


def next_answer(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    a = lg.first_after(F.col("turn"), F.col("role") == "assistant", *BY_TURN)
    return c.select("conv_id", "turn", "role", a.alias("answer_turn")).where("role = 'user'").drop("role")


def delete_turn_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Without every fourth user message and the answer that follows it."""
    c = table(spark, sf, "conversations")
    gone = c.select("conv_id", "turn", "role", lg.first_after(F.col("turn"), F.col("role") == "assistant", *BY_TURN).alias("a")).where("role = 'user' and conv_id % 4 = 0")
    keys = gone.select("conv_id", "turn").unionByName(gone.where("a is not null").select("conv_id", F.col("a").alias("turn"))).distinct()
    return c.join(keys, ["conv_id", "turn"], "left_anti").select("conv_id", "turn", "role")


def loop_detection(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", lg.in_loop(F.col("event_type"), "user_id", "event_id").alias("loop"))


def iteration_limit(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", (n >= 10).alias("stopped"))


TOPICS = ["answer", "question", "list", "number", "write", "the", "of"]


def topic_trigger(spark: SparkSession, sf: str) -> DataFrame:
    """The longest keyword in each message, ties in alphabetical order; the ladder of triggers; the time since the last turn."""
    order = sorted(TOPICS, key=lambda k: (-len(k), k))
    hit = F.coalesce(*(F.when(F.contains(F.lower("text"), F.lit(k)), k) for k in order))
    level = F.when(F.length(hit) > 5, 0.9).when(hit.isNotNull(), 0.6).when(F.col("turn") % 5 == 0, 0.5).otherwise(0.0)
    return table(spark, sf, "conversations").select("conv_id", "turn", hit.alias("topic"), level.alias("confidence"))


def entity_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Per conversation: first words of messages, newest first, at most ten, each once."""
    first = F.lower(F.regexp_extract("text", r"^\s*(\w+)", 1))
    c = table(spark, sf, "conversations").select("conv_id", "turn", first.alias("w")).where("w <> ''")
    words = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("turn", "w")))), lambda x: x.w)
    return c.groupBy("conv_id").agg(F.array_join(F.slice(F.array_distinct(words), 1, 10), ",").alias("entities"))


def carried_context(spark: SparkSession, sf: str) -> DataFrame:
    """The last known value at each event, and a clarified question made with it."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w)
    e = table(spark, sf, "events").select("event_id", last.alias("last_value"), "event_type")
    said = F.when(F.col("last_value").isNull(), F.col("event_type")).otherwise(F.concat("event_type", F.lit(" about "), F.col("last_value").cast("int").cast("string")))
    return e.select("event_id", F.round("last_value", 4).alias("last_value"), said.alias("question"))


def memory_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as memories, as of a given day; they span years, and so do the limits."""
    day = F.col("o_orderdate")
    why = lg.memory_state(day, day, F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), F.lit("1998-08-02").cast("timestamp_ntz"), ttl_days=1500, idle_days=700)
    return table(spark, sf, "orders").groupBy(why.alias("state")).agg(F.count("*").alias("n"))


def memory_access(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("access_count"), F.max("event_id").alias("last_event"))
    return e


def profile_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of two profiles joined where the confidence suffices."""
    e = table(spark, sf, "events").where(F.get_json_object("props", "$.k").cast("int") >= 6)
    half = lambda n: F.collect_set(F.when(F.col("event_id") % 2 == n, F.col("event_type")))
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.array_union(half(0), half(1))), ",").alias("interests"))


def memory_compression(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of a conversation by length, longest first, within a budget of characters."""
    w = Window.partitionBy("conv_id").orderBy(F.length("text").desc(), "turn")
    used = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf, "conversations").select("conv_id", "turn", used.cast("long").alias("used")).where("used <= 2000")


def cache_ttl_replay(spark: SparkSession, sf: str) -> DataFrame:
    log = lg.ttl_hits(table(spark, sf, "events"), ["user_id", "event_type"], "ts", 86_400)
    return log.groupBy("event_type").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("rate"))


def cache_trend_minute(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("at", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return e.groupBy(F.col("at").cast("long").alias("at")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def cache_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that stay: within their time to live and of the current version."""
    end = F.lit("2024-01-20").cast("timestamp_ntz")
    e = table(spark, sf, "events")
    return e.where((F.col("ts") >= end - F.expr("interval 7 days")) & (F.get_json_object("props", "$.k").cast("int") % 2 == 0)).select("event_id")


def lockout_windows(spark: SparkSession, sf: str) -> DataFrame:
    n = lg.failures_in(24 * 60, "user_id", "ts", F.col("event_type") == "error")
    return table(spark, sf, "events").select("event_id", n.alias("failures"), (n >= 3).alias("locked"))


def latency_last_n(spark: SparkSession, sf: str) -> DataFrame:
    """Of all calls; the mean of the last hundred, which Spark cuts in each task before they are sorted together."""
    last = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf, "events")
    recent = e.withColumn("n", F.row_number().over(last)).where("n <= 100").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("latency"))
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.max("value"), 6).alias("slowest")).join(recent, "event_type")


def trace_search(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of some days, end day included, second page of twenty, with the total."""
    e = table(spark, sf, "events")
    day = F.lit("2024-01-10").cast("timestamp_ntz")
    found = e.where((F.col("event_type") == "error") & (F.col("ts") >= day) & (F.col("ts") < day + F.expr("interval 6 days")))
    page = found.orderBy(F.desc("event_id")).offset(20).limit(20)
    return page.select("event_id", "user_id", found.agg(F.count("*")).scalar().alias("total"))


def trace_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(
        F.count("*").alias("spans"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 4).alias("duration"),
        F.count_if(F.col("event_type") == "view").alias("model_calls"),
    )


def span_tree_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Depth of spans whose parent is a third of their number; those without a parent are roots."""
    e = table(spark, sf, "events").select("event_id", F.expr("event_id DIV 3").alias("parent"))
    return lg.depths(e, "event_id", "parent").groupBy(F.col("depth").cast("int").alias("depth")).agg(F.count("*").alias("spans"))


def cleanup_preview(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    return e.groupBy("event_type").agg(F.count("*").alias("traces"), F.countDistinct("user_id").alias("sessions"))


def breaker_replay(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("service"), F.col("event_id").alias("t"), (F.col("user_id") % 3 != 0).alias("bad"))
    return lg.breaker_states(e, "service", "t", F.col("bad"), limit=4, cool=50)


def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.concat("c_name", F.lit("+")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return lg.upsert(c, new, "c_custkey", keep_old=("c_acctbal",)).withColumn("c_acctbal", F.round("c_acctbal", 2))


def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    new = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("c_custkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("c_name"), "o_orderkey")
    return lg.insert_ignore(c, new, "c_custkey", ["o_orderkey"])


def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Lines left when every order of some customers goes."""
    gone = table(spark, sf, "orders").where("o_custkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    left = table(spark, sf, "lineitem").join(gone, "l_orderkey", "left_anti")
    return left.groupBy("l_orderkey").agg(F.count("*").alias("lines"))


def protected_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Configurations that a run refers to stay; the others are deleted."""
    p, l = table(spark, sf, "part"), table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    used, free = p.join(l, "p_partkey", "left_semi"), p.join(l, "p_partkey", "left_anti")
    return used.select("p_partkey", F.lit("kept").alias("state")).unionByName(free.select("p_partkey", F.lit("deleted").alias("state")))


def next_version(spark: SparkSession, sf: str) -> DataFrame:
    """Versions as numbers, not text, so that v10 follows v9; exactly one is active."""
    v = table(spark, sf, "orders").select("o_custkey", F.concat(F.lit("v"), (F.col("o_orderkey") % 100).cast("string")).alias("version"))
    n = F.max(F.substring("version", 2, 10).cast("long"))
    return v.groupBy("o_custkey").agg((F.coalesce(n, F.lit(0)) + 1).alias("next"), F.concat(F.lit("v"), n.cast("string")).alias("active"))


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Keys in either of two snapshots: both, old or new."""
    o = table(spark, sf, "orders")
    a, b = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.lit(1).alias("a")), o.where("o_orderkey % 4 <> 0").select("o_orderkey", F.lit(1).alias("b"))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "old").otherwise("both")
    return a.join(b, "o_orderkey", "full").select("o_orderkey", state.alias("state"))


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Session windows with a gap of a day."""
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("at", "1 day").alias("w")).agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("w.start").cast("long").alias("start"), "events")


QUERIES = {f.__name__: f for f in (
    session_counts, session_search_page, prior_user_question, next_answer, delete_turn_pair, loop_detection, iteration_limit, topic_trigger, entity_merge, carried_context,
    memory_expiry, memory_access, profile_merge, memory_compression, cache_ttl_replay, cache_trend_minute, cache_cleanup, lockout_windows, latency_last_n, trace_search,
    trace_summary, span_tree_depth, cleanup_preview, breaker_replay, upsert_merge, insert_ignore, cascade_delete, protected_delete, next_version, snapshot_diff, event_sessions,
)}

_topics = " ".join(f"WHEN contains(lower(text), '{k}') THEN '{k}'" for k in sorted(TOPICS, key=lambda k: (-len(k), k)))

#: The states of a breaker, call after call.
BREAKER_SQL = """
WITH RECURSIVE c AS (SELECT {service} AS service, CAST(event_id AS BIGINT) AS t, {bad} AS bad, row_number() OVER (PARTITION BY {service} ORDER BY event_id) AS i FROM events),
w AS (SELECT DISTINCT service, 0::BIGINT AS i, 0::BIGINT AS t, 0 AS n, NULL::BIGINT AS since, '' AS state FROM c
  UNION ALL SELECT service, i, t, CASE WHEN cooling THEN n WHEN trips THEN 0 ELSE m END, CASE WHEN cooling THEN since WHEN trips THEN t END, CASE WHEN cooling OR trips THEN 'open' WHEN half THEN 'half_open' ELSE 'closed' END
  FROM (SELECT *, NOT cooling AND bad AND (half OR m >= {limit}) AS trips FROM (SELECT c.*, w.n, w.since, coalesce(c.t - w.since < {cool}, false) AS cooling, w.since IS NOT NULL AND c.t - w.since >= {cool} AS half, CASE WHEN c.bad THEN w.n + 1 ELSE 0 END AS m
    FROM w JOIN c ON c.service = w.service AND c.i = w.i + 1)))
"""

SQL = {
    "breaker_replay": BREAKER_SQL.format(service="event_type", bad="user_id % 3 <> 0", limit=4, cool=50) + "SELECT service, t, state FROM w WHERE i > 0",
    "session_counts": "SELECT c_custkey AS session_id, c_name, count(turn) AS messages FROM customer LEFT JOIN conversations ON conv_id = c_custkey GROUP BY ALL",
    "session_search_page": "SELECT c_custkey, c_name, count(*) OVER () AS total FROM customer WHERE c_name ILIKE '%customer#%1%' ORDER BY c_name, c_custkey LIMIT 10 OFFSET 10",
    "prior_user_question": "SELECT a.conv_id, a.turn, md5(u.text) AS question FROM (FROM conversations WHERE role = 'assistant') a ASOF LEFT JOIN (FROM conversations WHERE role = 'user') u ON a.conv_id = u.conv_id AND a.turn > u.turn",
    "next_answer": "SELECT u.conv_id, u.turn, a.turn AS answer_turn FROM (FROM conversations WHERE role = 'user') u ASOF LEFT JOIN (FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND u.turn < a.turn",
    "delete_turn_pair": """WITH g AS (SELECT u.conv_id, u.turn, (SELECT min(a.turn) FROM conversations a WHERE a.conv_id = u.conv_id AND a.turn > u.turn AND a.role = 'assistant') AS a FROM conversations u WHERE role = 'user' AND conv_id % 4 = 0)
  SELECT conv_id, turn, role FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.conv_id = c.conv_id AND (g.turn = c.turn OR g.a = c.turn))""",
    "loop_detection": "SELECT event_id, lag(event_type, 2) OVER o IS NOT NULL AND event_type = lag(event_type) OVER o AND event_type = lag(event_type, 2) OVER o AS loop FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)",
    "iteration_limit": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) >= 10 AS stopped FROM conversations",
    "topic_trigger": f"WITH t AS (SELECT conv_id, turn, CASE {_topics} END AS topic FROM conversations) SELECT conv_id, turn, topic, CASE WHEN length(topic) > 5 THEN 0.9::DOUBLE WHEN topic IS NOT NULL THEN 0.6 WHEN turn % 5 = 0 THEN 0.5 ELSE 0.0 END AS confidence FROM t",
    "entity_merge": """WITH w AS (SELECT conv_id, turn, lower(regexp_extract(text, '^\\s*(\\w+)', 1)) AS w FROM conversations), d AS (SELECT conv_id, w, max(turn) AS t FROM w WHERE w <> '' GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t DESC) AS n FROM d) SELECT conv_id, string_agg(w, ',' ORDER BY t DESC) AS entities FROM r WHERE n <= 10 GROUP BY conv_id""",
    "carried_context": """WITH l AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events)
  SELECT event_id, round(v, 4) AS last_value, CASE WHEN v IS NULL THEN event_type ELSE event_type || ' about ' || CAST(trunc(v) AS INTEGER) END AS question FROM l""",
    "memory_expiry": "SELECT CASE WHEN date_diff('day', o_orderdate, TIMESTAMP '1998-08-02') > 1500 THEN 'expired' WHEN date_diff('day', o_orderdate, TIMESTAMP '1998-08-02') > 700 AND o_orderstatus = 'F' THEN 'unused' ELSE 'live' END AS state, count(*) AS n FROM orders GROUP BY ALL",
    "memory_access": "SELECT user_id, count(*) AS access_count, max(event_id) AS last_event FROM events GROUP BY user_id",
    "profile_merge": "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS interests FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 6 GROUP BY user_id",
    "memory_compression": "SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations QUALIFY used <= 2000",
    "cache_ttl_replay": """WITH h AS (SELECT event_type, coalesce(CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 86400, false) AS hit FROM events)
  SELECT event_type, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END), 4) AS rate FROM h GROUP BY event_type""",
    "cache_trend_minute": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS at, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "cache_cleanup": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0",
    "lockout_windows": """WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
  n AS (SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS BIGINT) AS failures FROM e) SELECT event_id, failures, failures >= 3 AS locked FROM n""",
    "latency_last_n": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
  SELECT event_type, count(*) AS calls, round(avg(value) FILTER (n <= 100), 6) AS latency, round(max(value), 6) AS slowest FROM e GROUP BY event_type""",
    "trace_search": "SELECT event_id, user_id, count(*) OVER () AS total FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-16' ORDER BY event_id DESC LIMIT 20 OFFSET 20",
    "trace_summary": "SELECT user_id, count(*) AS spans, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS duration, count(*) FILTER (event_type = 'view') AS model_calls FROM events GROUP BY user_id",
    "span_tree_depth": """WITH RECURSIVE s AS (SELECT event_id AS id, event_id // 3 AS parent FROM events), t AS (SELECT id, 0 AS depth FROM s WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.id = s.parent AND s.id <> s.parent)
  UNION ALL SELECT s.id, t.depth + 1 FROM s JOIN t ON s.parent = t.id AND s.id <> s.parent) SELECT depth, count(*) AS spans FROM t GROUP BY depth""",
    "cleanup_preview": "SELECT event_type, count(*) AS traces, count(DISTINCT user_id) AS sessions FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY event_type",
    "upsert_merge": """WITH n AS (SELECT c_custkey * 2 AS c_custkey, c_name || '+' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0)
  SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, round(coalesce(o.c_acctbal, n.c_acctbal), 2) AS c_acctbal FROM customer o FULL JOIN n USING (c_custkey)""",
    "insert_ignore": """SELECT c_custkey, c_name FROM customer UNION ALL SELECT o_custkey * 2, 'order ' || min(o_orderkey) FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey""",
    "cascade_delete": "SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 0) GROUP BY l_orderkey",
    "protected_delete": "SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) THEN 'kept' ELSE 'deleted' END AS state FROM part",
    "next_version": "SELECT o_custkey, max(o_orderkey % 100) + 1 AS next, 'v' || max(o_orderkey % 100) AS active FROM orders GROUP BY o_custkey",
    "snapshot_diff": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 4 = 0 THEN 'old' ELSE 'both' END AS state FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 4 <> 0",
    "event_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
  SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS events FROM s GROUP BY user_id, n""",
}
