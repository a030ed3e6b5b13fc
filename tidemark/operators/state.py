"""Feedback, entities, versions, calls, caches and traces: what changes over time, as joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.logs import last_before


def triaged(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """Pending feedback with what classifying needs: feedback_id, session_id, state, question, answer, sources.

    state: rejected for a rating other than down, to_classify for the rest; feedback on a message that doesn't exist is left
    out. question: the last one of the user before the message, or empty. feedback: feedback_id, session_id, message_id,
    rating, status; messages: session_id, message_id, role, content, sources.
    """
    asked = last_before(F.col("content"), F.col("role") == "user", ["session_id"], ["message_id"])
    said = messages.select("message_id", F.coalesce(asked, F.lit("")).alias("question"), F.coalesce("content", F.lit("")).alias("answer"), "sources")
    pending = feedback.where("status = 'pending'")
    state = F.when(F.col("rating") == "down", "to_classify").otherwise("rejected")
    # Rejected at once; only the others need their message.
    both = pending.join(said, "message_id", "left").withColumn("state", state)
    return both.where((F.col("state") == "rejected") | F.col("answer").isNotNull()).select("feedback_id", "session_id", "state", "question", "answer", "sources")


def badcase_samples(cases: DataFrame) -> DataFrame:
    """Evaluation samples of bad cases that have a question: id, question, ground_truth, docs, question_type.

    cases: feedback_id, question, correction, sources (array of source files), kind; docs are the distinct named files.
    """
    files = F.array_sort(F.array_distinct(F.filter(F.coalesce("sources", F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != ""))))
    return cases.where("question <> ''").select(
        F.concat(F.lit("bc_"), F.col("feedback_id").cast("string")).alias("id"), "question", F.coalesce("correction", F.lit("")).alias("ground_truth"),
        files.alias("docs"), F.coalesce(F.nullif("kind", F.lit("")), F.lit("factual")).alias("question_type"),
    )


def entities(text: Column, categories: dict[str, tuple[str, ...]], names: tuple[str, ...]) -> Column:
    """Of each category the first of its words that the text holds, and every name that it holds; distinct and sorted."""
    found = []
    for words in categories.values():
        first = F.lit(None).cast("string")
        for w in reversed(words):
            first = F.when(F.contains(text, F.lit(w)), w).otherwise(first)
        found.append(first)
    found += [F.when(F.contains(text, F.lit(n)), n) for n in names]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def trigger(text: Column, words: tuple[str, ...], companies: tuple[str, ...], known: Column, topics: tuple[str, ...], idle: Column, every: int = 60) -> tuple[Column, Column]:
    """Why memories are looked up, and how sure: keyword 0.9, company 0.85, entity 0.7, topic 0.6, interval 0.5, else skip, 0.

    known: array of entities of the session; idle: seconds since the last look-up, null for none so far.
    """
    holds = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(text, w)) if ws else F.lit(False)
    entity = F.exists(F.coalesce(known, F.array().cast("array<string>")), lambda w: F.contains(text, w))
    rungs = ((holds(words), "keyword", 0.9), (holds(companies), "company", 0.85), (entity, "entity", 0.7), (holds(topics), "topic", 0.6), (idle.isNull() | (idle >= every), "interval", 0.5))
    why, sure = F.lit("skip"), F.lit(0.0)
    for test, name, value in reversed(rungs):
        why, sure = F.when(test, name).otherwise(why), F.when(test, value).otherwise(sure)
    return why, sure


def versions_after(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """Versions of each group after changes in order: group, version, active. versions: group, version, active; changes:
    group, seq, action (create, activate, delete), version.

    A created version is the active one from then on, and so is an activated one that exists; a version is deleted unless it
    is active. Each change depends on all before it, so a group's are folded in its own row: as many as people make.
    """
    log = changes.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "version"))).alias("log"))
    old = versions.groupBy("group").agg(F.collect_set("version").alias("have"), F.max(F.when(F.col("active"), F.col("version"))).alias("now"))
    both = log.join(old, "group", "full").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))

    def step(acc: Column, x: Column) -> Column:
        created = x.action == "create"
        wins = created | ((x.action == "activate") & F.array_contains(acc.have, x.version))
        gone = (x.action == "delete") & ~acc.now.eqNullSafe(x.version)
        have = F.when(created, F.array_union(acc.have, F.array(x.version))).when(gone, F.array_remove(acc.have, x.version)).otherwise(acc.have)
        return F.struct(have.alias("have"), F.when(wins, x.version).otherwise(acc.now).alias("now"))

    empty = F.array().cast(log.schema["log"].dataType)
    after = both.select("group", F.aggregate(F.coalesce("log", empty), F.struct("have", "now"), step).alias("x"))
    return after.select("group", F.explode("x.have").alias("version"), F.col("x.now").alias("now")).select(
        "group", "version", F.coalesce(F.col("version") == F.col("now"), F.lit(False)).alias("active")
    )


def call_stats(calls: DataFrame, by: str, order: list[str], failed: Column, latency: str, last: int = 100) -> DataFrame:
    """by, calls, failures, success_rate (4 places, 0 without calls), mean_latency of the `last` calls.

    The counts come from one aggregation; the window needs only the last calls of each key, which Spark's limit by group cuts
    before the exchange.
    """
    n = F.row_number().over(Window.partitionBy(by).orderBy(*(F.desc(c) for c in order)))
    recent = calls.select(by, latency, *order).withColumn("_n", n).where(F.col("_n") <= last).groupBy(by).agg(F.avg(latency).alias("mean_latency"))
    total = calls.groupBy(by).agg(F.count("*").alias("calls"), F.count_if(failed).alias("failures"))
    rate = F.round((F.col("calls") - F.col("failures")) / F.col("calls"), 4)
    return total.join(recent, by).select(by, "calls", "failures", rate.alias("success_rate"), "mean_latency")


def cache_stats(log: DataFrame, scope: str = "scope") -> DataFrame:
    """scope (null: all), hits, misses, rate (4 places) of a log with hit."""
    return log.rollup(scope).agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)), 4).alias("rate")
    )


def trace_filter(
    traces: DataFrame, *, trace_id: str | None = None, session_id: str | None = None, status: str | None = None, name: str | None = None, since: str | None = None, until: str | None = None
) -> DataFrame:
    """Traces that meet the filters given; a day given as `until` is included. Expects the columns of that name and created_at."""
    for column, value in (("trace_id", trace_id), ("session_id", session_id), ("status", status)):
        if value is not None:
            traces = traces.where(F.col(column) == value)
    if name is not None:
        traces = traces.where(F.contains("name", F.lit(name)))
    if since is not None:
        traces = traces.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        traces = traces.where(F.col("created_at") < F.lit(until).cast("timestamp_ntz") + F.expr("interval 1 day"))
    return traces


def page_of(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """The rows of a page (from 1), in order: a top-n with an offset, not a numbering of all rows."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def tokens_of(text: Column, size: int = 4) -> Column:
    """The text in pieces of `size` characters, in order."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n, F.lit(size)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def frequencies(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, counts: how often each value occurs, as a map sorted by value; null values are left out."""
    n = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("counts"))


def decoded(column: Column, schema: str) -> Column:
    """A JSON array column, or an empty array where it is null or no such JSON."""
    return F.coalesce(F.from_json(column, schema), F.from_json(F.lit("[]"), schema))


def contained(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """doc, hit: pairs by equality, or where the hit's source holds the document's name. docs: doc; hits: hit, source.

    Equal ones meet by their key. For the rest each source is cut into its substrings of the lengths that documents' names
    have, so that they meet by a key too, and no pair of rows is compared that doesn't match.
    """
    names = docs.select("doc", F.replace(F.replace("doc", F.lit(".md"), F.lit("")), F.lit("_"), F.lit("")).alias("name")).where("name <> ''")
    lengths = names.select(F.length("name").alias("n")).distinct()
    cuts = hits.join(lengths, F.length("source") >= F.col("n"))  # a row per length of names, which are few
    at = F.sequence(F.lit(1), F.length("source") - F.col("n") + 1)
    cuts = cuts.select("hit", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col("source"), i, F.col("n"))))).alias("name"))
    equal = docs.join(hits.select("hit", F.col("source").alias("doc")), "doc").select("doc", "hit")
    return equal.unionByName(names.join(cuts, "name").select("doc", "hit")).distinct()


def markdown_regulation(clauses: DataFrame, by: str, order: str, head: dict[str, str]) -> DataFrame:
    """by, text: a Markdown document of clauses (by, order, title, body, meta: map) with front matter of the columns in head
    (key: column), and each clause's metadata as a quoted line."""
    meta = F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat(e.key, F.lit("="), e.value)), " | ")
    part = F.concat(F.lit("## "), "title", F.lit("\n\n"), F.when(F.size("meta") > 0, F.concat(F.lit("> **元数据**: "), meta, F.lit("\n\n"))).otherwise(""), "body")
    rows = clauses.select(by, order, part.alias("_part"), *(c for c in dict.fromkeys(head.values()) if c not in (by, order)))
    first = [F.min_by(c, order).alias(c) for c in dict.fromkeys(head.values()) if c not in (by, order)]
    done = rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_part"))), lambda r: r["_part"]), "\n\n").alias("_body"), *first)
    front = F.concat(*(x for k, c in head.items() for x in (F.lit(f"{k}: "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"))))
    return done.select(by, F.concat(F.lit("---\n"), front, F.lit("---\n\n"), "_body", F.lit("\n")).alias("text"))


def with_done(records: DataFrame, by: str, order: str, record: str) -> DataFrame:
    """The records of each stream, and after the last one that it is done."""
    last = records.groupBy(by).agg((F.max(order) + 1).alias(order)).withColumn(record, F.lit('{"type": "done"}'))
    return records.select(by, order, record).unionByName(last)
