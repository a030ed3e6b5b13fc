"""Queries: evaluation of retrieval and answers, attribution, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import evaluation as ev
from tidemark.operators import retrieval as rt
from tidemark.plans.retrieval import BM25_SQL, TOKENS
from tidemark.sources import files
from tidemark.sources.storage import written
from tidemark.sources.tables import table

#: The driver's answers are English: their tags and what states a fact in them.
TAG, FACTUAL = r"\[source (\d+)\]", r"\d|percent|must|shall|at least|at most|according to"

# Retrieval results to evaluate: each order's lines are ranked hits, relevant where they were returned.
HITS_SQL = """
WITH hits AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank,
  CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END AS rel FROM lineitem),
samples AS (SELECT o_orderkey AS query_id, o_orderpriority AS question_type, o_orderstatus AS topic FROM orders),
g AS (SELECT *, rel / log2(rank + 1.0::DOUBLE) AS gain, CASE WHEN rel > 0 THEN 1.0::DOUBLE / log2(row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) + 1.0::DOUBLE) ELSE 0 END AS ideal FROM hits),
per AS (SELECT query_id, avg(rel) AS precision, min(CASE WHEN rel > 0 THEN rank END) AS first_rank, sum(gain) AS dcg, sum(ideal) AS best, count(*) AS n FROM g GROUP BY query_id),
m AS (SELECT s.*, coalesce(precision, 0.0) AS precision, first_rank, coalesce(1.0::DOUBLE / first_rank, 0) AS mrr, coalesce(dcg / nullif(best, 0), 0) AS ndcg, coalesce(n, 0) AS n_hits
  FROM samples s LEFT JOIN per USING (query_id))
"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rel = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.row_number().over(order).alias("rank"), rel.alias("rel"))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    samples = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("question_type"), F.col("o_orderstatus").alias("topic"))
    return ev.rank_metrics(_hits(spark, sf), samples)


def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    return m.select("query_id", *(F.round(c, 6).alias(c) for c in ("precision", "mrr", "ndcg")), F.col("first_rank").cast("long").alias("first_rank"))


def report_by_type(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    out = m.groupingSets([[], ["question_type"]], "question_type").agg(
        F.count("*").alias("samples"), *(F.round(F.avg(c), 6).alias(c) for c in ("precision", "mrr", "ndcg")),
        F.round(F.avg(F.when(F.col("n_hits") > 0, 1.0).otherwise(0.0)), 6).alias("rejection_rate_ref"),
        F.round(F.avg(F.when(F.col("n_hits") == 0, 1.0).otherwise(0.0)), 6).alias("true_rejection_rate"),
    )
    return out.withColumn("question_type", F.coalesce("question_type", F.lit("all")))


def failure_list(spark: SparkSession, sf: str) -> DataFrame:
    why = F.when(F.col("n_hits") == 0, "none").when(F.col("precision") == 0, "irrelevant").otherwise("ranking")
    return _metrics(spark, sf).where("precision < 0.5").select("query_id", why.alias("reason"))


def weak_areas(spark: SparkSession, sf: str) -> DataFrame:
    per = _metrics(spark, sf).groupBy("topic", "question_type").agg(F.avg("precision").alias("mean"), F.count("*").alias("samples"))
    return per.where("mean < 0.5").select("topic", "question_type", F.round("mean", 6).alias("mean"), "samples")


def metric_levels(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf).groupBy("topic").agg(*(F.avg(c).alias(c) for c in ("precision", "mrr", "ndcg")))
    long = m.unpivot("topic", ["precision", "mrr", "ndcg"], "metric", "value")
    return long.select("topic", "metric", F.round("value", 3).alias("value"), ev.level(F.col("metric"), F.col("value")).alias("level"))


def run_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Runs are the halves of the orders by key; sections are topics."""
    m = _metrics(spark, sf).groupBy("topic", (F.col("query_id") % 2).alias("run")).agg(*(F.avg(c).alias(c) for c in ("precision", "mrr", "ndcg")))
    long = m.unpivot(["topic", "run"], ["precision", "mrr", "ndcg"], "metric", "value").withColumnRenamed("topic", "section")
    both = ev.compare_runs(long.where("run = 0").drop("run"), long.where("run = 1").drop("run"), 0.01)
    return both.select("section", "metric", F.round("delta", 6).alias("delta"), F.round("pct", 6).alias("pct"), "trend")


def metric_trend(spark: SparkSession, sf: str) -> DataFrame:
    """The metric of the last five completed runs of each user."""
    last = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    runs = table(spark, sf, "events").where("event_type <> 'error'").withColumn("n", F.row_number().over(last)).where("n <= 5")
    return runs.select("user_id", "n", F.get_json_object("props", "$.k").cast("long").alias("metric"))


def redundancy_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Of the ten best hits of each question, by BM25."""
    docs = table(spark, sf, "documents")
    found = rt.bm25_search(docs, table(spark, sf, "benchmark"), id_col="doc_id", text_col="text", query_id="item_id", query_text="text", k=10)
    found = written(found)  # few rows, which meet the documents where they lie
    words = docs.select(F.col("doc_id").alias("id"), F.array_distinct(tx.tokens(F.col("text"))).alias("words"))
    return ev.redundancy(found.join(words, "id").select("query_id", "rank", "words"), 0.3).select("query_id", F.round("redundancy", 6).alias("redundancy"))


def coverage_blindspots(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc"))
    evidence = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("sample_id"))
    return ev.coverage(docs, evidence)


def dataset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return files.fingerprints(table(spark, sf, "documents"), "source", "doc_id")


def dataset_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of the evaluation set, one row each."""
    q = table(spark, sf, "benchmark").withColumn("words", F.array_distinct(tx.tokens(F.col("text"))))
    rules = F.array_compact(F.array(F.when(F.length(F.trim("text")) == 0, "empty"), F.when(F.length("text") < 120, "short"), F.when(F.size("words") < 12, "few_words")))
    own = q.select("item_id", F.explode(rules).alias("issue"))
    twice = ev.near_questions(q.select(F.col("item_id").alias("id"), "words"))
    return own.unionByName(twice.select(F.col("b").alias("item_id"), F.lit("duplicate").alias("issue")).distinct())


AUDIT_SQL = f"""
WITH q AS (SELECT item_id, text, list_distinct({TOKENS.format("text")}) AS w FROM benchmark),
p AS (SELECT b.item_id, len(list_intersect(a.w, b.w)) AS n, len(a.w) + len(b.w) AS m FROM q a JOIN q b ON a.item_id < b.item_id)
SELECT item_id, 'empty' AS issue FROM q WHERE length(trim(text)) = 0 UNION ALL SELECT item_id, 'short' FROM q WHERE length(text) < 120
UNION ALL SELECT item_id, 'few_words' FROM q WHERE len(w) < 12 UNION ALL SELECT DISTINCT item_id, 'duplicate' FROM p WHERE n::DOUBLE / (m - n) > 0.8"""


def human_review_stats(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return l.groupBy("source").agg(
        F.round(F.avg("quality"), 4).alias("quality"), F.round(F.avg("toxic"), 4).alias("toxic"), F.count("*").alias("total"),
        F.count_if(F.col("quality") == 1).alias("approved"), F.count_if(F.col("quality") == 0).alias("pending"),
    )


def clause_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Automatic against human verdicts per clause; a missing one differs from any."""
    auto = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("auto"))
    both = auto.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "full")
    return both.select("doc_id", F.coalesce(F.col("auto") == F.col("quality"), F.lit(False)).alias("agree"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with the question before and a context, tags added by rule."""
    c = table(spark, sf, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    q = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(order)
    turns = c.withColumn("question", q).where("role = 'assistant'")
    tag = F.concat(F.lit(" [source "), (F.col("turn") % 3 + 1).cast("string"), F.lit("] then "), (F.col("conv_id") % 100).cast("string"), F.lit(" % must hold"))
    return turns.withColumn("answer", F.when(F.col("conv_id") % 4 == 0, F.col("text")).otherwise(F.concat("text", tag)))


TURNS_SQL = """
WITH t AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations),
a AS (SELECT conv_id, turn, text, question, CASE WHEN conv_id % 4 = 0 THEN text ELSE text || ' [source ' || (turn % 3 + 1) || '] then ' || (conv_id % 100) || ' % must hold' END AS answer FROM t WHERE role = 'assistant')
"""
BIGRAMS = "list_distinct(list_transform(({0})[1:greatest(len({0}) - 1, 0)], lambda x, i: x || ({0})[i + 1]))"


def faithfulness(spark: SparkSession, sf: str) -> DataFrame:
    """Of each answer to its context: the question, and the answer before it."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = _turns(spark, sf).withColumn("context", F.concat_ws(" ", "question", before))
    return t.select("conv_id", "turn", F.round(ev.faithfulness(F.col("answer"), F.col("context")), 6).alias("faithfulness"))


FAITHFUL_SQL = TURNS_SQL + f""", c AS (SELECT *, concat_ws(' ', question, lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS context FROM a),
w AS (SELECT conv_id, turn, {TOKENS.format("context")} AS cw, {TOKENS.format("answer")} AS aw,
  list_filter(list_transform(regexp_extract_all(answer, '[^。！？.!?\\n]+[。！？.!?\\n]?'), lambda s: trim(s, ' ')), lambda s: length(s) > 3) AS sentences FROM c),
b AS (SELECT conv_id, turn, {BIGRAMS.format("cw")} AS known, {BIGRAMS.format("aw")} AS own, sentences FROM w),
s AS (SELECT conv_id, turn, known, unnest(sentences) AS sentence FROM b),
u AS (SELECT conv_id, turn, known, {TOKENS.format("sentence")} AS sw FROM s),
g AS (SELECT conv_id, turn, known, {BIGRAMS.format("sw")} AS part FROM u),
n AS (SELECT conv_id, turn, avg(CASE WHEN coalesce(len(list_intersect(part, known))::DOUBLE / nullif(len(part), 0), 0) >= 0.4 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM g GROUP BY ALL),
x AS (SELECT b.conv_id, b.turn, share, coalesce(len(list_intersect(own, known))::DOUBLE / nullif(len(own), 0), 0) AS whole FROM b LEFT JOIN n ON n.conv_id = b.conv_id AND n.turn = b.turn)
SELECT conv_id, turn, round(coalesce(share * 0.7::DOUBLE + whole * 0.3::DOUBLE, whole), 6) AS faithfulness FROM x"""


def retrieval_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the question's bigrams in the answer; 0 without any."""
    t = _turns(spark, sf)
    q, a = (tx.bigrams(tx.tokens(F.col(c))) for c in ("question", "answer"))
    return t.select("conv_id", "turn", F.round(tx.overlap(q, a), 6).alias("relevance"))


RELEVANCE_SQL = TURNS_SQL + f""", w AS (SELECT conv_id, turn, {TOKENS.format("coalesce(question, '')")} AS q, {TOKENS.format("answer")} AS a FROM a),
b AS (SELECT conv_id, turn, {BIGRAMS.format("q")} AS q, {BIGRAMS.format("a")} AS a FROM w)
SELECT conv_id, turn, round(coalesce(len(list_intersect(q, a))::DOUBLE / nullif(len(q), 0), 0), 6) AS relevance FROM b"""


def info_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the question's numbers that the answer holds; 1 if it has none."""
    t = _turns(spark, sf).withColumn("nq", tx.numbers(F.coalesce("question", F.lit("")))).withColumn("na", tx.numbers(F.col("answer")))
    share = F.size(F.filter("nq", lambda x: F.array_contains("na", x))).cast("double") / F.size("nq")
    return t.select("conv_id", "turn", F.round(F.when(F.size("nq") == 0, 1.0).otherwise(share), 6).alias("completeness"))


COMPLETE_SQL = TURNS_SQL + """, n AS (SELECT conv_id, turn, regexp_extract_all(coalesce(question, ''), '\\d+(?:\\.\\d+)?') AS q, regexp_extract_all(answer, '\\d+(?:\\.\\d+)?') AS a FROM a)
SELECT conv_id, turn, round(CASE WHEN len(q) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(q, lambda x: list_contains(a, x)))::DOUBLE / len(q) END, 6) AS completeness FROM n"""


def citations(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf).select("conv_id", "turn", F.posexplode(ev.cited(F.col("answer"), TAG)).alias("pos", "n"))
    return t.where("n between 1 and 3").select("conv_id", "turn", "pos", (F.col("n") - 1).alias("source_idx"))


CITE_SQL = TURNS_SQL + """SELECT conv_id, turn, 0 AS pos, CAST(regexp_extract(answer, '\\[source (\\d+)\\]', 1) AS INTEGER) - 1 AS source_idx FROM a WHERE regexp_matches(answer, '\\[source \\d+\\]')"""


def uncited_sources(spark: SparkSession, sf: str) -> DataFrame:
    left = F.array_except(F.array(*map(F.lit, (1, 2, 3))), ev.cited(F.col("answer"), TAG))
    return _turns(spark, sf).select("conv_id", "turn", F.array_join(F.array_sort(left).cast("array<string>"), ",").alias("uncited"))


UNCITED_SQL = TURNS_SQL + """SELECT conv_id, turn, array_to_string(list_filter(['1', '2', '3'], lambda x: NOT list_contains(regexp_extract_all(answer, '\\[source (\\d+)\\]', 1), x)), ',') AS uncited FROM a"""


def unverified_claims(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", F.md5(ev.unsupported(F.col("answer"), TAG, FACTUAL)).alias("claim"))


UNVERIFIED_SQL = TURNS_SQL + f""", x AS (SELECT *, regexp_matches(answer, '\\[source \\d+\\]') AS has, trim(regexp_extract(answer, '(?s)^.*\\[source \\d+\\](.*)$', 1), ' ') AS tail FROM a)
SELECT conv_id, turn, md5(CASE WHEN has THEN CASE WHEN length(tail) >= 5 AND NOT regexp_matches(tail, '\\d$') AND regexp_matches(tail, '{FACTUAL}') THEN tail END
  WHEN regexp_matches(answer, '{FACTUAL}') THEN answer END) AS claim FROM x"""


def numeric_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers with a unit in answers that none of their sources has: the question, and what was said before it."""
    t = _turns(spark, sf).withColumn("source", F.concat(((F.col("conv_id") + F.col("turn")) % 100).cast("string"), F.lit(" % is stated")))
    said = F.explode(ev.mismatches(F.col("answer"), F.array(F.coalesce("question", F.lit("")), F.col("source"))))
    return t.select("conv_id", "turn", said.alias("number"))


MISMATCH_SQL = TURNS_SQL + """, n AS (SELECT conv_id, turn, coalesce(question, '') AS question, unnest(list_distinct(regexp_extract_all(answer, '(\\d+(?:\\.\\d+)?)\\s*[%％]', 1))) AS number FROM a)
SELECT conv_id, turn, number FROM n WHERE NOT list_contains(regexp_extract_all(question, '(\\d+(?:\\.\\d+)?)\\s*[%％]', 1), number) AND number <> CAST((conv_id + turn) % 100 AS VARCHAR)"""


def overall_quality(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("x", F.col("event_id") % 11 / 10.0).withColumn("y", F.col("user_id") % 7 / 6.0)
    q = ev.overall_quality(F.when(F.col("event_type") != "error", F.col("x")), F.col("y"), F.col("x"))
    return e.select("event_id", F.round(q, 3).alias("overall"), (q < 0.4).alias("feedback"))


OVERALL_SQL = """
WITH e AS (SELECT event_id, event_type, event_id % 11 / 10.0::DOUBLE AS x, user_id % 7 / 6.0::DOUBLE AS y FROM events),
q AS (SELECT event_id, round(CASE WHEN event_type = 'error' THEN y * 0.5::DOUBLE + x * 0.5::DOUBLE ELSE x * 0.4::DOUBLE + y * 0.3::DOUBLE + x * 0.3::DOUBLE END, 4) AS q FROM e)
SELECT event_id, round(q, 3) AS overall, q < 0.4::DOUBLE AS feedback FROM q"""


def badcase_classify(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf).withColumn("bad", ev.unsupported(F.col("answer"), TAG, FACTUAL).isNotNull())
    kind = ev.badcase(F.length(F.coalesce("question", F.lit(""))), F.col("answer"), F.coalesce("question", F.lit("")), F.col("bad"))
    return t.withColumn("kind", kind).select("conv_id", "turn", "kind", ev.risk(F.col("kind"), F.col("answer")).alias("risk"))


BADCASE_SQL = TURNS_SQL + f""", x AS (SELECT *, regexp_matches(answer, '\\[source \\d+\\]') AS has, trim(regexp_extract(answer, '(?s)^.*\\[source \\d+\\](.*)$', 1), ' ') AS tail FROM a),
y AS (SELECT *, CASE WHEN has THEN length(tail) >= 5 AND NOT regexp_matches(tail, '\\d$') AND regexp_matches(tail, '{FACTUAL}') ELSE regexp_matches(answer, '{FACTUAL}') END AS bad FROM x),
k AS (SELECT *, CASE WHEN coalesce(length(question), 0) = 0 THEN 'knowledge_gap'
  WHEN regexp_matches(answer, '(?i)not found|no information|cannot answer') AND len(list_intersect(list_distinct(string_split(answer, '')), list_distinct(string_split(coalesce(question, ''), '')))) <= 2 THEN 'knowledge_gap'
  WHEN bad THEN 'hallucination' ELSE 'retrieval_failure' END AS kind FROM y)
SELECT conv_id, turn, kind, CASE WHEN kind = 'hallucination' AND regexp_matches(answer, '(?i)\\d+(\\.\\d+)?\\s*%|must|shall') THEN 2 WHEN kind = 'hallucination' THEN 1
  WHEN regexp_matches(answer, '(?i)guarantee|risk-free') THEN 1 ELSE 0 END AS risk FROM k"""


def feedback_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback by type and by status, and satisfaction overall, in one pass."""
    f = table(spark, sf, "orders")
    up = F.count_if(F.col("o_totalprice") > 150000)
    out = f.groupingSets([[], ["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), up.alias("up"))
    return out.select("o_orderstatus", "o_orderpriority", "n", F.round(F.coalesce(F.try_divide(F.col("up").cast("double"), F.col("n")), F.lit(0.0)), 4).alias("rate"))


QUERIES = {f.__name__: f for f in (
    retrieval_metrics, report_by_type, failure_list, weak_areas, metric_levels, run_comparison, metric_trend, redundancy_rate, coverage_blindspots,
    dataset_fingerprint, dataset_audit, human_review_stats, clause_agreement, faithfulness, retrieval_relevance, info_completeness, citations,
    uncited_sources, unverified_claims, numeric_mismatch, overall_quality, badcase_classify, feedback_stats,
)}

SQL = {
    "faithfulness": FAITHFUL_SQL,
    "retrieval_metrics": HITS_SQL + "SELECT query_id, round(precision, 6) AS precision, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, first_rank FROM m",
    "report_by_type": HITS_SQL + """SELECT coalesce(question_type, 'all') AS question_type, count(*) AS samples, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg,
  round(avg(CASE WHEN n_hits > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS rejection_rate_ref, round(avg(CASE WHEN n_hits = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS true_rejection_rate FROM m GROUP BY GROUPING SETS ((), (question_type))""",
    "failure_list": HITS_SQL + "SELECT query_id, CASE WHEN n_hits = 0 THEN 'none' WHEN precision = 0 THEN 'irrelevant' ELSE 'ranking' END AS reason FROM m WHERE precision < 0.5",
    "weak_areas": HITS_SQL + "SELECT topic, question_type, round(avg(precision), 6) AS mean, count(*) AS samples FROM m GROUP BY ALL HAVING avg(precision) < 0.5",
    "metric_levels": HITS_SQL + """, l AS (UNPIVOT (SELECT topic, avg(precision) AS precision, avg(mrr) AS mrr, avg(ndcg) AS ndcg FROM m GROUP BY topic) ON precision, mrr, ndcg INTO NAME metric VALUE value),
  t(metric, best, good) AS (VALUES ('precision', 0.7::DOUBLE, 0.5::DOUBLE), ('mrr', 0.8, 0.5), ('ndcg', 0.7, 0.5))
  SELECT topic, metric, round(value, 3) AS value, CASE WHEN value >= best THEN 'excellent' WHEN value >= good THEN 'good' ELSE 'poor' END AS level FROM l JOIN t USING (metric)""",
    "run_comparison": HITS_SQL + """, l AS (UNPIVOT (SELECT topic AS section, query_id % 2 AS run, avg(precision) AS precision, avg(mrr) AS mrr, avg(ndcg) AS ndcg FROM m GROUP BY ALL) ON precision, mrr, ndcg INTO NAME metric VALUE value)
  SELECT section, metric, round(b.value - a.value, 6) AS delta, round(coalesce((b.value - a.value) / nullif(a.value, 0), 0), 6) AS pct,
  CASE WHEN b.value - a.value > 0.01 THEN 'improved' WHEN b.value - a.value < -0.01 THEN 'regressed' ELSE 'same' END AS trend
  FROM (FROM l WHERE run = 0) a JOIN (FROM l WHERE run = 1) b USING (section, metric)""",
    "metric_trend": "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS n, CAST(json_extract_string(props, '$.k') AS BIGINT) AS metric FROM events WHERE event_type <> 'error' QUALIFY n <= 5",
    "redundancy_rate": f"""
WITH h AS ({BM25_SQL.replace("QUALIFY rank <= 20", "QUALIFY rank <= 10")}),
d AS (SELECT query_id, rank, list_distinct({TOKENS.format("text")}) AS w FROM h JOIN documents USING (doc_id)),
p AS (SELECT a.query_id, len(list_intersect(a.w, b.w)) AS n, len(a.w) + len(b.w) AS m FROM d a JOIN d b ON a.query_id = b.query_id AND a.rank < b.rank WHERE len(a.w) > 0 AND len(b.w) > 0)
SELECT query_id, round(avg(CASE WHEN n::DOUBLE / (m - n) > 0.3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS redundancy FROM p GROUP BY query_id""",
    "coverage_blindspots": "SELECT c_custkey AS doc, count(o_orderkey) AS samples, CASE WHEN count(o_orderkey) = 0 THEN 'blind' WHEN count(o_orderkey) < 5 THEN 'thin' ELSE 'covered' END AS state FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "dataset_fingerprint": "SELECT source, substring(sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR))), 1, 12) AS fingerprint FROM documents GROUP BY source",
    "dataset_audit": AUDIT_SQL,
    "human_review_stats": "SELECT source, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic, count(*) AS total, count(*) FILTER (quality = 1) AS approved, count(*) FILTER (quality = 0) AS pending FROM labels JOIN documents USING (doc_id) GROUP BY source",
    "clause_agreement": "SELECT doc_id, coalesce((CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) = quality, false) AS agree FROM documents FULL JOIN labels USING (doc_id)",
    "retrieval_relevance": RELEVANCE_SQL,
    "info_completeness": COMPLETE_SQL,
    "citations": CITE_SQL,
    "uncited_sources": UNCITED_SQL,
    "unverified_claims": UNVERIFIED_SQL,
    "numeric_mismatch": MISMATCH_SQL,
    "overall_quality": OVERALL_SQL,
    "badcase_classify": BADCASE_SQL,
    "feedback_stats": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) FILTER (o_totalprice > 150000)::DOUBLE / count(*), 4) AS rate FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))",
}
