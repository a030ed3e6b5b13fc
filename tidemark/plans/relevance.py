"""Queries: relevance, recall and its reports, hybrid retrieval, sample synthesis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import relevance as rl
from tidemark.operators import retrieval as rt
from tidemark.operators import seams as sm
from tidemark.operators.vectors import vector_search
from tidemark.plans.inputs import given, plain
from tidemark.plans.retrieval import BM25_SQL, COSINE, TOKENS
from tidemark.sources.storage import fresh_path, written
from tidemark.sources.tables import table

SYNONYMS = {"cold": ["hot", "small"], "widget": ["gear"]}

#: Every order is a sample; its evidence are files, its keywords sizes and kinds of parts.
SAMPLES = """
SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 7 = 0 THEN 'unanswerable' WHEN o_orderkey % 7 < 4 THEN 'factual' ELSE 'reasoning' END AS question_type,
  'supp_' || (o_custkey % 10) || '.md|law_of_' || (o_custkey % 3) || '.md|x.md' AS docs,
  CASE o_orderkey % 4 WHEN 0 THEN 'cold|widget|PROMO' WHEN 1 THEN 'gear|a|标准' WHEN 2 THEN '标准|保险' ELSE 'small|bolt|ECONOMY|STANDARD|large' END AS keywords
FROM {orders}"""
#: Its lines are its hits, in order.
HITS = """
SELECT l_orderkey AS query_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS rank,
  p_name || ' ' || p_type || CASE WHEN p_size > 25 THEN ' 标准' ELSE '' END AS content,
  CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'supp_' || (l_suppkey % 10) || '.md' END AS source_file, 'the lawof' || (l_partkey % 3) || ' act' AS law_name
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey"""


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    s = given(spark, sf, SAMPLES)
    return s.withColumn("docs", F.split("docs", r"\|")).withColumn("keywords", F.split("keywords", r"\|"))


def _with_samples(hits: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples grow with their hits, and take many times the room of the files that they are made from: no broadcast."""
    return hits.join(samples.hint("merge"), "query_id")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    hits = _with_samples(given(spark, sf, HITS), _samples(spark, sf))
    rel = rl.relevant(F.col("content"), F.col("source_file"), F.col("law_name"), F.col("docs"), F.col("keywords"), synonyms=SYNONYMS)
    return hits.select("query_id", "rank", "source_file", "law_name", rel.cast("double").alias("rel"))


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    hits, samples = _judged(spark, sf), _samples(spark, sf)
    return ev.rank_metrics(hits.select("query_id", "rank", "rel"), samples.select("query_id", "question_type")).join(rl.recall(hits, samples), "query_id")


def relevance_judgement(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("query_id", "rank", F.col("rel").cast("int").alias("rel"))


def relevance_with_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """The same, where a hit whose content is like the sample's keywords, by the default embedder, counts too."""
    samples = _samples(spark, sf).withColumn("said", F.array_join("keywords", " "))
    hits = _with_samples(given(spark, sf, HITS), samples)
    # Embeddings are of unit length, or zero.
    hits = sm.with_similarity(hits, sm.HashingEmbedder(), fresh_path(spark), a="content", b="said")
    like = F.col("similarity")
    rel = rl.relevant(F.col("content"), F.col("source_file"), F.col("law_name"), F.col("docs"), F.col("keywords"), synonyms=SYNONYMS, similarity=like)
    return hits.select("query_id", "rank", rel.cast("int").alias("rel"), F.round(like, 6).alias("similarity"))


def recall_by_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return rl.recall(_judged(spark, sf), _samples(spark, sf)).select("query_id", F.round("recall", 6).alias("recall"))


def recall_report(spark: SparkSession, sf: str) -> DataFrame:
    r = rl.report(_measured(spark, sf))
    return r.select(F.coalesce("question_type", F.lit("all")).alias("question_type"), "samples", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg", "rejection_rate")))


def recall_failures(spark: SparkSession, sf: str) -> DataFrame:
    return rl.failures(_measured(spark, sf)).select("query_id", F.round("recall", 6).alias("recall"), "reason", F.col("first_rank").cast("long").alias("first_rank"))


JUDGED_SQL = f"""
WITH s AS (SELECT query_id, question_type, string_split(docs, '|') AS docs, string_split(keywords, '|') AS kw FROM ({plain(SAMPLES)})),
s2 AS (SELECT *, list_filter(kw, lambda k: k NOT IN ('标准', '保险')) AS special FROM s),
s3 AS (SELECT *, list_filter(special, lambda k: length(k) >= 2) AS long,
  list_distinct(list_concat(special, CASE WHEN list_has_any(special, ['cold', 'hot', 'small']) THEN ['cold', 'hot', 'small'] ELSE [] END, CASE WHEN list_has_any(special, ['widget', 'gear']) THEN ['widget', 'gear'] ELSE [] END)) AS wide FROM s2),
h AS ({plain(HITS)}),
j AS (SELECT h.*, s3.docs, s3.question_type, CASE WHEN
    (len(long) > 0 AND len(list_filter(long, lambda k: contains(content, k))) >= greatest(2, CAST(floor(len(long) * 0.6) AS INTEGER)))
    OR (len(list_filter(wide, lambda k: length(k) >= 2 AND contains(content, k))) > 0 AND ((source_file <> '' AND list_contains(s3.docs, source_file))
      OR len(list_filter(s3.docs, lambda d: length(replace(replace(d, '.md', ''), '_', '')) >= 4 AND contains(law_name, replace(replace(d, '.md', ''), '_', '')))) > 0)) THEN 1 ELSE 0 END AS rel
  FROM h JOIN s3 USING (query_id))
"""
RECALL_SQL = JUDGED_SQL + """, b AS (SELECT query_id, CASE WHEN source_file <> '' THEN source_file ELSE law_name END AS source, docs FROM j WHERE rel = 1),
c AS (SELECT query_id, list_min(list_filter(docs, lambda d: d = source OR contains(source, replace(replace(d, '.md', ''), '_', '')))) AS doc FROM b),
n AS (SELECT query_id, count(DISTINCT doc) AS n FROM c GROUP BY query_id),
r AS (SELECT s.query_id, s.question_type, coalesce(n, 0)::DOUBLE / len(docs) AS recall FROM s LEFT JOIN n USING (query_id))
"""
MEASURED_SQL = RECALL_SQL + """, g AS (SELECT query_id, rank, rel, rel / log2(rank + 1.0::DOUBLE) AS gain, CASE WHEN rel > 0 THEN 1.0::DOUBLE / log2(row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) + 1.0::DOUBLE) ELSE 0 END AS ideal FROM j),
p AS (SELECT query_id, avg(rel) AS precision, min(CASE WHEN rel > 0 THEN rank END) AS first_rank, sum(gain) AS dcg, sum(ideal) AS best, count(*) AS n FROM g GROUP BY query_id),
m AS (SELECT r.*, coalesce(precision, 0.0) AS precision, first_rank, coalesce(1.0::DOUBLE / first_rank, 0) AS mrr, coalesce(dcg / nullif(best, 0), 0) AS ndcg, coalesce(n, 0) AS n_hits FROM r LEFT JOIN p USING (query_id))
"""


def _keyword(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    return rt.bm25_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), id_col="doc_id", text_col="text", query_id="item_id", query_text="text", k=k)


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    """Questions by words over the documents, and by the vector with their number over the vectors of the documents."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = v.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("id")), "id", "left_semi")
    near = vector_search(v, asked, k=20)
    hits = [x.select("query_id", "id", "rank", F.lit(0).alias("variant")) for x in (_keyword(spark, sf), near)]
    # The hits are few and are written, so that documents meet them where they lie, and only those that were found travel.
    found = written(rt.hybrid(hits[0], hits[1]))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return found.join(docs.join(found.select("id").distinct(), "id", "left_semi"), "id", "left")


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Words and vectors fused, at most three documents of a source and language, the five best."""
    found = rt.top_per_query(rt.cap_per_group(_fused(spark, sf), ["source", "lang"], 3), 5)
    return found.select("query_id", F.col("id").alias("doc_id"), "rank", F.round("score", 8).alias("score"))


def rerank_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Fused hits after a reranker that scored every second one."""
    scored = _fused(spark, sf).withColumn("reranked", F.col("id") % 2 == 0).withColumn("rerank_score", F.when(F.col("id") % 2 == 0, F.col("id") % 10 / 10))
    return rt.rerank_threshold(scored, 0.35).select("query_id", F.col("id").alias("doc_id"))


FUSED_SQL = f"""
WITH k AS ({BM25_SQL}),
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
x AS (SELECT query_id, vec_id AS id, {COSINE} AS score FROM q JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) ON query_id <> vec_id),
v AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM x QUALIFY rank <= 20),
l AS (SELECT query_id, id, rank FROM v UNION ALL SELECT query_id, doc_id, rank FROM k),
f0 AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM l GROUP BY query_id, id),
f AS (SELECT f0.*, source, lang FROM f0 LEFT JOIN documents ON doc_id = id)
"""


def judge_means(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a judge: the values of events, by type; every tenth is not a number."""
    value = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("event_id") % 100 / 100)
    e = table(spark, sf, "events").select("event_type", (F.col("user_id") % 3).cast("string").alias("metric"), value.alias("value"))
    m = rl.judged(e.withColumnRenamed("event_type", "question_type"))
    return m.select("metric", F.coalesce("question_type", F.lit("all")).alias("question_type"), F.round("mean", 6).alias("mean"), "n")


def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    m = _measured(spark, sf).agg(*(F.round(F.avg(c), 3).alias(c) for c in ("precision", "recall", "mrr", "ndcg")), F.lit(0.5).alias("unknown_metric"))
    long = m.unpivot([], ["precision", "recall", "mrr", "ndcg", "unknown_metric"], "metric", "value")
    return rl.level_lists(long.withColumn("level", ev.level(F.col("metric"), F.col("value"))))


#: Questions that come again, with short and long answers.
CANDIDATES = """
SELECT o_orderkey AS id, 'which ' || (o_custkey % 50) || ' in ' || (o_orderkey % 20) AS question, 'an answer of ' || repeat('word ', CAST(o_orderkey % 4 AS INT)) || o_orderpriority AS answer,
  CASE WHEN o_orderkey % 3 = 0 THEN 'HIGH|LOW' ELSE 'URGENT|MEDIUM|x' END AS keywords FROM {orders}"""


def sample_synthesis(spark: SparkSession, sf: str) -> DataFrame:
    c = given(spark, sf, CANDIDATES).withColumn("keywords", F.split("keywords", r"\|"))
    return rl.new_samples(c, c.where("id % 11 = 0"), ["id"]).select("id", "question")


#: Orders as samples with all kinds of faults; questions that come again are alike.
FAULTY = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'what of number ' || (o_orderkey % 400) || ' of customer ' || (o_custkey % 30) || ' with ' || o_orderpriority END AS question,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'answer' END AS answer, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'a.md' END AS docs, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'x|word' WHEN 2 THEN '保险|word' ELSE 'word' END AS keywords,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderstatus END AS topic, CASE WHEN o_orderkey % 10 = 0 THEN 'unanswerable' ELSE 'factual' END AS question_type
FROM {orders}"""


def sample_audit(spark: SparkSession, sf: str) -> DataFrame:
    s = given(spark, sf, FAULTY)
    for c in ("docs", "keywords"):
        s = s.withColumn(c, F.filter(F.split(c, r"\|"), lambda x: x != ""))
    return ev.audit(s, rl.GENERIC).groupBy("id", "issue", "severity").agg(F.sum("n").alias("n"))


TOKENS_OF = TOKENS.format("question")
AUDIT_SQL = f"""
WITH s AS ({plain(FAULTY)}), w AS (SELECT id, list_distinct({TOKENS_OF}) AS w FROM s WHERE trim(question, ' ') <> ''),
o AS (SELECT id, 'empty_question' AS issue, 'error' AS severity FROM s WHERE trim(question, ' ') = '' UNION ALL SELECT id, 'empty_answer', 'warning' FROM s WHERE answer = ''
  UNION ALL SELECT id, 'no_evidence_docs', 'error' FROM s WHERE docs = '' AND question_type <> 'unanswerable' UNION ALL SELECT id, 'no_evidence_keywords', 'warning' FROM s WHERE keywords = ''
  UNION ALL SELECT id, 'keyword_too_short', 'warning' FROM s WHERE keywords = 'x|word' UNION ALL SELECT id, 'generic_keyword', 'info' FROM s WHERE keywords = '保险|word' UNION ALL SELECT id, 'missing_topic', 'warning' FROM s WHERE topic = ''),
p AS (SELECT b.id, len(list_intersect(a.w, b.w)) AS n, len(a.w) + len(b.w) AS m FROM w a JOIN w b ON a.id < b.id AND list_has_any(a.w, b.w))
SELECT id, issue, severity, count(*) AS n FROM (SELECT * FROM o UNION ALL SELECT id, 'duplicate_question', 'warning' FROM p WHERE n::DOUBLE / (m - n) > 0.8) GROUP BY ALL"""

QUERIES = {f.__name__: f for f in (
    relevance_judgement, relevance_with_embeddings, sample_audit, recall_by_evidence, recall_report, recall_failures, hybrid_search, rerank_threshold, judge_means, metric_summary, sample_synthesis,
)}

SQL = {
    "sample_audit": AUDIT_SQL,
    "relevance_judgement": JUDGED_SQL + "SELECT query_id, rank, rel FROM j",
    "recall_by_evidence": RECALL_SQL + "SELECT query_id, round(recall, 6) AS recall FROM r",
    "recall_report": MEASURED_SQL + """SELECT coalesce(question_type, 'all') AS question_type, count(*) AS samples, round(avg(precision), 6) AS precision,
  round(coalesce(CASE WHEN grouping(question_type) = 1 THEN avg(CASE WHEN question_type <> 'unanswerable' THEN recall END) ELSE avg(recall) END, 0), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg,
  round(coalesce(avg(CASE WHEN question_type = 'unanswerable' THEN CASE WHEN n_hits > 0 THEN 1.0::DOUBLE ELSE 0 END END), 0), 6) AS rejection_rate FROM m GROUP BY GROUPING SETS ((), (question_type))""",
    "recall_failures": MEASURED_SQL + "SELECT query_id, round(recall, 6) AS recall, CASE WHEN n_hits = 0 THEN 'none' WHEN precision = 0 THEN 'irrelevant' ELSE 'ranking' END AS reason, CAST(first_rank AS BIGINT) AS first_rank FROM m WHERE recall < 0.5",
    "hybrid_search": FUSED_SQL + """, c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id, source, lang ORDER BY round(score, 9) DESC, id) <= 3)
SELECT query_id, id AS doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, round(score, 8) AS score FROM c QUALIFY rank <= 5""",
    "rerank_threshold": FUSED_SQL + "SELECT query_id, id AS doc_id FROM f WHERE id % 2 <> 0 OR id % 10 / 10.0::DOUBLE >= 0.35",
    "judge_means": """WITH e AS (SELECT event_type, CAST(user_id % 3 AS VARCHAR) AS metric, CASE WHEN event_id % 10 <> 0 THEN event_id % 100 / 100.0::DOUBLE END AS value FROM events)
SELECT metric, coalesce(event_type, 'all') AS question_type, round(avg(value), 6) AS mean, count(value) AS n FROM e GROUP BY GROUPING SETS ((metric), (metric, event_type))""",
    "metric_summary": MEASURED_SQL + """, a AS (SELECT round(avg(precision), 3) AS precision, round(avg(recall), 3) AS recall, round(avg(mrr), 3) AS mrr, round(avg(ndcg), 3) AS ndcg FROM m),
  l AS (UNPIVOT a ON precision, recall, mrr, ndcg INTO NAME metric VALUE value),
  t(metric, best, good) AS (VALUES ('precision', 0.7::DOUBLE, 0.5::DOUBLE), ('recall', 0.8, 0.6), ('mrr', 0.8, 0.5), ('ndcg', 0.7, 0.5)),
  v AS (SELECT metric || '=' || format('{:.3f}', value) AS line, CASE WHEN value >= best THEN 'excellent' WHEN value >= good THEN 'good' ELSE 'poor' END AS level FROM l JOIN t USING (metric))
SELECT level, string_agg(line, ',' ORDER BY line) AS metrics FROM v GROUP BY level""",
    "sample_synthesis": f"""WITH c AS (SELECT id, question, answer, string_split(keywords, '|') AS kw FROM ({plain(CANDIDATES)})),
g AS (SELECT * FROM c WHERE length(answer) >= 20 AND len(list_filter(kw, lambda k: length(k) >= 2 AND contains(answer, k))) > 0 AND question NOT IN (SELECT question FROM c WHERE id % 11 = 0))
SELECT min(id) AS id, question FROM g GROUP BY question""",
}
