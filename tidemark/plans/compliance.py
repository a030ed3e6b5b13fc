"""Queries: clauses, rules, classification, page lines, fragment streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import compliance as cp
from tidemark.sources.tables import table

KEYWORDS = [("metal", ("steel", "tin", "copper", "nickel", "brass")), ("size", ("small", "large", "medium", "economy")), ("finish", ("polished", "brushed", "plated", "burnished", "anodized")), ("kind", ("standard", "promo"))]
RULES = [("r1", "high", "!!", "a^"), ("r2", "medium", "%%%", r"\$\$\$"), ("r3", "low", " | ", r"\d{3}-\d{4}"), ("r4", "low", "disgusting", r"\bstupid\b")]


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as clauses: every line of a text gets a number."""
    d = table(spark, sf, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    number = F.concat(((F.floor(F.col("pos") / 3)) + 1).cast("string"), F.lit("."), (F.col("pos") % 3 + 1).cast("string"))
    return lines.withColumn("number", number).withColumn("clause", F.concat("number", F.lit(" "), "line"))


NUMBERED = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
c AS (SELECT doc_id, pos, line, (pos // 3 + 1) || '.' || (pos % 3 + 1) AS number FROM l)
"""


def clause_extract(spark: SparkSession, sf: str) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "clause"))), lambda x: x.clause), "\n")
    d = _numbered(spark, sf).groupBy("doc_id").agg(text.alias("text"))
    return d.select("doc_id", F.array_join(cp.clauses(F.col("text")), ";").alias("numbers"))


def definition_chapter(spark: SparkSession, sf: str) -> DataFrame:
    """The last chapter with at least two clauses and 30 % of them."""
    per = _numbered(spark, sf).groupBy("doc_id", F.substring_index("number", ".", 1).cast("int").alias("chapter")).agg(F.count("*").alias("n"))
    per = per.withColumn("all", F.sum("n").over(Window.partitionBy("doc_id")))
    return per.where("n >= 2 and n >= 0.3 * all").groupBy("doc_id").agg(F.max("chapter").cast("long").alias("chapter"))


def clause_batches(spark: SparkSession, sf: str) -> DataFrame:
    b = cp.batches(_numbered(spark, sf), "doc_id", "pos", 10)
    return b.groupBy("doc_id", "batch").agg(F.count("*").alias("n"), F.min("number").alias("first"))


def clause_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses of ten characters and more, cut at 10,000, without those of many control characters, within the budget."""
    kept = cp.normal_clauses(_numbered(spark, sf), "doc_id", "pos", "line")
    return kept.groupBy("doc_id").agg(F.count("*").alias("clauses"), F.sum(F.length("line")).cast("long").alias("chars"))


def clause_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = _numbered(spark, sf)
    flagged = c.where(F.contains("line", F.lit("!!"))).select("doc_id", "number").distinct()
    both = c.select("doc_id", "number").distinct().join(flagged.withColumn("f", F.lit(1)), ["doc_id", "number"], "left")
    return both.groupBy("doc_id").agg(F.count("*").alias("total"), F.count("f").alias("flagged"))


def clause_groups(spark: SparkSession, sf: str) -> DataFrame:
    lines = _numbered(spark, sf).withColumn("shown", F.when(F.col("pos") % 2 == 0, F.col("clause")).otherwise(F.concat(F.lit("_"), "line")))
    return cp.clause_groups(lines, "doc_id", "pos", "shown")


def section_runs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "ask").when(F.col("turn") % 3 == 0, "note")
    return cp.sections_of(table(spark, sf, "conversations"), "conv_id", "turn", kind)


def column_gaps(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(F.col("event_id") % 10 < 5, F.col("event_id") % 40 / 100).otherwise(0.6 + F.col("event_id") % 40 / 100)
    return cp.column_gap(table(spark, sf, "events").withColumn("x", x), "event_type", "x")


GAPS = """
WITH e AS (SELECT event_type, CAST(least(floor(CASE WHEN event_id % 10 < 5 THEN event_id % 40 / 100::DOUBLE ELSE 0.6::DOUBLE + event_id % 40 / 100::DOUBLE END * 20), 19) AS INTEGER) AS bin FROM events),
g AS (SELECT DISTINCT event_type, b.bin FROM e, (SELECT unnest(generate_series(0, 19)) AS bin) b), n AS (SELECT g.event_type, g.bin, count(e.bin) AS n FROM g LEFT JOIN e ON e.event_type = g.event_type AND e.bin = g.bin GROUP BY ALL),
m AS (SELECT *, avg(n) OVER (PARTITION BY event_type) AS mean FROM n)
SELECT event_type, CAST(arg_min(bin, n * 100 + bin) AS INTEGER) AS gap FROM m WHERE bin >= 6 AND bin < 14 AND n < mean / 10 GROUP BY event_type"""


def product_classify(spark: SparkSession, sf: str) -> DataFrame:
    k = spark.createDataFrame([(c, i, w) for i, (c, ws) in enumerate(KEYWORDS) for w in ws], "category string, cat_pos int, keyword string")
    found = cp.classify(table(spark, sf, "part"), k, "p_partkey", "p_name", "p_type")
    return found.select(F.col("id").alias("p_partkey"), "category", "score", F.when(F.col("score") > 3, 0.9).otherwise(0.7).alias("confidence"))


_k = ", ".join(f"('{c}', {i}, '{w}')" for i, (c, ws) in enumerate(KEYWORDS) for w in ws)
CLASSIFY = f"""
WITH k(category, pos, w) AS (VALUES {_k}),
h AS (SELECT p_partkey, category, pos, sum(length(w) / 2::DOUBLE * (CASE WHEN contains(lower(p_name), w) THEN 5 ELSE 0 END + CASE WHEN contains(lower(substring(p_type, 1, 2000)), w) THEN 1 ELSE 0 END)) AS score
  FROM part JOIN k ON contains(lower(p_name), w) OR contains(lower(substring(p_type, 1, 2000)), w) GROUP BY ALL)
SELECT p_partkey, category, score, CASE WHEN score > 3 THEN 0.9::DOUBLE ELSE 0.7 END AS confidence FROM h QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, pos) = 1"""


def first_match_category(spark: SparkSession, sf: str) -> DataFrame:
    """The first category, in order, with a keyword in the type."""
    hit = F.coalesce(*(F.when(F.lower("p_type").rlike("|".join(ws)), c) for c, ws in KEYWORDS), F.lit("other"))
    return table(spark, sf, "part").select("p_partkey", hit.alias("category"))


FIRST = "SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(lower(p_type), '{'|'.join(ws)}') THEN '{c}'" for c, ws in KEYWORDS) + " ELSE 'other' END AS category FROM part"


def negative_rules(spark: SparkSession, sf: str) -> DataFrame:
    r = spark.createDataFrame(RULES, "rule string, severity string, keyword string, pattern string")
    return cp.rule_hits(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), r)


_r = " UNION ALL ".join(f"SELECT doc_id AS id, '{r}' AS rule, '{s}' AS severity FROM documents WHERE contains(text, '{k}') OR regexp_matches(text, '{p}')" for r, s, k, p in RULES)


def score_grade(spark: SparkSession, sf: str) -> DataFrame:
    return cp.rule_score(negative_rules(spark, sf), table(spark, sf, "documents").select(F.col("doc_id").alias("id")))


def violations_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    v = cp.by_severity(negative_rules(spark, sf))
    return v.select("id", *(F.array_join(k, ",").alias(k) for k in ("high", "medium", "low")))


SCORE = f"""
WITH h AS ({_r}), s AS (SELECT doc_id AS id, greatest(0, 100 - coalesce(sum(CASE severity WHEN 'high' THEN 20 WHEN 'medium' THEN 10 WHEN 'low' THEN 5 END), 0))::BIGINT AS score FROM documents LEFT JOIN h ON h.id = doc_id GROUP BY doc_id)
SELECT id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade FROM s"""


def rule_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """skipped without text, else violated or passed; and counts by severity."""
    h = negative_rules(spark, sf).groupBy("id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n")).join(h, "id", "left")
    state = F.when(F.col("n") < 60, "skipped").when(F.col("high").isNotNull(), "violated").otherwise("passed")
    return d.groupBy(state.alias("outcome")).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in ("high", "medium", "low")))


OUTCOME = f"""
WITH h AS (SELECT id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM ({_r}) GROUP BY id)
SELECT CASE WHEN length(text) < 60 THEN 'skipped' WHEN high IS NOT NULL THEN 'violated' ELSE 'passed' END AS outcome, count(*) AS n, CAST(coalesce(sum(high), 0) AS BIGINT) AS high, CAST(coalesce(sum(medium), 0) AS BIGINT) AS medium, CAST(coalesce(sum(low), 0) AS BIGINT) AS low
FROM documents LEFT JOIN h ON id = doc_id GROUP BY ALL"""


def regulation_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses of a category's list, then of the general one; the first of each law and article counts."""
    ps = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("list"), "l_orderkey")
    first = Window.partitionBy("l_partkey", "l_suppkey").orderBy("list", "l_orderkey")
    return ps.withColumn("n", F.row_number().over(first)).where("n = 1").select("l_partkey", "l_suppkey", "list", "l_orderkey")


def ref_block(spark: SparkSession, sf: str) -> DataFrame:
    """A numbered block of sources per region, in order of name."""
    n = table(spark, sf, "nation").withColumn("i", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")))
    line = F.concat(F.lit("[R"), F.col("i").cast("string"), F.lit("] "), "n_name")
    return n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x.line), "\n").alias("block"))


def ndjson_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Objects cut in two and joined again, per user; some lines are empty or broken."""
    e = table(spark, sf, "events")
    tail = F.when(F.col("event_id") % 7 == 0, "\n\n[]\n{\"x\n").when(F.col("event_id") % 5 == 0, "\n{}\n").otherwise("\n")
    whole = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit("}"), tail)
    parts = e.select("user_id", (F.col("event_id") * 2).alias("seq"), F.substring(whole, 1, 5).alias("f")).unionByName(
        e.select("user_id", (F.col("event_id") * 2 + 1).alias("seq"), F.substring(whole, F.lit(6), F.lit(1000)).alias("f"))
    )
    r = cp.ndjson(parts, "user_id", "seq", "f")
    return r.select("user_id", F.get_json_object("record", "$.id").cast("long").alias("event_id"))


def extraction_gate(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("event_id") % 101
    state = F.when(q == 0, "warn").when(q < 60, "reject").when(q < 80, "info").otherwise("ok")
    return table(spark, sf, "events").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def range_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to the range they fall in: events to the last purchase of their user before them, by the window form of the range join."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    start = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, sf, "events").select("event_id", start.alias("range_start"))


QUERIES = {f.__name__: f for f in (
    clause_extract, definition_chapter, clause_batches, clause_limits, clause_coverage, clause_groups, section_runs, column_gaps, product_classify, first_match_category,
    negative_rules, score_grade, violations_by_severity, rule_outcome, regulation_lookup, ref_block, ndjson_parse, extraction_gate, range_assignment,
)}

SQL = {
    "violations_by_severity": f"SELECT id, {', '.join(f"coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (severity = '{k}'), '') AS {k}" for k in ('high', 'medium', 'low'))} FROM (SELECT DISTINCT id, rule, severity FROM ({_r})) GROUP BY id",
    "clause_extract": NUMBERED + "SELECT doc_id, string_agg(number, ';' ORDER BY pos) AS numbers FROM c GROUP BY doc_id",
    "definition_chapter": NUMBERED + ", p AS (SELECT doc_id, pos // 3 + 1 AS chapter, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS a FROM p) SELECT doc_id, CAST(max(chapter) AS BIGINT) AS chapter FROM t WHERE n >= 2 AND n >= 0.3 * a GROUP BY doc_id",
    "clause_batches": NUMBERED + "SELECT doc_id, CAST(pos // 10 AS BIGINT) AS batch, count(*) AS n, min(number) AS first FROM c GROUP BY ALL",
    "clause_limits": NUMBERED + """, k AS (SELECT doc_id, pos, substring(line, 1, 10000) AS line FROM c WHERE length(line) >= 10 AND length(regexp_replace(line, '[^\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) <= 0.01::DOUBLE * length(line)), r AS (SELECT *, sum(length(line)) OVER o AS t, row_number() OVER o AS n FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
  SELECT doc_id, count(*) AS clauses, CAST(sum(length(line)) AS BIGINT) AS chars FROM r WHERE t <= 500000 AND n <= 500 GROUP BY doc_id""",
    "clause_coverage": NUMBERED + "SELECT doc_id, count(DISTINCT number) AS total, count(DISTINCT CASE WHEN contains(line, '!!') THEN number END) AS flagged FROM c GROUP BY doc_id",
    "clause_groups": NUMBERED + """, s AS (SELECT doc_id, pos, CASE WHEN pos % 2 = 0 THEN number ELSE NULL END AS own FROM c), f AS (SELECT doc_id, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS number FROM s)
  SELECT doc_id, number, count(*) AS n_lines FROM f WHERE number IS NOT NULL GROUP BY ALL""",
    "section_runs": """WITH k AS (SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN 'ask' WHEN turn % 3 = 0 THEN 'note' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS kind FROM conversations),
  c AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS ch FROM k WHERE kind IS NOT NULL), s AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS section FROM c)
  SELECT conv_id, section, kind, min(turn) AS first, max(turn) AS last FROM s GROUP BY ALL""",
    "column_gaps": GAPS,
    "product_classify": CLASSIFY,
    "first_match_category": FIRST,
    "negative_rules": _r,
    "score_grade": SCORE,
    "rule_outcome": OUTCOME,
    "regulation_lookup": "SELECT l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS list, l_orderkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY list, l_orderkey) = 1",
    "ref_block": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation) SELECT n_regionkey, string_agg('[R' || i || '] ' || n_name, chr(10) ORDER BY i) AS block FROM n GROUP BY n_regionkey",
    "ndjson_parse": "SELECT user_id, event_id FROM events",
    "extraction_gate": "SELECT CASE WHEN event_id % 101 = 0 THEN 'warn' WHEN event_id % 101 < 60 THEN 'reject' WHEN event_id % 101 < 80 THEN 'info' ELSE 'ok' END AS state, count(*) AS n FROM events GROUP BY ALL",
    "range_assignment": "SELECT e.event_id, p.event_id AS range_start FROM events e ASOF LEFT JOIN (FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.event_id >= p.event_id",
}
