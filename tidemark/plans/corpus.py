"""Queries: chunking, document quality, tables, sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import chunking as ck
from tidemark.operators import quality as ql
from tidemark.operators import sheets as sh
from tidemark.plans.inputs import given, plain
from tidemark.sources.storage import fresh_path
from tidemark.sources.tables import table

# A regulation made of a document: front matter, headings, a metadata quote.
MARKDOWN = """'---' || chr(10) || 'collection: 07_' || source || chr(10) || 'regulation: ' || CASE WHEN doc_id % 3 = 0 THEN 'Rule ' || lang ELSE '' END || chr(10) || '---' || chr(10) || chr(10)
 || CASE WHEN doc_id % 2 = 0 THEN '# Law of ' || lang || chr(10) ELSE '' END || '> meta: topic=' || lang || ' | part=' || source || chr(10) || text || chr(10) || '## Annex' || chr(10) || 'Doc ' || doc_id"""


def _regulations(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    nl = F.lit("\n")
    rule = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Rule "), "lang")).otherwise("")
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# Law of "), "lang", nl)).otherwise("")
    text = F.concat(
        F.lit("---\ncollection: 07_"), "source", F.lit("\nregulation: "), rule, F.lit("\n---\n\n"), title,
        F.lit("> meta: topic="), "lang", F.lit(" | part="), "source", nl, "text", F.lit("\n## Annex\nDoc "), F.col("doc_id").cast("string"),
    )
    return d.select("doc_id", text.alias("text"))


def front_matter(spark: SparkSession, sf: str) -> DataFrame:
    d = ck.front_matter(_regulations(spark, sf))
    return d.select("doc_id", ck.head_value(F.col("head"), "collection").alias("collection"), ck.head_value(F.col("head"), "regulation").alias("regulation"), F.md5("body").alias("body"))


FRONT = f"""
WITH r AS (SELECT doc_id, {MARKDOWN} AS text FROM documents),
p AS (SELECT doc_id, string_split(text, '---') AS p FROM r),
f AS (SELECT doc_id, p[2] AS head, trim(array_to_string(p[3:], '---'), ' ') AS body FROM p)
"""


def law_names(spark: SparkSession, sf: str) -> DataFrame:
    """The regulation, else the first heading, else the collection, else unknown; and the category of the collection."""
    d = ck.front_matter(_regulations(spark, sf))
    h1 = F.nullif(F.regexp_extract("body", r"(?m)^#\s+(.+)$", 1), F.lit(""))
    collection = ck.head_value(F.col("head"), "collection")
    name = F.coalesce(ck.head_value(F.col("head"), "regulation"), h1, collection, F.lit("unknown"))
    category = F.element_at(F.split(collection, "_", 2), -1)  # what follows the first sign
    return d.select("doc_id", name.alias("law_name"), category.alias("category"), F.concat_ws(" > ", category, name).alias("hierarchy_path"))


def headings(spark: SparkSession, sf: str) -> DataFrame:
    d = ck.front_matter(_regulations(spark, sf))
    return ck.headings(ck.lines(d, "doc_id", "body")).where("level is not null").select(F.col("id").alias("doc_id"), "line_no", "level")


LINES = FRONT + """, l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no FROM f),
m AS (SELECT *, regexp_matches(line, '^#{1,6}\\s+.+$') AS md FROM l),
a AS (SELECT *, max(CAST(md AS INTEGER)) OVER (PARTITION BY doc_id) = 1 AS any_md FROM m),
v AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line, CASE WHEN any_md THEN CASE WHEN md THEN length(regexp_extract(line, '^(#+)', 1)) END
  WHEN regexp_matches(line, '^第[一二三四五六七八九十百零]+条([：:\\s]|$)') THEN 1 WHEN regexp_matches(line, '^\\d+(\\.\\d+)*([.、\\s]|$)') THEN len(string_split(regexp_extract(line, '^(\\d+(?:\\.\\d+)*)', 1), '.'))
  WHEN regexp_matches(line, '^[（(][一二三四五六七八九十\\d]+[）)]') OR regexp_matches(line, '^[一二三四五六七八九十]+[、.]') THEN 2 END AS level FROM a)
"""


def heading_sections(spark: SparkSession, sf: str) -> DataFrame:
    d = ck.front_matter(_regulations(spark, sf))
    s = ck.sections(ck.headings(ck.lines(d, "doc_id", "body")))
    return s.select(F.col("id").alias("doc_id"), F.col("section").cast("long").alias("section"), "heading", F.length("content").cast("long").alias("n"), F.md5("content").alias("digest"))


def section_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Each section with the headings above it."""
    d = ck.front_matter(_regulations(spark, sf))
    s = ck.section_paths(ck.headings(ck.lines(d, "doc_id", "body")))
    return s.select(F.col("id").alias("doc_id"), "section", F.size("path").cast("long").alias("depth"), F.md5(F.array_join("path", " > ")).alias("path"))


PATHS = LINES.replace("WITH", "WITH RECURSIVE", 1) + """, head AS (SELECT doc_id, line_no, line, level, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM v WHERE level IS NOT NULL),
above AS (SELECT x.doc_id, x.section, x.line, max(o.section) AS up FROM head x LEFT JOIN head o ON o.doc_id = x.doc_id AND o.section < x.section AND o.level < x.level GROUP BY ALL),
way AS (SELECT doc_id, section, 1 AS depth, line AS path FROM above WHERE up IS NULL UNION ALL SELECT x.doc_id, x.section, depth + 1, path || ' > ' || x.line FROM above x JOIN way ON way.doc_id = x.doc_id AND way.section = x.up)
SELECT doc_id, section, CAST(depth AS BIGINT) AS depth, md5(path) AS path FROM way"""


SECTIONS = LINES + """, s AS (SELECT *, sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM v),
g AS (SELECT doc_id, CAST(section AS BIGINT) AS section, max(CASE WHEN level IS NOT NULL THEN line END) AS heading, coalesce(trim(string_agg(CASE WHEN level IS NULL THEN line END, chr(10) ORDER BY line_no), ' '), '') AS content FROM s WHERE section > 0 GROUP BY ALL)
SELECT doc_id, section, heading, CAST(length(content) AS BIGINT) AS n, md5(content) AS digest FROM g"""


def quote_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Keys and values of the quoted metadata line, and the text without it."""
    r = _regulations(spark, sf)
    line = F.regexp_extract("text", r"(?m)^> meta: (.*)$", 1)
    attrs = F.str_to_map(line, F.lit(r"\s*\|\s*"), F.lit("="))
    return r.select("doc_id", attrs["topic"].alias("topic"), attrs["part"].alias("part"), F.md5(F.regexp_replace("text", r"(?m)^> meta: .*\n", "")).alias("rest"))


QUOTE = f"""
WITH r AS (SELECT doc_id, lang, source, {MARKDOWN} AS text FROM documents)
SELECT doc_id, regexp_extract(text, 'topic=(\\S*) \\|', 1) AS topic, regexp_extract(text, '\\| part=(\\S*)', 1) AS part, md5(replace(text, '> meta: topic=' || lang || ' | part=' || source || chr(10), '')) AS rest FROM r"""


def fixed_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = ck.windows(table(spark, sf, "documents"), "doc_id", "text")
    return w.select(F.col("id").alias("doc_id"), "chunk", F.length("content").cast("long").alias("n"), F.md5("content").alias("digest"))


WINDOWS = """
WITH s AS (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 2850)) AS start FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, CAST(start // 2850 AS INTEGER) AS chunk, substring(text, start + 1, 3000) AS content FROM s)
"""


def chunk_links(spark: SparkSession, sf: str) -> DataFrame:
    w = ck.linked(ck.windows(table(spark, sf, "documents"), "doc_id", "text"))
    return w.select(F.col("id").alias("doc_id"), "chunk", "prev_chunk", "next_chunk")


def overlap_tail(spark: SparkSession, sf: str) -> DataFrame:
    w = ck.with_overlap(ck.windows(table(spark, sf, "documents"), "doc_id", "text"), limit=3200)
    return w.select(F.col("id").alias("doc_id"), "chunk", F.md5("tail").alias("tail"))


OVERLAP = WINDOWS + """, l AS (SELECT *, right(lag(content) OVER (PARTITION BY doc_id ORDER BY chunk), 150) AS last FROM w WHERE length(content) >= 20),
t AS (SELECT *, trim(CASE WHEN regexp_matches(last, '[.!?。！？\\n]') THEN regexp_extract(last, '(?s)^.*[.!?。！？\\n](.*)$', 1) ELSE last END, ' ') AS tail FROM l)
SELECT doc_id, chunk, md5(CASE WHEN length(tail) + length(content) <= 3200 THEN tail END) AS tail FROM t"""


def paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents packed greedily; the chunks of a document join up to its lines again."""
    parts = F.filter(F.transform(F.split("text", "\n"), lambda p: F.trim(p)), lambda p: p != "")
    packed = ck.packed_parts(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), parts.alias("parts")), 1500, "\n")
    return packed.select(F.col("id").alias("doc_id"), "chunk", F.length("content").cast("long").alias("n"), F.md5("content").alias("digest"))


PARAGRAPHS = """
WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents),
s AS (SELECT doc_id, unnest(l) AS part, generate_subscripts(l, 1) AS i FROM p),
w AS (SELECT doc_id, i, length(part) AS size, 0 AS chunk FROM s WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN w.size + 1 + length(s.part) <= 1500 THEN w.size + 1 + length(s.part) ELSE length(s.part) END, CASE WHEN w.size + 1 + length(s.part) <= 1500 THEN w.chunk ELSE w.chunk + 1 END
  FROM w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i + 1),
c AS (SELECT doc_id, chunk, string_agg(part, chr(10) ORDER BY i) AS content FROM w JOIN s USING (doc_id, i) GROUP BY doc_id, chunk)
SELECT doc_id, chunk, CAST(length(content) AS BIGINT) AS n, md5(content) AS digest FROM c"""


def chunk_guards(spark: SparkSession, sf: str) -> DataFrame:
    w = ck.windows(table(spark, sf, "documents").withColumn("text", F.substring("text", 1, 10_000_000)), "doc_id", "text", 500, 0, 1)
    counted = w.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("chunk"))).where("n <= 10000")
    return counted.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("chunks"))


def table_split(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as table rows below a header: parts of 50 rows, the header in each."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = ck.numbered(table(spark, sf, "lineitem"), "l_returnflag", order)
    part = F.floor((F.col("i") - 1) / 49)
    return rows.groupBy(F.col("l_returnflag").alias("t"), part.cast("long").alias("part")).agg((F.count("*") + 1).alias("rows"), F.max("i").cast("long").alias("last"))


def table_markdown(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    line = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda r: r.line)
    return n.groupBy("n_regionkey").agg(F.concat(F.lit("| key | name |\n| --- | --- |\n"), F.array_join(rows, "\n")).alias("markdown"))


def sheet_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Rows under the last row that starts a group: messages under the last one of the user."""
    c = table(spark, sf, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    start = F.col("role") == "user"
    return c.select(
        "conv_id", "turn", F.sum(start.cast("int")).over(order).cast("long").alias("group_no"),
        F.md5(F.last(F.when(start, F.col("text")), ignorenulls=True).over(order)).alias("name"),
    )


#: Each conversation is a checklist; every second has a line of owners. Some turns begin a sub-regulation, the others are clauses.
SHEETS = """
SELECT conv_id, 1 AS row_no, 'Sheet ' || conv_id AS a, CAST(NULL AS STRING) AS b, CAST(NULL AS STRING) AS d FROM (SELECT DISTINCT conv_id FROM {conversations}) x
UNION ALL SELECT conv_id, 2, '序号', CASE WHEN conv_id % 2 = 1 THEN '产品开发责任人：x' END, '全部' FROM (SELECT DISTINCT conv_id FROM {conversations}) x
UNION ALL SELECT conv_id, 3, '序号', NULL, NULL FROM (SELECT DISTINCT conv_id FROM {conversations}) x WHERE conv_id % 2 = 1
UNION ALL SELECT conv_id, 3 + conv_id % 2, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'Law ' || conv_id || chr(10) || '（2020）' END, NULL, NULL FROM (SELECT DISTINCT conv_id FROM {conversations}) x
UNION ALL SELECT conv_id, 4 + conv_id % 2 + turn, CASE WHEN turn % 3 = 1 AND conv_id % 5 > 0 THEN 'Part ' || turn || chr(10) || '(old)' ELSE CAST(turn AS STRING) END, text, CASE WHEN turn % 2 = 0 THEN '全部' ELSE role END FROM {conversations}"""


def sheet_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses of both layouts, with their regulation and sub-regulation."""
    rows = given(spark, sf, SHEETS)
    nothing = F.lit(None).cast("string")
    found = sh.sheet_clauses(rows.select(F.col("conv_id").alias("sheet"), F.col("row_no").cast("int").alias("row_no"), F.array("a", "b", nothing, "d").alias("cells")))
    return found.select("sheet", "layout", "regulation_name", "sub_regulation", F.col("row_no").cast("long").alias("row_no"), "sequence", F.md5("content").alias("content"), F.element_at("applies", "险种大类").alias("kind"))


SHEET_SQL = "WITH r AS (" + plain(SHEETS).replace("AS STRING", "AS VARCHAR") + """),
l AS (SELECT conv_id, conv_id % 2 = 1 AS o, CASE WHEN conv_id % 3 = 0 THEN 'Sheet ' || conv_id ELSE 'Law ' || conv_id END AS law FROM (SELECT DISTINCT conv_id FROM conversations)),
d AS (SELECT r.*, o, law, CASE WHEN a LIKE 'Part %' THEN regexp_replace(a, '\\n.*', '') END AS part FROM r JOIN l USING (conv_id) WHERE row_no >= 4 + conv_id % 2),
g AS (SELECT *, coalesce(last_value(part IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY row_no), law) AS sub, bool_or(part IS NOT NULL) OVER (PARTITION BY conv_id) AS parts FROM d)
SELECT conv_id AS sheet, CASE WHEN o THEN 'with_owner' ELSE 'standard' END AS layout, law AS regulation_name, CASE WHEN parts THEN sub END AS sub_regulation, CAST(row_no AS BIGINT) AS row_no,
  CAST(a AS BIGINT) AS sequence, md5(trim(b, ' ')) AS content, nullif(trim(d), '全部') AS kind FROM g WHERE part IS NULL AND trim(b, ' ') <> ''"""


def front_matter_issues(spark: SparkSession, sf: str) -> DataFrame:
    r = _regulations(spark, sf).withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.substring("text", 1, 30)).otherwise(F.col("text")))
    return r.select("doc_id", F.explode(ql.front_matter_issues(F.col("text"), ("regulation", "collection", "issuer"))).alias("issue"))


ISSUES = f"""
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN substring({MARKDOWN}, 1, 30) ELSE {MARKDOWN} END AS text FROM documents),
p AS (SELECT doc_id, len(string_split(text, '---')) >= 3 AS ended, string_split(text, '---')[2] AS head FROM r)
SELECT doc_id, 'error:unterminated' AS issue FROM p WHERE NOT ended UNION ALL SELECT doc_id, 'warning:missing:regulation' FROM p WHERE ended AND NOT regexp_matches(head, '(?m)^regulation:\\s*\\S')
UNION ALL SELECT doc_id, 'warning:missing:collection' FROM p WHERE ended AND NOT regexp_matches(head, '(?m)^collection:\\s*\\S') UNION ALL SELECT doc_id, 'warning:missing:issuer' FROM p WHERE ended"""


def content_issues(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(ql.content_issues(F.col("text"))).alias("issue"))


CONTENT = """
WITH d AS (SELECT doc_id, text, length(trim(text, ' ')) AS n, len(list_distinct(string_split(text, ''))) AS k FROM documents)
SELECT doc_id, 'error:short' AS issue FROM d WHERE n < 50 UNION ALL SELECT doc_id, 'info:uniform' FROM d WHERE n >= 50 AND k::DOUBLE / length(text) < 0.3
UNION ALL SELECT doc_id, 'error:garbled' FROM d WHERE regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]|\\x{FEFF}|\\x{FFFD}')"""


def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.exists(ql.content_issues(F.col("text")), lambda x: x.startswith("error"))
    return table(spark, sf, "documents").select("doc_id", (~bad).alias("passed"))


def exact_dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return ql.first_of_each_text(table(spark, sf, "documents"), "text", ["doc_id"]).select("doc_id")


def low_quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where((F.length("text") >= 50) & (F.trim("text") != "")).select("doc_id")


def build_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    ok = ~F.exists(ql.content_issues(F.col("text")), lambda x: x.startswith("error"))
    return d.groupBy("source").agg(F.count("*").alias("parsed"), F.count_if(ok).alias("passed"), F.countDistinct(F.md5("text")).alias("unique_texts"))


def build_observed(spark: SparkSession, sf: str) -> DataFrame:
    """The figures of a build, counted while its two stores are written: chunks that pass, for vectors and for words."""
    docs, at = table(spark, sf, "documents"), fresh_path(spark)
    ok = ~F.exists(ql.content_issues(F.col("text")), lambda x: x.startswith("error"))
    parsed = docs.withColumn("ok", ok)
    return ql.build_figures(
        parsed, at, "ok", "doc_id", {"vector": lambda d: d.select("doc_id", "text"), "words": lambda d: d.select("doc_id", F.split("text", " ").alias("words"))}
    )


def incremental_build(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = c.where("c_custkey % 10 = 0").withColumn("c_name", F.concat("c_name", F.lit("*")))
    added = changed.withColumn("c_custkey", F.col("c_custkey") + 1_000_000).where("c_custkey % 20 = 0")
    return ql.incremental(c, changed.unionByName(added), c.where("c_custkey % 7 = 0 and c_custkey % 10 <> 0"), "c_custkey")


def file_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks per file, files without any included."""
    files = table(spark, sf, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"))
    return files.join(table(spark, sf, "documents"), "source", "left").groupBy("source").agg(F.count("doc_id").alias("chunks"))


def scan_filtered(spark: SparkSession, sf: str) -> DataFrame:
    conditions: list[Column] = [F.col("lang") == "en", F.col("n_chars") > 1000]
    d = table(spark, sf, "documents")
    for c in conditions:
        d = d.where(c)
    return d.select("doc_id", "source", "n_chars")


QUERIES = {f.__name__: f for f in (
    front_matter, law_names, headings, heading_sections, section_paths, build_observed, quote_metadata, fixed_windows, chunk_links, overlap_tail, paragraph_chunks, chunk_guards, table_split,
    table_markdown, sheet_groups, sheet_clauses, front_matter_issues, content_issues, quality_gate, exact_dedup_first, low_quality_filter, build_stats, incremental_build,
    file_counts, scan_filtered,
)}

SQL = {
    "paragraph_chunks": PARAGRAPHS,
    "front_matter": FRONT + "SELECT doc_id, nullif(trim(regexp_extract(head, '(?m)^collection:[ \\t]*(.*)$', 1), ' '), '') AS collection, nullif(trim(regexp_extract(head, '(?m)^regulation:[ \\t]*(.*)$', 1), ' '), '') AS regulation, md5(body) AS body FROM f",
    "law_names": FRONT + """, n AS (SELECT doc_id, nullif(trim(regexp_extract(head, '(?m)^collection:[ \\t]*(.*)$', 1), ' '), '') AS c, nullif(trim(regexp_extract(head, '(?m)^regulation:[ \\t]*(.*)$', 1), ' '), '') AS r, nullif(regexp_extract(body, '(?m)^#\\s+(.+)$', 1), '') AS h FROM f),
  x AS (SELECT doc_id, coalesce(r, h, c, 'unknown') AS law_name, CASE WHEN contains(c, '_') THEN substring(c, position('_' IN c) + 1) ELSE c END AS category FROM n) SELECT *, category || ' > ' || law_name AS hierarchy_path FROM x""",
    "headings": LINES + "SELECT doc_id, line_no, level FROM v WHERE level IS NOT NULL",
    "heading_sections": SECTIONS,
    "section_paths": PATHS,
    "build_observed": "WITH d AS (SELECT length(trim(text, ' ')) >= 50 AND NOT regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]|\\x{FEFF}|\\x{FFFD}') AS ok FROM documents) SELECT count(*) AS parsed, count(*) FILTER (ok) AS passed, count(*) FILTER (ok) AS vector, count(*) FILTER (ok) AS words, true AS consistent FROM d",
    "quote_metadata": QUOTE,
    "fixed_windows": WINDOWS + "SELECT doc_id, chunk, CAST(length(content) AS BIGINT) AS n, md5(content) AS digest FROM w WHERE length(content) >= 20",
    "chunk_links": WINDOWS + "SELECT doc_id, chunk, lag(chunk) OVER o AS prev_chunk, lead(chunk) OVER o AS next_chunk FROM w WHERE length(content) >= 20 WINDOW o AS (PARTITION BY doc_id ORDER BY chunk)",
    "overlap_tail": OVERLAP,
    "chunk_guards": "SELECT doc_id, CAST(least(10000, ceil(length(substring(text, 1, 10000000)) / 500.0)) AS BIGINT) AS chunks FROM documents WHERE length(text) > 0",
    "table_split": "WITH r AS (SELECT l_returnflag AS t, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem) SELECT t, (i - 1) // 49 AS part, count(*) + 1 AS rows, max(i) AS last FROM r GROUP BY ALL",
    "table_markdown": "SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey",
    "sheet_clauses": SHEET_SQL,
    "sheet_groups": "SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER o AS BIGINT) AS group_no, md5(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER o) AS name FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)",
    "front_matter_issues": ISSUES,
    "content_issues": CONTENT,
    "quality_gate": "SELECT doc_id, length(trim(text, ' ')) >= 50 AND NOT regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]|\\x{FEFF}|\\x{FFFD}') AS passed FROM documents",
    "exact_dedup_first": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)",
    "low_quality_filter": "SELECT doc_id FROM documents WHERE length(text) >= 50 AND trim(text, ' ') <> ''",
    "build_stats": "SELECT source, count(*) AS parsed, count(*) FILTER (length(trim(text, ' ')) >= 50 AND NOT regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]|\\x{FEFF}|\\x{FFFD}')) AS passed, count(DISTINCT md5(text)) AS unique_texts FROM documents GROUP BY source",
    "incremental_build": """WITH c AS (SELECT c_custkey, c_name, c_acctbal FROM customer), n AS (SELECT c_custkey, c_name || '*' AS c_name, c_acctbal FROM c WHERE c_custkey % 10 = 0)
  SELECT * FROM c WHERE c_custkey % 10 <> 0 AND c_custkey % 7 <> 0 UNION ALL SELECT * FROM n UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM n WHERE (c_custkey + 1000000) % 20 = 0""",
    "file_counts": "SELECT 'src' || n_nationkey AS source, count(doc_id) AS chunks FROM nation LEFT JOIN documents ON source = 'src' || n_nationkey GROUP BY ALL",
    "scan_filtered": "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000",
}
