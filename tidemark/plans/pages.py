"""Queries: lines, sections and tables of product documents, names and numbers, chunks by sentence, documents under audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import chunking as ck
from tidemark.operators import compliance as cp
from tidemark.operators import pages as pg
from tidemark.plans.inputs import given, plain
from tidemark.sources.tables import table

#: Orders as documents, their lines as lines of three pages or more, of sixteen kinds.
LINES = """
SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS line_no,
  CAST(floor((l_linenumber - 1) / 2) AS INT) AS page, (l_suppkey * 37 + l_partkey) % 800 + 0.5 AS top, 800 AS page_height,
  CASE l_partkey % 16 WHEN 0 THEN '第 3 页' WHEN 1 THEN 'Page 12' WHEN 2 THEN '9 / 18' WHEN 3 THEN '2．保险责任及责任免除' WHEN 4 THEN '2.6 责任免除' WHEN 5 THEN '条款目录'
    WHEN 6 THEN '1.1 投保范围' WHEN 7 THEN '1.2 被保险人范围 凡出生满28天至70周岁在本公司认可的医院出生并且符合投保条件的人都可以作为被保险人参加本保险' WHEN 8 THEN '其他事项'
    WHEN 9 THEN '健康告知' WHEN 10 THEN '《标准名称》是由某部门发布' WHEN 11 THEN '周岁 以法定身份证明文件中记载的出生日期为基础计算' WHEN 12 THEN 'plain line ' || l_partkey
    WHEN 13 THEN '内部资料' WHEN 14 THEN '3.1 附加险条款 说明' ELSE '附加险条款说明。' END AS text
FROM {lineitem}"""
LINES_SQL = f"WITH l AS (SELECT *, trim(text, ' ') AS bare FROM ({plain(LINES)}))\n"
NUMBERS_SQL = " OR ".join(f"regexp_matches(bare, '{p}')" for p in pg.PAGE_NUMBERS)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, LINES, lineitem="l_orderkey")


def clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    return pg.clean_lines(_lines(spark, sf)).select("doc", "line_no")


def titles_and_bodies(spark: SparkSession, sf: str) -> DataFrame:
    x = _lines(spark, sf).select("doc", "line_no", pg.title_and_body(F.col("text")).alias("x"))
    return x.select("doc", "line_no", "x.title", "x.body")


def section_types(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("doc", "line_no", pg.section_type(F.col("text")).alias("kind")).where("kind is not null")


def _kinds_sql() -> str:
    out = "NULL"
    for kind, words in reversed(pg.SECTIONS):
        tests = " OR ".join(
            f"CASE WHEN numbered THEN starts_with(title, '{w}') OR (ends_with(title, '{w}') AND length(title) < {2 * len(w)}) OR (contains(title, ' ') AND (starts_with(word, '{w}') OR ends_with(word, '{w}')))"
            f" ELSE length(bare) < 40 AND (starts_with(bare, '{w}') OR ends_with(bare, '{w}')) END"
            for w in words
        )
        out = f"CASE WHEN {tests} THEN '{kind}' ELSE {out} END"
    return out


def without_contents(spark: SparkSession, sf: str) -> DataFrame:
    return pg.without_contents(_lines(spark, sf), ["doc"], "line_no", "page").select("doc", "line_no")


CONTENTS_SQL = LINES_SQL + """, o AS (SELECT *, min(CASE WHEN page < 3 AND (contains(bare, '目录') OR contains(bare, '目 录') OR contains(bare, 'CONTENTS') OR contains(bare, 'Content')) THEN line_no END) OVER (PARTITION BY doc, page) AS opened,
  trim(regexp_extract(bare, '^\\d+\\.\\d+(?:\\.\\d+)*\\s+(.+)$', 1), ' ') AS title FROM l),
p AS (SELECT *, coalesce(line_no > opened, false) AS inside, contains(bare, '凡投保') OR contains(bare, '凡出生') OR contains(bare, '保险期间为') OR contains(bare, '自首次投保') OR contains(bare, '在保证续保') OR length(title) > 40 AS body FROM o),
q AS (SELECT *, max(CASE WHEN inside AND body THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY line_no) AS begun FROM p)
SELECT doc, line_no FROM q WHERE coalesce(line_no <> opened, true) AND NOT (inside AND begun = 0 AND ((title <> '' AND length(title) <= 25) OR regexp_matches(bare, '^\\d+[．.]\\s*.+$')))"""


def without_margins(spark: SparkSession, sf: str) -> DataFrame:
    return pg.without_margins(_lines(spark, sf)).select("doc", "line_no")


#: Characters of event types, set apart by what the events say.
CHARACTERS = """
SELECT user_id AS doc, CAST(event_id % 97 * 8 + event_id % 3 AS DOUBLE) AS top, CAST(event_id % 1009 * 3 + event_id % 5 AS DOUBLE) AS x0, 2.0e0 AS width, substring(event_type, 1 + CAST(event_id % 3 AS INT), 1) AS text
FROM {events}"""


def character_lines(spark: SparkSession, sf: str) -> DataFrame:
    return pg.lines_of_characters(given(spark, sf, CHARACTERS), ["doc"]).select("doc", "top", "text")


CHARACTERS_SQL = f"""
WITH RECURSIVE c AS (SELECT *, round(top / 8.0::DOUBLE) * 8 AS line FROM ({plain(CHARACTERS)})),
n AS (SELECT *, row_number() OVER (PARTITION BY doc, line ORDER BY x0, width, text) AS i, min(x0) OVER (PARTITION BY doc, line) AS first FROM c),
w AS (SELECT doc, line, i, text AS said, 1 AS parts, x0 + width AS ends FROM n WHERE i = 1
  UNION ALL SELECT n.doc, n.line, n.i, w.said || CASE WHEN s THEN ' ' ELSE '' END || n.text, w.parts + CASE WHEN s THEN 2 ELSE 1 END, n.x0 + n.width
  FROM w, LATERAL (SELECT *, x0 - w.ends > (width + w.ends - first) / (w.parts + 1) * 0.3 AND x0 - w.ends > 2 AS s FROM n WHERE n.doc = w.doc AND n.line = w.line AND n.i = w.i + 1) n)
SELECT doc, line AS top, arg_max(said, i) AS text FROM w GROUP BY doc, line"""

#: Lines of orders as tables of two or three rows.
TABLES = """
SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS table_no, l_linenumber AS page, l_suppkey % 8 * 100.0e0 AS top, 800.0e0 AS page_height,
  CASE WHEN l_partkey % 7 = 0 THEN '附表一' ELSE '' END AS title, CASE WHEN l_partkey % 11 = 0 THEN 'see' WHEN l_partkey % 13 = 0 THEN '附录二' ELSE '' END AS around,
  CASE l_partkey % 9 WHEN 0 THEN '费率' WHEN 1 THEN '药品' WHEN 2 THEN '保障计划' WHEN 3 THEN '指定医院' WHEN 4 THEN '' ELSE 'other' END AS h1, CASE WHEN l_suppkey % 5 = 0 THEN ' ' ELSE 'age' END AS h2,
  CASE WHEN l_partkey % 17 = 0 THEN 'Ⅱ期' ELSE 'x' END AS cell, l_quantity > 3 AS several
FROM {lineitem}"""


def table_types(spark: SparkSession, sf: str) -> DataFrame:
    t = given(spark, sf, TABLES)
    head, row = F.array("h1", "h2"), F.array("cell", "h2")
    t = t.withColumn("rows", F.when(F.col("several"), F.array(head, row)).otherwise(F.array(head)))
    return pg.typed_tables(pg.real_tables(t), "doc", ["table_no"]).select("doc", "table_no", "kind", "continues")


TABLES_SQL = f"""
WITH t AS (SELECT * FROM ({plain(TABLES)}) WHERE several AND trim(h1, ' ') <> '' AND trim(h2, ' ') <> ''),
o AS (SELECT *, CASE h1 WHEN '费率' THEN 'premium' WHEN '药品' THEN 'drug_list' WHEN '保障计划' THEN 'coverage' WHEN '指定医院' THEN 'hospital' ELSE 'other' END AS own,
  coalesce(top < 120 AND lag(page) OVER (PARTITION BY doc ORDER BY table_no) <> page, false) AS continues, CASE WHEN title <> '' OR cell = 'Ⅱ期' OR around = '附录二' THEN 'appendix' ELSE 'other' END AS hint FROM t),
c AS (SELECT *, sum(CASE WHEN continues THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY table_no) AS chain, CASE WHEN own <> 'other' THEN own WHEN NOT continues AND hint <> 'other' THEN hint END AS told FROM o)
SELECT doc, table_no, coalesce(told, last_value(told IGNORE NULLS) OVER (PARTITION BY doc, chain ORDER BY table_no), hint) AS kind, continues FROM c"""


def sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = ck.sentence_chunks(table(spark, sf, "documents"), "doc_id", "text", limit=400, overlap=50)
    return c.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("chunks"), F.max(F.length("content")).cast("long").alias("longest"), F.md5(F.array_join(F.array_sort(F.collect_list("content")), "|")).alias("digest"))


SENTENCES_SQL = """
WITH RECURSIVE s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^。；！？.!?]*[。；！？.!?]|[^。；！？.!?]+')) AS part, generate_subscripts(regexp_extract_all(text, '[^。；！？.!?]*[。；！？.!?]|[^。；！？.!?]+'), 1) AS i FROM documents WHERE length(text) <= 10000),
w AS (SELECT doc_id, i, length(part) AS size, 0 AS chunk FROM s WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN w.size + length(s.part) <= 400 THEN w.size + length(s.part) ELSE length(s.part) END, CASE WHEN w.size + length(s.part) <= 400 THEN w.chunk ELSE w.chunk + 1 END
  FROM w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i + 1),
c AS (SELECT doc_id, chunk, trim(string_agg(part, '' ORDER BY i), ' ') AS content FROM w JOIN s USING (doc_id, i) GROUP BY doc_id, chunk),
f AS (SELECT doc_id, unnest(generate_series(0, length(text) - 1, 350)) AS start, text FROM documents WHERE length(text) > 10000),
a AS (SELECT doc_id, content FROM c WHERE content <> '' UNION ALL SELECT doc_id, substring(text, start + 1, 400) FROM f WHERE length(substring(text, start + 1, 400)) >= 20)
SELECT doc_id, count(*) AS chunks, CAST(max(length(content)) AS BIGINT) AS longest, md5(string_agg(content, '|' ORDER BY content)) AS digest FROM a GROUP BY doc_id"""

#: Lines of orders as chunks, some of which were wrongly cut.
CHUNKS = """
SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS chunk,
  CASE l_partkey % 6 WHEN 0 THEN '(1) an item' WHEN 1 THEN '但是 not so' WHEN 2 THEN 'as follows:' WHEN 3 THEN 'a. letter' ELSE 'words ' || repeat('and more ', CAST(l_partkey % 5 AS INT)) END AS content
FROM {lineitem}"""


def merged_chunks(spark: SparkSession, sf: str) -> DataFrame:
    m = ck.merged_neighbours(given(spark, sf, CHUNKS), limit=40)
    return m.select("id", "chunk", F.md5("content").alias("digest"))


MERGED_SQL = f"""
WITH RECURSIVE c AS ({plain(CHUNKS)}),
w AS (SELECT id, chunk, content, content AS whole, 0 AS n FROM c WHERE chunk = 1
  UNION ALL SELECT c.id, c.chunk, c.content, CASE WHEN j THEN w.whole || chr(10) || chr(10) || c.content ELSE c.content END, CASE WHEN j THEN w.n ELSE w.n + 1 END
  FROM w, LATERAL (SELECT *, (regexp_matches(trim(w.content, ' '), '[:：;；]$') OR regexp_matches(content, '^[（(]\\d+[）)]|^[a-zA-Z]\\.|^但')) AND length(w.whole) + 2 + length(content) <= 60 AS j FROM c WHERE c.id = w.id AND c.chunk = w.chunk + 1) c)
SELECT id, CAST(n AS INTEGER) AS chunk, md5(arg_max(whole, chunk)) AS digest FROM w GROUP BY id, n"""

#: Ages, articles and names of regulations, by order.
NAMES = """
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN (o_custkey % 20) || '-' || (o_custkey % 60 + 20) || '岁' WHEN 1 THEN (o_custkey % 90) || '天' WHEN 2 THEN 'none' ELSE (o_custkey % 30) || ' 到 ' || (o_custkey % 70) END AS age,
  CASE o_orderkey % 5 WHEN 0 THEN '第' || (o_custkey % 40) || '条' WHEN 1 THEN '第二十条' WHEN 2 THEN '第三项' WHEN 3 THEN '附则' ELSE '第一百零三条之一' END AS article,
  CASE o_orderkey % 4 WHEN 0 THEN '中国保监会关于规范 人身险的通知（保监发〔2016〕' || (o_custkey % 99) || '号）' WHEN 1 THEN '2020年第' || (o_custkey % 9) || '号' WHEN 2 THEN '国家金融监督管理总局办法' ELSE 'a & b: "c" ' || o_custkey END AS name
FROM {orders}"""


def names_and_numbers(spark: SparkSession, sf: str) -> DataFrame:
    n = given(spark, sf, NAMES)
    age, key = tx.age_range(F.col("age")), tx.article_key(F.col("article"))
    return n.select("id", age.low.alias("low"), age.high.alias("high"), key.other.alias("other"), key.n.alias("n"), key.text.alias("text"), tx.regulation_name(F.col("name")).alias("regulation"), tx.file_name(F.col("name")).alias("file"))


# 一百零三 holds 零, which no article's number may, so such an article goes by its text.
NAMES_SQL = f"""
WITH x AS (SELECT *, article IN ('附则', '第一百零三条之一') AS named, nullif(regexp_extract(age, '(\\d+)', 1), '') AS low, nullif(regexp_extract(age, '\\d+\\s*[-~到]\\s*(\\d+)', 1), '') AS high FROM ({plain(NAMES)}))
SELECT id, CAST(low AS INTEGER) AS low, CAST(coalesce(high, low) AS INTEGER) AS high, CASE WHEN named THEN 1 ELSE 0 END AS other, CASE WHEN named THEN article END AS text,
  CAST(CASE WHEN named THEN NULL WHEN article = '第二十条' THEN '30' WHEN article = '第三项' THEN '3' ELSE regexp_extract(article, '(\\d+)', 1) END AS BIGINT) AS n,
  CASE id % 4 WHEN 0 THEN '关于规范人身险的通知' WHEN 1 THEN name WHEN 2 THEN '办法' ELSE replace(name, ' ', '') END AS regulation,
  CASE id % 4 WHEN 0 THEN replace(regexp_replace(name, '[（）〔〕]', '', 'g'), ' ', '_') WHEN 3 THEN 'a&b_c_' || regexp_extract(name, '(\\d+)$', 1) ELSE name END AS file FROM x"""

#: Documents under audit: an order's lines are its parts.
PARTS = """
SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS part_no,
  CASE l_partkey % 7 WHEN 0 THEN 'table' WHEN 1 THEN 'notice' WHEN 2 THEN 'rider' WHEN 3 THEN 'health' ELSE 'clause' END AS kind, (l_linenumber % 3 + 1) || '.' || l_linenumber AS number, 'title ' || l_suppkey AS title, 'text ' || l_partkey AS text
FROM {lineitem}"""


def combined_text(spark: SparkSession, sf: str) -> DataFrame:
    return cp.combined_text(given(spark, sf, PARTS), "doc", "part_no").select("doc", F.md5("text").alias("digest"))


COMBINED_SQL = f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY doc, kind ORDER BY part_no) AS n, list_position(['clause', 'table', 'notice', 'health', 'exclusion', 'rider'], kind) AS place FROM ({plain(PARTS)})),
l AS (SELECT doc, place, part_no, CASE kind WHEN 'clause' THEN '【条款 ' || number || '】' || title WHEN 'table' THEN '【数据表 ' || n || '】' WHEN 'notice' THEN '【投保须知】' || title WHEN 'health' THEN '【健康告知】' || title WHEN 'rider' THEN '【附加险条款 ' || number || '】' || title END || chr(10) || text AS line FROM p),
c AS (SELECT doc, string_agg(line, chr(10) || chr(10) ORDER BY place, part_no) AS text FROM l GROUP BY doc)
"""


def document_parts(spark: SparkSession, sf: str) -> DataFrame:
    d = cp.combined_text(given(spark, sf, PARTS), "doc", "part_no").select("doc", cp.document_parts(F.col("text"), fewest=2).alias("x"))
    return d.select(
        "doc", F.array_join("x.all_clauses", ",").alias("all_clauses"), "x.definition_chapter", F.array_join("x.clauses", ",").alias("clauses"), "x.has_notices", "x.has_health", "x.has_exclusions", "x.has_tables"
    )


PARTS_SQL = COMBINED_SQL + """, n AS (SELECT doc, text, regexp_extract_all(text, '【(?:附加险)?条款\\s+(\\d+(?:\\.\\d+)*)】', 1) AS a FROM c),
h AS (SELECT *, list_max(list_transform(a, lambda x: CAST(string_split(x, '.')[1] AS INTEGER))) AS last FROM n),
d AS (SELECT *, CASE WHEN len(list_filter(a, lambda x: CAST(string_split(x, '.')[1] AS INTEGER) = last)) >= greatest(2, 0.3::DOUBLE * len(a)) THEN CAST(last AS VARCHAR) END AS ch FROM h)
SELECT doc, array_to_string(a, ',') AS all_clauses, ch AS definition_chapter, array_to_string(CASE WHEN ch IS NULL THEN a ELSE list_filter(a, lambda x: NOT starts_with(x, ch || '.')) END, ',') AS clauses,
  contains(text, '【投保须知】') AS has_notices, contains(text, '【健康告知】') AS has_health, contains(text, '【责任免除】') AS has_exclusions, regexp_matches(text, '【数据表 \\d+】') AS has_tables FROM d"""

#: Violations as a model gives them, and the chunks that their sources stand for.
RAW = """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'clause ' || (user_id % 9) || '.' || (event_id % 5) || '(2)' WHEN 1 THEN '' WHEN 2 THEN 'none' ELSE CAST(user_id AS STRING) END AS clause_number,
  CASE WHEN event_id % 6 = 0 THEN '' ELSE event_type END AS clause_content, CASE WHEN event_id % 5 = 0 THEN 'compliant' END AS status, 'R' || (event_id % 8) AS source_ref, CAST(NULL AS STRING) AS suggestion, 'c' AS conclusion
FROM {events}"""


def violations(spark: SparkSession, sf: str) -> DataFrame:
    refs = spark.range(5).select(F.concat(F.lit("R"), F.col("id").cast("string")).alias("source_ref"), F.concat(F.lit("chunk"), F.col("id").cast("string")).alias("chunk_id"))
    return cp.normal_violations(given(spark, sf, RAW), refs, "clause")


def article_numbers(spark: SparkSession, sf: str) -> DataFrame:
    n = given(spark, sf, NAMES)
    return n.select("id", cp.article_number(F.concat("article", F.lit(" text")), F.col("age")).alias("article_number"))


QUERIES = {f.__name__: f for f in (
    clean_lines, titles_and_bodies, section_types, without_contents, without_margins, character_lines, table_types, sentence_chunks, merged_chunks,
    names_and_numbers, combined_text, document_parts, violations, article_numbers,
)}

SQL = {
    "clean_lines": LINES_SQL + f"SELECT doc, line_no FROM l WHERE NOT ({NUMBERS_SQL}) AND NOT (length(bare) < 20 AND regexp_matches(bare, '(其他事项|合同效力|保险费|保险金的申请及给付|名词释义|投保范围|保险责任及责任免除)$'))",
    "titles_and_bodies": LINES_SQL + """, s AS (SELECT *, position(' ' IN bare) AS gap FROM l), b AS (SELECT *, regexp_extract(bare, '^(《[^》]*》)', 1) AS book FROM s)
SELECT doc, line_no, CASE WHEN gap BETWEEN 3 AND 26 AND NOT contains(substring(bare, 1, gap - 1), '。') THEN substring(bare, 1, gap - 1) WHEN book <> '' THEN book ELSE bare END AS title,
  CASE WHEN gap BETWEEN 3 AND 26 AND NOT contains(substring(bare, 1, gap - 1), '。') THEN trim(substring(bare, gap + 1), ' ') WHEN book <> '' THEN substring(bare, length(book) + 1) ELSE '' END AS body FROM b""",
    "section_types": LINES_SQL + f", t AS (SELECT *, regexp_matches(bare, '^\\d+(\\.\\d+)*\\s+.+$') AS numbered, regexp_extract(bare, '^\\d+(?:\\.\\d+)*\\s+(.+)$', 1) AS title FROM l), u AS (SELECT *, string_split(title, ' ')[1] AS word FROM t), k AS (SELECT doc, line_no, {_kinds_sql()} AS kind FROM u) SELECT * FROM k WHERE kind IS NOT NULL",
    "without_contents": CONTENTS_SQL,
    "without_margins": LINES_SQL + f"SELECT doc, line_no FROM l WHERE NOT (top < page_height * 0.08 AND length(bare) <= 60 AND contains(bare, '内部资料')) AND NOT (top > page_height * 0.92 AND length(bare) <= 40 AND ({NUMBERS_SQL}))",
    "character_lines": CHARACTERS_SQL,
    "table_types": TABLES_SQL,
    "sentence_chunks": SENTENCES_SQL,
    "merged_chunks": MERGED_SQL,
    "names_and_numbers": NAMES_SQL,
    "combined_text": COMBINED_SQL + "SELECT doc, md5(text) AS digest FROM c",
    "document_parts": PARTS_SQL,
    "violations": f"""WITH r AS ({plain(RAW)})
SELECT event_id, coalesce(nullif(regexp_extract(clause_number, '(\\d+(?:\\.\\d+)*(?:\\(\\d+\\))?)', 1), ''), '未知') AS clause_number, 'clause' AS check_type, clause_content, coalesce(status, 'non_compliant') AS status,
  CASE WHEN event_id % 8 < 5 THEN 'chunk' || (event_id % 8) END AS chunk_id, source_ref, '' AS suggestion, conclusion FROM r WHERE clause_content <> ''""",
    "article_numbers": f"SELECT id, CASE WHEN regexp_matches(article, '^第[一二三四五六七八九十百零]+条') THEN regexp_extract(article, '^(第[一二三四五六七八九十百零]+条)', 1) ELSE age END AS article_number FROM ({plain(NAMES)})",
}
