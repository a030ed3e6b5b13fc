"""Queries: lexical and vector retrieval, fusion, packing, text primitives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import segment as sg
from tidemark.functions import text as tx
from tidemark.operators import lexical_index as li
from tidemark.operators import retrieval as rt
from tidemark.operators.vectors import build_vector_index, search_vector_index, vector_search
from tidemark.sources.storage import fresh_path
from tidemark.sources.tables import table

#: SQL of the default tokenizer, for DuckDB.
TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2)"


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = rt.bm25_search(
        table(spark, sf, "documents"), table(spark, sf, "benchmark"),
        id_col="doc_id", text_col="text", query_id="item_id", query_text="text", k=20,
    )
    return found.select("query_id", F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def _asked(spark: SparkSession, sf: str, root: str, **more: object) -> DataFrame:
    found = li.index_search(spark, root, table(spark, sf, "benchmark"), query_id="item_id", query_text="text", k=20, **more)
    return found.select("query_id", F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The questions against a stored index of all documents."""
    root = fresh_path(spark)
    li.build_index(table(spark, sf, "documents"), root, id_col="doc_id", text_col="text", file_col="source", buckets=16)
    return _asked(spark, sf, root)


def _changed_index(spark: SparkSession, sf: str) -> str:
    """Each source is a file. Those on 3 go, those on 5 are modified (every text gets the first question's words before it), and
    those on 7 only come with the change."""
    docs, root = table(spark, sf, "documents"), fresh_path(spark)
    ends = lambda n: F.col("source").endswith(n)
    keys = {"id_col": "doc_id", "text_col": "text", "file_col": "source"}
    li.build_index(docs.where(~ends("7")), root, columns=("lang",), buckets=16, **keys)
    files = docs.select(F.col("source").alias("file")).distinct()
    change = F.when(F.col("file").endswith("3"), "deleted").when(F.col("file").endswith("5"), "modified").when(F.col("file").endswith("7"), "added")
    now = docs.withColumn("text", F.when(ends("5"), F.concat(F.lit("the and of changed "), "text")).otherwise(F.col("text")))
    li.change_index(root, files.withColumn("change", change).where("change is not null"), now, **keys)
    return root


def index_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The questions against an index that was built, and then changed: as if built from the documents as they are now."""
    return _asked(spark, sf, _changed_index(spark, sf))


def index_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequencies and idf of the changed index, which sums differences."""
    return li.index_terms(spark, _changed_index(spark, sf)).select("term", "df", F.round("idf", 6).alias("idf"))


def index_search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """English documents only; the statistics are those of all."""
    return _asked(spark, sf, _changed_index(spark, sf), filters={"lang": "en"})


BM25_SQL = f"""
WITH d AS (SELECT doc_id AS id, {TOKENS.format("text")} AS w FROM documents),
l AS (SELECT id, len(w) AS dl FROM d),
s AS (SELECT count(*) AS n, avg(dl) AS mean FROM l),
p AS (SELECT d.id, t.term, l.dl, count(*) AS tf FROM d JOIN l ON l.id = d.id, unnest(d.w) AS t(term) GROUP BY ALL),
f AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, s GROUP BY term, n),
i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM f) ELSE raw END AS idf FROM f),
q AS (SELECT item_id AS query_id, t.term, count(*) AS qf FROM (SELECT item_id, {TOKENS.format("text")} AS w FROM benchmark), unnest(w) AS t(term) GROUP BY ALL),
x AS (SELECT q.query_id, p.id AS doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score
      FROM q JOIN i USING (term) JOIN p USING (term), s GROUP BY ALL)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank,
  round(score, 6) AS score FROM x WHERE score > 0
QUALIFY rank <= 20"""


#: The documents as the change leaves them.
CHANGED = "(SELECT doc_id, lang, CASE WHEN source LIKE '%5' THEN 'the and of changed ' || text ELSE text END AS text FROM documents WHERE source NOT LIKE '%3')"
TERMS_SQL = f"""
WITH d AS (SELECT doc_id AS id, list_distinct({TOKENS.format("text")}) AS w FROM DOCS),
c AS (SELECT term, count(*) AS df FROM (SELECT unnest(w) AS term FROM d) GROUP BY term),
f AS (SELECT term, df, ln((SELECT count(*) FROM d) - df + 0.5) - ln(df + 0.5) AS raw FROM c)
SELECT term, DF_round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM f) ELSE raw END, 6) AS idf FROM f"""


def bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    _, terms = rt.bm25_index(docs, "doc_id", "text")
    return rt.bm25_idf(terms, docs.count()).select("term", F.round("idf", 6).alias("idf"))


def _search(spark: SparkSession, sf: str, kind: str, k: int, grouped: bool = False) -> DataFrame:
    """Every row whose id is divisible by 20, against all rows."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("grp"))
    return vector_search(v, v.where("id % 20 = 0"), k=k, kind=kind, grouped=grouped)


def vector_topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "cosine", 10).select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def vector_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The same by an inverted file, of about 128 rows a cell; a query looks into as many cells as the index's sample asks for."""
    v, root = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), fresh_path(spark)
    build_vector_index(v, root, rows_per_cell=128)
    found = search_vector_index(spark, root, v.where("id % 20 = 0"), k=10)
    return found.select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


VECTORS = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS q_label FROM embeddings WHERE vec_id % 20 = 0),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
x AS (SELECT query_id, vec_id, label, {score} AS score FROM q JOIN v ON query_id <> vec_id{more})
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank,
  round(score, 6) AS score FROM x QUALIFY rank <= 10"""
COSINE = "coalesce(list_dot_product(q, e) / nullif(sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(e, e)), 0), 0)"


def vector_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    found = _search(spark, sf, "cosine", 10, grouped=True)
    return found.select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def memory_topk_l2(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "l2", 10).select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def memory_suppression(spark: SparkSession, sf: str) -> DataFrame:
    """Memories whose nearest other one is too alike to be stored again."""
    return _search(spark, sf, "cosine", 1).select(F.col("query_id").alias("vec_id"), (F.col("score") > 0.9).alias("skipped"), F.round("score", 6).alias("score"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """Two ranked lists for each query: by cosine and by inner product, over whole vectors."""
    lists = [_search(spark, sf, kind, 20).withColumn("list", F.lit(n)) for n, kind in enumerate(("cosine", "dot"))]
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return lists[0].unionByName(lists[1]).join(labels, "id")


HITS = f"""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
x AS (SELECT query_id, id, label, {COSINE} AS a, list_dot_product(q, e) AS b FROM q JOIN v ON query_id <> id),
h AS (SELECT query_id, id, label, row_number() OVER (PARTITION BY query_id ORDER BY round(a, 9) DESC, id) AS rank FROM x QUALIFY rank <= 20
  UNION ALL SELECT query_id, id, label, row_number() OVER (PARTITION BY query_id ORDER BY round(b, 9) DESC, id) AS rank FROM x QUALIFY rank <= 20),
f AS (SELECT query_id, id, any_value(label) AS label, sum(1.0::DOUBLE / (60 + rank)) AS score FROM h GROUP BY query_id, id)
"""


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    fused = rt.reciprocal_rank_fusion(_hits(spark, sf))
    return fused.select("query_id", F.col("id").alias("vec_id"), F.round("score", 8).alias("score"))


def _fused_labels(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf)
    labels = hits.select("query_id", "id", "label").distinct()
    return rt.reciprocal_rank_fusion(hits).join(labels, ["query_id", "id"])


def rrf_article_cap(spark: SparkSession, sf: str) -> DataFrame:
    kept = rt.cap_per_group(_fused_labels(spark, sf), ["label"], 3)
    return kept.select("query_id", F.col("id").alias("vec_id"), "label", F.round("score", 8).alias("score"))


def rrf_gate(spark: SparkSession, sf: str) -> DataFrame:
    kept = rt.gate(_fused_labels(spark, sf), 0.0325)
    return kept.select("query_id", F.col("id").alias("vec_id"), F.round("score", 8).alias("score"))


def metadata_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    wanted = {"lang": "en", "source": "src0"}
    for name, value in wanted.items():
        docs = docs.where(F.col(name).eqNullSafe(value))
    return docs.select("doc_id", "lang", "source", "n_chars")


def _answers(col: str = "event_id") -> Column:
    """A made-up model answer with a ranking, from columns of events."""
    return F.concat(
        F.lit("I rank ["), (F.col(col) % 7).cast("string"), F.lit("] > ["), (F.col("user_id") % 5).cast("string"), F.lit("] and 3, "),
        (F.col(col) % 7).cast("string"), F.lit("."),
    )


def rerank_permutation(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", F.array_join(tx.permutation(_answers(), F.lit(5)), ",").alias("ranking"))


RERANK_SQL = """
WITH a AS (SELECT event_id, 'I rank [' || (event_id % 7) || '] > [' || (user_id % 5) || '] and 3, ' || (event_id % 7) || '.' AS s FROM events),
n AS (SELECT event_id, list_filter(list_transform(regexp_extract_all(s, '\\d{1,9}'), lambda x: CAST(x AS INTEGER)), lambda x: x >= 1 AND x <= 5) AS l FROM a),
d AS (SELECT event_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM n)
SELECT event_id, array_to_string(list_concat(l, list_filter([1, 2, 3, 4, 5], lambda x: NOT list_contains(l, x))), ',') AS ranking FROM d"""


def rerank_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates in the order of a ranking: score 1 / (rank + 1), counted from 0."""
    e = table(spark, sf, "events").select("event_id", F.posexplode(tx.permutation(_answers(), F.lit(5))).alias("rank", "candidate"))
    return e.select("event_id", "candidate", "rank", F.round(F.lit(1.0) / (F.col("rank") + 1), 6).alias("rerank_score"))


RERANK_SCORES_SQL = f"""
WITH r AS ({RERANK_SQL}), c AS (SELECT event_id, unnest(string_split(ranking, ',')) AS c, generate_subscripts(string_split(ranking, ','), 1) - 1 AS rank FROM r)
SELECT event_id, CAST(c AS INTEGER) AS candidate, CAST(rank AS INTEGER) AS rank, round(1.0::DOUBLE / (rank + 1), 6) AS rerank_score FROM c"""


def context_packing(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of each source, in order, packed into a budget."""
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("query_id"), "doc_id", "text", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank")
    )
    return rt.pack_context(docs, 12000).select("doc_id", F.length("part").cast("long").alias("n"), "whole")


CONTEXT_SQL = """
WITH r AS (SELECT source, doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents)
SELECT doc_id, CAST(CASE WHEN length(text) <= 12000 - used THEN length(text) ELSE 12000 - used - 50 END AS BIGINT) AS n, length(text) <= 12000 - used AS whole
FROM r WHERE length(text) <= 12000 - used OR 12000 - used - 50 > 100"""


def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    words = F.col("words")  # a column of its own, so that the text is split once
    return table(spark, sf, "documents").select("doc_id", tx.tokens(F.col("text")).alias("words")).select(
        "doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"), F.size(tx.bigrams(words)).cast("long").alias("n_bigrams")
    )


TOKEN_STATS_SQL = f"""
WITH d AS (SELECT doc_id, {TOKENS.format("text")} AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct,
  CAST(CASE WHEN len(w) >= 2 THEN len(list_distinct(list_transform(w[1:len(w) - 1], lambda x, i: x || w[i + 1]))) ELSE 0 END AS BIGINT) AS n_bigrams FROM d"""


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(tx.sentences(F.col("text")), "|")).alias("digest"))


SENTENCE_SQL = """
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？.!?\\n]+[。！？.!?\\n]?'), lambda x: trim(x, ' ')), lambda x: length(x) > 3) AS l FROM documents)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n, md5(array_to_string(l, '|')) AS digest FROM s"""

SYNONYMS = {"shall": "must", "is": "are", "the": "a", "thereof": "of it"}


def synonym_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.md5(tx.replace_terms(F.col("text"), SYNONYMS)).alias("digest"))


SYNONYM_SQL = "SELECT item_id, md5(replace(replace(replace(replace(text, 'thereof', 'of it'), 'shall', 'must'), 'the', 'a'), 'is', 'are')) AS digest FROM benchmark"


def query_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Each question and at most three variants with a term replaced, longest term first."""
    terms = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(sorted(SYNONYMS.items(), key=lambda kv: -len(kv[0])))], "term string, variant string, pos int")
    q = table(spark, sf, "benchmark")
    hit = q.join(F.broadcast(terms), F.contains("text", "term")).withColumn("text", F.replace("text", F.col("term"), F.col("variant")))
    hit = hit.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy("pos"))).where("n <= 3")
    return q.select("item_id", F.lit(0).alias("n"), F.md5("text").alias("digest")).unionByName(hit.select("item_id", "n", F.md5("text").alias("digest")))


EXPAND_SQL = """
WITH t(term, variant, pos) AS (VALUES ('thereof', 'of it', 0), ('shall', 'must', 1), ('the', 'a', 2), ('is', 'are', 3)),
h AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY pos) AS INTEGER) AS n, md5(replace(text, term, variant)) AS digest FROM benchmark JOIN t ON contains(text, term) QUALIFY n <= 3)
SELECT item_id, 0 AS n, md5(text) AS digest FROM benchmark UNION ALL SELECT item_id, n, digest FROM h"""


def truncate_at_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.cut_at_sentence(F.col("text"), 400)).alias("digest"))


TRUNCATE_SQL = """
WITH d AS (SELECT doc_id, text, substring(text, 1, 400) AS h FROM documents), w AS (SELECT *, regexp_extract(h, '(?s)^(.*[.!?。！？\\n])', 1) AS s FROM d)
SELECT doc_id, md5(CASE WHEN length(text) <= 400 THEN text WHEN length(s) > 200 THEN s || ' [cut]' ELSE h || '...' END) AS digest FROM w"""


def document_names(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("kb/"), F.col("lang"), F.lit("/"), F.upper("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf, "documents").select("doc_id", tx.document_name(path).alias("name"), tx.first_int(F.col("text")).cast("long").alias("first_int"))


NAMES_SQL = """
SELECT doc_id, lower(upper(source) || '_' || doc_id) AS name, CAST(nullif(regexp_extract(text, '(\\d{1,9})', 1), '') AS BIGINT) AS first_int FROM documents"""


def model_json(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("<think>hm"), F.col("event_type"), F.lit("</think> ```json\n"), F.col("props"), F.lit("\n``` done"))
    part = tx.json_part(tx.without_reasoning(said))
    return table(spark, sf, "events").select("event_id", F.get_json_object(part, "$.k").cast("long").alias("k"))


MODEL_JSON_SQL = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"

def segmented_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each text with two terms of the field before it, unspaced, chosen by its id."""
    terms = F.array(*map(F.lit, sg.TERMS))
    pick = lambda step: F.element_at(terms, (F.col("doc_id") * step % len(sg.TERMS) + 1).cast("int"))
    docs = table(spark, sf, "documents").withColumn("text", F.concat(pick(1), F.lit("的"), pick(7), F.lit(" "), "text"))
    words = docs.select("doc_id", sg.segmenter(spark)(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n"), F.array_join(F.slice("w", 1, 2), ",").alias("terms"), F.md5(F.array_join("w", " ")).alias("digest"))


_terms = "[" + ", ".join(f"'{t}'" for t in sg.TERMS) + "]"
SEGMENT_SQL = f"""
WITH t AS (SELECT doc_id, text, list_value({_terms[1:-1]}) AS terms FROM documents),
w AS (SELECT doc_id, [terms[doc_id % 46 + 1], terms[doc_id * 7 % 46 + 1]] AS two, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1) AS rest FROM t)
SELECT doc_id, len(two) + len(rest) AS n, two[1] || ',' || two[2] AS terms, md5(array_to_string(two || rest, ' ')) AS digest FROM w"""

QUERIES = {
    "segmented_terms": segmented_terms,
    "bm25_topk": bm25_topk,
    "bm25_terms": bm25_terms,
    "index_search": index_search,
    "index_after_changes": index_after_changes,
    "index_search_filtered": index_search_filtered,
    "index_terms": index_terms,
    "vector_topk_cosine": vector_topk_cosine,
    "vector_index_topk": vector_index_topk,
    "vector_topk_filtered": vector_topk_filtered,
    "memory_topk_l2": memory_topk_l2,
    "memory_suppression": memory_suppression,
    "rrf_fusion": rrf_fusion,
    "rrf_article_cap": rrf_article_cap,
    "rrf_gate": rrf_gate,
    "metadata_search": metadata_search,
    "rerank_permutation": rerank_permutation,
    "rerank_scores": rerank_scores,
    "context_packing": context_packing,
    "token_stats": token_stats,
    "sentence_split": sentence_split,
    "synonym_normalize": synonym_normalize,
    "query_expand": query_expand,
    "truncate_at_sentence": truncate_at_sentence,
    "document_names": document_names,
    "model_json": model_json,
}

SQL = {
    "segmented_terms": SEGMENT_SQL,
    "bm25_topk": BM25_SQL,
    "bm25_terms": TERMS_SQL.replace("DOCS", "documents").replace("DF_", ""),
    "index_search": BM25_SQL,
    "index_after_changes": BM25_SQL.replace("FROM documents", f"FROM {CHANGED}"),
    "index_search_filtered": BM25_SQL.replace("FROM documents", f"FROM {CHANGED}").replace(
        "WHERE score > 0", "WHERE score > 0 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"
    ),
    "index_terms": TERMS_SQL.replace("DOCS", CHANGED).replace("DF_", "df, "),
    "vector_topk_cosine": VECTORS.format(score=COSINE, more=""),
    "vector_topk_filtered": VECTORS.format(score=COSINE, more=" AND q_label IS NOT DISTINCT FROM label"),
    "memory_topk_l2": VECTORS.format(score="1.0::DOUBLE / (1.0 + list_dot_product(list_transform(q, lambda x, i: x - e[i]), list_transform(q, lambda x, i: x - e[i])))", more=""),
    "memory_suppression": f"SELECT query_id AS vec_id, score > 0.9 AS skipped, round(score, 6) AS score FROM ({VECTORS.format(score=COSINE, more='').replace('round(score, 6) AS score', 'score')}) WHERE rank = 1",
    "rrf_fusion": HITS + "SELECT query_id, id AS vec_id, round(score, 8) AS score FROM f",
    "rrf_article_cap": HITS + "SELECT query_id, id AS vec_id, label, round(score, 8) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY round(score, 9) DESC, id) <= 3",
    "rrf_gate": HITS + "SELECT query_id, id AS vec_id, round(score, 8) AS score FROM f QUALIFY max(score) OVER (PARTITION BY query_id) >= 0.0325",
    "metadata_search": "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src0'",
    "rerank_permutation": RERANK_SQL,
    "rerank_scores": RERANK_SCORES_SQL,
    "context_packing": CONTEXT_SQL,
    "token_stats": TOKEN_STATS_SQL,
    "sentence_split": SENTENCE_SQL,
    "synonym_normalize": SYNONYM_SQL,
    "query_expand": EXPAND_SQL,
    "truncate_at_sentence": TRUNCATE_SQL,
    "document_names": NAMES_SQL,
    "model_json": MODEL_JSON_SQL,
}
