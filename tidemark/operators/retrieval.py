"""Retrieval over many queries at once: BM25, vectors, rank fusion, caps and gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.sources.storage import written

#: Words of chunks that a task of a search counts, about.
WORDS_PER_TASK = 1 << 20
#: Pairs of a query and one of its words in a chunk that a task of a search scores, about.
PAIRS_PER_TASK = 500_000


def bm25_index(chunks: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(postings: id, term, tf, dl; terms: term, df). A chunk's words are counted in its own row; only df is an exchange."""
    words = chunks.select(F.col(id_col).alias("id"), tx.tokens(F.col(text_col)).alias("words"))
    postings = words.select("id", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))
    terms = words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return postings, terms


def bm25_idf(terms: DataFrame, n: int, floor: float = 0.25) -> DataFrame:
    """term, idf = ln((n - df + 0.5) / (df + 0.5)); negative ones become `floor` times the mean over all terms."""
    raw = terms.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select(
        "term", F.when(F.col("raw") < 0, F.col("mean") * floor).otherwise(F.col("raw")).alias("idf")
    )


def bm25_search(
    chunks: DataFrame,
    queries: DataFrame,
    *,
    id_col: str,
    text_col: str,
    query_id: str,
    query_text: str,
    k: int,
    k1: float = 1.5,
    b: float = 0.75,
    filters: dict[str, object] | None = None,
    tokenize: Callable[[Column], Column] = tx.tokens,
    broadcast_bytes: int = 8 << 20,
) -> DataFrame:
    """query_id, id, score, rank: for each query the k chunks with the highest BM25 score above 0, ties to smaller ids.

    Repeated query words count as often as they occur. filters: column and value that a hit must have; the statistics are those
    of all chunks.

    Chunks are dealt by id, in as many tasks as their words and their pairs with queries ask for, and meet the words of all queries
    there: neither words nor pairs travel. That takes a copy of the queries' words in each task; over `broadcast_bytes` of them,
    counted words and queries are joined by term, and scores summed after a shuffle.
    """
    kept = F.lit(True)
    for name, value in (filters or {}).items():
        kept = kept & F.col(name).eqNullSafe(F.lit(value))
    # Splitting texts costs most, so the words are written once and read for the statistics and for the hits.
    rows = written(chunks.select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("words"), kept.alias("kept")))
    terms = written(rows.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    sizes = rows.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")).first()
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokenize(F.col(query_text))).alias("term"))
    asked = asked.groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    # Only the words of the questions need their idf here, but its floor is a mean over all.
    asked = written(asked.join(terms, "term").join(bm25_idf(terms, sizes.n), "term"))
    # As a row of a broadcast: the strings, and about 64 bytes for the numbers and pointers.
    size = F.sum(F.octet_length("term") + F.coalesce(F.octet_length(F.col("query_id").cast("string")), F.lit(0)) + 64)
    met = asked.agg(F.coalesce(size, F.lit(0)).alias("bytes"), F.coalesce(F.sum("df"), F.lit(0)).alias("pairs")).first()
    all_there = F.broadcast if met.bytes <= broadcast_bytes else lambda df: df
    tasks = max(1, -(-sizes.words // WORDS_PER_TASK), -(-met.pairs // PAIRS_PER_TASK))
    length = F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(float(sizes.mean or 1.0))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)
    dealt = rows.where("kept").select("id", "words").repartition(min(tasks, 100_000), "id")
    words = dealt.select("id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    found = words.join(all_there(asked.select("term").distinct()), "term", "left_semi").groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))
    scored = found.join(all_there(asked), "term").groupBy("query_id", "id").agg(F.sum(part).alias("score")).where("score > 0")
    return top_per_query(scored, k)


def top_per_query(scored: DataFrame, k: int, *, score: str = "score", tie: str = "id") -> DataFrame:
    # Scores that differ only by the order of a sum's terms count as equal.
    order = Window.partitionBy("query_id").orderBy(F.round(score, 9).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(hits: DataFrame, k: int = 60, key: str = "id") -> DataFrame:
    """hits: query_id, list, rank (from 1), key. query_id, key, score = sum of 1 / (k + rank), first (best list and rank)."""
    return hits.groupBy("query_id", key).agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first")
    )


def cap_per_group(scored: DataFrame, group: list[str], cap: int) -> DataFrame:
    """At most cap rows per query and group, best first; 0: no cap."""
    if not cap:
        return scored
    order = Window.partitionBy("query_id", *group).orderBy(F.round("score", 9).desc(), "id")
    return scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def hybrid(keyword: DataFrame, vector: DataFrame, *, k: int = 60) -> DataFrame:
    """query_id, id, score, first of both kinds of hits. Both: query_id, variant, id, rank. The hits of a query's variants
    follow each other in one list, as many as there are."""
    order = Window.partitionBy("query_id").orderBy("variant", "rank", "id")
    lists = [x.withColumn("rank", F.row_number().over(order)).withColumn("list", F.lit(n)) for n, x in enumerate((vector, keyword))]
    return reciprocal_rank_fusion(lists[0].select("query_id", "id", "list", "rank").unionByName(lists[1].select("query_id", "id", "list", "rank")), k)


def rerank_threshold(hits: DataFrame, least: float) -> DataFrame:
    """Hits that weren't reranked, or whose rerank_score reaches least; all, if least is 0. hits: reranked, rerank_score."""
    if least <= 0:
        return hits
    return hits.where(~F.coalesce("reranked", F.lit(False)) | (F.coalesce("rerank_score", F.lit(0.0)) >= least))


def gate(scored: DataFrame, least: float) -> DataFrame:
    """All of a query's rows, or none if its best score is below least."""
    best = Window.partitionBy("query_id")
    return scored.withColumn("_best", F.max("score").over(best)).where(F.col("_best") >= least).drop("_best")


def pack_context(ranked: DataFrame, budget: int, *, text: str = "text") -> DataFrame:
    """ranked: query_id, rank, text. Texts in rank order until the budget; the first that overflows is cut to what is left
    less 50 characters, if that is over 100; nothing after it."""
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text)).over(before), F.lit(0))
    out = ranked.withColumn("used", used).withColumn("left", F.lit(budget) - F.col("used"))
    whole = F.length(text) <= F.col("left")
    room = F.col("left") - 50
    part = F.when(whole, F.col(text)).when(room > 100, F.substring(F.col(text), F.lit(1), room.cast("int")))
    return out.withColumn("part", part).where("part is not null").withColumn("whole", whole).drop("left")
