"""Evaluation of retrieval and answers, attribution checks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.sources.storage import written

# Metric thresholds, excellent and good; lower is better for redundancy.
THRESHOLDS = [
    ("recall", 0.80, 0.60, True),
    ("precision", 0.70, 0.50, True),
    ("mrr", 0.80, 0.50, True),
    ("ndcg", 0.70, 0.50, True),
    ("redundancy", 0.10, 0.30, False),
    ("faithfulness", 0.85, 0.70, True),
    ("answer_relevancy", 0.85, 0.70, True),
    ("answer_correctness", 0.80, 0.60, True),
    ("context_relevance", 0.70, 0.50, True),
    ("rejection_rate", 0.80, 0.60, True),
]
# How an answer names its sources, what states a fact, and what states a number.
SOURCE_TAG = r"\[来源(\d+)\]"
FACTS = "|".join((
    r"\d+天", r"\d+年", r"\d+个月", r"\d+%", r"\d+元", r"\d+万元", r"\d+周岁", r"第[一二三四五六七八九十百千\d]+条", r"《[^》]+》",
    r"(必须|应当|不得|禁止|严禁|不得以)", r"(有权|无权|免除|承担)", r"\d{4}年\d{1,2}月", r"\d{4}年", r"(赔偿|赔付|给付|退还|返还)\s*\d+",
))
VALUES = (r"(\d+(?:\.\d+)?)\s*[%％]", r"(\d+(?:\.\d+)?)\s*(?:倍|元|万元)", r"(\d+)\s*(?:天|年|个月|周岁)")


def rank_metrics(hits: DataFrame, samples: DataFrame) -> DataFrame:
    """Per sample: precision, mrr, first_rank, ndcg (ideal over the retrieved relevant hits). hits: query_id, rank, rel.

    Samples without hits get zeros.
    """
    gain = F.col("rel") / F.log2(F.col("rank") + 1.0)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "rank"))
    ideal = F.when(F.col("rel") > 0, 1.0 / F.log2(place + 1.0)).otherwise(0.0)
    per = hits.withColumn("gain", gain).withColumn("ideal", ideal).groupBy("query_id").agg(
        F.avg("rel").alias("precision"),
        F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first_rank"),
        F.sum("gain").alias("dcg"),
        F.sum("ideal").alias("best"),
        F.count("*").alias("n"),
    )
    out = samples.join(per, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        *samples.columns,
        zero(F.col("precision")).alias("precision"),
        "first_rank",
        zero(F.try_divide(F.lit(1.0), F.col("first_rank"))).alias("mrr"),
        zero(F.try_divide(F.col("dcg"), F.col("best"))).alias("ndcg"),
        F.coalesce("n", F.lit(0)).alias("n_hits"),
    )


def redundancy(hits: DataFrame, least: float = 0.6) -> DataFrame:
    """query_id, redundancy: pairs of a query's hits whose token sets are alike, of all its pairs. hits: query_id, rank, words."""
    own = hits.where(F.size("words") > 0)
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.rank") < F.col("b.rank")))
    like = tx.jaccard(F.col("a.words"), F.col("b.words")) > least
    return pairs.groupBy(F.col("a.query_id").alias("query_id")).agg(F.avg(like.cast("double")).alias("redundancy"))


def level(metric: Column, value: Column) -> Column:
    """excellent, good or poor; null for an unknown metric."""
    out = F.lit(None).cast("string")
    for name, best, good, higher in THRESHOLDS:
        top, fair = (value >= best, value >= good) if higher else (value <= best, value <= good)
        out = F.when(metric == name, F.when(top, "excellent").when(fair, "good").otherwise("poor")).otherwise(out)
    return out


def compare_runs(old: DataFrame, new: DataFrame, band: float = 0.0) -> DataFrame:
    """section, metric, delta, pct (0 from a baseline of 0), trend. Both: section, metric, value."""
    both = old.withColumnRenamed("value", "a").join(new.withColumnRenamed("value", "b"), ["section", "metric"])
    delta = F.col("b") - F.col("a")
    gain = F.when(F.col("metric") == "redundancy", -delta).otherwise(delta)
    trend = F.when(gain > band, "improved").when(gain < -band, "regressed").otherwise("same")
    return both.select("section", "metric", delta.alias("delta"), F.coalesce(F.try_divide(delta, F.col("a")), F.lit(0.0)).alias("pct"), trend.alias("trend"))


def coverage(docs: DataFrame, evidence: DataFrame, least: int = 5) -> DataFrame:
    """doc, samples (0 kept), state: blind, thin or covered. docs: doc; evidence: doc, sample_id."""
    n = F.count("sample_id")
    return docs.join(evidence, "doc", "left").groupBy("doc").agg(n.alias("samples")).withColumn(
        "state", F.when(F.col("samples") == 0, "blind").when(F.col("samples") < least, "thin").otherwise("covered")
    )


def faithfulness(answer: Column, context: Column) -> Column:
    """0.7 times the share of sentences with 40 % of their bigrams in the context, plus 0.3 times the overlap of all."""
    known = tx.bigrams(tx.tokens(context))
    whole = tx.overlap(tx.bigrams(tx.tokens(answer)), known)
    lines = tx.sentences(answer)
    good = F.filter(lines, lambda s: tx.overlap(tx.bigrams(tx.tokens(s)), known) >= 0.4)
    share = F.try_divide(F.size(good).cast("double"), F.size(lines))
    return F.coalesce(share * 0.7 + whole * 0.3, whole)


def cited(answer: Column, tag: str = SOURCE_TAG) -> Column:
    """Numbers in the tags of sources, repeats kept. tag: a pattern whose first group is the number."""
    return F.transform(F.regexp_extract_all(answer, F.lit(tag), 1), lambda x: x.try_cast("int"))


def unsupported(answer: Column, tag: str = SOURCE_TAG, facts: str = FACTS) -> Column:
    """The whole answer if it states facts without any tag; else what follows the last tag, if that does."""
    tail = F.trim(F.regexp_extract(answer, rf"(?s)^.*{tag}(.*)$", 2))
    after = F.when((F.length(tail) >= 5) & ~tail.rlike(r"\d$") & tail.rlike(facts), tail)
    return F.when(answer.rlike(tag), after).otherwise(F.when(answer.rlike(facts), answer))


def values(text: Column, patterns: tuple[str, ...] = VALUES) -> Column:
    """Distinct numbers that a text states with a unit."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), 1) for p in patterns)))


def mismatches(answer: Column, sources: Column, patterns: tuple[str, ...] = VALUES) -> Column:
    """Numbers that an answer states with a unit and none of its sources (array of texts) does; none without sources."""
    held = F.flatten(F.transform(sources, lambda s: values(s, patterns)))
    return F.when(F.size(sources) > 0, F.array_except(values(answer, patterns), held)).otherwise(F.array().cast("array<string>"))


def overall_quality(faith: Column, relevance: Column, complete: Column) -> Column:
    return F.round(
        F.when(faith.isNull(), relevance * 0.5 + complete * 0.5).otherwise(faith * 0.4 + relevance * 0.3 + complete * 0.3), 4
    )


def badcase(context_size: Column, answer: Column, question: Column, unverified: Column) -> Column:
    """Why an answer was bad: knowledge_gap, hallucination or retrieval_failure."""
    letters = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    shared = F.size(F.array_intersect(letters(answer), letters(question)))
    gap = answer.rlike("(?i)not found|no information|cannot answer") & (shared <= 2)
    return F.when(context_size == 0, "knowledge_gap").when(gap, "knowledge_gap").when(unverified, "hallucination").otherwise("retrieval_failure")


def risk(kind: Column, answer: Column) -> Column:
    return F.when((kind == "hallucination") & answer.rlike(r"(?i)\d+(\.\d+)?\s*%|must|shall"), 2).when(kind == "hallucination", 1).when(
        answer.rlike("(?i)guarantee|risk-free"), 1
    ).otherwise(0)


def _named(words: Column) -> Column:
    """A digest of a set of words."""
    # Words with their lengths before them: no two lists make one text.
    return F.sha2(F.array_join(F.transform(F.sort_array(words), lambda w: F.concat(F.length(w), F.lit(":"), w)), ""), 256)


def near_sets(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """a, b (a before b): sets of words with a Jaccard similarity over `least`. sets: set, words (distinct).

    Words are put in order from the rarest on. Sets of m and n words that are so alike share at least
    o = floor(least * (m + n) / (1 + least)) + 1 words, hence one of the first m - o + 1 of the one and of the first n - o + 1 of the
    other: only those meet, for each pair of sizes apart, and no common word brings all sets together. The exact comparison follows.
    """
    each = sets.where(F.size("words") > 0).select("set", F.explode("words").alias("w"))
    often = each.groupBy("w").agg(F.count("*").alias("n"))
    rare = each.join(often, "w").groupBy("set").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("order"))
    n, m = F.size("order"), F.col("other")
    lengths = rare.withColumn("other", F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(n * least - 1e-6)).cast("int"), F.floor(n / least + 1e-6).cast("int"))))
    about = F.floor((n + m) * (least / (1 + least)) - 1e-6) + 1
    shared = F.when(about / (n + m - about) > least, about).otherwise(about + 1)  # as the comparison rounds
    kept = lengths.withColumn("kept", F.least(n, n - shared + 1).cast("int")).where("kept > 0")
    first = kept.select("set", n.alias("size"), "other", F.explode(F.slice("order", 1, F.col("kept"))).alias("x")).select("set", "size", "other", "x.w")
    other = first.select(F.col("set").alias("b"), F.col("size").alias("other"), F.col("other").alias("size"), "w")
    pairs = first.withColumnRenamed("set", "a").join(other, ["w", "size", "other"]).where("a < b").select("a", "b").distinct()
    words = lambda i: sets.select(F.col("set").alias(i), F.col("words").alias(f"words_{i}"))
    both = pairs.join(words("a"), "a").join(words("b"), "b")
    return both.where(tx.jaccard(F.col("words_a"), F.col("words_b")) > least).select("a", "b")


def _linked_questions(questions: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(id, set of questions that have words; a, b: sets that are alike, both ways, and each with itself). Sets are compared once,
    whatever number of questions has them."""
    of = written(questions.where(F.size("words") > 0).select("id", _named(F.col("words")).alias("name"), "words"))
    named = written(of.groupBy("name").agg(F.first("words").alias("words")).withColumn("set", F.monotonically_increasing_id()))
    near = written(near_sets(named.select("set", "words"), least))
    same = named.select(F.col("set").alias("a"), F.col("set").alias("b"))
    links = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(same)
    return of.select("id", "name").join(named.select("name", "set"), "name").select("id", "set"), links


def near_questions(questions: DataFrame, least: float = 0.8) -> DataFrame:
    """a, b (a before b): questions whose sets of words have a Jaccard similarity over `least`. questions: id, words (distinct).

    All pairs, those of questions with one set too; earlier_questions() counts them without.
    """
    of, links = _linked_questions(questions, least)
    left, right = (of.select(F.col("id").alias(i), F.col("set").alias(s)) for i, s in (("x", "a"), ("y", "b")))
    return left.join(links, "a").join(right, "b").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))


def earlier_questions(questions: DataFrame, least: float = 0.8) -> DataFrame:
    """id, n: in how many pairs of near_questions() each question is the later one, without these pairs; only n > 0.

    A question stands once in the list of each set that is like its own. How many of a list's own questions come before is
    counted in its order by id, which is cut by range, so that a set that many questions have isn't counted by one task.
    """
    of, links = _linked_questions(questions, least)
    met = of.join(links, of["set"] == links["a"]).select(F.col("b").alias("list"), "id", (F.col("a") == F.col("b")).cast("long").alias("own"))
    lists = met.repartitionByRange("list", "id").groupBy("list", "id").agg(F.count("*").alias("rows"), F.sum("own").alias("own"))
    dealt = written(lists.withColumn("part", F.spark_partition_id()))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("list", "part").agg(F.sum("own").alias("own"))
    sums = lambda w: F.coalesce(F.sum("own").over(w), F.lit(0))
    before = parts.select("list", "part", sums(earlier.partitionBy("list").orderBy("part")).alias("before"))
    within = dealt.withColumn("within", sums(earlier.partitionBy("list", "part").orderBy("id")))
    counted = within.join(before, ["list", "part"])
    return counted.groupBy("id").agg(F.sum(F.col("rows") * (F.col("before") + F.col("within"))).alias("n")).where("n > 0")


def audit(samples: DataFrame, generic: tuple[str, ...]) -> DataFrame:
    """id, issue, severity, n: how often it was found. samples: id, question, answer, docs, keywords, topic, question_type.

    Null counts as empty. A question that is like an earlier one (by id) is a duplicate once for each of these: n says of how many.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    none = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) == 0
    said = F.coalesce("keywords", F.array().cast("array<string>"))
    rules = (
        (blank("question"), "empty_question", "error"), (blank("answer"), "empty_answer", "warning"),
        (none("docs") & (F.coalesce("question_type", F.lit("")) != "unanswerable"), "no_evidence_docs", "error"), (none("keywords"), "no_evidence_keywords", "warning"),
        (F.exists(said, lambda k: F.length(k) < 2), "keyword_too_short", "warning"), (blank("topic"), "missing_topic", "warning"),
        (F.exists(said, lambda k: k.isin(*generic)), "generic_keyword", "info"),
    )
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(i).alias("issue"), F.lit(s).alias("severity"))) for test, i, s in rules)))
    own = samples.select("id", F.explode(found).alias("x")).select("id", "x.issue", "x.severity", F.lit(1).cast("long").alias("n"))
    words = samples.select("id", F.array_distinct(tx.tokens(F.col("question"))).alias("words"))
    twice = earlier_questions(words).select("id", F.lit("duplicate_question").alias("issue"), F.lit("warning").alias("severity"), "n")
    return own.unionByName(twice)
