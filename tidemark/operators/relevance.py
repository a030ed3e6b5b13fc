"""Whether hits are relevant to evaluation samples, and what follows: recall, reports, failures, sample synthesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords too general to tell relevance.
GENERIC = tuple("保险 规定 条款 要求 情况 内容 范围 方式 条件 标准 原则 办法 措施 制度 程序 责任 义务 权利 期限 金额 比例 费用 问题 产品 合同 公司".split())


def stem(doc: Column) -> Column:
    """A document's name without .md and underscores."""
    return F.replace(F.replace(doc, F.lit(".md"), F.lit("")), F.lit("_"), F.lit(""))


def closure(synonyms: dict[str, list[str]]) -> Column:
    """A map from each term to all terms of the families that it is in, standard terms included."""
    found: dict[str, list[str]] = {}
    for standard, variants in synonyms.items():
        for term in (standard, *variants):
            found.setdefault(term, []).extend((standard, *variants))
    pairs = [x for k, v in found.items() for x in (F.lit(k), F.array(*map(F.lit, dict.fromkeys(v))))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")


def expanded(keywords: Column, synonyms: dict[str, list[str]]) -> Column:
    families = closure(synonyms)
    related = F.flatten(F.transform(keywords, lambda k: F.coalesce(F.try_element_at(families, k), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(keywords, related))


def relevant(
    content: Column,
    source_file: Column,
    law_name: Column,
    docs: Column,
    keywords: Column,
    *,
    synonyms: dict[str, list[str]] | None = None,
    generic: tuple[str, ...] = GENERIC,
    similarity: Column | None = None,
    least: float = 0.65,
) -> Column:
    """Whether a hit answers a sample: most of its special keywords stand in the content; or the hit is of an evidence
    document, by its file or by a law name that holds the document's (four characters or more), and one keyword or a synonym
    stands there; or a similarity, if given, reaches `least`. Keywords of one character never count. Null counts as empty.
    """
    empty = F.array().cast("array<string>")
    text, file, law = (F.coalesce(c, F.lit("")) for c in (content, source_file, law_name))
    docs, keywords = F.coalesce(docs, empty), F.coalesce(keywords, empty)
    special = F.filter(keywords, lambda k: ~k.isin(*generic)) if generic else keywords
    long = F.filter(special, lambda k: F.length(k) >= 2)
    matched = F.size(F.filter(long, lambda k: F.contains(text, k)))
    mostly = (F.size(long) > 0) & (matched >= F.greatest(F.lit(2), F.floor(F.size(long) * 0.6)))
    any_word = (F.size(keywords) > 0) & F.exists(expanded(special, synonyms or {}), lambda k: (F.length(k) >= 2) & F.contains(text, k))
    by_file = (file != "") & F.array_contains(docs, file)
    by_law = F.exists(docs, lambda d: (F.length(stem(d)) >= 4) & F.contains(law, stem(d)))
    found = mostly | (any_word & (by_file | by_law))
    return found if similarity is None else found | F.coalesce(similarity >= least, F.lit(False))


def recall(hits: DataFrame, samples: DataFrame) -> DataFrame:
    """query_id, recall: evidence documents that relevant hits bring, of all of a sample's; 0 without any.

    hits: query_id, rel, source_file, law_name; samples: query_id, docs. A hit brings one document, the first by name whose
    file it is or whose name its file (or law, if it has none) holds.
    """
    source = F.coalesce(F.nullif(F.col("source_file"), F.lit("")), F.col("law_name"), F.lit(""))
    brought = F.filter("docs", lambda d: (source != "") & ((d == source) | F.contains(source, stem(d))))
    met = hits.where("rel > 0").join(samples.select("query_id", "docs"), "query_id").select("query_id", F.array_min(brought).alias("doc"))
    found = met.groupBy("query_id").agg(F.countDistinct("doc").alias("n"))
    share = F.coalesce(F.try_divide(F.col("n").cast("double"), F.size("docs")), F.lit(0.0))
    return samples.join(found, "query_id", "left").select("query_id", share.alias("recall"))


def report(measured: DataFrame) -> DataFrame:
    """question_type (all: null), samples, precision, recall, mrr, ndcg, rejection_rate, from a row per sample.

    Over all, recall leaves out unanswerable samples, and rejection_rate is the share of these that had hits.
    """
    answerable = F.col("question_type") != "unanswerable"
    kept = F.when(F.grouping("question_type") == 1, F.avg(F.when(answerable, F.col("recall")))).otherwise(F.avg("recall"))
    rejected = F.avg(F.when(~answerable, (F.col("n_hits") > 0).cast("double")))
    return measured.groupingSets([[], ["question_type"]], "question_type").agg(
        F.count("*").alias("samples"),
        F.avg("precision").alias("precision"),
        F.coalesce(kept, F.lit(0.0)).alias("recall"),
        F.avg("mrr").alias("mrr"),
        F.avg("ndcg").alias("ndcg"),
        F.coalesce(rejected, F.lit(0.0)).alias("rejection_rate"),
    )


def failures(measured: DataFrame, least: float = 0.5) -> DataFrame:
    """Samples whose recall is below `least`, and why: none (no hits), irrelevant (none relevant) or ranking."""
    why = F.when(F.col("n_hits") == 0, "none").when(F.col("precision") == 0, "irrelevant").otherwise("ranking")
    return measured.where(F.col("recall") < least).withColumn("reason", why)


def judged(scores: DataFrame) -> DataFrame:
    """question_type (all: null), metric, mean, n, from question_type, metric, value of an outside judge; NaN is left out."""
    value = F.when(~F.isnan("value"), F.col("value"))
    return scores.groupingSets([["metric"], ["metric", "question_type"]], "metric", "question_type").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def level_lists(levels: DataFrame) -> DataFrame:
    """level, metrics (metric=value, sorted), from metric, value, level; metrics without a level are left out."""
    line = F.concat("metric", F.lit("="), F.format_number(F.round("value", 3), 3))
    return levels.where("level is not null").groupBy("level").agg(F.array_join(F.array_sort(F.collect_list(line)), ",").alias("metrics"))


def new_samples(candidates: DataFrame, existing: DataFrame, order: list[str], shortest: int = 20) -> DataFrame:
    """Candidates whose answer has `shortest` characters and one of their keywords (two characters or more), and whose
    question is neither in existing nor one of an earlier kept candidate. candidates: question, answer, keywords.
    """
    named = F.exists("keywords", lambda k: (F.length(k) >= 2) & F.contains("answer", k))
    good = candidates.where((F.length("answer") >= shortest) & named).join(existing.select("question").distinct(), "question", "left_anti")
    row = F.struct(*(F.col(c) for c in good.columns))
    first = good.groupBy("question").agg(F.min_by(row, F.struct(*order)).alias("first"))
    return first.select("first.*").select(*candidates.columns)
