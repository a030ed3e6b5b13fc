"""Clauses, rules, classification and page lines of product documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

# What a violation costs, and the grades.
WEIGHTS = {"critical": 40, "high": 20, "medium": 10, "low": 5}
PRICING = 10
GRADES = ((90, "A"), (75, "B"), (60, "C"))

#: The largest part of a table of rules or keywords that is broadcast at once.
BROADCAST_BYTES = 8 << 20


def clauses(text: Column, marker: str = r"(?m)^(\d+(?:\.\d+)+)\s") -> Column:
    """Clause numbers in a text, in order."""
    return F.regexp_extract_all(text, F.lit(marker), 1)


def number_key(number: Column) -> Column:
    """Sorts 2.10 after 2.9."""
    return F.transform(F.split(number, r"\."), lambda x: x.cast("int"))


def broadcast_blocks(rows: DataFrame, most: int = BROADCAST_BYTES) -> list[DataFrame]:
    """rows, measured and cut by hash into blocks to broadcast, none over `most` bytes.

    Raises ValueError where 4096 blocks don't suffice, as for a single row over that size.
    """
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in rows.columns), F.lit(64))
    n = 1
    while n <= 4096:
        block = F.pmod(F.xxhash64(*rows.columns), F.lit(n))
        largest = rows.groupBy(block.alias("b")).agg(F.sum(size).alias("s")).agg(F.max("s")).first()[0] or 0
        if largest <= most:
            return [F.broadcast(rows.where(block == i) if n > 1 else rows) for i in range(n)]
        n *= 2
    raise ValueError(f"4096 blocks of {most} bytes don't hold the rows")


def keyword_blocks(rows: DataFrame, most: int) -> list[list[Row]]:
    """rows (n, keyword, and what else is wanted), cut into blocks of `most` bytes at most, each of which may go to the driver."""
    return [block.collect() for block in broadcast_blocks(rows.where("keyword is not null"), most)]


def keywords_in(texts: DataFrame, columns: tuple[str, ...], keywords: list[Row]) -> DataFrame:
    """texts with, for each of columns, the array `in_{column}` of the numbers n of all keywords that it holds.

    keywords: n, keyword; a block of bounded size. An automaton over all of them passes each text once, however many there
    are. The empty keyword is in every text; null texts hold none.
    """
    shared = texts.sparkSession.sparkContext.broadcast([(r.n, r.keyword) for r in keywords])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers: dict[str, list[int]] = {}
        for n, keyword in shared.value:
            numbers.setdefault(keyword, []).append(n)
        everywhere = numbers.pop("", [])
        automaton = ahocorasick.Automaton()
        for keyword, ns in numbers.items():
            automaton.add_word(keyword, ns)
        if numbers:
            automaton.make_automaton()

        def find(text: str | None) -> list[int]:
            if not isinstance(text, str):
                return []
            found = {id(ns): ns for _, ns in automaton.iter(text)} if numbers else {}
            return sorted([*everywhere, *(n for ns in found.values() for n in ns)])

        for b in batches:
            yield b.assign(**{f"in_{c}": b[c].map(find) for c in columns})

    schema = StructType([*texts.schema, *(StructField(f"in_{c}", ArrayType(IntegerType())) for c in columns)])
    return texts.mapInPandas(run, schema)


def classify(docs: DataFrame, keywords: DataFrame, id_col: str, name: str, body: str, head: int = 2000, most: int = BROADCAST_BYTES) -> DataFrame:
    """id, category, score: half a keyword's length, five times in the name, once in the first characters of the body.

    keywords: category, cat_pos, keyword; a dictionary that meets the documents in blocks of `most` bytes. Ties go to
    the first category.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.lower(name).alias("n"), F.lower(F.substring(body, 1, head)).alias("b"))
    numbered = keywords.select("category", "cat_pos", "keyword", F.lit(0).alias("n"))
    parts = []
    for block in keyword_blocks(numbered, most):
        rows = [Row(n=i, keyword=r.keyword, category=r.category, cat_pos=r.cat_pos) for i, r in enumerate(block)]
        found = keywords_in(texts, ("n", "b"), rows)
        hits = [found.select("id", F.explode(f"in_{c}").alias("k"), F.lit(weight).alias("weight")) for c, weight in (("n", 5), ("b", 1))]
        known = docs.sparkSession.createDataFrame([(r.n, r.category, r.cat_pos, len(r.keyword)) for r in rows], "k int, category string, cat_pos int, size int")
        parts.append(hits[0].unionByName(hits[1]).join(F.broadcast(known), "k"))  # no larger than the block
    scored = reduce(DataFrame.unionByName, parts).groupBy("id", "category", "cat_pos").agg(F.sum(F.col("size") / 2 * F.col("weight")).alias("score"))
    best = Window.partitionBy("id").orderBy(F.desc("score"), "cat_pos")
    return scored.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("id", "category", "score")


def rule_hits(texts: DataFrame, rules: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of texts (id, text) that a rule (rule, severity, keyword, pattern) matches; rules come in blocks of `most` bytes.

    All keywords are looked for in one pass of a text. Only rules with a pattern are tried one by one.
    """
    parts = []
    for block in broadcast_blocks(rules.select("rule", "severity", "keyword", "pattern"), most):
        rows = block.collect()
        known = [Row(n=i, keyword=r.keyword) for i, r in enumerate(rows) if r.keyword is not None]
        found = keywords_in(texts.select("id", "text"), ("text",), known)
        table = F.broadcast(texts.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, rule string, severity string, keyword string, pattern string"))
        plain = found.select("id", F.explode("in_text").alias("n")).join(table.where("pattern is null"), "n")
        either = F.array_contains("in_text", F.col("n")) | F.coalesce(F.expr("text rlike pattern"), F.lit(False))
        parts += [plain.select("id", "rule", "severity"), found.join(table.where("pattern is not null"), either).select("id", "rule", "severity")]
    return reduce(DataFrame.unionByName, parts)


def rule_score(hits: DataFrame, ids: DataFrame, pricing: DataFrame | None = None) -> DataFrame:
    """id, score (100 less the weights, and less PRICING for each row of pricing: id; at least 0), grade."""
    weight = F.coalesce(*(F.when(F.col("severity") == k, v) for k, v in WEIGHTS.items()), F.lit(0))
    lost = hits.select("id", weight.alias("w"))
    if pricing is not None:
        lost = lost.unionByName(pricing.select("id", F.lit(PRICING).alias("w")))
    lost = lost.groupBy("id").agg(F.sum("w").alias("lost"))
    score = F.greatest(F.lit(0), F.lit(100) - F.coalesce("lost", F.lit(0)))
    out = ids.join(lost, "id", "left").select("id", score.cast("long").alias("score"))
    grade = F.lit("D")
    for least, name in reversed(GRADES):
        grade = F.when(F.col("score") >= least, name).otherwise(grade)
    return out.withColumn("grade", grade)


def by_severity(hits: DataFrame) -> DataFrame:
    """id, and for each severity of WEIGHTS the rules that found something, sorted. hits: id, rule, severity."""
    lists = (F.array_sort(F.collect_set(F.when(F.col("severity") == k, F.col("rule")))).alias(k) for k in WEIGHTS)
    return hits.groupBy("id").agg(*lists)


def batches(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Adds batch: `size` rows each, in order."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("batch", F.floor((n - 1) / size).cast("long"))


def within_budget(rows: DataFrame, by: str, order: str, text: str, budget: int, most: int) -> DataFrame:
    """Rows in order until the running total passes the budget, at most `most`."""
    w = Window.partitionBy(by).orderBy(order)
    total = F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_t", total).withColumn("_n", F.row_number().over(w)).where((F.col("_t") <= budget) & (F.col("_n") <= most)).drop("_t", "_n")


# The limits of a document's clauses: characters of one, of all, how many, and the share of control characters.
SHORTEST, LONGEST, MOST_CLAUSES, MOST_CHARACTERS, MOST_CONTROL = 10, 10_000, 500, 500_000, 0.01


def normal_clauses(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Clauses that are long enough and hold few control characters, cut, until their running total or number is reached."""
    control = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    kept = rows.where((F.length(text) >= SHORTEST) & (control <= MOST_CONTROL * F.length(text)))
    return within_budget(kept.withColumn(text, F.substring(text, 1, LONGEST)), by, order, text, MOST_CHARACTERS, MOST_CLAUSES)


def ndjson(fragments: DataFrame, by: str, order: str, fragment: str) -> DataFrame:
    """by, record: the JSON objects of a stream of fragments, joined in order; blanks, [], {} and broken lines are left out."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(fragment).alias("f")))), lambda x: x.f), "")
    lines = fragments.groupBy(by).agg(whole.alias("w")).select(by, F.explode(F.split("w", "\n")).alias("record"))
    lines = lines.withColumn("record", F.trim("record"))
    return lines.where(~F.col("record").isin("", "[]", "{}") & F.try_parse_json("record").isNotNull())


def clause_groups(lines: DataFrame, by: str, order: str, line: str, number: str = r"^(\d+(?:\.\d+)+)\s") -> DataFrame:
    """by, number, n_lines: lines under the last clause number before them; a number that comes again goes on."""
    own = F.nullif(F.regexp_extract(line, number, 1), F.lit(""))
    last = F.last(own, ignorenulls=True).over(Window.partitionBy(by).orderBy(order))
    return lines.withColumn("number", last).where("number is not null").groupBy(by, "number").agg(F.count("*").alias("n_lines"))


def sections_of(lines: DataFrame, by: str, order: str, kind: Column) -> DataFrame:
    """by, section, kind, first, last: runs of lines of one kind; a line without one belongs to the run before it."""
    w = Window.partitionBy(by).orderBy(order)
    filled = lines.withColumn("kind", F.last(kind, ignorenulls=True).over(w)).where("kind is not null")
    changed = F.coalesce((F.col("kind") != F.lag("kind").over(w)).cast("int"), F.lit(1))
    runs = filled.withColumn("_c", changed).withColumn("section", F.sum("_c").over(w))
    return runs.groupBy(by, "section", "kind").agg(F.min(order).alias("first"), F.max(order).alias("last"))


def column_gap(xs: DataFrame, by: str, x: str, bins: int = 20) -> DataFrame:
    """by, gap: the emptiest of `bins` bins between 30 and 70 % of the width, if it holds under a tenth of the mean."""
    b = F.least(F.floor(F.col(x) * bins), F.lit(bins - 1)).cast("int")
    counts = xs.groupBy(by, b.alias("bin")).agg(F.count("*").alias("n"))
    grid = counts.select(by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(counts, [by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mean = F.avg("n").over(Window.partitionBy(by))
    low = full.withColumn("mean", mean).where((F.col("bin") >= 0.3 * bins) & (F.col("bin") < 0.7 * bins) & (F.col("n") < F.col("mean") / 10))
    return low.groupBy(by).agg(F.min_by("bin", F.struct("n", "bin")).alias("gap"))


# The marks that open the parts of a document under audit.
CLAUSE_MARK = r"【(?:附加险)?条款\s+(\d+(?:\.\d+)*)】"
PART_MARKS = {"has_notices": "【投保须知】", "has_health": "【健康告知】", "has_exclusions": "【责任免除】", "has_tables": r"【数据表 \d+】"}


def document_parts(text: Column, fewest: int = 10, share: float = 0.3) -> Column:
    """struct of all_clauses, definition_chapter, clauses (those to audit) and the flags of PART_MARKS.

    The last chapter defines terms if it has `fewest` clauses and `share` of all; its clauses aren't audited.
    """
    numbers = F.regexp_extract_all(text, F.lit(CLAUSE_MARK), 1)
    chapter = F.transform(numbers, lambda n: F.substring_index(n, ".", 1).cast("int"))
    last = F.array_max(chapter)
    many = F.size(F.filter(chapter, lambda c: c == last))
    defines = F.when((many >= fewest) & (many >= F.size(numbers) * share), last.cast("string"))
    audited = F.when(defines.isNull(), numbers).otherwise(F.filter(numbers, lambda n: ~F.startswith(n, F.concat(defines, F.lit(".")))))
    flags = (text.rlike(p).alias(name) for name, p in PART_MARKS.items())
    return F.struct(numbers.alias("all_clauses"), defines.alias("definition_chapter"), audited.alias("clauses"), *flags)


def article_number(content: Column, fallback: Column) -> Column:
    """The article that a regulation's text begins with, else the fallback."""
    return F.coalesce(F.nullif(F.regexp_extract(content, "^(第[一二三四五六七八九十百零]+条)", 1), F.lit("")), fallback)


def normal_violations(raw: DataFrame, refs: DataFrame, check_type: str) -> DataFrame:
    """Violations with content, in one shape. raw: clause_number, clause_content, status, source_ref, suggestion, conclusion;
    refs: source_ref, chunk_id. Without a number in it, a clause's is 未知; without a status, it is non_compliant."""
    number = F.nullif(F.regexp_extract(F.coalesce("clause_number", F.lit("")), r"(\d+(?:\.\d+)*(?:\(\d+\))?)", 1), F.lit(""))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    kept = raw.where(F.coalesce("clause_content", F.lit("")) != "").join(refs, "source_ref", "left")
    others = [c for c in raw.columns if c not in ("clause_number", "clause_content", "status", "source_ref", "suggestion", "conclusion")]
    return kept.select(
        *others, F.coalesce(number, F.lit("未知")).alias("clause_number"), F.lit(check_type).alias("check_type"), "clause_content",
        F.coalesce("status", F.lit("non_compliant")).alias("status"), "chunk_id", text("source_ref"), text("suggestion"), text("conclusion"),
    )


# The kinds of parts of a document in the order of its combined text, and their marks; {n} is a part's number,
# of tables their place.
COMBINED = (("clause", "【条款 {n}】"), ("table", "【数据表 {n}】"), ("notice", "【投保须知】"), ("health", "【健康告知】"), ("exclusion", "【责任免除】"), ("rider", "【附加险条款 {n}】"))


def combined_text(parts: DataFrame, by: str, order: str) -> DataFrame:
    """by, text: the parts of each document with their marks, by kind and order. parts: by, order, kind, number, title, text."""
    kinds = [k for k, _ in COMBINED]
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    n = F.row_number().over(Window.partitionBy(by, "kind").orderBy(order)).cast("string")
    n = F.when(F.col("kind") == "table", n).otherwise(F.coalesce("number", F.lit("")))
    mark = F.get(F.array(*(F.lit(m) for _, m in COMBINED)), (place - 1).cast("int"))
    head = F.concat(F.replace(mark, F.lit("{n}"), n), F.when(F.col("kind") == "table", "").otherwise(F.coalesce("title", F.lit(""))))
    lines = parts.where(F.col("kind").isin(*kinds)).select(by, order, place.alias("_place"), F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("_line"))
    rows = F.array_sort(F.collect_list(F.struct("_place", order, "_line")))
    return lines.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["_line"]), "\n\n").alias("text"))
