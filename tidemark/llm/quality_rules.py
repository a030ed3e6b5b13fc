"""Quality rules: base counts, then hashed n-gram log-likelihood ratios of a trusted target against the raw corpus.

Everything is DataFrame operations. Each text becomes arrays inside its own row. Exchanges carry the counts of `buckets` hashed
n-grams, and once the texts whose ids may be trusted, to find those of the trusted target. Passes over the documents: for these, then
counts, then scores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text, written

SPACE_CLASS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


def _split(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(docs, text_col)
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    return docs.select(docs[id_col].alias("doc_id"), text.alias("text"), row).select(
        "doc_id", "text", "row", F.array_remove(F.split("text", SPACE_CLASS + "+"), "").alias("words")
    )


def _hashed(words: DataFrame) -> DataFrame:
    """Adds n_words and hashes, the 64-bit hash of each word in order."""
    return words.withColumn("n_words", F.size("words").cast("long")).withColumn(
        "hashes", F.transform("words", lambda w: F.xxhash64(w))
    )


def _pairs(n: Column, size: int, f) -> Column:
    """f of each start of a window of `size` words."""
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), (n - size).cast("int")), f)).otherwise(
        F.array().cast("array<bigint>")
    )


def _ngrams(hashes: Column, n: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    ones = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)))
    twos = _pairs(n, 2, lambda i: F.pmod(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)), F.lit(buckets)))
    return F.concat(ones, twos)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (the whole row), hashes and the base counts of each document.

    Two windows count as the same if the 64-bit hash of their three words is; within one text that is exact for
    all practical purposes (20,000 words: one error in 10^11 texts).
    """
    split = _split(docs, id_col, text_col)
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = _hashed(
        split.select(
            "doc_id",
            "row",
            "words",
            F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            lines.alias("lines"),
        )
    )
    h, n = F.col("hashes"), F.col("n_words")
    windows = _pairs(n, 3, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    sorted_windows = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    counted = counted.select(
        "doc_id",
        "row",
        "n_words",
        "hashes",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        sorted_windows.alias("w"),
    )
    w = F.col("w")
    same = lambda x, y: F.coalesce(x.h == y.h, F.lit(False))
    found = F.filter(
        F.transform(
            w, lambda x, i: F.when(same(x, F.get(w, i + 1)) | same(x, F.get(w, i - 1)), x.i)
        ),
        lambda x: x.isNotNull(),
    )
    counted = counted.withColumn("starts", F.sort_array(found)).drop("w")
    s = F.col("starts")
    covered = F.aggregate(
        F.transform(s, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - x, F.lit(3))).cast("long")),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return counted.select(
        "doc_id", "row", "hashes", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words")
    )


def ratio_weights(
    docs: DataFrame, known: DataFrame, buckets: int, prior: float, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[list[float], list[list[float]]]:
    """The log-likelihood ratio of each bucket, by all of the target and by each half of it.

    known: the documents of the target, all of them, with row.half (0 or 1). All documents are counted, in one pass; the driver gets
    at most 2 * `buckets` rows. The target's multinomial is smoothed towards the raw one with `prior` times its own mass.
    """

    def counts(rows: DataFrame, half: Column) -> DataFrame:
        grams = _hashed(_split(rows, id_col, text_col).withColumn("half", half).drop("text", "row")).select("half", "hashes", "n_words")
        exploded = grams.select("half", F.explode(_ngrams(F.col("hashes"), F.col("n_words"), buckets)).alias("bucket"))
        return exploded.groupBy("bucket").agg(F.count("*").alias("n"), F.coalesce(F.sum("half"), F.lit(0)).alias("second"))

    raw, whole, second = [0] * buckets, [0] * buckets, [0] * buckets
    for r in counts(docs, F.lit(0)).collect():
        raw[r.bucket] = r.n
    for r in counts(known, F.col("row.half")).collect():
        whole[r.bucket], second[r.bucket] = r.n, r.second

    n_raw = sum(raw)

    def ratios(target: list[int]) -> list[float]:
        n = sum(target)
        if not n:
            return [0.0] * buckets
        out = []
        for x, y in zip(raw, target, strict=True):
            p = (x + 1) / (n_raw + buckets)
            out.append(math.log((y + prior * n * p) / ((1 + prior) * n * p)))
        return out

    return ratios(whole), [ratios([x - y for x, y in zip(whole, second, strict=True)]), ratios(second)]


def _scored(docs: DataFrame, w: Column, buckets: int, min_words: int, max_repeat_percent: int, **cols: str) -> DataFrame:
    """base_counts() of docs with base_failed and llr. w: the weights, as a value or a column of the row."""
    scored = base_counts(docs, **cols).withColumn("grams", _ngrams(F.col("hashes"), F.col("n_words"), buckets))
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get(F.col("w"), b.cast("int")))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    return scored.withColumn("w", w).select(
        "doc_id",
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(F.lit(0.0)).alias("llr"),
    )


def quantiles(rows: DataFrame, col: str, shares: tuple[float, ...], most: int = 10_000, bins: int = 1 << 12) -> list[float]:
    """Exact quantiles of a column of finite doubles, between neighbours in proportion; 0 of no rows. rows: a written table.

    The range that holds a rank is cut into bins, and the bin that holds it again, until it has at most `most` values or one; only
    these, and the counts of bins, come to the driver.
    """
    ends = rows.agg(F.count(col).alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).first()

    def at(rank: int) -> float:
        low, high, n = ends.low, ends.high, ends.n
        while low < high:
            inside = rows.where(F.col(col).between(low, high))
            if n <= most:
                return sorted(r[0] for r in inside.select(col).collect())[rank]
            place = F.least(F.floor((F.col(col) - low) / (high - low) * bins), F.lit(bins - 1))
            counted = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("low"), F.max(col).alias("high"))
            for r in sorted(counted.collect(), key=lambda r: r.bin):
                if rank < r.n:
                    break
                rank -= r.n
            low, high, n = r.low, r.high, r.n
        return low

    out = []
    for share in shares:
        place = share * (ends.n - 1)
        below = math.floor(place)
        out.append(0.0 if not ends.n else at(below) if below == place else at(below) + (place - below) * (at(below + 1) - at(below)))
    return out


def _likely(docs: DataFrame, ids: DataFrame, id_col: str, per_id: int = 16, most: int = 1 << 26) -> DataFrame:
    """Rows of docs whose id is among ids, and few others: those whose hash meets that of an id in a table of bits.

    The table has about `per_id` bits for each id, `most` (8 MB) at most; a fuller one lets more rows through. ids: a written table.
    """
    bits = min(most, 1 << max(0, per_id * ids.count() - 1).bit_length())

    def place(col: str) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(col), F.lit(bits))
        return F.shiftright(at, 15), at.bitwiseAND(F.lit((1 << 15) - 1))

    block, at = place(id_col)
    marked = ids.groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(at).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1
    return docs.join(F.broadcast(marked), block == F.col("_block")).where(hit).drop("_block", "_bits")


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 1 << 14,
    prior: float = 1.0,
    quantile: float = 0.001,
    stretch: float = 1.5,
    threshold: float | None = None,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    with_row: bool = False,
) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept, llr; row, the row itself, if with_row.

    The trusted target is all documents labelled quality = 1: their texts are joined by id, past a table of bits that stops
    nearly all others, and written once. Counts cover every
    document. llr is the mean over a document's n-grams (words and pairs of neighbours) of
    log p_target / p_raw; kept is true where the base rules hold and llr >= threshold.

    Unless given, the threshold follows from how the target scores when it isn't counted: each half is scored by the
    ratios of the other, and the threshold lies `stretch` times as far below the median as the lowest `quantile` does.

    Null text: no words, hence base_failed. Null doc_id: the row stays, never trusted. Repeated rows each give a row.
    No labels: all ratios are 0 and only the base rules decide. No documents: no rows. Other columns are ignored.
    """
    spark, cols = docs.sparkSession, {"id_col": id_col, "text_col": text_col}
    first = written(labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(id_col)).distinct())
    half = F.pmod(F.hash(id_col), F.lit(2)).alias("half")
    rows = docs.select(id_col, text_col)
    if rows.schema[id_col].dataType == first.schema[id_col].dataType:  # else equal ids may differ in their hashes
        rows = _likely(rows, first, id_col)
    known = written(rows.join(first.hint("merge"), id_col).select(id_col, text_col, half))
    whole, halves = ratio_weights(docs, known, buckets, prior, **cols)

    def value(weights: list[float]) -> Column:
        """One value with `buckets` numbers: its size does not depend on the data."""
        return spark.createDataFrame([(weights,)], "w array<double>").scalar()

    rules = {"buckets": buckets, "min_words": min_words, "max_repeat_percent": max_repeat_percent} | cols
    if threshold is None:
        crossed = F.when(F.col("row.half") == 0, value(halves[1])).otherwise(value(halves[0]))
        llr = F.when(~F.col("base_failed"), F.col("llr"))
        scores = written(_scored(known, crossed, **rules).select(llr.alias("llr")))  # no filter, into which all would be copied
        low, middle = quantiles(scores, "llr", (quantile, 0.5))
        threshold = middle - stretch * (middle - low)
    scored = _scored(docs, value(whole), **rules)
    # The last term is always true. It isn't deterministic to the optimiser, which so leaves a later filter on kept
    # where it is, instead of copying all these expressions into it, each time they are used.
    kept = ~F.col("base_failed") & (F.col("llr") >= threshold) & (F.spark_partition_id() >= 0)
    return scored.withColumn("kept", kept).drop(*([] if with_row else ["row"]))
