"""Document and chunk quality: issues, gates, exact dedup, incremental builds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

GARBLED = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]|﻿|�"


def front_matter_issues(text: Column, wanted: tuple[str, ...]) -> Column:
    """An array of issue: severity:code[:key]."""
    starts = F.startswith(text, F.lit("---"))
    parts = F.split(text, "---", 3)
    head = F.get(parts, F.lit(1))
    ended = starts & (F.size(parts) == 3)
    missing = [F.when(ended & ~head.rlike(rf"(?m)^{k}:\s*\S"), F.lit(f"warning:missing:{k}")) for k in wanted]
    return F.array_compact(
        F.array(
            F.when(~starts, "warning:none"),
            F.when(starts & ~ended, "error:unterminated"),
            F.when(ended & (F.trim(head) == ""), "warning:empty"),
            *missing,
        )
    )


def garbled(text: Column) -> Column:
    return text.rlike(GARBLED)


def content_issues(text: Column, shortest: int = 50, least_variety: float = 0.3) -> Column:
    n = F.length(F.trim(text))
    kinds = F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))
    return F.array_compact(
        F.array(
            F.when(n < shortest, "error:short"),
            F.when((n >= shortest) & (F.try_divide(kinds.cast("double"), F.length(text)) < least_variety), "info:uniform"),
            F.when(garbled(text), "error:garbled"),
        )
    )


def first_of_each_text(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row of each text. Rows meet by the text's hash, so that no text is a shuffle key."""
    w = Window.partitionBy("_h").orderBy(*order)
    return rows.withColumn("_h", F.md5(text)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_h", "_n")


def observed_write(df: DataFrame, path: str, **figures: Column) -> dict[str, object]:
    """Writes df, and gives aggregates of its rows as they were counted on the way: no further pass. A task that is tried again
    counts once."""
    seen = Observation()
    df.observe(seen, *(c.alias(name) for name, c in figures.items())).write.mode("overwrite").parquet(path)
    return seen.get


def build_figures(parsed: DataFrame, root: str, ok: str, id_col: str, stores: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """One row: parsed, passed, the rows of each store, and whether all stores hold the same ids (consistent).

    parsed: chunks, and in column ok whether they pass. stores: name, and what is kept of a chunk that passes; each is
    written below root. Chunks are counted as the first store is written, and each store by itself; ids are compared by their
    number and the sum of their hashes.
    """
    mark = F.coalesce(F.sum(F.xxhash64(id_col).cast("decimal(38,0)")), F.lit(0))
    figures: dict[str, object] = {}
    marks = set()
    for n, (name, kept) in enumerate(stores.items()):
        rows = parsed
        if not n:
            whole = Observation()
            rows = parsed.observe(whole, F.count(F.lit(1)).alias("parsed"), F.count_if(F.coalesce(ok, F.lit(False))).alias("passed"))
        found = observed_write(kept(rows.where(ok)), f"{root}/{name}", n=F.count(F.lit(1)), mark=mark)
        if not n:
            figures |= whole.get
        figures[name] = found["n"]
        marks.add((found["n"], found["mark"]))
    row = (*figures.values(), len(marks) == 1)
    return parsed.sparkSession.createDataFrame([row], ", ".join([*(f"{c} long" for c in figures), "consistent boolean"]))


def incremental(old: DataFrame, changed: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """old without what was deleted or changed, and all that is changed or added."""
    gone = deleted.select(key).unionByName(changed.select(key)).distinct()
    return old.join(gone, key, "left_anti").unionByName(changed)
