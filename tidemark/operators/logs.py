"""Conversations, feedback, traces, caches and tables that change: windows, as-of joins, merges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.storage import forget, written


def last_before(value: Column, keep: Column, by: list[str], order: list[str]) -> Column:
    """Backward as-of: the latest value before this row where keep holds."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(keep, value), ignorenulls=True).over(w)


def first_after(value: Column, keep: Column, by: list[str], order: list[str]) -> Column:
    """Forward as-of: the next value after this row where keep holds."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return F.first(F.when(keep, value), ignorenulls=True).over(w)


def in_loop(question: Column, by: str, order: str, last: int = 3) -> Column:
    """Whether the last `last` questions are (nearly) all the same, judged by a short hash of the trimmed lower text."""
    w = Window.partitionBy(by).orderBy(order)
    h = F.substring(F.md5(F.lower(F.trim(question))), 1, 8)
    recent = w.rowsBetween(1 - last, 0)
    return (F.count(F.lit(1)).over(recent) >= last) & (F.size(F.collect_set(h).over(recent)) < 1.5)


def failures_in(minutes: int, by: str, ts: str, failed: Column) -> Column:
    """Failures of a user in the minutes up to and including each event."""
    seconds = F.col(ts).cast("timestamp").cast("long")
    w = Window.partitionBy(by).orderBy(seconds).rangeBetween(-60 * minutes, 0)
    return F.sum(failed.cast("long")).over(w)


def ttl_hits(log: DataFrame, key: list[str], ts: str, ttl: int) -> DataFrame:
    """Adds hit: whether the same key was seen at most ttl seconds before."""
    seconds = F.col(ts).cast("timestamp").cast("long")
    before = F.lag(seconds).over(Window.partitionBy(*key).orderBy(ts, "event_id"))
    return log.withColumn("hit", F.coalesce(seconds - before <= ttl, F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Rows of either. Where new has the row, its values win, null ones too, but for the columns in keep_old of a row that
    old has. Keys are one row each in either."""
    a, b = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    cols = [c for c in old.columns if c != key]

    def pick(c: str) -> Column:
        mine, theirs = F.col(f"o.{c}"), F.col(f"n.{c}")
        return F.when(F.col("_old").isNotNull(), mine).otherwise(theirs) if c in keep_old else F.when(F.col("_new").isNotNull(), theirs).otherwise(mine)

    return a.join(b, key, "full").select(key, *(pick(c).alias(c) for c in cols))


def insert_ignore(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks; of equal keys in new the first wins."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(key), key, "left_anti").select(*old.columns))


def breaker_states(log: DataFrame, by: str, order: str, failed: Column, limit: int = 5, cool: int = 60) -> DataFrame:
    """by, order, state after each call: closed, open or half_open.

    `limit` failures in a row open the breaker; `cool` seconds later one call is let through, which closes it again if
    it succeeds. Each call depends on the one before it, so a service's calls pass one task in order, which keeps two numbers;
    nothing is collected. log: by, order (seconds).
    """
    rows = log.select(F.col(by).cast("string").alias("s"), F.col(order).cast("long").alias("t"), failed.alias("bad"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, since = None, 0, None
        for b in batches:
            states = []
            for s, t, bad in zip(b["s"].tolist(), b["t"].tolist(), b["bad"].tolist(), strict=True):
                if not states and now is None or s != now:
                    now, n, since = s, 0, None
                if since is not None and t - since < cool:
                    states.append("open")
                    continue
                half = since is not None
                n = n + 1 if bad else 0
                if bad and (half or n >= limit):
                    n, since = 0, t
                    states.append("open")
                else:
                    since = None
                    states.append("half_open" if half else "closed")
            yield pd.DataFrame({"s": b["s"], "t": b["t"], "state": states})

    dealt = rows.repartition("s").sortWithinPartitions("s", "t")
    return dealt.mapInPandas(run, "s string, t long, state string").select(F.col("s").alias(by), F.col("t").alias(order), "state")


def memory_state(created: Column, accessed: Column, accesses: Column, as_of: Column, *, ttl_days: int = 30, idle_days: int = 60) -> Column:
    """expired: created more than ttl_days ago (0: never); unused: last touched more than idle_days ago without an access;
    else live. as_of is a parameter, so that a run can be repeated."""
    expired = F.datediff(as_of, created) > ttl_days if ttl_days else F.lit(False)
    return F.when(expired, "expired").when((F.datediff(as_of, accessed) > idle_days) & (accesses == 0), "unused").otherwise("live")


def depths(spans: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """id, depth of each span below its root: a span without a parent among the ids, or its own.

    Each round doubles how far a span looks up, so there are about log2 of the deepest chain; every round is written, where
    the next one starts. Spans that lead into a cycle have no root and are left out.
    """
    rows = spans.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up"))
    known = rows.select(F.col("id").alias("up"), F.lit(True).alias("known"))
    found = rows.join(known, "up", "left").select("id", F.when(F.col("known") & (F.col("up") != F.col("id")), F.col("up")).alias("up"))
    now = written(found.select("id", "up", F.col("up").isNotNull().cast("long").alias("depth")))
    left = None
    while True:
        open_ = now.agg(F.count("up").alias("n"), F.sum("depth").alias("d")).first()
        # Done, or only cycles are left, which look further up for ever without an end.
        if not open_.n or left is not None and open_.n == left:
            return now.where("up is null").select("id", "depth")
        left = open_.n
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        step = now.join(above, "up", "left").select("id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        after = written(step)
        forget(now)
        now = after
