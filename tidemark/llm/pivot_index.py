"""Exact top-k search by a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. Sorted by that key, vectors fall into annuli: blocks
of neighbours in distance around one pivot. For a query q and an annulus around pivot p that spans distances lo to hi,
the triangle inequality bounds |q - v| from below, and so q.v from above. Runs of neighbouring annuli are one wider
annulus each, level above level up to a pivot's whole range, so that a block of queries only ever meets the parts of an
annulus whose own bound it couldn't dismiss. Searching goes in rounds:

1. The annuli that hold the queries' own places give a first k-th score.
2. From the pivots down, annuli are expanded where their bound reaches it; of those left, the most promising are scored.
3. The better k-th scores stop most of the others; the rest are scored. Nothing is approximate.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

OUT_SCHEMA = "query_id long, rank int, vec_id long, score long, n_scored long"
#: How many bits of an annulus's number are dropped for the wider annuli, from the widest (of one task) down.
LEVELS = (32, 12, 6, 0)
#: Digits of a score in wide searches; doubles allow no more.
DIGITS = 640
LONG = (-(1 << 63), (1 << 63) - 1)


def scaled(x: np.ndarray | None, dim: int, scale: int) -> bytes | None:
    """floor(scale * x), in 32 bits a component or, if one needs more, as doubles; None where the vector takes no part."""
    if x is None or len(x) != dim or not dim:
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.floor(scale * np.asarray(x, np.float64))
    if not np.isfinite(y).all():
        return None
    return (y.astype(np.int32) if np.abs(y).max() < 1 << 31 else y).tobytes()


def numbers(vectors: list[bytes], dim: int) -> np.ndarray:
    """Vectors as doubles, a row each."""
    data = b"".join(vectors)
    if len(data) == 4 * dim * len(vectors):
        return np.frombuffer(data, np.int32).reshape(len(vectors), dim).astype(np.float64)
    return np.stack([np.frombuffer(v, np.int32 if len(v) == 4 * dim else np.float64).astype(np.float64) for v in vectors])


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the vector of the sample that is farthest from those before it."""
    picked = [0]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(picked) < min(count, len(sample)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[picked[-1]], axis=1))
    return sample[picked]


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of two arrays of whole doubles; Python's integers where 64 bits don't do."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if top < 1 << 62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return whole[0] @ whole[1].T


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(ids) > k:
        edge = np.partition(scores, len(ids) - k)[len(ids) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _blocks(rows: DataFrame, size: int, dim: int) -> DataFrame:
    """rows: vec_id, v, pivot, r. Blocks of up to `size` rows of one pivot, in order of distance."""
    names = ["block", "pivot", "lo", "hi", "norm", "ids", "vectors"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n = TaskContext.get().partitionId(), 0

        def block(part: pd.DataFrame) -> tuple:
            nonlocal n
            n += 1
            vectors = part["v"].tolist()
            norm = np.linalg.norm(numbers(vectors, dim), axis=1).max()
            return ((task << 32) + n, part["pivot"].iloc[0], part["r"].iloc[0], part["r"].iloc[-1], norm, part["vec_id"].tolist(), vectors)

        rest = None
        for b in batches:
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            out, at = [], 0
            pivots = rest["pivot"].to_numpy()
            while at < len(rest):
                end = min(at + size, int(np.searchsorted(pivots, pivots[at], "right")))
                if end == len(rest) and end - at < size:
                    break
                out.append(block(rest.iloc[at:end]))
                at = end
            rest = rest.iloc[at:]
            yield pd.DataFrame(out, columns=names)
        if rest is not None and len(rest):
            yield pd.DataFrame([block(rest)], columns=names)

    dealt = rows.repartitionByRange("pivot", "r", "vec_id").sortWithinPartitions("pivot", "r", "vec_id")
    schema = "block long, pivot int, lo double, hi double, norm double, ids array<long>, vectors array<binary>"
    return dealt.mapInPandas(run, schema)


def top_k(
    vectors: DataFrame,
    queries: str,
    *,
    k: int = 10,
    scale: int = 1024,
    pivots: int = 64,
    sample: int = 4096,
    block: int = 128,
    group: int = 32,
    first_blocks: int = 4,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score, n_scored: the k highest inner products of each query with every other row.

    queries: an SQL condition on vec_id that picks the queries. Components are floor(scale * x), x as double; scores are
    exact integers, ties go to smaller ids. n_scored: how many vectors the query was scored against; the bounds dismissed
    the others. The pivots come from the `sample` vectors with the smallest hash of their id (they only steer the search,
    every vector is indexed). Nothing is dropped or capped.

    Vectors take no part if they are null, empty, hold null or non-finite components, or have no id (or components over
    1.7e305, which scaled are no doubles). Ranks follow the exact scores, however large; one beyond a long is shown as the
    nearest long. A query meets the vectors with as many components as its own; each number of components that queries have
    is a search of its own. A query's row that is repeated is one query; rows with its id and another vector are queries of
    their own, each with its own ranks. A row that repeats a query's id isn't among its results; other repeated rows each
    are. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("x")).where("vec_id is not null")
    asked = rows.where("size(x) > 0").where(queries).select(F.size("x").alias("dim")).distinct().orderBy("dim").collect()
    if not asked:
        return vectors.sparkSession.createDataFrame([], OUT_SCHEMA)
    parts = [_top_k(rows, r.dim, queries, k, scale, pivots, sample, block, group, first_blocks) for r in asked]
    return functools.reduce(DataFrame.unionByName, parts)


def _expanded(asked: DataFrame, meta: DataFrame, reaches: Column) -> DataFrame:
    """asked: q, pivot and what reaches needs besides lo, hi and norm of an annulus. Gives the rows and block for the annuli
    reached, each wider one of which is reached too.
    """
    front = asked.withColumn("above", F.lit(0).cast("long"))
    for n, shift in enumerate(LEVELS):
        above = F.lit(0).cast("long") if n == 0 else F.shiftright("block", LEVELS[n - 1])
        nodes = meta.groupBy("pivot", above.alias("above"), F.shiftright("block", shift).alias("node")).agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("norm").alias("norm")
        )
        met = front.join(nodes, ["pivot", "above"]).where(reaches)
        front = met.drop("above", *(["lo", "hi", "norm"] if shift else [])).withColumnRenamed("node", "above")
    return front.withColumnRenamed("above", "block")


def _top_k(
    rows: DataFrame, dim: int, queries: str, k: int, scale: int, pivots: int, sample: int, block: int, group: int, first_blocks: int
) -> DataFrame:
    """top_k among the vectors of `dim` components. rows: vec_id, x."""
    spark = rows.sparkSession

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = [scaled(x, dim, scale) for x in b["x"]]
            ok = [x is not None for x in v]
            yield pd.DataFrame({"vec_id": b["vec_id"][ok], "v": [x for x in v if x is not None]})

    rows = rows.mapInPandas(clean, "vec_id long, v binary")
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()
    if not picked:
        return spark.createDataFrame([], OUT_SCHEMA)
    points = choose_pivots(numbers([bytes(r.v) for r in picked], dim), pivots)
    shared = spark.sparkContext.broadcast(points)

    def distances(v: np.ndarray) -> np.ndarray:
        p = shared.value
        with np.errstate(over="ignore", invalid="ignore"):
            d = np.sqrt(np.maximum(0, (v * v).sum(1)[:, None] + (p * p).sum(1) - 2 * v @ p.T))
        return np.nan_to_num(d, nan=np.inf, posinf=np.inf)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            v = numbers(b["v"].tolist(), dim)
            d = distances(v)
            at = d.argmin(1)
            yield b.assign(pivot=at.astype(np.int32), r=d[np.arange(len(b)), at], top=np.abs(v).max(1))

    keyed = written(rows.mapInPandas(assign, "vec_id long, v binary, pivot int, r double, top double"))
    index = written(_blocks(keyed.drop("top"), block, dim))
    # A query's place in the blocks, q and row, tells queries with the same id apart.
    queried = _blocks(keyed.where(queries).drop("top").distinct(), group, dim)
    queried = written(queried.withColumnsRenamed({"block": "q", "ids": "q_ids", "vectors": "q_vectors"}))
    # Scores that 64 bits can't hold go by their digits.
    wide = (keyed.agg(F.max("top")).first()[0] or 0) ** 2 * dim >= 1 << 62

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each block of queries and pivot: the range of distances, the highest product and norm."""
        p = shared.value
        for b in batches:
            out = []
            for q, data in zip(b["q"].tolist(), b["q_vectors"], strict=True):
                v = numbers(list(data), dim)
                d = distances(v)
                with np.errstate(over="ignore", invalid="ignore"):
                    norm, product = float(np.sqrt((v * v).sum(1).max())), (v @ p.T).max(0)
                out += zip([q] * len(p), range(len(p)), d.min(0).tolist(), d.max(0).tolist(), product.tolist(), [norm] * len(p))
            yield pd.DataFrame(out, columns=["q", "pivot", "near", "far", "product", "q_norm"])

    reached = queried.select("q", "q_vectors").mapInPandas(
        reach, "q long, pivot int, near double, far double, product double, q_norm double"
    )
    # |q - v| is at least what separates the two ranges of distances to the pivot; something is left for rounding.
    slack = 1 + (F.col("q_norm") + F.col("norm")) * 1e-6
    gap = F.greatest(F.lit(0.0), F.col("near") - F.col("hi") - slack, F.col("lo") - F.col("far") - slack)
    square = F.pow("q_norm", F.lit(2)) + F.pow("norm", F.lit(2))
    bound = F.least((square - gap * gap) / 2, F.col("product") + F.col("q_norm") * (F.col("hi") + slack)) + square * 1e-9 + 1
    bound = F.when(F.isnan(bound), F.lit(float("inf"))).otherwise(bound)
    meta = index.select("block", "pivot", "lo", "hi", "norm")
    schema = "q long, row int, query_id long, vec_id long, score long, about double, digits string"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by block of queries; a task keeps the best k of each query it sees."""

        def flush() -> pd.DataFrame:
            out = []
            for row, (ids, scores) in enumerate(held):
                i = best(ids, scores, k)
                found = [int(x) for x in scores[i]]
                made = {"q": now, "row": row, "query_id": q_ids[row], "vec_id": ids[i], "score": [min(max(x, LONG[0]), LONG[1]) for x in found]}
                made["about"] = [float(x) for x in found]
                made["digits"] = [f"{x + 10**DIGITS:0{DIGITS + 1}d}" for x in found] if wide else None
                out.append(pd.DataFrame(made))
            return pd.concat(out)

        now, q_ids, held = None, [], []
        for b in batches:
            for q, own, data, ids, vectors in zip(*(b[c] for c in ("q", "q_ids", "q_vectors", "ids", "vectors")), strict=True):
                if q != now:
                    if now is not None:
                        yield flush()
                    now, q_ids, asking = q, own, numbers(list(data), dim)
                    held = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q_ids]
                found = exact_scores(asking, numbers(list(vectors), dim))
                for row, (had, scores) in enumerate(held):
                    other = ids != q_ids[row]
                    had, scores = np.concatenate([had, ids[other]]), np.concatenate([scores, found[row][other]])
                    i = best(had, scores, k)
                    held[row] = (had[i], scores[i])
        if now is not None:
            yield flush()

    def search(pairs: DataFrame) -> DataFrame:
        full = pairs.select("q", "block").join(index.select("block", "ids", "vectors"), "block")
        full = full.join(queried.select("q", "q_ids", "q_vectors"), "q")
        return full.sortWithinPartitions("q").mapInPandas(score, schema)

    by_query = Window.partitionBy("q", "row").orderBy(F.desc("digits" if wide else "score"), "vec_id")

    def stops(found: DataFrame) -> DataFrame:
        """A block of queries stops where all its queries do; one with fewer than k results so far never does."""
        kth = found.withColumn("n", F.row_number().over(by_query)).where(F.col("n") == k).groupBy("q").agg(
            F.count("*").alias("n"), F.min("about").alias("stop")
        )
        sizes = queried.select("q", F.size("q_ids").alias("queries"))
        low = F.when(F.col("n") == F.col("queries"), F.col("stop")).otherwise(F.lit(float("-inf")))
        return sizes.join(kth, "q", "left").select("q", low.alias("stop"))

    own = written(_expanded(queried.select("q", "pivot", F.col("lo").alias("near"), F.col("hi").alias("far")), meta, F.expr("lo <= far and hi >= near")).select("q", "block"))
    start = written(search(own))
    reached = reached.join(stops(start), "q")
    front = _expanded(reached, meta, bound >= F.col("stop")).withColumn("bound", bound).select("q", "block", "bound")
    front = front.join(own, ["q", "block"], "left_anti")
    front = written(front.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))))
    first = front.where(F.col("n") <= first_blocks)
    start = written(start.unionByName(search(first)))
    rest = written(front.where(F.col("n") > first_blocks).join(stops(start), "q").where("bound >= stop").select("q", "block"))
    found = start.unionByName(search(rest)).withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    # A query's own vector lies in one of its own annuli, and isn't scored.
    pairs = own.unionByName(first.select("q", "block")).unionByName(rest)
    scored = pairs.join(index.select("block", F.size("ids").alias("size")), "block").groupBy("q").agg((F.sum("size") - 1).alias("n_scored"))
    return found.join(scored, "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "n_scored")
