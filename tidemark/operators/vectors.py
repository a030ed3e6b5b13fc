"""Vector search of a stated set of queries, block against block: exact against all rows, or against the nearest cells of an index.

The index is an inverted file: centroids are fitted on a bounded sample, every row is stored with the cell of its nearest
centroid, and a query looks into the cells whose centroids are nearest to it, where rows are scored exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.retrieval import top_per_query
from tidemark.sources import commits
from tidemark.sources.storage import written

CLEAN = "v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"


def _scores(q: np.ndarray, v: np.ndarray, kind: str) -> np.ndarray:
    if kind == "l2":  # 1 / (1 + squared distance)
        return 1 / (1 + np.array([((v - x) ** 2).sum(1) for x in q]))
    dots = q @ v.T
    if kind == "dot":
        return dots
    length = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))
    return np.divide(dots, length, out=np.zeros_like(dots), where=length > 0)


def _best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of scores its k highest that are allowed, ties to smaller ids: rows and columns. Only what can be among them
    is sorted."""
    scores = np.where(allowed, np.round(scores, 9), -np.inf)
    n = scores.shape[1]
    kept = allowed & (scores >= np.partition(scores, n - k, 1)[:, n - k, None]) if n > k else allowed
    q, r = np.nonzero(kept)
    order = np.lexsort((ids[r], -scores[q, r], q))
    q, r = q[order], r[order]
    starts = np.searchsorted(q, q)  # where each one's row begins
    first = np.arange(len(q)) - starts < k
    return q[first], r[first]


#: Scores that a task holds at once, about.
SCORES = 1 << 19


def _score_blocks(k: int, kind: str, grouped: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block of rows (id, v, grp, cell) and one of queries (id, v, grp, cells) to query_id, id, score of each query's k best rows of
    the block that lie in its cells, some queries at a time."""

    def values(t: pa.Table, name: str) -> np.ndarray:
        return t[name].combine_chunks().to_numpy(zero_copy_only=False)

    def vectors(t: pa.Table) -> np.ndarray:
        return np.asarray(pc.list_flatten(t["v"].combine_chunks()), np.float64).reshape(t.num_rows, -1)

    def score(rows: pa.Table, queries: pa.Table) -> pa.Table:
        parts = [pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        if not rows.num_rows or not queries.num_rows:
            return parts[0]
        ids, v, grp = values(rows, "id"), vectors(rows), values(rows, "grp")
        known, local = np.unique(values(rows, "cell"), return_inverse=True)
        step = max(1, SCORES // len(ids))
        for i in range(0, queries.num_rows, step):
            some = queries.slice(i, step)
            asked, cells = values(some, "id"), some["cells"].combine_chunks()
            own = np.zeros((len(asked), len(known)), bool)  # which of the block's cells a query looks into
            which, wanted = np.asarray(pc.list_parent_indices(cells)), np.asarray(pc.list_flatten(cells))
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            here = known[at] == wanted
            own[which[here], at[here]] = True
            allowed = own[:, local] & (asked[:, None] != ids)
            if grouped:
                allowed &= values(some, "grp")[:, None] == grp
            found = _scores(vectors(some), v, kind)
            q, r = _best(found, ids, allowed, k)
            parts.append(pa.table({"query_id": asked[q], "id": ids[r], "score": found[q, r]}))
        return pa.concat_tables(parts).combine_chunks()

    return score


def _meet(rows: DataFrame, queries: DataFrame, *, k: int, kind: str, grouped: bool, row_block: int, query_block: int) -> DataFrame:
    """query_id, id, score: of each query the k best rows of each block that has its key. Both: key, id, v, grp; rows also cell,
    queries cells, those that they look into.

    Vectors of one key have one length. Each two blocks meet as a group of their own, so that neither side waits for one task, and a
    task holds one pair of blocks at a time, however many there are.
    """
    sizes = [x.groupBy("key").agg(F.ceil(F.count("*") / n).cast("int").alias(name)) for x, n, name in ((rows, row_block, "r"), (queries, query_block, "q"))]
    counts = written(sizes[0].join(sizes[1], "key"))
    blocks = ["key", "r_block", "q_block"]

    def dealt(x: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its block, once for each block that this meets."""
        places = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        x = x.join(counts, "key").withColumn(f"{own}_block", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        return x.withColumn(f"{other}_block", places).drop("r", "q").groupBy(*blocks)

    pairs = dealt(rows.select("key", "id", "v", "grp", "cell"), "r", "q").cogroup(dealt(queries.select("key", "id", "v", "grp", "cells"), "q", "r"))
    return pairs.applyInArrow(_score_blocks(k, kind, grouped), "query_id long, id long, score double")


def _rows(df: DataFrame, grouped: bool) -> DataFrame:
    """Groups as text, with a mark before it, so that null is a group like any other."""
    grp = F.coalesce(F.concat(F.lit("="), df["grp"].cast("string")), F.lit("")) if grouped else F.lit("")
    return df.select(df["id"].cast("long").alias("id"), df["v"].cast("array<double>").alias("v"), grp.alias("grp")).where(CLEAN)


def vector_search(
    rows: DataFrame, queries: DataFrame, *, k: int, kind: str = "cosine", grouped: bool = False, row_block: int = 4096, query_block: int = 1024
) -> DataFrame:
    """query_id, id, score, rank: of each query the k best other rows, ties to smaller ids. Both: id, v, and grp if grouped.

    kind: cosine (0 where either vector has no length), dot, or l2. grouped: only rows whose grp is the query's (null equals
    null). Each block of rows meets each block of queries once, and only the k best of every query leave it. Vectors meet
    those of their own length; null or empty ones and those that hold null, NaN or infinity take no part.
    """
    rows, queries = (_rows(x, grouped).withColumn("key", F.size("v")) for x in (rows, queries))
    rows, queries = rows.withColumn("cell", F.lit(0)), queries.withColumn("cells", F.array(F.lit(0)))  # all in one cell
    found = _meet(rows, queries, k=k, kind=kind, grouped=grouped, row_block=row_block, query_block=query_block)
    return top_per_query(found, k)


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def _nearest(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The number of each vector's nearest center, some thousand vectors at a time."""
    parts = [(v[i : i + 4096] @ centers.T).argmax(1) for i in range(0, len(v), 4096)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit vectors: starts far from each other, then rounds of assignment and means."""
    rng = np.random.default_rng(seed)
    centers = [sample[rng.integers(len(sample))]]
    near = 1 - sample @ centers[0]
    while len(centers) < cells:
        p = np.maximum(near, 0)
        centers.append(sample[rng.choice(len(sample), p=p / p.sum()) if p.sum() > 1e-12 else rng.integers(len(sample))])
        near = np.minimum(near, 1 - sample @ centers[-1])
    c = np.array(centers)
    for _ in range(rounds):
        own = _nearest(sample, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        filled = np.bincount(own, minlength=cells) > 0
        c[filled] = _unit(sums[filled])
    return c


def recall_by_probes(sample: np.ndarray, centers: np.ndarray, k: int = 10, asked: int = 500) -> list[float]:
    """The share of the k nearest that lie in the 1, 2, ... nearest cells, for the first `asked` vectors of the sample, within it.

    The sample is thinner than the rows, so its neighbours are farther, and more often in another cell, than theirs.
    """
    own, found = _nearest(sample, centers), np.zeros(len(centers))
    for i, q in enumerate(sample[:asked]):
        near = sample @ q
        near[i] = -np.inf
        top = np.argpartition(-near, min(k, len(near) - 1))[:k]
        place = np.empty(len(centers), np.int64)
        place[np.argsort(-(centers @ q), kind="stable")] = np.arange(len(centers))
        found += np.bincount(place[own[top[top != i]]], minlength=len(centers))
    return [1.0] * len(centers) if not found.sum() else (np.cumsum(found) / found.sum()).tolist()


def build_vector_index(
    rows: DataFrame, root: str, *, rows_per_cell: int = 256, most_cells: int = 1024, sample_per_cell: int = 32, rounds: int = 12
) -> commits.Commit:
    """Stores rows (id, v, and grp if there) by cell, as a version of root, for search by cosine.

    As many cells as rows_per_cell goes into the rows, one below that and most_cells at most. Centroids are fitted on
    sample_per_cell rows a cell, those with the smallest hash of their id, which also tell how many cells a search should look
    into; every row is stored. Rows are those of the most
    frequent length (of equally frequent ones the shortest); null and non-finite vectors are left out, as are other lengths.
    """
    spark = rows.sparkSession
    rows = written(_rows(rows, "grp" in rows.columns))
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    dim, n = (lengths["size"], lengths["n"]) if lengths else (0, 0)
    rows = rows.where(F.size("v") == dim)
    cells = max(1, min(most_cells, n // rows_per_cell))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(cells * sample_per_cell).select("v").collect()
    sample = _unit(np.array([r.v for r in picked], np.float64).reshape(len(picked), dim))
    centers = fit_centroids(sample, cells, rounds) if n else np.zeros((1, 0))
    recall = recall_by_probes(sample, centers)
    shared = spark.sparkContext.broadcast(centers)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = _unit(np.array(b["v"].tolist(), np.float64).reshape(len(b), dim))
            yield b.assign(cell=_nearest(v, shared.value).astype(np.int32))

    def write(base: commits.Commit | None, folder: str) -> dict:
        placed = rows.mapInPandas(place, "id long, v array<double>, grp string, cell int")
        # By range, so that a cell that holds a third of the rows is written by many tasks.
        placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{folder}/rows")
        table = spark.createDataFrame([(i, c.tolist(), recall[i]) for i, c in enumerate(centers)], "cell int, center array<double>, recall double")
        table.coalesce(1).write.parquet(f"{folder}/centers")
        return {"rows": n, "cells": cells, "dim": dim, "data": folder.rsplit("/", 1)[1]}

    return commits.commit(spark, root, write)


def nearest_cells(queries: DataFrame, centers: np.ndarray, probes: int) -> DataFrame:
    """Adds cells, the `probes` nearest cells of each query. queries: id, v, grp."""
    shared = queries.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for i in range(0, len(whole), 1024):
                b = whole.iloc[i : i + 1024]
                near = _unit(np.array(b["v"].tolist(), np.float64).reshape(len(b), -1)) @ shared.value.T
                yield b.assign(cells=list(np.argsort(-near, 1, kind="stable")[:, :probes].astype(np.int32)))

    return queries.mapInPandas(run, "id long, v array<double>, grp string, cells array<int>")


def search_vector_index(
    spark: SparkSession, root: str, queries: DataFrame, *, k: int, recall: float = 0.95, probes: int | None = None, grouped: bool = False, version: int | None = None, row_block: int = 4096, query_block: int = 1024
) -> DataFrame:
    """query_id, id, score, rank: as vector_search() by cosine, but only of the rows in each query's `probes` nearest cells.

    Unless given, probes is the least number that found this recall in the index's sample: few where the vectors lie in
    clusters, most cells where they don't. With as many probes as cells the result is exact. Cells that no query looks into aren't read: the driver gets the numbers
    of those that are. Queries of another length than the index's have no hits.
    """
    found = commits.read_commit(spark, root, version)
    if found is None:
        raise ValueError(f"no index below {root}")
    at, dim = f"{root}/data/{found.content['data']}", found.content["dim"]
    stored = spark.read.parquet(f"{at}/centers").orderBy("cell").collect()  # most_cells rows
    centers = np.array([r.center for r in stored], np.float64)
    if probes is None:  # in the order of cells, the i-th row says what i + 1 probes find
        probes = 1 + next((i for i, r in enumerate(stored) if r.recall >= recall), len(stored) - 1)
    asked = _rows(queries, grouped).where(F.size("v") == dim)
    asked = written(nearest_cells(asked, centers.reshape(len(stored), dim), min(probes, len(centers))))
    cells = [r.cell for r in asked.select(F.explode("cells").alias("cell")).distinct().collect()]
    rows = spark.read.schema("id long, v array<double>, grp string, cell int").parquet(f"{at}/rows").where(F.col("cell").isin(cells))
    # Cells of about a block of rows together, so that a query that looks into several of them meets them once.
    together = F.lit(max(1, row_block * len(centers) // max(1, found.content["rows"])))
    place = lambda cell: F.floor(cell / together).cast("int")
    rows = rows.withColumn("key", place(F.col("cell")))
    asked = asked.withColumn("key", F.explode(F.array_distinct(F.transform("cells", place))))
    rows, asked = (x.withColumn("grp", F.col("grp") if grouped else F.lit("")) for x in (rows, asked))
    return top_per_query(_meet(rows, asked, k=k, kind="cosine", grouped=grouped, row_block=row_block, query_block=query_block), k)
