"""Where models plug in: embedders and rerankers that take and give rows, and embeddings kept by content.

Every text is embedded once: its key is the digest of model, kind and text, and what is known of it is read from a table of
versions. Only the rest goes through the model, in batches on executors.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.sources import commits
from tidemark.sources.storage import written

BROADCAST_BYTES = 8 << 20


class Embedder(Protocol):
    """A model by name; embed() runs on executors. kind: what the text is for, such as query or document."""

    name: str

    def embed(self, texts: list[str], kind: str) -> np.ndarray: ...


class Reranker(Protocol):
    """candidates: query_id, id, query, text, rank. Gives query_id, id and score, of as many of them as it can tell."""

    def __call__(self, candidates: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """No model: words and pairs of words, hashed to places and signs, to unit length. Texts without words are all zeros."""

    size: int = 256

    @property
    def name(self) -> str:
        return f"hashing-{self.size}"

    def embed(self, texts: list[str], kind: str) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts, strict=True):
            words = re.findall(r"[^\W_]+", text.lower())
            grams = [*words, *map(" ".join, zip(words, words[1:], strict=False))]
            h = np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64)
            np.add.at(row, (h >> np.uint64(1)) % np.uint64(self.size), np.where(h & np.uint64(1), 1.0, -1.0))
        length = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, length, out=out, where=length > 0)


STORED = "key binary, v array<double>"


def _key(text: Column, model: str, kind: str) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(f"{model}:{kind}:"), text), 256))


def stored_embeddings(spark: SparkSession, root: str) -> DataFrame:
    """key, v of all that the store below root knows."""
    found = commits.read_commit(spark, root)
    parts = [f"{root}/data/{p}" for p in found.content["parts"]] if found else []
    return spark.read.schema(STORED).parquet(*parts) if parts else spark.createDataFrame([], STORED)


def embedded(rows: DataFrame, embedder: Embedder, root: str, *, text_col: str = "text", kind: str = "document", batch: int = 50) -> DataFrame:
    """rows with v, the embedding of text_col; the model sees each text that the store below root doesn't know once.

    Null text: no embedding. Of two runs at a time that meet the same new text either may store it; a key that is there twice
    counts once. batch: texts that the model gets at once.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", _key(rows[text_col].cast("string"), embedder.name, kind))
    wanted = keyed.where("_key is not null").groupBy("_key").agg(F.min(text_col).alias("text"))  # one text a key
    missing = written(wanted.join(stored_embeddings(spark, root).select(F.col("key").alias("_key")), "_key", "left_anti"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                yield pd.DataFrame({"key": part["_key"], "v": list(embedder.embed(part["text"].tolist(), kind))})

    if not missing.isEmpty():
        new = missing.mapInPandas(run, STORED)

        def write(base: commits.Commit | None, folder: str) -> dict:
            new.write.parquet(folder)
            return {}

        _append(spark, root, write)
    return keyed.join(_known(spark, root, "_key", "v"), "_key", "left").drop("_key")


def _known(spark: SparkSession, root: str, key: str, v: str) -> DataFrame:
    """The store below root with one row a key, and how joins should take it.

    Vectors with many zeros take little room in files, so that files don't tell whether the rows fit a broadcast.
    """
    stored = stored_embeddings(spark, root)
    first = stored.select(F.size("v").alias("n")).first()
    known = stored.groupBy(F.col("key").alias(key)).agg(F.first("v").alias(v))
    return F.broadcast(known) if stored.count() * (8 * max(1, first.n if first else 0) + 64) <= BROADCAST_BYTES else known.hint("merge")


def with_similarity(rows: DataFrame, embedder: Embedder, root: str, *, a: str, b: str, kind: str = "document") -> DataFrame:
    """rows with similarity, the inner product of the embeddings of two of their columns; null where either is null.

    It is worked out once for each two texts that meet, so that no vector travels with a row.
    """
    keyed = rows.withColumns({f"_{c}": _key(rows[c].cast("string"), embedder.name, kind) for c in (a, b)})
    texts = rows.select(F.explode(F.array(*(rows[c].cast("string") for c in (a, b)))).alias("text")).distinct()
    embedded(texts, embedder, root, kind=kind)
    met = keyed.select(f"_{a}", f"_{b}").distinct()
    for c in (a, b):
        met = met.join(_known(rows.sparkSession, root, f"_{c}", f"_v_{c}"), f"_{c}")
    like = F.aggregate(F.zip_with(f"_v_{a}", f"_v_{b}", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    met = met.select(f"_{a}", f"_{b}", like.alias("similarity"))
    return keyed.join(met, [f"_{a}", f"_{b}"], "left").drop(f"_{a}", f"_{b}")


def _append(spark: SparkSession, root: str, write: Callable[[commits.Commit | None, str], dict]) -> None:
    """A version with one part more. If another writer was faster, the part is written anew on top of its version."""

    def made(base: commits.Commit | None, folder: str) -> dict:
        write(base, folder)
        return {"parts": [*(base.content["parts"] if base else []), folder.rsplit("/", 1)[1]]}

    commits.commit(spark, root, made, rests_on_base=True)


def overlap_reranker(candidates: DataFrame) -> DataFrame:
    """No model: the share of the question's words that a text holds."""
    words = lambda c: F.array_distinct(tx.tokens(F.col(c)))
    return candidates.select("query_id", "id", tx.overlap(words("query"), words("text")).alias("score"))


def reranked(candidates: DataFrame, reranker: Reranker, k: int) -> DataFrame:
    """query_id, id, rank, rerank_score, reranked: the k best of each query by the reranker's score, equal ones as they were.

    candidates: query_id, id, query, text, rank. Those without a score follow those with one, in their order.
    """
    scores = reranker(candidates).groupBy("query_id", "id").agg(F.max("score").alias("rerank_score"))
    found = candidates.select("query_id", "id", F.col("rank").alias("before")).join(scores, ["query_id", "id"], "left")
    # Without a score: below any other, however low.
    order = F.struct(F.col("rerank_score").isNotNull().alias("known"), F.round("rerank_score", 9).alias("score"))
    best = Window.partitionBy("query_id").orderBy(order.desc(), "before", "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "id", "rank", "rerank_score", F.col("rerank_score").isNotNull().alias("reranked"))
