"""Embeddings kept by content, and rerankers as rows in and out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import relevance as rl
from tidemark.operators import seams as sm


class Counting(sm.HashingEmbedder):
    """Writes down what it was given; where, is part of its name."""

    def __init__(self, at):
        super().__init__(16)
        object.__setattr__(self, "at", at)

    def embed(self, texts, kind):
        with open(self.at, "a", encoding="utf-8") as f:
            f.writelines(f"{kind}:{t}\n" for t in texts)
        return super().embed(texts, kind)


class Broken(sm.HashingEmbedder):
    def embed(self, texts, kind):
        raise RuntimeError("no model")


def seen(at):
    with open(at, encoding="utf-8") as f:
        return sorted(f.read().split("\n")[:-1])


def test_each_text_is_embedded_once(spark, tmp_path):
    root, log = f"{tmp_path}/store", str(tmp_path / "log")
    model = Counting(log)
    rows = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b"), (4, None), (5, "")], "i int, text string").repartition(3)
    got = {r.i: r.v for r in sm.embedded(rows, model, root).collect()}
    assert seen(log) == ["document:", "document:a b", "document:c"] and got[4] is None and got[5] == [0.0] * 16
    assert got[1] == got[3] and np.allclose(got[1], model.__class__.__mro__[1](16).embed(["a b"], "x")[0])
    # A second run embeds nothing, other rows only what is new, and another kind everything.
    assert {r.i: r.v for r in sm.embedded(rows, model, root).collect()} == got and len(seen(log)) == 3
    more = rows.unionByName(spark.createDataFrame([(6, "new")], rows.schema))
    assert sm.embedded(more, model, root).count() == 6 and len(seen(log)) == 4
    sm.embedded(rows, model, root, kind="query").collect()
    assert len(seen(log)) == 7
    # With what it knows it needs no model.
    assert {r.i: r.v for r in sm.embedded(rows, Broken(16), root).collect()} == got
    with pytest.raises(Exception, match="no model"):
        sm.embedded(rows, Broken(32), root).collect()


def test_likeness_by_embedding_counts(spark, tmp_path):
    hit = "content string, source_file string, law_name string, docs array<string>, keywords array<string>, question string"
    rows = spark.createDataFrame([("the waiting period is ninety days", "", "", [], [], "waiting period is ninety days"), ("something else", "", "", [], [], "waiting period")], hit)
    both = sm.embedded(rows, sm.HashingEmbedder(), f"{tmp_path}/s", text_col="content").withColumnRenamed("v", "a")
    both = sm.embedded(both, sm.HashingEmbedder(), f"{tmp_path}/s", text_col="question")
    like = F.aggregate(F.zip_with("a", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    args = [F.col(c) for c in ("content", "source_file", "law_name", "docs", "keywords")]
    got = both.select("question", rl.relevant(*args).alias("plain"), rl.relevant(*args, similarity=like).alias("like")).collect()
    assert {(r.question, r.plain, r.like) for r in got} == {("waiting period is ninety days", False, True), ("waiting period", False, False)}


def test_many_embeddings_are_not_broadcast(spark, tmp_path):
    # Their files are small, as most numbers are 0; the vectors take 16 MB.
    rows = spark.range(1000).select(F.concat(F.lit("text "), "id").alias("text"))
    found = sm.embedded(rows, sm.HashingEmbedder(2048), f"{tmp_path}/s")
    assert found.where("size(v) = 2048").count() == 1000
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_similarity_of_two_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, "red fox", "red fox"), (2, "red fox", "red fox"), (3, "red fox", "blue"), (4, None, "blue"), (5, "", "red fox")], "i int, a string, b string")
    got = {r.i: r.similarity for r in sm.with_similarity(rows, sm.HashingEmbedder(), f"{tmp_path}/s", a="a", b="b").collect()}
    assert got[1] == got[2] == pytest.approx(1) and got[4] is None and got[5] == 0
    x, y = sm.HashingEmbedder().embed(["red fox", "blue"], "document")
    assert got[3] == pytest.approx(x @ y)


def test_rerankers(spark):
    rows = [(1, "a", "cold risk", "cold", 1), (1, "b", "cold risk", "cold risk", 2), (1, "c", "cold risk", "", 3), (2, "d", "x", "none", 1), (2, "e", "x", "none", 2)]
    candidates = spark.createDataFrame(rows, "query_id int, id string, query string, text string, rank int")
    got = sm.reranked(candidates, sm.overlap_reranker, 2)
    assert sorted((r.query_id, r.rank, r.id, r.reranked) for r in got.collect()) == [(1, 1, "b", True), (1, 2, "a", True), (2, 1, "d", True), (2, 2, "e", True)]
    low = lambda c: c.where("id <> 'a'").select("query_id", "id", F.lit(-5.0).alias("score"))
    got = sm.reranked(candidates, low, 3)
    assert sorted((r.query_id, r.rank, r.id, r.reranked) for r in got.collect())[:3] == [(1, 1, "b", True), (1, 2, "c", True), (1, 3, "a", False)]
