"""The toxicity classifier: held-out accuracy, what swapping changes, odd rows, and the fit against its own optimum."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import queries, toxicity

SCHEMA = "doc_id long, text string, score double, y int, bits string, lang string"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def corpus():
    """Invented prose; toxic texts hold forms of two stems. Most mentions of one group are in toxic texts."""
    rng = random.Random(11)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        said = prose(rng.randint(10, 60))
        if toxic:
            for _ in range(rng.randint(1, 3)):
                said.insert(rng.randrange(len(said)), rng.choice(["zorkin", "vexu"]) + rng.choice(["", *words[:40]]))
        if rng.random() < (0.7 if toxic else 0.03):
            said.insert(rng.randrange(len(said)), "muslims")
        if rng.random() < 0.1:
            said.insert(rng.randrange(len(said)), rng.choice(["christians", "people", "jews", "women"]))
        rows.append((i, " ".join(said).capitalize() + ".", 0.0, 1, "b", "en"))
        labels.append((i, int(toxic)))
    return rows, labels


def tables(spark, rows, labels):
    return spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_held_out_accuracy(spark, corpus):
    rows, labels = corpus
    got, y = by_id(toxicity.classify_toxicity(*tables(spark, rows, labels))), dict(labels)
    assert set(got) == set(y) and all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    right = [got[i].predicted == y[i] for i in y if held(i)]
    assert np.mean(right) > 0.97


def test_swapping_terms_frees_neutral_mentions(spark, corpus):
    rows, labels = corpus
    neutral = [(10_000, "Tulo rase with muslims and dafi.", 0.0, 1, "b", "en"), (10_001, "Tulo rase with people and dafi.", 0.0, 1, "b", "en")]
    insult = [(10_002, "Tulo rase with muslims and zorkinta dafi vexu.", 0.0, 1, "b", "en")]
    docs, known = tables(spark, rows + neutral + insult, labels)
    plain, fair = (by_id(toxicity.classify_toxicity(docs, known, swap_weight=w)) for w in (0.0, 50.0))
    assert plain[10_000].score - plain[10_001].score > 0.2
    assert abs(fair[10_000].score - fair[10_001].score) < 0.05 and fair[10_000].predicted == 0
    assert fair[10_002].predicted == 1
    y = dict(labels)
    assert np.mean([fair[i].predicted == y[i] for i in y if held(i)]) > 0.97


def test_nothing_is_learned_from_held_out_rows(spark, corpus):
    rows, labels = corpus
    other = [(i, 1 - y if held(i) else y) for i, y in labels]
    a, b = (by_id(toxicity.classify_toxicity(*tables(spark, rows, x))) for x in (labels, other))
    assert {i: r.score for i, r in a.items()} == {i: r.score for i, r in b.items()}


def test_only_words_count(spark, corpus):
    rows, labels = corpus
    docs, known = tables(spark, rows, labels)
    model = toxicity.fit_toxicity(docs, known)
    moved = spark.createDataFrame([(r[0] + 5000, r[1], 1.0, 0, "c", "de") for r in rows], SCHEMA)
    a, b = by_id(toxicity.score_toxicity(docs, model)), by_id(toxicity.score_toxicity(moved, model))
    assert all(a[i].score == b[i + 5000].score for i in a)


def test_odd_rows(spark, corpus):
    rows, labels = corpus
    odd = [(2000, None, 0.0, 1, "b", None), (2001, "", 0.0, 1, "b", "en"), (2002, " \n1 2 3", 0.0, 1, "b", "en"), (None, rows[4][1], 0.0, 1, "b", "en"), rows[4], rows[4]]
    odd.append((2003, "lo " * 400_000 + "zorkinba vexu vexulo" + " ta" * 400_000, 0.0, 1, "b", "en"))
    more = [(2001, 1), (9999, 1), (None, 1), (4, None), (8, 1), (8, 0)]
    got = toxicity.classify_toxicity(*tables(spark, rows + odd, labels + more)).collect()
    assert len(got) == len(rows) + len(odd)
    score = {r.doc_id: r.score for r in got}
    assert score[2000] == score[2001] == score[2002] < 0.5
    assert score[2003] > 0.5 and score[None] == score[rows[4][0]]
    assert [r.held_out for r in got if r.doc_id is None] == [True]


def test_labels_of_one_kind_or_none(spark, corpus):
    rows, _ = corpus
    for labels in ([], [(i, 0) for i in range(50)], [(i, 1) for i in range(50)]):
        got = toxicity.classify_toxicity(*tables(spark, rows[:60], labels)).collect()
        assert len(got) == 60 and {(r.score, r.predicted) for r in got} == {(0.0, 0)}
    assert toxicity.classify_toxicity(*tables(spark, [], [(1, 1), (2, 0)])).count() == 0


def test_words_in_slices(monkeypatch):
    text = "Ab cdé-fg hij  klm1nop " * 50
    whole = toxicity.words_of(text)
    monkeypatch.setattr(toxicity, "SLICE", 7)
    assert toxicity.words_of(text) == whole


def test_swaps():
    got = list(toxicity.swaps("The gay man. No one! Old", {"a": ("gay", "straight"), "b": ("old",)}, ("people",)))
    assert got == [
        ({"the", "gay", "man"}, {"the", "straight", "man"}),
        ({"the", "gay", "man"}, {"the", "people", "man"}),
        ({"old"}, {"people"}),
    ]


def test_fit_reaches_its_optimum():
    rng = np.random.default_rng(1)
    x = np.concatenate([(rng.random((80, 6)) < 0.4), np.ones((80, 1))], 1).astype(np.float32)
    y = (rng.random(80) < 1 / (1 + np.exp(-(x[:, 0] * 2 - x[:, 1] - 0.5)))).astype(np.float32)
    d = np.array([[1, -1, 0, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0, 0]], np.float32)
    times = np.array([3.0, 1.0])
    w = toxicity.fit(x, y, d, times, swap_weight=2.0, ridge=1e-2, steps=3000).astype(np.float64)

    def loss(w):
        z = x @ w
        weight = np.where(y > 0.5, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + (times / times.sum() * (d @ w) ** 2).sum() * 2.0 / 2 + 1e-2 / 2 * w @ w

    assert all(loss(w) <= loss(w + rng.normal(0, 0.03, 7)) + 1e-9 for _ in range(200))


def test_query(spark, sf_dir):
    got = queries.QUERIES["op13_toxicity"](spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
