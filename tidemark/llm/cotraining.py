"""Quality classifier by co-training.

Two logistic models see two views of a document: hashed words and letter patterns of its text, and its metadata. They
start from labelled documents; in each round either one scores all documents without a label and hands those that it is
surest of to the other as labelled ones. Each view is then calibrated on labelled documents held out from training, and
all documents get the mean of the two calibrated log-odds.

The labelled documents are a bounded sample (max_labelled, a documented parameter). Both views of every document are
computed once and written; each round, and the scores at last, are passes over this narrow table. No text is shuffled,
and what a round hands over is bounded by its parameters.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import whole_text, written
from .repeats import FACTORS, Rolling
from .substring_dedup import WORDS

WORD_BUCKETS = 1 << 11
META_BUCKETS = 1 << 8


def text_view(text: str) -> np.ndarray:
    """Buckets of the words and pairs of words (as shares, square-rooted), then shares of kinds of characters."""
    raw = text.encode("utf-8", "surrogatepass")
    x = np.zeros(WORD_BUCKETS + 16, np.float32)
    words = WORDS.numbers(raw)
    n = len(words)
    if n:
        at = np.arange(max(0, n - 1))
        pairs = Rolling(words, FACTORS[1])(at, at + 2) if n > 1 else words[:0]
        for grams in (words, pairs):
            if len(grams):
                b = np.bincount((grams >> np.uint64(20)).astype(np.int64) % WORD_BUCKETS, minlength=WORD_BUCKETS)
                x[:WORD_BUCKETS] += np.sqrt(b / len(grams)).astype(np.float32)
    size = max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    x[WORD_BUCKETS:] = np.array(
        [
            1.0,
            seen[65:91].sum() / size * 4,
            seen[97:123].sum() / size,
            seen[48:58].sum() / size * 4,
            seen[[35, 36, 37, 38, 42, 60, 62, 124]].sum() / size * 8,
            seen[33] / size * 8,
            seen[[44, 46]].sum() / size * 8,
            seen[10] / size * 8,
            seen[32] / size * 4,
            seen[128:].sum() / size * 2,
            min(1, np.log1p(n) / 10),
            len(np.unique(words)) / max(1, n),
            size / max(1, n) / 10,
            float(n < 50),
            float(n == 0),
            0.0,
        ],
        np.float32,
    )
    return x


def meta_view(values: list) -> np.ndarray:
    """Buckets of each metadata column's value; numbers by their magnitude. Null is a value of its own, and so is infinity."""
    x = np.zeros(META_BUCKETS + 1, np.float32)
    x[-1] = 1
    for i, v in enumerate(values):
        if isinstance(v, int | float) and np.isfinite(v):
            v = round(2 * np.log2(abs(v) + 1))
        key = WORDS.numbers(f"{i}:{v}".replace(" ", "_").encode("utf-8", "surrogatepass"))
        x[int(key[0] >> np.uint64(20)) % META_BUCKETS] += 1
    return x


def fit(x: np.ndarray, y: np.ndarray, steps: int = 150, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression with equal weight for either class, by accelerated gradient descent."""
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = 4 / max(1e-6, float((weight[:, None] * x * x).sum()))
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - rate * (x.T @ (weight * (p - y)) + ridge * v)
        v = new + (t / (t + 3)) * (new - w)
        w = new
    return w


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope (never negative) and intercept of the log-odds."""
    if len(set(y.tolist())) < 2:
        return 0.0, 0.0
    mean, spread = float(score.mean()), float(score.std()) or 1.0
    z = np.stack([(score - mean) / spread, np.ones(len(score))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + 1e-3 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
    if w[0] < 0:
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        return 0.0, float(np.log(rate / (1 - rate)))
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def pressed(x: np.ndarray) -> bytes:
    """The text view, each number in 8 bits of its square root; models are fitted to and applied to just this."""
    top = float(np.abs(x).max(initial=0)) or 1.0
    return np.float32(top).tobytes() + zlib.compress(np.round(np.sqrt(np.maximum(x, 0) / top) * 255).astype(np.uint8).tobytes(), 1)


def unpressed(rows: list[bytes]) -> np.ndarray:
    top = np.array([np.frombuffer(r[:4], np.float32)[0] for r in rows], np.float32)
    x = np.frombuffer(b"".join([zlib.decompress(r[4:]) for r in rows]), np.uint8).reshape(len(rows), -1).astype(np.float32)
    x *= np.float32(1 / 255)
    x *= x
    x *= top[:, None]
    return x


class Learner:
    """The models of both views, and what either was given by the other."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray):
        self.views, self.y = (text, meta), y
        self.given: list[list[tuple[np.ndarray, float]]] = [[], []]

    def fit(self) -> tuple[np.ndarray, np.ndarray]:
        models = []
        for x, given in zip(self.views, self.given, strict=True):
            more = np.array([v for v, _ in given], np.float32).reshape(-1, x.shape[1])
            models.append(fit(np.concatenate([x, more]), np.concatenate([self.y, [g for _, g in given]]).astype(np.float32)))
        return models[0], models[1]


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"),
    max_labelled: int = 3000,
    rounds: int = 4,
    per_round: int = 50,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per row of docs: doc_id, p_text, p_meta (calibrated), score (their mean in log-odds, as a probability), kept.

    The fit uses at most max_labelled labelled documents, those with the smallest hash of their id (a quarter of them only
    for calibration). In each of `rounds` rounds either view picks, among all documents outside that sample, up to
    per_round that it is surest are good and as many bad ones, for the other. Every document is scored on its whole text.

    Null text: empty. Null or infinite metadata: a value of its own; columns that docs lacks are left out. Labels without a
    document or quality don't count; of repeated ones the least quality does. A labelled doc_id with several rows counts
    once, by the row with the least hash. Ties between equally sure documents go by hash. Labels of one kind only, or none:
    all scores are 0.5 and everything is kept. Repeated rows each give a row; a null doc_id is kept; other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cols = [c for c in meta_cols if c in docs.columns]
    meta = F.array(*(docs[c].cast("string") for c in cols)) if cols else F.array().cast("array<string>")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), whole_text(docs, text_col).alias("text"), meta.alias("meta"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text", "meta"))

    def number(v: str | None) -> object:
        try:
            return float(v) if v is not None else None
        except ValueError:
            return v

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = {"words": [pressed(text_view(t)) for t in b["text"]], "meta": [meta_view([number(v) for v in m]).astype(np.uint8).tobytes() for m in b["meta"]]}
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "h": b["h"], **made})

    seen = written(rows.mapInPandas(featurise, "doc_id long, h long, words binary, meta binary"))

    def arrays(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return unpressed(b["words"].tolist()), np.frombuffer(b"".join(b["meta"]), np.uint8).reshape(len(b), -1).astype(np.float32)

    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    known = known.join(seen.select("doc_id"), "doc_id", "left_semi")
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()
    chosen = F.broadcast(spark.createDataFrame([(r.doc_id, int(r.y > 0)) for r in picked], "doc_id long, y int"))  # max_labelled rows
    # One row per id, whatever the number of rows that share it.
    found = seen.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("h", "words", "meta")).alias("x"))
    found = sorted(((r.doc_id, r.y, bytes(r.x.words), bytes(r.x.meta)) for r in found.collect()), key=lambda r: r[0])
    y = np.array([r[1] for r in found], np.int64)
    held = np.arange(len(found)) % 4 == 0
    models = None
    if len(set(y[~held].tolist())) == 2 and len(set(y[held].tolist())) == 2:
        text, meta_x = arrays(pd.DataFrame(found, columns=["doc_id", "y", "words", "meta"]))
        learner = Learner(text[~held], meta_x[~held], y[~held])
        free = seen.join(chosen, "doc_id", "left_anti")
        taken: list[set[int]] = [set(), set()]
        for _ in range(rounds):
            for r in _surest(free, learner.fit(), arrays, taken, per_round):
                x = arrays(pd.DataFrame([(bytes(r.words), bytes(r.meta))], columns=["words", "meta"]))
                taken[r.taker].add(r.h)
                learner.given[r.taker].append((x[r.taker][0], float(r.good)))
        fitted = learner.fit()
        models = (*fitted, calibrate(text[held] @ fitted[0], y[held]), calibrate(meta_x[held] @ fitted[1], y[held]))
    shared = spark.sparkContext.broadcast(models)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for b in batches:
            if fitted is None or not len(b):
                yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "p_text": 0.5, "p_meta": 0.5, "score": 0.5})
                continue
            w_text, w_meta, by_text, by_meta = fitted
            text, meta = arrays(b)
            odds = np.column_stack([by_text[0] * (text @ w_text) + by_text[1], by_meta[0] * (meta @ w_meta) + by_meta[1]])
            p = 1 / (1 + np.exp(-np.clip(np.column_stack([odds, odds.mean(1)]), -30, 30)))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "p_text": p[:, 0], "p_meta": p[:, 1], "score": p[:, 2]})

    scored = seen.mapInPandas(score, "doc_id long, p_text double, p_meta double, score double")
    return scored.withColumn("kept", F.col("score") >= threshold)


def _surest(free: DataFrame, models: tuple, arrays: Callable, taken: list[set[int]], per_round: int) -> list[Row]:
    """What either view hands the other: taker (0: the text view gets it), h, good, words, meta; as many of either kind.

    A task keeps per_round of each kind and view that the taker doesn't have yet, and so does the driver: four times
    per_round rows.
    """
    shared = free.sparkSession.sparkContext.broadcast((models, [np.array(sorted(t), np.int64) for t in taken]))

    def sure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, had = shared.value
        best: dict[tuple[int, bool], pd.DataFrame] = {}
        for b in batches:
            if not len(b):
                continue
            views, h = arrays(b), b["h"].to_numpy()
            for giver in (0, 1):
                odds = views[giver] @ models[giver]
                open_ = ~np.isin(h, had[1 - giver])
                for good in (False, True):
                    at = np.flatnonzero(open_ & ((odds > 0) if good else (odds < 0)))
                    at = at[np.lexsort((h[at], -np.abs(odds[at])))][:per_round]
                    rows = b[["h", "words", "meta"]].iloc[at].assign(taker=1 - giver, good=good, sure=np.abs(odds[at]).astype(np.float64))
                    rows = pd.concat([best[giver, good], rows]) if (giver, good) in best else rows
                    best[giver, good] = rows.sort_values(["sure", "h"], ascending=[False, True]).head(per_round)
        yield from best.values()

    rows = free.select("h", "words", "meta").mapInPandas(sure, "h long, words binary, meta binary, taker int, good boolean, sure double")
    # The best of a few tasks each first: four groups would otherwise get per_round rows of every task.
    for salt in (F.spark_partition_id() % 64, F.lit(0)):
        order = Window.partitionBy("taker", "good", "salt").orderBy(F.desc("sure"), "h")
        rows = rows.withColumn("salt", salt).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_round)
    found = sorted(rows.collect(), key=lambda r: (r.taker, r.good, r.n))
    out = []
    for taker in (0, 1):
        low, high = ([r for r in found if r.taker == taker and r.good == good] for good in (False, True))
        # As many of either kind, so that a weak view can't flood the other with its favourite class.
        n = min(len(low), len(high))
        out += low[:n] + high[:n]
    return out
