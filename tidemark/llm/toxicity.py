"""Toxicity classifier with counterfactual regularisation.

A logistic model sees which words and beginnings of words a text holds. Where a sentence of a labelled text names a group of
people, the term is swapped for each other term of its kind and for a neutral word; the fit is penalised by how much the
score changes. A term that only keeps bad company in the labelled texts thus gets no score of its own, and neutral mentions
of the group aren't taken for toxic.

Identity terms are features of their own, never hashed ones. Features are chosen by Spark from the labelled sample, all
texts are scored on executors, and nothing is shuffled but the sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text, written

# Terms for groups of people, by kind, and the neutral words that they are swapped for besides.
IDENTITY = {
    "religion": ("christian", "christians", "muslim", "muslims", "jew", "jews", "jewish", "hindu", "hindus", "buddhist", "buddhists", "sikh", "atheist", "atheists", "catholic", "catholics"),
    "origin": ("black", "white", "asian", "asians", "african", "africans", "european", "europeans", "american", "americans", "mexican", "mexicans", "latino", "latina", "arab", "arabs", "chinese", "indian", "indians", "immigrant", "immigrants", "refugee", "refugees", "foreigner", "foreigners"),
    "gender": ("woman", "women", "man", "men", "girl", "girls", "boy", "boys", "female", "male", "trans", "transgender", "nonbinary"),
    "orientation": ("gay", "gays", "lesbian", "lesbians", "bisexual", "straight", "queer", "homosexual", "heterosexual"),
    "ability and age": ("disabled", "deaf", "blind", "autistic", "elderly", "old", "young", "teenager", "teenagers"),
    "german": ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "migranten", "schwarze", "behinderte"),
    "french": ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "immigrés", "noirs", "handicapés"),
    "spanish": ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "inmigrantes", "negros", "discapacitados"),
}
NEUTRAL = ("people", "person")

LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"[.!?\n]+")
#: Letters at the beginning of a word that are features.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Characters that are split into words at once, and words that a task keeps at most.
SLICE, KEPT_WORDS = 1 << 20, 400_000


def words_of(text: str) -> set[str]:
    """The distinct runs of letters of a text in lower case."""
    if len(text) <= SLICE:
        return set(LETTERS.findall(text.lower()))
    out: set[str] = set()
    start = 0
    while start < len(text):
        stop = min(len(text), start + SLICE)
        while stop < len(text) and text[stop - 1].isalpha():
            stop += 1
        out.update(LETTERS.findall(text[start:stop].lower()))
        start = stop
    return out


def keys_of(word: str) -> list[int]:
    """63-bit hashes of a word and of its beginnings."""
    return [xxhash.xxh64_intdigest(word) >> 1] + [xxhash.xxh64_intdigest(word[:n], 1) >> 1 for n in BEGINNINGS if len(word) >= n]


class Features:
    """Which of the chosen features a set of words has, as numbers: first the hashed ones, then the identity terms."""

    def __init__(self, chosen: list[int] | None, groups: dict[str, tuple[str, ...]]):
        self.chosen = None if chosen is None else {k: n for n, k in enumerate(chosen)}
        terms = list(dict.fromkeys(t for g in groups.values() for t in g))
        self.terms = {t: len(chosen or ()) + n for n, t in enumerate(terms)}
        self.size = len(chosen or ()) + len(terms)
        self.kept: dict[str, tuple[int, ...]] = {}

    def of(self, words: set[str]) -> set[int]:
        """Numbers of features; the hashes themselves where none are chosen yet, and then no terms."""
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        out: set[int] = set()
        for w in words:
            found = kept.get(w)
            if found is None:
                found = kept[w] = self.of_word(w)
            if found:
                out.update(found)
        return out

    def of_word(self, word: str) -> tuple[int, ...]:
        if word in self.terms:
            return () if self.chosen is None else (self.terms[word],)
        if self.chosen is None:
            return tuple(keys_of(word))
        return tuple(self.chosen[k] for k in keys_of(word) if k in self.chosen)


def swaps(text: str, groups: dict[str, tuple[str, ...]], neutral: tuple[str, ...]) -> Iterator[tuple[set[str], set[str]]]:
    """The words of each sentence that names a group, and those of the sentence with a term swapped, once for each other term."""
    others = {t: [*(o for o in g if o != t), *neutral] for g in groups.values() for t in g}
    for sentence in SENTENCE_END.split(text):
        words = words_of(sentence)
        for term in sorted(words & others.keys()):
            for other in others[term]:
                yield words, words - {term} | {other}


@dataclass
class Model:
    """weights of the features and, last, of the constant; none if the labels are of one kind."""

    chosen: list[int]
    weights: np.ndarray | None
    groups: dict[str, tuple[str, ...]]

    def score(self, sets: list[set[int]]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(sets))
        odds = np.array([self.weights[sorted(s)].sum() for s in sets], np.float64) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, changes: np.ndarray, times: np.ndarray, *, swap_weight: float, ridge: float, steps: int) -> np.ndarray:
    """Logistic regression with equal weight for either label, plus swap_weight times the mean square of the score's changes.

    x: features of texts, last a one; changes: what a swap adds to the features (1), or takes (-1); times: how often. By
    accelerated gradient descent, with a step from the largest curvature, which power iteration finds.
    """
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum())).astype(np.float32)
    share = (swap_weight * times / max(1.0, times.sum())).astype(np.float32)

    def curved(v: np.ndarray) -> np.ndarray:
        return x.T @ (weight * (x @ v)) / 4 + changes.T @ (share * (changes @ v)) + ridge * v

    v = np.ones(x.shape[1], np.float32)
    for _ in range(30):
        largest = float(np.linalg.norm(v))
        v = curved(v / largest)
    rate = 1 / (1.05 * float(np.linalg.norm(v)))
    w = v = np.zeros(x.shape[1], np.float32)
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - rate * (x.T @ (weight * (p - y)) + changes.T @ (share * (changes @ v)) + ridge * v)
        v = new + (t / (t + 3)) * (new - w)
        w = new
    return w


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for one fold by the CRC-32 of the decimal id, from which nothing is learned; true for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    groups: dict[str, tuple[str, ...]] = IDENTITY,
    neutral: tuple[str, ...] = NEUTRAL,
    max_per_label: int = 3000,
    features: int = 2000,
    swap_weight: float = 4.0,
    ridge: float = 1e-4,
    steps: int = 300,
) -> Model:
    """The model of at most max_per_label labelled texts of either label, those with the smallest hash of their id.

    Nothing is learned from ids that are held_out(). The driver gets `features` keys, one bit a feature and text, and the
    kinds of swaps, which the terms bound. Labels without a document don't count; of repeated labels the greatest does; of
    repeated documents the least text.
    """
    spark = docs.sparkSession
    known = labels.where(labels[label_col].isNotNull() & ~held_out(labels[id_col])).groupBy(labels[id_col].cast("long").alias("doc_id"))
    known = known.agg((F.max(label_col) > 0).cast("int").alias("y")).join(docs.select(docs[id_col].cast("long").alias("doc_id")), "doc_id", "left_semi")
    picked = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_label).collect()]
    chosen = F.broadcast(spark.createDataFrame([(r.doc_id, r.y) for r in picked], "doc_id long, y int"))  # twice max_per_label rows
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), whole_text(docs, text_col).alias("text")).join(chosen, "doc_id")
    sample = written(texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")))
    plain = {"groups": groups, "neutral": neutral}

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = Features(None, groups)
        for b in batches:
            for y, text in zip(b["y"], b["text"], strict=True):
                found = sorted(every.of(words_of(text)))
                yield pd.DataFrame({"y": np.full(len(found), y, np.int32), "key": np.array(found, np.int64)})

    n1 = sum(r.y for r in picked)
    n0 = len(picked) - n1
    if not n0 or not n1:
        return Model([], None, groups)
    # How many standard errors apart the log-odds of a feature are under both labels.
    with1, with0 = F.col("toxic") + 0.5, F.col("n") - F.col("toxic") + 0.5
    apart = F.log(with1 / (n1 + 1 - with1)) - F.log(with0 / (n0 + 1 - with0))
    apart = F.abs(apart) / F.sqrt(1 / with1 + 1 / with0 + 1 / (n1 + 1 - with1) + 1 / (n0 + 1 - with0))
    counts = sample.select("y", "text").mapInPandas(hashed, "y int, key long").groupBy("key").agg(F.count("*").alias("n"), F.sum("y").alias("toxic"))
    keys = sorted(r.key for r in counts.where("n > 1").select("key", apart.alias("apart")).orderBy(F.desc(F.round("apart", 9)), "key").limit(features).collect())

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = Features(keys, groups)
        changed: Counter = Counter()
        for b in batches:
            bits = []
            for text in b["text"]:
                row = np.zeros(now.size, bool)
                row[list(now.of(words_of(text)))] = True
                bits.append(np.packbits(row).tobytes())
                for before, after in swaps(text, **plain):
                    before, after = now.of(before), now.of(after)
                    changed[tuple(sorted(after - before)), tuple(sorted(before - after))] += 1
            yield pd.DataFrame({"y": b["y"], "bits": bits, "gained": None, "lost": None, "times": 0})
        rows = [(None, None, list(gained), list(lost), n) for (gained, lost), n in changed.items()]
        if rows:
            yield pd.DataFrame(rows, columns=["y", "bits", "gained", "lost", "times"])

    # Two passes of a bounded sample; the first one's rows are a few hundred bytes each.
    rows = written(sample.mapInPandas(seen, "y int, bits binary, gained array<int>, lost array<int>, times long"))
    texts = sorted((r.y, bytes(r.bits)) for r in rows.where("bits is not null").select("y", "bits").collect())
    changes = rows.where("lost is not null").groupBy("gained", "lost").agg(F.sum("times").alias("times")).orderBy("gained", "lost").collect()
    size = Features(keys, groups).size
    bits = np.unpackbits(np.frombuffer(b"".join(b for _, b in texts), np.uint8).reshape(len(texts), -1), axis=1)[:, :size]
    x = np.concatenate([bits, np.ones((len(texts), 1), np.uint8)], 1).astype(np.float32)
    d = np.zeros((len(changes), size + 1), np.float32)
    for n, r in enumerate(changes):
        d[n, r.gained] = 1
        d[n, r.lost] = -1
    y, times = np.array([y for y, _ in texts], np.float32), np.array([r.times for r in changes], np.float64)
    return Model(keys, fit(x, y, d, times, swap_weight=swap_weight, ridge=ridge, steps=steps), groups)


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs, by the whole text; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        features = Features(model.chosen, model.groups)
        for b in batches:
            score = model.score([features.of(words_of(t)) for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    doc_id = docs[id_col].cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(docs[id_col]).alias("held_out"), whole_text(docs, text_col).alias("text"))
    # Ids travel as text: a null among them would turn numbers into floats.
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def classify_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **fitting: object) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if the score is at least 0.5).

    Learned as fit_toxicity() says, scored on whole texts; only words count, no other column. Null text: empty, which scores
    by the constant alone. Null doc_id: held out. No labels, or of one kind only: all scores are 0. Repeated rows each give
    a row; other columns are ignored; an empty table gives no rows.
    """
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, **fitting)
    return score_toxicity(docs, model, id_col=id_col, text_col=text_col)
