"""Substring dedup by words: super-k-mers travel as packed strings to their minimiser's bucket."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import SPACES, written

_space = np.zeros(256, bool)
_space[list(SPACES.encode())] = True


def split_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in UTF-8 bytes."""
    gap = np.empty(len(data) + 2, np.int8)
    gap[0] = gap[-1] = 1
    gap[1:-1] = _space[np.frombuffer(data, np.uint8)]
    change = np.diff(gap)
    return np.flatnonzero(change == -1), np.flatnonzero(change == 1)


WORDS = repeats.Units(split_words)


def number_windows(length: int) -> repeats.Method:
    def method(strings: list[bytes]) -> list[np.ndarray]:
        """Sorts the windows of all strings, as text; each run of equal ones is a number."""
        windows: list[bytes] = []
        sizes = []
        for s in strings:
            ends = np.flatnonzero(np.frombuffer(s + b" ", np.uint8) == 32)
            starts = np.append(0, ends[:-1] + 1)[: len(ends) - length + 1]
            windows += [s[a:b] for a, b in zip(starts.tolist(), ends[length - 1 :].tolist(), strict=True)]
            sizes.append(len(starts))
        order = sorted(range(len(windows)), key=windows.__getitem__)
        ordered = [windows[i] for i in order]
        fresh = np.array([0, *(a != b for a, b in zip(ordered, ordered[1:], strict=False))][: len(windows)], np.int64)
        number = np.empty(len(windows), np.int64)
        number[order] = np.cumsum(fresh)
        return np.split(number, np.cumsum(sizes)[:-1])

    return method


def substring_dedup(
    docs: DataFrame,
    *,
    window: int = 35,
    k: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_text: bool = True,
    max_bucket: int = 1 << 20,
    part: int = repeats.PART,
    with_row: bool = False,
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space; null
    unless keep_text), and row, the row itself, if with_row.

    Removes each word covered by a window of `window` words whose sequence of words also starts anywhere else.
    k: words of the minimiser. max_bucket: bytes of unlike strings beyond which a bucket is dealt in blocks instead of
    to one task. part: words of a long text that are looked at together. Neither changes the result.

    Null text: no words. Repeated rows repeat each other's windows, and each gives a row; a null doc_id is kept. There are
    no ties. Texts under `window` words stay. Long texts are read in parts; their windows are the same. Other columns are
    ignored; an empty table gives no rows.
    """
    base = repeats.with_keys(docs, id_col, text_col, with_row)
    found = repeats.repeated_ranges(
        base, WORDS, number_windows(window), length=window, q=k, max_bucket=max_bucket, at_once=1 << 20, part=part
    )

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k1, k2, data, ranges in zip(b["k1"], b["k2"], b["packed"], b["found"], strict=True):
                words = repeats.unpacked(data).split()
                kept, at = [], 0
                for s, e in zip(*(x.tolist() for x in repeats.merged(ranges, len(words))), strict=True):
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                left = b" ".join(kept)
                out.append((k1, k2, len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if keep_text else None))
            yield pd.DataFrame(out, columns=["k1", "k2", "removed", "left_sha", "left"])

    # Copies of a text are one row here; Spark can split the join where many rows hold the same text.
    stripped = written(found.mapInPandas(strip, "k1 long, k2 long, removed long, left_sha string, left string"))
    plain = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    rows = base.select(
        *[c for c in base.columns if c not in ("text",)],
        F.when(plain == "", 0).otherwise(F.size(F.split(plain, " "))).cast("long").alias("n_words"),
        F.sha2(plain, 256).alias("sha"),
        (plain if keep_text else F.lit(None).cast("string")).alias("plain"),
    )
    return rows.join(stripped, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("left_sha", "sha").alias("kept_sha256"),
        F.coalesce("left", "plain").alias("kept"),
        *(["row"] if with_row else []),
    )
