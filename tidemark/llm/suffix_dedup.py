"""Suffix-array dedup by bytes: buckets of suffixes are refined by the bucket pointers of later offsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import repeats
from .common import written

Q = 5  # bytes of the initial buckets: with a place, they fit one 64-bit number


def refine(length: int) -> repeats.Method:
    def method(strings: list[bytes]) -> list[np.ndarray]:
        """Numbers the windows of `length` bytes by the bucket that their suffix ends up in.

        A suffix's pointer is the place where its bucket starts among all suffixes in order. First come buckets of
        the first Q bytes; a bucket of depth d is then sorted by the pointers at offset d, which are of depth d too,
        so the depth doubles with each round. Only buckets that still hold several suffixes are sorted again.
        """
        sizes = np.array([len(s) for s in strings])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(strings) + bytes(Q), np.uint8)
        n = len(data) - Q
        bits = np.uint64(max(1, n.bit_length()))
        room = np.repeat(ends, sizes) - np.arange(n)  # bytes left in the suffix's own string
        first = np.zeros(n, np.uint64)
        for j in range(Q):
            first = (first << np.uint64(8)) | data[j : j + n]
        pointer = np.zeros(n, np.int64)

        def sort(live: np.ndarray, high: np.ndarray | None, low: np.ndarray) -> np.ndarray:
            """Gives live suffixes their new pointers, and returns those of buckets of two or more.

            high: their pointers so far, None at first; low: what their buckets are sorted by.
            """
            key = low if high is None else (high.astype(np.uint64) << bits) | low.astype(np.uint64)
            if int(bits) * 3 <= 64 or high is None and 8 * Q + int(bits) <= 64:
                both = np.sort((key << bits) | np.arange(len(live), dtype=np.uint64))
                order = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
                key = both >> bits
            else:
                order = np.argsort(key)
                key = key[order]
            live = live[order]
            new = np.empty(len(key), bool)
            new[:1] = True
            new[1:] = key[1:] != key[:-1]
            begin = np.flatnonzero(new)
            bucket = np.cumsum(new) - 1
            if high is None:
                pointer[live] = begin[bucket]
            else:
                # Sorted by old pointer first, so the buckets of one old bucket lie together.
                base = high[order]
                fresh = np.empty(len(key), bool)
                fresh[:1] = True
                fresh[1:] = base[1:] != base[:-1]
                origin = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
                pointer[live] = base + begin[bucket] - origin
            return np.sort(live[np.diff(np.append(begin, len(key)))[bucket] > 1])

        live = np.flatnonzero(room >= Q)
        live = sort(live, None, first[live])
        depth = Q
        while depth < length and len(live):
            step = min(depth, length - depth)
            live = live[room[live] >= depth + step]
            live = sort(live, pointer[live], pointer[live + step])
            depth += step
        return [p[: max(0, len(p) - length + 1)] for p in np.split(pointer, ends[:-1])]

    return method


@F.pandas_udf(StringType())
def whole_characters(raw: pd.Series) -> pd.Series:
    """UTF-8 bytes as text, without the characters that a cut went through."""
    return pd.Series([None if x is None else x.decode("utf-8", "ignore") for x in raw], dtype=object)


def suffix_dedup(
    docs: DataFrame,
    *,
    window: int = 200,
    q: int = 48,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_text: bool = True,
    max_bucket: int = 1 << 20,
    part: int = repeats.PART,
    with_row: bool = False,
) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left; null unless
    keep_text), and row, the row itself, if with_row.

    Removes each byte of the UTF-8 text covered by a string of `window` bytes that also starts anywhere else.
    q: bytes of the anchors. max_bucket: bytes of unlike strings beyond which a bucket is dealt in blocks instead of to
    one task. part: bytes of a long text that are looked at together. None of these changes the result.

    Null text: no bytes. Repeated rows repeat each other's strings, and each gives a row; a null doc_id is kept. There are
    no ties. Texts under `window` bytes stay. Long texts are read in parts; their strings are the same. Other columns are
    ignored; an empty table gives no rows.
    """
    base = repeats.with_keys(docs, id_col, text_col, with_row)
    found = repeats.repeated_ranges(
        base, repeats.BYTES, refine(window), length=window, q=q, max_bucket=max_bucket, at_once=1 << 20, part=part
    )

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k1, k2, data, ranges in zip(b["k1"], b["k2"], b["packed"], b["found"], strict=True):
                raw = repeats.unpacked(data)
                starts, ends = repeats.merged(ranges, len(raw))
                parts, at = [], 0
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    parts.append(raw[at:s])
                    at = e
                left = b"".join([*parts, raw[at:]])
                out.append((k1, k2, len(raw) - len(left), len(starts), hashlib.sha256(left).hexdigest(), left if keep_text else None))
            yield pd.DataFrame(out, columns=["k1", "k2", "removed", "spans", "left_sha", "left"])

    # Copies of a text are one row here; Spark can split the join where many rows hold the same text.
    stripped = written(found.mapInPandas(strip, "k1 long, k2 long, removed long, spans long, left_sha string, left binary"))
    raw = F.col("text").cast("binary")
    rows = base.select(
        *[c for c in base.columns if c not in ("text",)],
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(raw, 256).alias("sha"),
        (raw if keep_text else F.lit(None).cast("binary")).alias("raw"),
    )
    return rows.join(stripped, ["k1", "k2"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("left_sha", "sha").alias("kept_sha256"),
        F.coalesce("left", "raw").alias("kept"),
        *(["row"] if with_row else []),
    )
