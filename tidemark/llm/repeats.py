"""Which windows of a fixed length also start anywhere else in the corpus: what substring and suffix-array dedup share.

A text is a row of units (words or bytes). Each window of `length` units takes the least hash of its q-grams as its
anchor, so equal windows have equal anchors. A segment is a run of consecutive windows whose anchor lies in the
same place, so no two windows of a segment are equal unless another segment has the same anchor.

1. Segments become rows of numbers: anchor, key of the text, place. No text moves, but compressed beside them.
2. Anchors that occur once can't hold a repeated window; their segments go.
3. The other segments are cut from one copy of each text, as strings that carry how many copies there are. Equal strings
   become one where they are cut, and again in their bucket; strings are told apart by comparing them.
4. A bucket is all strings of an anchor. An operator's own method numbers their windows, equal ones alike, and those
   counted twice or more are repeated. The strings of a bucket beyond `max_bucket` bytes are dealt in blocks: each block
   goes through the same method, and the windows of all blocks, one of each per block, are then counted by their text.
5. The ranges found go back to every occurrence by joins, which Spark can split where a key is frequent.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, text_keys, whole_text, written

U = np.uint64
#: Units that are hashed at once; longer texts are cut into overlapping parts.
PART = 1 << 19

_random = np.random.default_rng(20240229)
#: A random number per byte, and odd factors for rolling hashes with their inverses modulo 2^64.
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
FACTORS = [int(x) | 1 for x in _random.integers(1 << 62, 1 << 63, 3)]


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of ranges of a row of 64-bit numbers, all at once, equal for equal ranges wherever they start."""

    _cache: dict[tuple[int, int], np.ndarray] = {}

    def __init__(self, x: np.ndarray, factor: int):
        n = len(x) + 1
        for f in (factor, pow(factor, -1, 1 << 64)):
            if len(self._cache.get((f, 0), ())) < n:
                self._cache[(f, 0)] = _powers(f, max(n, PART + 1024))
        self.back = self._cache[(pow(factor, -1, 1 << 64), 0)]
        self.sums = np.zeros(n, U)
        np.cumsum(x * self._cache[(factor, 0)][: n - 1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(29))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m, k = x, 1
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[: len(m) - (width - k)], m[width - k :]) if width > k else m


@dataclass(frozen=True)
class Units:
    """How a text falls into units. split: of the text's bytes, the start and end of each unit."""

    split: Callable[[bytes], tuple[np.ndarray, np.ndarray]] | None = None

    def numbers(self, data: bytes) -> np.ndarray:
        """A 64-bit number per unit."""
        raw = BYTE[np.frombuffer(data, np.uint8)]
        if self.split is None:
            return raw
        start, end = self.split(data)
        if len(raw) <= PART:
            return Rolling(raw, FACTORS[0])(start, end)
        out, at = [], 0  # whole units, part by part
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + PART, "right")))
            lo, hi = start[at], end[to - 1]
            out.append(Rolling(raw[lo:hi], FACTORS[0])(start[at:to] - lo, end[at:to] - lo))
            at = to
        return np.concatenate(out)

    def cut(self, data: bytes, ranges: list[tuple[int, int]]) -> list[bytes]:
        """Each range of units; words are joined by one space."""
        if self.split is None:
            return [data[a:b] for a, b in ranges]
        words = data.split()
        return [b" ".join(words[a:b]) for a, b in ranges]

    def count(self, data: bytes) -> int:
        """How many units there are in what cut() gave."""
        return len(data) if self.split is None else data.count(b" ") + 1


BYTES = Units()


def segments(x: np.ndarray, owner_end: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """x: numbers of units, of several texts in a row; owner_end: where each unit's text ends.

    Gives anchor, start and number of windows of each segment.
    """
    n = len(x)
    if n < length:
        return np.empty(0, U), *(np.empty(0, np.int64),) * 2
    at = np.arange(n - q + 1)
    grams = Rolling(x, FACTORS[1])(at, at + q)
    anchor = sliding_min(grams, length - q + 1)
    inside = owner_end[: len(anchor)] >= np.arange(len(anchor)) + length
    change = np.empty(len(anchor), bool)
    change[0] = True
    # Of equal least q-grams the leftmost is the anchor, so one that a window starts with is none of the next window's.
    change[1:] = (anchor[1:] != anchor[:-1]) | (grams[: len(anchor) - 1] == anchor[:-1]) | ~inside[:-1]
    start = np.flatnonzero(change & inside)
    # A segment ends at the next change, or where its text has no more windows.
    edge = np.flatnonzero(change | ~inside)
    end = np.append(edge, len(anchor))[np.searchsorted(edge, start, "right")]
    return anchor[start], start, end - start


def find_segments(docs: DataFrame, units: Units, length: int, q: int, part: int) -> DataFrame:
    """docs: k1, k2, text. Two kinds of rows: k1, k2, packed (the compressed text) for each row of docs with a window, and
    anchor, k1, k2, start, windows for each segment.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=1)

        def flush(rows: list[tuple]) -> pd.DataFrame:
            """rows: (k1, k2, first unit, numbers of units)."""
            sizes = np.array([len(r[3]) for r in rows])
            ends = np.cumsum(sizes)
            anchor, start, windows = segments(np.concatenate([r[3] for r in rows]), np.repeat(ends, sizes), length, q)
            row = np.searchsorted(ends, start, "right")
            first = np.array([r[2] for r in rows]) - (ends - sizes)
            keys = np.array([r[:2] for r in rows], np.int64)[row]
            made = pd.DataFrame({"anchor": anchor.view(np.int64), "k1": keys[:, 0], "k2": keys[:, 1], "start": start + first[row], "windows": windows})
            return made.assign(packed=None)

        rows: list[tuple] = []
        size = 0
        for b in batches:
            texts = []
            for k1, k2, text in zip(b["k1"].tolist(), b["k2"].tolist(), b["text"].tolist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                x = units.numbers(raw)
                if len(x) >= length:
                    texts.append((k1, k2, press.compress(raw)))
                for at in range(0, max(0, len(x) - length + 1), part - length + 1):
                    piece = x[at : at + part]
                    if size + len(piece) > part and rows:
                        yield flush(rows)
                        rows, size = [], 0
                    rows.append((k1, k2, at, piece))
                    size += len(piece)
            yield pd.DataFrame(texts, columns=["k1", "k2", "packed"]).assign(anchor=None, start=None, windows=None)
        if rows:
            yield flush(rows)

    return docs.mapInPandas(run, "k1 long, k2 long, packed binary, anchor long, start long, windows long")


def packed_texts(docs: DataFrame) -> DataFrame:
    """docs with their text compressed, for a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            b["text"] = [press.compress(t.encode("utf-8", "surrogatepass")) for t in b["text"]]
            yield b

    schema = ", ".join(f"`{c}` {'binary' if c == 'text' else t}" for c, t in docs.dtypes)
    return docs.mapInPandas(run, schema)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def flags_to_ranges(flags: np.ndarray, length: int) -> list[int]:
    """The units that flagged windows cover, as start, end, start, end ..."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > length)
    out = np.empty(2 * (len(gap) + 1), np.int64)
    out[0::2] = at[np.r_[0, gap + 1]]
    out[1::2] = at[np.r_[gap, len(at) - 1]] + length
    return out.tolist()


#: A bucket's strings -> a number for each of their windows; two windows have the same one just if they are equal.
Method = Callable[[list[bytes]], list[np.ndarray]]


def _united(rows: list[tuple]) -> tuple[list[int], list[bytes], list[bytes], list[int]]:
    """rows: anchor, digest, n, part. Equal strings of an anchor as one: anchors, digests, strings, how often each occurs."""
    often: dict[tuple[int, bytes], int] = {}
    name: dict[tuple[int, bytes], bytes] = {}
    for anchor, digest, n, part in rows:
        often[anchor, part] = often.get((anchor, part), 0) + n
        name[anchor, part] = digest
    return [a for a, _ in often], list(name.values()), [p for _, p in often], list(often.values())


def _repeated(method: Method, strings: list[bytes], often: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The number of each window of each string (small and without gaps), and how often each number occurs."""
    numbers = method(strings)
    sizes = [len(x) for x in numbers]
    _, number = np.unique(np.concatenate(numbers), return_inverse=True)
    count = np.bincount(number, weights=np.repeat(np.asarray(often, np.float64), sizes))
    return np.split(number, np.cumsum(sizes)[:-1]), count


def _in_buckets(strings: DataFrame, method: Method, units: Units, length: int, at_once: int) -> DataFrame:
    """strings: anchor, digest, n, part. Whole buckets are handed to method, several at once. Gives anchor, digest, ranges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(rows: list[tuple]) -> pd.DataFrame:
            anchors, digests, strings, often = _united(rows)
            kinds = Counter(anchors)
            # The only string of a bucket: all its windows are repeated if there are several of it, else none.
            several = [i for i, a in enumerate(anchors) if kinds[a] > 1]
            out = [
                (a, d, [0, units.count(p)])
                for a, d, p, n in zip(anchors, digests, strings, often, strict=True)
                if kinds[a] == 1 and n > 1
            ]
            if several:
                numbers, count = _repeated(method, [strings[i] for i in several], [often[i] for i in several])
                out += [(anchors[i], digests[i], x) for i, k in zip(several, numbers, strict=True) if (x := flags_to_ranges(count[k] > 1, length))]
            return pd.DataFrame(out, columns=["anchor", "digest", "ranges"])

        rows: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b[c].tolist() for c in ("anchor", "digest", "n", "part")), strict=True):
                if size > at_once and r[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
        if rows:
            yield flush(rows)

    dealt = strings.repartition(F.col("anchor")).sortWithinPartitions("anchor")
    return dealt.mapInPandas(run, "anchor long, digest binary, ranges array<long>")


def _in_blocks(strings: DataFrame, method: Method, units: Units, length: int, max_bucket: int) -> DataFrame:
    """The same for buckets that are too large for one task. strings has also size, that of the bucket."""
    blocks = F.ceil(F.col("size") / max(1, max_bucket)).cast("long")
    dealt = strings.withColumn("block", F.pmod(F.xxhash64("digest"), blocks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(rows: list[tuple]) -> pd.DataFrame:
            """rows: of one block. Each window once, as text, with its count and places."""
            anchors, digests, strings, often = _united([r[1:] for r in rows])
            numbers, count = _repeated(method, strings, often)
            number = np.concatenate(numbers)
            string = np.repeat(np.arange(len(strings)), [len(x) for x in numbers])
            at = np.concatenate([np.arange(len(x)) for x in numbers])
            order = np.argsort(number, kind="stable")
            ends = np.cumsum(np.bincount(number))
            out = []
            for k, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)):
                places = [{"digest": digests[string[i]], "at": int(at[i])} for i in order[a:b]]
                i = order[a]
                text = units.cut(strings[string[i]], [(int(at[i]), int(at[i]) + length)])[0]
                out.append((anchors[0], text, int(count[k]), places))
            return pd.DataFrame(out, columns=["anchor", "window", "n", "places"])

        rows: list[tuple] = []
        for b in batches:
            for r in zip(*(b[c].tolist() for c in ("block", "anchor", "digest", "n", "part")), strict=True):
                if rows and r[:2] != rows[0][:2]:
                    yield flush(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield flush(rows)

    dealt = dealt.repartition("anchor", "block").sortWithinPartitions("anchor", "block")
    schema = "anchor long, window binary, n long, places array<struct<digest: binary, at: long>>"
    rows = written(dealt.mapInPandas(run, schema))
    often = rows.groupBy("anchor", "window").agg(F.sum("n").alias("n")).where("n > 1").drop("n")
    found = rows.join(often, ["anchor", "window"]).select("anchor", F.explode("places").alias("p"))
    found = found.groupBy("anchor", "p.digest").agg(F.collect_list("p.at").alias("at"))

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for at in b["at"]:
                flags = np.zeros(max(at) + 1, bool)
                flags[np.asarray(at, np.int64)] = True
                out.append(flags_to_ranges(flags, length))
            yield pd.DataFrame({"anchor": b["anchor"], "digest": b["digest"], "ranges": out})

    return found.mapInPandas(ranges, "anchor long, digest binary, ranges array<long>")


def with_keys(docs: DataFrame, id_col: str, text_col: str, with_row: bool = False) -> DataFrame:
    """doc_id, text, k1, k2, and row, the whole row, if with_row."""
    row = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if with_row else []
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), whole_text(docs, text_col).alias("text"), *row)
    return base.select("*", *text_keys(F.col("text")))


def repeated_ranges(
    docs: DataFrame, units: Units, method: Method, *, length: int, q: int, max_bucket: int, at_once: int, part: int
) -> DataFrame:
    """docs: k1, k2, text. Gives k1, k2, packed, found for each text with repeated windows, once.

    found: all ranges of units that these cover, as start, end, start, end ...
    """
    both = written(find_segments(docs.select("k1", "k2", "text"), units, length, q, part))
    whole = both.where("anchor is null").select("k1", "k2", "packed")
    parts = both.where("anchor is not null").select("anchor", "k1", "k2", "start", "windows")
    # Written, so that the join below deals both sides afresh and Spark can split a frequent anchor.
    often = written(parts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    # Copies of a text have the same segments; they are counted, and one of them is enough from now on.
    wanted = parts.join(often, "anchor").groupBy("k1", "k2").agg(F.collect_set(F.struct("anchor", "start", "windows")).alias("wanted"))
    # Arrays of numbers, not of structs, which Python would hold as a dictionary each.
    wanted = wanted.select("k1", "k2", "wanted.anchor", "wanted.start", "wanted.windows")
    texts = whole.groupBy("k1", "k2").agg(F.first("packed").alias("packed"), F.count("*").alias("n")).join(wanted, ["k1", "k2"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of three kinds: each text; each segment, with its string's digest; each string, equal ones as one."""
        names = ["k1", "k2", "packed", "anchor", "start", "digest", "part", "n"]
        for b in batches:
            out, strings = [], []
            rows = zip(*(b[c].tolist() for c in ("k1", "k2", "packed", "n", "anchor", "start", "windows")), strict=True)
            for k1, k2, data, n, anchors, starts, windows in rows:
                out.append((k1, k2, data, None, None, None, None, None))
                anchors, starts, ends = anchors.tolist(), starts.tolist(), (starts + windows + length - 1).tolist()
                for a, s, p in zip(anchors, starts, units.cut(unpacked(data), list(zip(starts, ends, strict=True))), strict=True):
                    strings.append((a, hashlib.blake2b(p, digest_size=16).digest(), n, p))
                    out.append((k1, k2, None, a, s, strings[-1][1], None, None))
            out += [(None, None, None, a, None, d, p, n) for a, d, p, n in zip(*_united(strings), strict=True)]
            # Nullable from the start: 64 bits don't fit the floats that pandas takes for numbers with gaps.
            columns = dict(zip(names, zip(*out, strict=True), strict=True)) if out else dict.fromkeys(names, ())
            yield pd.DataFrame({c: x if c in ("packed", "digest", "part") else pd.array(x, "Int64") for c, x in columns.items()})

    cuts = written(
        texts.mapInPandas(cut, "k1 long, k2 long, packed binary, anchor long, start long, digest binary, part binary, n long")
    )
    forget(both)
    forget(often)
    placed = cuts.where("start is not null").select("anchor", "digest", "k1", "k2", "start")
    strings = cuts.where("part is not null").select("anchor", "digest", "part", "n")
    sizes = strings.groupBy("anchor").agg(F.sum(F.length("part")).alias("size"))
    hot = written(sizes.where(F.col("size") > max_bucket))
    cool = _in_buckets(strings.join(hot, "anchor", "left_anti"), method, units, length, at_once)
    spread = _in_blocks(strings.join(hot, "anchor"), method, units, length, max_bucket)
    ranges = written(cool.unionByName(spread))
    found = (
        placed.join(ranges, ["anchor", "digest"])
        .select("k1", "k2", F.transform("ranges", lambda r: r + F.col("start")).alias("r"))
        .groupBy("k1", "k2")
        .agg(F.flatten(F.collect_list("r")).alias("found"))
    )
    return cuts.where("packed is not null").select("k1", "k2", "packed").join(found, ["k1", "k2"])


def merged(found: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal covered ranges of a text of n units. found: start, end, start, end ..."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, found[0::2], 1)
    np.add.at(steps, found[1::2], -1)
    on = np.concatenate(([0], np.cumsum(steps[:-1]) > 0, [0])).astype(np.int8)
    change = np.diff(on)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)
