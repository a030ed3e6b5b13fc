"""Best-fit decreasing packing of documents into sequences.

Best fit only looks at lengths, and there are at most `capacity` of them. So the pieces are numbered within their
length where they are made, the driver gets one count per length (at most `capacity` numbers), fits whole runs of equal
pieces with a segment tree over the remaining capacities, and each piece looks up its place in that plan by its length
and number. This is best-fit decreasing over all pieces, not an approximation by partition; what passes through the
driver depends on the capacity alone.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import whole_text, written

PLAN = ["length", "number", "count", "sequence", "offset", "each"]


class OpenBins:
    """Open bins by remaining capacity, with a segment tree that finds the tightest one that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.leaves)
        self.runs: dict[int, deque[tuple[int, int]]] = {}

    def add(self, room: int, first: int, count: int) -> None:
        if not room or not count:
            return
        self.runs.setdefault(room, deque()).append((first, count))
        i = room + self.leaves
        while i and not self.tree[i]:
            self.tree[i] = True
            i //= 2

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of an open bin that is at least size."""
        i = size + self.leaves
        if self.tree[i]:
            return size
        while i > 1 and not (i % 2 == 0 and self.tree[i + 1]):
            i //= 2
        if i <= 1:
            return None
        i += 1
        while i < self.leaves:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.leaves

    def take(self, room: int, count: int) -> tuple[int, int]:
        """Closes up to count bins of that remaining capacity: the first one's number, and how many."""
        runs = self.runs[room]
        first, n = runs.popleft()
        if n > count:
            runs.appendleft((first + count, n - count))
            n = count
        if not runs:
            i = room + self.leaves
            while i:
                self.tree[i] = i < self.leaves and (self.tree[2 * i] or self.tree[2 * i + 1])
                i //= 2
        return first, n


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """counts: pieces by length. Gives rows of PLAN, and the number of sequences.

    A row places the pieces of a length from `number` on, `each` in a row to a sequence from `sequence` on.
    """
    bins, plan, used = OpenBins(capacity), [], 0
    for size in sorted(counts, reverse=True):
        number, left = 0, counts[size]
        while left:
            room = bins.tightest(size)
            each = (room or capacity) // size
            # The bin that got a piece stays the tightest one until no more fit, so each is filled before the next.
            whole = max(1, left // each)
            if room is None:
                first, n, room = used, whole, capacity
                used += n
            else:
                first, n = bins.take(room, whole)
            here = min(left, n * each)
            plan.append((size, number, here, first, capacity - room, each))
            if here == n * each:
                bins.add(room - each * size, first, n)
            else:  # a single bin that got fewer
                bins.add(room - here * size, first, n)
            number, left = number + here, left - here
    return plan, used


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's number among those of its length in its task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder(path)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end, wide = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            out: list[tuple] = []

            def emit(doc: object, data: bytes, n: int, start: int, out: list = out) -> None:
                out.append((doc, n, start, len(data) // 4, zlib.crc32(data)))

            ids, texts = b["doc_id"].tolist(), b["text"].tolist()
            at, tail, n, start = -1, b"", 0, 0
            for k, runs in enc.slices(texts):
                if k != at:
                    if at >= 0:
                        tail += end
                        for i in range(0, len(tail), wide):
                            emit(ids[at], tail[i : i + wide], n, start)
                            n, start = n + 1, start + capacity
                    at, tail, n, start = k, b"", 0, 0
                tail += b"".join(runs)
                while len(tail) > wide:
                    whole = (len(tail) - 1) // wide * wide
                    for i in range(0, whole, wide):
                        emit(ids[at], tail[i : i + wide], n, start)
                        n, start = n + 1, start + capacity
                    tail = tail[whole:]
            if at >= 0:
                tail += end
                for i in range(0, len(tail), wide):
                    emit(ids[at], tail[i : i + wide], n, start)
                    n, start = n + 1, start + capacity
            made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            made["doc_id"] = made["doc_id"].astype("Int64")
            made["task"] = task
            lengths = made["length"].to_numpy(np.int64)
            made["number"] = made.groupby("length").cumcount().to_numpy() + seen[lengths]
            np.add.at(seen, lengths, 1)
            yield made

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"
    return docs.select(docs[id_col].alias("doc_id"), whole_text(docs, text_col).alias("text")).mapInPandas(run, schema)


def pack(
    docs: DataFrame,
    path: str,
    *,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids by the vocabulary file at path, then end_id; longer ones are cut into pieces of `capacity`.
    Null text counts as empty, one piece of one id. Rows with the same doc_id, or none, are packed as documents of
    their own. Other columns are ignored; an empty table gives no rows.
    """
    made = written(pieces(docs, path, capacity, end_id, id_col, text_col))
    by_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before_task = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, _ = best_fit_plan(counts, capacity)
    plan = np.array(rows, np.int64).reshape(-1, len(PLAN))
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = shared.value
        length, number = plan[:, 0], plan[:, 1]
        lows = {x: (np.searchsorted(length, x), np.searchsorted(length, x, "right")) for x in np.unique(length).tolist()}
        for b in batches:
            row = np.zeros(len(b), np.int64)
            size, n = b["length"].to_numpy(), b["number"].to_numpy()
            for x in np.unique(size).tolist():
                lo, hi = lows[x]
                mine = size == x
                row[mine] = lo + np.searchsorted(number[lo:hi], n[mine], "right") - 1
            p = plan[row]
            k = n - p[:, 1]
            b["sequence_id"] = p[:, 3] + k // p[:, 5]
            b["offset"] = p[:, 4] + k % p[:, 5] * size
            yield b.drop(columns="number")

    numbered = made.join(before_task, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("number")
    )
    return numbered.mapInPandas(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
