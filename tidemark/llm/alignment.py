"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Two pointers walk over the cumulative token ends of both sides, inside mapInPandas. Where both end at one byte, a group
closes and the two tokens that end there are a link. Spark counts the linked pairs over the corpus, takes the maximum of
each side's id, and joins both back.

No token of either vocabulary crosses from a character that isn't white space to a space, so texts are aligned in runs cut
there, and a run that a task has met before is looked up. Documents travel in blocks of bounded size, so that a frequent
pair is joined once a block, not once a document.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from .bpe import byte_symbols
from .common import join_counted, whole_text, written

#: A part of a text that is aligned at once, and a block of documents, in characters.
SLICE = 1 << 21
#: Runs that a task keeps at most; beyond this it starts anew after the block.
KEPT_RUNS = 500_000
#: A pair of ids is a << SHIFT | b.
SHIFT = 32

SPACE_MARK = "▁"
#: Fixed value: how byte-level vocabularies split a text.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these, Unicode versions differ in what a letter is; such runs are encoded by the slower library.
RARE = re.compile("[^\0-\u024f]")
CUT = re.compile(r"(?<=\S)(?= )")
ODD = re.compile(r"\s(?= )")


class Vocabularies:
    """Both encoders, and the bytes of their entries. A: byte-level BPE of a JSON file; B: a SentencePiece model."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        if self.a.normalizer:
            raise ValueError(f"{path_a}: tokens don't spell the text, as a normaliser changes it")
        self.b = SentencePieceProcessor(model_file=path_b)
        byte = {c: n for n, c in enumerate(byte_symbols())}
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.bytes_a[i] = token.encode() if token in special else bytes(byte[c] for c in token)
        # In this kind of vocabulary ids ascend with the rank of their merge.
        ranks = {bytes(byte[c] for c in t): i for t, i in entries.items() if t not in special}
        self.quick = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError(f"{path_b}: a piece holds a space after another character")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.size_a, self.size_b = ([len(x) for x in side] for side in (self.bytes_a, self.bytes_b))
        self.mark = self.b.piece_to_id(SPACE_MARK)

    def encode(self, runs: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of runs, each with a space before it, on both sides; B writes that space itself, unless the run is empty."""
        rare, quick = RARE.search, self.quick.encode_ordinary
        a = [self.a.encode(" " + r, add_special_tokens=False).ids if rare(r) else quick(" " + r) for r in runs]
        return a, [ids or [self.mark] for ids in self.b.encode(runs, num_threads=1)]


@functools.cache
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


def merge(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """Two pointers over ascending ends: the places, on both sides, of those that are in both."""
    out, i, j = [], 0, 0
    while i < len(ends_a) and j < len(ends_b):
        if ends_a[i] < ends_b[j]:
            i += 1
        elif ends_a[i] > ends_b[j]:
            j += 1
        else:
            out.append((i, j))
            i, j = i + 1, j + 1
    return out


def runs_of(text: str) -> Iterator[list[str]]:
    """The text in lists of runs, each list of SLICE characters about; the space before each run is left out."""
    start = 0
    while start < len(text) or not start:
        stop = len(text)
        if stop - start > SLICE:
            m = CUT.search(text, start + SLICE)
            stop = m.start() if m else stop
        part = text[start:stop] if start or stop < len(text) else text
        if start:
            part = part[1:]  # the space at which it was cut
        if ODD.search(part) or part[:1].isspace():
            yield [r[1:] for r in CUT.split(" " + part)]
        else:
            yield part.split(" ")
        start = stop
        if stop == len(text):
            return


class Runs:
    """Aligned runs of a task by number: tokens of either side, groups as text, links as a << 32 | b."""

    def __init__(self, path_a: str, path_b: str):
        self.v = vocabularies(path_a, path_b)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a, self.n_b, self.links, self.starts, self.alike = array("i"), array("i"), array("q"), array("q", [0]), array("b")

    def find(self, runs: list[str]) -> np.ndarray:
        new = list(set(runs).difference(self.number))
        if new:
            self.learn(new)
        return np.fromiter(map(self.number.__getitem__, runs), np.int64, len(runs))

    def learn(self, runs: list[str]) -> None:
        bytes_b, size_a, size_b = self.v.bytes_b.__getitem__, self.v.size_a.__getitem__, self.v.size_b.__getitem__
        for run, a, b in zip(runs, *self.v.encode(runs), strict=True):
            self.number[run] = len(self.groups)
            if b"".join(map(bytes_b, b)) != (" " + run).encode():
                self.add("", 0, 0, (), False)
                continue
            ends_a, ends_b = list(accumulate(map(size_a, a))), list(accumulate(map(size_b, b)))
            if ends_a == ends_b:  # each step of both pointers would close a group
                self.add(";".join([f"{x}|{y}" for x, y in zip(a, b, strict=True)]), len(a), len(b), [x << SHIFT | y for x, y in zip(a, b, strict=True)], True)
                continue
            links, groups, at_a, at_b = [], [], 0, 0
            for i, j in merge(ends_a, ends_b):
                links.append(a[i] << SHIFT | b[j])
                groups.append(f"{a[i]}|{b[j]}" if i == at_a and j == at_b else ",".join(map(str, a[at_a : i + 1])) + "|" + ",".join(map(str, b[at_b : j + 1])))
                at_a, at_b = i + 1, j + 1
            self.add(";".join(groups), len(a), len(b), links, True)

    def add(self, groups: str, n_a: int, n_b: int, links: list[int] | tuple, alike: bool) -> None:
        self.groups.append(groups)
        self.n_a.append(n_a)
        self.n_b.append(n_b)
        self.links.extend(links)
        self.starts.append(len(self.links))
        self.alike.append(alike)


class Block:
    """Documents that travel together; once full, one row with their counts and the pairs of ids that they link."""

    COLUMNS = (
        "doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_links array<bigint>, sha array<string>, groups array<string>, "
        "kinds array<int>, links binary, pair array<bigint>, pair_n array<bigint>"
    )

    def __init__(self, runs: Runs, with_groups: bool):
        self.runs, self.with_groups = runs, with_groups
        self.ids: list[int | None] = []
        self.found: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str) -> None:
        none = np.zeros(0, np.int64)
        self.ids.append(doc_id)
        self.found.append(np.concatenate([none, *map(self.runs.find, runs_of(text))]) if text else none)
        self.size += len(text) + 64

    def row(self) -> pd.DataFrame:
        r = self.runs
        alike, n_a, n_b, starts = (np.array(x) for x in (r.alike, r.n_a, r.n_b, r.starts))
        links, sizes = np.array(r.links, np.int64), np.diff(starts)
        found = [k if alike[k].all() else k[:0] for k in self.found]
        sums = [[int(x[k].sum()) for k in found] for x in (n_a, n_b, sizes)]
        groups = [";".join(map(r.groups.__getitem__, k.tolist())) for k in found]
        sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        every = np.concatenate([np.zeros(0, np.int64), *found])
        doc = np.repeat(np.arange(len(found)), sums[2])
        n = sizes[every]
        at = np.repeat(starts[:-1][every] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair, which, pair_n = np.unique(links[at], return_inverse=True, return_counts=True)
        key, times = np.unique(doc * max(1, len(pair)) + which, return_counts=True)
        kinds = np.bincount(key // max(1, len(pair)), minlength=len(found))
        packed = np.stack([key % max(1, len(pair)), times]).astype(np.int32).tobytes()
        cells = [self.ids, *sums, sha, groups if self.with_groups else [], kinds.tolist(), packed, pair, pair_n]
        return pd.DataFrame({c.split()[0]: [x] for c, x in zip(self.COLUMNS.split(", "), cells, strict=True)})


def _blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, with_groups: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = Runs(path_a, path_b)
        block = Block(runs, with_groups)
        for b in batches:
            for i, text in zip(b["doc_id"], b["text"], strict=True):
                block.add(None if pd.isna(i) else int(i), text)
                if block.size >= SLICE:
                    yield block.row()
                    block = Block(runs, with_groups)
                    if len(runs.groups) > KEPT_RUNS:
                        runs.clear()
        if block.ids:
            yield block.row()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), whole_text(docs, text_col).alias("text"))
    return written(rows.mapInPandas(run, Block.COLUMNS).withColumn("block", F.monotonically_increasing_id()))


def _counted(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, pair, n of every block; pair, blocks that hold it, n over the corpus, most_a and most_b of its two ids)."""
    held = blocks.select("block", F.explode(F.arrays_zip("pair", "pair_n")).alias("x")).select("block", "x.pair", F.col("x.pair_n").alias("n"))
    pairs = held.groupBy("pair").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"))
    pairs = written(pairs.select("pair", "n", "blocks", F.shiftright("pair", SHIFT).alias("a"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).alias("b")))
    # No more rows than a vocabulary has entries.
    for side in "ab":
        most = pairs.groupBy(side).agg(F.max("n").alias(f"most_{side}"))
        pairs = pairs.join(F.broadcast(most), side)
    return held.drop("n"), pairs


def pair_counts(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, n, most_a, most_b: the links of each pair of ids over all documents, and the most that either id has with any."""
    return _counted(_blocks(docs, path_a, path_b, id_col, text_col, False))[1].select("a", "b", "n", "most_a", "most_b")


def align(
    docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True
) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_a, count_sum, groups_sha256; groups.

    A encodes a space and the text, B the text, before which it writes that space; special tokens' strings are plain text.
    groups: `a1,a2|b1;a3|b2,b3`, ids in order, cut where both sides end. Tokens aren't empty, so a group has one link, that
    of its last tokens. n_best: links whose pair is linked as often, over all documents, as any pair of its B id;
    n_best_a: of its A id; ties count. count_sum: the sum over links of how often their pair is linked.

    Texts that are null, empty or whose tokens don't spell a space and the text (U+2581 reads as a space) have no tokens:
    zeros, and groups and groups_sha256 are empty. Repeated rows each give a row and count each; a null doc_id stays null;
    other columns are ignored; an empty table gives no rows. Both files must be on every executor.
    """
    blocks = _blocks(docs, path_a, path_b, id_col, text_col, with_groups)
    held, pairs = _counted(blocks)
    found = join_counted(held, pairs.select("pair", "n", "most_a", "most_b", "blocks"), "pair", "blocks")
    # Pairs are in ascending order in their block, and so in these arrays.
    found = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pair", "n", "most_a", "most_b"))).alias("x"))
    found = found.select("block", *(F.col(f"x.{c}").alias(c) for c in ("n", "most_a", "most_b")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples():
                which, times = np.frombuffer(b.links, np.int32).reshape(2, -1).astype(np.int64)
                doc = np.repeat(np.arange(len(b.doc_id)), b.kinds)
                n, most_a, most_b = (np.asarray([] if x is None else x, np.int64)[which] for x in (b.n, b.most_a, b.most_b))

                def total(x: np.ndarray, doc: np.ndarray = doc, ends: int = len(b.doc_id)) -> np.ndarray:
                    out = np.zeros(ends, np.int64)
                    np.add.at(out, doc, x)
                    return out

                out = {"doc_id": pd.array(list(b.doc_id), "Int64"), "n_a": b.n_a, "n_b": b.n_b, "n_groups": b.n_links, "n_links": b.n_links}
                out |= {"n_best": total(times * (n == most_b)), "n_best_a": total(times * (n == most_a)), "count_sum": total(times * n)}
                out |= {"groups_sha256": b.sha} | ({"groups": b.groups} if with_groups else {})
                yield pd.DataFrame(out)

    columns = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_a long, count_sum long, groups_sha256 string"
    rows = blocks.drop("pair", "pair_n").join(found, "block", "left").drop("block")
    return rows.mapInPandas(run, columns + (", groups string" if with_groups else ""))
