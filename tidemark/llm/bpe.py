"""Byte-pair encoding and decoding by a pair occurrence index.

The distinct words that a task meets for the first time are laid out as one row of symbols. An index maps each pair that
has a rank to all its positions there; the active ranks are applied in ascending order, each to all its positions from
left to right, and a merge only changes the lists of the pairs on its two sides. Words are independent of each other, so
applying the lowest rank to all words at once gives what each word would get alone. What a word became is kept, so that
further occurrences only look it up.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import whole_text

#: A slice of texts that is encoded at once, in characters; longer texts are cut at white space.
SLICE = 1 << 21
#: Encoded words that a task keeps at most; beyond this it starts anew.
KEPT_WORDS = 400_000
#: Longer runs without white space hardly come again and aren't kept.
KEPT_LENGTH = 48
#: Bytes of words that share one index, about.
INDEXED = 1 << 20
#: From so many positions on, a pair's are merged as arrays.
MANY = 24


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """A vocabulary file: BPE with word ends over bytes; text is NFC, lower case, split by the file's pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        parts = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not end or parts != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError(f"{path}: not a vocabulary of lower-case BPE with word ends")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.token = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        #: White space as the file's pattern has it, and what str.split() takes for white space besides.
        self.space, self.odd = regex.compile(r"\s+"), re.compile("[\x1c-\x1f]")
        #: Beyond these, Unicode versions differ in letters and cases; such texts are normalised and split (not encoded)
        #: by the library.
        self.rare, self.library = re.compile("[^\0-\u024f]"), Tokenizer.from_file(path)
        self.specials = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)))
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.last = np.array([vocab[c + end] for c in symbols], np.int64)
        self.size = max(self.token) + 1
        #: (left id * size + right id) -> rank; rank -> left, right and merged id.
        self.rank: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        for n, (a, b) in enumerate(tuple(x.split(" ")) if isinstance(x, str) else x for x in model["merges"]):
            self.rank[vocab[a] * self.size + vocab[b]] = n
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
        keys = np.array(list(self.rank), np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(self.rank.values()), np.int64)[order]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, four bytes each; words aren't empty."""
        out: list[bytes] = []
        held: list[bytes] = []
        size = 0
        for w in words:
            held.append(w.encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size >= INDEXED:
                out += self.encode_together(held)
                held, size = [], 0
        return out + self.encode_together(held) if held else out

    def encode_together(self, raw: list[bytes]) -> list[bytes]:
        """The same for words that share one index of pair occurrences."""
        sizes = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(raw), np.uint8)
        place = np.arange(len(data)) + np.repeat(np.arange(len(raw)), sizes)  # a gap follows each word: no pair crosses it
        row = np.full(len(data) + len(raw), -1, np.int64)
        row[place] = self.inner[data]
        row[place[ends - 1]] = self.last[data[ends - 1]]
        ranks, places = self.find(row[:-1], row[1:])
        order = np.argsort(ranks, kind="stable")
        active, starts = np.unique(ranks[order], return_index=True)
        places, starts = places[order].tolist(), [*starts.tolist(), len(places)]
        active = active.tolist()
        index = {r: places[starts[n] : starts[n + 1]] for n, r in enumerate(active)}  # ascending, hence a heap

        size, rank_of, merges = self.size, self.rank.get, self.merges
        symbol, after, before = array("q", row.tobytes()), array("q", range(1, len(row) + 1)), array("q", range(-1, len(row) - 1))
        # The same numbers for numpy, where a pair has many positions at once.
        symbols, afters, befores = (np.frombuffer(x, np.int64) for x in (symbol, after, before))

        def add(rank: int, found: list[int]) -> None:
            if rank in index:
                index[rank] += found
            else:
                index[rank] = found
                heapq.heappush(active, rank)

        while active:
            r = heapq.heappop(active)
            places = index.pop(r)
            left, right, merged = merges[r]
            if len(places) >= MANY and left != right:  # no two of these positions overlap
                i = np.unique(places)
                i = i[symbols[i] == left]
                i = i[symbols[afters[i]] == right]
                j = afters[i]
                symbols[i], symbols[j] = merged, -2
                k = afters[i] = afters[j]
                befores[k] = i
                h = befores[i]
                a, b = symbols[np.concatenate([h, i])], symbols[np.concatenate([i, k])]
                ranks, which = self.find(a, b)
                at = np.concatenate([h, i])[which]
                order = np.argsort(ranks, kind="stable")
                new, starts = np.unique(ranks[order], return_index=True)
                at, starts = at[order].tolist(), [*starts.tolist(), len(at)]
                for n, s in enumerate(new.tolist()):
                    add(s, at[starts[n] : starts[n + 1]])
                continue
            places.sort()
            key = merged * size
            for i in places:
                if symbol[i] != left or symbol[j := after[i]] != right:
                    continue
                symbol[i], symbol[j] = merged, -2
                k = after[i] = after[j]
                before[k] = i
                h = before[i]
                # A gap is -1; before the first word comes the last gap.
                if (x := symbol[h]) >= 0 and (s := rank_of(x * size + merged)) is not None:
                    add(s, [h])
                if (x := symbol[k]) >= 0 and (s := rank_of(key + x)) is not None:
                    add(s, [i])
        stays = symbols >= 0
        ids = symbols[stays].astype("<u4").tobytes()
        count = np.cumsum(np.add.reduceat(stays, ends - sizes + np.arange(len(raw)))) * 4
        return [ids[a:b] for a, b in zip([0, *count[:-1].tolist()], count.tolist(), strict=True)]

    def split(self, chunk: str) -> list[str]:
        if not self.rare.search(chunk):
            return self.pattern.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of those symbols that form a pair, and where they are in the arrays."""
        key = left * self.size + right
        i = np.searchsorted(self.keys, key)
        i[i == len(self.keys)] = 0
        at = np.flatnonzero((self.keys[i] == key) & (left >= 0) & (right >= 0))
        return self.ranks[i[at]], at

    def chunks(self, text: str) -> list[str]:
        """Runs without white space, normalised. No token crosses white space."""
        if self.rare.search(text):
            text = self.library.normalizer.normalize_str(text)
        elif not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.lower()
        return [c for c in self.space.split(text) if c] if self.odd.search(text) else text.split()


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts to the ids (four bytes each) of runs without white space, or to what `render` makes of these."""

    def __init__(self, path: str, render: Callable[[bytes], object] | None = None):
        self.v, self.render, self.ids = vocabulary(path), render, {}
        self.kept: dict = self.ids if render is None else {}

    def learn(self, chunks: list[str]) -> dict:
        """What render makes of each chunk; the words in them that are new are encoded together."""
        ids, split, render = self.ids, self.v.split, self.render
        parts = {c: split(c) for c in chunks if not c.isalpha() or self.v.rare.search(c)}
        whole = [c for c in chunks if c not in parts] if parts else chunks
        words = set(chain.from_iterable(parts.values()))
        words.update(whole)
        words = list(words.difference(ids))
        ids.update(zip(words, self.v.encode_words(words), strict=True))
        find = ids.__getitem__
        out = {c: b"".join(map(find, p)) for c, p in parts.items()}
        if render is None:
            return out
        return {c: render(find(c)) for c in whole} | {c: render(x) for c, x in out.items()}

    def encode(self, texts: list[list[str | int]]) -> list[list]:
        """texts: each a list of texts without special tokens, and of special ids. Gives the rendered runs of each."""
        split = [[self.v.chunks(x) if isinstance(x, str) else x for x in t] for t in texts]
        wanted: set[str] = set()
        for t in split:
            for x in t:
                if not isinstance(x, int):
                    wanted.update(x)
        kept = self.kept
        kept.update(new := self.learn(list(wanted.difference(kept))))
        out = []
        for t in split:
            rendered: list = []
            for x in t:
                if isinstance(x, int):
                    one = x.to_bytes(4, "little")
                    rendered.append(self.render(one) if self.render else one)
                else:
                    rendered.extend(map(kept.__getitem__, x))
            out.append(rendered)
        if len(kept) > KEPT_WORDS:
            kept.clear()
            self.ids.clear()
        elif long := [c for c in new if len(c) > KEPT_LENGTH]:
            for c in long:
                del kept[c]
        return out

    def parts(self, text: str) -> Iterator[list[str | int]]:
        """The text in parts of at most about SLICE characters, cut before white space; special tokens as ids."""
        found, at = [], 0
        if "<" in text:
            for m in self.v.specials.finditer(text):
                found += [text[at : m.start()], self.v.special[m[0]]]
                at = m.end()
        found.append(text[at:] if at else text)
        for x in found:
            if isinstance(x, int):
                yield [x]
                continue
            while len(x) > SLICE:
                m = re.search(r"[ \n]", x[SLICE:])
                cut = SLICE + m.start() if m else len(x)
                yield [x[:cut]]
                x = x[cut:]
            yield [x]

    def slices(self, texts: list[str]) -> Iterator[tuple[int, list]]:
        """(number of the text, its next rendered runs), texts in order."""
        todo: list[tuple[int, list]] = []
        size = 0
        for n, t in enumerate(texts):
            for part in self.parts(t):
                todo.append((n, part))
                size += sum(len(x) for x in part if isinstance(x, str))
                if size >= SLICE:
                    yield from zip([n for n, _ in todo], self.encode([p for _, p in todo]), strict=True)
                    todo, size = [], 0
        if todo:
            yield from zip([n for n, _ in todo], self.encode([p for _, p in todo]), strict=True)


def encode_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; nothing is shuffled.

    ids_sha256 covers the decimal ids joined by one space; decoded_sha256 covers what the vocabulary's decoder gives
    (this kind has none, so tokens are joined by one space, special ones included). path: the vocabulary file, which
    every executor must have. Null text: empty, no tokens. Texts that hold the strings of special tokens get those.
    Repeated rows each give a row; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        number, token = {i: str(i) for i in v.token}.__getitem__, v.token.__getitem__

        def render(ids: bytes) -> tuple[str, str]:
            ids = memoryview(ids).cast("I")
            return " ".join(map(number, ids)), " ".join(map(token, ids))

        enc = Encoder(path, render)
        for b in batches:
            texts = b["text"].tolist()
            n = [0] * len(texts)
            ids, words = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
            for at, runs in enc.slices(texts):
                if runs:
                    x, y = " ".join([r[0] for r in runs]), " ".join([r[1] for r in runs])
                    if n[at]:
                        x, y = " " + x, " " + y
                    n[at] += x.count(" ") + (not n[at])
                    ids[at].update(x.encode())
                    words[at].update(y.encode())
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"],
                    "n_tokens": n,
                    "ids_sha256": [h.hexdigest() for h in ids],
                    "decoded_sha256": [h.hexdigest() for h in words],
                }
            )

    return docs.select(docs[id_col].alias("doc_id"), whole_text(docs, text_col).alias("text")).mapInPandas(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
