"""Segmentation of text without spaces by a dictionary: a trie finds every word at every place, and of all ways through this
graph of words the likeliest is taken."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The terms of the field and how often each is taken to occur.
TERMS = {
    "现金价值": 100, "保证续保": 100, "犹豫期": 100, "等待期": 100, "免赔额": 100, "免赔率": 100, "投保人": 100, "被保险人": 100,
    "受益人": 100, "保险期间": 100, "保险费率": 100, "如实告知": 100, "健康告知": 100, "万能险": 50, "分红险": 50, "年金险": 50,
    "投资连结险": 50, "变额年金": 50, "趸交": 100, "期交": 100, "保费": 100, "保额": 100, "保单": 100, "理赔": 100, "退保": 100,
    "续保": 100, "核保": 100, "免责条款": 100, "责任免除": 100, "保险合同": 100, "保险标的": 100, "保险事故": 100, "保险金额": 100,
    "保险价值": 100, "法定解除": 100, "约定解除": 100, "不可抗辩": 100, "宽限期": 100, "复效": 100, "减额缴清": 100, "自动垫交": 100,
    "保单贷款": 100, "红利": 50, "万能账户": 50, "结算利率": 50, "保证利率": 50,
}

# Words that are left out, and single characters that are kept.
STOPWORDS = frozenset(
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们 那 些 什么 怎么 如何 可以 以及 或者 还是".split()
)
SINGLES = frozenset("险 保 赔 费 额 期 率 金".split())

PARTS = re.compile("([一-鿿]+)|([^\\W_一-鿿]+)")


class Segmenter:
    """words: how often each occurs. unknown: what becomes of characters between words: their overlapping pairs, or nothing.

    A character that is no word counts as one that occurred once. Of equally likely ways the one with the longer first word is
    taken, from the left on.
    """

    def __init__(self, words: dict[str, int], stopwords: frozenset[str] = STOPWORDS, singles: frozenset[str] = SINGLES, unknown: str = "pairs"):
        self.stopwords, self.singles, self.pairs = stopwords, singles, unknown == "pairs"
        self.trie, self.total = ahocorasick.Automaton(), math.log(sum(words.values()) or 1)
        self.weight = {w: math.log(n) for w, n in words.items() if w and n > 0}
        for w in self.weight:
            self.trie.add_word(w, w)
        if self.weight:
            self.trie.make_automaton()

    def path(self, run: str) -> list[str]:
        """The likeliest words that make up a run."""
        n = len(run)
        ends: list[list[int]] = [[] for _ in run]
        if self.weight:
            for last, w in self.trie.iter(run):
                ends[last + 1 - len(w)].append(last + 1)
        best: list[tuple[float, int]] = [(0.0, 0)] * n + [(0.0, n)]
        for i in range(n - 1, -1, -1):
            best[i] = max((self.weight.get(run[i:j], 0.0) - self.total + best[j][0], j) for j in {i + 1, *ends[i]})
        out, i = [], 0
        while i < n:
            out.append(run[i : best[i][1]])
            i = best[i][1]
        return out

    def tokens(self, text: str | None) -> list[str]:
        """Words, and runs of other letters and digits; no stop words, and of single characters only those to keep."""
        return [t for t in self.raw(text or "") if t not in self.stopwords and (len(t) > 1 or t in self.singles)]

    def raw(self, text: str) -> Iterator[str]:
        for m in PARTS.finditer(text):
            if m[2]:
                yield m[2]
                continue
            loose = ""
            for w in [*self.path(m[1]), ""]:
                if len(w) == 1 and w not in self.weight:
                    loose += w
                    continue
                if loose:
                    yield from [c for c in loose if c in self.singles] if len(loose) == 1 or not self.pairs else (loose[i : i + 2] for i in range(len(loose) - 1))
                    loose = ""
                if w:
                    yield w


_built: dict[int, Segmenter] = {}


def _in_pieces(text: pa.Array, tokens: Callable[[str | None], list[str]], piece: int = 256) -> pa.Array:
    """The tokens of texts; Python holds those of `piece` texts at a time."""
    kind = pa.list_(pa.string())
    return pa.concat_arrays([pa.array([], kind), *(pa.array([tokens(t) for t in text.slice(i, piece).to_pylist()], kind) for i in range(0, len(text), piece))])


def segmenter(
    spark: SparkSession, words: dict[str, int] = TERMS, *, stopwords: frozenset[str] = STOPWORDS, singles: frozenset[str] = SINGLES, unknown: str = "pairs"
) -> Callable[[Column], Column]:
    """A tokenizer: a text's column to the array of its tokens, in order, in Arrow batches. Null and blank texts have none.

    The dictionary travels once to each executor, and its trie is built once in each of its Python processes.
    """
    shared = spark.sparkContext.broadcast((words, stopwords, singles, unknown))
    number = shared._jbroadcast.id()

    @F.arrow_udf("array<string>")
    def tokens(text: pa.Array) -> pa.Array:
        if number not in _built:
            _built[number] = Segmenter(*shared.value)
        return _in_pieces(text, _built[number].tokens)

    return tokens
