"""Segmentation against every way through a run; many keywords against a plain search for each."""

from __future__ import annotations

import math
import random
import time

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import segment as sg
from tidemark.operators import compliance as cp
from tidemark.operators import retrieval as rt


def brute_path(run, words):
    total = math.log(sum(words.values()) or 1)

    def best(rest):
        if not rest:
            return 0.0, []
        ways = []
        for j in range(1, len(rest) + 1):
            if j == 1 or rest[:j] in words:
                score, tail = best(rest[j:])
                ways.append((math.log(words.get(rest[:j], 1)) - total + score, j, [rest[:j], *tail]))
        score, _, path = max(ways, key=lambda w: (w[0], w[1]))
        return score, path

    return best(run)


def test_best_path():
    rng = random.Random(6)
    for _ in range(150):
        words = {"".join(rng.choices("甲乙丙丁", k=rng.randint(1, 3))): rng.randint(1, 200) for _ in range(rng.randint(0, 12))}
        run = "".join(rng.choices("甲乙丙丁戊", k=rng.randint(1, 9)))
        s = sg.Segmenter(words)
        path = s.path(run)
        total = math.log(sum(words.values()) or 1)
        assert "".join(path) == run and all(len(w) == 1 or w in words for w in path)
        assert math.isclose(sum(math.log(words.get(w, 1)) - total for w in path), brute_path(run, words)[0], abs_tol=1e-9)


def test_segmentation_by_hand(spark):
    rows = [
        "投保人退保后现金价值不足", "被保险人在保险期间内出险", "健康保险产品的等待期不得超过90天。", "保险条款Insurance2024年", "保", "的", "", " \n", None,
        "核保、理赔。续保", "万能险的万能账户与结算利率", "甲", "甲乙丙", "x y ab", "a_b2 c",
    ]
    want = [
        ["投保人", "退保", "现金价值", "不足"], ["被保险人", "保险期间", "内出", "出险"], ["健康", "康保", "保险", "险产", "产品", "品的", "等待期", "不得", "得超", "超过", "90"],
        ["保险", "险条", "条款", "Insurance2024"], ["保"], [], [], [], [], ["核保", "理赔", "续保"], ["万能险", "万能账户", "结算利率"], [], ["甲乙", "乙丙"], ["ab"], ["b2"],
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = [r.w for r in df.select("i", sg.segmenter(spark)(F.col("t")).alias("w")).orderBy("i").collect()]
    for text, g, w in zip(rows, got, want, strict=True):
        assert g == w, text
    alone = sg.Segmenter(sg.TERMS, unknown="none")
    assert alone.tokens("健康保险产品的等待期不得超过90天。") == ["保", "险", "等待期", "90"]


def test_search_with_a_dictionary(spark):
    docs = spark.createDataFrame([("1", "等待期为九十天"), ("2", "犹豫期为十五天"), ("3", "退保有现金价值"), ("4", "受益人"), ("5", "核保")], "id string, t string")
    asked = spark.createDataFrame([(1, "等待期多长"), (2, "现金价值")], "q int, t string")
    how = {"id_col": "id", "text_col": "t", "query_id": "q", "query_text": "t", "k": 3}
    got = {(r.query_id, r.id) for r in rt.bm25_search(docs, asked, tokenize=sg.segmenter(spark), **how).collect()}
    assert got == {(1, "1"), (2, "3")}
    assert rt.bm25_search(docs, asked, **how).count() == 0  # without it a clause is one token


def test_keywords_in_texts(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("abc ", k=rng.randint(1, 5))) for _ in range(120)}) + ["", "abc", "abc"]
    texts = ["".join(rng.choices("abcd ", k=rng.randint(0, 60))) for _ in range(80)] + [None, ""]
    rows = [Row(n=i, keyword=w) for i, w in enumerate(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = {r.id: r.in_text for r in cp.keywords_in(df, ("text",), rows).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ([n for n, w in enumerate(words) if w in t] if t is not None else []), t
    assert {tuple(r.in_text) for r in cp.keywords_in(df, ("text",), []).collect()} == {()}


def test_rules_with_and_without_patterns(spark):
    texts = spark.createDataFrame([(1, "some risk here"), (2, "no 12 %"), (3, None), (1, "some risk here"), (4, "risk 5 %")], "id long, text string")
    rules = spark.createDataFrame(
        [("a", "high", "risk", None), ("b", "low", "risk", r"\d+ %"), ("c", "low", None, "some"), ("d", "low", None, None), ("e", "low", "12", "^x")],
        "rule string, severity string, keyword string, pattern string",
    )
    for most in (cp.BROADCAST_BYTES, 90):
        got = sorted((r.id, r.rule) for r in cp.rule_hits(texts, rules, most=most).collect())
        assert got == sorted([(1, "a"), (1, "a"), (4, "a"), (1, "b"), (1, "b"), (2, "b"), (4, "b"), (1, "c"), (1, "c"), (2, "e")])


def test_time_does_not_follow_the_number_of_keywords(spark):
    """A thousand times as many keywords take far less than a thousand times as long."""
    rng = random.Random(1)
    texts = spark.createDataFrame([(i, "".join(rng.choices("abcdefgh", k=4000))) for i in range(200)], "id int, text string").repartition(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=9))

    def seconds(n):
        rows = [Row(n=i, keyword=w) for i, w in enumerate({word() for _ in range(n)})]
        start = time.time()
        cp.keywords_in(texts, ("text",), rows).agg(F.sum(F.size("in_text"))).collect()
        return time.time() - start

    seconds(10)
    assert seconds(10_000) < 20 * seconds(10) + 2


def test_tokens_are_made_in_pieces(monkeypatch):
    texts = [None, "", *(f"a{i} 等待期" for i in range(700))]
    sizes, real = [], pa.array
    monkeypatch.setattr(sg.pa, "array", lambda x, kind: sizes.append(len(x)) or real(x, kind))
    seen = sg._in_pieces(real(texts), sg.Segmenter(sg.TERMS).tokens)
    assert max(sizes) == 256 and seen.to_pylist() == [[], [], *([f"a{i}", "等待期"] for i in range(700))]
