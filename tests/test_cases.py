"""Hand-made cases of relevance, product documents, chunks, names, audits and what changes over time."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import chunking as ck
from tidemark.operators import compliance as cp
from tidemark.operators import evaluation as ev
from tidemark.operators import logs as lg
from tidemark.operators import pages as pg
from tidemark.operators import quality as ql
from tidemark.operators import relevance as rl
from tidemark.operators import retrieval as rt
from tidemark.operators import state as st
from tidemark.operators.vectors import vector_search
from tidemark.plans import inputs
from tidemark.plans import pages as plans_pages
from tidemark.sources import files

HIT = "content string, source_file string, law_name string, docs array<string>, keywords array<string>, like double"


def of(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.orderBy("i").select(column(F.col("t")).alias("x")).collect()]


def test_relevance(spark):
    synonyms = {"等待期": ["观察期"]}
    cases = [
        (("等待期为九十天，犹豫期十五天", "", "", [], ["等待期", "犹豫期"], None), True),  # two of two keywords
        (("等待期为九十天", "", "", [], ["等待期", "犹豫期"], None), False),  # one of two, and no source
        (("等待期为九十天", "a.md", "", ["a.md"], ["等待期", "犹豫期"], None), True),  # file and one keyword
        (("观察期为九十天", "a.md", "", ["a.md"], ["等待期"], None), True),  # a synonym
        (("等待期为九十天", "a.md", "", ["a.md"], ["观察期"], None), True),  # the other way
        (("保险合同规定", "a.md", "", ["a.md"], ["保险", "规定", "合同"], None), False),  # general words only
        (("等待期", None, "健康保险管理办法", ["健康_保险.md"], ["等待期"], None), True),  # law name holds the document
        (("等待期", None, "保险法", ["保险.md"], ["等待期"], None), False),  # too short a name
        (("甲", "a.md", "", ["a.md"], ["甲"], None), False),  # one character
        ((None, None, None, None, None, None), False),
        (("other", "", "", [], ["等待期"], 0.75), True),
        (("other", "", "", [], ["等待期"], 0.40), False),
    ]
    df = spark.createDataFrame([c for c, _ in cases], HIT).coalesce(1)
    got = df.select(rl.relevant(*(F.col(c) for c in ("content", "source_file", "law_name", "docs", "keywords")), synonyms=synonyms, similarity=F.col("like")).alias("x")).collect()
    assert [r.x for r in got] == [w for _, w in cases]


def test_recall_and_reports(spark):
    hits = spark.createDataFrame([(1, 1.0, "aa.md", ""), (1, 1.0, "aa.md", ""), (1, 0.0, "bb.md", ""), (1, 1.0, "", "law cc act"), (2, 1.0, "x", "")], "query_id int, rel double, source_file string, law_name string")
    samples = spark.createDataFrame([(1, ["aa.md", "bb.md", "c_c.md"]), (2, ["y.md"]), (3, [])], "query_id int, docs array<string>")
    assert {r.query_id: round(r.recall, 3) for r in rl.recall(hits, samples).collect()} == {1: 0.667, 2: 0.0, 3: 0.0}
    m = spark.createDataFrame([("factual", 0.5, 1.0, 1.0, 1.0, 2), ("factual", 0.0, 0.0, 0.0, 0.0, 3), ("unanswerable", 0.0, 0.0, 0.0, 0.0, 1), ("unanswerable", 0.0, 0.0, 0.0, 0.0, 0)], "question_type string, precision double, recall double, mrr double, ndcg double, n_hits int")
    got = {r.question_type: r for r in rl.report(m).collect()}
    assert got[None].recall == 0.5 and got[None].rejection_rate == 0.5 and got[None].samples == 4 and got["unanswerable"].recall == 0 and got["factual"].rejection_rate == 0
    assert sorted(r.reason for r in rl.failures(m).collect()) == ["irrelevant", "irrelevant", "none"]
    scores = spark.createDataFrame([("f", "m", 0.5), ("f", "m", float("nan")), ("g", "m", 1.0)], "question_type string, metric string, value double")
    assert {(r.question_type, r.mean, r.n) for r in rl.judged(scores).collect()} == {(None, 0.75, 2), ("f", 0.5, 1), ("g", 1.0, 1)}


def test_new_samples(spark):
    rows = [(1, "q1", "a long answer with 等待期 in", ["等待期"]), (2, "q1", "a long answer with 等待期 in", ["等待期"]), (3, "q2", "short 等待期", ["等待期"]), (4, "q3", "a long answer without it, really", ["等待期"]), (5, "q4", "a long answer with 等待期 in", ["等待期"]), (6, "q5", "a long answer with 期 only, no more", ["期"])]
    df = spark.createDataFrame(rows, "id int, question string, answer string, keywords array<string>")
    assert [r.id for r in rl.new_samples(df, df.where("id = 5"), ["id"]).collect()] == [1]


def test_hybrid_lists_follow_each_other(spark):
    hits = "query_id int, variant int, id long, rank int"
    keyword = spark.createDataFrame([(1, 0, 10, 1), (1, 1, 11, 1)], hits)
    vector = spark.createDataFrame([(1, 0, 11, 1)], hits)
    got = {r.id: r.score for r in rt.hybrid(keyword, vector).collect()}
    assert got == {10: pytest.approx(1 / 61), 11: pytest.approx(1 / 62 + 1 / 61)}
    ranked = spark.createDataFrame([(1, True, 0.2), (2, True, 0.6), (3, False, None), (4, None, 0.1)], "id int, reranked boolean, rerank_score double")
    assert {r.id for r in rt.rerank_threshold(ranked, 0.5).collect()} == {2, 3, 4} and rt.rerank_threshold(ranked, 0).count() == 4


def test_vector_search_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(20)] + [(50, None, 0), (51, [0.0, 0.0], 0), (52, [1.0], 0)], "id long, v array<float>, grp int")
    got = [(r.query_id, r.id) for r in vector_search(rows, rows.where("id in (4, 19)"), k=2, kind="l2", row_block=3, query_block=1).orderBy("query_id", "rank").collect()]
    assert got == [(4, 3), (4, 5), (19, 18), (19, 17)]
    got = [(r.query_id, r.id) for r in vector_search(rows, rows.where("id = 4"), k=2, kind="l2", grouped=True).orderBy("rank").collect()]
    assert got == [(4, 2), (4, 6)]


def test_bm25_filter(spark):
    docs = spark.createDataFrame([(1, "red fox", "a"), (2, "red fox", "b"), (3, "x y", "a"), (4, "zz top", None)], "id int, t string, law string")
    q = spark.createDataFrame([(9, "fox")], "q int, t string")
    args = {"id_col": "id", "text_col": "t", "query_id": "q", "query_text": "t", "k": 5}
    both = {r.id: r.score for r in rt.bm25_search(docs, q, **args).collect()}
    one = {r.id: r.score for r in rt.bm25_search(docs, q, filters={"law": "b"}, **args).collect()}
    assert one == {k: v for k, v in both.items() if k == 2}  # statistics of all chunks


def test_lines_of_product_documents(spark):
    assert of(spark, pg.is_page_number, "第 3 页", "Page 7", "9 / 18", "9 18", "共 20 页", "plain") == [True] * 5 + [False]
    assert of(spark, pg.is_chapter, "7. 其他事项", "其他事项说明", "关于" * 9 + "名词释义") == [True, False, False]
    pairs = of(spark, pg.title_and_body, "被保险人范围 凡出生满28天", "标题\n正文\n二", "《标准》是由某部门发布", "没有空格的标题", "", "这是一句话。 后文", "一" * 26 + " 后文")
    assert [tuple(p) for p in pairs] == [("被保险人范围", "凡出生满28天"), ("标题", "正文\n二"), ("《标准》", "是由某部门发布"), ("没有空格的标题", ""), ("", ""), ("这是一句话。 后文", ""), ("一" * 26 + " 后文", "")]
    kinds = of(spark, pg.section_type, "2.6 责任免除", "2 保险责任及责任免除", "健康告知事项", "4 其他免责条款", "3.1 附加险条款 说明", "正文", "", "我们的责任免除如下，请您仔细阅读本条款中的全部内容")
    assert kinds == ["exclusion", None, "health_disclosure", "exclusion", "rider", None, None, None]
    lines = ["封面", "条款目录", "1.1 投保范围", "2．保险责任", "随便一行", "1.1 投保范围 凡投保本险", "1.2 短标题"]
    df = spark.createDataFrame([("d", 0, i, t) for i, t in enumerate(lines)] + [("d", 5, 9, "目录"), ("d", 5, 10, "1.1 投保")], "doc string, page int, n int, text string")
    assert [r.n for r in pg.without_contents(df, ["doc"], "n", "page").orderBy("n").collect()] == [0, 4, 5, 6, 9, 10]
    margins = spark.createDataFrame([(10.0, 800.0, "内部资料"), (400.0, 800.0, "内部资料"), (790.0, 800.0, "page 3"), (790.0, 800.0, "end"), (5.0, 800.0, " ")], "top double, page_height double, text string")
    assert sorted((r.top, r.text) for r in pg.without_margins(margins).collect()) == [(400.0, "内部资料"), (790.0, "end")]
    chars = [("a", 0.0, 5.0, 9.0), ("b", 5.0, 5.0, 7.5), ("c", 20.0, 5.0, 8.2), ("z", 0.0, 5.0, 30.0)]
    df = spark.createDataFrame([("d", *c) for c in chars], "doc string, text string, x0 double, width double, top double")
    assert [(r.top, r.text) for r in pg.lines_of_characters(df, ["doc"]).orderBy("top").collect()] == [(8.0, "ab c"), (32.0, "z")]


def test_tables(spark):
    assert of(spark, pg.table_type, "产品名称 药品", "药品", "附表一", "保障计划", "费率", "x") == ["gene_test", "drug_list", "appendix", "coverage", "premium", "other"]
    rows = lambda h: [[h, "b"], ["1", "2"]]
    data = [(1, 1, 500.0, "", "", rows("费率")), (2, 2, 20.0, "", "", rows("x")), (3, 3, 30.0, "", "", rows("y")), (4, 3, 400.0, "附表二", "", rows("z")), (5, 4, 400.0, "", "见附表", rows("q")), (6, 4, 500.0, "", "附录", rows("q")), (7, 5, 500.0, "", "", [["a", "b"], ["Ⅱ期", ""]]), (8, 5, 600.0, "", "", [["a", "b"]]), (9, 5, 700.0, "", "", [["a", " "], ["1", "2"]])]
    df = spark.createDataFrame([("d", *r[:3], 800.0, *r[3:]) for r in data], "doc string, n int, page int, top double, page_height double, title string, around string, rows array<array<string>>")
    got = {r.n: (r.kind, r.continues) for r in pg.typed_tables(pg.real_tables(df), "doc", ["n"]).collect()}
    assert got == {1: ("premium", False), 2: ("premium", True), 3: ("premium", True), 4: ("appendix", False), 5: ("other", False), 6: ("appendix", False), 7: ("appendix", False)}


def test_headings_of_all_families(spark):
    plain = "第一条 总则\n1.2.3 深\n（一）括号\n一、中文\n12\n1没有\n正文"
    df = spark.createDataFrame([(1, plain), (2, "# 标题\n第一条 总则\n## 二")], "id int, t string")
    got = {(r.id, r.line_no): r.level for r in ck.headings(ck.lines(df, "id", "t")).where("level is not null").collect()}
    assert got == {(1, 0): 1, (1, 1): 3, (1, 2): 2, (1, 3): 2, (1, 4): 1, (2, 0): 1, (2, 2): 2}


def test_sentence_chunks_and_merges(spark):
    df = spark.createDataFrame([(1, "一二。三四。五六七八九。十"), (2, ""), (3, None), (4, "x" * 30)], "id int, t string")
    got = [(r.id, r.chunk, r.content) for r in ck.sentence_chunks(df, "id", "t", limit=6, overlap=2, least=3, force=25).orderBy("id", "chunk").collect()]
    assert got[:3] == [(1, 0, "一二。三四。"), (1, 1, "五六七八九。"), (1, 2, "十")]
    assert [c for i, _, c in got if i == 4] == ["x" * 6] * 7  # every fourth character from 0 on; the last two are too short
    chunks = spark.createDataFrame([(1, 0, "如下："), (1, 1, "甲"), (1, 2, "乙"), (1, 3, "但是丙"), (1, 4, "（1）丁"), (2, 0, "only")], "id int, chunk int, content string")
    got = [(r.id, r.content) for r in ck.merged_neighbours(chunks, limit=8).orderBy("id", "chunk").collect()]
    assert got == [(1, "如下：\n\n甲"), (1, "乙\n\n但是丙\n\n（1）丁"), (2, "only")]
    assert [r.content for r in ck.merged_neighbours(chunks.where("id = 1"), limit=6).orderBy("chunk").collect()] == ["如下：\n\n甲", "乙\n\n但是丙", "（1）丁"]


def test_names_and_numbers(spark):
    assert [tuple(r) for r in of(spark, tx.age_range, "0-60岁", "18 到 65", "90天", "none", None)] == [(0, 60), (18, 65), (90, 90), (None, None), (None, None)]
    keys = of(spark, tx.article_key, "第12条", "第二十条", "第三项", "附则", "第一百零三条")
    assert [tuple(k) for k in keys] == [(0, 12, None), (0, 30, None), (0, 3, None), (1, None, "附则"), (1, None, "第一百零三条")]
    names = of(spark, tx.regulation_name, "中国保监会关于规范人身保险的通知（保监发〔2016〕76号）", "国家金融监督管理总局人身险司 办法", "2020年第7号")
    assert names == ["关于规范人身保险的通知", "办法", "2020年第7号"]
    files = of(spark, tx.file_name, "a / b: “c”?", "险 & 法", "字" * 100)
    assert files[1:] == ["险&法", "字" * 80] and "/" not in files[0] and ":" not in files[0]


def test_audited_documents(spark):
    text = "".join(f"【条款 1.{i}】a\nb\n\n" for i in range(5)) + "".join(f"【附加险条款 10.{i}】a\n" for i in range(12)) + "【投保须知】x【数据表 1】"
    x = of(spark, cp.document_parts, text, "no marks", "【条款 2.1】")
    assert len(x[0].all_clauses) == 17 and x[0].definition_chapter == "10" and x[0].clauses == [f"1.{i}" for i in range(5)]
    assert (x[0].has_notices, x[0].has_health, x[0].has_exclusions, x[0].has_tables) == (True, False, False, True)
    assert x[1].all_clauses == [] and x[1].definition_chapter is None and x[2].clauses == ["2.1"]
    article = spark.createDataFrame([("第十二条 内容", "f"), ("内容第三条", "f")], "a string, b string").select(cp.article_number(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in article] == ["第十二条", "f"]
    raw = spark.createDataFrame([(1, "条款 2.3(1)", "c", None, "R1", None, "x"), (2, None, "c", "compliant", None, "s", None), (3, "1", "", None, "R1", None, None)], "i int, clause_number string, clause_content string, status string, source_ref string, suggestion string, conclusion string")
    refs = spark.createDataFrame([("R1", "k")], "source_ref string, chunk_id string")
    got = {r.i: r for r in cp.normal_violations(raw, refs, "neg").collect()}
    assert set(got) == {1, 2} and (got[1].clause_number, got[1].status, got[1].chunk_id, got[1].suggestion) == ("2.3(1)", "non_compliant", "k", "")
    assert (got[2].clause_number, got[2].status, got[2].chunk_id, got[2].source_ref) == ("未知", "compliant", None, "")
    parts = spark.createDataFrame([(1, 3, "rider", "9.1", "r", "t3"), (1, 1, "table", None, "", "t1"), (1, 2, "clause", "1.1", "c", "t2"), (1, 4, "table", None, "", "t4"), (1, 5, "other", "", "", "")], "doc int, n int, kind string, number string, title string, text string")
    assert cp.combined_text(parts, "doc", "n").first().text == "【条款 1.1】c\nt2\n\n【数据表 1】\nt1\n\n【数据表 2】\nt4\n\n【附加险条款 9.1】r\nt3"
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["short", "long enough to keep", "x" * 10_050, "bad\x01\x02\x03 control characters"])], "d int, n int, t string")
    assert sorted(len(r.t) for r in cp.normal_clauses(rows, "d", "n", "t").collect()) == [19, 10_000]


def test_feedback(spark):
    messages = spark.createDataFrame([("s", 1, "user", "q1", None), ("s", 2, "assistant", "a1", ["b.md", "", "a.md", "b.md"]), ("s", 3, "user", "q2", None), ("s", 4, "assistant", "a2", None), ("t", 5, "assistant", "a3", None)], "session_id string, message_id int, role string, content string, sources array<string>")
    feedback = spark.createDataFrame([(1, "s", 2, "down", "pending"), (2, "s", 4, "up", "pending"), (3, "s", 4, "down", "fixed"), (4, "t", 5, "down", "pending"), (5, "s", 99, "down", "pending"), (6, "s", 99, "up", "pending")], "feedback_id int, session_id string, message_id int, rating string, status string")
    got = {r.feedback_id: (r.state, r.question) for r in st.triaged(feedback, messages).collect()}
    assert got == {1: ("to_classify", "q1"), 2: ("rejected", "q2"), 4: ("to_classify", ""), 6: ("rejected", None)}
    cases = st.triaged(feedback, messages).where("state = 'to_classify'").withColumn("correction", F.lit(None).cast("string")).withColumn("kind", F.lit(""))
    assert [tuple(r) for r in st.badcase_samples(cases).collect()] == [("bc_1", "q1", "", ["a.md", "b.md"], "factual")]


def test_entities_and_triggers(spark):
    found = of(spark, lambda t: st.entities(t, {"life": ("寿险", "终身"), "health": ("医疗",)}, ("平安", "泰康")), "平安的终身寿险和医疗", "nothing")
    assert found == [["医疗", "寿险", "平安"], []]
    df = spark.createDataFrame([("等待期", None, 1), ("平安", None, 1), ("say x", ["x"], 1), ("topic", None, 1), ("hm", None, None), ("hm", None, 70), ("hm", None, 5)], "t string, known array<string>, idle int").coalesce(1)
    why, sure = st.trigger(F.col("t"), ("等待期",), ("平安",), F.col("known"), ("topic",), F.col("idle"))
    got = [(r.w, r.s) for r in df.select(why.alias("w"), sure.alias("s")).collect()]
    assert got == [("keyword", 0.9), ("company", 0.85), ("entity", 0.7), ("topic", 0.6), ("interval", 0.5), ("interval", 0.5), ("skip", 0.0)]


def test_versions_calls_and_memories(spark):
    versions = spark.createDataFrame([("g", "v1", True), ("h", "v1", True)], "group string, version string, active boolean")
    changes = spark.createDataFrame([("g", 1, "create", "v2"), ("g", 2, "delete", "v2"), ("g", 3, "activate", "v9"), ("g", 4, "activate", "v1"), ("g", 5, "delete", "v2"), ("g", 6, "activate", "v2")], "group string, seq int, action string, version string")
    assert {tuple(r) for r in st.versions_after(versions, changes).collect()} == {("g", "v1", True), ("h", "v1", True)}
    calls = spark.createDataFrame([("a", i, i == 0, float(i)) for i in range(4)], "k string, t int, bad boolean, ms double")
    assert [tuple(r) for r in st.call_stats(calls, "k", ["t"], F.col("bad"), "ms", last=2).collect()] == [("a", 4, 1, 0.75, 2.5)]
    days = spark.createDataFrame([("2024-01-01", "2024-03-01", 0), ("2024-02-20", "2024-02-20", 0), ("2023-12-01", "2023-12-01", 0), ("2023-12-01", "2023-12-01", 3)], "a string, b string, n int").coalesce(1)
    state = lambda **k: [r.x for r in days.select(lg.memory_state(F.col("a").cast("date"), F.col("b").cast("date"), F.col("n"), F.lit("2024-03-02").cast("date"), **k).alias("x")).collect()]
    assert state() == ["expired", "live", "expired", "expired"] and state(ttl_days=0) == ["live", "live", "unused", "live"]


def test_small_ones(spark):
    assert of(spark, st.tokens_of, "abcdefghi", "", None) == [["abcd", "efgh", "i"], [], []]
    assert of(spark, lambda t: st.decoded(t, "array<string>"), '["a"]', "bad", None) == [["a"], [], []]
    docs = spark.createDataFrame([("a_b.md",), ("zz.md",), (".md",)], "doc string")
    hits = spark.createDataFrame([(1, "a_b.md"), (2, "the ab act"), (3, "none"), (4, None)], "hit int, source string")
    assert {tuple(r) for r in st.contained(docs, hits).collect()} == {("a_b.md", 1), ("a_b.md", 2)}
    f = st.frequencies(spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "b"), ("x", None)], "k string, v string"), "k", "v").first()
    assert f.counts == {"a": 1, "b": 2}


def test_audit_and_near_questions(spark):
    q = spark.createDataFrame([(i, list(w)) for i, w in enumerate(["abcdefghij", "abcdefghi", "abcdefgh", "xyz", "", "abcdefghijk"])], "id int, words array<string>")
    assert {tuple(r) for r in ev.near_questions(q).collect()} == {(0, 1), (0, 5), (1, 2), (1, 5)}
    rows = [(1, "what is it", "a", ["d"], ["word"], "t", "factual"), (2, " ", None, None, [], "", "factual"), (3, "what is it", "a", [], ["x", "保险"], "t", "unanswerable")]
    df = spark.createDataFrame(rows, "id int, question string, answer string, docs array<string>, keywords array<string>, topic string, question_type string")
    got = {(r.id, r.issue) for r in ev.audit(df, rl.GENERIC).collect()}
    assert got == {(2, "empty_question"), (2, "empty_answer"), (2, "no_evidence_docs"), (2, "no_evidence_keywords"), (2, "missing_topic"), (3, "keyword_too_short"), (3, "generic_keyword"), (3, "duplicate_question")}


def test_copies_of_questions_are_counted_without_their_pairs(spark):
    # 20,000 questions with one of two sets that are alike: 200 million pairs.
    words = F.when(F.col("id") % 2 == 0, F.split(F.lit("a b c d e f g h i j"), " ")).otherwise(F.split(F.lit("a b c d e f g h i"), " "))
    got = {r.id: r.n for r in ev.earlier_questions(spark.range(20000).select("id", words.alias("words"))).collect()}
    assert got == {i: i for i in range(1, 20000)}
    rows = [(i, list(w)) for i, w in ((1, "abcdefghij"), (2, "abcdefghi"), (2, "abcdefghi"), (3, "abcdefgh"), (4, "xyz"), (5, ""), (5, "abcdefghijk"))]
    q = spark.createDataFrame(rows, "id int, words array<string>")
    pairs = [r.b for r in ev.near_questions(q).collect()]
    assert {r.id: r.n for r in ev.earlier_questions(q).collect()} == {i: pairs.count(i) for i in set(pairs)} == {2: 2, 3: 2, 5: 3}


def test_depths(spark):
    chain = [(i, i - 1) for i in range(1, 41)] + [(0, None)]
    rows = [*chain, (100, 100), (101, 100), (200, 201), (201, 200), (202, 201), (300, 999)]
    got = {r.id: r.depth for r in lg.depths(spark.createDataFrame(rows, "i long, p long"), "i", "p").collect()}
    assert got == {**{i: i for i in range(41)}, 100: 0, 101: 1, 300: 0}


def test_datasets_and_deletes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, question string")
    files.save_samples(df, f"{tmp_path}/d")
    assert {tuple(r) for r in spark.read.schema("id int, question string").json(f"{tmp_path}/d/samples").collect()} == {(1, "a"), (2, "b")}
    assert spark.read.json(f"{tmp_path}/d/total").first().total == 2
    for _ in range(2):
        files.append_rows(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    left, (children,) = files.without_parents(df, [df.unionByName(df)], df.where("id = 1"), "id")
    assert left.count() == 1 and children.count() == 2
    (tmp_path / "one.md").write_text("# x", encoding="utf-8")
    assert [r.text for r in files.read_markdown(spark, f"{tmp_path}/one.md").collect()] == ["# x"]


def test_section_paths(spark):
    """Against a stack that is folded over the headings."""
    rng = random.Random(12)
    rows = [(d, n, f"h{d}.{n}", rng.choice([None, 1, 1, 2, 2, 3, 4, 40])) for d in range(12) for n in range(rng.randint(0, 30))]
    want = {}
    for d in range(12):
        stack, n = [], 0
        for _, _, line, level in (r for r in rows if r[0] == d):
            if level is None:
                continue
            level = min(level, 6)
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, line))
            n += 1
            want[d, n] = [x for _, x in stack]
    marked = spark.createDataFrame(rows, "id int, line_no int, line string, level int").repartition(4)
    assert {(r.id, r.section): r.path for r in ck.section_paths(marked, deepest=6).collect()} == want


def test_build_figures(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", True), (4, "d", None)], "id int, text string, ok boolean").repartition(3)
    whole = lambda d: d
    got = ql.build_figures(rows, f"{tmp_path}/a", "ok", "id", {"vector": whole, "words": lambda d: d.select("id")}).first()
    assert got.asDict() == {"parsed": 4, "passed": 2, "vector": 2, "words": 2, "consistent": True}
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/a/words").collect()) == [1, 3]
    for other in (lambda d: d.where("id < 3"), lambda d: d.withColumn("id", F.col("id") + 1)):
        assert not ql.build_figures(rows, f"{tmp_path}/b", "ok", "id", {"vector": whole, "words": other}).first().consistent
    none = ql.build_figures(rows.limit(0), f"{tmp_path}/c", "ok", "id", {"vector": whole}).first()
    assert (none.parsed, none.passed, none.vector, none.consistent) == (0, 0, 0, True)


def test_lines_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    """One sort holds a bounded number of lines: the statement's rows are dealt in tasks of that size, and only once."""
    monkeypatch.setattr(inputs, "ROWS_PER_TASK", 200)
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    found = plans_pages.without_contents(spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\((\w+)#\d+L?, (\d+)\)", plan) == [("l_orderkey", str(-(-n // 200)))]
    monkeypatch.undo()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plans_pages.without_contents(spark, sf_dir).collect()))


def test_section_words_are_looked_for_before_patterns(spark):
    lines = ["2.6 责任免除", "责任免除条款说明", "1.1 投保范围", "x 健康告知", "3.1 附加险条款 说明", "3.2 说明 附加险条款", None, "", " 健康告知 "]
    kind = pg.section_type(F.col("t"))
    got = [r.kind for r in spark.createDataFrame([(x,) for x in lines], "t string").coalesce(1).select(kind.alias("kind")).collect()]
    assert got == ["exclusion", "exclusion", None, "health_disclosure", "rider", None, None, None, "health_disclosure"]
    words = {w for _, ws in pg.SECTIONS for w in ws}
    plan = spark.createDataFrame([("",)], "t string").select(kind)._jdf.queryExecution().analyzed().toString()
    assert all(re.search(rf"Contains\(trim\(t#\d+, None\), {w}\)|contains\(trim\(t#\d+\), {w}\)", plan, re.I) for w in words)
