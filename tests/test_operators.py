"""Operators by hand-made cases."""

from __future__ import annotations

import hashlib
import io
import math
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import chunking as ck
from tidemark.operators import compliance as cp
from tidemark.operators import evaluation as ev
from tidemark.operators import logs as lg
from tidemark.operators import quality as ql
from tidemark.operators import retrieval as rt
from tidemark.sources import files, html


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column.alias("x")).first().x


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red red fox"), (2, "red dog"), (3, "blue cat sat"), (4, "")], "id int, t string")
    q = spark.createDataFrame([(9, "red fox")], "q int, t string")
    got = {r.id: r.score for r in rt.bm25_search(docs, q, id_col="id", text_col="t", query_id="q", query_text="t", k=5).collect()}
    idf = {"red": math.log(2.5) - math.log(2.5), "fox": math.log(3.5) - math.log(1.5)}
    length = 1.5 * (0.25 + 0.75 * 3 / 2)
    assert got == {1: pytest.approx(idf["red"] * 2 * 2.5 / (2 + length) + idf["fox"] * 2.5 / (1 + length))}


def test_search_deals_chunks_and_not_words(spark, monkeypatch):
    """Words meet the queries where their chunk is, in as many tasks as there are words; over the bytes of a broadcast, by term."""
    monkeypatch.setattr(rt, "WORDS_PER_TASK", 2)
    docs = spark.createDataFrame([(1, "red red fox"), (1, "red fox red"), (1, "red"), (2, "red dog"), (3, "blue cat sat"), (4, ""), (None, "fox")], "id int, t string")
    q = spark.createDataFrame([(9, "red fox fox"), (8, "sat blue none"), (7, None)], "q int, t string")
    how = {"id_col": "id", "text_col": "t", "query_id": "q", "query_text": "t", "k": 5}
    found = rt.bm25_search(docs, q, **how)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and re.search(r"hashpartitioning\(id#\d+, 7\)", plan)
    rows = sorted(map(tuple, found.select("query_id", "rank", "id", F.round("score", 9)).collect()))
    assert [r[:3] for r in rows][-1] == (9, 3, 2) and {r[2] for r in rows} == {None, 1, 2, 3}
    assert rows == sorted(map(tuple, rt.bm25_search(docs, q, broadcast_bytes=0, **how).select("query_id", "rank", "id", F.round("score", 9)).collect()))


def test_fusion_cap_and_gate(spark):
    hits = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "b"), (2, 0, 1, "c")], "query_id int, list int, rank int, id string")
    fused = rt.reciprocal_rank_fusion(hits)
    got = {(r.query_id, r.id): r.score for r in fused.collect()}
    assert got[1, "b"] == pytest.approx(1 / 62 + 1 / 61) and got[2, "c"] == pytest.approx(1 / 61)
    assert {r.query_id for r in rt.gate(fused, 0.02).collect()} == {1}
    capped = rt.cap_per_group(fused.withColumn("law", F.lit("x")), ["law"], 1)
    assert {(r.query_id, r.id) for r in capped.collect()} == {(1, "b"), (2, "c")}
    assert rt.cap_per_group(fused, [], 0).count() == 3


def test_permutation_and_numbers(spark):
    assert one(spark, tx.permutation(F.col("a"), F.lit(4)), a="[3] then 9, 3, 1") == [3, 1, 2, 4]
    assert one(spark, tx.first_int(F.col("a")), a="within 90 days") == 90
    assert one(spark, tx.first_int(F.col("a")), a="none") is None


def test_jaccard_and_bigrams(spark):
    assert one(spark, tx.bigrams(tx.tokens(F.col("a"))), a="one") == []
    assert one(spark, tx.bigrams(tx.tokens(F.col("a"))), a="one two three") == ["onetwo", "twothree"]
    assert one(spark, tx.jaccard(tx.tokens(F.col("a")), tx.tokens(F.col("b"))), a="", b="x yy") == 0
    assert one(spark, tx.jaccard(tx.tokens(F.col("a")), tx.tokens(F.col("b"))), a="xx yy", b="yy zz") == pytest.approx(1 / 3)


def test_greedy_pack(spark):
    parts = spark.createDataFrame([(["aaaa", "bbbb", "c" * 30, "d"],), ([],)], "p array<string>")
    got = [r.x for r in parts.select(ck.greedy_pack(F.col("p"), 10, "--").alias("x")).collect()]
    assert got == [["aaaa--bbbb", "c" * 30, "d"], []]


def test_sections_drop_what_comes_before_the_first_heading(spark):
    d = spark.createDataFrame([(1, "x\n# A\na\n## B\nb\nc"), (2, "no heading")], "id int, t string")
    got = [(r.section, r.heading, r.content) for r in ck.sections(ck.headings(ck.lines(d, "id", "t"))).orderBy("section").collect()]
    assert got == [(1, "# A", "a"), (2, "## B", "b\nc")]


def test_ndcg_and_zero_rows(spark):
    hits = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0), (1, 3, 1.0)], "query_id int, rank int, rel double")
    samples = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r.query_id: r for r in ev.rank_metrics(hits, samples).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got[1].ndcg == pytest.approx((1 / math.log2(3) + 1 / 2) / ideal) and got[1].mrr == 0.5
    assert (got[2].precision, got[2].mrr, got[2].ndcg, got[2].n_hits) == (0, 0, 0, 0)


def test_attribution(spark):
    english = (r"\[source (\d+)\]", r"\d|must")
    assert one(spark, ev.cited(F.col("a"), english[0]), a="x [source 2] y [source 2]") == [2, 2]
    assert one(spark, ev.unsupported(F.col("a"), *english), a="x must [source 1] then it must be") == "then it must be"
    assert one(spark, ev.unsupported(F.col("a"), *english), a="x [source 1] must be 90") is None
    assert one(spark, ev.unsupported(F.col("a"), *english), a="hello there") is None
    assert one(spark, ev.cited(F.col("a")), a="等待期90天[来源2]，犹豫期[来源10]") == [2, 10]
    assert one(spark, ev.unsupported(F.col("a")), a="等待期90天[来源1]保险人必须赔付损失") == "保险人必须赔付损失"
    assert one(spark, ev.unsupported(F.col("a")), a="等待期为90天") == "等待期为90天"
    assert one(spark, ev.unsupported(F.col("a")), a="您好") is None
    got = spark.createDataFrame([("等待期90天，比例80%，保额5万元", ["等待期 90 天", "比例 70％"]), ("80%", [])], "a string, s array<string>").select(ev.mismatches(F.col("a"), F.col("s")).alias("x")).collect()
    assert [sorted(r.x) for r in got] == [["5", "80"], []]
    same = one(spark, ev.faithfulness(F.col("a"), F.col("b")), a="the cat sat down. it was red.", b="the cat sat down. it was red.")
    assert same == pytest.approx(1.0)


def test_quality(spark):
    assert one(spark, ql.front_matter_issues(F.col("a"), ("k",)), a="---\nk: 1") == ["error:unterminated"]
    assert one(spark, ql.front_matter_issues(F.col("a"), ("k", "l")), a="---\nk: 1\n---\nx") == ["warning:missing:l"]
    assert one(spark, ql.content_issues(F.col("a")), a="a" * 60) == ["info:uniform"]
    assert one(spark, ql.garbled(F.col("a")), a="x\x01") is True


def test_breaker(spark):
    calls = spark.createDataFrame([("s", t, bad) for t, bad in [(0, True), (1, True), (2, True), (30, False), (70, False), (71, False)]], "s string, t long, bad boolean")
    got = [r.state for r in lg.breaker_states(calls, "s", "t", F.col("bad"), 3, 60).orderBy("t").collect()]
    assert got == ["closed", "closed", "open", "open", "half_open", "closed"]


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, made int")
    new = spark.createDataFrame([(2, "B", 9), (3, "c", 9)], "k int, v string, made int")
    got = {r.k: (r.v, r.made) for r in lg.upsert(old, new, "k", ("made",)).collect()}
    assert got == {1: ("a", 1), 2: ("B", 1), 3: ("c", 9)}
    null = lg.upsert(old, spark.createDataFrame([(2, None, 9)], "k int, v string, made int"), "k", ("made",)).where("k = 2").first()
    assert (null.v, null.made) == (None, 1)
    assert lg.insert_ignore(old, new.unionByName(new), "k", ["made"]).count() == 3


def test_ndjson(spark):
    f = spark.createDataFrame([(1, 1, '{"a"'), (1, 2, ': 1}\n\n[]\n{bad\n{"b": 2}')], "s int, n int, f string")
    assert [r.record for r in cp.ndjson(f, "s", "n", "f").collect()] == ['{"a": 1}', '{"b": 2}']


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# hé", encoding="utf-8")
    (tmp_path / "y.md").write_bytes("条款".encode("gbk"))
    (tmp_path / "z.md").write_text("  ")
    got = {r.file_name: r.text for r in files.read_markdown(spark, str(tmp_path)).collect()}
    assert got == {"x.md": "# hé", "y.md": "条款"}


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    rows = "".join(f"<w:tr>{cell(f'1.{i}')}{cell(f'Title {i}: text')}</w:tr>" for i in range(6))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Intro</w:t></w:r></w:p><w:tbl>{rows}</w:tbl></w:body></w:document>")
    (tmp_path / "d.docx").write_bytes(raw.getvalue())
    got = files.read_docx(spark, str(tmp_path))
    assert got.where("kind = 'row'").count() == 6
    clauses = files.clauses_of(got).orderBy("n").collect()
    assert [c.number for c in clauses] == [f"1.{i}" for i in range(6)] and clauses[0].title == "Title 0"


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "kb")
    df = spark.createDataFrame([("b",), ("a",)], "id string")
    assert [files.write_snapshot(df, root, "id"), files.write_snapshot(df.limit(0), root, "id")] == [1, 2]
    prints = {r.version: r.fingerprint for r in files.read_manifest(spark, root).collect()}
    assert len(prints[1]) == 12 and prints[2] == "empty"
    assert files.read_snapshot(spark, root, 1).count() == 2
    with pytest.raises(ValueError):
        files.read_snapshot(spark, root, 7)
    assert files.read_snapshot(spark, root).count() == 0
    with pytest.raises(ValueError):
        files.read_snapshot(spark, root + "/none")
    rows = spark.createDataFrame([(None, i) for i in range(30)] + [("b", 10), ("b", 9), ("a", None), ("b", 100)], "k string, i int").repartition(4)
    digest = lambda ids: hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()[:12]
    assert set(map(tuple, files.fingerprints(rows, "k", "i").collect())) == {(None, digest(range(30))), ("b", digest([10, 9, 100]))}


def test_html_tables_and_paragraphs(spark):
    page = "<h1>T &amp; t</h1><p>one<b> two</b><p>three<table><tr><td>a<td>b<tr><td>c</table><script>x</script>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [r.text for r in html.paragraphs(df).orderBy("n").collect()] == ["T & t", "one two", "three", "a", "b", "c"]
    assert [r.cells for r in html.tables(df).orderBy("row_no").collect()] == [["a", "b"], ["c"]]


def test_rules_in_blocks(spark):
    texts = spark.createDataFrame([(1, "late fee due"), (2, "no words"), (3, None), (4, "fee 12 x")], "id long, text string")
    rules = spark.createDataFrame([(f"r{i}", "low", k, r"\d\d") for i, k in enumerate(["fee", "late", "zz", "", "fee"])], "rule string, severity string, keyword string, pattern string")
    got = lambda **x: sorted(map(tuple, cp.rule_hits(texts, rules, **x).collect()))
    assert len(cp.broadcast_blocks(rules, 100)) > 1
    assert len(cp.broadcast_blocks(rules)) == 1 == len(cp.broadcast_blocks(rules.limit(0)))
    want = [(1, "r0"), (1, "r1"), (1, "r3"), (1, "r4"), (2, "r3"), *((4, f"r{i}") for i in range(5))]
    assert got() == got(most=100) == [(i, r, "low") for i, r in want]
    words = spark.createDataFrame([("a", 0, "fee"), ("b", 1, "late"), ("a", 0, "x")], "category string, cat_pos int, keyword string")
    scored = lambda **x: sorted(map(tuple, cp.classify(texts, words, "id", "text", "text", **x).collect()))
    assert scored() == scored(most=80) == [(1, "b", 12.0), (4, "a", 12.0)]
    with pytest.raises(ValueError, match="blocks"):
        cp.broadcast_blocks(rules, 10)


def test_rows_of_few_keys_are_numbered_in_ranges(spark, monkeypatch):
    """As a window over each key would, but no task sorts a whole key."""
    monkeypatch.setattr(ck, "ROWS_PER_TASK", 50)
    rows = spark.range(1000).selectExpr("case when id % 5 < 3 then 'a' when id % 5 = 3 then 'b' end k", "id * 7919 % 1000 x", "id % 3 y", "id").repartition(6)
    got = ck.numbered(rows, "k", ["x", "y"], keep=("id",))
    assert got.select(F.col("id")).distinct().count() == 1000 and len(got.inputFiles()) >= 15
    plain = rows.selectExpr("k", "id", "row_number() over (partition by k order by x, y) i")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert ck.numbered(rows.limit(0), "k", ["x"]).count() == 0
