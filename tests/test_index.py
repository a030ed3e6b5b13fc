"""The stored lexical index against search over the texts, after any number of changes; and versions of tables of files."""

from __future__ import annotations

import os
import random
import threading
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import lexical_index as li
from tidemark.operators import retrieval as rt
from tidemark.sources import commits

KEYS = {"id_col": "id", "text_col": "text", "file_col": "file"}
SCHEMA = "id string, text string, file string, law string"


def corpus(seed, files, n=4):
    rng = random.Random(seed)
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh", "ii"] + [f"w{i}" for i in range(20)]
    return [(f"{f}-{seed}-{i}", " ".join(rng.choices(words, k=rng.randint(1, 12))), f, rng.choice(["x", "y", None])) for f in files for i in range(n)]


def answers(found):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in found.collect())


def same_as_fresh(spark, root, rows, filters=None):
    asked = spark.createDataFrame([(1, "aa bb aa w3"), (2, "cc w19 nothing"), (3, ""), (4, None)], "q int, t string")
    docs = spark.createDataFrame(rows, SCHEMA)
    how = {"query_id": "q", "query_text": "t", "k": 5, "filters": filters}
    want = answers(rt.bm25_search(docs, asked, id_col="id", text_col="text", **how))
    assert answers(li.index_search(spark, root, asked, **how)) == want
    if filters is None:
        assert answers(li.index_search(spark, root, asked, **how, broadcast_bytes=0)) == want
    if not filters:
        _, terms = rt.bm25_index(docs, "id", "text")
        fresh = {(r.term, round(r.idf, 6)) for r in rt.bm25_idf(terms, len(rows)).collect()}
        assert {(r.term, round(r.idf, 6)) for r in li.index_terms(spark, root).collect()} == fresh
    return want


def changed(spark, root, now, changes):
    return li.change_index(root, spark.createDataFrame(changes, "file string, change string"), spark.createDataFrame(now, SCHEMA), **KEYS)


def test_changes_give_what_a_fresh_index_gives(spark, tmp_path):
    root = f"{tmp_path}/index"
    rows = corpus(1, ["a", "b", "c"]) + [("empty", None, "e", None), ("blank", " ", "e", "x")]
    first = li.build_index(spark.createDataFrame(rows, SCHEMA), root, columns=("law",), buckets=4, **KEYS)
    assert first.version == 1 and same_as_fresh(spark, root, rows)
    # a goes, b has other chunks, d comes; e is left alone; a file named twice: deleted wins; unknown ones do no harm.
    rows2 = [r for r in rows if r[2] in "ce"] + corpus(2, ["b", "d"])
    stray = corpus(5, ["z"])
    changed(spark, root, rows2 + stray, [("a", "deleted"), ("a", "modified"), ("b", "modified"), ("d", "added"), ("y", "deleted")])
    assert same_as_fresh(spark, root, rows2)
    same_as_fresh(spark, root, rows2, {"law": "x"})
    same_as_fresh(spark, root, rows2, {"law": None})
    # The same ids come again with other words; then all but one file goes.
    again = [(i, t + " aa aa", f, law) for i, t, f, law in rows2 if f == "b"]
    changed(spark, root, again, [("b", "modified")])
    rows3 = [r for r in rows2 if r[2] != "b"] + again
    assert same_as_fresh(spark, root, rows3)
    compacted = li.compact_index(spark, root)
    assert compacted.version == 4 and len(li.Index(spark, root).parts) == 1 and same_as_fresh(spark, root, rows3)
    changed(spark, root, [], [(f, "deleted") for f in "acde"])
    assert same_as_fresh(spark, root, again)
    changed(spark, root, [], [("b", "deleted")])
    assert li.index_terms(spark, root).count() == 0 and not same_as_fresh(spark, root, [])
    # Older versions can still be asked.
    asked = spark.createDataFrame([(1, "aa bb")], "q int, t string")
    found = li.index_search(spark, root, asked, query_id="q", query_text="t", k=50, version=1)
    assert {r.id.split("-")[0] for r in found.collect()} <= {"a", "b", "c"} and found.count()


def test_a_search_reads_the_folders_of_its_terms(spark, tmp_path):
    root = f"{tmp_path}/index"
    li.build_index(spark.createDataFrame(corpus(3, "abcdef", 20), SCHEMA), root, buckets=16, **KEYS)
    index = li.Index(spark, root)
    terms = spark.createDataFrame([("aa",)], "term string")

    def files_read(rows):
        plan = rows._jdf.queryExecution().executedPlan()
        assert plan.executeCollect() is not None and "text" not in plan.toString()
        return plan.collectLeaves().apply(0).metrics().apply("numFiles").value()

    some, every = files_read(index.in_buckets("postings", terms)), files_read(index.table("postings"))
    assert 0 < some < every / 4


def test_no_chunks_unknown_columns_and_formats(spark, tmp_path):
    root = f"{tmp_path}/index"
    with pytest.raises(ValueError, match="no index"):
        li.Index(spark, root)
    li.build_index(spark.createDataFrame([], SCHEMA), root, **KEYS)
    assert not same_as_fresh(spark, root, [])
    with pytest.raises(ValueError, match="law"):
        same_as_fresh(spark, root, [], {"law": "x"})
    commits.commit(spark, root, lambda base, folder: {"format": "0"})
    with pytest.raises(ValueError, match="format 0"):
        li.Index(spark, root)


def test_two_changes_at_once(spark, tmp_path, monkeypatch):
    """The second writer has read the first version, loses the race, and makes its change anew."""
    root = f"{tmp_path}/index"
    rows = corpus(1, ["a", "b", "c"])
    li.build_index(spark.createDataFrame(rows, SCHEMA), root, buckets=4, **KEYS)
    one = [r for r in rows if r[2] != "a"] + corpus(7, ["d"])
    real, ran = commits._created, []

    def slow(*args):
        if not ran:
            ran.append(1)
            changed(spark, root, one, [("d", "added"), ("b", "modified")])
        return real(*args)

    monkeypatch.setattr(commits, "_created", slow)
    done = changed(spark, root, rows, [("a", "deleted")])
    assert done.version == 3 and commits.versions(spark, root) == [1, 2, 3]
    assert same_as_fresh(spark, root, one)
    assert len(os.listdir(f"{root}/data")) == 3  # what was written in vain is gone


def test_two_writers_take_two_versions(spark, tmp_path):
    root, gate, done = f"{tmp_path}/t", threading.Barrier(4), []

    def writer(n):
        def write(base, folder):
            spark.range(n).write.parquet(f"{folder}/x")
            gate.wait(60)
            return {"n": n}

        done.append(commits.commit(spark, root, write))

    threads = [threading.Thread(target=writer, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(c.version for c in done) == commits.versions(spark, root) == [1, 2, 3, 4]
    for c in done:
        assert commits.read_commit(spark, root, c.version).content == {"n": c.content["n"]}
        assert spark.read.parquet(f"{c.content['folder']}/x").count() == c.content["n"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    root = f"{tmp_path}/t"
    commits.commit(spark, root, lambda base, folder: {"a": 1})

    def broken(base, folder):
        spark.range(3).write.parquet(f"{folder}/x")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        commits.commit(spark, root, broken)
    assert commits.read_commit(spark, root) == commits.Commit(1, {"a": 1})
    assert not os.path.exists(f"{root}/data") or not os.listdir(f"{root}/data")
    assert not [f for f in os.listdir(f"{root}/commits") if not f.endswith("1.json") and not f.endswith(".crc")]
    with pytest.raises(commits.Outdated):
        commits.commit(spark, root, lambda base, folder: {}, tries=0)
    with pytest.raises(ValueError, match="no version 9"):
        commits.read_commit(spark, root, 9)


def test_another_tokenizer(spark, tmp_path):
    root = f"{tmp_path}/index"
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    li.build_index(spark.createDataFrame([("1", "甲乙", "f", None), ("2", "丙乙", "f", None), ("3", "丁", "f", None), ("4", "丁", "f", None)], SCHEMA), root, tokenize=letters, **KEYS)
    asked = spark.createDataFrame([(1, "甲")], "q int, t string")
    assert [r.id for r in li.index_search(spark, root, asked, query_id="q", query_text="t", k=3, tokenize=letters).collect()] == ["1"]


def test_words_are_counted_in_their_row_and_dealt_in_blocks():
    rng = random.Random(9)
    texts = [[], ["all"], []] + [["all", *rng.choices([f"w{i}" for i in range(400)], k=rng.randint(0, 60))] for _ in range(700)] + [["z"] * 1000, []]
    words = pa.RecordBatch.from_pydict({"id": pa.array(range(len(texts)), pa.int64()), "words": pa.array(texts, pa.list_(pa.string())), "more": pa.array(["x"] * len(texts))})
    none = words.slice(0, 0)
    counted = list(li._count_words(iter([none, words])))
    assert [b.num_rows for b in counted] == [0, len(texts)]
    assert all(dict(zip(r["terms"], r["tfs"])) == Counter(t) and r["dl"] == len(t) and r["more"] == "x" for r, t in zip(counted[1].to_pylist(), texts))
    blocks = [r for b in li._blocks(b.select(["id", "dl", "terms", "tfs"]) for b in counted) for r in b.to_pylist()]
    found = [(r["term"], *p) for r in blocks for p in zip(r["ids"], r["tfs"], r["dls"])]
    assert sorted(found) == sorted((t, i, n, len(text)) for i, text in enumerate(texts) for t, n in Counter(text).items())
    sizes = [len(r["ids"]) for r in blocks if r["term"] == "all"]
    assert max(sizes) == li.BLOCK and len(sizes) == 3
    assert len(blocks) == sum(-(-n // li.BLOCK) for n in Counter(t for t, *_ in found).values())


def test_large_batches_are_cut(monkeypatch):
    monkeypatch.setattr(li, "AT_ONCE", 100)
    texts = [[f"w{(i * j) % 50}" for j in range(i % 60)] for i in range(300)] + [["z"] * 1000, []]
    words = pa.RecordBatch.from_pydict({"id": pa.array(range(len(texts)), pa.int64()), "words": pa.array(texts, pa.list_(pa.string()))})
    counted = list(li._count_words(iter([words])))
    assert max(sum(b["dl"].to_pylist()) for b in counted if b.num_rows > 1) <= 100
    rows = [r for b in counted for r in b.to_pylist()]
    assert [r["id"] for r in rows] == list(range(len(texts))) and all(dict(zip(r["terms"], r["tfs"])) == Counter(t) for r, t in zip(rows, texts))
    made = list(li._blocks(iter([pa.Table.from_batches(counted).select(["id", "dl", "terms", "tfs"]).combine_chunks().to_batches()[0]])))
    assert max(sum(map(len, b["ids"].to_pylist())) for b in made) <= 100
    found = [(r["term"], *p) for b in made for r in b.to_pylist() for p in zip(r["ids"], r["tfs"])]
    assert sorted(found) == sorted((t, i, n) for i, text in enumerate(texts) for t, n in Counter(text).items())
