"""Vector search, exact and by cells, against plain numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import vectors as vs
from tidemark.plans import retrieval


def plain(rows, queries, k, grouped=False):
    out = []
    for q, w, g in queries:
        scored = []
        for i, v, h in rows:
            if i != q and len(v) == len(w) and (not grouped or g == h):
                n = np.linalg.norm(v) * np.linalg.norm(w)
                scored.append((-round(float(np.dot(v, w) / n) if n else 0.0, 9), i))
        out += [(q, i, r + 1) for r, (_, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows = [(i, [round(float(x), 3) for x in rng.normal(size=3 if i % 7 else 5)], i % 3 if i % 4 else None) for i in range(60)]
    return rows + [(100, rows[5][1], 1), (101, rows[5][1], 1), (102, [0.0, 0.0, 0.0], 2)]


def table(spark, rows, parts):
    return spark.createDataFrame(rows, "id long, v array<double>, grp int").repartition(parts)


def hits(found):
    return sorted((r.query_id, r.id, r.rank) for r in found.collect())


@pytest.mark.parametrize("parts", [1, 2, 5])
@pytest.mark.parametrize("grouped", [False, True])
def test_lengths_mix(spark, vectors, parts, grouped):
    asked = [r for r in vectors if r[0] % 5 == 0]
    odd = [(200, None, 1), (201, [1.0, None, 2.0], 1), (202, [1.0, float("nan"), 2.0], 1), (203, [], 1), (204, [float("inf"), 0.0, 1.0], 1)]
    got = vs.vector_search(table(spark, vectors + odd, parts), table(spark, asked + odd + [(300, [1.0] * 9, 1)], parts), k=4, grouped=grouped, row_block=8, query_block=3)
    assert hits(got) == plain(vectors, asked, 4, grouped)


def test_best_of_ties():
    scores, ids = np.array([[1.0, 0.5, 0.5, 0.5, 2.0], [0.0, 0.0, 0.0, 0.0, 0.0]]), np.array([9, 8, 3, 5, 1])
    every = np.ones((2, 5), bool)
    top = lambda allowed, k: [ids[r[q == n]].tolist() for q, r in [vs._best(scores, ids, allowed, k)] for n in (0, 1)]
    assert top(every, 3) == [[1, 9, 3], [1, 3, 5]] and top(every, 9) == [[1, 9, 3, 5, 8], [1, 3, 5, 8, 9]]
    assert top(every & (ids != 1), 2) == [[9, 3], [3, 5]] and top(~every, 2) == [[], []]


def test_index_with_all_cells_is_exact(spark, vectors, tmp_path):
    rows = [r for r in vectors if len(r[1]) == 3]
    root, asked = f"{tmp_path}/v", [r for r in rows if r[0] % 4 == 0]
    odd = [(200, None, 1), (203, [1.0], 1), (204, [float("inf"), 0.0, 1.0], 1)]
    done = vs.build_vector_index(table(spark, rows + odd, 3), root, rows_per_cell=8, sample_per_cell=4)
    assert done.content["cells"] == len(rows) // 8 and done.content["rows"] == len(rows)
    for grouped in (False, True):
        got = vs.search_vector_index(spark, root, table(spark, asked + odd, 2), k=3, probes=99, grouped=grouped, row_block=5, query_block=2)
        assert hits(got) == plain(rows, asked, 3, grouped)
    few = hits(vs.search_vector_index(spark, root, table(spark, asked, 2), k=3, probes=1))
    assert few and len(set(few) & set(plain(rows, asked, 3))) < len(plain(rows, asked, 3))


def test_index_of_few_or_no_rows(spark, vectors, tmp_path):
    rows = [r for r in vectors if len(r[1]) == 3]
    assert vs.build_vector_index(table(spark, rows, 2), f"{tmp_path}/v").content["cells"] == 1
    assert hits(vs.search_vector_index(spark, f"{tmp_path}/v", table(spark, rows[:3], 1), k=2)) == plain(rows, rows[:3], 2)
    vs.build_vector_index(table(spark, [], 1), f"{tmp_path}/none")
    assert hits(vs.search_vector_index(spark, f"{tmp_path}/none", table(spark, rows[:3], 1), k=2)) == []
    with pytest.raises(ValueError):
        vs.search_vector_index(spark, f"{tmp_path}/other", table(spark, rows[:3], 1), k=2)


def test_recall_over_all_queries(spark):
    """Of the ten nearest by exact search, over every query of the table."""
    sf = "/root/testdata/sf0.01"
    exact, found = (q(spark, sf).select("query_id", "vec_id") for q in (retrieval.vector_topk_cosine, retrieval.vector_index_topk))
    assert exact.join(found, ["query_id", "vec_id"]).count() >= 0.9 * exact.count()


def test_clusters_ask_for_few_probes(spark, tmp_path):
    """Where vectors lie in clusters, the sample asks for one cell or two, and only their folders are read."""
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(16)[i % 16] + rng.normal(scale=0.02, size=16)).tolist(), 0) for i in range(1600)]
    root = f"{tmp_path}/v"
    vs.build_vector_index(table(spark, rows, 4), root, rows_per_cell=100)
    got = vs.search_vector_index(spark, root, table(spark, rows[:3], 1), k=5)
    assert hits(got) == plain(rows, rows[:3], 5)
    recall = [r.recall for r in spark.read.parquet(f"{root}/data/*/centers").orderBy("cell").collect()]
    assert recall[1] > 0.95 and recall == sorted(recall) and recall[-1] == 1
    assert spark.read.parquet(f"{root}/data/*/rows").select("cell").distinct().count() == 16


def test_blocks_hold_few_scores_at_once(monkeypatch):
    rng = np.random.default_rng(1)
    v, ids = rng.normal(size=(60, 4)), np.arange(60)
    held = []
    real = vs._scores
    monkeypatch.setattr(vs, "SCORES", 600)
    monkeypatch.setattr(vs, "_scores", lambda q, v, kind: held.append(len(q) * len(v)) or real(q, v, kind))
    rows = pa.table({"id": ids, "v": pa.array(list(v)), "grp": [""] * 60, "cell": pa.array(ids % 3, pa.int32())})
    queries = rows.slice(0, 25).drop_columns("cell").append_column("cells", pa.array([[0, 2, 9]] * 25, pa.list_(pa.int32())))
    got = vs._score_blocks(5, "dot", False)(rows, queries).to_pylist()
    assert max(held) == 600
    dots = v @ v.T
    want = {(q, r) for q in range(25) for r in sorted((i for i in ids if i != q and i % 3 != 1), key=lambda i: -dots[q, i])[:5]}
    assert {(x["query_id"], x["id"]) for x in got} == want


def test_a_query_carries_its_cells_in_one_row(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0], ""), (2, [0.0, 1.0], "")], "id long, v array<double>, grp string")
    got = {r.id: r.cells for r in vs.nearest_cells(queries, np.array([[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]]), 2).collect()}
    assert got == {1: [0, 2], 2: [1, 2]}
