"""The prefix trie against a plain program that keeps whole prefixes as keys."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from tests.oracle import differences
from tidemark.llm import common, prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, digest string, n int, depth int, leaf string"


def unit(turn):
    return hashlib.sha256("".join(hashlib.sha256((x or "").encode()).hexdigest() for x in turn).encode()).digest()


def brute(rows, shared):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, unit((role, text)), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    built = own
    if shared:
        head = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        built = {c: own.get(c - int(math.fmod(c, 100)), [])[: head[c]] + t[head[c] :] for c, t in own.items()}
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(who), len(p), parent, len(who), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    cols = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256".split(", ")
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def talks():
    """Shared heads, copies, a chain of many turns, repeated rows, ties, nulls everywhere, long texts and odd ones."""
    rng = random.Random(3)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["hi", "how", "", None, "ñandú", "no" * 2000]))
    rows = [(c, t, *say()) for c in [*range(0, 30), *range(100, 130), 205, 1007] for t in range(rng.randint(1, 7))]
    rows += [(c, t, "user", "same") for c in range(300, 360) for t in range(4)]
    rows += [(700, t, "user", f"long {t % 3}") for t in range(400)] + [(701, t, "user", f"long {t % 3}") for t in range(390)]
    rows += [(5, 2, "user", "hi"), (5, 2, "user", "hi"), (5, 2, "user", "how"), (9, None, "user", "first"), (9, None, None, None)]
    rows += [(None, 0, "user", "lost"), (-7, 0, "user", "below"), (-7, 1, "a", "bc"), (-8, 0, "ab", "c"), (0, -3, "system", "x\ty")]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2, "l") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("shared", [False, True])
def test_prefix_trie(spark, talks, shared):
    got = rows_of(prefix_trie.prefix_trie(table(spark, talks), shared_heads=shared))
    assert got == brute(talks, shared)


def test_pieces_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, 0, "user", "a" if c % 3 else "b") for c in range(0, 400, 3)] + [(c, 0, "user", "a") for c in range(1, 90)]
    assert rows_of(prefix_trie.prefix_trie(table(spark, rows))) == brute(rows, False)


def test_role_and_text_do_not_run_together(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "", "abc")]
    assert len(rows_of(prefix_trie.prefix_trie(table(spark, rows)))) == 4


def test_no_conversations(spark):
    assert rows_of(prefix_trie.prefix_trie(table(spark, []), shared_heads=True)) == []
    assert rows_of(prefix_trie.prefix_trie(table(spark, [(None, 0, "user", "x")]))) == []


def test_conversations_without_turns_are_at_the_root(spark):
    # Of 157, 158 and so on the first turns are replaced by those of 100, which is absent.
    rows = [(c, 0, "user", "x") for c in range(150, 170)]
    got = rows_of(prefix_trie.prefix_trie(table(spark, rows), shared_heads=True))
    assert got == brute(rows, True) and got[0][3] == 20 and got[0][1] == 0


def test_query_matches_sql(spark, sf_dir):
    assert not differences(queries.QUERIES["op12_prefix_trie"], queries.ORACLE_SQL["op12_prefix_trie"], spark, sf_dir)


def test_joins_by_frequency(spark):
    left = spark.createDataFrame([(k, i) for k in range(6) for i in range(k * k + 1)], "k int, i int")
    right = left.groupBy("k").count().withColumnRenamed("count", "rows").withColumn("v", common.F.col("k") * 10)
    for parts in (1, 2, 4096):  # nothing, the most frequent key, every key is broadcast
        got = sorted(map(tuple, common.join_counted(left, right, "k", "rows", parts).select("k", "i", "v").collect()))
        assert got == [(k, i, k * 10) for k in range(6) for i in range(k * k + 1)]
