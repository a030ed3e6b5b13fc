"""Alignment against plain programs: whole texts through both libraries, sets of ends, dictionaries of counts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemark.llm import alignment, common

A, B = common.tokenizer_path("byte_bpe_50k.json"), common.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B), alignment.vocabularies(A, B)


def whole(sides, text):
    """(A ids, B ids) of a whole text; none if the bytes differ."""
    a, b, v = sides
    if not text:
        return [], []
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = (" " + text).encode()
    same = b"".join(v.bytes_a[i] for i in x) == raw and b"".join(v.bytes_b[i] for i in y) == raw
    return (x, y) if same else ([], [])


def ends(ids, spelled):
    out, n = {}, 0
    for k, i in enumerate(ids):
        n += len(spelled[i])
        out[n] = k
    return out


def brute(sides, texts):
    v, rows, count = sides[2], [], Counter()
    for t in texts:
        x, y = whole(sides, t)
        ex, ey = ends(x, v.bytes_a), ends(y, v.bytes_b)
        cuts = sorted(set(ex) & set(ey))
        links = [(x[ex[c]], y[ey[c]]) for c in cuts]
        count.update(links)
        groups, p, q = [], 0, 0
        for c in cuts:
            groups.append(",".join(map(str, x[p : ex[c] + 1])) + "|" + ",".join(map(str, y[q : ey[c] + 1])))
            p, q = ex[c] + 1, ey[c] + 1
        rows.append((len(x), len(y), links, ";".join(groups)))
    most_a, most_b = defaultdict(int), defaultdict(int)
    for (i, j), n in count.items():
        most_a[i], most_b[j] = max(most_a[i], n), max(most_b[j], n)
    out = []
    for n_a, n_b, links, groups in rows:
        best = sum(count[p] == most_b[p[1]] for p in links), sum(count[p] == most_a[p[0]] for p in links)
        digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        out.append((n_a, n_b, len(links), len(links), *best, sum(count[p] for p in links), digest, groups))
    return out, {(*p, n, most_a[p[0]], most_b[p[1]]) for p, n in count.items()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeéüß漢字ñ") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["the", "tokens", "it's", "don't", "2024", "x=1;"]
    out = [rng.choice([" ", " ", " ", "  ", "\n", " \n ", "\t"]).join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    out += [None, "", " ", "   ", "\n", " a", "a ", "a  ", "  a  b ", "a\n b", "a \n\n  b", "▁", "a▁b ok", "<|endoftext|> x", "<s> </s><unk>", "a\x00b", "﻿x", "é é ﬁ"]
    out += ["a  b c 　 d", "x\x1c y\x85 z", "👩‍👩‍👧 🏳️‍🌈", "z" * 3000, "ab " * 2000, "᠎ a᠎ b"]
    return out + out[:3]


def test_align(spark, sides, texts):
    rows = [(n if n else None, t, "x", 1, "p") for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair string, n long, block string").repartition(3)
    want, pairs = brute(sides, texts)
    got = {r[0]: tuple(r)[1:] for r in alignment.align(docs, A, B).collect()}
    assert got == {(n if n else None): w for n, w in enumerate(want)}
    assert set(map(tuple, alignment.pair_counts(docs, A, B).collect())) == pairs
    assert alignment.align(docs, A, B, with_groups=False).count() == len(texts)


def test_align_in_slices_and_blocks(spark, sides, texts, monkeypatch):
    """Texts in parts of 50 characters, blocks of few documents, and runs forgotten after each."""
    monkeypatch.setattr(alignment, "SLICE", 50)
    monkeypatch.setattr(alignment, "KEPT_RUNS", 5)
    runs = alignment.Runs(A, B)
    for t in texts:
        block = alignment.Block(runs, True)
        block.add(1, t or "")
        row = block.row().iloc[0]
        want = brute(sides, [t])[0][0]
        assert (row["n_a"][0], row["n_b"][0], row["n_links"][0], row["groups"][0]) == (want[0], want[1], want[2], want[8]), repr(t)
        assert sum(row["pair_n"]) == want[2]
        if len(runs.groups) > alignment.KEPT_RUNS:
            runs.clear()


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab é\n\t '<>▁\x1c\x85 漢1s"), max_size=30))
def test_runs_are_encoded_as_whole_texts(text):
    v = alignment.vocabularies(A, B)
    want = whole((v.a, v.b, v), text)
    runs = [r for part in alignment.runs_of(text) for r in part] if text else []
    a, b = v.encode(runs)
    raw = (" " + text).encode()
    joined = [b"".join(s[i] for ids in side for i in ids) for side, s in ((a, v.bytes_a), (b, v.bytes_b))]
    got = ([i for x in a for i in x], [i for x in b for i in x]) if text and joined == [raw, raw] else ([], [])
    assert got == want


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, A, B).count() == 0
    assert alignment.pair_counts(none, A, B).count() == 0
