"""The training-data operators against brute force, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, components, cotraining, lsh_forest, packing, pii, pivot_index, quality_rules, substring_dedup, suffix_dedup, wrapper_induction

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, passages that many share, periodic and odd texts, nulls, a repeated row, a row without an id."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéüß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    passage = prose(60)
    base = prose(200)
    out = [" ".join(prose(rng.randint(1, 150))) for _ in range(40)]
    out += [" ".join([*prose(30), *passage, *prose(20)]) for _ in range(12)]
    out += [" ".join([w if rng.random() > 0.01 else "zz" for w in base]) for _ in range(12)]
    out += [" ".join(base)] * 5
    out += ["la " * 120, "x" * 900, "ab" * 300, "", " \n\t ", "one", "one two three", "a b c d e", "<|endoftext|> It's <|startoftext|>'ll", "İ Σας ﬁ ́x", "a\x1cb\x85c d"]
    rows = [(i, t, "en", "s0", len(t)) for i, t in enumerate(out)]
    rows += [(1000, None, None, None, None), (1001, None, "en", "s1", 0), (3, *rows[3][1:]), (None, " ".join(base), "en", "s0", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    # Other columns, one with a name that operators use.
    return spark.createDataFrame(texts, SCHEMA).repartition(3).withColumn("words", F.lit(1)).withColumn("tag", F.lit("x")).withColumn("start", F.lit(None).cast("int"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


def covered(sequences, length):
    """Per sequence, which items windows cover that also start anywhere else."""
    n = Counter(tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        on = [False] * len(s)
        for i in range(len(s) - length + 1):
            if n[tuple(s[i : i + length])] > 1:
                on[i : i + length] = [True] * length
        out.append(on)
    return out


# 1


def brute_counts(text):
    text = text or ""
    words = [w.decode() for w in words_of(text)]
    lines = [x for x in text.split("\n") if words_of(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    rep = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep)


def test_quality_base_counts(spark, texts, docs):
    extra = [(2000, "a b c a b c\nx y\n\nx y\n  \n#|<> a", "en", "s", 1), (2001, "q q q q q q", "en", "s", 1)]
    df = spark.createDataFrame([*texts, *extra], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(df, labels).collect()
    want = Counter((r[0], *brute_counts(r[1])) for r in [*texts, *extra])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)  # without labels only the base rules decide


def test_quality_ratios(spark):
    """Likelihood ratios and the calibrated threshold as a plain program computes them."""
    rng = random.Random(1)
    good, bad = [f"w{i}" for i in range(60)], [f"z{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(bad if i % 5 == 0 else good) for _ in range(80)), "en", "s", 1) for i in range(60)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 60, 2)]
    m = 256

    def h(*parts, seed=42):
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed=seed)
        return seed

    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def grams(text):
        hs = [h(w) for w in words_of(text)]
        return [signed(x) % m for x in hs] + [signed(h(a.to_bytes(8, "little"), b.to_bytes(8, "little"))) % m for a, b in zip(hs, hs[1:], strict=False)]

    got = quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), buckets=m, threshold=-0.1).collect()
    trusted = {i for i, q, _ in labels if q}
    raw, target = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    n, k = raw.total(), target.total()
    for r in got:
        ratio = []
        for b in grams(rows[r.doc_id][1]):
            p = (raw[b] + 1) / (n + m)
            ratio.append(np.log((target[b] + k * p) / (2 * k * p)))
        assert r.llr == pytest.approx(np.mean(ratio), abs=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= -0.1)
    calibrated = quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), buckets=m).collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in calibrated)


# 2


def test_every_trusted_document_counts(spark):
    # 21,000 trusted documents; each has a word of its own for its bucket, so a list cut anywhere changes the weights.
    docs = spark.range(21000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    known, real = [], quality_rules.ratio_weights
    try:
        quality_rules.ratio_weights = lambda d, t, *a, **b: known.append(t.count()) or real(d, t, *a, **b)
        assert quality_rules.quality_rules(docs, labels, min_words=1).where("kept").count() == 21000
    finally:
        quality_rules.ratio_weights = real
    assert known == [21000]


def test_quantiles_are_exact(spark):
    values = [((i * 7919) % 1000) ** 3 / 7 for i in range(997)] + [5.0] * 300
    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    shares = (0.0, 0.001, 0.31, 0.5, 1.0)
    assert quality_rules.quantiles(rows, "x", shares, most=20, bins=8) == pytest.approx([float(np.quantile(values, q)) for q in shares])
    assert quality_rules.quantiles(rows.limit(0), "x", (0.5,)) == [0.0]


def test_exact_top_k(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 8)).astype(np.float32)
    v[300:500] = v[300]  # one very common vector
    v[5] *= 40
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, []), (902, [1.0] * 7), (903, [float("nan")] * 8), (904, [float("inf")] + [0.0] * 7), (905, [None] + [0.0] * 7), (None, [0.5] * 8), (906, [1e30] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    got = pivot_index.top_k(df, "vec_id % 50 = 0", block=16, group=4, pivots=8).collect()
    q = {i: [int(c) for c in np.floor(1024 * x.astype(np.float64))] for i, x in [*enumerate(v), (906, np.full(8, 1e30, np.float32))]}
    product = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = set()
    for i in range(0, 700, 50):
        order = sorted((-product(q[j], q[i]), j) for j in q if j != i)[:10]
        want |= {(i, k + 1, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for k, (s, j) in enumerate(order)}
    assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)
    assert all(10 <= r.n_scored <= 701 for r in got)
    assert pivot_index.top_k(df.limit(0), "vec_id % 50 = 0").count() == 0
    few = df.where("vec_id < 4 and vec_id >= 0")
    assert pivot_index.top_k(few, "vec_id % 2 = 0").count() == 6


def test_exact_top_k_of_large_components(spark):
    """Scores beyond 53 and 64 bits are ranked exactly; a far query in clustered data meets few vectors."""
    rng = np.random.default_rng(8)
    for scale in (7e4, 1e9, 1e20):
        v = rng.normal(size=(120, 4)) * scale
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        q = [[int(np.floor(1024 * c)) for c in x] for x in v]
        want = set()
        for i in range(0, 120, 40):
            order = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in range(120) if j != i)[:5]
            want |= {(i, n + 1, j, min(-s, (1 << 63) - 1)) for n, (s, j) in enumerate(order)}
        got = pivot_index.top_k(df, "vec_id % 40 = 0", k=5, block=8, group=4, pivots=8).collect()
        assert {tuple(r)[:4] for r in got} == want
    centres = rng.normal(size=(20, 8)) * 50
    v = (centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 8))).astype(np.float32)
    v = v / np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = pivot_index.top_k(df, "vec_id % 100 = 0", block=16, group=4, pivots=32).collect()
    assert len(got) == 200 and np.mean([r.n_scored for r in got]) < 1000


def test_exact_top_k_of_repeated_queries_and_lengths(spark):
    """Copies of a query are one query with k results, another vector under its id is one more, each length has its own."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, x) for i, x in enumerate(v)]
    rows += [(0, v[0])] * 2 + [(50, v[51])] + [(7, v[7])]  # two copies of a query's row, another vector under a query's id, a copy of a result
    rows += [(i, x) for i, x in enumerate(rng.normal(size=(40, 5)).astype(np.float32), 1000)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "vec_id long, embedding array<float>")
    got = pivot_index.top_k(df, "vec_id % 50 = 0", block=16, group=4, pivots=8).collect()
    scaled = [(i, np.floor(1024 * x.astype(np.float64)).astype(np.int64)) for i, x in rows]
    want = []
    for i, q in {(i, tuple(x)) for i, x in scaled if i % 50 == 0}:
        scores = sorted((-int(x @ np.array(q)), j) for j, x in scaled if j != i and len(x) == len(q))[:10]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    assert sorted(tuple(r)[:4] for r in got) == sorted(want)


# 3 and 4


@pytest.mark.parametrize("max_bucket", [1 << 17, 0])
def test_substring_dedup(texts, docs, max_bucket):
    got = substring_dedup.substring_dedup(docs, max_bucket=max_bucket).collect()
    seqs = [words_of(t) for _, t, *_ in texts]
    want = Counter()
    for (i, *_), s, on in zip(texts, seqs, covered(seqs, 35), strict=True):
        left = b" ".join(w for w, x in zip(s, on, strict=True) if not x)
        want[i, len(s), sum(on), hashlib.sha256(left).hexdigest(), left.decode()] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got) == want


@pytest.mark.parametrize("max_bucket", [1 << 20, 0])
def test_suffix_dedup(texts, docs, max_bucket):
    got = suffix_dedup.suffix_dedup(docs, max_bucket=max_bucket).collect()
    seqs = [(t or "").encode() for _, t, *_ in texts]
    want = Counter()
    for (i, *_), s, on in zip(texts, seqs, covered(seqs, 200), strict=True):
        spans = sum(x and not y for x, y in zip(on, [False, *on], strict=False))
        left = bytes(c for c, x in zip(s, on, strict=True) if not x)
        want[i, len(s), sum(on), spans, hashlib.sha256(left).hexdigest(), left] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == want


@pytest.mark.parametrize("max_bucket", [1 << 20, 50])
def test_dedup_of_long_texts_in_parts(texts, docs, max_bucket):
    """Parts of 300 units, far below the length of many texts, give what whole texts give."""
    seqs = [words_of(t) for _, t, *_ in texts]
    want = Counter((i, sum(on)) for (i, *_), on in zip(texts, covered(seqs, 35), strict=True))
    got = substring_dedup.substring_dedup(docs, part=60, max_bucket=max_bucket, keep_text=False).collect()
    assert Counter((r.doc_id, r.n_removed) for r in got) == want
    seqs = [(t or "").encode() for _, t, *_ in texts]
    want = Counter((i, sum(on)) for (i, *_), on in zip(texts, covered(seqs, 200), strict=True))
    got = suffix_dedup.suffix_dedup(docs, part=300, max_bucket=max_bucket, keep_text=False).collect()
    assert Counter((r.doc_id, r.n_removed) for r in got) == want


def test_dedup_of_texts_with_equal_hashes(spark):
    """Two texts without an id that hash() can't tell apart keep their own ranges."""
    words = spark.range(300_000).select(F.concat(F.lit("t"), "id", F.repeat(F.lit(" filling"), 40)).alias("text")).withColumn("h", F.hash("text"))
    pair = [r.text for r in words.join(words.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "h").orderBy("h").limit(2).collect()]
    assert len(pair) == 2 and len(set(pair)) == 2
    body = "".join(random.Random(1).choice("abc ") for _ in range(700))
    rows = [(None, pair[0], "", "", 0), (None, pair[1] + body, "", "", 0), (None, body[:400], "", "", 0), (None, pair[1], "", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for got, seqs, length in (
        (substring_dedup.substring_dedup(df), [words_of(r[1]) for r in rows], 35),
        (suffix_dedup.suffix_dedup(df), [r[1].encode() for r in rows], 200),
    ):
        assert sorted(r.n_removed for r in got.collect()) == sorted(map(sum, covered(seqs, length)))


def test_dedup_carries_rows(docs, texts):
    got = suffix_dedup.suffix_dedup(docs, with_row=True).select("doc_id", "kept", "row.*").collect()
    assert Counter((r[0], r[4], r.tag, r.words) for r in got) == Counter((i, lang, "x", 1) for i, _, lang, *_ in texts)


# 5


@pytest.mark.parametrize(("block_texts", "part"), [(512, 1 << 19), (3, 40)])
def test_near_duplicates(texts, docs, block_texts, part):
    got = lsh_forest.near_duplicates(docs, block_texts=block_texts, part=part).collect()
    sets = []
    for _, t, *_ in texts:
        w = words_of(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(texts)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links, others = Counter(), defaultdict(set)
    for i in range(n):
        for j in range(n):
            a, b = sets[i], sets[j]
            if i != j and (a == b or a and b and 5 * len(a & b) >= 4 * len(a | b)):
                links[i] += 1
                if a != b:
                    others[i].add(b)
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i in range(n):
        groups[root(i)].append(i)
    want = Counter()
    for members in groups.values():
        ids = [texts[i][0] for i in members if texts[i][0] is not None]
        for i in members:
            want[texts[i][0], min(ids, default=None), links[i], len(others[i])] += 1
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_linked_texts) for r in got) == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_depth():
    """Prefixes are shortened as the links measured need it; without enough of them, as one at the threshold does."""
    assert lsh_forest.prefix_depth({}, 32, 8, 0.8, 0.99999) == 5
    assert lsh_forest.prefix_depth({0.95: 1000.0}, 32, 8, 0.8, 0.99999) == 8
    assert lsh_forest.prefix_depth({0.95: 1000.0}, 32, 8, 0.8, 0.99999, 0.9999) == 6
    assert lsh_forest.prefix_depth({0.95: 900.0, 0.8: 300.0}, 32, 8, 0.8, 0.99999) == 5
    with pytest.raises(ValueError):
        lsh_forest.prefix_depth({}, 1, 2, 0.1, 0.99)


def test_links_measured_in_the_trie(spark):
    """Neighbours of the sorted trie show how similar the planted pairs are."""
    rng = random.Random(11)
    rows = []
    for i in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-30], *(f"x{rng.randrange(10**6)}" for _ in range(30))]))]
    labels = [lsh_forest.signature(lsh_forest.ngram_hashes(lsh_forest.WORDS.numbers(t.encode()), 5), 32, 8).tobytes() for _, t in rows]
    got = lsh_forest.measured(spark.createDataFrame([(bytearray(x),) for x in labels], "labels binary"), 32, 8, 0.7)
    assert 100 < sum(got.values()) < 200 and 0.78 < sum(s * w for s, w in got.items()) / sum(got.values()) < 0.86


# 6


@pytest.mark.parametrize("kind", ["long", "string"])
def test_quality_target_is_found_past_bits(spark, kind):
    """No trusted id is lost, however full the table of bits is; few others pass it, where it has room."""
    docs = spark.range(20_000).selectExpr(f"cast(id * 7919 - 1000 as {kind}) doc_id", "'a' text").unionByName(spark.createDataFrame([(None, "b")], f"doc_id {kind}, text string"))
    ids = docs.where("doc_id % 10 = 0").select("doc_id")
    n = ids.count()
    for most, share in ((1 << 26, 0.12), (1 << 10, 1.0), (1, 1.0)):
        rows = quality_rules._likely(docs, ids, "doc_id", most=most)
        assert rows.columns == docs.columns and rows.join(ids, "doc_id", "left_semi").count() == n
        assert rows.count() <= n + share * (docs.count() - n)
    assert quality_rules._likely(docs, ids.limit(0), "doc_id").count() == 0
    labels = ids.selectExpr("doc_id", "1 quality", "0 toxic")
    known, real = [], quality_rules.ratio_weights
    try:
        quality_rules.ratio_weights = lambda d, t, *a, **b: known.append(t.count()) or real(d, t, *a, **b)
        assert quality_rules.quality_rules(docs, labels).count() == docs.count()
    finally:
        quality_rules.ratio_weights = real
    assert known == [n]


def test_quality_classifier(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice(["red", "blue", "green", "grey"]) + ("!!" if bad else "") for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words), "en", "low" if bad == (rng.random() < 0.9) else "high", i))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    rows += [(900, None, None, None, None), (None, "red blue", "en", "high", 1), (901, "red", "inf", "Infinity", 1), (902, "blue " * 30000, "1e999", "nan", 1)]
    rows += [(2, "green!!", "en", "low", 2), (2, "green!!", "en", "low", 2)]  # a labelled id with other rows
    df, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 0), (7777, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    clashing = df.select("*", F.lit(1).alias("words"), F.lit(2).alias("h"), F.lit(3).alias("meta"), F.lit(4).alias("y"))
    found = cotraining.classify_quality(clashing, known).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and len(got) == len(rows) - 2
    held = [i for i in range(400) if i % 2]
    assert np.mean([got[i].kept == (i % 4 != 0) for i in held]) > 0.97
    again = cotraining.classify_quality(df.repartition(7), known).collect()
    assert sorted((r.doc_id or -1, round(r.score, 6)) for r in again) == sorted((r.doc_id or -1, round(r.score, 6)) for r in found)
    one_kind = cotraining.classify_quality(df, known.where("quality = 1")).collect()
    assert all(r.score == 0.5 and r.kept for r in one_kind)


# 7 and 9


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.tokenizer_path())


def test_bpe(texts, docs, tokenizer):
    got = bpe.encode_decode(docs, common.tokenizer_path()).collect()
    want = Counter()
    for i, t, *_ in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        said = tokenizer.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want


def test_bpe_all_characters_and_long_words(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 2000)
    rng = random.Random(7)
    every = [f"x{chr(c)}y {chr(c)}1 ab{chr(c)}" for c in range(0, 0x3000)]
    texts = [" ".join(every[i : i + 500]) for i in range(0, len(every), 500)]
    texts += ["".join(rng.choice("abcdef") for _ in range(n)) for n in (47, 48, 49, 3000)]
    texts += [" ".join(rng.choice(["the", "cat's", "don't", "..!!", "42nd"]) for _ in range(3000)), "a" * 5000]
    enc = bpe.Encoder(common.tokenizer_path())
    got = [b""] * len(texts)
    for k, runs in enc.slices(texts):
        got[k] += b"".join(runs)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_packing(texts, docs, tokenizer):
    got = packing.pack(docs, common.tokenizer_path(), capacity=64).collect()
    want = Counter()
    for i, t, *_ in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 64
    assert len(places) == brute_best_fit([r.length for r in got], 64)


def brute_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


def test_best_fit_plan():
    rng = random.Random(8)
    for _ in range(60):
        capacity = rng.randint(1, 40)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        plan, used = packing.best_fit_plan(dict(Counter(sizes)), capacity)
        assert used == brute_best_fit(sizes, capacity)
        filled = defaultdict(list)
        for size, number, count, sequence, offset, each in plan:
            for k in range(count):
                filled[sequence + k // each].append((offset + k % each * size, size))
        assert sum(map(len, filled.values())) == len(sizes) and (not sizes or len(filled) == used)
        for p in filled.values():
            end = 0
            for offset, size in sorted(p):
                assert offset == end
                end += size
            assert end <= capacity


# 8


def page(article, n=0, nav="Home"):
    return (
        f"<!DOCTYPE html><html><head><title>t{n}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header class='site-header'>Brand {n}</header>"
        f"<nav><ul><li><a href=/>{nav}<li>x</ul></nav><div class='ad'>Buy {n}</div>{article}<div class=comments><p>reader {n}</p></div><form><input><label>mail</label></form>"
        f"<aside>more {n}</aside><div id='cookie-notice'>We use cookies</div><footer>&copy; {n}</footer></body></html>"
    )


def test_html_extraction(spark):
    rows, want = [], {}
    for i in range(12):
        rows.append((i, f"https://a.example/{i}", page(f"<article><h1>Title {i}</h1><p><b>One &amp; {i}<br>x<p>two\n  {i}</p><p class='share'>Share</p></article>", i)))
        want[i] = f"Title {i}\nOne & {i} x\ntwo {i}"
    for i in range(20, 32):  # no article element: the slots that vary
        rows.append((i, f"http://B.example:80/{i}", page(f"<div class='c'><h2>Head {i}</h2><p>Body {i}</p><div class='tag'>Same line</div></div>", i)))
        want[i] = f"Head {i}\nBody {i}"
    rows += [(50, None, None), (51, "odd", ""), (52, "http://c.example/", "<p>just &lt;this&gt;"), (0, rows[0][1], rows[0][2]), (53, "http://d.example", "<article>open <b>bold")]
    want |= {50: "", 51: "", 52: "just <this>", 53: "open bold"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("?"))
    got = wrapper_induction.extract_main_text(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])), r.page_id
    assert wrapper_induction.extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["article", "div class='c'", "main"])
def test_html_extraction_of_near_copies(spark, tag):
    """Only a text that was voted constant goes, never another one on its path; an article element keeps all."""
    end, rows, want = tag.split()[0], [], {}
    for i in range(40):
        body = "The same body" if i % 20 else f"A body of its own {i}"
        rows.append((i, f"https://a.example/{i}", page(f"<{tag}><h1>Title {i}</h1><p>{body}</p><h2>Line {i % 2}</h2></{end}>", i)))
        want[i] = f"Title {i}\n" + (f"{body}\n" if tag == "article" or not i % 20 else "") + f"Line {i % 2}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.text for r in wrapper_induction.extract_main_text(df).collect()}
    assert got == want


def test_html_region_from_pages(spark):
    """Without article elements, what varies over the host's pages tells the article; names of text elements don't count there."""
    rows, want = [], {}
    rng = random.Random(12)
    for i in range(30):
        body = [" ".join(rng.choice(["share", "price", "rose", "fell", "today"]) + str(rng.randrange(1000)) for _ in range(30)) for _ in range(4)]
        html = (
            f"<body><div class=top>Brand</div><div class=x1><div class=x2><h1>Head {i}</h1><div class=x3><p class=share>{body[0]}<p id=search>{body[1]} <a class=ref>see</a> it"
            f"<h2 class=skip-link>{body[2]}</h2><p>{body[3]}<p>Always the same</div></div><div class=x4><p>teaser {i}</div></div><div class=x5>Foot {i % 2}</div>"
        )
        rows.append((i, "http://a.example/x", html))
        want[i] = "\n".join([f"Head {i}", body[0], f"{body[1]} see it", *body[2:]])
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    rows += [(100 + i, "http://b.example/", deep.replace("deep", f"deep {i} inside")) for i in range(3)]
    rows += [(200, "http://c.example", "<article><p>" + "main text " * 30 + "</article><article><p>teaser</article>"), (201, "http://d.example", "<p class=share>Share price rose</p><p id=search>About search engines</p>")]
    want |= {100: "deep 0 inside", 101: "deep 1 inside", 102: "deep 2 inside", 200: ("main text " * 30).strip(), 201: "Share price rose\nAbout search engines"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = [{r.page_id: (r.text, r.decided) for r in wrapper_induction.extract_main_text(df.repartition(n)).collect()} for n in (2, 50)]
    assert found[0] == found[1]
    assert {i: t for i, (t, _) in found[0].items()} == want
    assert {d for i, (_, d) in found[0].items() if i < 30} == {"template"} and found[0][200][1] == "tags"


def test_tree_matching():
    """Against the plain recursion over all pairs of forests."""
    rng = random.Random(13)

    def tree(n):
        x = wrapper_induction.Shape(rng.choice("ab"), "")
        n -= 1
        while n > 0:
            k = rng.randint(1, n)
            x.children.append(tree(k))
            n -= k
        x.form = hash((x.label, *(c.form for c in x.children)))
        return x

    def largest(a, b):
        def forest(xs, ys):
            if not xs or not ys:
                return 0
            both = largest(xs[-1], ys[-1]) + forest(xs[:-1], ys[:-1]) if xs[-1].label == ys[-1].label else 0
            return max(both, forest(xs[:-1], ys), forest(xs, ys[:-1]))

        return 1 + forest(a.children, b.children)

    for _ in range(150):
        a, b = tree(rng.randint(1, 12)), tree(rng.randint(1, 12))
        b.label = a.label
        for x in (a, b):
            x.form = hash((x.label, *(c.form for c in x.children)))
        size, pairs = wrapper_induction.match(a, b)
        assert size == largest(a, b) == len(pairs) and all(x.label == y.label for x, y in pairs)
    wide = "<div>" + "".join(f"<h2 class=c{i}>x</h2><p>y" for i in range(2000))
    assert len(wrapper_induction.lines_of(wrapper_induction.parse(wide))) == 4000


# 10


DISGUISED = {
    "mail john.doe [at] example [dot] com now": "email:john.doe [at] example [dot] com",
    "write to bob at mail dot example dot org please": "email:bob at mail dot example dot org",
    "call plus one four one five five five five two six seven one now": "phone:plus one four one five five five five two six seven one",
    "jоhn@exаmple.com": "email:jоhn@exаmple.com",
    "pay four one one one one one one one one one one one one one one one end": "card:four one one one one one one one one one one one one one one one",
    "ip one nine two dot one six eight dot one dot one ok": "ip:one nine two dot one six eight dot one dot one",
    "a＠ｂ.com": "email:a＠ｂ.com",
    "٤١١١ 1111 1111 1111": "card:٤١١١ 1111 1111 1111",
}


def test_disguises():
    for text, want in DISGUISED.items():
        base, added = pii.find(text)
        found = [f"{k}:{text[a:b]}" for k, own in zip(pii.KINDS, added, strict=True) for a, b in own]
        assert found == [want] and not any(base), text
    for text in ("meet at noon dot the end", "one two", "look at this. com", "one of the three at five", "Ölpreis – 3 × 4"):
        assert pii.disguised(text) == [[], [], [], []]


def test_disguises_in_plain_words():
    """Any last label, dots of the local part, dot words between numerals, numerals among digit words."""
    for text, want in {
        "ask anna at example dot pl today": "email:anna at example dot pl",
        "ask anna at example dot dev, today": "email:anna at example dot dev",
        "ask anna at mail dot example.com today": "email:anna at mail dot example.com",
        "ask anna at example dot co dot uk today": "email:anna at example dot co dot uk",
        "ask anna dot berg at example dot com today": "email:anna dot berg at example dot com",
        "ask anna dot m dot berg@example dot com": "email:anna dot m dot berg@example dot com",
        "ask anna dot berg at example.com": "email:anna dot berg at example.com",
        "host 192 dot 168 dot 1 dot 1 down": "ip:192 dot 168 dot 1 dot 1",
        "host 192 dot one six eight dot 1 dot one down": "ip:192 dot one six eight dot 1 dot one",
        "call +49 one five one 2345678 now": "phone:+49 one five one 2345678",
        "pay 4111 1111 one one one one 1111 now": "card:4111 1111 one one one one 1111",
    }.items():
        base, added = pii.find(text)
        found = [f"{k}:{text[a:b]}" for k, own in zip(pii.KINDS, added, strict=True) for a, b in own]
        assert found == [want] and not any(base), text
        assert pii.redact(text, added) == text.replace(want.split(":", 1)[1], f"<{want.split(':')[0].upper()}>")
    for text in ("we arrived at this point the rain fell", "look at example.com", "he looked at each dot and left", "at 3 point 5 and one of 2"):
        assert pii.disguised(text) == [[], [], [], []], text
    text = "+49 30 1234567 one day"
    assert [text[a:b] for x in pii.find(text) for own in x for a, b in own] == ["+49 30 1234567"]


def test_more_disguises():
    """Letters for digits, characters set apart, signs with space around, addresses that are only said, any last label."""
    for text, want in {
        "ask john at example dot xyz today": "email:john at example dot xyz",
        "ask x at y dot museum today": "email:x at y dot museum",
        "mail john at example.com today": "email:john at example.com",
        "ask john_77 at example.com today": "email:john_77 at example.com",
        "ask j o h n @ e x a m p l e . c o m now": "email:j o h n @ e x a m p l e . c o m",
        "ask john @ example.com now": "email:john @ example.com",
        "ask john@ example . com now": "email:john@ example . com",
        "call +1 four one five 555 2671 now": "phone:+1 four one five 555 2671",
        "call +49 3O l234567 now": "phone:+49 3O l234567",
        "pay 4lll 1111 1111 111I now": "card:4lll 1111 1111 111I",
        "host l92.168.O.1 down": "ip:l92.168.O.1",
    }.items():
        base, added = pii.find(text)
        found = [f"{k}:{text[a:b]}" for k, own in zip(pii.KINDS, added, strict=True) for a, b in own]
        assert want in found and not any(base), (text, found)
    for text in ("we look at example.com a lot", "more at www.example.com", "see you @ home . Then we eat", "Il 1990 o 2000 Il", "10 I 20 o 30 l 40", "vitamin B12 lol 3D O2", "a b c @ d e f"):
        assert pii.disguised(text) == [[], [], [], []], (text, pii.disguised(text))


def test_personal_data_takes_linear_time():
    import time

    for make in (
        lambda n: " " * n + "x(at)", lambda n: "(" + " " * n + "at", lambda n: "a " * n, lambda n: "1 " * n + "a", lambda n: "x at " * n, lambda n: "x at y" + " " * n + "dot",
        lambda n: "+1" + " " * n, lambda n: "@ " * n, lambda n: "a @ " * n, lambda n: "1l " * n, lambda n: "one " * n, lambda n: "1." * n, lambda n: "a@" * n, lambda n: "[at] " * n, lambda n: "x dot " * n + "at y dot com",
    ):
        began = time.process_time()
        pii.find(make(200_000))
        assert time.process_time() - began < 10, make(3)


def test_spans_against_a_plain_program(spark):
    """spans and base_sha256 of each row, from texts made of known pieces."""
    rng = random.Random(15)
    pieces = [("email", "ann.b@ex-a.org", True), ("ip", "10.0.200.7", True), ("card", "4111-1111-1111-1111", True), ("phone", "+49 (30) 123-4567", True), ("email", "bob [at] ex [dot] de", False), ("email", "kim at ex dot com", False), ("phone", "plus four nine three zero one two three four five", False), ("ip", "one dot two dot three dot four", False), ("card", "4111 1111 1111 111l", False)]
    rows, want = [], {}
    for i in range(60):
        text, base, every = "", [], []
        for _ in range(rng.randint(0, 6)):
            text += rng.choice(["word, ", "größe; ", "naïve\n", "汉字 text: "])
            kind, piece, plain = rng.choice(pieces)
            span = (pii.KINDS.index(kind), len(text), len(text) + len(piece))
            every.append(span)
            base += [span] * plain
            text += piece + rng.choice([" ; ", "\nand "])
        rows.append((i, text, "", "", 0))
        say = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))
        want[i] = (hashlib.sha256(say(base).encode()).hexdigest(), say(every))
    rows.append((99, "x" * 300_000 + " a@b.de", "", "", 0))
    want[99] = (hashlib.sha256(b"email:300001:300007").hexdigest(), "email:300001:300007")
    got = pii.find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.base_sha256, r.spans) for r in got} == want


def test_base_patterns():
    import re

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(9)
    digits = lambda s: re.sub("[^0-9]", "", s)
    for _ in range(20_000):
        s = "".join(rng.choice("ab_1@..-+ 290(") for _ in range(rng.randint(1, 50)))
        assert pii.emails(s) == [m.span() for m in email.finditer(s)]
        assert pii.ips(s) == [m.span() for m in ip.finditer(s) if all(int(x) <= 255 for x in m[0].split("."))]
        assert pii.cards(s) == [m.span() for m in card.finditer(s) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        assert pii.phones(s) == [m.span() for m in phone.finditer(s) if 8 <= len(digits(m[0])) <= 15]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.ips("9" * 5000 + ".1.1.1") == []


def test_personal_data(spark, docs, texts):
    rows = [(1, "x a@b.co 1.2.3.4 and 4111 1111 1111 1111 or +1 (415) 555-2671", "", "", 0), (2, None, "", "", 0), (3, "jo​hn@ex.com", "", "", 0)]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[1].redacted == "x <EMAIL> <IP> and <CARD> or <PHONE>"
    assert got[1].base_sha256 == hashlib.sha256(got[1].spans.encode()).hexdigest()
    assert got[2].spans == "" and got[2].redacted is None and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    # The source has 12 code points, the hidden one at 2.
    assert got[3].spans == "email:0:12,email:3:12" and got[3].n_added == 1 and got[3].redacted == "<EMAIL>"
    assert pii.find_personal_data(docs).count() == len(texts)


def test_pipeline(spark, texts, tokenizer, tmp_path):
    """run() against the stages as a plain program: without labels only the base rules decide in the first."""
    import corpus_pipeline

    rows = [*texts, (1500, "mail me: a@b.co " + " ".join(f"w{i}" for i in range(80)), "en", "s0", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    counts = [brute_counts(r[1]) for r in rows]
    docs = [r[:2] for r, (n, *_, rep) in zip(rows, counts, strict=True) if n >= 50 and 100 * rep <= 50 * n]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (words_of(t) for _, t in docs)]
    group = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (i, _), g in zip(docs, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    first = {i: t for (i, t), g in zip(docs, group, strict=True) if i is not None and least[g] == i}
    docs = [*first.items(), *((i, t) for i, t in docs if i is None)]
    seqs = [t.encode() for _, t in docs]
    left = [bytes(c for c, x in zip(s, on, strict=True) if not x).decode("utf-8", "ignore") for s, on in zip(seqs, covered(seqs, 200), strict=True)]
    want = Counter()
    for (i, _), t in zip(docs, left, strict=True):
        t = pii.redact(t, [x + y for x, y in zip(*pii.find(t), strict=True)])
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        assert len(ids) <= 2048
        want[i, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert len({r.sequence_id for r in got}) == brute_best_fit([r.length for r in got], 2048)
    assert 1500 in {r.doc_id for r in got} and len(got) < len(rows)


def test_pipeline_keeps_unlike_texts_under_one_id(spark):
    import corpus_pipeline

    rng = random.Random(2)
    prose = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(60))
    a, b, c, d = (prose() for _ in range(4))
    near = d + " more"
    rows = [(5, a), (5, b), (6, c), (7, a + " more"), (8, d), (8, a), (9, near), (9, near), (None, a), (None, None)]
    docs = spark.createDataFrame([(i, t, "k", 1, "c") for i, t in rows], "doc_id long, text string, k1 string, n int, component string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == Counter([(5, a), (5, b), (6, c), (8, d), (None, a), (None, None)])


def test_stages_delete_only_their_own_tables(spark):
    """A table that another thread writes while a stage runs stays."""
    import os
    import threading

    from tidemark.sources import storage

    other, inside, go, done = [], [], threading.Event(), threading.Event()

    def beside():
        go.wait(60)
        other.append(storage.written(spark.range(7)))
        done.set()

    t = threading.Thread(target=beside)
    t.start()
    before = storage.written(spark.range(3))

    def stage():
        inside.append(storage.written(spark.range(5)))
        go.set()
        done.wait(60)
        return inside[0].where("id > 2")

    out = storage.staged(spark, stage)
    t.join()
    assert (before.count(), other[0].count(), out.count()) == (3, 7, 2)
    with pytest.raises(Exception):
        inside[0].count()
    with storage.scope(spark):
        here = storage.staged(spark, lambda: spark.range(4))
        files = [f.removeprefix("file://") for f in here.inputFiles()]
        assert all(map(os.path.exists, files))
    assert not any(map(os.path.exists, files)) and out.count() == 2


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = common.tokenizer_path()
    for df in (
        quality_rules.quality_rules(none, labels), substring_dedup.substring_dedup(none), suffix_dedup.suffix_dedup(none), lsh_forest.near_duplicates(none),
        cotraining.classify_quality(none, labels), bpe.encode_decode(none, path), packing.pack(none, path), pii.find_personal_data(none),
    ):
        assert df.count() == 0
