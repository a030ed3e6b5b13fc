"""N-gram Jaccard join: a MinHash LSH forest proposes, exact verification decides.

1. Texts with the same set of word n-grams form a class; everything below works on one representative per class.
2. Each representative has a signature of `trees` labels of `depth` minima; sorted, the labels of a tree are a prefix trie.
3. How far prefixes are shortened follows from the data: neighbours in the first sorted trie are compared by the minima of
   the other trees, which gives how similar linked texts are here. From the full depth on, matched prefixes lose one
   minimum after another until the links measured so would be found with the target recall.
4. Texts that share a prefix in a tree form a group. A pair is looked at in the first tree in which it shares one, so each
   pair once. Only texts with such a pair travel to a group; large groups are dealt block against block.
5. There, pairs are verified on the n-grams themselves. A task returns counts and a spanning forest of the true links, as
   many rows as texts; never a row per pair.
6. Components of the true links are the classes of near-duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, text_keys, whole_text, written
from .components import connected_components
from .repeats import FACTORS, PART, Rolling, mixed, unpacked
from .substring_dedup import WORDS

U = np.uint64


def recall_of(similarity: float | np.ndarray, trees: int, depth: int) -> float | np.ndarray:
    """How likely a pair shares the prefix of `depth` minima in one tree at least."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(
    found: dict[float, float], trees: int, depth: int, threshold: float, recall: float, at_threshold: float = 0.0, enough: float = 100
) -> int:
    """The longest prefix, shortened from the full depth, that finds the links of `found` with the target recall, and a
    pair at the threshold itself with at_threshold.

    found: weight by similarity of links measured in the data; of too few of them, all count as lying at the threshold.
    """
    total = sum(found.values())
    if total < enough:
        found, total = {threshold: 1.0}, 1.0
    for d in range(depth, 0, -1):
        reached = sum(w * recall_of(s, trees, d) for s, w in found.items()) / total
        if reached >= recall and recall_of(threshold, trees, d) >= at_threshold:
            return d
    raise ValueError("no prefix reaches the recall; take more trees")


def ngram_hashes(x: np.ndarray, n: int, size: int = PART) -> np.ndarray:
    """x: numbers of the words. The sorted distinct hashes of the n-grams; a shorter text is one n-gram. size: n-grams at a time."""
    if not len(x):
        return np.empty(0, U)
    n = min(n, len(x))
    out = []
    for lo in range(0, len(x) - n + 1, size):
        part = x[lo : lo + size + n - 1]
        at = np.arange(len(part) - n + 1)
        out.append(Rolling(part, FACTORS[1])(at, at + n))
    return np.unique(np.concatenate(out))


def signature(grams: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """`depth` minima for each of `trees` labels, 16 bits of each."""
    n = trees * depth
    rng = np.random.default_rng(91)
    flip = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    factor = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    x = (grams >> U(32)).astype(np.uint32)
    for lo in range(0, len(x), 512):
        h = (x[lo : lo + 512, None] ^ flip) * factor
        h ^= h >> np.uint32(15)
        np.minimum(low, (h * np.uint32(0x846CA68B)).min(axis=0), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").reshape(trees, depth)


def prefixes(labels: np.ndarray, length: int) -> np.ndarray:
    """labels: texts x trees x depth. A number per text and tree for the prefix of `length` minima."""
    key = np.zeros(labels.shape[:2], U)
    for d in range(length):
        key = mixed(key * U(0x9E3779B97F4A7C15) + labels[:, :, d].astype(U) + U(1))
    return (key >> U(33)).astype(np.int32)


def not_before(a: np.ndarray, b: np.ndarray, tree: int) -> np.ndarray:
    """a, b: keys of texts x trees. Which of their pairs share a prefix in no tree before `tree`."""
    out = np.ones((len(a), len(b)), bool)
    if out.size * tree <= 1 << 16:
        return ~(a[:, None, :tree] == b[None, :, :tree]).any(2)
    for t in range(tree):
        out &= a[:, t][:, None] != b[:, t]
    return out


def links_in_blocks(sets: list[np.ndarray], left: int, num: int, den: int) -> np.ndarray:
    """Whether each two of the sets have a Jaccard similarity of num/den or more; left: how many form the first block.

    Rows are the first `left` sets, columns all others if there are any, else the same sets.
    """
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(column, minlength=len(values)) > 1
    keep = often[column]
    column, owner = (np.cumsum(often) - 1)[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    a, b = np.arange(left), np.arange(left, len(sets)) if left < len(sets) else np.arange(left)
    both = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, int(often.sum()), 4096):
        i, j = np.searchsorted(column, (lo, lo + 4096))
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[i:j], column[i:j] - lo] = 1
        both += m[a] @ m[b].T
    both = both.astype(np.int64)
    union = sizes[a][:, None] + sizes[b][None, :] - both
    return (both * den >= num * union) & (both > 0)


def _forest(linked: np.ndarray, rows: list[int], columns: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        a, b = root(rows[i]), root(columns[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((rows[i], columns[j]))
    return out


def _batched(groups: Iterator[list[tuple]], rows: int = 4096) -> Iterator[list[list[tuple]]]:
    """Several groups at once, up to about so many rows."""
    held, size = [], 0
    for g in groups:
        held.append(g)
        size += len(g)
        if size >= rows:
            yield held
            held, size = [], 0
    if held:
        yield held


def _groups(columns: tuple[str, ...], batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """The rows of each group; the first four columns name it, and rows come sorted by it."""
    rows: list[tuple] = []
    for b in batches:
        for r in zip(*(b[c].tolist() for c in columns), strict=True):
            if rows and r[:4] != rows[0][:4]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def measured(reps: DataFrame, trees: int, depth: int, threshold: float) -> dict[float, float]:
    """reps: labels. Weight by similarity of links, as neighbours in the sorted trie of the first tree show it.

    The similarity is the share of equal minima of other trees (15 of them do). A pair has the same first minimum, and so lies near
    each other, as often as it is similar; it counts as often as that inverted. Pairs up to two standard deviations
    below the threshold count too, which errs towards shorter prefixes.
    """
    trees = min(trees, 16)
    n = (trees - 1) * depth
    least = threshold - 2 * (threshold * (1 - threshold) / max(1, n)) ** 0.5

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for b in batches:
            x = np.frombuffer(b"".join(b["labels"]), "<u2").reshape(len(b), trees, depth)
            x = x if before is None else np.concatenate([before, x])
            before = x[-1:]
            near = x[1:, 0, 0] == x[:-1, 0, 0]
            same = (x[1:, 1:] == x[:-1, 1:]).sum((1, 2))[near]
            equal, often = np.unique(same, return_counts=True)
            yield pd.DataFrame({"equal": equal, "n": often})

    trie = reps.select(F.substring("labels", 1, 2 * depth * trees).alias("labels"), F.substring("labels", 1, 2 * depth).alias("label"))
    trie = trie.repartitionByRange("label").sortWithinPartitions("label").select("labels")
    rows = trie.mapInPandas(compare, "equal int, n long").groupBy("equal").agg(F.sum("n").alias("n")).collect()
    return {r.equal / n: r.n * n / r.equal for r in rows if n and r.equal and r.equal / n >= least}


def near_duplicates(
    docs: DataFrame,
    *,
    n: int = 5,
    threshold: tuple[int, int] = (4, 5),
    trees: int = 32,
    depth: int = 8,
    recall: float = 0.99999,
    at_threshold: float = 0.9999,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_texts: int = 512,
    part: int = PART,
    with_keys: bool = False,
) -> DataFrame:
    """One row per row of docs: doc_id, class_id, copy_of, n_links, n_linked_texts; with_keys: k1, k2, component too.

    Two texts are linked if the Jaccard similarity of their sets of word n-grams is at least threshold (a fraction).
    class_id: the least doc_id reachable over links, the document's own if it has none. copy_of: the least doc_id with
    the same n-grams. n_links: other rows linked to this one, copies included; n_linked_texts: other classes of copies
    linked to it. Links are verified exactly; those of the data are proposed with at least the target recall, as
    measured() finds them, and a pair at the threshold itself with at_threshold.
    k1, k2: text_keys() of the row's text; component: a number that the rows of a class share, and no others. Where several
    texts have one id, ids don't tell their classes apart, but these do.
    block_texts: texts of a group that meet in one task; part: words that are looked at together. Neither changes the result.

    Words are runs without ASCII white space, unchanged. Texts of 1 to n - 1 words are one n-gram. Null texts and texts
    without words are copies of each other and of nothing else. A null doc_id: such rows take part, but no class is
    named after them unless all its rows are so; it is then null. Repeated rows are copies and each give a row. Long texts
    are read whole, in parts. Ties don't arise: the least id names a class. Other columns are ignored; an empty table
    gives no rows.
    """
    num, den = threshold
    text = whole_text(docs, text_col)
    keys = ("k1", "k2") if with_keys else ()
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), *(text_keys(text) if with_keys else ()))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = []
            for text in b["text"].tolist():
                raw = text.encode("utf-8", "surrogatepass")
                grams = ngram_hashes(WORDS.numbers(raw), n, part)
                with np.errstate(over="ignore"):
                    one, two = mixed(grams ^ U(FACTORS[0])).sum(dtype=U), mixed(grams + U(FACTORS[2])).sum(dtype=U)
                same = one.tobytes() + two.tobytes() + len(grams).to_bytes(4, "little")
                out.append((same, len(grams), signature(grams, trees, depth).tobytes(), press.compress(raw)) if len(grams) else (same, 0, b"", b""))
            made = pd.DataFrame(out, columns=["same", "size", "labels", "packed"])
            yield made.assign(doc_id=b["doc_id"].astype("Int64"), **{k: b[k] for k in keys})

    schema = "doc_id long, same binary, size int, labels binary, packed binary" + "".join(f", {k} long" for k in keys)
    rows = written(base.mapInPandas(sign, schema))
    copies = rows.groupBy("same").agg(
        F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("size", "labels", "packed"))
    )
    # Written, so that a class keeps the number it gets here.
    copies = written(copies.withColumn("node", F.monotonically_increasing_id()))
    ids = written(rows.select("doc_id", "same", *keys))
    forget(rows)
    reps = copies.where("size > 0")
    length = prefix_depth(measured(reps, trees, depth, num / den), trees, depth, num / den, recall, at_threshold)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = prefixes(np.frombuffer(b"".join(b["labels"]), "<u2").reshape(len(b), trees, depth), length)
            yield pd.DataFrame({"node": b["node"], "keys": list(keys)})

    keyed = written(reps.select("node", "labels").mapInPandas(key, "node long, keys array<int>"))
    prefix = keyed.select("node", F.posexplode("keys").alias("tree", "key"))
    shared = prefix.groupBy("tree", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared.select("tree", "key", F.ceil(F.col("n") / block_texts).cast("int").alias("blocks"))
    member = prefix.join(shared, ["tree", "key"]).join(keyed, "node")
    member = member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Each text goes to every pair of blocks that its own is part of.
    pairs = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ("tree", "key", "i", "j")
    pairs = pairs.select("tree", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "keys")

    def sides(rows: list[tuple], at: int) -> tuple[int, slice, np.ndarray]:
        """Sorts the rows of a group by block. How many are in the first block, where the others start, the pairs to look at."""
        rows.sort(key=lambda r: r[4])
        left = sum(r[4] == rows[0][2] for r in rows)
        keys = np.stack([r[at] for r in rows])
        other = slice(0 if rows[0][2] == rows[0][3] else left, None)
        todo = not_before(keys[:left], keys[other], rows[0][0])
        if other.start == 0:
            np.fill_diagonal(todo, False)
        return left, other, todo

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The texts that have a pair in this group that isn't looked at elsewhere."""
        for b in _batched(_groups((*group, "block", "node", "keys"), batches)):
            out = []
            for rows in b:
                left, other, todo = sides(rows, 6)
                need = np.zeros(len(rows), bool)
                need[:left] = todo.any(1)
                need[other] |= todo.any(0)
                out += [r for r, x in zip(rows, need.tolist(), strict=True) if x]
            yield pd.DataFrame(out, columns=[*group, "block", "node", "keys"])

    schema = "tree int, key int, i int, j int, block int, node long, keys array<int>"
    chosen = pairs.repartition(*group).sortWithinPartitions(*group).mapInPandas(choose, schema)

    # A merge join at every size: the texts are dealt the same way whether there are few candidates or many.
    texts = reps.select("node", "copies", "packed").hint("merge").join(chosen, "node").select(*group, "block", "node", "copies", "keys", "packed")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _batched(_groups((*group, "block", "node", "copies", "keys", "packed"), batches)):
            out = []
            for rows in b:
                left, other, todo = sides(rows, 7)
                if not todo.any():
                    continue
                grams = [ngram_hashes(WORDS.numbers(unpacked(r[8])), n, part) for r in rows]
                found = links_in_blocks(grams, left, num, den) & todo
                nodes, copies = [r[5] for r in rows], np.array([r[6] for r in rows])
                texts, linked = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                texts[:left], linked[:left] = found.sum(1), found @ copies[other]
                if other.start:
                    texts[other], linked[other] = found.sum(0), copies[:left] @ found
                out += [(x, x, t, c) for x, t, c in zip(nodes, texts.tolist(), linked.tolist(), strict=True) if t]
                out += [(x, y, 0, 0) for x, y in _forest(found, nodes[:left], nodes[other])]
            yield pd.DataFrame(out, columns=["node", "other", "texts", "rows"]).astype("int64")

    found = written(
        texts.repartition(*group).sortWithinPartitions(*group).mapInPandas(verify, "node long, other long, texts long, rows long")
    )
    links = found.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("linked"))
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = copies.select("same", "copy_of", "copies", "node").join(links, "node", "left").join(classes, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("copy_of").alias("class_id"))
    named = named.join(names, "component").select(
        "same",
        "class_id",
        "copy_of",
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_linked_texts"),
        *(["component"] if with_keys else []),
    )
    return ids.join(named, "same").drop("same")
