"""Conversation prefix trie by chained digests.

The digest of a prefix is that of the prefix before it and of its last turn, so that equal prefixes have equal digests. Every
prefix of every conversation is a row; rows alike in depth and digest are one node. A node's leaves and savings go to all
its ancestors: these are prefixes of the conversation that stands for it. Nodes with one such conversation lie on one path
and are summed along it first, so that a path of n nodes sends n rows and not n * n / 2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, written

#: Bytes of SHA-256 that name a prefix.
BYTES = 16
ROOT = bytes(BYTES)
#: Conversation ids in one piece of a node's list.
PIECE = 4096


def ordered_turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, n (from 1, by turn, null first), unit (digest of role and text), size (code points of the text)."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    unit = F.unhex(F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256))
    rows = conversations.select(
        conversations[id_col].cast("long").alias("conv_id"), conversations[turn_col].alias("turn"), unit.alias("unit"), F.length(text).cast("long").alias("size")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "unit")
    return rows.where("conv_id is not null").withColumn("n", F.row_number().over(order)).drop("turn")


def with_shared_heads(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin with the first turns of the first one of their group. turns: as of ordered_turns().

    Of conversation c, the first h turns (h: CRC-32 of its decimal id, modulo `most`) are replaced by those of conversation
    c - c % group: all if it has fewer, none if it is absent. The place of its own turns is after all of these.
    """

    def head(c: Column) -> Column:
        return F.crc32(c.cast("string").cast("binary")) % most

    own = turns.where(F.col("n") > head(F.col("conv_id"))).withColumn("n", F.col("n") + most)
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("n") < most)).select(F.col("conv_id").alias("base"), "n", "unit", "size")
    ids = turns.where("n = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    # At most `group` conversations meet at most `most` turns.
    shared = ids.join(first, "base").where(F.col("n") <= head(F.col("conv_id")))
    return own.select("conv_id", "n", "unit", "size").unionByName(shared.select("conv_id", "n", "unit", "size"))


def prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent, size, last: every prefix of every conversation of ids, the empty one too.

    A conversation's turns come to one task in order and are chained as they pass; nothing of it is kept but the last digest.
    """
    start = ids.select("conv_id", F.lit(0).alias("n"), F.lit(None).cast("binary").alias("unit"), F.lit(0).cast("long").alias("size"))
    rows = turns.select("conv_id", "n", "unit", "size").unionByName(start)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, depth, digest, held = None, 0, ROOT, None
        for b in batches:
            out = [held] if held else []
            for c, unit, size in zip(b["conv_id"].tolist(), b["unit"], b["size"].tolist(), strict=True):
                if c != conv:
                    if out:
                        out[-1] = (*out[-1][:-1], True)
                    conv, depth, digest, parent = c, 0, ROOT, None
                else:
                    depth, parent = depth + 1, digest
                    digest = hashlib.sha256(parent + unit).digest()[:BYTES]
                out.append((c, depth, digest, parent, size, False))
            held = out.pop() if out else None  # it is known with the next row whether this was the last
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([(*held[:-1], True)], columns=names)

    names = ["conv_id", "depth", "digest", "parent", "size", "last"]
    return rows.mapInPandas(run, "conv_id long, depth long, digest binary, parent binary, size long, last boolean")


def digest_of_ends(found: DataFrame) -> DataFrame:
    """digest, ends_sha256: of each node, the conversations that end there, as ascending decimal ids joined by commas.

    Ids are put together in pieces of PIECE; a node's pieces pass one task in order, which keeps only the state of the hash.
    """
    piece = F.floor(F.col("conv_id") / PIECE)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    rows = found.where("last").groupBy("digest", piece.alias("piece")).agg(ids.alias("ids"))
    rows = rows.repartition("digest").sortWithinPartitions("digest", "piece")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha = None, None
        for b in batches:
            out = []
            for d, ids in zip(b["digest"], b["ids"], strict=True):
                if d != node:
                    if sha:
                        out.append((node, sha.hexdigest()))
                    node, sha = d, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["digest", "ends_sha256"])
        if sha:
            yield pd.DataFrame([(node, sha.hexdigest())], columns=["digest", "ends_sha256"])

    return rows.drop("piece").mapInPandas(run, "digest binary, ends_sha256 string")


def subtree_sums(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """digest, n_leaves, saved_tokens: sums over each node's subtree. nodes: conv_id, depth, leaf, saved."""
    weights = nodes.where("leaf > 0 or saved > 0").select("conv_id", "depth", F.lit(None).cast("binary").alias("digest"), "leaf", "saved")
    none = F.lit(0).cast("long")
    rows = found.select("conv_id", "depth", "digest", none.alias("leaf"), none.alias("saved")).unionByName(weights)
    # All that lies on the path at this depth or deeper; a path's rows pass in order of depth.
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    rows = rows.select("digest", F.sum("leaf").over(below).alias("leaf"), F.sum("saved").over(below).alias("saved"))
    rows = rows.where("digest is not null and (leaf > 0 or saved > 0)")
    return rows.groupBy("digest").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per node: digest, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, n, unit, size, as of ordered_turns(); ids: conv_id, once each. A node is a distinct sequence of first
    turns; its members are the conversations that begin with it, conv_id the smallest of them. saved_tokens: over the
    subtree, the size of a node's last turn for each member but one. ends_sha256: of its members with no further turn.
    """
    found = written(prefixes(turns, ids))
    # All rows of a group agree in parent and size.
    nodes = found.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("size").alias("size"))
    nodes = written(nodes)
    children = written(nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")))
    nodes = nodes.join(children.withColumnRenamed("parent", "digest"), "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = written(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("size")))
    # A node may have a third of all others as children.
    parents = nodes.where("n_children > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    parents = join_counted(nodes.where("parent is not null").select("digest", "parent"), parents, "parent", "n_children").drop("parent")
    out = nodes.join(parents, "digest", "left").join(subtree_sums(found, nodes), "digest", "left").join(digest_of_ends(found), "digest", "left")
    zero, nothing = F.lit(0).cast("long"), F.lit(hashlib.sha256().hexdigest())
    return out.select(
        "digest", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("n_leaves", zero).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def prefix_trie(
    conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shared_heads: bool = False
) -> DataFrame:
    """The nodes of all conversations' prefixes, as of trie(), from the textless root on. shared_heads: with_shared_heads() first.

    Turns are ordered by number, null first; turns of one number by the digest of role and text. Null role or text: empty.
    Repeated rows are turns of their own. Rows without a conversation don't count; other columns are ignored. A
    conversation that with_shared_heads() leaves without turns is a member of the root. No conversations: no rows.
    """
    turns = written(ordered_turns(conversations, id_col, turn_col, role_col, text_col))
    return trie(with_shared_heads(turns) if shared_heads else turns, turns.where("n = 1").select("conv_id"))


#: The same nodes of `conversations` with shared heads, for DuckDB. Prefixes are lists of turns there; CRC-32 is taken bit by bit.
SQL = """
WITH ordered AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bytes AS (
  SELECT c, list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)) AS b FROM ordered),
crc AS (
  SELECT c, xor(4294967295::UBIGINT, list_reduce(b, lambda s, x: list_reduce(list_prepend(xor(s, x), range(8)::UBIGINT[]),
    lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END))) AS crc FROM bytes),
heads AS (SELECT o.*, (crc % 6)::BIGINT AS h FROM ordered o JOIN crc USING (c)),
rebuilt AS (
  SELECT x.c, list_concat(coalesce(b.own[1:x.h], []), x.own[x.h + 1:]) AS turns FROM heads x LEFT JOIN ordered b ON b.c = x.c - x.c % 100),
prefix AS (SELECT c, len(turns) AS size, d, turns[1:d] AS p FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CASE WHEN size = d THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends FROM prefix GROUP BY p, d),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
weighted AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(p[d].text) ELSE 0 END AS saved
  FROM node n LEFT JOIN children USING (p)),
sums AS (
  SELECT p[1:k] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS k FROM weighted) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM weighted n JOIN sums s ON s.p = n.p LEFT JOIN node u ON n.d > 0 AND u.d = n.d - 1 AND u.p = n.p[1:n.d - 1]
"""
