"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.storage import forget, staged, written
from tidemark.sources.tables import table

__all__ = ["SPACES", "forget", "join_counted", "staged", "table", "text_keys", "tokenizer_path", "whole_text", "written"]

#: A word is a run of anything but these six ASCII characters.
SPACES = " \t\n\x0b\x0c\r"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a vocabulary file of the public tokenizers lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_text(docs: DataFrame, text: str = "text") -> Column:
    """The text as a string; null counts as empty. Spark bounds the bytes of what a Python worker gets at once."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def text_keys(text: Column) -> list[Column]:
    """k1, k2: the first 128 bits of the text's SHA-256. Rows alike in both hold the same text."""
    sha = F.sha2(text, 256)
    return [F.conv(F.substring(sha, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "k1"), (17, "k2"))]


def join_counted(left: DataFrame, right: DataFrame, key: str, rows: str, parts: int = 4096) -> DataFrame:
    """left joined with right on key. right: one row per key and, in column `rows`, how many rows of left have it.

    Keys that hold more than 1 / parts of left's rows are fewer than `parts`, whatever the data: these are broadcast. No
    other key sends more than that share to one task.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = F.col(rows) * parts > total
    found = left.join(F.broadcast(right.where(hot).drop(rows)), key)
    return found.unionByName(left.join(right.where(~hot).drop(rows), key))
