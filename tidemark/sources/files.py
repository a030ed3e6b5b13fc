"""Files: Markdown folders, DOCX documents, JSON datasets, snapshots and reports."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tidemark.sources import commits

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8, or GBK where that fails; what neither can read is replaced."""

    def one(raw: bytes) -> str:
        for name in ("utf-8-sig", "gbk"):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
        return raw.decode("utf-8", "replace")

    return content.map(one)


def read_markdown(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """file_name, text of all Markdown files below a folder, or of one file; blank ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), decoded("content").alias("text"))
    return rows.where(F.trim("text") != "")


def read_docx(spark: SparkSession, folder: str) -> DataFrame:
    """doc, kind (paragraph or row), table_no, n, cells: paragraphs and table rows of DOCX files, in order."""

    def text(node: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in node.iter(f"{W}t")).strip()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, raw in zip(b["doc"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
                tables, n = 0, 0
                for node in body if body is not None else ():
                    if node.tag == f"{W}tbl":
                        for row in node.iter(f"{W}tr"):
                            out.append((doc, "row", tables, n, [text(c) for c in row.iter(f"{W}tc")]))
                            n += 1
                        tables += 1
                    elif node.tag == f"{W}p" and (t := text(node)):
                        out.append((doc, "paragraph", None, n, [t]))
                        n += 1
            made = pd.DataFrame(out, columns=["doc", "kind", "table_no", "n", "cells"])
            yield made.astype({"table_no": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("doc"), "content")
    return rows.mapInPandas(run, "doc string, kind string, table_no long, n long, cells array<string>")


def clauses_of(rows: DataFrame, least: int = 5) -> DataFrame:
    """doc, number, title, text: clause tables' rows (number, text); documents with fewer than `least` use paragraphs."""
    number = r"^\s*(\d+(?:\.\d+)*)"
    cell = F.col("cells")
    from_rows = rows.where("kind = 'row' and size(cells) = 2").select("doc", "n", F.regexp_extract(cell[0], number, 1).alias("number"), cell[1].alias("text")).where("number <> ''")
    enough = from_rows.groupBy("doc").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("doc")
    from_text = rows.where("kind = 'paragraph'").join(enough, "doc", "left_anti").select(
        "doc", "n", F.regexp_extract(cell[0], number, 1).alias("number"), F.trim(F.regexp_replace(cell[0], number + r"[.、]?", "")).alias("text")
    ).where("number <> ''")
    found = from_rows.join(enough, "doc", "left_semi").unionByName(from_text)
    return found.select("doc", "n", "number", F.regexp_extract("text", r"^([^\n。.:：]{1,40})", 1).alias("title"), "text")


def read_samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON dataset: a list of samples, or an object with a list of them."""
    wrapped = spark.read.schema(f"samples array<struct<{schema}>>").json(path, multiLine=True)
    inner = wrapped.where("samples is not null").select(F.explode("samples").alias("s")).select("s.*")
    return inner.unionByName(spark.read.schema(schema).json(path, multiLine=True).where(F.coalesce(*inner.columns[:1]).isNotNull()))


def save_samples(df: DataFrame, path: str) -> None:
    """A JSON dataset that read_samples() reads: a sample a line, in as many files as there are tasks, and beside it how many
    there are in all."""
    df.write.mode("overwrite").json(f"{path}/samples")
    spark = df.sparkSession
    spark.read.schema(df.schema).json(f"{path}/samples").agg(F.count("*").alias("total")).write.mode("overwrite").json(f"{path}/total")


def append_rows(df: DataFrame, path: str) -> None:
    """Adds rows to a table of files; a write that fails leaves nothing of its rows."""
    df.write.mode("append").parquet(path)


def without_parents(parents: DataFrame, children: list[DataFrame], gone: DataFrame, key: str) -> tuple[DataFrame, list[DataFrame]]:
    """Parents and all their children without the rows whose key is in gone."""
    keys = gone.select(key)
    return parents.join(keys, key, "left_anti"), [c.join(keys, key, "left_anti") for c in children]


def fingerprints(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """key, fingerprint: the first 12 hexadecimal digits of the SHA-256 of each key's ids, sorted as text and joined by commas.

    A key's ids pass one task in order, which keeps the state of the hash and no ids.
    """
    ids = rows.where(F.col(id_col).isNotNull()).select(key, F.col(id_col).cast("string").alias("id"))

    def rows_of(found: list[tuple]) -> pd.DataFrame:
        keys, prints = zip(*found, strict=True) if found else ((), ())
        return pd.DataFrame({key: pd.Series(keys, dtype=object), "fingerprint": pd.Series(prints, dtype=object)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for b in batches:
            out = []
            for k, one in zip(b[key], b["id"], strict=True):
                k = None if pd.isna(k) else k
                if sha is not None and k == now:
                    sha.update(b",")
                else:
                    if sha is not None:
                        out.append((now, sha.hexdigest()[:12]))
                    now, sha = k, hashlib.sha256()
                sha.update(one.encode())
            yield rows_of(out)
        if sha is not None:
            yield rows_of([(now, sha.hexdigest()[:12])])

    return ids.repartition(key).sortWithinPartitions(key, "id").mapInPandas(run, f"{key} {dict(ids.dtypes)[key]}, fingerprint string")


def write_snapshot(df: DataFrame, root: str, id_col: str) -> int:
    """Writes df as the next snapshot below root. Of writers at one time each gets a version; one that fails leaves nothing."""
    spark = df.sparkSession

    def write(base: commits.Commit | None, folder: str) -> dict:
        df.write.parquet(f"{folder}/rows")
        data = spark.read.schema(df.schema).parquet(f"{folder}/rows")
        found = fingerprints(data.select(F.lit(0).alias("all"), id_col), "all", id_col).first()
        return {"rows": data.count(), "fingerprint": found.fingerprint if found else "empty", "data": folder.rsplit("/", 1)[1], "schema": df.schema.jsonValue()}

    return commits.commit(spark, root, write).version


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """version, rows, fingerprint of all snapshots."""
    found = [commits.read_commit(spark, root, v) for v in commits.versions(spark, root)]
    return spark.createDataFrame([(c.version, c.content["rows"], c.content["fingerprint"]) for c in found], "version long, rows long, fingerprint string")


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A snapshot, the latest unless a version is given; ValueError if there is none."""
    found = commits.read_commit(spark, root, version)
    if found is None:
        raise ValueError(f"no snapshot below {root}")
    return spark.read.schema(StructType.fromJson(found.content["schema"])).parquet(f"{root}/data/{found.content['data']}/rows")


def report_markdown(metrics: DataFrame) -> DataFrame:
    """section, markdown: a table of each section's metrics. metrics: section, metric, value."""
    line = F.concat(F.lit("| "), "metric", F.lit(" | "), F.format_number("value", 4), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("metric", line.alias("line")))), lambda x: x.line)
    return metrics.groupBy("section").agg(F.concat(F.lit("| metric | value |\n| --- | --- |\n"), F.array_join(lines, "\n")).alias("markdown"))
