"""Versioned tables of files: data first, then one commit file that is created only if it isn't there yet.

A version is what its commit file names. A writer takes the number after the latest one; if another writer was faster, the
file exists, and it tries the next number, or does its work again where that rests on the version it read. What a writer
that failed or lost has written is deleted, and nobody reads it before.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Outdated(Exception):
    """The version that a writer started from isn't the latest any more."""


@dataclass(frozen=True)
class Commit:
    version: int
    content: dict = field(default_factory=dict)


def _fs(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _created(spark: SparkSession, at: str, text: str) -> bool:
    """Creates a file with this text in one step; False if it exists. A file of that name is never seen half written."""
    jvm = spark.sparkContext._jvm
    path, fs = _fs(spark, at)
    fs.mkdirs(path.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(draft.toUri().getPath(), path.toUri().getPath())  # unlike a rename it never takes another's place
            return True
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context.rename(draft, path, rename)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(draft, False)


def versions(spark: SparkSession, root: str) -> list[int]:
    path, fs = _fs(spark, f"{root}/commits")
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))


def read_commit(spark: SparkSession, root: str, version: int | None = None) -> Commit | None:
    """A version's commit, the latest unless given; None if the table has none. ValueError if there is no such version."""
    known = versions(spark, root)
    if version is None and not known:
        return None
    if version is not None and version not in known:
        raise ValueError(f"no version {version} below {root}")
    version = known[-1] if version is None else version
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(f"{root}/commits/{version:020d}.json").collect())
    return Commit(version, json.loads(text))


def commit(
    spark: SparkSession, root: str, write: Callable[[Commit | None, str], dict], *, rests_on_base: bool = False, tries: int = 20
) -> Commit:
    """Makes a version. write(the latest commit, a folder of its own) writes data and gives the content of the commit.

    rests_on_base: the data is only right on top of the version that write() was given; if another comes between, it is
    written anew. Otherwise only the number changes, and data is written once. After `tries` lost races: Outdated.
    """
    base = read_commit(spark, root)
    folder, content = None, {}
    try:
        for _ in range(tries):
            if folder is None:
                folder = f"{root}/data/{uuid.uuid4().hex}"
                content = write(base, folder)
            version = (base.version if base else 0) + 1
            if _created(spark, f"{root}/commits/{version:020d}.json", json.dumps(content)):
                done, folder = folder, None
                return Commit(version, content | {"folder": done})
            base = read_commit(spark, root)
            if rests_on_base:
                remove(spark, folder)
                folder = None
        raise Outdated(f"{tries} writers were faster below {root}")
    finally:
        if folder is not None:
            remove(spark, folder)


def remove(spark: SparkSession, at: str) -> None:
    path, fs = _fs(spark, at)
    fs.delete(path, True)


def table_of(spark: SparkSession, at: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).parquet(at) if schema else spark.read.parquet(at)
