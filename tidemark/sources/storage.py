"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder in local mode, as in tests; on a cluster an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tidemark.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.shared.dir", at)
    return at


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"


#: Tables that the current thread's innermost scope() has made; none outside of one.
_scope: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def _write(df: DataFrame) -> tuple[str, DataFrame]:
    at = fresh_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(at)
    return at, df.sparkSession.read.schema(df.schema).parquet(at)


def _kept(at: str) -> None:
    if (tables := _scope.get()) is not None:
        tables.append(at)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: it is computed once, and a lost executor takes nothing with it.

    The table stays until the scope() in which it was made ends, or until forget().
    """
    at, out = _write(df)
    _kept(at)
    return out


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Deletes the tables of written() that df reads."""
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(r"/tidemark-[0-9a-f]{32}$", at):
            _delete(df.sparkSession, at)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """At its end, the tables that written() made within it, in this thread, are deleted; what others made stays."""
    tables: list[str] = []
    token = _scope.set(tables)
    try:
        yield
    finally:
        _scope.reset(token)
        for at in tables:
            _delete(spark, at)


def staged(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """written(make()), after which the tables that make() wrote on its way are deleted."""
    with scope(spark):
        at, out = _write(make())
    _kept(at)
    return out
