"""Inputs that a query and its SQL form share: one statement that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tables import table


#: Rows that a task sorts, about.
ROWS_PER_TASK = 1 << 19


def given(spark: SparkSession, sf: str, sql: str, **by: str) -> DataFrame:
    """The rows of a statement that names its tables in braces. by: of a table the column by which the statement groups its rows;
    they are dealt by it, in as many tasks as their number asks for."""
    return spark.sql(sql, **{name: _dealt(table(spark, sf, name), by.get(name)) for name in set(re.findall(r"\{(\w+)\}", sql))})


def _dealt(rows: DataFrame, by: str | None) -> DataFrame:
    """As Spark deals them, where the usual number of partitions is enough."""
    tasks = -(-rows.count() // ROWS_PER_TASK) if by else 0
    return rows.repartition(tasks, by) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def plain(sql: str) -> str:
    """The same statement for DuckDB, where the tables are views."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)
