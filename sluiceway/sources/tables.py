"""Table and query sources, samples and the row-count guard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluiceway.functions.expression import quoted
from sluiceway.operators.sqlsteps import run_select


def read_table(
    spark: SparkSession,
    table: str,
    columns: Sequence[str] | None = None,
    file_format: str = "parquet",
) -> DataFrame:
    """A catalog table, or a path where the name holds a slash; all or some columns."""
    if "/" in table:
        df = spark.read.format(file_format).load(table)
    else:
        df = spark.table(table)
    return df if columns is None else df.select(*[quoted(name) for name in columns])


def read_query(
    spark: SparkSession, query: str, tables: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """A query source. The text is wrapped, never edited, and must be a SELECT."""
    return run_select(spark, query, tables)


def sample(df: DataFrame, rows: int = 10, order_by: str | list[str] | None = None) -> DataFrame:
    """The first ``rows`` rows, at least one; fixed ones when ordered by a key."""
    ordered = df if order_by is None else df.orderBy(order_by)
    return ordered.limit(max(1, rows))


class RowLimitExceeded(ValueError):
    """The source holds more rows than the run may take."""


def guard_row_count(df: DataFrame, row_limit: int) -> int:
    """The row count, or an error if it is above ``row_limit``.

    The count is spread over all executors; on a plain Parquet source it reads
    file footers only.
    """
    total = df.count()
    if total > row_limit:
        raise RowLimitExceeded(
            f"Source table has {total} rows which exceeds the limit of {row_limit}"
        )
    return total


def row_count_report(df: DataFrame, row_limit: int) -> DataFrame:
    """The guard's answer as one lazy row: the count and whether it is allowed."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(row_limit).cast("bigint").alias("row_limit"),
        (F.col("n_rows") <= row_limit).alias("within_limit"),
    )
