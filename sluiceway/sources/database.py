"""Database source over JDBC, read in parallel ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Database:
    """How to reach a database; ``properties`` holds user, driver and so on."""

    url: str
    properties: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def postgres(
        cls, host: str, database: str, user: str, password: str, port: int = 5432
    ) -> Database:
        return cls(
            f"jdbc:postgresql://{host}:{port}/{database}",
            {"user": user, "password": password, "driver": "org.postgresql.Driver"},
        )


@dataclass(frozen=True)
class Ranges:
    """Split a read into ``partitions`` ranges of a numeric, date or time column.

    Rows outside the bounds are still read, by the first and last range. For an
    unevenly filled column give ``read_database`` a list of predicates instead.
    """

    column: str
    lower: object
    upper: object
    partitions: int


def reader_options(
    database: Database,
    table: str | None = None,
    query: str | None = None,
    ranges: Ranges | None = None,
    fetch_rows: int = 10_000,
) -> dict[str, str]:
    """The Spark JDBC options of one read."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    # Spark allows range partitioning on dbtable only, so a query goes in brackets
    relation = table if table is not None else f"(\n{query}\n) AS _src"
    options = {
        **database.properties,
        "url": database.url,
        "dbtable": relation,
        "fetchsize": str(fetch_rows),
    }
    if ranges is not None:
        options.update(
            partitionColumn=ranges.column,
            lowerBound=str(ranges.lower),
            upperBound=str(ranges.upper),
            numPartitions=str(ranges.partitions),
        )
    return options


def read_database(
    spark: SparkSession,
    database: Database,
    table: str | None = None,
    query: str | None = None,
    ranges: Ranges | None = None,
    predicates: Sequence[str] | None = None,
    fetch_rows: int = 10_000,
) -> DataFrame:
    """Rows of a table or query. Filters and column lists reach the database.

    Without ``ranges`` or ``predicates`` one task reads everything, which is
    right for small tables only.
    """
    options = reader_options(database, table, query, ranges, fetch_rows)
    if predicates is not None:
        url, relation = options.pop("url"), options.pop("dbtable")
        return spark.read.jdbc(
            url, relation, predicates=list(predicates), properties=options
        )
    return spark.read.format("jdbc").options(**options).load()
