"""Database targets over JDBC: parallel batched inserts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sluiceway.session import new_scratch_path
from sluiceway.sinks.base import Folder, Pending, counted
from sluiceway.sinks.files import write_and_verify
from sluiceway.sources.database import Database

BATCH_ROWS = 1000


def writer_options(
    database: Database, table: str, batch_rows: int, connections: int | None, truncate: bool
) -> dict[str, str]:
    """The Spark JDBC options of one write."""
    options = {
        **database.properties,
        "url": database.url,
        "dbtable": table,
        "batchsize": str(batch_rows),
    }
    if connections is not None:
        options["numPartitions"] = str(connections)  # upper limit of parallel inserts
    if truncate:
        options["truncate"] = "true"  # keep the table's definition
    return options


@dataclass(frozen=True)
class AppendDatabase:
    """Insert into an existing database table.

    Each task commits its own rows. A task that is run again after it committed
    inserts them twice, so let the target's key refuse duplicates.
    """

    database: Database
    table: str
    batch_rows: int = BATCH_ROWS
    connections: int | None = None

    def stage(self, df: DataFrame) -> Pending:
        rows, count = counted(df)
        options = writer_options(
            self.database, self.table, self.batch_rows, self.connections, truncate=False
        )

        def commit() -> int:
            rows.write.format("jdbc").options(**options).mode("append").save()
            return count()

        return Pending(commit)


@dataclass(frozen=True)
class ReplaceDatabase:
    """Truncate a database table and insert anew.

    The rows are computed into the shared scratch folder first: if that fails or
    gives no rows, the target is not truncated.
    """

    database: Database
    table: str
    batch_rows: int = BATCH_ROWS
    connections: int | None = None

    def stage(self, df: DataFrame) -> Pending:
        spark = df.sparkSession
        staging = Folder(spark, new_scratch_path(spark, "database"))
        total = write_and_verify(df, staging, "parquet")
        options = writer_options(
            self.database, self.table, self.batch_rows, self.connections, truncate=True
        )

        def commit() -> int:
            if total:
                staged = spark.read.schema(df.schema).parquet(staging.path)
                staged.write.format("jdbc").options(**options).mode("overwrite").save()
            staging.remove()
            return total

        return Pending(commit, staging.remove)
