"""File and catalog targets: append, and replace that keeps the old data on failure.

All rows are written beside the target and counted back. The switch only renames, behind an intent record
(``switch.py``), so a run that fails, or whose driver is lost, leaves the old rows or the new ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sluiceway.sinks.base import (
    Folder,
    Pending,
    Sink,
    WriteError,
    aligned,
    counted,
    held_columns,
)
from sluiceway.sinks.switch import partition_columns, partition_parts, recover, staged, switch

# what CSV needs so that rows come back as they were written
_OPTIONS = {"csv": {"header": "true", "escape": '"', "nullValue": "\\N"}}
_COLUMNS = "_columns.json"


def _options(file_format: str, options: Mapping[str, str]) -> dict[str, str]:
    return {**_OPTIONS.get(file_format, {}), **options}


def stored_columns(spark: SparkSession, path: str) -> T.StructType | None:
    """The columns that a sink wrote beside its files, where the files do not hold them."""
    told = Folder(spark, f"{path.rstrip('/')}/{_COLUMNS}")
    return T.StructType.fromJson(json.loads(told.read_text())) if told.exists() else None


def folder_columns(
    spark: SparkSession, path: str, file_format: str, options: Mapping[str, str] | None = None
) -> T.StructType | None:
    """The columns of the files in a folder, None if there is no such folder.

    Stored columns go first; without them the files are asked, and text files know only the columns that they show.
    """
    if not Folder(spark, path).exists():
        return None
    stored = stored_columns(spark, path)
    if stored is not None:
        return stored
    return spark.read.format(file_format).options(**_options(file_format, options or {})).load(path).schema


def read_files(
    spark: SparkSession, path: str, file_format: str = "parquet", options: Mapping[str, str] | None = None
) -> DataFrame:
    """Rows of a folder that the sinks here wrote, with the columns they had."""
    reader = spark.read.format(file_format).options(**_options(file_format, options or {}))
    stored = stored_columns(spark, path)
    return (reader if stored is None else reader.schema(stored)).load(path)


@dataclass(frozen=True)
class _Files:
    """A folder of files. ``partition_by`` is for new folders; an existing one keeps the layout it has.

    ``schema`` tells the columns of an existing folder of text files that no sink here wrote.
    """

    path: str
    file_format: str = "parquet"
    fill_missing: bool = field(default=False, kw_only=True)
    options: Mapping[str, str] = field(default_factory=dict, kw_only=True)
    schema: T.StructType | str | None = field(default=None, kw_only=True)
    partition_by: Sequence[str] = field(default=(), kw_only=True)
    then: tuple[str, str] | None = field(default=None, kw_only=True)

    def held(self, spark: SparkSession) -> T.StructType | None:
        recover(spark, self.path)
        found = folder_columns(spark, self.path, self.file_format, self.options)
        if found is None or self.schema is None or stored_columns(spark, self.path) is not None:
            return found
        return self.schema if isinstance(self.schema, T.StructType) else T.StructType.fromDDL(self.schema)

    def _layout(self, spark: SparkSession) -> list[str]:
        """The partition columns: those of the folder, else the given ones."""
        if not Folder(spark, self.path).exists():
            return list(self.partition_by)
        found = partition_columns(spark, self.path)
        if self.partition_by and list(self.partition_by) != found:
            raise WriteError(f"{self.path} is partitioned by {found}, not by {list(self.partition_by)}")
        return found

    def _staged(self, df: DataFrame, held: T.StructType | None) -> tuple[str, int, list[str]]:
        """The rows in a folder beside the target: its path, their number, and the partition columns."""
        spark = df.sparkSession
        layout = self._layout(spark)
        missing = [name for name in layout if name not in df.columns]
        if missing:
            raise WriteError(f"columns of the partitions that the rows lack: {missing}")
        if held is not None:
            df = aligned(df, held, self.fill_missing)
        path = staged(spark, self.path)
        total = write_and_verify(df, Folder(spark, path), self.file_format, self.options, layout)
        return path, total, layout


@dataclass(frozen=True)
class AppendFiles(_Files):
    """Add files to an existing folder.

    As with other inserts, rows that were added stay when another target of the run fails; a batch
    that is told in a ledger (``then``) is taken back.
    """

    def stage(self, df: DataFrame) -> Pending:
        spark, held = df.sparkSession, self.held(df.sparkSession)
        if held is None:
            raise WriteError(f"target does not exist: {self.path}")
        path, total, _ = self._staged(df, held)
        # the names hold the writing job's id, so they are new in the target
        moved = switch(spark, self.path, path, Folder(spark, path).files() if total else (), then=self.then)
        pending = _pending(spark, moved, total, self.then is not None)
        if self.then is not None:
            return pending

        def commit() -> int:
            added = pending.commit()
            pending.finish()
            return added

        return Pending(commit, pending.discard)


@dataclass(frozen=True)
class ReplaceFiles(_Files):
    """Put new files in the place of a folder, in the same partitions. An output without rows changes nothing."""

    create: bool = field(default=True, kw_only=True)

    def stage(self, df: DataFrame) -> Pending:
        spark, held = df.sparkSession, self.held(df.sparkSession)
        if held is None and not self.create:
            raise WriteError(f"target does not exist: {self.path}")
        path, total, _ = self._staged(df, held)
        return _pending(spark, switch(spark, self.path, path, [""] if total else (), then=self.then), total, self.then is not None)


@dataclass(frozen=True)
class ReplacePartitions(_Files):
    """Replace those partitions of a folder that the rows have; the others stay as they are."""

    def stage(self, df: DataFrame) -> Pending:
        spark, held = df.sparkSession, self.held(df.sparkSession)
        if not self._layout(spark):
            raise WriteError(f"{self.path} has no partitions")
        path, total, layout = self._staged(df, held)
        parts = [""]
        if held is not None:  # one rename for each partition that the rows have
            parts = partition_parts(spark, path, len(layout))
        return _pending(spark, switch(spark, self.path, path, parts if total else (), then=self.then), total, self.then is not None)


def _pending(spark: SparkSession, moved, total: int, always: bool) -> Pending:
    """The switch as a pending write; without rows there is none, unless a record has to be told."""
    staging = Folder(spark, moved.staging)

    def commit() -> int:
        if total == 0 and not always:
            staging.remove()
            return 0
        moved.run()
        spark.catalog.refreshByPath(moved.target)
        return total

    def undo() -> None:
        if total or always:
            moved.undo()
            spark.catalog.refreshByPath(moved.target)

    return Pending(commit, staging.remove, undo, moved.finish if total or always else lambda: None, quick=True)


def write_and_verify(
    df: DataFrame,
    staging: Folder,
    file_format: str,
    options: Mapping[str, str] | None = None,
    partition_by: Sequence[str] = (),
) -> int:
    """Write to a fresh folder and compare the count with what can be read back.

    Where the files do not hold the columns (text formats, partitions) these are stored beside them.
    """
    rows, count = counted(df)
    settings = _options(file_format, options or {})
    try:
        writer = rows.write.format(file_format).options(**settings).mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).save(staging.path)
        total = count()
        reader = df.sparkSession.read.format(file_format).options(**settings).schema(df.schema)
        found = reader.load(staging.path).count()
        if found != total:
            raise WriteError(f"{staging.path} holds {found} rows instead of {total}")
        if partition_by or file_format in ("csv", "json"):
            Folder(df.sparkSession, f"{staging.path}/{_COLUMNS}").write_text(df.schema.json())
    except Exception:
        staging.remove()
        raise
    return total


def _detail(spark: SparkSession, table: str) -> dict[str, str]:
    return {
        row["col_name"]: row["data_type"]
        for row in spark.sql(f"DESCRIBE TABLE EXTENDED {table}")
        .where(F.col("col_name").isin("Location", "Provider"))
        .collect()
    }


def _partition_names(spark: SparkSession, table: str) -> list[str]:
    return [column.name for column in spark.catalog.listColumns(table) if column.isPartition]


@dataclass(frozen=True)
class AppendTable:
    """Insert into an existing catalog table, by column name.

    With ``then``, a record that is to be written together with the rows, the files of an unpartitioned
    table are put into its folder by renames.
    """

    table: str
    fill_missing: bool = False
    then: tuple[str, str] | None = None

    def held(self, spark: SparkSession) -> T.StructType:
        return spark.table(self.table).schema

    def stage(self, df: DataFrame) -> Pending:
        spark = df.sparkSession
        if self.then is not None:
            return self._stage_files(df)
        rows, count = counted(aligned(df, self.held(spark), self.fill_missing))

        def commit() -> int:
            rows.write.insertInto(self.table)
            return count()

        return Pending(commit)

    def _stage_files(self, df: DataFrame) -> Pending:
        spark = df.sparkSession
        detail = _detail(spark, self.table)
        provider = detail["Provider"].lower()
        if _partition_names(spark, self.table) or provider not in ("parquet", "orc"):
            raise WriteError(f"{self.table} cannot take rows together with a record")
        recover(spark, detail["Location"])
        files = AppendFiles(detail["Location"], provider, then=self.then)
        inner = files.stage(aligned(df, self.held(spark), self.fill_missing))

        def commit() -> int:
            total = inner.commit()
            spark.catalog.refreshTable(self.table)
            return total

        def undo() -> None:
            inner.undo()
            spark.catalog.refreshTable(self.table)

        return Pending(commit, inner.discard, undo, inner.finish, quick=True)


@dataclass(frozen=True)
class ReplaceTable:
    """Point a catalog table at a newly written folder.

    The switch is one catalog change, also on stores without renames; a partitioned table takes one for each
    partition, which a failure takes back one by one. Partitions that the new rows do not have are
    pointed at an empty folder and dropped at the end. The old folders stay for readers that are still on them, unless
    ``drop_old``.
    """

    table: str
    drop_old: bool = False
    fill_missing: bool = False
    repeatable = True

    def held(self, spark: SparkSession) -> T.StructType:
        return spark.table(self.table).schema

    def stage(self, df: DataFrame) -> Pending:
        spark = df.sparkSession
        layout = _partition_names(spark, self.table)
        detail = _detail(spark, self.table)
        rows = aligned(df, self.held(spark), self.fill_missing)
        base = detail["Location"].split(".version-")[0].rstrip("/")
        fresh = Folder(spark, f"{base}.version-{uuid.uuid4().hex}")
        total = write_and_verify(rows, fresh, detail["Provider"], partition_by=layout)
        if layout:
            moved = _Partitions(spark, self.table, layout, fresh.path)
        else:
            moved = _Location(spark, self.table, detail["Location"], fresh.path)

        def commit() -> int:
            if total == 0:
                fresh.remove()
                return 0
            try:
                moved.run()
            except Exception:
                moved.undo()
                raise
            return total

        def undo() -> None:
            if total:
                moved.undo()
                fresh.remove()

        def finish() -> None:
            if total:
                moved.finish(self.drop_old)

        return Pending(commit, fresh.remove, undo, finish, quick=True)


@dataclass
class _Location:
    """The folder of an unpartitioned table."""

    spark: SparkSession
    table: str
    before: str
    after: str

    def _point_to(self, path: str) -> None:
        self.spark.sql(f"ALTER TABLE {self.table} SET LOCATION '{path}'")
        self.spark.catalog.refreshTable(self.table)

    def run(self) -> None:
        self._point_to(self.after)

    def undo(self) -> None:
        self._point_to(self.before)

    def finish(self, drop_old: bool) -> None:
        if drop_old:
            Folder(self.spark, self.before).remove()


class _Partitions:
    """The folders of a table's partitions, as the catalog has them."""

    def __init__(self, spark: SparkSession, table: str, names: list[str], fresh: str):
        self.spark, self.table, self.fresh = spark, table, fresh
        self.before = {
            part: self._location(part) for part in (r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect())
        }
        self.after = partition_parts(spark, fresh, len(names))
        self._moved: list[str] = []
        self._added: list[str] = []

    def _spec(self, part: str) -> str:
        told = []
        for level in part.split("/"):
            name, value = level.split("=", 1)
            value = unquote(value)
            if value == "__HIVE_DEFAULT_PARTITION__":
                told.append(f"`{name}` = null")
            else:
                text = value.replace("\\", "\\\\").replace("'", "\\'")
                told.append(f"`{name}` = '{text}'")  # the catalog casts it to the column's type
        return ", ".join(told)

    def _location(self, part: str) -> str:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.table} PARTITION ({self._spec(part)})")
        return rows.where("col_name = 'Location'").first()["data_type"]

    def _point(self, part: str, path: str) -> None:
        self.spark.sql(f"ALTER TABLE {self.table} PARTITION ({self._spec(part)}) SET LOCATION '{path}'")

    def run(self) -> None:
        for part in self.after:
            path = f"{self.fresh}/{part}"
            if part in self.before:
                self._moved.append(part)
                self._point(part, path)
            else:
                self._added.append(part)
                self.spark.sql(f"ALTER TABLE {self.table} ADD PARTITION ({self._spec(part)}) LOCATION '{path}'")
        for part in self.before:
            if part not in self.after:
                empty = Folder(self.spark, f"{self.fresh}/_none/{part}")
                Folder(self.spark, f"{empty.path}/.").make_parent()
                self._moved.append(part)
                self._point(part, empty.path)
        self.spark.catalog.refreshTable(self.table)

    def undo(self) -> None:
        for part in self._moved:
            self._point(part, self.before[part])
        for part in self._added:
            self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION ({self._spec(part)})")
        self._moved, self._added = [], []
        self.spark.catalog.refreshTable(self.table)

    def finish(self, drop_old: bool) -> None:
        for part in set(self.before) - set(self.after):
            self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION ({self._spec(part)})")
        if drop_old:
            for path in self.before.values():
                Folder(self.spark, path).remove()
        self.spark.catalog.refreshTable(self.table)


@dataclass(frozen=True)
class DryRun:
    """Run everything but the write, against the columns of ``of`` if it is given."""

    of: Sink | None = None
    repeatable = True

    @property
    def fill_missing(self) -> bool:
        return getattr(self.of, "fill_missing", False)

    def held(self, spark: SparkSession) -> T.StructType | None:
        return held_columns(self.of, spark)

    def stage(self, df: DataFrame) -> Pending:
        rows, count = counted(df)
        rows.write.format("noop").mode("overwrite").save()
        return Pending(count, quick=True, skipped=True)
