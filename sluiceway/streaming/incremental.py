"""Incremental run of row-wise steps, or of whole flows, with Structured Streaming.

The checkpoint remembers which files were taken. Each run takes the new ones,
writes and stops. Steps that need more than the new rows (grouping, sorting)
are refused by Spark itself, because they would be wrong on a part of the data; a whole flow sees
one batch of new rows as if it were its source.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, types as T

from sluiceway.operators.columns import TableStep
from sluiceway.operators.sqlsteps import StepError
from sluiceway.plans.flow import Flow, RunReport
from sluiceway.sinks.base import Folder, Pending, Sink, WriteError, held_columns


@dataclass(frozen=True)
class NewFiles:
    """A folder that files arrive in. ``files_per_batch`` bounds one micro-batch."""

    path: str
    schema: T.StructType | None = None
    file_format: str = "parquet"
    files_per_batch: int = 1000

    def stream(self, spark: SparkSession) -> DataFrame:
        # a single file is read through its folder, as a stream needs a folder
        folder, _, name = self.path.rstrip("/").rpartition("/")
        schema = self.schema or spark.read.format(self.file_format).load(self.path).schema
        reader = (
            spark.readStream.format(self.file_format)
            .schema(schema)
            .option("maxFilesPerTrigger", self.files_per_batch)
        )
        if Folder(spark, self.path).is_directory():
            return reader.load(self.path)
        return reader.option("pathGlobFilter", name).load(folder)


def run_new(
    spark: SparkSession,
    source: NewFiles,
    steps: Iterable[TableStep],
    checkpoint: str,
    target: str | None = None,
    each_batch: Callable[[DataFrame, int], None] | None = None,
) -> int:
    """Take the rows of new files through the steps; the number of rows read.

    With ``target`` the rows go to Parquet files whose log makes each batch
    count once, also when it is tried again. ``each_batch`` gets every batch
    and its id instead, for other sinks; a batch may come twice with one id.
    """
    if (target is None) == (each_batch is None):
        raise ValueError("give either a target folder or a function for each batch")
    rows = reduce(lambda df, step: df.transform(step), steps, source.stream(spark))
    writer = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if target is not None:
        query = writer.format("parquet").outputMode("append").option("path", target).start()
    else:
        query = writer.foreachBatch(each_batch).start()
    # Spark keeps the last hundred progress reports only, so they are read on the way
    taken: dict[int, int] = {}
    finished = False
    while not finished:
        finished = query.awaitTermination(1)
        for progress in query.recentProgress:
            batch = progress["batchId"]
            taken[batch] = max(taken.get(batch, 0), progress["numInputRows"])
    return sum(taken.values())


@dataclass(frozen=True)
class BatchLedger:
    """What every batch of a stream has brought to every target, one small file each.

    An entry is committed with the rows: the switch of a file sink writes it as its last act, and a
    run that finds an unfinished switch completes both or takes back both.
    """

    path: str

    def entry(self, stream: str, batch: int, target: str) -> str:
        return f"{self.path.rstrip('/')}/{stream}/{batch:012d}-{target}.json"

    def rows(self, spark: SparkSession, entry: str) -> int | None:
        """Rows that the batch has brought, None if it has not."""
        told = Folder(spark, entry)
        return json.loads(told.read_text())["rows"] if told.exists() else None


@dataclass(frozen=True)
class Once:
    """A sink for one batch: nothing is written if the ledger has the batch.

    File sinks and unpartitioned tables write the entry with the rows. A sink without ``then`` that replaces all it has
    is written again when a batch comes twice, with the same result; one that inserts is refused.
    """

    sink: Sink
    ledger: BatchLedger
    entry: str

    @property
    def fill_missing(self) -> bool:
        return getattr(self.sink, "fill_missing", False)

    def held(self, spark: SparkSession) -> T.StructType | None:
        return held_columns(self.sink, spark)

    def stage(self, df: DataFrame) -> Pending:
        spark = df.sparkSession
        held_columns(self.sink, spark)  # completes what a lost run began, with its entry
        if self.ledger.rows(spark, self.entry) is not None:
            return Pending(lambda: 0, quick=True, skipped=True)
        Folder(spark, self.entry).make_parent()
        if hasattr(self.sink, "then"):
            n = df.count()
            return replace(self.sink, then=(self.entry, json.dumps({"rows": n}))).stage(df)
        if not getattr(self.sink, "repeatable", False):
            raise WriteError(f"{type(self.sink).__name__} cannot tell whether a batch came before")
        pending = self.sink.stage(df)

        def commit() -> int:
            total = pending.commit()
            Folder(spark, self.entry).write_text(json.dumps({"rows": total}))
            return total

        def undo() -> None:
            Folder(spark, self.entry).remove()
            pending.undo()

        return replace(pending, commit=commit, undo=undo if pending.undo else None)


@dataclass
class StreamReport:
    """``rows_read`` of the new files, and the run of the flow on each batch."""

    rows_read: int = 0
    batches: dict[int, RunReport] = field(default_factory=dict)

    @property
    def rows(self) -> dict[str, int]:
        """Rows written, by target."""
        total: dict[str, int] = {}
        for report in self.batches.values():
            for target, n in report.rows.items():
                total[target] = total.get(target, 0) + n
        return total


def run_flow(
    spark: SparkSession,
    source: NewFiles,
    flow: Callable[[DataFrame], Flow],
    checkpoint: str,
    ledger: BatchLedger,
    **options,
) -> StreamReport:
    """Run a whole flow, with its contracts and targets, on every batch of new files.

    ``flow`` makes the flow for the rows of a batch, which belong to a session of their own (``batch.sparkSession``):
    its other sources are tables, queries or frames of that session. ``options`` go to its ``run``. A batch counts once
    in every target, also when it comes again after a failure or a lost driver: the ledger tells which targets have
    it, and only the others are written. A run that fails ends the stream; its files come again next time. Entries
    belong to the checkpoint: with a new one all files are new.
    """
    report = StreamReport()

    def each(batch: DataFrame, number: int) -> None:
        stream = json.loads(Folder(spark, f"{checkpoint.rstrip('/')}/metadata").read_text())["id"]
        made = flow(batch)
        targets = [
            replace(t, sink=Once(t.sink, ledger, ledger.entry(stream, number, t.name))) for t in made.targets
        ]
        run = Flow(batch.sparkSession, made.steps, targets).run(**options)
        report.batches[number] = run
        # Spark's progress counts rows again for every target that reads them
        report.rows_read += batch.count()
        if run.status != "completed":
            raise StepError(run.error)

    writer = source.stream(spark).writeStream.option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return report
