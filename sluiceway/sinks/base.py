"""The two halves of a write: everything that may fail, then the switch."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from sluiceway.functions.conversion import loses_fraction
from sluiceway.functions.expression import quoted
from sluiceway.sinks.progress import watched


class WriteError(RuntimeError):
    """The target was left as it was."""


@dataclass
class Pending:
    """A write that is ready to be switched in or dropped.

    ``commit`` returns the number of rows written. It is ``quick`` if all rows
    are computed and only a switch is left. ``discard`` drops what was staged, before a
    commit only. After a commit ``undo``, where there is one, puts the old rows back,
    and ``finish`` drops what only an undo needs.
    """

    commit: Callable[[], int]
    discard: Callable[[], None] = lambda: None
    undo: Callable[[], None] | None = None
    finish: Callable[[], None] = lambda: None
    quick: bool = False
    skipped: bool = False


class Sink(Protocol):
    """Where rows go. A sink may also have ``held(spark)``: the columns that an existing
    target has, or None. They are the target's contract where none is declared.
    """

    def stage(self, df: DataFrame) -> Pending: ...


def held_columns(sink: Sink, spark: SparkSession) -> T.StructType | None:
    held = getattr(sink, "held", None)
    return None if held is None else held(spark)


def write(df: DataFrame, sink: Sink, progress: Callable[[int], None] | None = None) -> int:
    """Stage and commit in one go; the number of rows written.

    ``progress`` is told the rows of finished tasks while they are staged, and again from
    0 while a database or table takes them.
    """
    with watched(df.sparkSession, progress):
        pending = sink.stage(df)
    try:
        with watched(df.sparkSession, progress):
            total = pending.commit()
    except Exception:
        pending.discard()
        raise
    pending.finish()
    return total


def counted(df: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
    """``df`` that counts its rows while it is written, and the count to read after."""
    seen = Observation(f"rows_{uuid.uuid4().hex}")
    observed = df.observe(seen, F.count(F.lit(1)).alias("n"))

    def rows() -> int:
        try:
            return seen.get["n"]
        except Py4JError:  # the optimizer found the plan to be empty and dropped the counter
            return df.count()

    return observed, rows


def aligned(df: DataFrame, target: T.StructType, fill_missing: bool = False) -> DataFrame:
    """``df`` with the target's columns, order and types, matched by name.

    A column that the target does not have is an error, and so is a target column that
    ``df`` lacks, unless ``fill_missing`` asks for nulls. A number that would
    lose its fraction stops the write.
    """
    unknown = [name for name in df.columns if name not in target.names]
    if unknown:
        raise WriteError(f"columns not in the target: {unknown}")
    missing = [name for name in target.names if name not in df.columns]
    if missing and not fill_missing:
        raise WriteError(f"columns of the target that the rows lack: {missing}")
    return df.select(
        *[
            (_whole_value(df, f) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in target.fields
        ]
    )


def _whole_value(df: DataFrame, target: T.StructField) -> Column:
    value, current = quoted(target.name), df.schema[target.name].dataType
    cast = value.cast(target.dataType)
    if not loses_fraction(current, target.dataType):
        return cast
    told = F.concat(F.lit(f"{target.name} would lose its fraction: "), value.cast("string"))
    return F.when(value.isNull() | (cast == value), cast).otherwise(
        F.raise_error(told).cast(target.dataType)
    )


class Folder:
    """A path, of a folder or a file, on whatever file system the session reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark = spark
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._new_path = jvm.org.apache.hadoop.fs.Path
        self.path = path

    @property
    def name(self) -> str:
        return self._path.getName()

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def is_directory(self) -> bool:
        return self.exists() and self._fs.getFileStatus(self._path).isDirectory()

    def age_hours(self) -> float:
        """Hours since the last change of the folder itself."""
        return (time.time() - self._fs.getFileStatus(self._path).getModificationTime() / 1000) / 3600

    def _entries(self, path, folders: bool) -> list[Folder]:
        if not self._fs.exists(path):
            return []
        found = [status for status in self._fs.listStatus(path) if status.isDirectory() or not folders]
        return [Folder(self._spark, status.getPath().toString()) for status in found]

    def folders(self) -> list[Folder]:
        """The folders directly below."""
        return self._entries(self._path, True)

    def siblings(self) -> list[Folder]:
        """Everything in the same folder, this included."""
        return self._entries(self._path.getParent(), False)

    def files(self) -> list[str]:
        """Relative paths of all data files below; names that begin with ``_`` or ``.`` are none."""
        found = self._fs.listFiles(self._path, True)
        base = self._fs.makeQualified(self._path).toString().rstrip("/")
        out = []
        while found.hasNext():
            path = found.next().getPath()
            if not path.getName().startswith(("_", ".")):
                out.append(self._fs.makeQualified(path).toString()[len(base) + 1 :])
        return sorted(out)

    def make_parent(self) -> None:
        self._fs.mkdirs(self._path.getParent())

    def write_text(self, text: str) -> None:
        stream = self._fs.create(self._path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def read_text(self) -> str:
        stream = self._fs.open(self._path)
        try:
            return self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def move_to(self, path: str) -> None:
        if not self._fs.rename(self._path, self._new_path(path)):
            raise WriteError(f"could not rename {self.path} to {path}")

    def remove(self) -> None:
        self._fs.delete(self._path, True)
