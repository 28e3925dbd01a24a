"""Records of a text file that go over several lines, read by many tasks.

A line break ends a record only outside quotes. Whether a block of the file begins inside quotes is the parity of all
quotes before it: a prefix sum over one number for each block. With it every task cuts its own block
into records; those that go over the edge of a block come as pieces and are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

WHOLE, BEGIN, MIDDLE, END = 0, 1, 2, 3

_PIECES = "file string, block bigint, kind int, record string, header boolean"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines with the file and the block, by its first byte, that they begin in."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _inside_at(lines: DataFrame) -> dict[str, dict[int, bool]]:
    """For every block of every file, whether it begins inside quotes. One row for each block comes to the driver."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2 == 1).alias("odd"))
    found: dict[str, dict[int, bool]] = {}
    told = sorted((r["file"], r["block"], r["odd"]) for r in odd.collect())
    for file, blocks in groupby(told, key=lambda row: row[0]):
        inside, found[file] = False, {}
        for _, block, odd_ in blocks:
            found[file][block] = inside
            inside ^= odd_
    return found


class _Cutter:
    """Cuts the lines of one block into records and pieces of records."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.inside = file, block, inside
        self.cut, self.first = inside, block == 0  # goes on from the block before; the file's first record is its header
        self.open: list[str] = []

    def take(self, line: str) -> Iterator[tuple[int, str, bool]]:
        self.open.append(line)
        self.inside ^= bool(line.count('"') & 1)
        if not self.inside:
            yield END if self.cut else WHOLE, "\n".join(self.open), self.first
            self.open, self.cut, self.first = [], False, False

    def rest(self) -> Iterator[tuple[int, str, bool]]:
        if self.open:
            yield MIDDLE if self.cut else BEGIN, "\n".join(self.open), self.first


def _cut(inside_at, pieces: bool):
    """Whole records, or the pieces of those that no block holds whole."""

    def wanted(found: Iterator[tuple[int, str, bool]], cutter: _Cutter) -> Iterator[tuple]:
        for kind, record, header in found:
            if (kind != WHOLE) == pieces:
                yield cutter.file, cutter.block, kind, record, header

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
            names=["file", "block", "kind", "record", "header"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = None
        for part in batches:
            rows: list[tuple] = []
            files, blocks, lines = (column.to_pylist() for column in part.columns)
            for file, block, line in zip(files, blocks, lines, strict=True):
                if cutter is None or (file, block) != (cutter.file, cutter.block):
                    if cutter is not None:
                        rows.extend(wanted(cutter.rest(), cutter))
                    cutter = _Cutter(file, block, inside_at.value[file][block])
                rows.extend(wanted(cutter.take(line), cutter))
            yield batch(rows)
        if cutter is not None:
            yield batch(list(wanted(cutter.rest(), cutter)))

    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the text of every record below the headers, without the line break that ends it.

    Quotes stand around a whole value or doubled inside one. Each file begins with a header. A quote that the
    file never closes stops the read. The lines are read three times: for the parities, the records
    and the few pieces at the edges of blocks.
    """
    lines = _lines(spark, path)
    # a flag and a number for each block, fewer than the driver's own list of blocks
    inside_at = spark.sparkContext.broadcast(_inside_at(lines))
    whole = lines.mapInArrow(_cut(inside_at, False), _PIECES).where("not header").select("record")
    order = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == BEGIN, 1).otherwise(0))
    joined = (
        lines.mapInArrow(_cut(inside_at, True), _PIECES)
        .withColumn("number", F.count_if(F.col("kind") == BEGIN).over(order))
        .groupBy("file", "number")
        .agg(
            F.sort_array(F.collect_list(F.struct("block", "record"))).alias("parts"),
            F.bool_or("header").alias("header"),
            F.bool_or(F.col("kind") == END).alias("closed"),
        )
        .where("not header")
    )
    unclosed = F.raise_error(F.concat(F.lit("Malformed record: a quote is never closed in "), F.col("file")))
    text = F.when(F.col("closed"), F.array_join("parts.record", "\n")).otherwise(unclosed.cast("string"))
    return whole.unionAll(joined.select(text.alias("record")))
