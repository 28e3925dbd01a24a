"""Text tables: CSV with a header row, every value a string."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sluiceway.functions.expression import quoted
from sluiceway.sources.stitched import records


def read_text_table(
    spark: SparkSession,
    path: str,
    multiline: bool = False,
    null_text: str | None = "",
) -> DataFrame:
    """All columns as text, under the names of the header.

    A missing value reads as ``null_text``; give ``None`` to read null. Quotes
    inside a quoted value are doubled. ``multiline`` allows line breaks inside
    quotes, in files of any size: many tasks read one file (see ``stitched.py``). Every file has a header.

    A record with fewer or more values than the header fails the read, whichever columns
    are asked for; none is padded. So a record that a line break tears fails as well without ``multiline``,
    unless all its pieces happen to have as many values as the header; with it there are no pieces.
    """
    reader = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("columnPruning", False)
    )
    if multiline:
        # only the first record is looked at
        names = reader.option("multiLine", True).csv(path).columns
        df = _values(records(spark, path), names)
    else:
        df = reader.csv(path)
    if null_text is None:
        return df
    return df.select(
        *[F.coalesce(quoted(name), F.lit(null_text)).alias(name) for name in df.columns]
    )


def _values(found: DataFrame, names: list[str]) -> DataFrame:
    """The values of each record under the names; a record of another width stops the read."""
    columns = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    text = F.regexp_replace("record", "\\r$", "")
    options = {"escape": '"', "mode": "FAILFAST", "columnNameOfCorruptRecord": "_bad"}
    parsed = found.where(F.trim("record", F.lit(" \t\r")) != "").select(
        F.from_csv(text, columns.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("v")
    )
    return parsed.select(*[F.col(f"v._{i}").alias(name) for i, name in enumerate(names)])
