"""Does a Python step keep its schema over all of its input?"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

if TYPE_CHECKING:
    import pandas as pd
    import pyarrow as pa


def observed_schemas(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """The column names and types that ``fn`` returns over all batches of ``df``.

    Each batch reports its own columns; only these few rows are shuffled. A
    column that holds nothing but nulls in a batch has type ``null`` there.
    """

    def report(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas
        import pyarrow

        for part in parts:
            result = fn(part)
            schema = pyarrow.Schema.from_pandas(result, preserve_index=False)
            yield pandas.DataFrame(
                {
                    "position": range(1, len(schema) + 1),
                    "column": [str(name) for name in schema.names],
                    "type": [str(kind) for kind in schema.types],
                    "n_rows": len(result),
                }
            )

    seen = df.mapInPandas(report, "position bigint, column string, type string, n_rows bigint")
    return seen.groupBy("position", "column", "type").agg(F.sum("n_rows").alias("n_rows"))


def schema_stability(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """One row per column: the types and rows seen, and whether it is stable.

    A stable column has one type and one place and is present in every batch.
    """
    typed = F.when(F.col("type") != "null", F.col("type"))
    per_column = (
        observed_schemas(df, fn)
        .groupBy("column")
        .agg(
            F.array_join(F.array_sort(F.collect_set(typed)), ",").alias("types"),
            F.count_distinct(typed).alias("n_types"),
            F.count_distinct("position").alias("n_positions"),
            F.sum("n_rows").alias("n_rows"),
        )
    )
    # a window over one row per column
    most_rows = F.max("n_rows").over(Window.partitionBy(F.lit(0)))
    steady = (F.col("n_types") <= 1) & (F.col("n_positions") == 1)
    return per_column.select(
        "column",
        "types",
        "n_positions",
        "n_rows",
        (steady & (F.col("n_rows") == most_rows)).alias("is_stable"),
    )


def _extremes(kind: T.DataType) -> list:
    """The least and greatest values of a type, or the emptiest and an unusually full one."""
    whole = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}
    if type(kind) in whole:
        return [-(1 << whole[type(kind)]), (1 << whole[type(kind)]) - 1]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [float("-inf"), float("nan")]
    if isinstance(kind, T.DecimalType):
        most = decimal.Decimal(10**kind.precision - 1).scaleb(-kind.scale)
        return [-most, most]
    if isinstance(kind, T.DateType):
        return [datetime.date(1, 1, 1), datetime.date(9999, 12, 31)]
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return [datetime.datetime(1700, 1, 1), datetime.datetime(2262, 1, 1)]
    if isinstance(kind, T.BooleanType):
        return [False, True]
    if isinstance(kind, T.StringType):
        return ["", "x" * 100_000]
    if isinstance(kind, T.BinaryType):
        return [b"", bytes(range(256))]
    if isinstance(kind, T.ArrayType):
        return [[], _extremes(kind.elementType)]
    return [None, None]


def _usual(kind: T.DataType, text: str):
    """One plain value of a type; texts are the given one."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.IntegralType):
        return 1
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return 1.5
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(1).scaleb(-kind.scale)
    if isinstance(kind, T.DateType):
        return datetime.date(2024, 2, 29)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return datetime.datetime(2024, 2, 29, 12)
    if isinstance(kind, T.BooleanType):
        return True
    if isinstance(kind, T.BinaryType):
        return text.encode()
    if isinstance(kind, T.ArrayType):
        return [_usual(kind.elementType, text)]
    return None


def edge_batches(schema: T.StructType) -> dict[str, dict[str, list]]:
    """Small batches that real samples seldom hold, by name: the values of each column."""
    fields = schema.fields
    return {
        "no rows": {f.name: [] for f in fields},
        "one row": {f.name: [_usual(f.dataType, "a")] for f in fields},
        "all null": {f.name: [None, None] for f in fields},
        "extremes": {f.name: _extremes(f.dataType) for f in fields},
        "non-ASCII": {f.name: [_usual(f.dataType, t) for t in ("\u00e9\u6f22", "\U0001f600 \u202e")] for f in fields},
    }


_SEEN = "case string, position bigint, column string, type string, n_rows bigint, error string"


def _told_type(kind: pa.DataType) -> str:
    """The type; pandas gives decimals the digits that the values happen to have."""
    import pyarrow

    return f"decimal(scale {kind.scale})" if pyarrow.types.is_decimal(kind) else str(kind)


def _described(case: str, fn: Callable, part: pd.DataFrame) -> pd.DataFrame:
    """What ``fn`` makes of one batch: its columns, or its exception."""
    import pandas
    import pyarrow

    try:
        result = fn(part)
        schema = pyarrow.Schema.from_pandas(result, preserve_index=False)
        empty = [bool(result.iloc[:, k].isna().all()) for k in range(result.shape[1])]
        told = [
            (case, k + 1, str(name), "null" if empty[k] else _told_type(schema.types[k]), len(result), None)
            for k, name in enumerate(result.columns)
        ] or [(case, None, None, None, len(result), None)]
    except Exception as error:  # the step's own function may raise anything
        told = [(case, None, None, None, 0, f"{type(error).__name__}: {error}"[:500])]
    return pandas.DataFrame(told, columns=["case", "position", "column", "type", "n_rows", "error"]).astype(
        {"position": "Int64", "n_rows": "int64"}
    )


def varied_schemas(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], samples: int = 8
) -> DataFrame:
    """What ``fn`` returns for varied input: ``case``, ``position``, ``column``, ``type``, ``error``, ``n_rows``.

    The rows are dealt by their hash to ``samples`` parts, so that batches differ from those in the files' order; the
    cases of ``edge_batches`` are made from the schema and run on an executor as well. A batch that fails is a row with
    its error. A column without values has type ``null``.
    """
    schema = df.schema
    arrow = to_arrow_schema(schema)

    def report(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for number, some in part.groupby("_sample"):
                yield _described(f"sample {number}", fn, some.drop(columns="_sample").reset_index(drop=True))

    def edges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow

        for part in parts:
            for _ in range(len(part)):
                for case, values in edge_batches(schema).items():
                    yield _described(case, fn, pyarrow.table(values, schema=arrow).to_pandas(date_as_object=True))

    dealt = df.withColumn("_sample", F.pmod(F.xxhash64(F.to_json(F.struct("*"))), F.lit(samples)).cast("int"))
    seen = dealt.mapInPandas(report, _SEEN).unionAll(df.sparkSession.range(0, 1, 1, 1).mapInPandas(edges, _SEEN))
    return seen.groupBy("case", "position", "column", "type", "error").agg(F.sum("n_rows").alias("n_rows"))


def varied_stability(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], samples: int = 8
) -> DataFrame:
    """One row per column of ``fn``'s output: ``column``, ``types``, ``is_stable``, ``shown_by``.

    A column is stable if all cases of ``varied_schemas`` have it, at one place and with one type. ``shown_by`` names, in
    order, the cases that tell it is not: those where it is missing, where the step fails, or where its type
    or place is another than in the case that comes first by name among those with values.
    """
    seen = varied_schemas(df, fn, samples)
    # a few rows for each case and column from here on
    cases = seen.select("case").distinct()
    columns = seen.where("column is not null").select("column").distinct()
    typed = F.when(F.col("type") != "null", F.col("type"))
    told = seen.where("column is not null").groupBy("column", "case").agg(
        F.array_sort(F.collect_set(typed)).alias("kinds"), F.array_sort(F.collect_set("position")).alias("places")
    )
    failed = seen.where("error is not null").select("case").distinct().withColumn("failed", F.lit(True))
    wanted = columns.withColumn("_one", F.lit(1)).join(cases.withColumn("_one", F.lit(1)), "_one").drop("_one")
    every = wanted.join(told, ["column", "case"], "left").join(failed, "case", "left")
    by_column = Window.partitionBy("column")
    # samples of the data come before the made batches
    order = F.struct((~F.col("case").startswith("sample")).alias("made"), "case")
    usual = lambda name, there: F.min(F.when(there, F.struct(order, name))).over(by_column)[name]
    marked = every.select(
        "column", "case", "kinds", "places", "failed",
        usual("kinds", F.size("kinds") > 0).alias("kind"),
        usual("places", F.size("places") > 0).alias("place"),
    )
    other = (
        F.col("failed").isNotNull()
        | F.col("kinds").isNull()
        | (F.size("kinds") > 1) | (F.size("places") > 1)
        | ((F.size("kinds") > 0) & (F.col("kinds") != F.col("kind")))
        | (F.col("places") != F.col("place"))
    )
    return marked.groupBy("column").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))), ",").alias("types"),
        (~F.bool_or(other)).alias("is_stable"),
        F.array_join(F.array_sort(F.collect_list(F.when(other, F.col("case")))), ", ").alias("shown_by"),
    )
