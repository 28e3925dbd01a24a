"""Typed load: cast an all-text table to declared types and report the rejects."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluiceway.functions.conversion import converted
from sluiceway.functions.expression import quoted
from sluiceway.functions.types import canonical_type, is_time_of_day, spark_type

# Fixed form of a time of day.
_TIME = r"^([01]\d|2[0-3]):([0-5]\d)(:([0-5]\d)(\.\d{1,6})?)?$"


@dataclass(frozen=True)
class TypedLoad:
    """The outcome of a typed load, as three lazy frames.

    ``rows`` has the declared types and ``rejects`` one row per refused value.
    ``marked`` is ``rows`` with the refused values of each row in an array
    ``_rejects``: write it once where a second pass over the text would be dear,
    and read both from there.
    """

    rows: DataFrame
    rejects: DataFrame
    marked: DataFrame


def _is_text(type_name: str) -> bool:
    return (
        not is_time_of_day(type_name)
        and canonical_type(type_name) == "utf8"
        and isinstance(spark_type(type_name), T.StringType)
    )


def _time_of_day(value: Column) -> Column:
    with_seconds = F.when(F.length(value) == 5, F.concat(value, F.lit(":00"))).otherwise(value)
    whole = F.substring(with_seconds, 1, 8)
    fraction = F.rpad(F.substring(with_seconds, 10, 6), 6, "0")
    return F.when(value.rlike(_TIME), F.concat_ws(".", whole, fraction))


def _bytes(value: Column) -> Column:
    # Postgres prints bytes as \x followed by hex digits
    hexed = F.when(F.length(value) % 2 == 0, F.unhex(F.substr(value, F.lit(3))))
    return F.when(value.startswith("\\x"), hexed).otherwise(F.encode(value, "UTF-8"))


def typed_value(name: str, type_name: str) -> Column:
    """Text column ``name`` as ``type_name``; null where the text does not fit.

    Empty text is null for every type but text, as text tables write null so.
    """
    if _is_text(type_name):
        return quoted(name)
    value = F.btrim(quoted(name))
    canonical = canonical_type(type_name)
    if is_time_of_day(type_name):
        return _time_of_day(value)
    if canonical == "binary":
        return F.when(value != "", _bytes(value))
    return converted(value, T.StringType(), spark_type(type_name), trimmed=True)


def _is_empty(name: str) -> Column:
    return F.coalesce(F.btrim(quoted(name)) == "", F.lit(True))


def is_rejected(name: str, type_name: str) -> Column:
    """True where a value is present but has no reading as ``type_name``."""
    return typed_value(name, type_name).isNull() & ~_is_empty(name)


def typed_load(
    df: DataFrame,
    column_types: Mapping[str, str],
    key: Iterable[str] = (),
) -> TypedLoad:
    """Cast ``df`` to ``{column: postgres type name}``; other columns stay text.

    ``rejects`` holds the key columns, the column name, its declared type and
    the raw text. Each frame is one pass over the text, without a shuffle.
    """
    keys = [quoted(name) for name in key]
    typed = [
        typed_value(name, column_types[name]).alias(name) if name in column_types else quoted(name)
        for name in df.columns
    ]
    refused = [
        F.when(
            is_rejected(name, kind),
            F.struct(
                F.lit(name).alias("column"),
                F.lit(kind).alias("type"),
                quoted(name).alias("value"),
            ),
        )
        for name, kind in column_types.items()
        if name in df.columns and not _is_text(kind)
    ]
    if refused:
        found = F.array_compact(F.array(*refused))
    else:
        found = F.lit(None).cast("array<struct<column: string, type: string, value: string>>")
    rejects = df.select(*keys, F.explode(found).alias("_reject")).select(
        *keys, "_reject.column", "_reject.type", "_reject.value"
    )
    return TypedLoad(df.select(*typed), rejects, df.select(*typed, found.alias("_rejects")))


def reject_counts(df: DataFrame, column_types: Mapping[str, str]) -> DataFrame:
    """One row per declared column: rows, empty values and refused values."""
    names = [name for name in column_types if name in df.columns]
    sums = [F.count(F.lit(1)).alias("n_rows")]
    for i, name in enumerate(names):
        sums.append(F.count_if(_is_empty(name)).alias(f"_e{i}"))
        refused = F.lit(False) if _is_text(column_types[name]) else is_rejected(
            name, column_types[name]
        )
        sums.append(F.count_if(refused).alias(f"_r{i}"))
    per_column = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.lit(column_types[name]).alias("type"),
                F.col("n_rows"),
                F.col(f"_e{i}").alias("n_empty"),
                F.col(f"_r{i}").alias("n_rejected"),
            )
            for i, name in enumerate(names)
        ]
    )
    return df.agg(*sums).select(F.inline(per_column))
