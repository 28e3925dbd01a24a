"""The values of several columns as one narrow table.

Counting distinct values of many columns in one aggregate makes Spark carry a
row as wide as the table for every column. Here each value travels alone, with
the number of the column it comes from.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluiceway.functions.expression import quoted

_LONG_TEXT = 128


def short_form(value: Column) -> Column:
    """Text to tell apart: long text is shuffled as its SHA-256 digest.

    The digest form is longer than any text that is kept as it stands, so the
    two never meet.
    """
    digest = F.concat(F.lit("sha-256:" + "#" * _LONG_TEXT), F.sha2(value, 256))
    return F.when(F.length(value) > _LONG_TEXT, digest).otherwise(value)


def comparable(field: T.StructField) -> tuple[str, Column] | None:
    """The family of a column and its values as ``bigint`` or text, equal where they are equal.

    Maps and variants cannot be compared.
    """
    value, kind = quoted(field.name), field.dataType
    if isinstance(kind, T.IntegralType):
        return "integer", value.cast("bigint")
    if isinstance(kind, T.DateType):
        return "date", F.unix_date(value).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return "instant", F.unix_micros(value)
    if isinstance(kind, T.StringType):
        return "text", short_form(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "float", (value + F.lit(0.0)).cast("string")  # -0.0 is 0.0
    if isinstance(kind, T.BinaryType):
        return "binary", short_form(F.hex(value))
    if not orderable(kind):
        return None
    if isinstance(kind, (T.ArrayType, T.StructType)):
        nested = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
        return "nested", short_form(F.when(value.isNotNull(), nested))
    return kind.simpleString(), value.cast("string")


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(orderable(field.dataType) for field in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def distinct_estimate(value: Column, relative_error: float) -> Column:
    """Estimated distinct values of a ``bigint`` or text column; ``relative_error`` is the standard deviation.

    One sketch of a few thousand bytes per column; Spark's older estimate carries a row as wide as all its registers.
    """
    size = max(4, min(21, math.ceil(2 * math.log2(1.04 / relative_error))))
    return F.hll_sketch_estimate(F.hll_sketch_agg(value, F.lit(size)))


def is_whole(family: str) -> bool:
    """True for the families whose values are ``bigint``; the others are text."""
    return family in ("integer", "date", "instant")


def tagged_values(df: DataFrame, columns: Sequence[tuple[int, Column]]) -> DataFrame:
    """One row ``(site, value)`` per value that is not null."""
    entries = [
        F.struct(F.lit(site).alias("site"), value.alias("value")) for site, value in columns
    ]
    return df.select(F.inline(F.array(*entries))).where("value IS NOT NULL")
