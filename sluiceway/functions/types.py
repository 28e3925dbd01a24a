"""Postgres type names: their Spark type and their display category."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# The canonical types and the Spark type of each. Spark has no
# unsigned integers, so those take the next wider signed type. A time of day is
# text in the form HH:mm:ss.SSSSSS.
CANONICAL_TO_SPARK = {
    "int64": T.LongType(),
    "int32": T.IntegerType(),
    "int16": T.ShortType(),
    "int8": T.ByteType(),
    "uint64": T.DecimalType(20, 0),
    "uint32": T.LongType(),
    "float64": T.DoubleType(),
    "float32": T.FloatType(),
    "utf8": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampNTZType(),
    "date": T.DateType(),
    "time": T.StringType(),
    "binary": T.BinaryType(),
    "null": T.NullType(),
}

# Postgres names by canonical type. Names not listed are text.
_NAMES = {
    "int64": ("integer", "int", "int4", "bigint", "int8"),
    "int32": ("smallint", "int2"),
    "float32": ("real", "float4"),
    "float64": ("double precision", "float8", "numeric", "decimal"),
    "utf8": (
        "text", "varchar", "character varying", "char", "uuid", "json", "jsonb",
    ),
    "boolean": ("boolean", "bool"),
    "timestamp": (
        "timestamp", "timestamp without time zone",
        "timestamp with time zone", "timestamptz",
    ),
    "date": ("date",),
    "time": ("time",),
    "binary": ("bytea",),
}
_CANONICAL_OF = {name: kind for kind, names in _NAMES.items() for name in names}

_ZONED = ("timestamptz", "timestamp with time zone")
_SIZED_NUMERIC = re.compile(r"(?:numeric|decimal)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)")

# Display categories by catalog type name.
CATEGORIES = {
    "number": (
        "int2", "int4", "int8", "float4", "float8",
        "numeric", "money", "serial", "bigserial",
    ),
    "text": ("varchar", "text", "char", "bpchar", "name", "citext"),
    "datetime": ("timestamp", "timestamptz", "date", "time", "timetz", "interval"),
    "boolean": ("bool",),
    "json": ("json", "jsonb"),
    "uuid": ("uuid",),
    "binary": ("bytea",),
}
_CATEGORY_OF = {name: category for category, names in CATEGORIES.items() for name in names}


MOST_DIGITS = 38
_SIZE = re.compile(r"\s*\(\s*(\d+)\s*\)")


def clean_name(name: str) -> str:
    return name.lower().strip()


def canonical_type(name: str) -> str:
    """Canonical type of a Postgres type name; unknown names are ``utf8``."""
    return _CANONICAL_OF.get(clean_name(name), "utf8")


def spark_type(name: str) -> T.DataType:
    """Spark type of a Postgres type name.

    Times with a zone are ``TimestampType`` and without ``TimestampNTZType``;
    ``numeric(p, s)`` keeps its precision instead of becoming a double, and is refused
    beyond the digits that a decimal has. Sizes of times and texts do not change the type.
    """
    cleaned = clean_name(name)
    if cleaned in _ZONED:
        return T.TimestampType()
    sized = _SIZED_NUMERIC.fullmatch(cleaned)
    if sized:
        if int(sized[1]) > MOST_DIGITS:
            raise ValueError(f"{name} has more than the {MOST_DIGITS} digits of a decimal")
        return T.DecimalType(int(sized[1]), int(sized[2] or 0))
    cleaned = _SIZE.sub("", cleaned)
    if cleaned in _ZONED:
        return T.TimestampType()
    if cleaned == "float" and not _SIZE.search(clean_name(name)):
        return T.DoubleType()
    if cleaned == "float" and _SIZE.search(clean_name(name)):
        # float(1) to float(24) are single precision, more is double
        digits = int(_SIZE.search(clean_name(name))[1])
        return T.FloatType() if digits <= 24 else T.DoubleType()
    name = cleaned
    return CANONICAL_TO_SPARK[canonical_type(name)]


def is_time_of_day(name: str) -> bool:
    """True for a time without a date or a zone, with or without the number of its digits."""
    return _SIZE.sub("", clean_name(name)) in ("time", "time without time zone")


def category(name: str) -> str:
    """Display category of a catalog type name; ``_name`` is an array of it."""
    if name.startswith("_"):
        return "array"
    return _CATEGORY_OF.get(name, "unknown")


def catalog_name(kind: T.DataType) -> str:
    """The Postgres catalog name under which a Spark type would be listed."""
    if isinstance(kind, T.ArrayType):
        return "_" + catalog_name(kind.elementType)
    if isinstance(kind, (T.MapType, T.StructType)):
        return "json"
    for spark_class, name in (
        (T.ByteType, "int2"),
        (T.ShortType, "int2"),
        (T.IntegerType, "int4"),
        (T.LongType, "int8"),
        (T.FloatType, "float4"),
        (T.DoubleType, "float8"),
        (T.DecimalType, "numeric"),
        (T.CharType, "bpchar"),
        (T.VarcharType, "varchar"),
        (T.StringType, "text"),
        (T.BooleanType, "bool"),
        (T.TimestampNTZType, "timestamp"),
        (T.TimestampType, "timestamptz"),
        (T.DateType, "date"),
        (T.BinaryType, "bytea"),
        (T.DayTimeIntervalType, "interval"),
        (T.YearMonthIntervalType, "interval"),
    ):
        if isinstance(kind, spark_class):
            return name
    return "unknown"
