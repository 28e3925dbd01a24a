"""Read text as another type: null where the text is not of that type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Fixed forms of the values that Postgres prints or reads. They are looked at
# before the cast: text that does not parse costs Spark an exception per value,
# and "2024" alone or "1.0d" would pass as a date or a number.
_INTEGER = r"^[+-]?\d+$"
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_FLOAT = r"^([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(?i:inf|infinity)|(?i:nan))$"
_DATE = r"^\d{4,6}-\d{1,2}-\d{1,2}$"
_TIMESTAMP = r"^\d{4,6}-\d{1,2}-\d{1,2}([ T]|$)"
_TRUE = ("t", "true", "y", "yes", "on", "1")
_FALSE = ("f", "false", "n", "no", "off", "0")

_FORMS = (
    (T.IntegralType, _INTEGER),
    (T.DecimalType, _DECIMAL),
    ((T.DoubleType, T.FloatType), _FLOAT),
    (T.DateType, _DATE),
    ((T.TimestampType, T.TimestampNTZType), _TIMESTAMP),
)


def loses_fraction(current: T.DataType, wanted: T.DataType) -> bool:
    """True if values of ``current`` may have digits after the point that ``wanted`` drops."""
    if isinstance(wanted, T.IntegralType):
        return isinstance(current, (T.FloatType, T.DoubleType)) or (
            isinstance(current, T.DecimalType) and current.scale > 0
        )
    return (
        isinstance(wanted, T.DecimalType)
        and isinstance(current, T.DecimalType)
        and current.scale > wanted.scale
    )


def converted(
    value: Column, current: T.DataType, wanted: T.DataType, trimmed: bool = False
) -> Column:
    """``value`` of type ``current`` as ``wanted``, or null where it does not convert or would lose a fraction."""
    if not isinstance(current, T.StringType):
        cast = value.try_cast(wanted)
        return F.when(cast == value, cast) if loses_fraction(current, wanted) else cast
    text = value if trimmed else F.btrim(value)
    if isinstance(wanted, T.BooleanType):
        word = F.lower(text)
        return F.when(word.isin(*_TRUE), True).when(word.isin(*_FALSE), False)
    for kinds, form in _FORMS:
        if isinstance(wanted, kinds):
            return F.when(text.rlike(form), text.try_cast(wanted))
    return value.try_cast(wanted)
