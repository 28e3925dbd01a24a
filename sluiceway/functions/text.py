"""Text functions of the column steps, with their null and whitespace rules.

Every argument is taken in its text form (Spark's ``CAST(x AS STRING)``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

# The characters Python's ``str.strip`` removes, in code order.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def as_text(value: Column) -> Column:
    return value.cast("string")


def upper(value: Column) -> Column:
    return F.upper(as_text(value))


def lower(value: Column) -> Column:
    return F.lower(as_text(value))


def trim(value: Column) -> Column:
    """Strip all leading and trailing whitespace, not only blanks."""
    return F.btrim(as_text(value), F.lit(WHITESPACE))


def length(value: Column) -> Column:
    """Number of code points of the text form; null stays null."""
    return F.length(as_text(value))


def concat(*values: Column) -> Column:
    """Join the text forms; a null counts as empty text, so never null."""
    return F.concat_ws("", *[as_text(value) for value in values])


def coalesce(values: Sequence[tuple[Column, T.DataType]]) -> Column:
    """First non-null value; all branches become text unless their types agree."""
    if len({kind for _, kind in values}) == 1:
        return F.coalesce(*[value for value, _ in values])
    return F.coalesce(*[as_text(value) for value, _ in values])
