"""Turn the short expression of a derived column into a Spark ``Column``.

The accepted text is one column name or one call ``NAME(arg, ...)``. This is a
lookup done once per step while the plan is built; the rows only see Spark
expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from sluiceway.functions import text

# Fixed forms of the expression language.
_CALL = re.compile(r"(?P<name>\w+)\((?P<args>.+)\)")
_ARGUMENT = re.compile(r"""((?:'[^']*(?:'|$)|"[^"]*(?:"|$)|[^,'"])*)(?:,|$)""")

_ONE_ARGUMENT = {
    "UPPER": text.upper,
    "LOWER": text.lower,
    "TRIM": text.trim,
    "LENGTH": text.length,
}
FUNCTIONS = (*_ONE_ARGUMENT, "CONCAT", "COALESCE")


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def call_arguments(args: str) -> list[str]:
    """Split at the commas that stand outside quotes."""
    # the pattern always finds one more, empty part at the very end
    parts = [match.group(1) for match in _ARGUMENT.finditer(args)][:-1]
    return [part.strip() for part in parts]


def _is_quoted(arg: str) -> bool:
    return arg[:1] in ("'", '"') and arg[:1] == arg[-1:]


def _argument(arg: str, schema: T.StructType) -> tuple[Column, T.DataType]:
    if _is_quoted(arg):
        return F.lit(arg[1:-1]), T.StringType()
    if arg in schema.names:
        return quoted(arg), schema[arg].dataType
    return F.lit(arg), T.StringType()


def expression_column(expression: str, schema: T.StructType) -> Column:
    """``expression`` over rows of ``schema``.

    A bare name copies that column and an unknown name is null. In a call, a
    quoted word is a literal, a known name is its column, and anything else is
    taken as literal text; calls do not nest.
    """
    stripped = expression.strip()
    call = _CALL.fullmatch(stripped)
    if call is None:
        if stripped in schema.names:
            return quoted(stripped)
        return F.lit(None).cast("string")

    name = call["name"].upper()
    if name not in FUNCTIONS:
        raise ValueError(f"Unsupported function: {name}")
    values = [_argument(arg, schema) for arg in call_arguments(call["args"])]
    if name == "COALESCE":
        return text.coalesce(values)
    columns = [value for value, _ in values]
    if name == "CONCAT":
        return text.concat(*columns)
    return _ONE_ARGUMENT[name](columns[0])
