"""SQL steps: one SELECT over named inputs, chained into one Spark plan."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from sluiceway.plans.blame import remembered

_MAX_NAME = 63  # Postgres identifier limit
_COMMENTS = re.compile(r"--[^\n]*|/\*.*?\*/", re.DOTALL)


class StepError(ValueError):
    """A step's text or function is not acceptable."""


def relation_name(name: str, position: int) -> str:
    """The relation name of a step: cleaned name plus position, 63 characters."""
    if not name.strip():
        return f"step_{position}"
    ending = f"_{position}"
    cleaned = "_".join(re.findall("[a-z0-9]+", name.lower()))
    return cleaned[: _MAX_NAME - len(ending)] + ending


def bind_inputs(text: str, inputs: Mapping[str, str]) -> str:
    """Put relation names in place of ``{prev}``, ``{left}`` ...; other braces stay."""
    for placeholder, relation in inputs.items():
        text = text.replace("{" + placeholder + "}", relation)
    return text


def require_select(text: str) -> None:
    """Refuse empty text and anything that does not start as a query."""
    first = re.match(r"[\s(]*(\w*)", _COMMENTS.sub(" ", text))[1].upper()
    if not first:
        raise StepError("SQL expression is empty or could not be parsed")
    if first not in ("SELECT", "WITH"):
        raise StepError(f"SQL expression must be a SELECT statement, got: {first}")


def run_select(
    spark: SparkSession,
    text: str,
    relations: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """A lazy frame for one SELECT that may read the given relations.

    The text stands inside ``SELECT * FROM (...)``, where only a query parses,
    so nothing else can run. The relations are common table expressions of this
    statement alone: they hide nothing else in the session and Spark inlines
    them, so filters and column lists still reach the scans.
    """
    require_select(text)
    visible = {
        name: df
        for name, df in (relations or {}).items()
        if re.search(rf"(?<!\w){re.escape(name)}(?!\w)", text, re.IGNORECASE)
    }
    views = {name: f"_in_{uuid.uuid4().hex}" for name in visible}
    for name, view in views.items():
        visible[name].createOrReplaceTempView(view)
    heads = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
    statement = f"SELECT * FROM (\n{text}\n) AS _step"
    if heads:
        statement = f"WITH {heads}\n{statement}"
    try:
        return spark.sql(remembered(statement))
    except ParseException as error:
        if ";" in text:
            raise StepError(
                "SQL expression must be a single statement (no semicolons)"
            ) from error
        raise StepError(f"Invalid SQL expression: {error}") from error
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def sql_chain(
    source: DataFrame,
    steps: list[tuple[str, str]],
    limit: int | None = None,
    source_name: str = "source",
) -> DataFrame:
    """Run named SQL steps one after another over ``source``.

    ``{prev}`` is the step before; any earlier step may be named directly
    (``source_0``, ``lower_1``). The limit applies to the end of the chain.
    """
    if not steps:
        raise StepError("Cannot compile empty SQL chain")
    spark = source.sparkSession
    previous = relation_name(source_name, 0)
    relations = {previous: source}
    for position, (name, text) in enumerate(steps, start=1):
        frame = run_select(spark, bind_inputs(text, {"prev": previous}), relations)
        previous = relation_name(name, position)
        relations[previous] = frame
    result = relations[previous]
    return result if limit is None else result.limit(limit)
