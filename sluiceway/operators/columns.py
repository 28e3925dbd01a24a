"""Column steps: mapping, derived columns, generated columns, and their fold."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame

from sluiceway.functions.expression import expression_column, quoted

TableStep = Callable[[DataFrame], DataFrame]


def column_mapping(mappings: Iterable[Mapping]) -> TableStep:
    """Keep, rename and reorder columns.

    Each mapping is ``{"source_col", "target_col", "drop"}``. Only mapped
    columns are kept, in mapping order. A dropped or absent source is left out.
    A target named twice keeps its first place and its last value.
    """
    wanted = [m for m in mappings if not m.get("drop")]

    def apply(df: DataFrame) -> DataFrame:
        source_of: dict[str, str] = {}
        for mapping in wanted:
            if mapping["source_col"] in df.columns:
                source_of[mapping["target_col"]] = mapping["source_col"]
        return df.select(*[quoted(src).alias(name) for name, src in source_of.items()])

    return apply


def derived(expression: str, output_column: str) -> TableStep:
    """Add ``expression`` as ``output_column``.

    A column of exactly that name is replaced where it stands; otherwise the
    new one comes last. All other columns stay.
    """

    def apply(df: DataFrame) -> DataFrame:
        value = expression_column(expression, df.schema).alias(output_column)
        kept = [value if name == output_column else quoted(name) for name in df.columns]
        if output_column not in df.columns:
            kept.append(value)
        return df.select(*kept)

    return apply


def generated(generated_expression: str, output_column: str, approved: bool) -> TableStep:
    """A derived column written by a generator: applied only once approved."""
    if not approved:
        return lambda df: df
    return derived(generated_expression, output_column)


def transformation(record: Mapping) -> TableStep:
    """The step for ``{"type", "config"}``; unknown types change nothing."""
    kind, config = record["type"], record["config"]
    if kind == "column_mapping":
        return column_mapping(config["mappings"])
    if kind == "sql_expression":
        return derived(config["expression"], config["output_column"])
    if kind == "ai_generated":
        return generated(
            config["generated_expression"],
            config["output_column"],
            config.get("approved", False),
        )
    return lambda df: df


def apply_transformations(df: DataFrame, records: Iterable[Mapping]) -> DataFrame:
    """Apply the records one after another, by ``order`` where it is given."""
    ordered = sorted(records, key=lambda record: record.get("order", 0))
    return reduce(lambda table, record: table.transform(transformation(record)), ordered, df)


def before_after(
    df: DataFrame,
    records: Iterable[Mapping],
    rows: int = 10,
    order_by: str | list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The same sampled rows without and with the transformations.

    With ``order_by`` (a unique key) both sides read the same rows because the
    sample is fixed by the key. Without it the few sampled rows are kept, so
    that the second side does not draw other ones.
    """
    if order_by is None:
        sample = df.limit(rows).persist()
    else:
        sample = df.orderBy(order_by).limit(rows)
    return sample, apply_transformations(sample, records)
