"""Table profile: what the catalog would say of a table, read from its data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sluiceway.functions.expression import quoted
from sluiceway.functions.types import catalog_name, category
from sluiceway.operators.values import comparable, distinct_estimate, is_whole, orderable, tagged_values

def table_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    distinct: str = "exact",
    relative_error: float = 0.05,
) -> DataFrame:
    """One row per column, in table order.

    Counts and bounds come from one aggregation without grouping. Exact distinct
    counts come from one more over the narrow table of all values, where each
    task first drops the repeats it has seen.

    ``distinct`` is ``exact`` or ``approx``; the latter keeps a fixed-size
    sketch per column and shuffles no values, for tables where counting every
    value is too dear; ``relative_error`` is the standard deviation of its estimates.
    ``is_unique`` and ``is_key`` (unique without nulls) are
    known only for exact counts and are null otherwise.
    """
    if distinct not in ("exact", "approx"):
        raise ValueError(f"distinct must be exact or approx, got: {distinct}")
    fields = [
        (i, field)
        for i, field in enumerate(df.schema.fields, start=1)
        if columns is None or field.name in columns
    ]
    no_count, no_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")

    bounds = [F.count(F.lit(1)).alias("n_rows")]
    rows = []
    for i, field in fields:
        name = quoted(field.name)
        bounds.append(F.count(name).alias(f"_n{i}"))
        low = high = no_text
        estimate = no_count
        if orderable(field.dataType):
            bounds += [F.min(name).alias(f"_lo{i}"), F.max(name).alias(f"_hi{i}")]
            low, high = F.col(f"_lo{i}").cast("string"), F.col(f"_hi{i}").cast("string")
            if distinct == "approx":
                value = comparable(field)[1]
                bounds.append(F.coalesce(distinct_estimate(value, relative_error), F.lit(0).cast("bigint")).alias(f"_d{i}"))
                estimate = F.col(f"_d{i}")
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.col("n_rows"),
                F.col(f"_n{i}").alias("n_present"),
                estimate.alias("n_distinct"),
                low.alias("min_value"),
                high.alias("max_value"),
            )
        )
    found = df.agg(*bounds).select(F.inline(F.array(*rows)))

    forms = {i: comparable(field) for i, field in fields}
    counted = [(i, form) for i, form in forms.items() if form is not None]
    for whole in (True, False) if distinct == "exact" else ():
        values = [(i, value) for i, (family, value) in counted if is_whole(family) == whole]
        if values:
            different = (
                tagged_values(df, values)
                .distinct()
                .groupBy(F.col("site").alias("position"))
                .agg(F.count(F.lit(1)).alias("n_distinct"))
            )
            found = found.unionByName(different, allowMissingColumns=True)
    # at most two short rows per column from here on; a column without values has none
    merged = found.groupBy("position").agg(
        *[
            F.max(name).alias(name)
            for name in ("n_rows", "n_present", "n_distinct", "min_value", "max_value")
        ]
    )

    def of_column(values: Sequence[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("position"))

    types = [catalog_name(field.dataType) for field in df.schema.fields]
    countable = F.col("position").isin([i for i, _ in counted])
    present = F.col("n_present")
    n_distinct = F.when(countable, F.coalesce("n_distinct", F.lit(0).cast("bigint")))
    unique = (n_distinct == present) if distinct == "exact" else F.lit(None).cast("boolean")
    return merged.select(
        "position",
        of_column(df.columns).alias("column"),
        of_column(types).alias("type"),
        of_column([category(name) for name in types]).alias("category"),
        "n_rows",
        (F.col("n_rows") - present).alias("n_null"),
        n_distinct.alias("n_distinct"),
        "min_value",
        "max_value",
        (F.col("n_rows") > present).alias("has_null"),
        unique.alias("is_unique"),
        (unique & (F.col("n_rows") == present)).alias("is_key"),
    )
