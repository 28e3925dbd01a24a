"""Code steps: Spark-native functions, Python batches, group-relative values.

The Python functions given here run on the executors. The small wrappers around
them are closures, so they travel with the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from operator import and_
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sluiceway.functions.expression import quoted
from sluiceway.operators.columns import TableStep
from sluiceway.operators.sqlsteps import StepError
from sluiceway.plans.blame import marked

if TYPE_CHECKING:
    import pandas as pd
    import pyarrow as pa


def transform(fn: Callable[[DataFrame], DataFrame]) -> TableStep:
    """A whole-table step written with Spark's own functions."""
    if not callable(fn):
        raise StepError("Code must define a 'transform(df)' function")

    def apply(df: DataFrame) -> DataFrame:
        result = fn(df)
        if not isinstance(result, DataFrame):
            raise StepError(f"transform() must return a DataFrame, got: {type(result).__name__}")
        return result

    return apply


def batches(
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
) -> TableStep:
    """A row-local Python function, run over Arrow batches.

    The function sees a few thousand rows at a time and must not depend on
    which rows share a batch.
    """

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield fn(part)

    return lambda df: df.mapInPandas(marked(each), schema)


def gated(step: TableStep, enabled: bool) -> TableStep:
    """The step itself once it is approved, else no change."""
    return step if enabled else (lambda df: df)


def with_group_values(
    df: DataFrame,
    keys: list[str],
    values: Mapping[str, Column],
    large_groups: int = 10_000,
) -> DataFrame:
    """Add aggregates of each row's group without bringing a group together.

    The aggregates are built with map-side partial sums. The ``large_groups``
    biggest groups meet their rows in a join of their own, whose small side has that many
    rows at most: Spark sends it to the tasks if its bytes are below the session's
    threshold, else splits its skewed keys. Every other group holds less than one
    part in ``large_groups`` of the table, so the shuffled join of the rest has
    no hot key. Null keys form a group of their own.
    """
    clash = [name for name in values if name in df.columns]
    if clash:
        raise StepError(f"group values would hide columns: {clash}")
    key_names = [f"_key_{i}" for i in range(len(keys))]
    totals = (
        df.groupBy(*[quoted(k).alias(k) for k in keys])
        .agg(
            F.count(F.lit(1)).alias("_size"),
            *[value.alias(name) for name, value in values.items()],
        )
        .select(
            *[quoted(k).alias(name) for k, name in zip(keys, key_names)],
            "_size",
            *[quoted(name).alias(f"_value_{i}") for i, name in enumerate(values)],
        )
    )
    large = totals.orderBy(F.desc("_size"), *key_names).limit(large_groups).alias("big")
    other = totals.alias("other")

    def same_key(side: str) -> Column:
        pairs = zip(keys, key_names)
        return reduce(and_, [quoted(k).eqNullSafe(F.col(f"{side}.{name}")) for k, name in pairs])

    columns = [quoted(name) for name in df.columns]
    marked = df.join(large, same_key("big"), "left")
    in_large = marked.where(F.col("big._size").isNotNull()).select(
        *columns, *[F.col(f"big._value_{i}").alias(name) for i, name in enumerate(values)]
    )
    # both sides of the coalesce and both sizes are named so that all uses of
    # ``totals`` need the same columns and share one shuffle
    in_rest = (
        marked.where(F.col("big._size").isNull())
        .join(other, same_key("other") & (F.col("other._size") > 0), "inner")
        .select(
            *columns,
            *[
                F.coalesce(f"big._value_{i}", f"other._value_{i}").alias(name)
                for i, name in enumerate(values)
            ],
        )
    )
    return in_large.unionAll(in_rest)


def group_relative(
    keys: list[str],
    values: Mapping[str, Column],
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
) -> TableStep:
    """A Python function over rows that carry the aggregates of their group."""
    return lambda df: with_group_values(df, keys, values).transform(batches(fn, schema))


def group_fold(
    keys: list[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    state_rows: int = 100_000,
) -> TableStep:
    """A Python aggregate per group, for groups of any size.

    ``partial`` turns rows into states, one row per key; ``merge`` turns states
    into one state per key, and merging a merged state changes nothing. Each
    task folds its own rows first and hands on at most ``state_rows`` states at
    a time, so a hot key travels as one short row per task. The states then meet
    sorted by key and are folded as they stream by.
    """

    def plain(states: pd.DataFrame) -> pd.DataFrame:
        # grouping turns a text column of nulls into floats, which Spark does not take back
        empty = [c for c in states if states[c].isna().all()]
        return states.assign(**{c: [None] * len(states) for c in empty})

    def fold_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas

        # chunks of states, each at least twice the next, so that a state is merged a few times only
        chunks: list[pd.DataFrame] = []
        for part in parts:
            if part.empty:
                continue
            chunks.append(partial(part))
            while len(chunks) > 1 and len(chunks[-2]) < 2 * len(chunks[-1]):
                chunks[-2:] = [merge(pandas.concat(chunks[-2:]))]
            if sum(map(len, chunks)) >= state_rows:
                yield plain(merge(pandas.concat(chunks)) if len(chunks) > 1 else chunks[0])
                chunks = []
        if chunks:
            yield plain(merge(pandas.concat(chunks)) if len(chunks) > 1 else chunks[0])

    def fold_states(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas

        held = None
        for part in parts:
            if part.empty:
                continue
            states = merge(part if held is None else pandas.concat([held, part]))
            # the last key may go on in the next batch; looked at by column, as a
            # row would bring all its columns to one type
            open_ = pandas.Series(True, index=states.index)
            for key in keys:
                last = part[key].iloc[-1]
                same = states[key].isna() if pandas.isna(last) else (states[key] == last).fillna(False)
                open_ &= same.astype(bool)
            held = states[open_]
            if not open_.all():
                yield plain(states[~open_])
        if held is not None:
            yield plain(held)

    def apply(df: DataFrame) -> DataFrame:
        columns = [quoted(k) for k in keys]
        states = df.mapInArrow(marked(_over_frames(fold_rows, schema)), schema)
        met = states.repartition(*columns).sortWithinPartitions(*columns)
        return met.mapInArrow(marked(_over_frames(fold_states, schema)), schema)

    return apply


def _over_frames(
    fold: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType | str
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fold`` over pandas frames in which whole numbers beside nulls stay whole numbers."""
    wanted = to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        import pandas

        for batch in batches:
            columns = {}
            for field, column in zip(batch.schema, batch.columns):
                whole = _NULLABLE.get(str(field.type)) if column.null_count else None
                columns[field.name] = (
                    pandas.Series(column.to_pylist(), dtype=whole) if whole else column.to_pandas()
                )
            yield pandas.DataFrame(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow

        for part in fold(frames(batches)):
            yield pyarrow.RecordBatch.from_pandas(part, schema=wanted, preserve_index=False)

    return run


# Arrow's whole numbers and the pandas types that hold them beside nulls
_NULLABLE = {"int8": "Int8", "int16": "Int16", "int32": "Int32", "int64": "Int64"}
