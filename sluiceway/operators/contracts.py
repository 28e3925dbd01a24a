"""Target contracts: compare a step's output with the table it is meant for."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from enum import Enum
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sluiceway.functions.conversion import converted
from sluiceway.functions.expression import quoted
from sluiceway.functions.types import catalog_name, category, spark_type
from sluiceway.operators.keys import key_check, reference_check


class Status(str, Enum):
    PASSED = "passed"
    FAILED = "failed"
    WARNING = "warning"


@dataclass(frozen=True)
class TargetColumn:
    """What a target table declares of one column."""

    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    is_primary_key: bool = False
    foreign_key: str | None = None  # "table.column"
    is_unique: bool = False
    # the Spark type itself, where it was read from a Spark table and not told by name
    exact: T.DataType | None = field(default=None, compare=False, repr=False)

    @property
    def category(self) -> str:
        return category(self.type)

    @property
    def spark_type(self) -> T.DataType:
        return self.exact if self.exact is not None else spark_type(self.type)


@dataclass(frozen=True)
class Check:
    """One finding; ``violations`` is null where no rows were counted."""

    rule: str
    column: str | None
    status: Status
    message: str
    expected: str | None = None
    actual: str | None = None
    violations: int | None = None


CHECK_COLUMNS = (
    "rule string, column string, status string, expected string, "
    "actual string, violations bigint, message string"
)


def columns_of(schema: T.StructType) -> list[TargetColumn]:
    """The contract that an existing table states: its names, types and nullability."""
    return [
        TargetColumn(f.name, catalog_name(f.dataType), f.nullable, exact=f.dataType)
        for f in schema.fields
    ]


def declared_columns(df: DataFrame) -> list[TargetColumn]:
    """The contract that a frame itself satisfies."""
    return columns_of(df.schema)


def missing_columns(columns: Sequence[str], contract: Iterable[TargetColumn]) -> list[Check]:
    """One finding per target column that the output lacks; extras pass.

    A nullable column or one with a default is still required, and types are
    not looked at.
    """
    return [
        Check(
            "missing_column",
            target.name,
            Status.FAILED,
            f"Column '{target.name}' not found in pipeline output",
            expected=target.type,
        )
        for target in contract
        if target.name not in columns
    ]


def name_findings(columns: Sequence[str]) -> list[Check]:
    """Findings on the names alone: none at all, empty ones, duplicates."""
    rule = "column_name_check"
    if not columns:
        return [
            Check("schema_compatibility", None, Status.WARNING, "Empty schema, nothing to compare")
        ]
    found = []
    empty = [i for i, name in enumerate(columns) if not name.strip()]
    if empty:
        found.append(
            Check(rule, None, Status.FAILED, f"Empty column name(s) at positions: {empty}")
        )
    repeated = sorted({name for name in columns if columns.count(name) > 1})
    if repeated:
        found.append(Check(rule, None, Status.FAILED, f"Duplicate column names: {repeated}"))
    return found or [Check(rule, None, Status.PASSED, "All column names valid and unique")]


def schema_findings(
    df: DataFrame, contract: Sequence[TargetColumn], stop_at_critical: bool = False
) -> list[Check]:
    """The findings that need no job. A missing column is critical.

    With ``stop_at_critical`` the first critical rule that fails ends the list.
    """
    missing = missing_columns(df.columns, contract)
    if missing and stop_at_critical:
        return missing
    return missing + name_findings(df.columns)


def _converted(df: DataFrame, target: TargetColumn) -> Column:
    current = df.schema[target.name].dataType
    value = converted(quoted(target.name), current, target.spark_type)
    try:
        df.select(value)
    except AnalysisException:  # no cast between these types at all
        return F.lit(None)
    return value


def _as_row(check: Check) -> Column:
    def text(value: str | None) -> Column:
        return F.lit(value).cast("string")

    return F.struct(
        text(check.rule).alias("rule"),
        text(check.column).alias("column"),
        text(check.status.value).alias("status"),
        text(check.expected).alias("expected"),
        text(check.actual).alias("actual"),
        F.lit(check.violations).cast("bigint").alias("violations"),
        text(check.message).alias("message"),
    )


def _counted_row(
    rule: str, target: TargetColumn, actual: str, violations: Column, complaint: str
) -> Column:
    bad = violations > 0
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(target.name).alias("column"),
        F.when(bad, Status.FAILED.value).otherwise(Status.PASSED.value).alias("status"),
        F.lit(target.type).alias("expected"),
        F.lit(actual).alias("actual"),
        violations.alias("violations"),
        F.when(bad, F.format_string("%s: %d " + complaint, F.lit(target.name), violations))
        .otherwise(F.concat(F.lit(target.name), F.lit(": ok")))
        .alias("message"),
    )


def contract_checks(
    df: DataFrame,
    contract: Sequence[TargetColumn],
    strict: bool = False,
    stop_at_critical: bool = False,
) -> DataFrame:
    """All findings on ``df`` as rows, with the data counts from one pass.

    ``type_mismatch``: with ``strict`` any other type fails; otherwise the
    values that do not convert are counted. ``not_null``: the nulls that a
    non-null target would receive.
    """
    found = schema_findings(df, contract, stop_at_critical)
    rows = [_as_row(check) for check in found]
    critical = any(check.rule == "missing_column" for check in found)
    sums: list[Column] = []
    if not (critical and stop_at_critical):
        countable = [t for t in contract if df.columns.count(t.name) == 1]
        for i, target in enumerate(countable):
            field = df.schema[target.name]
            actual = field.dataType.simpleString()
            try:
                wanted = target.spark_type
            except ValueError as error:  # a type that no column here can have
                told = f"{target.name}: not compared, {error}"
                rows.append(
                    _as_row(
                        Check(
                            "type_mismatch", target.name, Status.WARNING, told,
                            expected=target.type, actual=actual,
                        )
                    )
                )
                wanted = field.dataType
            value = quoted(target.name)
            if field.dataType != wanted and strict:
                rows.append(
                    _as_row(
                        Check(
                            "type_mismatch",
                            target.name,
                            Status.FAILED,
                            f"{target.name}: expected {target.type}, got {actual}",
                            expected=target.type,
                            actual=actual,
                        )
                    )
                )
            elif field.dataType != wanted:
                lost = value.isNotNull() & _converted(df, target).isNull()
                sums.append(F.count_if(lost).alias(f"_t{i}"))
                rows.append(
                    _counted_row(
                        "type_mismatch", target, actual, F.col(f"_t{i}"), "values do not convert"
                    )
                )
            if not target.nullable:
                sums.append(F.count_if(value.isNull()).alias(f"_v{i}"))
                rows.append(
                    _counted_row("not_null", target, actual, F.col(f"_v{i}"), "nulls")
                )
    if not sums:
        sums = [F.count(F.lit(1)).alias("_rows")] if df.columns else []
    if not sums:
        spark: SparkSession = df.sparkSession
        return spark.range(1).select(F.inline(F.array(*rows)))
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def key_findings(df: DataFrame, contract: Sequence[TargetColumn]) -> list[DataFrame]:
    """One check frame per declared key: the primary key and each unique column."""
    primary = [t.name for t in contract if t.is_primary_key]
    keys = ([("primary_key", primary)] if primary else []) + [
        ("unique", [t.name]) for t in contract if t.is_unique and [t.name] != primary
    ]
    frames = []
    for rule, names in keys:
        nulls = F.col("null_rows") if rule == "primary_key" else F.lit(0)
        bad = F.col("surplus_rows") + nulls
        frames.append(_finding(key_check(df, names), rule, ",".join(names), bad, "rows break the key"))
    return frames


def reference_findings(
    df: DataFrame, contract: Sequence[TargetColumn], tables: Mapping[str, DataFrame]
) -> list[DataFrame]:
    """One check frame per declared reference; a warning where the parent table is not given."""
    frames = []
    for target in contract:
        if target.foreign_key is None:
            continue
        table, column = target.foreign_key.rsplit(".", 1)
        if table not in tables:
            told = f"{target.name}: {table} was not given, {target.foreign_key} is not checked"
            spark = df.sparkSession
            frames.append(
                spark.range(1).select(
                    _as_row(Check("foreign_key", target.name, Status.WARNING, told)).alias("c")
                ).select("c.*")
            )
            continue
        counted = reference_check(df, [target.name], tables[table], [column])
        frames.append(
            _finding(counted, "foreign_key", target.name, F.col("orphan_rows"),
                     f"rows without a parent in {target.foreign_key}")
        )
    return frames


def _finding(counted: DataFrame, rule: str, column: str, bad: Column, complaint: str) -> DataFrame:
    bad = bad.cast("bigint")
    return counted.select(
        F.lit(rule).alias("rule"),
        F.lit(column).alias("column"),
        F.when(bad > 0, Status.FAILED.value).otherwise(Status.PASSED.value).alias("status"),
        F.lit(None).cast("string").alias("expected"),
        F.lit(None).cast("string").alias("actual"),
        bad.alias("violations"),
        F.when(bad > 0, F.format_string("%s: %d " + complaint, F.lit(column), bad))
        .otherwise(F.concat(F.lit(column), F.lit(": ok")))
        .alias("message"),
    )


def full_checks(
    df: DataFrame,
    contract: Sequence[TargetColumn],
    tables: Mapping[str, DataFrame] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Schema, type, null, key and reference findings in one frame."""
    present = [t for t in contract if df.columns.count(t.name) == 1]
    frames = [
        contract_checks(df, contract, strict),
        *key_findings(df, present),
        *reference_findings(df, present, tables or {}),
    ]
    return reduce(DataFrame.unionByName, frames)
