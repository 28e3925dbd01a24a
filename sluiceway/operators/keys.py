"""Keys and references checked on the data itself.

Every check counts per key value first (with map-side partial counts), so a key
that fills a third of the table travels as a few partial rows, and joins only
see one row per distinct value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluiceway.functions.expression import quoted
from sluiceway.operators.candidates import KEY_FAMILIES, column_sketches, possible_inclusions
from sluiceway.operators.values import comparable, tagged_values

_WORD = 63  # usable bits of one bigint mask
_WIDE = T.DecimalType(38, 18)  # where a whole number and a fraction meet


def _any_null(names: Sequence[str]) -> Column:
    return reduce(or_, [quoted(name).isNull() for name in names])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key values that occur more than once, with their row counts."""
    counts = df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.where((F.col("n_rows") > 1) & ~_any_null(keys))


def key_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row telling whether ``keys`` are a key: no nulls and no duplicates."""
    n = F.col("n_rows")
    counts = (
        df.groupBy(*[quoted(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(n, _any_null(keys).alias("has_null"))
    )
    whole = ~F.col("has_null")
    zero = F.lit(0).cast("bigint")
    return counts.agg(
        F.lit(",".join(keys)).alias("key_columns"),
        F.coalesce(F.sum(n), zero).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("has_null"), n)), zero).alias("null_rows"),
        F.count_if(whole).alias("distinct_keys"),
        F.count_if(whole & (n > 1)).alias("duplicated_keys"),
        F.coalesce(F.sum(F.when(whole & (n > 1), n - 1)), zero).alias("surplus_rows"),
    ).withColumn("is_key", (F.col("null_rows") == 0) & (F.col("duplicated_keys") == 0))


def _shared_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """A type that holds the values of both sides without loss.

    Both sides are cast to it, so counting and joining share a shuffle. Whole numbers beside
    fractions are compared as decimals where these are wide enough, dates and times as
    times, everything beside text as text. Other pairs are refused.
    """
    if left == right:
        return left
    kinds = (left, right)

    def all_of(*classes) -> bool:
        return all(isinstance(kind, classes) for kind in kinds)

    if all_of(T.IntegralType):
        return T.LongType()
    if all_of(T.FloatType, T.DoubleType):
        return T.DoubleType()
    if all_of(T.IntegralType, T.DecimalType):
        sides = [
            (kind.precision - kind.scale, kind.scale) if isinstance(kind, T.DecimalType) else (19, 0)
            for kind in kinds
        ]
        whole, scale = (max(side[k] for side in sides) for k in range(2))
        if whole + scale <= 38:
            return T.DecimalType(whole + scale, scale)
    if all_of(T.IntegralType, T.DoubleType, T.FloatType):
        small = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)
        # a bigint and a double meet where neither is rounded: as decimals
        return T.DoubleType() if all_of(*small) else _WIDE
    if all_of(T.DateType, T.TimestampNTZType):
        return T.TimestampNTZType()
    if all_of(T.DateType, T.TimestampType):
        return T.TimestampType()
    if any(isinstance(kind, T.StringType) for kind in kinds):
        return T.StringType()
    raise ValueError(f"a reference cannot compare {left.simpleString()} with {right.simpleString()}")


def _key_parts(df: DataFrame, name: str, kind: T.DataType, alias: str) -> list[Column]:
    """The value as ``kind``. A fraction too large for it stays beside it as it is, and equals nothing."""
    value = quoted(name)
    if kind == _WIDE and isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        fitting = value.try_cast(kind)
        beyond = F.when(fitting.isNull(), value.cast("double"))
        return [fitting.alias(alias), beyond.alias(f"{alias}_beyond")]
    return [value.cast(kind).alias(alias)]


def _counted_references(
    child: DataFrame,
    child_columns: Sequence[str],
    parent: DataFrame,
    parent_columns: Sequence[str],
) -> tuple[DataFrame, DataFrame, Column]:
    if len(child_columns) != len(parent_columns):
        raise ValueError("a reference needs as many parent columns as child columns")
    child_keys, parent_keys, same = [], [], []
    for i, (ours, theirs) in enumerate(zip(child_columns, parent_columns)):
        kind = _shared_type(child.schema[ours].dataType, parent.schema[theirs].dataType)
        child_keys += _key_parts(child, ours, kind, f"_c{i}")
        parent_keys.append(_key_parts(parent, theirs, kind, f"_p{i}")[0])
        same.append(F.col(f"_c{i}") == F.col(f"_p{i}"))
    named = child.select(*child_keys)
    references = named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("n_rows"))
    return references, parent.select(*parent_keys).distinct(), reduce(and_, same)


def _refers_to_nothing(references: DataFrame, n: int) -> Column:
    """True where a part of the reference is null."""

    def null(i: int) -> Column:
        beyond = f"_c{i}_beyond"
        missing = F.col(f"_c{i}").isNull()
        return missing & F.col(beyond).isNull() if beyond in references.columns else missing

    return reduce(or_, [null(i) for i in range(n)])


def orphans(
    child: DataFrame,
    child_columns: Sequence[str],
    parent: DataFrame,
    parent_columns: Sequence[str],
) -> DataFrame:
    """Reference values without a parent, with their row counts.

    A reference with a null part refers to nothing and passes.
    """
    references, keys, same = _counted_references(child, child_columns, parent, parent_columns)

    def shown(i: int, name: str) -> Column:
        beyond = f"_c{i}_beyond"
        value = F.col(f"_c{i}")
        if beyond in references.columns:
            value = F.coalesce(value.cast("double"), F.col(beyond))
        return value.alias(name)

    return (
        references.where(~_refers_to_nothing(references, len(child_columns)))
        .join(keys, same, "left_anti")
        .select(*[shown(i, name) for i, name in enumerate(child_columns)], "n_rows")
    )


def reference_check(
    child: DataFrame,
    child_columns: Sequence[str],
    parent: DataFrame,
    parent_columns: Sequence[str],
    name: str | None = None,
) -> DataFrame:
    """One row: references, orphans, and the share of values that have a parent."""
    references, keys, same = _counted_references(child, child_columns, parent, parent_columns)
    n, null, lone = F.col("n_rows"), F.col("has_null"), F.col("lone")
    joined = references.join(keys, same, "left").select(
        n, _refers_to_nothing(references, len(child_columns)).alias("has_null"), F.col("_p0").isNull().alias("lone")
    )
    zero = F.lit(0).cast("bigint")
    values, orphan_values = F.count_if(~null), F.count_if(~null & lone)
    return joined.agg(
        F.lit(name or ",".join(child_columns) + "->" + ",".join(parent_columns)).alias("reference"),
        F.coalesce(F.sum(n), zero).alias("total_rows"),
        F.coalesce(F.sum(F.when(null, n)), zero).alias("null_rows"),
        values.alias("distinct_values"),
        orphan_values.alias("orphan_values"),
        F.coalesce(F.sum(F.when(~null & lone, n)), zero).alias("orphan_rows"),
        F.when(values > 0, F.round(1 - orphan_values / values, 6)).alias("inclusion"),
    ).withColumn("holds", F.col("orphan_values") == 0)


def _masks(sites: int) -> list[tuple[str, Column]]:
    """For each bigint word, the bits of the sites that were met."""
    site = F.col("site")
    words = []
    for w in range((sites + _WORD - 1) // _WORD):
        bit = F.when(
            (site >= w * _WORD) & (site < (w + 1) * _WORD),
            F.expr(f"shiftleft(1L, site - {w * _WORD})"),
        ).otherwise(F.lit(0).cast("bigint"))
        words.append((f"mask{w}", F.bit_or(bit)))
    return words


_REFERENCES = (
    "child_table string, child_column string, parent_table string, parent_column string, "
    "distinct_values bigint, contained_values bigint, inclusion double, holds boolean"
)


def discover_references(
    tables: Mapping[str, DataFrame],
    columns: Mapping[str, Sequence[str]] | None = None,
    all_pairs: bool = False,
    min_inclusion: float | None = None,
) -> DataFrame:
    """Ordered pairs of columns with the share of values the first has in the second.

    Pairs that share no value are left out unless ``all_pairs`` asks for them, so that the
    result does not grow with the square of the columns. Without ``columns`` the columns of whole numbers, texts,
    dates and times are compared, else the named ones; a named column that cannot be compared is refused.
    With ``min_inclusion`` only pairs with at least that share are told. Sketches of the columns then rule out
    most pairs before any value is shuffled, and the values of columns that are in no
    possible pair are not shuffled at all.
    Each distinct value is marked with the set of columns it occurs in (one bit
    per column), in one aggregation over all tables. Only these few distinct
    sets, not the values, are then spread into column pairs.
    """
    if all_pairs and min_inclusion is not None:
        raise ValueError("give either all_pairs or min_inclusion")
    sites: list[tuple[str, str, str]] = []
    forms: dict[str, dict[int, Column]] = {}
    for table, df in tables.items():
        for field in df.schema.fields:
            form = comparable(field)
            wanted = columns is None or field.name in columns.get(table, ())
            named = columns is not None and wanted
            if named and form is None:
                raise ValueError(f"{table}.{field.name} cannot be compared")
            if wanted and form is not None and (named or form[0] in KEY_FAMILIES):
                forms.setdefault(table, {})[len(sites)] = form[1]
                sites.append((table, field.name, form[0]))
    if not sites:
        raise ValueError("no columns to compare")
    possible: set[tuple[int, int]] | None = None
    if min_inclusion is not None:
        sketches = reduce(DataFrame.unionAll, [column_sketches(tables[t], found) for t, found in forms.items()])
        possible = possible_inclusions(sketches, [site[2] for site in sites], min_inclusion)
    looked_at = set(range(len(sites))) if possible is None else {i for pair in possible for i in pair}
    parts: dict[str, list[DataFrame]] = {}
    for table, found in forms.items():
        values: dict[str, list[tuple[int, Column]]] = {}
        for i, form in found.items():
            if i in looked_at:
                values.setdefault(sites[i][2], []).append((i, form))
        for family, tagged in values.items():
            parts.setdefault(family, []).append(tagged_values(tables[table], tagged))
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], _REFERENCES)

    masks = _masks(len(sites))
    names = [name for name, _ in masks]
    sets = reduce(
        DataFrame.unionAll,
        [
            reduce(DataFrame.unionAll, found)
            .groupBy("value")
            .agg(*[mask.alias(name) for name, mask in masks])
            .groupBy(*names)
            .agg(F.count(F.lit(1)).alias("n"))
            for found in parts.values()
        ],
    )
    members = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"mask{i // _WORD}").bitwiseAND(F.lit(1 << (i % _WORD))) != 0, F.lit(i)
                )
                for i in range(len(sites))
            ]
        )
    )
    # from here on there is at most one row per pair of columns
    shared = (
        sets.select("n", members.alias("members"))
        .select("n", "members", F.explode("members").alias("own"))
        .select("n", "own", F.explode("members").alias("other"))
        .groupBy("own", "other")
        .agg(F.sum("n").alias("n"))
        .groupBy("own")
        .agg(F.map_from_entries(F.collect_list(F.struct("other", "n"))).alias("shared"))
    )
    table_of, column_of, family_of = (
        F.array(*[F.lit(site[part]) for site in sites]) for part in range(3)
    )
    own, other = F.col("own"), F.col("other")
    others = F.sequence(F.lit(0), F.lit(len(sites) - 1)) if all_pairs else F.map_keys("shared")
    contained = F.coalesce(F.col("shared")[other], F.lit(0).cast("bigint"))
    distinct = F.col("shared")[own]
    pairs = shared.select("own", "shared", F.explode(others).alias("other")).where(
        (own != other) & (family_of[own] == family_of[other])
    )
    if min_inclusion is not None:
        pairs = pairs.where(contained >= F.lit(min_inclusion) * distinct)
    return (
        pairs
        .select(
            table_of[own].alias("child_table"),
            column_of[own].alias("child_column"),
            table_of[other].alias("parent_table"),
            column_of[other].alias("parent_column"),
            distinct.alias("distinct_values"),
            contained.alias("contained_values"),
            F.round(contained / distinct, 6).alias("inclusion"),
            (contained == distinct).alias("holds"),
        )
    )
