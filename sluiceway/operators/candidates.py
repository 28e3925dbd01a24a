"""Keys and references that a table does not declare, found in its data.

Both searches first look at sketches of distinct counts, which are small and merge, and shuffle values
only for what the sketches leave open. What they report is counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from sluiceway.functions.expression import quoted
from sluiceway.operators.values import comparable, distinct_estimate

KEY_FAMILIES = ("integer", "text", "date", "instant", "timestamp_ntz")  # what keys are made of
_SALTS = 64  # sketches of the tasks are merged in two steps
_SKETCH = 12  # binary logarithm of the values that a sketch keeps
_CERTAIN = math.log(2e9)  # a bound that is passed once in a thousand million times
_SAMPLE = 100_000  # rows that a repeat is looked for in first
_PER_JOB = 200  # sketches in one aggregation
_TASK_ROWS = 1_000_000  # rows whose values one task holds to find a repeat


def _estimates(df: DataFrame, sets: Sequence[tuple[str, ...]], error: float) -> dict[tuple[str, ...], int]:
    """Estimated distinct rows of each set of columns, in one pass over the table for every _PER_JOB sets."""
    found = {}
    for start in range(0, len(sets), _PER_JOB):
        part = sets[start : start + _PER_JOB]
        row = df.agg(
            *(
                distinct_estimate(F.xxhash64(*(quoted(c) for c in columns)), error).alias(f"_{i}")
                for i, columns in enumerate(part)
            )
        ).first()
        found |= {columns: row[f"_{i}"] for i, columns in enumerate(part)}
    return found


def key_candidates(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_width: int = 3,
    error: float = 0.01,
    deviations: float = 8.0,
) -> DataFrame:
    """The minimal sets of columns whose values are unique and never null: ``key_columns``, ``width``, ``n_rows``.

    Without ``columns`` whole numbers, texts, dates and times are looked at. The search goes by level: a set is
    looked at if no smaller key is in it. Three things rule a set out without a shuffle of its values: a null in a column, distinct
    counts whose product is below the rows, and an estimate of its distinct rows that is ``deviations``
    standard deviations (of ``error`` each) below the rows. A repeat among a part of the values rules out more. What is
    left is counted exactly, one set at a time; as a rule these are the keys. A table without rows has no candidates: nothing speaks for a key.
    ``key_columns`` are in the table's order, joined by commas.
    """
    names = [
        field.name
        for field in df.schema.fields
        if (form := comparable(field)) is not None
        and (field.name in columns if columns is not None else form[0] in KEY_FAMILIES)
    ]
    unknown = [name for name in columns or () if name not in names]
    if unknown:
        raise ValueError(f"columns that cannot be part of a key: {unknown}")
    out: list[tuple[str, int, int]] = []
    if names:
        counts = df.agg(
            F.count(F.lit(1)).alias("_n"), *(F.count(quoted(c)).alias(f"_{i}") for i, c in enumerate(names))
        ).first()
        n = counts["_n"]
        names = [c for i, c in enumerate(names) if counts[f"_{i}"] == n] if n else []
        out = [(",".join(key), len(key), n) for key in _minimal_keys(df, names, n, max_width, error, deviations)]
    return df.sparkSession.createDataFrame(out, "key_columns string, width int, n_rows bigint")


def _minimal_keys(
    df: DataFrame, names: list[str], n: int, max_width: int, error: float, deviations: float
) -> list[tuple[str, ...]]:
    keys: list[tuple[str, ...]] = []
    least, most = 1 - deviations * error, 1 + deviations * error
    distinct: dict[tuple[str, ...], int] = {}
    for width in range(1, min(max_width, len(names)) + 1):
        open_ = [s for s in combinations(names, width) if not any(set(key) <= set(s) for key in keys)]
        # a set has at most as many distinct rows as its parts have together
        possible = [
            s for s in open_
            if width == 1 or min(
                distinct[part] * distinct[rest,] for rest in s for part in [tuple(c for c in s if c != rest)]
            ) * most**2 >= n
        ]
        distinct |= _estimates(df, possible, error)
        likely = [s for s in possible if distinct[s] >= n * least]
        keys += [s for s in _without_repeats(df, likely, n) if _is_unique(df, s, n)]
        for s in open_:  # bounds for the next level
            if s not in distinct:
                distinct[s] = math.ceil(
                    min(distinct[tuple(c for c in s if c != rest)] * distinct[rest,] for rest in s) * most**2
                )
    return keys


def _without_repeats(df: DataFrame, sets: list[tuple[str, ...]], n: int) -> list[tuple[str, ...]]:
    """The sets that have no repeat among some of their values: about _SAMPLE rows, chosen by the value's hash.

    Rows of equal values are chosen together, so a set with few repeats in a hundred is ruled out by a small part
    of the table. All sets share one pass; a value travels as 128 bits of hash.
    """
    kept = []
    part = max(1, n // _SAMPLE)
    for start in range(0, len(sets), _PER_JOB):
        some = sets[start : start + _PER_JOB]
        values = F.array(
            *(
                F.struct(
                    F.lit(i).alias("set"),
                    F.xxhash64(*(quoted(c) for c in s)).alias("a"),
                    F.xxhash64(F.lit(1), *(quoted(c) for c in s)).alias("b"),
                )
                for i, s in enumerate(some)
            )
        )
        chosen = df.select(F.inline(values)).where(F.pmod("a", F.lit(part)) == 0)
        repeated = chosen.groupBy("set", "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        ruled_out = {r["set"] for r in repeated.select("set").distinct().collect()}  # a row per set at most
        kept += [s for i, s in enumerate(some) if i not in ruled_out]
    return kept


def _is_unique(df: DataFrame, columns: Sequence[str], n: int) -> bool:
    """Exactly: no value occurs twice among the ``n`` rows. Counting stops nowhere.

    Few values repeat by now, so rows are dealt by value before they are counted, about _TASK_ROWS to a task: a
    task then holds its own values only, not those of the steps that ``df`` is made by as well.
    """
    names = [quoted(c) for c in columns]
    dealt = df.select(*names).repartition(max(1, -(-n // _TASK_ROWS)), *names)
    counts = dealt.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where("_n > 1").limit(1).count() == 0


def column_sketches(df: DataFrame, columns: Mapping[int, Column]) -> DataFrame:
    """``site``, ``sketch``: a theta sketch of the values of each numbered column, merged over the tasks in two steps."""
    parts = df.select(*(form.alias(f"_{i}") for i, form in columns.items())).groupBy(
        F.pmod(F.spark_partition_id(), F.lit(_SALTS)).alias("_salt")
    ).agg(*(F.theta_sketch_agg(f"_{i}", F.lit(_SKETCH)).alias(f"_{i}") for i in columns))
    merged = parts.agg(*(F.theta_union_agg(f"_{i}", F.lit(_SKETCH)).alias(f"_{i}") for i in columns))
    return merged.select(
        F.inline(F.array(*(F.struct(F.lit(i).alias("site"), F.col(f"_{i}").alias("sketch")) for i in columns)))
    )


def possible_inclusions(sketches: DataFrame, families: Sequence[str], min_inclusion: float) -> set[tuple[int, int]]:
    """Pairs (child, parent) of sites that the sketches do not rule out.

    A sketch keeps the values of least hash, so of the child's values those below both sketches' bounds are a
    sample that tells whether each is in the parent. A pair goes if the share found in the sample plus a bound on its error
    (twice Hoeffding's, which is passed once in a thousand million times, as the sample's size is random too)
    stays below ``min_inclusion``. Sketches of few values hold them all and are exact. There are as many pairs as
    pairs of columns.
    """
    kinds = F.array(*(F.lit(f) for f in families))
    side = sketches.select("site", "sketch", F.get(kinds, F.col("site")).alias("family"))
    child = side.select(F.col("site").alias("c"), F.col("sketch").alias("cs"), "family")
    parent = side.select(F.col("site").alias("p"), F.col("sketch").alias("ps"), "family")
    told = child.join(parent, "family").where("c <> p").select(
        "c", "p",
        F.theta_sketch_estimate("cs").alias("n_child"),
        F.theta_sketch_estimate("ps").alias("n_parent"),
        F.theta_sketch_estimate(F.theta_intersection("cs", "ps")).alias("n_both"),
    ).collect()
    kept, held = set(), 1 << _SKETCH
    for r in told:
        if not r["n_child"]:
            continue
        widest = max(r["n_child"], r["n_parent"])
        # a theta sketch holds all values up to its nominal number; the estimate of more is far from 0.8 of it
        sample = max(r["n_child"] * held / (2 * widest), 1e-9)
        slack = 0.0 if widest <= 0.8 * held else 2 * math.sqrt(_CERTAIN / (2 * sample))
        if r["n_both"] / r["n_child"] + slack >= min_inclusion:
            kept.add((r["c"], r["p"]))
    return kept
