"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a line of its shuffled documents, cut into blocks of equal
token counts. The points of a van der Corput sequence, mapped through the
cumulative slot counts, deal the slots of the mix to the sources; a source's
slots, ranked in the order of the mix, take its blocks one after another,
starting over at the line's end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.staging import written

# documents that one task puts in order at a time; slots that one task ranks, as a power of 2
BUCKET_ROWS = 20_000
BUCKET_SLOT_BITS = 16

BLANKS = " \t\n\x0b\x0c\r"
WORD_AND_BLANKS_BEFORE = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"


def word_count(text: str) -> Column:
    """Runs of non-blank characters. Each becomes one letter, so that no list of words is made."""
    ended = F.rtrim(F.col(text).cast("string"), F.lit(BLANKS))
    letters = F.regexp_replace(ended, WORD_AND_BLANKS_BEFORE, "x")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def _reversed_bits(value: Column, bits: int) -> Column:
    """The van der Corput rank of an index: its bits, last first."""
    return F.conv(F.reverse(F.lpad(F.bin(value), bits, "0")), 2, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, cap: float
) -> DataFrame:
    """One row per source: ``key``, ``source_size``, ``target`` (double).

    ``sizes`` has ``key``, ``source`` and ``size``. Sources in code-point order, null last,
    take ``weights`` by turns. ``share`` of all sizes is dealt by weight; no
    target exceeds ``cap`` times its source, and the excess goes to the others by weight.

    With sources ordered by cap over weight the common level is the largest of
    (what the capped ones leave) / (weight of the others). One row per source
    passes through one task.
    """
    totals = sizes.groupBy("key").agg(
        F.max("source").alias("source"), F.sum("size").cast("long").alias("source_size")
    )
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*(F.lit(float(w)) for w in weights)),
        F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))).cast("int") + 1,
    )
    all_rows = Window.partitionBy(F.lit(0))
    order = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        totals.withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(all_rows))
        .withColumn(
            "level",
            (F.col("wanted") - F.coalesce(F.sum("limit").over(order), F.lit(0.0)))
            / (F.col("all_weight") - F.coalesce(F.sum("weight").over(order), F.lit(0.0))),
        )
    )
    level = F.max("level").over(all_rows)
    return levels.select(
        "key", "source_size", F.least("limit", level * F.col("weight")).alias("target")
    )


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text_col).alias("size"),
        )
        # a key that keeps a null source apart from any text
        .withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .withColumn("shuffled", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        "mix-sizes",
    )


def mixture(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    block_tokens: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The pieces of the mix, one row per document and slot it fills.

    Columns: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``row`` (which
    row of its source and bucket it is), ``slot`` (place in the mix; the order of
    the mix is slot, then from_word), ``pass`` (0 or 1, the second time the source is read),
    ``from_word`` and ``words``. Documents that the mix does not take have one row
    with a null slot and no words.

    A null text has no words; null sources are one source of their own, last in
    order. Repeated rows are separate documents. Reruns agree: the order of a
    source is that of md5(doc_id). An empty table gives no rows. ``cap`` is at most 2.
    """
    if not 0 < cap <= 2:
        raise ValueError("a source is read twice at most")
    measured = _measured(docs, id_col, text_col, source_col)
    digits = max(1, math.ceil(math.log(max(measured.count(), 1) / BUCKET_ROWS, 16)))
    measured = measured.withColumn("bucket", F.substring("shuffled", 1, digits))

    # where each bucket starts on its source's line: sums first, then a window over sums
    sums = measured.groupBy("key", "bucket").agg(
        F.sum("size").alias("size"), F.max("source").alias("source")
    )
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    targets = written(source_targets(sums, weights, share, cap), "mix-targets")
    line = (
        sums.withColumn("bucket_start", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .select("key", "bucket", "bucket_start")
        .join(
            targets.withColumn("goal", F.floor(F.col("target") + 0.5)).withColumn(
                "block", F.greatest(F.least(F.col("goal"), F.lit(block_tokens)), F.lit(1))
            ),
            "key",
        )
    )
    within = Window.partitionBy("key", "bucket").orderBy("shuffled", "doc_id", "size")
    placed = (
        measured.withColumn("row", F.row_number().over(within))
        .withColumn(
            "offset",
            F.coalesce(
                F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .join(line, ["key", "bucket"])
        .withColumn("start", F.col("bucket_start") + F.col("offset"))
    )

    def copy(number: int) -> Column:
        start = F.col("start") + number * F.col("source_size")
        stop = F.least(start + F.col("size"), F.col("goal"))
        return F.when(
            stop > start,
            F.transform(
                F.sequence(F.expr(f"(start + {number} * source_size) div block"), F.expr(
                    f"(least(start + {number} * source_size + size, goal) - 1) div block"
                )),
                lambda at: F.struct(
                    at.alias("rank"),
                    F.lit(number).alias("pass"),
                    (F.greatest(start, at * F.col("block")) - start).alias("from_word"),
                    (
                        F.least(stop, (at + 1) * F.col("block"))
                        - F.greatest(start, at * F.col("block"))
                    ).alias("words"),
                ),
            ),
        ).otherwise(F.expr("array()"))

    pieces = placed.withColumn("piece", F.explode_outer(F.concat(copy(0), copy(1)))).select(
        "key", "bucket", "row", "doc_id", "source", "size", "source_size", "target", "piece.*"
    )
    taken = pieces.where("rank is not null").join(_slots(targets, block_tokens), ["key", "rank"])
    idle = pieces.where("rank is null").withColumn("slot", F.lit(None).cast("long"))
    names = ["doc_id", "source", "size", "source_size", "target", "key", "bucket", "row",
             "slot", "pass", "from_word", "words"]
    return taken.select(names).unionByName(
        idle.select(names).withColumn("words", F.lit(0).cast("long"))
    )


def _slots(targets: DataFrame, block_tokens: int) -> DataFrame:
    """``key``, ``rank`` and ``slot``: the slots of each source, ranked in the order of the mix."""
    goal = F.floor(F.col("target") + 0.5)
    block = F.greatest(F.least(goal, F.lit(block_tokens)), F.lit(1))
    counts = targets.withColumn("n", F.ceil(goal / block).cast("long")).where("n > 0")
    first = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.withColumn("low", F.coalesce(F.sum("n").over(first), F.lit(0))).select(
        "key", "low", (F.col("low") + F.col("n")).alias("high")
    )
    total = spans.agg(F.max("high")).first()[0] or 0
    bits = max(1, (max(total, 2) - 1).bit_length())
    chunk = 1 << 12
    points = (
        spans.withColumn("chunk", F.explode(F.sequence(F.expr(f"low div {chunk}"), F.expr(f"(high - 1) div {chunk}"))))
        .repartition("key", "chunk")
        .withColumn(
            "point",
            F.explode(
                F.sequence(
                    F.greatest("low", F.col("chunk") * chunk),
                    F.least("high", (F.col("chunk") + 1) * chunk) - 1,
                )
            ),
        )
        .select("key", _reversed_bits(F.col("point"), bits).alias("slot"))
        .withColumn("part", F.shiftright("slot", min(bits, BUCKET_SLOT_BITS)))
    )
    sums = points.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked")
    )
    inside = Window.partitionBy("key", "part").orderBy("slot")
    return (
        points.withColumn("place", F.row_number().over(inside) - 1)
        .join(starts, ["key", "part"])
        .select("key", (F.col("ranked") + F.col("place")).alias("rank"), "slot")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``.

    ``taken`` counts the words the mix takes, repeats included; ``first_slot`` is
    where it first appears. The same options and rules as ``mixture``.
    """
    same = ["key", "bucket", "row"]
    kept = ["doc_id", "source", "size", "source_size", "target"]
    return (
        mixture(docs, **options)
        .groupBy(*same, *kept)
        .agg(F.sum("words").cast("long").alias("taken"), F.min("slot").alias("first_slot"))
        .select("doc_id", "size", "source_size", "target", "taken", "first_slot")
    )
