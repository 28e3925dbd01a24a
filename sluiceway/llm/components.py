"""Connected components of a link table, smallest id as the label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.staging import written


def connected_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``node`` and ``component`` for every node of ``links(a, b)``.

    Large-star and small-star steps by turns: each moves the links of a node to
    its smallest neighbour, which keeps every component together, until all
    links end at the component's smallest id. The minimum of a hub is summed
    per task before it is shuffled, and its links are joined in place, where a
    skewed key can be split. Each round is written to the shared folder.
    """
    stars = written(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    for _ in range(rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).where("u <> v")
        large = large.distinct()
        # small-star: u's smaller neighbours and u itself move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        stars = written(small, "links")
        now = stars.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
