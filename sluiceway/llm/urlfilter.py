"""URL filters whose lists change over time, with column expressions only.

Dated entries (a pattern is added to or removed from a list on a day) become
validity intervals. Each capture is matched to the entries that were in force
when it was fetched, for its host and every parent domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# days of an era; intervals are cut at eras, so that a host's history is many keys
ERA_DAYS = 64

FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """The lower-cased host, without login, port or final dot; null if there is none."""
    rest = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    host = F.regexp_replace(rest, r"\.+$", "")
    return F.when(host != "", host)


def parent_domains(host: Column) -> Column:
    """The host and its parents: a.b.example.com, b.example.com, example.com, com."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
    )


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``list_name, domain, action, valid_from, valid_to`` (end exclusive) from dated entries.

    ``entries`` has ``list_name``, ``domain``, ``action`` (``block`` or ``allow``), ``change`` (``add`` or
    ``remove``) and ``day``. An entry is in force from the day it is added until the next
    day on which it is removed. Adding again what is in force, or removing what is not,
    changes nothing; on one day a removal wins. Entries with a null field other
    than the list's name are void. Repeated entries count once.
    """
    days = (
        entries.select(
            F.coalesce("list_name", F.lit("")).alias("list_name"),
            F.lower("domain").alias("domain"),
            "action",
            F.col("day").cast("date").alias("day"),
            F.when(F.col("change") == "add", 1).when(F.col("change") == "remove", 0).alias("on"),
        )
        .where("domain is not null and day is not null and `on` is not null")
        .where(F.col("action").isin("block", "allow"))
        .groupBy("list_name", "domain", "action", "day")
        .agg(F.min("on").alias("on"))
    )
    order = Window.partitionBy("list_name", "domain", "action").orderBy("day")
    changes = days.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(0))).where("`on` <> was")
    return (
        changes.withColumn("valid_to", F.coalesce(F.lead("day").over(order), F.lit(FOREVER).cast("date")))
        .where("`on` = 1")
        .select("list_name", "domain", "action", F.col("day").alias("valid_from"), "valid_to")
    )


def filter_urls(
    captures: DataFrame,
    entries: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    day_col: str = "fetched",
) -> DataFrame:
    """``page_id, host, fetched, n_block, n_allow, matched, kept`` for every capture.

    ``matched`` is the most specific domain with an entry in force on the day of the
    fetch, over all lists. It decides: ``allow`` beats ``block`` on the same domain. Counts are of
    entries in force for the host or its parents. Captures without a host or a
    day match nothing and are kept. Repeated rows are judged one by one;
    an empty list keeps everything.

    The distinct pairs of host and day meet the intervals on (domain, era): a domain's
    long history is spread over the eras, and a busy host counts once a day. Captures then
    get the verdict of their host and day, a join whose skewed keys can be split.
    """
    era = lambda day: F.floor(F.unix_date(day) / ERA_DAYS)
    fetched = captures.select(
        F.col(id_col).alias("page_id"),
        host_of(F.col(url_col).cast("string")).alias("host"),
        F.col(day_col).cast("date").alias("fetched"),
    )
    # intervals are cut to the days of the captures, so that their eras are finite
    ends = fetched.agg(F.min("fetched").alias("a"), F.max("fetched").alias("b")).first()
    cut = (
        validity_intervals(entries)
        .withColumn("a", F.greatest("valid_from", F.lit(ends["a"]).cast("date")))
        .withColumn("b", F.least(F.date_sub("valid_to", 1), F.lit(ends["b"]).cast("date")))
        .where("a <= b")
        .withColumn("era", F.explode(F.sequence(era(F.col("a")), era(F.col("b")))))
        .select("domain", "era", "action", "valid_from", "valid_to")
    )
    # the verdict depends on host and day alone
    asked = (
        fetched.where("host is not null and fetched is not null")
        .select("host", "fetched")
        .distinct()
        .withColumn("domain", F.explode(parent_domains(F.col("host"))))
        .withColumn("era", era(F.col("fetched")))
    )
    in_force = (F.col("fetched") >= F.col("valid_from")) & (F.col("fetched") < F.col("valid_to"))
    judged = (
        asked.join(cut, ["domain", "era"])
        .where(in_force)
        .groupBy("host", "fetched")
        .agg(
            F.count(F.when(F.col("action") == "block", 1)).alias("n_block"),
            F.count(F.when(F.col("action") == "allow", 1)).alias("n_allow"),
            F.max(
                F.struct(
                    F.length("domain").alias("length"),
                    (F.col("action") == "allow").alias("allow"),
                    F.col("domain").alias("domain"),
                )
            ).alias("best"),
        )
    )
    return fetched.join(judged, ["host", "fetched"], "left").select(
        "page_id",
        "host",
        "fetched",
        F.coalesce("n_block", F.lit(0)).cast("long").alias("n_block"),
        F.coalesce("n_allow", F.lit(0)).cast("long").alias("n_allow"),
        F.col("best.domain").alias("matched"),
        F.coalesce("best.allow", F.lit(True)).alias("kept"),
    )
