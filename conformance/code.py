"""Code steps: Spark functions, Python batches, group-relative values."""

from pyspark.sql import functions as F

from conformance import query, table
from sluiceway.functions.columns import (
    digest,
    json_text,
    pattern_group,
    round_half_even,
    trunc_to,
)
from sluiceway.operators.codesteps import (
    batches,
    gated,
    group_fold,
    group_relative,
    transform,
    with_group_values,
)
from sluiceway.operators.stability import schema_stability, varied_stability
from sluiceway.plans.flow import Flow
from sluiceway.plans.steps import Code, Source, Sql


@query(
    """
    SELECT c_custkey, md5(c_name) AS name_md5, sha256(c_name) AS name_sha256,
           sha1(CAST(c_custkey AS VARCHAR)) AS key_sha1
    FROM customer
    """
)
def code_hash_pii(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        digest(F.col("c_name"), "md5").alias("name_md5"),
        digest(F.col("c_name")).alias("name_sha256"),
        digest(F.col("c_custkey"), "sha1").alias("key_sha1"),
    )


@query(
    """
    SELECT page_id,
           regexp_extract(url, '^https?://([^/]+)', 1) AS host,
           nullif(regexp_extract(url, 'utm_source=([a-z]+)', 1), '') AS source,
           regexp_replace(url, '[?].*$', '') AS bare_url,
           nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title
    FROM pages
    """
)
def code_regex(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        pattern_group(url, r"^https?://(?P<host>[^/]+)").alias("host"),
        pattern_group(url, "utm_source=([a-z]+)").alias("source"),
        F.regexp_replace(url, "[?].*$", "").alias("bare_url"),
        F.nullif(pattern_group(F.col("html"), "<title>([^<]*)</title>"), F.lit("")).alias("title"),
    )


@query(
    """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
           json_extract_string(props, '$.none') AS missing
    FROM events
    """
)
def code_json(spark, sf_dir):
    props = F.col("props")
    return table(spark, sf_dir, "events").select(
        "event_id",
        json_text(props, "$.k").cast("bigint").alias("k"),
        json_text(props, "$.none").alias("missing"),
    )


@query(
    """
    SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start,
           CAST(o_orderdate AS DATE) + 30 AS due,
           CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS age,
           strftime(o_orderdate, '%Y-%m') AS month_name,
           CAST(year(o_orderdate) AS BIGINT) AS year
    FROM orders
    """
)
def code_dates(spark, sf_dir):
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        trunc_to(day, "month").alias("month_start"),
        F.date_add(day.cast("date"), 30).alias("due"),
        F.datediff(F.lit("2002-01-01").cast("date"), day.cast("date")).cast("bigint").alias("age"),
        F.date_format(day, "yyyy-MM").alias("month_name"),
        F.year(day).cast("bigint").alias("year"),
    )


@query(
    """
    SELECT p_partkey, round_even(p_retailprice, 0) AS rounded, sqrt(p_size) AS root,
           abs(p_size - 25) AS off, pow(p_size, 2) AS squared,
           greatest(p_size, 25) AS at_least, p_size % 7 AS rest, floor(p_retailprice / 7) AS part_of
    FROM part
    """
)
def code_math(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        round_half_even(price).alias("rounded"),
        F.sqrt(size).alias("root"),
        F.abs(size - 25).alias("off"),
        F.pow(size, F.lit(2)).alias("squared"),
        F.greatest(size, F.lit(25)).alias("at_least"),
        (size % 7).alias("rest"),
        F.floor(price / 7).cast("double").alias("part_of"),
    )


@query(
    """
    SELECT s_suppkey, upper(s_name) AS s_name, s_acctbal > 0 AS in_credit
    FROM supplier WHERE s_acctbal IS NOT NULL
    """
)
def code_transform(spark, sf_dir):
    def clean(df):
        return df.where(F.col("s_acctbal").isNotNull()).select(
            "s_suppkey",
            F.upper("s_name").alias("s_name"),
            (F.col("s_acctbal") > 0).alias("in_credit"),
        )

    return table(spark, sf_dir, "supplier").transform(transform(clean))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net,
           l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charged
    FROM lineitem
    """
)
def code_batches(spark, sf_dir):
    def charge(rows):
        net = rows["l_extendedprice"] * (1 - rows["l_discount"])
        kept = rows[["l_orderkey", "l_linenumber", "l_partkey"]]
        return kept.assign(net=net, charged=net * (1 + rows["l_tax"]))

    columns = [
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax",
    ]
    return (
        table(spark, sf_dir, "lineitem")
        .select(*columns)
        .transform(
            batches(
                charge,
                "l_orderkey bigint, l_linenumber int, l_partkey bigint, net double, charged double",
            )
        )
    )


@query(
    """
    SELECT event_id, user_id,
           CAST(cents * count(*) OVER u - sum(cents) OVER u AS BIGINT) AS off_mean,
           cents * count(*) OVER u > sum(cents) OVER u AS above_mean
    FROM (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events) AS t
    WINDOW u AS (PARTITION BY user_id)
    """
)
def code_grouped(spark, sf_dir):
    # whole cents times the group size: exact, however the sum was put together
    def center(rows):
        off = rows["cents"] * rows["n_events"] - rows["sum_cents"]
        return rows[["event_id", "user_id"]].assign(off_mean=off, above_mean=off > 0)

    return (
        table(spark, sf_dir, "events")
        .select("event_id", "user_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
        .transform(
            group_relative(
                ["user_id"],
                {"n_events": F.count(F.lit(1)), "sum_cents": F.sum("cents")},
                center,
                "event_id bigint, user_id bigint, off_mean bigint, above_mean boolean",
            )
        )
    )


@query(
    """
    SELECT event_id, event_type, value,
           max(value) OVER (PARTITION BY event_type) AS top_value,
           count(*) OVER (PARTITION BY event_type) AS n_events
    FROM events
    """
)
def code_group_values(spark, sf_dir):
    # a few event types hold all rows: every group is a large one
    return with_group_values(
        table(spark, sf_dir, "events").select("event_id", "event_type", "value"),
        ["event_type"],
        {"top_value": F.max("value"), "n_events": F.count(F.lit(1))},
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity,
           sum(l_quantity) OVER (PARTITION BY l_orderkey) AS order_quantity
    FROM lineitem
    """
)
def code_group_values_many(spark, sf_dir):
    # more groups than the broadcast list takes: most rows use the shuffled join
    return with_group_values(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"),
        ["l_orderkey"],
        {"order_quantity": F.sum("l_quantity")},
        large_groups=100,
    )


@query(
    """
    SELECT user_id, count(*) AS n_events, max(value) - min(value) AS spread
    FROM events GROUP BY user_id
    """
)
def code_per_group(spark, sf_dir):
    def partial(rows):
        return (
            rows.groupby("user_id", dropna=False)["value"]
            .agg(n_events="size", low="min", high="max")
            .reset_index()
        )

    def merge(states):
        return (
            states.groupby("user_id", dropna=False)
            .agg({"n_events": "sum", "low": "min", "high": "max"})
            .reset_index()
        )

    return (
        table(spark, sf_dir, "events")
        .select("user_id", "value")
        .transform(
            group_fold(
                ["user_id"], partial, merge, "user_id bigint, n_events bigint, low double, high double"
            )
        )
        .select("user_id", "n_events", (F.col("high") - F.col("low")).alias("spread"))
    )


@query(
    """
    SELECT c_custkey, upper(c_mktsegment) AS c_mktsegment, c_name FROM customer
    """
)
def code_gated(spark, sf_dir):
    def loud(df):
        return df.withColumn("c_mktsegment", F.upper("c_mktsegment"))

    def hidden(df):
        return df.withColumn("c_name", F.lit("hidden"))

    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_mktsegment", "c_name")
        .transform(gated(transform(loud), True))
        .transform(gated(transform(hidden), False))
    )


@query(
    """
    SELECT band, count(*) AS n_orders, round(sum(o_totalprice), 2) AS price FROM (
      SELECT o_totalprice, CAST(floor(o_totalprice / 50000) AS BIGINT) AS band
      FROM orders WHERE o_orderstatus <> 'P') AS t
    WHERE band > 0 GROUP BY band
    """
)
def mixed_sql_code_sql(spark, sf_dir):
    def banded(df):
        return df.withColumn("band", F.floor(F.col("o_totalprice") / 50000).cast("bigint"))

    return Flow(
        spark,
        [
            Source("source", table(spark, sf_dir, "orders")),
            Sql("finished", "SELECT o_totalprice FROM {prev} WHERE o_orderstatus <> 'P'"),
            Code("bands", banded),
            Code("not yet approved", lambda df: df.limit(1), enabled=False),
            Sql(
                "totals",
                """
                SELECT band, count(*) AS n_orders, round(sum(o_totalprice), 2) AS price
                FROM {prev} WHERE band > 0 GROUP BY band
                """,
            ),
        ],
    ).result()


@query(
    """
    SELECT 'event_id' AS "column", 'int64' AS types, CAST(1 AS BIGINT) AS n_positions,
           count(*) AS n_rows, true AS is_stable FROM events
    UNION ALL SELECT 'kind', 'string', 1, count(*), true FROM events
    UNION ALL SELECT 'score', 'double', 1, count(*), true FROM events
    """
)
def schema_stability_batches(spark, sf_dir):
    def score(rows):
        return rows[["event_id"]].assign(
            kind=rows["event_type"].str.upper(), score=rows["value"] / 2
        )

    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return schema_stability(events, score)


@query(
    """
    SELECT * FROM (VALUES ('event_id', 'int64', true, ''), ('kind', 'string', true, ''),
                          ('grade', 'int64,string', false, 'extremes'), ('share', 'double', false, 'no rows'))
    AS t("column", types, is_stable, shown_by) WHERE (SELECT count(*) FROM events) > 100
    """
)
def schema_stability_varied(spark, sf_dir):
    """A step whose columns are steady over all given rows, and what shows that two of them need not be."""

    def graded(rows):
        out = rows[["event_id"]].assign(kind=rows["event_type"].str.upper())
        out["grade"] = rows["value"].gt(10).astype(int) if rows["value"].notna().any() or not len(rows) else None
        if (rows["value"] == float("-inf")).any():
            out["grade"] = "lowest"
        if len(rows):  # forgotten for a batch without rows
            out["share"] = rows["value"].clip(-1e6, 1e6) / 7
        return out

    return varied_stability(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), graded)


@query(
    """
    SELECT CASE WHEN user_id % 5 <> 0 THEN user_id + 9007199254740992 END AS user_id, count(*) AS n_events
    FROM events GROUP BY 1
    """
)
def group_fold_null_keys(spark, sf_dir):
    """Keys beyond the whole numbers of a double, beside null keys."""

    def partial(rows):
        return rows.groupby("user_id", dropna=False).size().rename("n_events").reset_index()

    def merge(states):
        return states.groupby("user_id", dropna=False)["n_events"].sum().reset_index()

    far = F.when(F.col("user_id") % 5 != 0, F.col("user_id") + F.lit(2**53))
    return table(spark, sf_dir, "events").select(far.alias("user_id")).transform(
        group_fold(["user_id"], partial, merge, "user_id bigint, n_events bigint")
    )
