"""Whole flows: the flagship, several inputs and targets, preview, run, metrics."""

from pyspark.sql import functions as F

from conformance import query, table
from sluiceway.operators.codesteps import batches
from sluiceway.plans.flow import Flow
from sluiceway.plans.steps import Code, Columns, Source, Sql, Target
from sluiceway.session import new_scratch_path
from sluiceway.sinks.base import Pending
from sluiceway.sinks.files import DryRun, ReplaceFiles


def flagship_flow(spark, sf_dir):
    return Flow(
        spark,
        [
            Source("lines", table(spark, sf_dir, "lineitem")),
            Source("orders", table(spark, sf_dir, "orders")),
            Source("customers", table(spark, sf_dir, "customer")),
            Sql(
                "sold",
                """
                SELECT c.c_mktsegment, o.o_orderkey, l.l_extendedprice * (1 - l.l_discount) AS net
                FROM {lines} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
                JOIN {customers} c ON o.o_custkey = c.c_custkey
                WHERE l.l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND o.o_orderstatus <> 'P'
                """,
                inputs={"lines": "lines", "orders": "orders", "customers": "customers"},
            ),
            Sql(
                "by segment",
                """
                SELECT c_mktsegment, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders,
                       round(sum(net), 4) AS revenue
                FROM {prev} GROUP BY c_mktsegment
                """,
            ),
            Columns(
                "shape",
                [
                    {
                        "type": "column_mapping",
                        "config": {
                            "mappings": [
                                {"source_col": "c_mktsegment", "target_col": "segment", "drop": False},
                                {"source_col": "revenue", "target_col": "revenue", "drop": False},
                                {"source_col": "n_lines", "target_col": "lines", "drop": False},
                                {"source_col": "n_orders", "target_col": "orders", "drop": False},
                            ]
                        },
                    },
                    {
                        "type": "sql_expression",
                        "config": {"expression": "LOWER(segment)", "output_column": "segment"},
                    },
                    {
                        "type": "sql_expression",
                        "config": {
                            "expression": "CONCAT(segment, ': ', lines, ' lines')",
                            "output_column": "label",
                        },
                    },
                ],
            ),
        ],
    )


@query(
    """
    SELECT lower(c_mktsegment) AS segment, round(sum(net), 4) AS revenue, count(*) AS lines,
           count(DISTINCT o_orderkey) AS orders,
           lower(c_mktsegment) || ': ' || count(*) || ' lines' AS label
    FROM (
      SELECT c_mktsegment, o_orderkey, l_extendedprice * (1 - l_discount) AS net
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderstatus <> 'P') AS t
    GROUP BY c_mktsegment
    """
)
def revenue_by_segment(spark, sf_dir):
    return flagship_flow(spark, sf_dir).result()


@query(
    """
    SELECT n_name, kind, count(*) AS n_accounts, round(sum(balance), 2) AS balance
    FROM (SELECT c_nationkey AS nation, c_acctbal AS balance, 'customer' AS kind FROM customer
          UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier) AS accounts
    JOIN nation ON nation = n_nationkey GROUP BY n_name, kind
    """
)
def multi_input_union_join(spark, sf_dir):
    def merge(people, firms):
        return people.withColumn("kind", F.lit("customer")).unionByName(
            firms.withColumn("kind", F.lit("supplier"))
        )

    return Flow(
        spark,
        [
            Source(
                "people",
                table(spark, sf_dir, "customer").selectExpr(
                    "c_nationkey AS nation", "c_acctbal AS balance"
                ),
            ),
            Source(
                "firms",
                table(spark, sf_dir, "supplier").selectExpr(
                    "s_nationkey AS nation", "s_acctbal AS balance"
                ),
            ),
            Code("accounts", merge, inputs={"people": "people", "firms": "firms"}),
            Source("nations", table(spark, sf_dir, "nation")),
            Sql(
                "named",
                """
                SELECT n_name, kind, count(*) AS n_accounts, round(sum(balance), 2) AS balance
                FROM {left} JOIN {right} ON nation = n_nationkey GROUP BY n_name, kind
                """,
                inputs={"left": "accounts", "right": "nations"},
            ),
        ],
    ).result()


def _fan_out(spark, sf_dir, share):
    big, small = new_scratch_path(spark, "big"), new_scratch_path(spark, "small")
    report = Flow(
        spark,
        [
            Source("orders", table(spark, sf_dir, "orders")),
            Sql("priced", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM {prev}"),
            Sql("big", "SELECT * FROM {prev} WHERE o_totalprice >= 250000"),
            Sql(
                "small",
                "SELECT * FROM {rows} WHERE o_totalprice < 250000",
                inputs={"rows": "priced"},
            ),
        ],
        [
            Target(ReplaceFiles(big), "big", name="big"),
            Target(ReplaceFiles(small), "small", name="small"),
        ],
    ).run(share=share)
    if report.status != "completed":
        raise RuntimeError(report.error)
    return (
        spark.read.parquet(big)
        .withColumn("branch", F.lit("big"))
        .unionByName(spark.read.parquet(small).withColumn("branch", F.lit("small")))
    )


_FAN_OUT = """
    SELECT o_orderkey, o_orderstatus, o_totalprice,
           CASE WHEN o_totalprice >= 250000 THEN 'big' ELSE 'small' END AS branch
    FROM orders
"""


@query(_FAN_OUT)
def fan_out_targets(spark, sf_dir):
    return _fan_out(spark, sf_dir, "persist")


@query(_FAN_OUT)
def fan_out_shared_table(spark, sf_dir):
    return _fan_out(spark, sf_dir, "table")


@query(
    """
    WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders),
    b AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000),
    c AS (SELECT o_orderkey, c_custkey AS o_custkey, o_totalprice, c_name
          FROM b JOIN customer ON o_custkey = c_custkey)
    SELECT * FROM (SELECT 0 AS position, 'orders' AS step, *, NULL AS c_name
                   FROM a ORDER BY o_orderkey LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 1, 'large', *, NULL FROM b ORDER BY o_orderkey LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 2, 'named', * FROM c ORDER BY o_orderkey LIMIT 10)
    """
)
def run_preview(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")

    def named(df):
        return df.join(
            customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey"
        )

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return Flow(
        spark,
        [
            Source("orders", orders),
            Sql("large", "SELECT * FROM {prev} WHERE o_totalprice > 200000"),
            Code("named", named),
        ],
    ).preview_frame(limit=10, order_by="o_orderkey")


@query(
    """
    SELECT CAST(o_orderkey AS BIGINT) AS id, 'order ' || o_orderkey AS label, o_totalprice AS price
    FROM orders WHERE o_orderstatus = 'O'
    """
)
def run_full(spark, sf_dir):
    path = new_scratch_path(spark, "run")
    report = _open_orders(spark, sf_dir, path).run()
    if report.status != "completed":
        raise RuntimeError(report.error)
    return spark.read.parquet(path)


def _open_orders(spark, sf_dir, path):
    return Flow(
        spark,
        [
            Source("orders", table(spark, sf_dir, "orders")),
            Sql(
                "open",
                "SELECT o_orderkey AS id, o_totalprice AS price FROM {prev} "
                "WHERE o_orderstatus = 'O'",
            ),
            Columns(
                "label",
                [
                    {
                        "type": "sql_expression",
                        "config": {"expression": "CONCAT('order ', id)", "output_column": "label"},
                    }
                ],
            ),
        ],
        [Target(ReplaceFiles(path))],
    )


@query(
    """
    SELECT 0 AS position, 'orders' AS step, 'ok' AS status, count(*) AS row_count,
           CAST(6 AS BIGINT) AS col_count FROM orders
    UNION ALL SELECT 1, 'open', 'ok', count(*), 2 FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 2, 'label', 'ok', count(*), 3 FROM orders WHERE o_orderstatus = 'O'
    """
)
def step_metrics(spark, sf_dir):
    flow = _open_orders(spark, sf_dir, new_scratch_path(spark, "metrics"))
    report = flow.run(metrics=True)
    return report.metrics(spark).drop("duration_ms", "message")


class _NeverSwitched:
    """A target that takes all rows and fails when they are to be switched in."""

    def stage(self, df):
        def commit():
            raise RuntimeError("the switch failed")

        return Pending(commit, quick=True)


@query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def replace_survives_failure(spark, sf_dir):
    """The old rows of a replaced target, after the switch of a second target failed."""
    path = new_scratch_path(spark, "survives")
    orders = table(spark, sf_dir, "orders")
    orders.where("o_orderstatus = 'F'").write.parquet(path)
    report = Flow(
        spark,
        [Source("orders", orders), Sql("open", "SELECT * FROM {prev} WHERE o_orderstatus = 'O'")],
        [Target(ReplaceFiles(path), name="first"), Target(_NeverSwitched(), name="second")],
    ).run()
    if report.targets != {"first": "restored", "second": "unchanged"}:
        raise RuntimeError(f"{report}")
    return spark.read.parquet(path)


@query(
    """
    SELECT * FROM (VALUES (0, 'lines', 'ok'), (1, 'kept', 'ok'), (2, 'broken', 'error')) AS t(position, step, status)
    WHERE (SELECT count(*) FROM lineitem) > 0
    """
)
def step_metrics_failed(spark, sf_dir):
    """Steps up to the one that fails, with its state."""
    report = Flow(
        spark,
        [
            Source("lines", table(spark, sf_dir, "lineitem")),
            Sql("kept", "SELECT l_orderkey FROM {prev}"),
            Sql("broken", "SELECT no_such_column FROM {prev}"),
            Sql("never", "SELECT * FROM {prev}"),
        ],
        [Target(DryRun())],
    ).run()
    return report.metrics(spark).select("position", "step", "status")


@query(
    """
    WITH kept AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 0),
    bad AS (SELECT count(*) AS n FROM kept WHERE l_linenumber = 3)
    SELECT 0 AS position, 'lines' AS step, 'ok' AS status, 11::BIGINT AS col_count, NULL AS condition
    UNION ALL SELECT 1, 'kept', 'ok', 3, NULL
    UNION ALL SELECT 2, 'per line', CASE WHEN n > 0 THEN 'error' ELSE 'ok' END, CASE WHEN n > 0 THEN 0 ELSE 4 END,
                     CASE WHEN n > 0 THEN 'DIVIDE_BY_ZERO' END FROM bad
    UNION ALL SELECT 3, 'rounded', 'ok', 5, NULL FROM bad WHERE n = 0
    """
)
def step_metrics_data_error(spark, sf_dir):
    """A value in the rows stops the third of four steps while all of them run as one job."""
    report = Flow(
        spark,
        [
            Source("lines", table(spark, sf_dir, "lineitem")),
            Sql("kept", "SELECT l_orderkey, l_linenumber, l_quantity FROM {prev} WHERE l_quantity > 0"),
            Sql("per line", "SELECT *, l_quantity / (l_linenumber - 3) AS share FROM {prev}"),
            Sql("rounded", "SELECT *, round(share / (l_linenumber + 1), 2) AS half FROM {prev}"),
        ],
        [Target(DryRun())],
    ).run(metrics=True)
    condition = F.when(F.col("message").isNotNull(), F.regexp_extract("message", r"^\[([A-Z_]+)\]", 1))
    return report.metrics(spark).select(
        "position", "step", "status", "col_count", condition.alias("condition")
    )


@query(
    """
    SELECT position, step, status, told FROM (
      SELECT 0 AS position, 'events' AS step, 'ok' AS status, NULL AS told, 0 AS least
      UNION ALL SELECT 1, 'numbered', 'ok', NULL, 0
      UNION ALL SELECT 2, 'parsed', 'error', 'ValueError: a user is there', 1)
    WHERE (SELECT count(*) FROM events WHERE user_id >= 0) >= least
    """
)
def step_metrics_python_error(spark, sf_dir):
    """An exception on the executors leads back to its step."""

    def numbered(part):
        return part.assign(n=part["event_id"] + 1)[["event_id", "user_id", "n"]]

    def parsed(part):
        if (part["user_id"] >= 0).any():
            raise ValueError("a user is there")
        return part

    schema = "event_id bigint, user_id bigint, n bigint"
    report = Flow(
        spark,
        [
            Source("events", table(spark, sf_dir, "events")),
            Code("numbered", batches(numbered, schema)),
            Code("parsed", batches(parsed, schema)),
        ],
        [Target(DryRun())],
    ).run()
    told = F.when(F.col("message").isNotNull(), F.regexp_extract("message", "ValueError: [a-z ]+", 0))
    return report.metrics(spark).select("position", "step", "status", told.alias("told"))


@query(
    """
    SELECT 0::BIGINT AS n_wrong, true AS has_rows, true AS is_part, count(*) AS n_whole FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    """
)
def preview_of_joins(spark, sf_dir):
    """A sample of three sources by their keys has rows, and none that the whole join has not."""
    lines = table(spark, sf_dir, "lineitem")
    flow = Flow(
        spark,
        [
            Source("lines", lines),
            Source("orders", table(spark, sf_dir, "orders")),
            Source("customers", table(spark, sf_dir, "customer")),
            Sql(
                "joined",
                """
                SELECT o.o_orderkey, l.l_linenumber, l.l_shipdate, l.l_extendedprice, c.c_name FROM {lines} l
                JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customers} c ON o.o_custkey = c.c_custkey
                """,
                inputs={"lines": "lines", "orders": "orders", "customers": "customers"},
            ),
        ],
    )
    columns = flow.result().columns
    # the rows of both meet in one shuffle, about a million lines in a task: no task of a join holds groups as well
    parts = max(1, -(-lines.count() // 1_000_000))
    rows = flow.key_sample(0.25).result().select(*columns, F.lit(1).alias("part"), F.lit(0).alias("all")).unionAll(
        flow.result().select(*columns, F.lit(0).alias("part"), F.lit(1).alias("all"))
    )
    both = rows.repartition(parts, *columns).groupBy(columns).agg(F.sum("part").alias("n_part"), F.sum("all").alias("n_all"))
    sampled, n_all = F.coalesce(F.sum("n_part"), F.lit(0)), F.sum("n_all")
    # as in a join on all columns, rows with a null have no partner
    partners = F.when(F.array_contains(F.array(*(F.isnull(c) for c in columns)), True), 0).otherwise(F.col("n_all"))
    return both.agg(
        F.count_if(F.col("n_part") > partners).alias("n_wrong"),
        (sampled > 0).alias("has_rows"),
        (sampled < n_all).alias("is_part"),
        n_all.alias("n_whole"),
    )
