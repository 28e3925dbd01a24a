"""Sinks and incremental runs, read back."""

from pyspark.sql import functions as F

from conformance import query, table
from sluiceway.operators.columns import derived
from sluiceway.operators.contracts import TargetColumn
from sluiceway.operators.sqlsteps import sql_chain
from sluiceway.plans.flow import Flow
from sluiceway.plans.steps import Source, Sql, Target
from sluiceway.session import new_scratch_path
from sluiceway.sinks.base import Folder, write
from sluiceway.sinks.files import (
    AppendFiles,
    AppendTable,
    ReplaceFiles,
    ReplacePartitions,
    ReplaceTable,
    read_files,
)
from sluiceway.streaming.incremental import BatchLedger, NewFiles, run_flow, run_new


@query(
    """
    SELECT c_custkey, c_name, c_mktsegment FROM customer
    UNION ALL SELECT c_custkey, c_name, NULL FROM customer WHERE c_acctbal < 0
    """
)
def sink_append_roundtrip(spark, sf_dir):
    path = new_scratch_path(spark, "append")
    customer = table(spark, sf_dir, "customer")
    write(customer.select("c_custkey", "c_name", "c_mktsegment"), ReplaceFiles(path))
    write(customer.where("c_acctbal < 0").select("c_name", "c_custkey"), AppendFiles(path, fill_missing=True))
    return spark.read.parquet(path)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def sink_replace_roundtrip(spark, sf_dir):
    path = new_scratch_path(spark, "replace")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"
    )
    write(orders.drop("o_orderstatus"), ReplaceFiles(path))
    write(orders.where("o_orderstatus = 'F'").drop("o_orderstatus"), ReplaceFiles(path))
    write(orders.where("o_orderkey < 0").drop("o_orderstatus"), ReplaceFiles(path))  # no rows
    return spark.read.parquet(path)


@query(
    """
    SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0
    UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 5000
    """
)
def sink_table_replace_append(spark, sf_dir):
    path = new_scratch_path(spark, "table")
    name = "supplier_" + path.rsplit("-", 1)[1]
    supplier = table(spark, sf_dir, "supplier")
    supplier.select("s_suppkey", "s_name").write.parquet(path)
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")
    write(supplier.where("s_acctbal > 0").select("s_name", "s_suppkey"), ReplaceTable(name))
    write(supplier.where("s_acctbal > 5000").select("s_name", "s_suppkey"), AppendTable(name))
    return spark.table(name)


@query(
    """
    SELECT event_id, user_id, event_type || '@' || user_id AS label, value
    FROM events WHERE value > 10
    """
)
def incremental_rowwise(spark, sf_dir):
    target, checkpoint = new_scratch_path(spark, "stream"), new_scratch_path(spark, "progress")
    steps = [
        lambda df: sql_chain(
            df, [("Kept", "SELECT event_id, user_id, event_type, value FROM {prev} WHERE value > 10")]
        ),
        derived("CONCAT(event_type, '@', user_id)", "label"),
        lambda df: df.drop("event_type"),
    ]
    source = NewFiles(f"{sf_dir}/events.parquet")
    run_new(spark, source, steps, checkpoint, target)
    run_new(spark, source, steps, checkpoint, target)  # nothing new, nothing added
    return spark.read.parquet(target)


@query(
    """
    SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_totalprice END AS o_totalprice
    FROM orders
    """
)
def sink_partition_replace(spark, sf_dir):
    """Of three partitions one is replaced; the others keep their files."""
    path = new_scratch_path(spark, "partitions")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    write(orders, ReplaceFiles(path, partition_by=["o_orderstatus"]))
    open_ = orders.where("o_orderstatus = 'O'").withColumn("o_totalprice", F.lit(0.0))
    write(open_, ReplacePartitions(path))
    return read_files(spark, path).select(orders.columns)


@query(
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity
    FROM lineitem WHERE l_linenumber < 3 GROUP BY ALL
    """
)
def sink_partitioned_table(spark, sf_dir):
    """A catalog table in partitions, replaced as a whole."""
    path = new_scratch_path(spark, "partitioned")
    name = "lines_" + path.rsplit("-", 1)[1]
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_linenumber", "l_returnflag", "l_linestatus")
    spark.sql(
        f"CREATE TABLE {name} (l_quantity double, l_linenumber int, l_returnflag string, l_linestatus string) "
        f"USING parquet PARTITIONED BY (l_returnflag, l_linestatus) LOCATION '{path}'"
    )
    write(lines, AppendTable(name))
    write(lines.where("l_linenumber < 3"), ReplaceTable(name))
    return spark.table(name).groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    """
    SELECT c_custkey, c_name, c_mktsegment FROM customer
    UNION ALL SELECT c_custkey, c_name, NULL FROM customer WHERE c_acctbal < 0
    """
)
def sink_csv_roundtrip(spark, sf_dir):
    """A CSV target keeps names, types and a column of nulls."""
    path = new_scratch_path(spark, "csv")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    write(customer.withColumn("c_mktsegment", F.lit(None).cast("string")), ReplaceFiles(path, "csv"))
    write(customer, ReplaceFiles(path, "csv"))
    less = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_name", "c_custkey")
    write(less, AppendFiles(path, "csv", fill_missing=True))
    return read_files(spark, path, "csv")


@query(
    """
    SELECT event_id, user_id, event_type, value, 'large' AS size FROM events WHERE value >= 50
    UNION ALL SELECT event_id, user_id, event_type, value, 'small' FROM events WHERE value < 50
    """
)
def incremental_flow(spark, sf_dir):
    """A flow with two targets and a contract on new files; its only batch comes twice and counts once."""
    base = new_scratch_path(spark, "incremental")
    columns = ["event_id", "user_id", "event_type", "value"]
    events = table(spark, sf_dir, "events").select(columns)
    large, small, checkpoint = f"{base}/large", f"{base}/small", f"{base}/progress"
    for path in (large, small):
        events.where("false").write.parquet(path)

    def flow(batch):
        return Flow(
            spark,
            [
                Source("events", batch),
                Sql("named", "SELECT event_id, user_id, event_type, value FROM {prev}"),
                Sql("large", "SELECT * FROM {rows} WHERE value >= 50", inputs={"rows": "named"}),
                Sql("small", "SELECT * FROM {rows} WHERE value < 50", inputs={"rows": "named"}),
            ],
            [
                Target(AppendFiles(large), "large", [TargetColumn("event_id", "bigint", nullable=False)], "large"),
                Target(AppendFiles(small), "small", name="small"),
            ],
        )

    source, ledger = NewFiles(f"{sf_dir}/events.parquet"), BatchLedger(f"{base}/ledger")
    run_flow(spark, source, flow, checkpoint, ledger, check_data=True)
    for name in ("0", ".0.crc"):  # the stream forgets that it ended the batch, as if the driver had been lost
        Folder(spark, f"{checkpoint}/commits/{name}").remove()
    again = run_flow(spark, source, flow, checkpoint, ledger)
    if again.batches[0].targets != {"large": "skipped", "small": "skipped"}:
        raise RuntimeError(f"{again}")
    return (
        spark.read.parquet(large).withColumn("size", F.lit("large"))
        .unionByName(spark.read.parquet(small).withColumn("size", F.lit("small")))
    )
