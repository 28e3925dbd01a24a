"""Sources, samples, the row guard and typed load."""

from pyspark.sql import functions as F

from conformance import query, table
from sluiceway.operators.typed_load import reject_counts, typed_load
from sluiceway.session import new_scratch_path
from sluiceway.sources.tables import read_query, read_table, row_count_report, sample
from sluiceway.sources.text_tables import read_text_table


@query("SELECT * FROM orders")
def source_table(spark, sf_dir):
    return read_table(spark, f"{sf_dir}/orders.parquet")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def source_table_columns(spark, sf_dir):
    return read_table(spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_mktsegment"])


@query(
    """
    SELECT * FROM (
      SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
    ) AS _src ORDER BY o_orderkey LIMIT 100
    """
)
def source_query_limited(spark, sf_dir):
    rows = read_query(
        spark,
        "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
        {"orders": table(spark, sf_dir, "orders")},
    )
    return sample(rows, 100, order_by="o_orderkey")


@query("SELECT * FROM events ORDER BY event_id LIMIT 10")
def sample_ordered(spark, sf_dir):
    return sample(table(spark, sf_dir, "events"), 10, order_by="event_id")


@query(
    """
    SELECT count(*) AS n_rows, CAST(100000 AS BIGINT) AS row_limit,
           count(*) <= 100000 AS within_limit
    FROM lineitem
    """
)
def row_guard_count(spark, sf_dir):
    return row_count_report(table(spark, sf_dir, "lineitem"), 100_000)


# An all-text form of events: user_id is empty for errors, amount holds words.
_EVENT_TYPES = {
    "event_id": "bigint",
    "ts": "timestamp",
    "user_id": " Integer ",
    "event_type": "text",
    "amount": "double precision",
    "props": "integer",
}

_EVENTS_AS_TEXT = """
    SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS ts_value,
           CASE WHEN event_type = 'error' THEN '' ELSE CAST(user_id AS VARCHAR) END AS user_id,
           event_type,
           CASE WHEN event_type = 'purchase' THEN CAST(value AS VARCHAR)
                ELSE event_type END AS amount,
           props
    FROM events
"""


def _events_as_text(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("string").alias("ts"),
        F.when(kind == "error", "").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        "event_type",
        F.when(kind == "purchase", F.col("value").cast("string")).otherwise(kind).alias("amount"),
        "props",
    )


@query(
    f"""
    SELECT TRY_CAST(event_id AS BIGINT) AS event_id, ts_value AS ts,
           TRY_CAST(nullif(user_id, '') AS BIGINT) AS user_id, event_type,
           TRY_CAST(amount AS DOUBLE) AS amount, TRY_CAST(props AS BIGINT) AS props
    FROM ({_EVENTS_AS_TEXT}) AS t
    """
)
def typed_load_rows(spark, sf_dir):
    return typed_load(_events_as_text(spark, sf_dir), _EVENT_TYPES).rows


@query(
    f"""
    SELECT event_id, 'amount' AS "column", 'double precision' AS type, amount AS value
    FROM ({_EVENTS_AS_TEXT}) AS t WHERE amount <> '' AND TRY_CAST(amount AS DOUBLE) IS NULL
    UNION ALL
    SELECT event_id, 'user_id', ' Integer ', user_id
    FROM ({_EVENTS_AS_TEXT}) AS t WHERE user_id <> '' AND TRY_CAST(user_id AS BIGINT) IS NULL
    UNION ALL
    SELECT event_id, 'props', 'integer', props
    FROM ({_EVENTS_AS_TEXT}) AS t WHERE props <> '' AND TRY_CAST(props AS BIGINT) IS NULL
    """
)
def typed_load_rejects(spark, sf_dir):
    return typed_load(_events_as_text(spark, sf_dir), _EVENT_TYPES, key=["event_id"]).rejects


@query(
    f"""
    SELECT 'user_id' AS "column", 'bigint' AS type, count(*) AS n_rows,
           count(*) FILTER (user_id = '') AS n_empty,
           count(*) FILTER (user_id <> '' AND TRY_CAST(user_id AS BIGINT) IS NULL) AS n_rejected
    FROM ({_EVENTS_AS_TEXT}) AS t
    UNION ALL
    SELECT 'amount', 'numeric', count(*), count(*) FILTER (amount = ''),
           count(*) FILTER (amount <> '' AND TRY_CAST(amount AS DOUBLE) IS NULL)
    FROM ({_EVENTS_AS_TEXT}) AS t
    UNION ALL
    SELECT 'event_type', 'text', count(*), count(*) FILTER (event_type = ''), 0
    FROM ({_EVENTS_AS_TEXT}) AS t
    """
)
def typed_load_counts(spark, sf_dir):
    return reject_counts(
        _events_as_text(spark, sf_dir),
        {"user_id": "bigint", "amount": "numeric", "event_type": "text"},
    )


@query(
    f"""
    SELECT TRY_CAST(event_id AS BIGINT) AS event_id, ts_value AS ts,
           TRY_CAST(nullif(user_id, '') AS BIGINT) AS user_id, event_type,
           TRY_CAST(amount AS DOUBLE) AS amount, TRY_CAST(props AS BIGINT) AS props,
           concat_ws('|', CASE WHEN user_id <> '' AND TRY_CAST(user_id AS BIGINT) IS NULL THEN user_id END,
                     CASE WHEN amount <> '' AND TRY_CAST(amount AS DOUBLE) IS NULL THEN amount END,
                     CASE WHEN props <> '' AND TRY_CAST(props AS BIGINT) IS NULL THEN props END) AS refused
    FROM ({_EVENTS_AS_TEXT}) AS t
    """
)
def typed_load_one_pass(spark, sf_dir):
    """All columns, loaded once: the rows and what was refused of them are read from one copy."""
    path = new_scratch_path(spark, "marked")
    typed_load(_events_as_text(spark, sf_dir), _EVENT_TYPES).marked.write.parquet(path)
    written = spark.read.parquet(path)
    return written.select(
        "event_id", "ts", "user_id", "event_type", "amount", "props",
        F.coalesce(F.array_join("_rejects.value", "|"), F.lit("")).alias("refused"),
    )


@query(
    """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
           coalesce(source, '') AS source, CAST(n_chars AS VARCHAR) AS n_chars
    FROM documents
    """
)
def text_table_documents(spark, sf_dir):
    """Whole texts with quotes, commas and line breaks, through a text table and back."""
    path = new_scratch_path(spark, "texts")
    documents = table(spark, sf_dir, "documents")
    documents.select("doc_id", "text", "lang", "source", "n_chars").write.options(
        header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return read_text_table(spark, path, multiline=True)


_FILE_BYTES = 1 << 29  # of texts in one file, as one task writes it; several of Spark's parts when it is read


@query(
    """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
           coalesce(source, '') AS source, CAST(n_chars AS VARCHAR) AS n_chars
    FROM documents
    """
)
def text_table_one_file(spark, sf_dir):
    """As text_table_documents, from one large file that many tasks read, or one for every _FILE_BYTES of texts."""
    path = new_scratch_path(spark, "one-text")
    documents = table(spark, sf_dir, "documents")
    size = documents.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    files = max(1, -(-size // _FILE_BYTES))
    documents.select("doc_id", "text", "lang", "source", "n_chars").repartition(files).write.options(
        header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return read_text_table(spark, path, multiline=True)


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def text_table_typed(spark, sf_dir):
    path = new_scratch_path(spark, "text")
    table(spark, sf_dir, "events").write.option("header", True).option("escape", '"').option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS"
    ).csv(path)
    return typed_load(
        read_text_table(spark, path),
        {
            "event_id": "int8",
            "ts": "timestamp without time zone",
            "user_id": "int8",
            "event_type": "varchar",
            "value": "float8",
            "props": "jsonb",
        },
    ).rows
