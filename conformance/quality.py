"""Contracts, keys, references and profiles."""

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from conformance import query, table
from sluiceway.operators.candidates import key_candidates
from sluiceway.operators.contracts import TargetColumn, contract_checks, full_checks
from sluiceway.operators.keys import (
    discover_references,
    duplicate_keys,
    key_check,
    orphans,
    reference_check,
)
from sluiceway.operators.profile import table_profile
from sluiceway.plans.flow import Flow
from sluiceway.plans.steps import Source, Target
from sluiceway.session import new_scratch_path
from sluiceway.sinks.files import ReplaceFiles


@query(
    """
    SELECT rule, "column", status, expected, actual,
           CASE WHEN rule = 'not_null' THEN (SELECT count(*) FROM customer WHERE c_acctbal < 0)
           END AS violations,
           CASE WHEN rule = 'not_null'
             THEN 'balance: ' || (SELECT count(*) FROM customer WHERE c_acctbal < 0) || ' nulls'
             ELSE message END AS message
    FROM (VALUES
      ('missing_column', 'email', 'failed', 'text', NULL,
       'Column ''email'' not found in pipeline output'),
      ('missing_column', 'created_at', 'failed', 'timestamptz', NULL,
       'Column ''created_at'' not found in pipeline output'),
      ('column_name_check', NULL, 'passed', NULL, NULL, 'All column names valid and unique'),
      ('not_null', 'balance', 'failed', 'float8', 'double', NULL)
    ) AS t(rule, "column", status, expected, actual, message)
    """
)
def contract_missing_columns(spark, sf_dir):
    output = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        "c_name",
    )
    return contract_checks(
        output,
        [
            TargetColumn("id", "int8"),
            TargetColumn("email", "text"),
            TargetColumn("created_at", "timestamptz", default="now()"),
            TargetColumn("balance", "float8", nullable=False),
        ],
    )


@query(
    """
    SELECT 'column_name_check' AS rule, CAST(NULL AS VARCHAR) AS "column", 'failed' AS status,
           CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS actual,
           CAST(NULL AS BIGINT) AS violations,
           'Duplicate column names: [''n_name'']' AS message
    UNION ALL
    SELECT 'column_name_check', NULL, 'failed', NULL, NULL, NULL,
           'Empty column name(s) at positions: [2]'
    UNION ALL
    SELECT 'not_null', 'n_nationkey', 'passed', 'int4', 'int',
           (SELECT count(*) FROM nation WHERE n_nationkey IS NULL), 'n_nationkey: ok'
    UNION ALL
    SELECT 'type_mismatch', 'n_nationkey', 'passed', 'int4', 'int', 0, 'n_nationkey: ok'
    """
)
def contract_names(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    output = nation.select(
        "n_nationkey", "n_name", F.lit("x").alias(" "), F.upper("n_name").alias("n_name")
    )
    return contract_checks(output, [TargetColumn("n_nationkey", "int4", nullable=False)])


@query(
    """
    WITH o AS (
      SELECT o_orderkey, nullif(o_custkey, 7) AS customer, o_orderpriority,
             CAST(o_totalprice AS VARCHAR) || CASE WHEN o_orderstatus = 'P' THEN '?' ELSE '' END
               AS price
      FROM orders),
    counts AS (
      SELECT count(*) FILTER (customer IS NULL) AS no_customer,
             count(*) FILTER (price LIKE '%?') AS bad_price, count(*) AS n FROM o)
    SELECT 'column_name_check' AS rule, NULL AS "column", 'passed' AS status,
           CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS actual, CAST(NULL AS BIGINT) AS violations,
           'All column names valid and unique' AS message
    UNION ALL SELECT 'not_null', 'key', 'passed', 'bigint', 'bigint', 0, 'key: ok'
    UNION ALL SELECT 'not_null', 'customer', 'failed', 'bigint', 'bigint', no_customer,
           'customer: ' || no_customer || ' nulls' FROM counts
    UNION ALL SELECT 'type_mismatch', 'price', 'failed', 'numeric', 'string', bad_price,
           'price: ' || bad_price || ' values do not convert' FROM counts
    UNION ALL SELECT 'type_mismatch', 'priority', 'failed', 'integer', 'string', n,
           'priority: ' || n || ' values do not convert' FROM counts
    """
)
def contract_types_nulls(spark, sf_dir):
    bad_mark = F.when(F.col("o_orderstatus") == "P", "?").otherwise("")
    output = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.nullif(F.col("o_custkey"), F.lit(7)).alias("customer"),
        F.concat(F.col("o_totalprice").cast("string"), bad_mark).alias("price"),
        F.col("o_orderpriority").alias("priority"),
    )
    return contract_checks(
        output,
        [
            TargetColumn("key", "bigint", nullable=False),
            TargetColumn("customer", "bigint", nullable=False),
            TargetColumn("price", "numeric"),
            TargetColumn("priority", "integer"),
        ],
    )


@query(
    """
    SELECT 'column_name_check' AS rule, NULL AS "column", 'passed' AS status,
           CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS actual, CAST(NULL AS BIGINT) AS violations,
           'All column names valid and unique' AS message
    UNION ALL SELECT 'primary_key', 'o_orderkey', 'passed', NULL, NULL,
           count(*) - count(DISTINCT o_orderkey), 'o_orderkey: ok' FROM orders
    UNION ALL SELECT 'unique', 'o_totalprice',
           CASE WHEN count(*) > count(DISTINCT o_totalprice) THEN 'failed' ELSE 'passed' END,
           NULL, NULL, count(*) - count(DISTINCT o_totalprice),
           CASE WHEN count(*) > count(DISTINCT o_totalprice)
             THEN 'o_totalprice: ' || (count(*) - count(DISTINCT o_totalprice))
                  || ' rows break the key'
             ELSE 'o_totalprice: ok' END FROM orders
    UNION ALL SELECT 'foreign_key', 'o_custkey', 'failed', NULL, NULL, count(*),
           'o_custkey: ' || count(*) || ' rows without a parent in customer.c_custkey'
           FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    """
)
def contract_keys_references(spark, sf_dir):
    output = table(spark, sf_dir, "orders")
    in_credit = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return full_checks(
        output,
        [
            TargetColumn("o_orderkey", "int8", is_primary_key=True),
            TargetColumn("o_totalprice", "float8", is_unique=True),
            TargetColumn("o_custkey", "int8", foreign_key="customer.c_custkey"),
        ],
        {"customer": in_credit},
    )


@query(
    """
    SELECT rule, "column", status, expected, actual, violations, message FROM (VALUES
      ('column_name_check', NULL, 'passed', NULL, NULL, CAST(NULL AS BIGINT),
       'All column names valid and unique'),
      ('type_mismatch', 'p_size', 'failed', 'text', 'int', NULL, 'p_size: expected text, got int')
    ) AS t(rule, "column", status, expected, actual, violations, message)
    UNION ALL
    SELECT 'not_null', 'p_name', 'failed', 'text', 'string', count(*),
           'p_name: ' || count(*) || ' nulls' FROM part WHERE p_brand = 'Brand#1'
    """
)
def contract_strict(spark, sf_dir):
    output = table(spark, sf_dir, "part").select(
        F.when(F.col("p_brand") != "Brand#1", F.col("p_name")).alias("p_name"),
        "p_size",
        "p_retailprice",
    )
    return contract_checks(
        output,
        [
            TargetColumn("p_name", "text", nullable=False),
            TargetColumn("p_size", "text"),
            TargetColumn("p_retailprice", "float8"),
        ],
        strict=True,
    )


@query(
    """
    SELECT key_columns, total_rows, null_rows, distinct_keys, duplicated_keys, surplus_rows,
           null_rows = 0 AND duplicated_keys = 0 AS is_key
    FROM (
      SELECT 'l_orderkey,l_linenumber' AS key_columns, CAST(sum(n) AS BIGINT) AS total_rows,
             CAST(0 AS BIGINT) AS null_rows, count(*) AS distinct_keys,
             count(*) FILTER (n > 1) AS duplicated_keys, CAST(sum(n - 1) AS BIGINT) AS surplus_rows
      FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) AS g
      UNION ALL
      SELECT 'o_orderkey', CAST(sum(n) AS BIGINT), 0, count(*), count(*) FILTER (n > 1),
             CAST(sum(n - 1) AS BIGINT)
      FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1) AS g
      UNION ALL
      SELECT 'priority', CAST(sum(n) AS BIGINT), CAST(sum(n) FILTER (p IS NULL) AS BIGINT),
             count(p), count(*) FILTER (p IS NOT NULL AND n > 1),
             CAST(sum(n - 1) FILTER (p IS NOT NULL) AS BIGINT)
      FROM (SELECT nullif(o_orderpriority, '5-LOW') AS p, count(*) AS n
            FROM orders GROUP BY 1) AS g
    ) AS checks
    """
)
def key_check_tables(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    priority = orders.select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    checks = [
        key_check(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]),
        key_check(orders, ["o_orderkey"]),
        key_check(priority, ["priority"]),
    ]
    return reduce(DataFrame.unionAll, checks)


@query(
    """
    SELECT l_orderkey, l_linenumber, count(*) AS n_rows
    FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    """
)
def key_duplicates(spark, sf_dir):
    return duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_REFERENCE = """
    SELECT '{name}' AS reference, count(*) AS total_rows,
           count(*) FILTER (child IS NULL) AS null_rows,
           count(DISTINCT child) AS distinct_values,
           count(DISTINCT child) FILTER (parent IS NULL) AS orphan_values,
           count(child) FILTER (parent IS NULL) AS orphan_rows,
           round(1 - count(DISTINCT child) FILTER (parent IS NULL) / count(DISTINCT child), 6)
             AS inclusion,
           count(child) FILTER (parent IS NULL) = 0 AS holds
    FROM (SELECT {child} AS child, p.parent FROM {child_table}
          LEFT JOIN (SELECT DISTINCT {parent} AS parent FROM {parent_table}) p
            ON {child} = p.parent) AS joined
"""


def _reference(name, child, child_table, parent, parent_table):
    return _REFERENCE.format(
        name=name, child=child, child_table=child_table, parent=parent, parent_table=parent_table
    )


@query(
    " UNION ALL ".join(
        [
            _reference("lines", "l_orderkey", "lineitem", "o_orderkey", "orders"),
            _reference("buyers", "nullif(o_custkey, 5)", "orders", "c_custkey", "customer"),
            _reference(
                "open orders", "l_orderkey", "lineitem", "o_orderkey",
                "(SELECT * FROM orders WHERE o_orderstatus <> 'F')",
            ),
            _reference("places", "c_nationkey", "customer", "n_nationkey", "nation"),
        ]
    )
)
def reference_check_tables(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    buyers = orders.select(F.nullif(F.col("o_custkey"), F.lit(5)).alias("buyer"))
    open_orders = orders.where("o_orderstatus <> 'F'")
    checks = [
        reference_check(lines, ["l_orderkey"], orders, ["o_orderkey"], "lines"),
        reference_check(buyers, ["buyer"], customer, ["c_custkey"], "buyers"),
        reference_check(lines, ["l_orderkey"], open_orders, ["o_orderkey"], "open orders"),
        reference_check(customer, ["c_nationkey"], nation, ["n_nationkey"], "places"),
    ]
    return reduce(DataFrame.unionAll, checks)


@query(
    """
    SELECT l_orderkey, count(*) AS n_rows FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
    GROUP BY l_orderkey
    """
)
def reference_orphans(spark, sf_dir):
    open_orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return orphans(table(spark, sf_dir, "lineitem"), ["l_orderkey"], open_orders, ["o_orderkey"])


_SITES = [
    ("lineitem", "l_orderkey"),
    ("lineitem", "l_suppkey"),
    ("orders", "o_orderkey"),
    ("orders", "o_custkey"),
    ("customer", "c_custkey"),
    ("customer", "c_nationkey"),
    ("supplier", "s_suppkey"),
    ("nation", "n_nationkey"),
]


def _pair_sql(child, parent):
    (ct, cc), (pt, pc) = child, parent
    return f"""
        SELECT '{ct}' AS child_table, '{cc}' AS child_column, '{pt}' AS parent_table,
               '{pc}' AS parent_column, count(*) AS distinct_values,
               count(p.v) AS contained_values, round(count(p.v) / count(*), 6) AS inclusion,
               count(p.v) = count(*) AS holds
        FROM (SELECT DISTINCT {cc} AS v FROM {ct}) c
        LEFT JOIN (SELECT DISTINCT {pc} AS v FROM {pt}) p ON c.v = p.v
    """


@query(
    " UNION ALL ".join(
        _pair_sql(child, parent) for child in _SITES for parent in _SITES if child != parent
    )
)
def reference_discovery(spark, sf_dir):
    columns = {}
    for name, column in _SITES:
        columns.setdefault(name, []).append(column)
    tables = {name: table(spark, sf_dir, name) for name in columns}
    return discover_references(tables, columns, all_pairs=True)


@query(
    " UNION ALL ".join(
        f"SELECT * FROM ({_pair_sql(child, parent)}) WHERE contained_values > 0"
        for child in _SITES for parent in _SITES if child != parent
    )
)
def reference_discovery_shared(spark, sf_dir):
    columns = {}
    for name, column in _SITES:
        columns.setdefault(name, []).append(column)
    return discover_references({name: table(spark, sf_dir, name) for name in columns}, columns)


_ALL_SITES = {
    "integer": [
        *(("lineitem", c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")),
        ("orders", "o_orderkey"), ("orders", "o_custkey"), ("customer", "c_custkey"), ("customer", "c_nationkey"),
        ("supplier", "s_suppkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"),
    ],
    "text": [
        ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("orders", "o_orderstatus"),
        ("orders", "o_orderpriority"), ("customer", "c_name"), ("customer", "c_mktsegment"), ("supplier", "s_name"),
        ("nation", "n_name"),
    ],
    "time": [("lineitem", "l_shipdate"), ("orders", "o_orderdate")],
}


@query(
    " UNION ALL ".join(
        f"SELECT * FROM ({_pair_sql(child, parent)}) WHERE contained_values >= 0.9 * distinct_values"
        for sites in _ALL_SITES.values() for child in sites for parent in sites if child != parent
    )
)
def reference_discovery_all(spark, sf_dir):
    """All columns of whole numbers, text and time of five tables."""
    names = ("lineitem", "orders", "customer", "supplier", "nation")
    return discover_references({name: table(spark, sf_dir, name) for name in names}, min_inclusion=0.9)


def _keys_sql(source, columns, width=3):
    """Minimal unique sets of columns that are never null, level by level."""
    sets = [s for k in range(1, width + 1) for s in combinations(columns, k)]
    counted = ", ".join(
        f"count(DISTINCT ({', '.join(s)})) = count(*) AND {' AND '.join(f'count({c}) = count(*)' for c in s)} AS u{i}"
        for i, s in enumerate(sets)
    )
    told = " UNION ALL ".join(
        f"SELECT '{','.join(s)}' AS key_columns, {len(s)} AS width, n AS n_rows FROM u WHERE n > 0 AND u{i}"
        + "".join(f" AND NOT u{j}" for j, smaller in enumerate(sets) if set(smaller) < set(s))
        for i, s in enumerate(sets)
    )
    return f"WITH u AS (SELECT count(*) AS n, {counted} FROM {source}) {told}"


_LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]
_SUPPLIED = """(SELECT l_partkey, l_suppkey, count(*) AS n_lines, max(l_linenumber) AS last, min(l_returnflag) AS flag
                FROM lineitem GROUP BY l_partkey, l_suppkey)"""
_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]


@query(_keys_sql("lineitem", _LINES))
def key_candidates_lines(spark, sf_dir):
    """No single column of the lines is a key; the sets that are one, up to three columns."""
    return key_candidates(table(spark, sf_dir, "lineitem"))


@query(_keys_sql(_SUPPLIED, ["l_partkey", "l_suppkey", "n_lines", "last", "flag"]))
def key_candidates_pairs(spark, sf_dir):
    """A table whose key has two columns."""
    supplied = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.count("*").alias("n_lines"), F.max("l_linenumber").alias("last"), F.min("l_returnflag").alias("flag")
    )
    return key_candidates(supplied)


@query(
    _keys_sql("orders", _ORDERS)
    + " UNION ALL " + "SELECT * FROM (" + _keys_sql("(SELECT *, nullif(s_suppkey, 3) AS gap FROM supplier)", ["s_suppkey", "s_name", "s_nationkey", "gap"]) + ")"
)
def key_candidates_single(spark, sf_dir):
    """Tables without repeats: single columns, and never one with a null."""
    supplier = table(spark, sf_dir, "supplier").withColumn("gap", F.nullif(F.col("s_suppkey"), F.lit(3).cast("bigint")))
    return key_candidates(table(spark, sf_dir, "orders")).unionAll(key_candidates(supplier))


@query(
    """
    SELECT child, count(*) AS n_rows FROM (
      SELECT CASE WHEN o_orderkey % 5 = 0 THEN 1e25 + o_orderkey % 2 * 1e24 ELSE o_orderkey % 40 END AS child FROM orders)
    WHERE child NOT IN (SELECT n_nationkey::DOUBLE FROM nation) GROUP BY child
    """
)
def reference_large_fractions(spark, sf_dir):
    """Values beyond any whole number beside whole-number parents: they have none."""
    key = F.col("o_orderkey")
    child = table(spark, sf_dir, "orders").select(
        F.when(key % 5 == 0, F.lit(1e25) + (key % 2) * F.lit(1e24)).otherwise((key % 40).cast("double")).alias("child")
    )
    parent = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"))
    return orphans(child, ["child"], parent, ["key"])


@query(
    """
    SELECT CAST(o_orderkey % 7 AS VARCHAR) AS child, count(*) AS n_rows
    FROM orders WHERE o_orderkey % 7 NOT IN (SELECT n_nationkey + 0.5 * (n_nationkey % 2) FROM nation)
    GROUP BY o_orderkey % 7
    """
)
def reference_mixed_types(spark, sf_dir):
    """A whole-number child beside a parent with fractions: 1.5 is no parent of 1."""
    child = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7).cast("int").alias("child"))
    key = F.col("n_nationkey")
    parent = table(spark, sf_dir, "nation").select((key + 0.5 * (key % 2)).cast("double").alias("key"))
    found = orphans(child, ["child"], parent, ["key"])
    return found.select(F.col("child").cast("int").cast("string").alias("child"), "n_rows")


@query(
    """
    SELECT 'column_name_check' AS rule, NULL AS "column", 'passed' AS status,
           CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS actual, CAST(NULL AS BIGINT) AS violations,
           'All column names valid and unique' AS message
    UNION ALL
    SELECT 'type_mismatch', 'p_retailprice', CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END, 'integer', 'double', n,
           CASE WHEN n > 0 THEN 'p_retailprice: ' || n || ' values do not convert' ELSE 'p_retailprice: ok' END
    FROM (SELECT count(*) FILTER (p_retailprice <> floor(p_retailprice)) AS n FROM part)
    UNION ALL
    SELECT 'type_mismatch', 'p_size', 'warning', 'numeric(50,2)', 'int', NULL,
           'p_size: not compared, numeric(50,2) has more than the 38 digits of a decimal'
    """
)
def contract_lossy(spark, sf_dir):
    """Prices that lose their fraction do not convert; a type too wide to have is told."""
    contract = [TargetColumn("p_retailprice", "integer"), TargetColumn("p_size", "numeric(50,2)")]
    return contract_checks(table(spark, sf_dir, "part").select("p_retailprice", "p_size"), contract)


@query(
    """
    SELECT 'lacking' AS run, 'failed' AS status,
           'Column ''c_acctbal'' not found in pipeline output' AS error, count(*) AS rows_held
    FROM customer WHERE c_acctbal >= 0
    UNION ALL
    SELECT 'unfit', 'failed',
           'c_acctbal: ' || (SELECT count(*) FROM customer WHERE c_acctbal < 0) || ' values do not convert', count(*)
    FROM customer WHERE c_acctbal >= 0
    UNION ALL
    SELECT 'whole', 'completed', NULL, count(*) FROM customer WHERE c_acctbal < 0
    """
)
def contract_from_target(spark, sf_dir):
    """Runs into a table that declares nothing but its own columns, and what it holds after each."""
    path = new_scratch_path(spark, "held")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    customer.where("c_acctbal >= 0").write.parquet(path)
    marked = F.concat(F.col("c_acctbal").cast("string"), F.when(F.col("c_acctbal") < 0, "?").otherwise(""))
    told = []
    for name, rows in (
        ("lacking", customer.drop("c_acctbal")),
        ("unfit", customer.withColumn("c_acctbal", marked)),
        ("whole", customer.where("c_acctbal < 0")),
    ):
        report = Flow(spark, [Source("rows", rows)], [Target(ReplaceFiles(path))]).run(check_data=True)
        told.append((name, report.status, report.error, spark.read.parquet(path).count()))
    return spark.createDataFrame(told, "run string, status string, error string, rows_held bigint")


def _profile_sql(table_name, position, column, type_name, kind, as_text=None):
    shown = as_text or "CAST({} AS VARCHAR)"
    low, high = (shown.format(f"{f}({column})") for f in ("min", "max"))
    return f"""
        SELECT {position} AS position, '{column}' AS "column", '{type_name}' AS type,
               '{kind}' AS category, count(*) AS n_rows, count(*) - count({column}) AS n_null,
               count(DISTINCT {column}) AS n_distinct, {low} AS min_value, {high} AS max_value,
               count(*) > count({column}) AS has_null,
               count(DISTINCT {column}) = count({column}) AS is_unique,
               count(DISTINCT {column}) = count(*) AS is_key
        FROM {table_name}
    """


@query(
    " UNION ALL ".join(
        [
            _profile_sql("customer", 1, "c_custkey", "int8", "number"),
            _profile_sql("customer", 2, "c_name", "text", "text"),
            _profile_sql("customer", 3, "c_nationkey", "int4", "number"),
            _profile_sql("customer", 4, "c_acctbal", "float8", "number"),
            _profile_sql("customer", 5, "c_mktsegment", "text", "text"),
        ]
    )
)
def profile_customer(spark, sf_dir):
    return table_profile(table(spark, sf_dir, "customer"))


@query(
    " UNION ALL ".join(
        [
            _profile_sql("documents", 1, "doc_id", "int8", "number"),
            _profile_sql("documents", 2, "text", "text", "text"),
            _profile_sql("documents", 3, "lang", "text", "text"),
            _profile_sql("documents", 4, "source", "text", "text"),
            _profile_sql("documents", 5, "n_chars", "int8", "number"),
        ]
    )
)
def profile_documents(spark, sf_dir):
    return table_profile(table(spark, sf_dir, "documents"))


@query(
    """
    SELECT position, "column", type, category, n_rows, n_null, n_null > 0 AS has_null,
           true AS close FROM (
    """
    + " UNION ALL ".join(
        f"""
        SELECT {i} AS position, '{name}' AS "column", '{kind}' AS type, '{group}' AS category,
               count(*) AS n_rows, count(*) FILTER ({absent}) AS n_null FROM lineitem
        """
        for i, (name, kind, group, absent) in enumerate(
            [
                ("l_orderkey", "int8", "number", "l_orderkey IS NULL"),
                ("l_partkey", "int8", "number", "l_partkey IS NULL"),
                ("l_suppkey", "int8", "number", "l_suppkey IS NULL"),
                ("l_linenumber", "int4", "number", "l_linenumber IS NULL"),
                ("l_quantity", "float8", "number", "l_quantity IS NULL"),
                ("l_extendedprice", "float8", "number", "l_extendedprice IS NULL"),
                ("l_discount", "float8", "number", "l_discount IS NULL"),
                ("l_tax", "float8", "number", "l_tax IS NULL"),
                ("l_returnflag", "text", "text", "l_returnflag = 'N'"),
                ("l_linestatus", "text", "text", "l_linestatus IS NULL"),
                ("l_shipdate", "timestamp", "datetime", "l_shipdate IS NULL"),
            ],
            start=1,
        )
    )
    + ") AS t"
)
def profile_approximate(spark, sf_dir):
    """Every column; ``close`` tells that the estimate is within 5 % of the exact count."""
    flag = F.nullif(F.col("l_returnflag"), F.lit("N"))
    lines = table(spark, sf_dir, "lineitem").withColumn("l_returnflag", flag)
    exact = table_profile(lines).select("position", F.col("n_distinct").alias("n_exact"))
    close = F.abs(F.col("n_distinct") - F.col("n_exact")) <= 0.05 * F.col("n_exact")
    return (
        table_profile(lines, distinct="approx", relative_error=0.01)
        .join(exact, "position")
        .select(
            "position", "column", "type", "category", "n_rows", "n_null", "has_null",
            close.alias("close"),
        )
    )
