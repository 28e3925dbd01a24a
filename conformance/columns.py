"""Column mappings, derived columns and name search."""

from pyspark.sql import functions as F

from conformance import query, table
from sluiceway.functions.search import subsequence_match
from sluiceway.operators.columns import (
    apply_transformations,
    before_after,
    column_mapping,
    derived,
)


def _keep(source, target=None):
    return {"source_col": source, "target_col": target or source, "drop": False}


def _drop(source):
    return {"source_col": source, "target_col": None, "drop": True}


@query("SELECT c_custkey AS id, c_name AS full_name, c_acctbal AS balance FROM customer")
def map_rename_drop(spark, sf_dir):
    mappings = [
        _keep("c_custkey", "id"),
        _keep("c_name", "full_name"),
        _keep("c_acctbal", "balance"),
        _drop("c_mktsegment"),
        _keep("not_there", "missing"),
    ]
    return table(spark, sf_dir, "customer").transform(column_mapping(mappings))


@query("SELECT p_brand AS brand, p_partkey, p_brand AS brand_again FROM part")
def map_reorder_duplicate_source(spark, sf_dir):
    mappings = [
        _keep("p_name", "brand"),  # the later mapping to "brand" wins, in this place
        _keep("p_partkey"),
        _keep("p_brand", "brand_again"),
        _keep("p_brand", "brand"),
    ]
    return table(spark, sf_dir, "part").transform(column_mapping(mappings))


@query("SELECT p_partkey, upper(p_name) AS name_upper FROM part")
def derive_upper(spark, sf_dir):
    return (
        table(spark, sf_dir, "part")
        .select("p_partkey", "p_name")
        .transform(derived("UPPER(p_name)", "name_upper"))
        .drop("p_name")
    )


@query("SELECT doc_id, lower(text) AS text_lower FROM documents")
def derive_lower(spark, sf_dir):
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "text")
        .transform(derived("lower(text)", "text_lower"))
        .drop("text")
    )


# the characters Python strips, for DuckDB's trim
_SPACE_CODES = (
    "9,10,11,12,13,28,29,30,31,32,133,160,5760,8192,8193,8194,8195,8196,8197,8198,"
    "8199,8200,8201,8202,8232,8233,8239,8287,12288"
)
_SPACES = " || ".join(f"chr({code})" for code in _SPACE_CODES.split(","))


@query(
    f"""
    SELECT doc_id, trim(chr(9) || ' ' || text || chr(10) || chr(12288), {_SPACES}) AS trimmed
    FROM documents
    """
)
def derive_trim(spark, sf_dir):
    padded = F.concat(F.lit("\t "), F.col("text"), F.lit("\n　"))
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", padded.alias("padded"))
        .transform(derived("TRIM(padded)", "trimmed"))
        .drop("padded")
    )


@query(
    """
    SELECT page_id, CAST(length(html) AS INTEGER) AS html_length,
           CAST(length(CAST(page_id AS VARCHAR)) AS INTEGER) AS id_length
    FROM pages
    """
)
def derive_length(spark, sf_dir):
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", "html")
        .transform(derived("LENGTH(html)", "html_length"))
        .transform(derived("LENGTH(page_id)", "id_length"))
        .drop("html")
    )


@query(
    """
    SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '') || ', ' || c_name AS label
    FROM customer
    """
)
def derive_concat_null_as_empty(spark, sf_dir):
    return (
        table(spark, sf_dir, "customer")
        .select(
            "c_custkey",
            "c_name",
            F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"),
        )
        .transform(derived("CONCAT(segment, ', ', c_name)", "label"))
        .select("c_custkey", "label")
    )


@query(
    """
    SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment,
           coalesce(CAST(nullif(c_nationkey, 3) AS VARCHAR), c_mktsegment) AS place
    FROM customer
    """
)
def derive_coalesce_literal(spark, sf_dir):
    return (
        table(spark, sf_dir, "customer")
        .select(
            "c_custkey",
            "c_mktsegment",
            F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"),
            F.nullif(F.col("c_nationkey"), F.lit(3)).alias("place"),
        )
        .transform(derived("COALESCE(segment, 'none')", "segment"))
        .transform(derived("COALESCE(place, c_mktsegment)", "place"))
        .drop("c_mktsegment")
    )


@query(
    """
    SELECT p_partkey, p_brand, p_brand AS brand_copy, CAST(NULL AS VARCHAR) AS nothing
    FROM part
    """
)
def derive_copy_and_unknown(spark, sf_dir):
    return (
        table(spark, sf_dir, "part")
        .select("p_partkey", "p_brand")
        .transform(derived(" p_brand ", "brand_copy"))
        .transform(derived("no_such_column", "nothing"))
    )


@query("SELECT * REPLACE (lower(p_brand) AS p_brand) FROM part")
def derive_replace_in_place(spark, sf_dir):
    return table(spark, sf_dir, "part").transform(derived("LOWER(p_brand)", "p_brand"))


@query(
    """
    SELECT p_partkey, 'a, b: ' || p_brand || ' size ' || CAST(p_size AS VARCHAR) || ' 42 word'
             AS label,
           'TRIM(P_BRAND)' AS not_nested
    FROM part
    """
)
def derive_literals(spark, sf_dir):
    return (
        table(spark, sf_dir, "part")
        .select("p_partkey", "p_brand", "p_size")
        .transform(
            derived("""CONCAT('a, b: ', p_brand, " size ", p_size, ' ', 42, ' ', word)""", "label")
        )
        .transform(derived("UPPER(TRIM(p_brand))", "not_nested"))
        .drop("p_brand", "p_size")
    )


_FOLD = [
    {
        "order": 2,
        "type": "sql_expression",
        "config": {"expression": "UPPER(name)", "output_column": "name_upper"},
    },
    {
        "order": 1,
        "type": "column_mapping",
        "config": {"mappings": [_keep("c_custkey", "id"), _keep("c_name", "name"), _drop("c_acctbal")]},
    },
    {"order": 3, "type": "not_known", "config": {}},
    {
        "order": 4,
        "type": "sql_expression",
        "config": {"expression": "CONCAT(id, '/', name_upper)", "output_column": "path"},
    },
]


@query(
    """
    SELECT id, name, name_upper, CAST(id AS VARCHAR) || '/' || name_upper AS path FROM (
      SELECT c_custkey AS id, c_name AS name, upper(c_name) AS name_upper FROM customer) AS t
    """
)
def fold_transformations(spark, sf_dir):
    return apply_transformations(table(spark, sf_dir, "customer"), _FOLD)


@query("SELECT c_custkey, c_name, lower(c_mktsegment) AS segment FROM customer")
def generated_gated(spark, sf_dir):
    def record(expression, output, approved):
        config = {
            "generated_expression": expression,
            "output_column": output,
            "approved": approved,
        }
        return {"type": "ai_generated", "config": config}

    return apply_transformations(
        table(spark, sf_dir, "customer"),
        [
            record("LOWER(c_mktsegment)", "segment", True),
            record("UPPER(c_name)", "c_name", False),
            {
                "type": "column_mapping",
                "config": {"mappings": [_keep("c_custkey"), _keep("c_name"), _keep("segment")]},
            },
        ],
    )


@query(
    """
    WITH s AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 20)
    SELECT 'before' AS side, c_custkey, c_name, CAST(NULL AS VARCHAR) AS label FROM s
    UNION ALL
    SELECT 'after', c_custkey, c_name, c_name || '!' FROM s
    """
)
def before_after_sample(spark, sf_dir):
    source = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    steps = [
        {
            "type": "sql_expression",
            "config": {"expression": "CONCAT(c_name, '!')", "output_column": "label"},
        }
    ]
    before, after = before_after(source, steps, rows=20, order_by="c_custkey")
    return before.withColumn("side", F.lit("before")).unionByName(
        after.withColumn("side", F.lit("after")), allowMissingColumns=True
    )


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '(?s)l.*b.*t')")
def name_search(spark, sf_dir):
    return (
        table(spark, sf_dir, "part")
        .where(subsequence_match(F.col("p_name"), "LbT"))
        .select("p_partkey", "p_name")
    )


@query(
    """
    SELECT doc_id FROM documents
    WHERE regexp_matches(lower(text), '(?s)q.*z.*\\.')
    """
)
def name_search_long_text(spark, sf_dir):
    return (
        table(spark, sf_dir, "documents")
        .where(subsequence_match(F.col("text"), "QZ."))
        .select("doc_id")
    )
