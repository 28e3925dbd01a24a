"""SQL steps: chains, back-references, named inputs, and plain SELECT features."""

from conformance import query, table
from sluiceway.operators.sqlsteps import bind_inputs, run_select, sql_chain
from sluiceway.plans.flow import Flow
from sluiceway.plans.joinkeys import dealt_by_pairs
from sluiceway.plans.steps import Source, Sql


def _select(spark, sf_dir, text, *names):
    """``text`` as a step with each table as an input of its own name."""
    steps = [Source(name, table(spark, sf_dir, name)) for name in names]
    inputs = {name: name for name in names}
    return Flow(spark, [*steps, Sql("result", text, inputs=inputs)]).result()


def _same_text(text, *names):
    """The oracle for ``_select``: the text with the table names put in."""
    return bind_inputs(text, {name: name for name in names})


@query(
    """
    WITH kept AS (SELECT * FROM lineitem WHERE l_quantity > 30)
    SELECT l_returnflag, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity
    FROM kept GROUP BY l_returnflag
    """
)
def sql_chain_two_steps(spark, sf_dir):
    return sql_chain(
        table(spark, sf_dir, "lineitem"),
        [
            ("Large lines!", "SELECT * FROM {prev} WHERE l_quantity > 30 -- no limit"),
            (
                "Totals",
                """
                SELECT l_returnflag, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity
                FROM {prev} GROUP BY l_returnflag
                """,
            ),
        ],
    )


@query(
    """
    SELECT o.o_orderkey, o.o_totalprice, m.top_price
    FROM orders o
    JOIN (SELECT o_custkey, max(o_totalprice) AS top_price FROM orders GROUP BY o_custkey) m
      ON o.o_custkey = m.o_custkey
    WHERE o.o_totalprice < m.top_price / 2
    """
)
def sql_back_reference(spark, sf_dir):
    return sql_chain(
        table(spark, sf_dir, "orders"),
        [
            (
                "Top price",
                "SELECT o_custkey, max(o_totalprice) AS top_price FROM {prev} GROUP BY o_custkey",
            ),
            (
                "Below half",
                """
                SELECT o.o_orderkey, o.o_totalprice, m.top_price
                FROM source_0 o JOIN top_price_1 m ON o.o_custkey = m.o_custkey
                WHERE o.o_totalprice < m.top_price / 2
                """,
            ),
        ],
    )


@query(
    """
    SELECT page_id, url FROM pages WHERE regexp_matches(url, '/[a-z]{2}/[0-9]{1,3}([?]|$)')
    """
)
def sql_other_braces(spark, sf_dir):
    return sql_chain(
        table(spark, sf_dir, "pages"),
        [("Short", "SELECT page_id, url FROM {prev} WHERE url RLIKE '/[a-z]{2}/[0-9]{1,3}([?]|$)'")],
    )


_FILTER = """
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem}
    WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07
      AND l_quantity < 24 AND l_returnflag IN ('A', 'N')
"""


@query(_same_text(_FILTER, "lineitem"))
def sql_filter(spark, sf_dir):
    return _select(spark, sf_dir, _FILTER, "lineitem")


_COMPUTED = """
    SELECT l_orderkey, l_linenumber, l_quantity * 2 AS double_quantity,
           round(l_extendedprice * (1 - l_discount), 4) AS net,
           l_returnflag || '-' || l_linestatus AS flags
    FROM {lineitem}
"""


@query(_same_text(_COMPUTED, "lineitem"))
def sql_computed(spark, sf_dir):
    return _select(spark, sf_dir, _COMPUTED, "lineitem")


_INNER = """
    SELECT c.c_custkey, c.c_name, n.n_name, o.o_orderkey, o.o_totalprice
    FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
    JOIN {nation} n ON c.c_nationkey = n.n_nationkey
    WHERE o.o_orderstatus = 'F'
"""


@query(_same_text(_INNER, "orders", "customer", "nation"))
def sql_join_inner(spark, sf_dir):
    return _select(spark, sf_dir, _INNER, "orders", "customer", "nation")


_LEFT = """
    SELECT c.c_custkey, count(o.o_orderkey) AS n_orders, max(o.o_totalprice) AS top_price
    FROM {left} c LEFT JOIN {right} o
      ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '1-URGENT'
    GROUP BY c.c_custkey
"""


@query(bind_inputs(_LEFT, {"left": "customer", "right": "orders"}))
def sql_join_left(spark, sf_dir):
    return Flow(
        spark,
        [
            Source("people", table(spark, sf_dir, "customer")),
            Source("purchases", table(spark, sf_dir, "orders")),
            Sql("joined", _LEFT, inputs={"left": "people", "right": "purchases"}),
        ],
    ).result()


_FULL = """
    SELECT coalesce(c.nation, s.nation) AS nation, c.n_customers, s.n_suppliers
    FROM (SELECT c_nationkey AS nation, count(*) AS n_customers FROM {customer}
          WHERE c_acctbal > 9000 GROUP BY c_nationkey) c
    FULL JOIN (SELECT s_nationkey AS nation, count(*) AS n_suppliers FROM {supplier}
               WHERE s_acctbal > 5000 GROUP BY s_nationkey) s
      ON c.nation = s.nation
"""


@query(_same_text(_FULL, "customer", "supplier"))
def sql_join_full(spark, sf_dir):
    return _select(spark, sf_dir, _FULL, "customer", "supplier")


_SEMI = """
    SELECT c_custkey, c_name FROM {customer} c
    WHERE EXISTS (SELECT 1 FROM {orders} o
                  WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)
"""


@query(_same_text(_SEMI, "customer", "orders"))
def sql_join_semi(spark, sf_dir):
    return _select(spark, sf_dir, _SEMI, "customer", "orders")


_ANTI = """
    SELECT c_custkey, c_name FROM {customer} c
    WHERE NOT EXISTS (SELECT 1 FROM {orders} o
                      WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')
"""


@query(_same_text(_ANTI, "customer", "orders"))
def sql_join_anti(spark, sf_dir):
    return _select(spark, sf_dir, _ANTI, "customer", "orders")


_THETA = """
    SELECT s.s_suppkey, c.c_custkey, s.s_acctbal, c.c_acctbal
    FROM {supplier} s JOIN {customer} c
      ON s.s_nationkey = c.c_nationkey AND c.c_acctbal > s.s_acctbal
"""


@query(_same_text(_THETA, "supplier", "customer"))
def sql_join_theta(spark, sf_dir):
    supplier, customer = (table(spark, sf_dir, name) for name in ("supplier", "customer"))
    supplier, customer = dealt_by_pairs(
        supplier, "s_nationkey", "s_acctbal", customer, "c_nationkey", "c_acctbal"
    )
    inputs = {"supplier": "supplier", "customer": "customer"}
    steps = [Source("supplier", supplier), Source("customer", customer), Sql("result", _THETA, inputs=inputs)]
    return Flow(spark, steps).result()


_HAVING = """
    SELECT l_suppkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS price,
           min(l_shipdate) AS first_ship
    FROM {lineitem} GROUP BY l_suppkey HAVING sum(l_quantity) > 15000
"""


@query(_same_text(_HAVING, "lineitem"))
def sql_group_having(spark, sf_dir):
    return _select(spark, sf_dir, _HAVING, "lineitem")


_DISTINCT = "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}"


@query(_same_text(_DISTINCT, "lineitem"))
def sql_distinct(spark, sf_dir):
    return _select(spark, sf_dir, _DISTINCT, "lineitem")


_ROLLUP = """
    SELECT l_returnflag, l_linestatus, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity
    FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)
"""


@query(_same_text(_ROLLUP, "lineitem"))
def sql_rollup(spark, sf_dir):
    return _select(spark, sf_dir, _ROLLUP, "lineitem")


_CUBE = """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders
    FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)
"""


@query(_same_text(_CUBE, "orders"))
def sql_cube(spark, sf_dir):
    return _select(spark, sf_dir, _CUBE, "orders")


_RANK = """
    SELECT o_orderkey, o_custkey, CAST(price_rank AS BIGINT) AS price_rank,
           round(running, 2) AS running, previous_price
    FROM (
      SELECT o_orderkey, o_custkey,
             rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS price_rank,
             sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
             lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
               AS previous_price
      FROM {orders}
    ) AS ranked
"""


@query(_same_text(_RANK, "orders"))
def sql_window_rank(spark, sf_dir):
    return _select(spark, sf_dir, _RANK, "orders")


_FIRST = """
    SELECT o_custkey, o_orderkey, o_orderdate FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place
      FROM {orders}) AS numbered
    WHERE place = 1
"""


@query(
    """
    SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate
    FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey
    """
)
def sql_distinct_on(spark, sf_dir):
    return _select(spark, sf_dir, _FIRST, "orders")


_UNION = """
    SELECT c_nationkey AS nation, 'customer' AS kind FROM {customer}
    UNION SELECT s_nationkey, 'supplier' FROM {supplier}
"""


@query(_same_text(_UNION, "customer", "supplier"))
def sql_union_top_level(spark, sf_dir):
    return _select(spark, sf_dir, _UNION, "customer", "supplier")


_SETS = """
    SELECT nation, kind FROM (
      (SELECT c_nationkey AS nation, 'both' AS kind FROM {customer} WHERE c_acctbal > 0
       INTERSECT SELECT s_nationkey, 'both' FROM {supplier} WHERE s_acctbal > 0)
      UNION ALL
      (SELECT c_nationkey, 'only customers' FROM {customer}
       EXCEPT SELECT s_nationkey, 'only customers' FROM {supplier} WHERE s_acctbal > 5000)
    ) AS sets
"""


@query(_same_text(_SETS, "customer", "supplier"))
def sql_setops(spark, sf_dir):
    return _select(spark, sf_dir, _SETS, "customer", "supplier")


_TOPK = """
    SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25
"""


@query(_same_text(_TOPK, "orders"))
def sql_topk(spark, sf_dir):
    return _select(spark, sf_dir, _TOPK, "orders")


@query(
    """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderstatus = 'O' ORDER BY o_totalprice, o_orderkey LIMIT 50
    """
)
def sql_chain_limit(spark, sf_dir):
    return sql_chain(
        table(spark, sf_dir, "orders"),
        [
            ("Open", "SELECT o_orderkey, o_totalprice FROM {prev} WHERE o_orderstatus = 'O'"),
            ("Sorted", "SELECT * FROM {prev} ORDER BY o_totalprice, o_orderkey"),
        ],
        limit=50,
    )


_CASE = """
    SELECT CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle'
                ELSE 'low' END AS band,
           count(*) AS n_orders,
           count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_finished
    FROM {orders} GROUP BY 1
"""


@query(_same_text(_CASE, "orders"))
def sql_case(spark, sf_dir):
    return _select(spark, sf_dir, _CASE, "orders")


_SUBQUERY = """
    WITH totals AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM {orders} GROUP BY o_custkey)
    SELECT o_custkey, round(spent, 2) AS spent FROM totals
    WHERE spent > (SELECT 2 * avg(spent) FROM totals)
       OR o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 9900)
"""


@query(_same_text(_SUBQUERY, "orders", "customer"))
def sql_subquery(spark, sf_dir):
    return _select(spark, sf_dir, _SUBQUERY, "orders", "customer")


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sql_over_tables(spark, sf_dir):
    return run_select(
        spark,
        "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
        {name: table(spark, sf_dir, name) for name in ("nation", "region")},
    )


_GROUPING_SETS = """
    SELECT l_returnflag, l_linestatus, count(*) AS n_lines, sum(l_linenumber) AS numbers
    FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())
"""


@query(_same_text(_GROUPING_SETS, "lineitem"))
def sql_grouping_sets(spark, sf_dir):
    return _select(spark, sf_dir, _GROUPING_SETS, "lineitem")


@query(
    """
    SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n,
           CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS n_positive, embedding[1] AS first
    FROM embeddings
    """
)
def sql_arrays(spark, sf_dir):
    text = """
        SELECT vec_id, size(embedding) AS n, size(filter(embedding, x -> x > 0)) AS n_positive,
               embedding[0] AS first
        FROM {embeddings}
    """
    return _select(spark, sf_dir, text, "embeddings")
