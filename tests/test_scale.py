"""Queries whose tasks must stay small as their tables grow, on rows of their own."""

from datetime import datetime

import pytest

from conformance import tables
from conformance.flows import preview_of_joins
from conformance.sqltext import sql_join_theta
from sluiceway.operators import candidates
from sluiceway.plans import joinkeys

from conftest import rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture
def sold(spark, tmp_path):
    """Lines of 200 orders by 20 customers; 60 lines lack their date."""
    day = datetime(1996, 1, 1)
    lines = [(o, n, day if (o + n) % 10 else None, 1.5 * n) for o in range(200) for n in range(1, 4)]
    written(spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate timestamp, l_extendedprice double"),
            tmp_path, "lineitem")
    written(spark.createDataFrame([(o, o % 20) for o in range(200)], "o_orderkey long, o_custkey long"), tmp_path, "orders")
    written(spark.createDataFrame([(c, f"c{c}") for c in range(20)], "c_custkey long, c_name string"), tmp_path, "customer")
    return str(tmp_path)


def test_a_preview_is_compared_in_one_shuffle_of_bounded_parts(spark, sold):
    found = preview_of_joins(spark, sold)
    assert "FullOuter" not in plan(found) and "REPARTITION_BY_NUM" in plan(found)
    ((n_wrong, has_rows, is_part, n_whole),) = rows(found)
    assert (has_rows, is_part, n_whole) == (True, True, 600)
    assert 0 < n_wrong < 60  # sampled lines without a date, which equal no line


def test_the_exact_count_of_a_key_holds_so_many_rows_in_a_task(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id % 60 AS a", "id div 60 AS b").groupBy("a", "b").count()
    seen = []
    deal = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *by: seen.append(n) or deal(self, n, *by))
    monkeypatch.setattr(candidates, "_TASK_ROWS", 700, raising=False)
    assert rows(candidates.key_candidates(df)) == [("a,b", 2, 3000)]
    assert seen == [5]
    twice = df.unionAll(df.limit(1))
    assert rows(candidates.key_candidates(twice)) == []


def test_large_text_tables_take_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "_FILE_BYTES", 4000, raising=False)
    docs = [(i, f'a "{i}",\nb ' * 20 if i % 7 else None, "en", None, 5) for i in range(100)]
    written(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
            tmp_path, "documents")
    found = tables.text_table_one_file(spark, str(tmp_path))
    assert rows(found) == sorted(((str(i), t or "", "en", "", "5") for i, t, *_ in docs), key=repr)
    size = sum(len(t or "") for _, t, *_ in docs)
    assert len(found.inputFiles()) == -(-size // 4000) > 3


def test_a_theta_join_is_dealt_by_its_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joinkeys, "_TASK_PAIRS", 1000, raising=False)
    customer = [(c, c % 3 if c % 50 else None, float(c % 40)) for c in range(300)]
    supplier = [(s, s % 3, float(s) if s % 9 else None) for s in range(60)]
    written(spark.createDataFrame(customer, "c_custkey long, c_nationkey int, c_acctbal double"), tmp_path, "customer")
    written(spark.createDataFrame(supplier, "s_suppkey long, s_nationkey int, s_acctbal double"), tmp_path, "supplier")
    found = sql_join_theta(spark, str(tmp_path))
    assert rows(found) == sorted(
        ((s, c, b, a) for s, n, b in supplier for c, m, a in customer if n == m and b is not None and a > b), key=repr
    )
    pairs = sum(n == m for _, n, _ in supplier for _, m, _ in customer)
    assert found.rdd.getNumPartitions() == -(-pairs // 1000) > 4


def test_a_theta_join_is_written_in_few_bytes_a_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joinkeys, "_TASK_PAIRS", 400_000)
    customer = [(c * 7919 % 100_003, c % 2, c * 6007 % 10_007 / 8) for c in range(2000)]
    supplier = [(s * 7907 % 100_003, s % 2, s * 6011 % 10_007 / 8) for s in range(2000)]
    written(spark.createDataFrame(customer, "c_custkey long, c_nationkey int, c_acctbal double"), tmp_path, "customer")
    written(spark.createDataFrame(supplier, "s_suppkey long, s_nationkey int, s_acctbal double"), tmp_path, "supplier")
    written(sql_join_theta(spark, str(tmp_path)), tmp_path, "found")
    n_rows = spark.read.parquet(f"{tmp_path}/found.parquet").count()
    assert n_rows == sum(n == m and a > b for _, n, b in supplier for _, m, a in customer)
    assert sum(f.stat().st_size for f in (tmp_path / "found.parquet").glob("*.parquet")) < n_rows


def test_tiles_hold_each_pair_once_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(joinkeys, "_TASK_PAIRS", 500)
    monkeypatch.setattr(joinkeys, "_BLOCK_ROWS", 8, raising=False)
    nan = float("nan")
    # one value has most rows, some rows come twice or have no partner, keys or values are null
    less = [(i % 90, i % 4 if i % 11 else None, (1.0, None, nan, -0.0, float(i))[i % 5 if i % 3 else 0]) for i in range(120)]
    more = [(i % 150, i % 5 if i % 13 else None, (1.0, 0.0, nan, None, float(i))[i % 5 if i % 2 else 0]) for i in range(200)]
    a = spark.createDataFrame(less, "id long, `k.y` int, v double")
    b = spark.createDataFrame(more, "id long, key long, v double")
    pairs = lambda a, b: rows(
        a.alias("a").join(b.alias("b"), (a["`k.y`"] == b["key"]) & (a["v"] < b["v"])).selectExpr("a.id", "b.id", "a.v", "b.v")
    )
    in_tiles = joinkeys.dealt_by_pairs(a, "k.y", "v", b, "key", "v")
    assert repr(pairs(*in_tiles)) == repr(pairs(a, b))
    for side, key in zip(in_tiles, ("`k.y`", "key"), strict=True):
        sizes = [n for _, n in rows(side.groupBy(key).count())]
        assert len(sizes) > 20 and max(sizes) <= 8
