import hashlib

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sluiceway.functions.columns import digest, json_text, pattern_group, round_half_even, trunc_to
from sluiceway.operators.codesteps import (
    batches,
    gated,
    group_fold,
    group_relative,
    transform,
    with_group_values,
)
from sluiceway.operators.sqlsteps import StepError
from sluiceway.operators.stability import schema_stability


def test_transform_applies_and_checks_its_result(people):
    loud = people.transform(transform(lambda df: df.withColumn("name", F.upper("name"))))
    assert [r[1] for r in rows(loud)] == ["ALICE", "BOB", "CHARLIE"]
    with pytest.raises(StepError, match="must return a DataFrame"):
        people.transform(transform(lambda df: 7))
    with pytest.raises(StepError, match="must define"):
        transform(None)


def test_batches_run_python_over_rows(people):
    def add(part):
        return part.assign(age=part["age"] + 1)[["id", "age"]]

    assert rows(people.transform(batches(add, "id bigint, age bigint"))) == [(1, 31), (2, 26), (3, 36)]


def test_gated(people):
    step = transform(lambda df: df.limit(1))
    assert people.transform(gated(step, False)).count() == 3
    assert people.transform(gated(step, True)).count() == 1


def skewed(spark):
    """One key holds a third of the rows; some keys are null."""
    return spark.range(3000).selectExpr(
        "id",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('k', id % 97) END AS k",
        "id % 11 AS v",
    )


@pytest.mark.parametrize("large", [1, 5, 10_000])
def test_group_values_match_pandas_for_hot_and_null_keys(spark, large):
    df = skewed(spark)
    out = with_group_values(
        df, ["k"], {"total": F.sum("v"), "n": F.count(F.lit(1))}, large_groups=large
    )
    want = df.toPandas()
    grouped = want.groupby("k", dropna=False)["v"]
    want["total"], want["n"] = grouped.transform("sum"), grouped.transform("size")
    key = want["k"].where(want["k"].notna(), None)
    expected = sorted(zip(want["id"], key, want["v"], want["total"], want["n"]), key=repr)
    assert out.columns == ["id", "k", "v", "total", "n"]
    assert rows(out) == [tuple(r) for r in expected]


def test_group_values_keep_null_results(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1)], "k string, v int")
    out = with_group_values(df, ["k"], {"top": F.max("v")}, large_groups=1)
    assert rows(out) == [("a", None, None), ("a", None, None), ("b", 1, 1)]


def test_group_values_refuse_hidden_columns(people):
    with pytest.raises(StepError, match="hide"):
        with_group_values(people, ["id"], {"age": F.max("age")})


def test_hot_rows_meet_their_values_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "skewed")
    skewed(spark).write.parquet(path)
    df = spark.read.parquet(path)
    out = with_group_values(df, ["k"], {"total": F.sum("v")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    hot = plan.split("Union")[1].split("\n   +- ")[0]
    assert "BroadcastHashJoin" in hot and "TakeOrderedAndProject(limit=10000" in hot
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_group_relative_python(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "k int, v double")

    def center(part):
        return part.assign(off=part["v"] - part["mean"])[["k", "off"]]

    out = df.transform(group_relative(["k"], {"mean": F.avg("v")}, center, "k int, off double"))
    assert rows(out) == [(1, -1.0), (1, 1.0), (2, 0.0)]


@pytest.mark.parametrize("state_rows", [3, 100_000])
def test_group_fold_matches_pandas_in_small_batches(spark, state_rows):
    df = skewed(spark).withColumn("part", F.col("id") % 2).repartition(5)
    keys = ["k", "part"]

    def partial(part):
        return part.groupby(keys, dropna=False)["v"].agg(n="size", top="max").reset_index()

    def merge(states):
        return states.groupby(keys, dropna=False).agg({"n": "sum", "top": "max"}).reset_index()

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = df.transform(
            group_fold(keys, partial, merge, "k string, part bigint, n bigint, top bigint", state_rows)
        )
        got = rows(out)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = rows(df.groupBy(*keys).agg(F.count(F.lit(1)), F.max("v")))
    assert got == want and len(got) > 150
    none = df.where("id < 0").transform(
        group_fold(keys, partial, merge, "k string, part bigint, n bigint, top bigint")
    )
    assert rows(none) == []


def test_digests_match_hashlib(spark):
    df = spark.createDataFrame([("añ",), (None,)], "s string")
    for name in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        got = [r[0] for r in df.select(digest(F.col("s"), name)).collect()]
        assert got == [hashlib.new(name, "añ".encode()).hexdigest(), None]
    with pytest.raises(ValueError):
        digest(F.col("s"), "crc")


def test_column_helpers(spark):
    df = spark.sql("SELECT 'a=12' AS s, '{\"k\": {\"x\": 5}}' AS j, 2.5D AS n, timestamp_ntz'2024-03-05 10:20:30' AS t")
    out = df.select(
        pattern_group(F.col("s"), r"a=(?P<n>\d+)"),
        pattern_group(F.col("s"), r"b=(\d+)"),
        json_text(F.col("j"), "$.k.x"),
        json_text(F.col("s"), "$.k"),
        round_half_even(F.col("n")),
        trunc_to(F.col("t"), "month").cast("string"),
    )
    assert rows(out) == [("12", None, "5", None, 2.0, "2024-03-01 00:00:00")]


def test_schema_stability_finds_a_changing_step(spark):
    df = spark.range(100).repartition(4).selectExpr("id", "id % 4 AS part")

    def steady(part):
        return part.assign(text="x")

    def changing(part):
        low = int(part["id"].min())
        return part.assign(odd=str(low)) if low < 2 else part.assign(odd=low)

    def missing(part):
        return part if part["id"].min() == 0 else part[["id"]]

    assert {r["is_stable"] for r in schema_stability(df, steady).collect()} == {True}
    found = {r["column"]: r for r in schema_stability(df, changing).collect()}
    assert found["id"]["is_stable"] and not found["odd"]["is_stable"]
    assert found["odd"]["types"] == "int64,string"
    lost = {r["column"]: r["is_stable"] for r in schema_stability(df, missing).collect()}
    assert lost == {"id": True, "part": False}
    assert isinstance(steady(pd.DataFrame({"id": [1]})), pd.DataFrame)


def _stability(df, fn):
    from sluiceway.operators.stability import varied_stability

    return {r["column"]: (r["is_stable"], r["shown_by"]) for r in varied_stability(df, fn, samples=3).collect()}


def test_varied_input_shows_what_the_rows_do_not(spark):
    df = spark.range(200).selectExpr("id", "concat('n', id) AS name", "id / 2 AS half")

    def steady(part):
        return part.assign(size=part["name"].str.len().astype("Int64"))

    assert set(_stability(df, steady).values()) == {(True, "")}

    def ascii_only(part):
        [n.encode("ascii") for n in part["name"].dropna()]
        return part

    assert set(_stability(df, ascii_only).values()) == {(False, "non-ASCII")}

    def first(part):
        return part.assign(first=part["id"].iloc[0])

    assert _stability(df, first)["first"] == (False, "no rows")

    def dropped(part):
        return part.dropna(axis=1, how="all") if len(part) else part

    assert _stability(df, dropped)["name"] == (False, "all null")

    def moved(part):
        return part[["name", "id"]] if len(part) == 1 else part[["id", "name"]]

    assert _stability(df, moved)["id"][1].startswith("one row")


def test_edge_batches_fit_every_type(spark):
    schema = (
        "a byte, b short, c int, d long, e float, f double, g decimal(10,2), h date, i timestamp, j timestamp_ntz, "
        "k boolean, l string, m binary, n array<int>, o struct<x:int>, p map<string,int>"
    )
    df = spark.createDataFrame([], schema)
    found = _stability(df, lambda part: part)
    assert len(found) == 16 and {name: how for name, how in found.items() if not how[0]} == {}
