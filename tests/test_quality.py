import pytest
from conftest import rows
from pyspark.sql import functions as F

from sluiceway.functions.search import subsequence_match, subsequence_pattern
from sluiceway.operators.contracts import (
    Status,
    TargetColumn,
    contract_checks,
    declared_columns,
    full_checks,
    missing_columns,
    name_findings,
    schema_findings,
)
from sluiceway.operators.keys import (
    discover_references,
    duplicate_keys,
    key_check,
    orphans,
    reference_check,
)
from sluiceway.operators.profile import table_profile


def test_missing_columns_are_reported_with_the_expected_type():
    found = missing_columns(["id", "extra"], [TargetColumn("id", "int4"), TargetColumn("email", "text")])
    assert [(c.rule, c.column, c.expected, c.actual) for c in found] == [
        ("missing_column", "email", "text", None)
    ]
    assert found[0].message == "Column 'email' not found in pipeline output"


def test_nullable_and_default_columns_are_still_required():
    contract = [TargetColumn("a", "int4", nullable=True), TargetColumn("b", "int4", default="0")]
    assert len(missing_columns([], contract)) == 2


def test_names():
    assert name_findings(["a", "b"])[0].status is Status.PASSED
    assert [c.message for c in name_findings(["a", "a", " "])] == [
        "Empty column name(s) at positions: [2]",
        "Duplicate column names: ['a']",
    ]
    assert name_findings([])[0].status is Status.WARNING


def test_critical_failure_stops(users):
    contract = [TargetColumn("nope", "text"), TargetColumn("id", "text", nullable=False)]
    assert [c.rule for c in schema_findings(users, contract, stop_at_critical=True)] == ["missing_column"]
    stopped = contract_checks(users, contract, stop_at_critical=True)
    assert [r["rule"] for r in stopped.collect()] == ["missing_column"]
    assert "not_null" in [r["rule"] for r in contract_checks(users, contract).collect()]


def test_a_frame_meets_its_own_contract(users):
    assert missing_columns(users.columns, declared_columns(users)) == []
    assert [c.type for c in declared_columns(users)] == ["int4", "text", "text"]


def test_types_and_nulls_in_one_pass(spark):
    df = spark.createDataFrame([("1", None), ("x", 2), (None, None)], "n string, m int")
    contract = [TargetColumn("n", "bigint"), TargetColumn("m", "int4", nullable=False)]
    got = {(r["rule"], r["column"]): (r["status"], r["violations"]) for r in contract_checks(df, contract).collect()}
    assert got[("type_mismatch", "n")] == ("failed", 1)
    assert got[("not_null", "m")] == ("failed", 2)
    assert got[("type_mismatch", "m")] == ("passed", 0)
    strict = {(r["rule"], r["column"]): r["status"] for r in contract_checks(df, contract, strict=True).collect()}
    assert strict[("type_mismatch", "n")] == "failed" and strict[("type_mismatch", "m")] == "failed"


def test_types_without_any_cast_count_every_value(spark):
    df = spark.createDataFrame([([1],), (None,)], "a array<int>")
    row = contract_checks(df, [TargetColumn("a", "bigint")]).where("rule = 'type_mismatch'").first()
    assert (row["status"], row["violations"]) == ("failed", 1)


def test_contract_checks_are_one_job_over_the_data(spark):
    df = spark.range(10).selectExpr("id", "cast(id AS string) s", "id k")
    contract = [TargetColumn(n, "integer", nullable=False) for n in ("id", "s", "k")]
    plan = contract_checks(df, contract)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Range") == 1


def test_empty_frame_without_columns(spark):
    empty = spark.range(3).select()
    got = contract_checks(empty, [TargetColumn("a", "text")]).collect()
    assert [(r["rule"], r["status"]) for r in got] == [
        ("missing_column", "failed"), ("schema_compatibility", "warning"),
    ]


def test_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "c"), (1, "a")], "k int, s string")
    assert rows(key_check(df, ["k"])) == [("k", 5, 1, 2, 1, 2, False)]
    assert rows(key_check(df, ["k", "s"])) == [("k,s", 5, 2, 2, 1, 1, False)]
    assert rows(duplicate_keys(df, ["k"])) == [(1, 3)]
    assert rows(key_check(df.where("s = 'b'"), ["k"])) == [("k", 1, 0, 1, 0, 0, True)]
    assert rows(key_check(df.where("k = 9"), ["k"])) == [("k", 0, 0, 0, 0, 0, True)]


def test_references(spark):
    parent = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x")], "id bigint, t string")
    child = spark.createDataFrame([(1, "x")] * 5 + [(3, "x"), (3, "x"), (None, "x"), (2, None)], "ref int, t string")
    assert rows(reference_check(child, ["ref"], parent, ["id"])) == [
        ("ref->id", 9, 1, 3, 1, 2, round(2 / 3, 6), False)
    ]
    assert rows(orphans(child, ["ref"], parent, ["id"])) == [(3, 2)]
    assert rows(reference_check(child, ["ref", "t"], parent, ["id", "t"], "pair")) == [
        ("pair", 9, 2, 2, 1, 2, 0.5, False)
    ]
    with pytest.raises(ValueError):
        reference_check(child, ["ref"], parent, ["id", "t"])


def test_reference_counting_and_join_share_one_shuffle_each(spark, tmp_path):
    spark.range(1000).selectExpr("id % 10 AS ref").write.parquet(str(tmp_path / "c"))
    spark.range(10).write.parquet(str(tmp_path / "p"))
    child, parent = spark.read.parquet(str(tmp_path / "c")), spark.read.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = orphans(child, ["ref"], parent, ["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
    assert "partial_count" in plan


def test_discovery_over_more_columns_than_one_mask_holds(spark):
    many = spark.range(3).select(*[(F.col("id") + i % 2).alias(f"c{i}") for i in range(70)])
    found = discover_references({"t": many})
    assert found.count() == 70 * 69
    pair = {(r["child_column"], r["parent_column"]): (r["contained_values"], r["holds"]) for r in found.collect()}
    assert pair[("c0", "c68")] == (3, True)
    assert pair[("c69", "c0")] == (2, False)


def test_discovery_keeps_types_apart_and_shows_disjoint_pairs(spark):
    a = spark.createDataFrame([(1, "1"), (2, "2")], "n int, s string")
    b = spark.createDataFrame([(7,), (8,)], "m bigint")
    got = {(r["child_column"], r["parent_column"], r["contained_values"]) for r in discover_references({"a": a, "b": b}, all_pairs=True).collect()}
    assert got == {("n", "m", 0), ("m", "n", 0)}
    assert discover_references({"a": a, "b": b}).count() == 0
    with pytest.raises(ValueError):
        discover_references({"a": a}, {"a": []})


def test_profile(spark):
    long_a, long_b = "x" * 500 + "a", "x" * 500 + "b"
    df = spark.createDataFrame(
        [(1, long_a, [1.0], None), (2, long_b, [2.0], None), (3, long_a, None, None)],
        "id int, s string, v array<double>, z string",
    ).withColumn("m", F.create_map(F.lit("k"), F.col("id")))
    got = {r["column"]: r for r in table_profile(df).collect()}
    assert [got[c]["position"] for c in df.columns] == [1, 2, 3, 4, 5]
    assert (got["id"]["n_distinct"], got["id"]["is_key"], got["id"]["min_value"], got["id"]["max_value"]) == (3, True, "1", "3")
    assert (got["s"]["n_distinct"], got["s"]["is_unique"], got["s"]["max_value"]) == (2, False, long_b)
    assert (got["v"]["n_null"], got["v"]["is_unique"], got["v"]["is_key"], got["v"]["category"]) == (1, True, False, "array")
    assert (got["z"]["n_null"], got["z"]["n_distinct"], got["z"]["has_null"], got["z"]["min_value"]) == (3, 0, True, None)
    assert (got["m"]["category"], got["m"]["n_distinct"]) == ("json", None)
    assert [r["column"] for r in table_profile(df, ["s"]).collect()] == ["s"]
    approx = {r["column"]: r for r in table_profile(df, distinct="approx").collect()}
    assert approx["id"]["n_distinct"] == 3 and approx["id"]["is_key"] is None
    with pytest.raises(ValueError):
        table_profile(df, distinct="maybe")


def test_full_checks(spark, users):
    orders = spark.createDataFrame([(1, 1, 9.5), (2, 5, None), (2, 1, 9.5)], "id int, user_id int, amount double")
    contract = [
        TargetColumn("id", "int4", nullable=False, is_primary_key=True),
        TargetColumn("user_id", "int4", foreign_key="users.id"),
        TargetColumn("amount", "numeric", nullable=False, is_unique=True),
    ]
    got = {(r["rule"], r["column"]): r["violations"] for r in full_checks(orders, contract, {"users": users}).collect()}
    assert got[("primary_key", "id")] == 1
    assert got[("foreign_key", "user_id")] == 1
    assert got[("unique", "amount")] == 1
    assert got[("not_null", "amount")] == 1


def brute_force(text, query):
    position = 0
    for char in query.lower():
        position = text.lower().find(char, position) + 1
        if position == 0:
            return False
    return True


@pytest.mark.parametrize("query", ["", "ab", "BA", "a.b", "[^]", "a-&&", "\\", "ñ", "  ", "{2}", "#~|"])
def test_ordered_subsequence(spark, query):
    texts = ["", "ab", "ba", "a\nxB", "a.b", "x[y^z]w", "a-&q&", "back\\slash", "AÑO", " - ", "{2}", "#a~b|"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r["s"] for r in df.where(subsequence_match(F.col("s"), query)).collect()]
    assert got == [t for t in texts if brute_force(t, query)]


def test_pattern_never_goes_back():
    assert subsequence_pattern("aB") == "^[^a]*+a[^b]*+b"


def test_distinct_counts_of_every_kind_match_spark(spark):
    df = spark.sql(
        """
        SELECT id % 7 AS whole, cast(id % 5 AS tinyint) AS small,
               CASE id % 4 WHEN 0 THEN 0.0D WHEN 1 THEN -0.0D WHEN 2 THEN double('NaN') END AS real,
               cast(id % 3 AS decimal(9, 2)) AS dec, id % 2 = 0 AS flag,
               date_add(date'2024-01-01', cast(id % 6 AS int)) AS day,
               timestamp_micros(id % 8) AS instant, timestamp_ntz'2024-01-01' AS plain,
               array(concat('a, ', id % 2), 'b') AS list, named_struct('x', id % 3, 'y', nullif(id % 2, 1)) AS pair,
               array(if(id % 2 = 0, 'a', 'a, b'), if(id % 2 = 0, 'b, c', 'c')) AS tricky,
               unhex(hex(id % 9)) AS raw, repeat(chr(97 + cast(id % 4 AS int)), 300) AS long_text,
               cast(NULL AS int) AS nothing
        FROM range(500)
        """
    )
    want = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first().asDict()
    got = {r["column"]: r["n_distinct"] for r in table_profile(df).collect()}
    assert got == want


def test_profile_carries_single_values_through_its_shuffles(spark):
    df = spark.range(100).select(*[(F.col("id") % i).alias(f"c{i}") for i in range(1, 41)])
    plan = table_profile(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "hashpartitioning(site" in plan


# -- keys and references that nobody declared ------------------------------------------------------


def _keys(df, **options):
    from sluiceway.operators.candidates import key_candidates

    return sorted(r["key_columns"] for r in key_candidates(df, **options).collect())


def test_minimal_keys_are_found_level_by_level(spark):
    df = spark.range(3000).selectExpr(
        "id % 30 AS a", "id div 30 AS b", "cast(id % 7 AS string) AS c", "cast(id AS double) AS d", "nullif(id, 5) AS gap",
    )
    assert _keys(df) == ["a,b"]
    assert _keys(df, max_width=1) == []
    assert _keys(df, columns=["a", "b", "d"]) == ["a,b", "d"]
    assert _keys(df.unionAll(df.limit(1))) == []
    assert _keys(df.limit(0)) == [] and _keys(df.limit(1)) == ["a", "b", "c", "gap"]
    with pytest.raises(ValueError, match="nope"):
        _keys(df, columns=["nope"])


def test_a_key_of_three_columns_beside_nearly_unique_ones(spark):
    df = spark.range(8000).selectExpr("id % 20 AS x", "id div 20 % 20 AS y", "id div 400 AS z", "CASE WHEN id = 1 THEN 0 ELSE id END AS nearly")
    assert _keys(df) == ["x,nearly", "x,y,z"]


def test_key_sets_agree_with_brute_force(spark):
    import random
    from itertools import combinations

    rng = random.Random(3)
    for _ in range(4):
        data = [tuple(rng.randrange(k) for k in (3, 6, 9, 12)) for _ in range(25)]
        names = "abcd"
        expected = []
        for width in (1, 2, 3):
            for s in combinations(range(4), width):
                if len({tuple(r[i] for i in s) for r in data}) == len(data) and not any(set(k) <= set(s) for k in expected):
                    expected.append(s)
        found = _keys(spark.createDataFrame(data, "a int, b int, c int, d int"))
        assert found == sorted(",".join(names[i] for i in s) for s in expected)


def test_sketches_rule_out_pairs_but_no_reference(spark):
    from sluiceway.operators.candidates import column_sketches, possible_inclusions

    wide = spark.range(60_000).selectExpr("id", "id * 3 AS triple", "id + 50000 AS shifted", "id % 900 AS small")
    part = spark.range(20_000).selectExpr("id * 2 AS even", "id - 100 AS below")
    forms = {0: F.col("id"), 1: F.col("triple"), 2: F.col("shifted"), 3: F.col("small")}
    sketches = column_sketches(wide, forms).unionAll(column_sketches(part, {4: F.col("even"), 5: F.col("below")}))
    possible = possible_inclusions(sketches, ["integer"] * 6, 0.9)
    assert {(3, 0), (4, 0), (5, 0)} <= possible  # what holds, or holds to 99.5 %
    assert not {(0, 1), (1, 0), (0, 2), (2, 0), (0, 4)} & possible
    found = discover_references({"wide": wide, "part": part}, min_inclusion=0.9)
    pairs = {(r["child_column"], r["parent_column"]): r["inclusion"] for r in found.collect()}
    assert pairs == {("small", "id"): 1.0, ("even", "id"): 1.0, ("below", "id"): 0.995, ("small", "below"): 1.0}
    none = discover_references({"a": wide.select("id"), "b": part.selectExpr("cast(even AS string) AS e")}, min_inclusion=0.5)
    assert none.collect() == []
    with pytest.raises(ValueError, match="either"):
        discover_references({"a": wide}, all_pairs=True, min_inclusion=0.5)


def test_values_beyond_the_shared_type_have_no_parent(spark):
    child = spark.createDataFrame([(1.0,), (1e25,), (1e25,), (None,), (2.5,), (float("nan"),)], "v double")
    parent = spark.createDataFrame([(1,), (2,)], "k bigint")
    found = orphans(child, ["v"], parent, ["k"]).collect()
    assert sorted(map(repr, ((r["v"], r["n_rows"]) for r in found))) == ["(1e+25, 2)", "(2.5, 1)", "(nan, 1)"]
    told = reference_check(child, ["v"], parent, ["k"]).first()
    assert (told["total_rows"], told["null_rows"], told["orphan_rows"], told["orphan_values"]) == (6, 1, 4, 3)
    back = orphans(parent, ["k"], child, ["v"]).collect()
    assert [(int(r["k"]), r["n_rows"]) for r in back] == [(2, 1)]
