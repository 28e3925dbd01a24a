import pytest
from conftest import rows
from pyspark.errors import AnalysisException

from sluiceway.operators.sqlsteps import (
    StepError,
    bind_inputs,
    relation_name,
    require_select,
    run_select,
    sql_chain,
)


@pytest.mark.parametrize(
    "name, position, wanted",
    [
        ("Lower Emails", 0, "lower_emails_0"),
        ("hash user's PII!", 2, "hash_user_s_pii_2"),
        ("", 5, "step_5"),
        ("   ", 1, "step_1"),
        ("source", 0, "source_0"),
        ("!!!", 3, "_3"),
    ],
)
def test_relation_names(name, position, wanted):
    assert relation_name(name, position) == wanted


def test_long_names_are_cut_to_the_limit():
    name = relation_name("a" * 100, 12)
    assert len(name) == 63 and name.endswith("a_12")


def test_only_known_inputs_are_put_in():
    text = "SELECT '{x}' FROM {left} JOIN {right} WHERE a RLIKE '[a-z]{3}'"
    assert bind_inputs(text, {"left": "l_0", "right": "r_1"}) == (
        "SELECT '{x}' FROM l_0 JOIN r_1 WHERE a RLIKE '[a-z]{3}'"
    )


def test_select_filter_compute(people):
    assert sql_chain(people, [("all", "SELECT * FROM {prev}")]).count() == 3
    assert sql_chain(people, [("old", "SELECT * FROM {prev} WHERE age > 28")]).count() == 2
    doubled = sql_chain(people, [("x", "SELECT name, age * 2 AS double_age FROM {prev}")])
    assert rows(doubled) == [("alice", 60), ("bob", 50), ("charlie", 70)]


def test_chain_and_back_reference(people):
    out = sql_chain(
        people,
        [
            ("lower", "SELECT id, upper(name) AS name FROM {prev}"),
            ("joined", "SELECT p.id, s.name AS old, p.name AS new FROM {prev} p JOIN source_0 s ON p.id = s.id"),
            ("again", "SELECT j.id, l.name FROM joined_2 j JOIN lower_1 l ON l.id = j.id -- end"),
        ],
        limit=2,
    )
    assert out.columns == ["id", "name"] and out.count() == 2


def test_limit_applies_after_the_chain(spark):
    out = sql_chain(spark.range(1000), [("n", "SELECT count(*) AS n FROM {prev}")], limit=10)
    assert rows(out) == [(1000,)]


def test_set_operations_and_ctes_are_accepted(people):
    out = sql_chain(
        people,
        [("u", "WITH x AS (SELECT id FROM {prev}) SELECT id FROM x UNION SELECT id + 10 FROM x")],
    )
    assert out.count() == 6


@pytest.mark.parametrize(
    "text, message",
    [
        ("", "empty"),
        ("  -- only a comment\n", "empty"),
        ("DROP TABLE t", "must be a SELECT statement, got: DROP"),
        ("INSERT INTO t VALUES (1)", "must be a SELECT"),
        ("CREATE TABLE t AS SELECT 1", "must be a SELECT"),
        ("SELECT 1; SELECT 2", "single statement"),
        ("SELECT 1;", "single statement"),
        ("not valid at all", "must be a SELECT"),
        ("SELECT FROM WHERE )", "Invalid SQL expression"),
        ("WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "Invalid SQL expression"),
    ],
)
def test_only_one_select_is_accepted(spark, text, message):
    with pytest.raises(StepError, match=message):
        run_select(spark, text)


def test_refusals_run_nothing(spark, people):
    people.createOrReplaceTempView("kept_view")
    with pytest.raises(StepError):
        run_select(spark, "DROP VIEW kept_view")
    assert spark.table("kept_view").count() == 3
    spark.catalog.dropTempView("kept_view")


def test_leading_comment_and_brackets_pass(spark):
    require_select("/* c */ ( -- d\n SELECT 1)")
    assert rows(run_select(spark, "/* c */ (SELECT 1 AS one)")) == [(1,)]


def test_unknown_column_is_an_analysis_error(people):
    with pytest.raises(AnalysisException, match="UNRESOLVED_COLUMN"):
        sql_chain(people, [("bad", "SELECT nope FROM {prev}")])


def test_no_views_are_left_behind(spark, people):
    before = {t.name for t in spark.catalog.listTables()}
    sql_chain(people, [("a", "SELECT * FROM {prev}")])
    assert {t.name for t in spark.catalog.listTables()} == before


def test_postgres_style_text(people):
    out = sql_chain(people, [("pg", 'SELECT "id"::int AS "n", name || \'!\' AS s FROM {prev} WHERE name ILIKE \'A%\'')])
    assert rows(out) == [(1, "alice!")]


def test_empty_chain(people):
    with pytest.raises(StepError, match="empty"):
        sql_chain(people, [])
