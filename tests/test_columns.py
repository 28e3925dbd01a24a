import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings, strategies as st

from sluiceway.functions.expression import call_arguments
from sluiceway.operators.columns import (
    apply_transformations,
    before_after,
    column_mapping,
    derived,
    generated,
)


def mapping(source, target=None, drop=False):
    return {"source_col": source, "target_col": target, "drop": drop}


def expression(df, text, output="out"):
    return [row[output] for row in df.transform(derived(text, output)).collect()]


def test_mapping_renames_and_drops(spark):
    df = spark.createDataFrame([("Alice", 30, "x")], "name string, age int, temp string")
    out = df.transform(
        column_mapping([mapping("name", "full_name"), mapping("age", "age"), mapping("temp", None, True)])
    )
    assert out.columns == ["full_name", "age"]
    assert rows(out) == [("Alice", 30)]


def test_mapping_drops_only(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    out = df.transform(column_mapping([mapping("a", "a"), mapping("b", None, True), mapping("c", "c")]))
    assert out.columns == ["a", "c"] and rows(out) == [(1, 3)]


def test_mapping_order_absent_and_repeated(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, `c.d` int")
    out = df.transform(
        column_mapping(
            [mapping("c.d", "x"), mapping("a", "y"), mapping("nope", "z"), mapping("b", "x"),
             mapping("b", "again"), mapping("a", "lost", True)]
        )
    )
    assert out.columns == ["x", "y", "again"]
    assert rows(out) == [(2, 1, 2)]


def test_mapping_names_are_exact(spark):
    df = spark.createDataFrame([(1,)], "Name int")
    assert df.transform(column_mapping([mapping("name", "x")])).columns == []


def test_upper_lower(spark):
    df = spark.createDataFrame([("alice", 1), ("straße", 2), (None, 3)], "name string, id int")
    assert expression(df, "UPPER(name)") == ["ALICE", "STRASSE", None]
    assert expression(df, "lower(name)") == ["alice", "straße", None]
    assert expression(df, "UPPER(id)") == ["1", "2", "3"]


def test_trim_strips_all_whitespace(spark):
    odd = "".join(chr(i) for i in range(0x3100) if chr(i).isspace())
    texts = [odd + "a b" + odd, "\t\nx\r", "", odd, None, "​z"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert expression(df, "TRIM(s)") == [t if t is None else t.strip() for t in texts]


def test_length_counts_code_points(spark):
    df = spark.createDataFrame([("añ😀",), ("",), (None,)], "s string")
    assert expression(df, "LENGTH(s)") == [3, 0, None]


def test_concat_takes_null_as_empty(spark):
    df = spark.createDataFrame(
        [("Alice", "Smith", 1), (None, "B", 2), (None, None, None)], "first string, last string, n int"
    )
    assert expression(df, "CONCAT(first, ' ', last)") == ["Alice Smith", " B", " "]
    assert expression(df, "CONCAT(first, last, n)") == ["AliceSmith1", "B2", ""]


def test_coalesce(spark):
    df = spark.createDataFrame([(None, 5), ("hello", None), (None, None)], "val string, n int")
    assert expression(df, "COALESCE(val, 'default')") == ["default", "hello", "default"]
    assert expression(df, "COALESCE(n, 'none')") == ["5", "none", "none"]
    out = df.transform(derived("COALESCE(n)", "m"))
    assert out.schema["m"].dataType.simpleString() == "int"


def test_literals_and_unknown_names(spark):
    df = spark.createDataFrame([("v",)], "c string")
    assert expression(df, "CONCAT('a, b', \"c, d\", c, word, 42)") == ["a, bc, dvword42"]
    assert expression(df, "UPPER(TRIM(c))") == ["TRIM(C)"]
    assert expression(df, "UPPER(c, extra)") == ["V"]
    assert expression(df, "  c  ") == ["v"]
    assert expression(df, "unknown") == [None]
    assert expression(df, "c || 'x'") == [None]
    assert expression(df, "UPPER()") == [None]


def test_unsupported_function_is_refused_while_planning(spark):
    df = spark.createDataFrame([("v",)], "c string")
    with pytest.raises(ValueError, match="Unsupported function: SUBSTR"):
        df.transform(derived("substr(c, 1)", "out"))


@pytest.mark.parametrize(
    "text, parts",
    [
        ("a, b", ["a", "b"]),
        ("a,", ["a"]),
        ("a,,b", ["a", "", "b"]),
        ("',', \",\"", ["','", '","']),
        ("'open, b", ["'open, b"]),
        ("'it', \"'\", x", ["'it'", "\"'\"", "x"]),
    ],
)
def test_arguments_split_outside_quotes(text, parts):
    assert call_arguments(text) == parts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab 1_.", min_size=1).filter(str.strip), min_size=1, max_size=5))
def test_plain_arguments_come_back(parts):
    assert call_arguments(",".join(parts)) == [p.strip() for p in parts]


def test_derived_replaces_in_place_or_appends(spark):
    df = spark.createDataFrame([("x", 1)], "a string, b int")
    assert df.transform(derived("UPPER(a)", "a")).columns == ["a", "b"]
    assert rows(df.transform(derived("UPPER(a)", "a"))) == [("X", 1)]
    assert df.transform(derived("b", "c")).columns == ["a", "b", "c"]


def test_fold_in_order(spark):
    df = spark.createDataFrame([("alice", "x", 30)], "name string, temp string, age int")
    steps = [
        {"type": "sql_expression", "order": 2,
         "config": {"expression": "UPPER(name)", "output_column": "name_upper"}},
        {"type": "column_mapping", "order": 1,
         "config": {"mappings": [mapping("name", "name"), mapping("age", "age"), mapping("temp", None, True)]}},
        {"type": "something else", "order": 3, "config": {}},
    ]
    out = apply_transformations(df, steps)
    assert out.columns == ["name", "age", "name_upper"]
    assert rows(out) == [("alice", 30, "ALICE")]


def test_generated_only_when_approved(spark):
    df = spark.createDataFrame([("a",)], "c string")
    assert df.transform(generated("UPPER(c)", "c", False)).collect()[0].c == "a"
    assert df.transform(generated("UPPER(c)", "c", True)).collect()[0].c == "A"


def test_before_after_shows_the_same_rows(spark):
    df = spark.range(1000).selectExpr("id", "cast(id AS string) AS s").repartition(7)
    steps = [{"type": "sql_expression", "config": {"expression": "CONCAT(s, '!')", "output_column": "t"}}]
    for order in (None, "id"):
        before, after = before_after(df, steps, rows=10, order_by=order)
        assert before.count() == 10
        assert rows(before) == [r[:2] for r in rows(after)]
        assert all(r.t == r.s + "!" for r in after.collect())


def _expected(text, row):
    """A row-at-a-time reading of one call, for comparison."""
    name, args = text[:-1].split("(", 1)
    values = [row.get(a.strip(), a.strip()) for a in args.split(",")]
    first = values[0]
    return {
        "UPPER": lambda: None if first is None else str(first).upper(),
        "TRIM": lambda: None if first is None else str(first).strip(),
        "LENGTH": lambda: None if first is None else len(str(first)),
        "CONCAT": lambda: "".join("" if v is None else str(v) for v in values),
        "COALESCE": lambda: next((v for v in values if v is not None), None),
    }[name]()


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.none() | st.text(st.characters(exclude_categories=["Cs"]), max_size=8),
            st.none() | st.text(max_size=3, alphabet="xyz \t"),
        ),
        min_size=1,
        max_size=5,
    )
)
def test_functions_agree_with_python(spark, data):
    df = spark.createDataFrame(data, "a string, b string")
    for text in ("UPPER(a)", "TRIM(a)", "LENGTH(a)", "CONCAT(a, b, z)", "COALESCE(a, b)"):
        want = [_expected(text, {"a": a, "b": b}) for a, b in data]
        assert expression(df, text) == want, text
