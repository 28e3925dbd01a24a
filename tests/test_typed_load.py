import pytest
from conftest import rows
from pyspark.sql import types as T

from sluiceway.functions.types import CATEGORIES, canonical_type, catalog_name, category, spark_type
from sluiceway.operators.typed_load import reject_counts, typed_load


def test_categories():
    for wanted, names in CATEGORIES.items():
        assert all(category(name) == wanted for name in names)
    assert category("_anything") == "array"
    for name in ("", "point", "INT4"):
        assert category(name) == "unknown"


def test_a_numeric_wider_than_a_decimal_is_refused():
    with pytest.raises(ValueError, match="38 digits"):
        spark_type("numeric(50,2)")


@pytest.mark.parametrize(
    "name, canonical, kind",
    [
        ("integer", "int64", T.LongType()),
        (" BIGINT ", "int64", T.LongType()),
        ("smallint", "int32", T.IntegerType()),
        ("real", "float32", T.FloatType()),
        ("numeric", "float64", T.DoubleType()),
        ("numeric(10, 2)", "utf8", T.DecimalType(10, 2)),
        ("decimal(5)", "utf8", T.DecimalType(5, 0)),
        ("character varying", "utf8", T.StringType()),
        ("uuid", "utf8", T.StringType()),
        ("interval", "utf8", T.StringType()),
        ("_int4", "utf8", T.StringType()),
        ("boolean", "boolean", T.BooleanType()),
        ("timestamp", "timestamp", T.TimestampNTZType()),
        ("timestamp with time zone", "timestamp", T.TimestampType()),
        ("timestamp(6)", "utf8", T.TimestampNTZType()),
        ("timestamp(3) with time zone", "utf8", T.TimestampType()),
        ("float(8)", "utf8", T.FloatType()),
        ("float(53)", "utf8", T.DoubleType()),
        ("date", "date", T.DateType()),
        ("time", "time", T.StringType()),
        ("bytea", "binary", T.BinaryType()),
    ],
)
def test_types(name, canonical, kind):
    assert canonical_type(name) == canonical
    assert spark_type(name) == kind


def test_catalog_names():
    assert catalog_name(T.ArrayType(T.FloatType())) == "_float4"
    assert catalog_name(T.TimestampNTZType()) == "timestamp"
    assert catalog_name(T.DecimalType(10, 2)) == "numeric"
    assert catalog_name(T.StructType()) == "json"


TEXT = "id string, n string, ok string, at string, day string, t string, raw string, note string"
TYPES = {
    "id": "integer", "n": "numeric(6,2)", "ok": "bool", "at": "timestamp", "day": "date",
    "t": "time", "raw": "bytea", "note": "text",
}


def test_values_and_rejects(spark):
    df = spark.createDataFrame(
        [
            ("1", " 12.50 ", "t", "2024-01-02 03:04:05.5", "2024-01-02", "09:30", "\\x4869", " kept "),
            ("2", "", "f", None, "", "23:59:59.25", "Hi", ""),
            ("x", "1e9", "maybe", "yesterday", "2024-13-01", "24:00", "\\xzz", None),
        ],
        TEXT,
    )
    loaded = typed_load(df, TYPES, key=["id"])
    got = [tuple(r) for r in loaded.rows.collect()]
    assert [str(v) for v in got[0][:5]] == ["1", "12.50", "True", "2024-01-02 03:04:05.500000", "2024-01-02"]
    assert got[0][5:] == ("09:30:00.000000", bytearray(b"Hi"), " kept ")
    assert got[1] == (2, None, False, None, None, "23:59:59.250000", bytearray(b"Hi"), "")
    assert got[2] == (None,) * 8
    assert rows(loaded.rejects) == sorted(
        [
            ("x", "id", "integer", "x"),
            ("x", "n", "numeric(6,2)", "1e9"),
            ("x", "ok", "bool", "maybe"),
            ("x", "at", "timestamp", "yesterday"),
            ("x", "day", "date", "2024-13-01"),
            ("x", "t", "time", "24:00"),
            ("x", "raw", "bytea", "\\xzz"),
        ],
        key=repr,
    )


def test_fractions_and_ranges_are_not_cut_silently(spark):
    df = spark.createDataFrame([("12.5",), ("99999999999",), ("7",)], "n string")
    loaded = typed_load(df, {"n": "smallint"})
    assert [r[0] for r in loaded.rows.collect()] == [None, None, 7]
    assert [r["value"] for r in loaded.rejects.collect()] == ["12.5", "99999999999"]


def test_untyped_columns_stay_and_text_never_fails(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    loaded = typed_load(df, {"x": "text", "missing": "int"})
    assert rows(loaded.rows) == [("a", "b")]
    assert loaded.rejects.columns == ["column", "type", "value"] and loaded.rejects.count() == 0


def test_marked_rows_carry_their_rejects(spark):
    df = spark.createDataFrame([("1", "x"), ("a", "2"), ("b", "c")], "n string, m string")
    marked = typed_load(df, {"n": "int", "m": "int"}).marked
    assert [(r["n"], r["m"], [(x["column"], x["value"]) for x in r["_rejects"]]) for r in marked.collect()] == [
        (1, None, [("m", "x")]),
        (None, 2, [("n", "a")]),
        (None, None, [("n", "b"), ("m", "c")]),
    ]


def test_reject_counts(spark):
    df = spark.createDataFrame([("1", "x"), ("", "y"), ("z", None)], "n string, s string")
    assert rows(reject_counts(df, {"n": "int", "s": "text"})) == [
        ("n", "int", 3, 1, 1),
        ("s", "text", 3, 1, 0),
    ]


@pytest.mark.parametrize(
    "type_name, good, bad",
    [
        ("integer", {"7": 7, "+7": 7, "-0": 0}, ["7.0", "1e3", "0x1", "7 8", "9" * 30]),
        ("float8", {"1e5": 1e5, ".5": 0.5, "5.": 5.0, "-Infinity": float("-inf")}, ["1.0d", "0x1p3", "e5", "."]),
        ("numeric(5,1)", {"12.5": 12.5, "1e2": 100.0}, ["NaN", "123456"]),
        ("boolean", {"t": True, "YES": True, "on": True, "0": False, "off": False}, ["2", "tr", "null"]),
        ("date", {"2024-02-29": "2024-02-29"}, ["2024", "2024-02", "2023-02-29", "2024-02-03 10:00:00"]),
        ("timestamp", {"2024-01-02": "2024-01-02 00:00:00", "2024-01-02T03:04:05": "2024-01-02 03:04:05"}, ["03:04", "2024-01-02 25:00:00", "2024-01-02x"]),
        ("timestamptz", {"2024-01-02 03:04:05+00": "2024-01-02 03:04:05", "2024-01-02 03:04:05-08": "2024-01-02 11:04:05"}, ["now"]),
    ],
)
def test_text_forms(spark, type_name, good, bad):
    texts = [*good, *bad]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").coalesce(1)
    loaded = typed_load(df, {"s": type_name}, key=["i"])
    shown = loaded.rows.orderBy("i")
    if type_name in ("date", "timestamp", "timestamptz"):
        shown = shown.select(shown.s.cast("string"))
    got = [r["s"] for r in shown.collect()]
    assert [float(v) if type_name.startswith("num") and v is not None else v for v in got] == [
        *good.values(), *[None] * len(bad)
    ]
    assert [r["value"] for r in loaded.rejects.orderBy("i").collect()] == bad


def test_times_with_digits_or_written_out_are_times(spark):
    df = spark.createDataFrame([("25:99", "25:99", "x1", "2.5"), ("07:30", "07:30:01.5", "23:59", "x")], "a string, b string, c string, d string")
    types = {"a": "time(3)", "b": "time without time zone", "c": "TIME (0) WITHOUT TIME ZONE", "d": "float"}
    load = typed_load(df, types)
    assert sorted((r["column"], r["value"]) for r in load.rejects.collect()) == [
        ("a", "25:99"), ("b", "25:99"), ("c", "x1"), ("d", "x")
    ]
    assert dict(load.rows.dtypes)["d"] == "double"
    assert [r["b"] for r in load.rows.collect()] == [None, "07:30:01.500000"]
