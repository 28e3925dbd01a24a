import pytest
from conftest import rows

from sluiceway.operators.sqlsteps import StepError
from sluiceway.session import new_scratch_path, scratch_root
from sluiceway.sinks.database import AppendDatabase, ReplaceDatabase, writer_options
from sluiceway.sources.database import Database, Ranges, reader_options
from sluiceway.sources.tables import (
    RowLimitExceeded,
    guard_row_count,
    read_query,
    read_table,
    row_count_report,
    sample,
)
from sluiceway.session import shuffle_settings
from sluiceway.sources.text_tables import read_text_table


def test_shuffles_start_with_parts_for_their_bytes():
    def parts(*given, **named):
        return list(shuffle_settings(*given, **named).values())

    assert parts("local[4]") == []
    assert parts("local[4]", 4) == parts("yarn", 4, largest_shuffle=10**14) == ["4"]
    assert parts("yarn") == ["10000"]
    assert parts("yarn", largest_shuffle=100 << 40) == ["102400"]
    assert parts("yarn", largest_shuffle=1) == ["200"]


def test_tables_by_path_and_by_name(spark, users, tmp_path):
    path = str(tmp_path / "users")
    users.write.parquet(path)
    assert rows(read_table(spark, path)) == rows(users)
    assert read_table(spark, path, ["email", "id"]).columns == ["email", "id"]
    users.createOrReplaceTempView("named_users")
    assert rows(read_table(spark, "named_users", ["name"])) == [("Alice",), ("Bob",), ("Charlie",)]
    spark.catalog.dropTempView("named_users")


def test_only_wanted_columns_are_scanned(spark, users, tmp_path):
    path = str(tmp_path / "users")
    users.write.parquet(path)
    plan = read_table(spark, path, ["id"]).where("id > 1")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:int>" in plan and "GreaterThan(id,1)" in plan


def test_query_source_is_wrapped(spark, users):
    out = read_query(spark, "SELECT id FROM users WHERE id > 1 -- tail", {"users": users})
    assert rows(out) == [(2,), (3,)]
    with pytest.raises(StepError):
        read_query(spark, "DELETE FROM users", {"users": users})


def test_samples(spark):
    df = spark.range(100)
    assert sample(df).count() == 10
    assert sample(df, 0).count() == 1
    assert rows(sample(df, 3, order_by="id")) == [(0,), (1,), (2,)]


def test_row_guard_is_strictly_above(spark):
    big = spark.range(200_000).selectExpr("id", "concat('row_', id) AS val")
    assert guard_row_count(big, 200_000) == 200_000
    with pytest.raises(RowLimitExceeded, match="200000 rows which exceeds the limit of 100000"):
        guard_row_count(big, 100_000)
    assert rows(row_count_report(big, 100_000)) == [(200_000, 100_000, False)]


def test_text_tables(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,note,empty\n1,"say ""hi"", now",\n02," spaced ",x\n')
    df = read_text_table(spark, str(path))
    assert dict(df.dtypes) == {"id": "string", "note": "string", "empty": "string"}
    assert rows(df) == [("02", " spaced ", "x"), ("1", 'say "hi", now', "")]
    assert [r["empty"] for r in read_text_table(spark, str(path), null_text=None).collect()] == [None, "x"]


def test_text_tables_with_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,note\n1,"two\nlines"\n')
    assert rows(read_text_table(spark, str(path), multiline=True)) == [("1", "two\nlines")]
    torn = read_text_table(spark, str(path))
    for read in (torn.collect, torn.select("id").collect):
        with pytest.raises(Exception, match="(?i)malformed"):
            read()


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of a few bytes, each by a task of its own."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]

    def bytes_(n):
        for name in names:
            spark.conf.set(name, str(n))

    yield bytes_
    for name, value in zip(names, before):
        spark.conf.set(name, value)


@pytest.mark.parametrize("size", [7, 40, 1000, 10**6])
def test_one_file_with_line_breaks_is_read_by_many_tasks(spark, tmp_path, small_blocks, size):
    import csv
    import random

    rng = random.Random(size)
    parts = ["a", '"', "\n", ",", "é", " ", "x" * 30, "\n\n", '""', "1,2"]
    data = [(str(i), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))), "end") for i in range(60)]
    data[30] = ("30", "\n".join(["long value, of many blocks"] * 80), "end")
    (tmp_path / "in").mkdir()
    for name, some in (("a.csv", data[:45]), ("b.csv", data[45:])):
        with open(tmp_path / "in" / name, "w", newline="") as file:
            writer = csv.writer(file, quoting=csv.QUOTE_ALL, lineterminator="\r\n" if name == "b.csv" else "\n")
            writer.writerows([("id", "no\nte", "last"), *some])
    small_blocks(size)
    df = read_text_table(spark, str(tmp_path / "in"), multiline=True)
    assert df.columns == ["id", "no\nte", "last"]
    assert rows(df) == sorted(data, key=repr)
    if size == 40:
        assert df.rdd.getNumPartitions() > 50


def test_text_tables_with_line_breaks_refuse_what_is_broken(spark, tmp_path, small_blocks):
    for k, text in enumerate(('a,b\n1,"x\ny\n2,z\n', "a,b\n1\n", 'a,b\n1,"x\ny",3\n')):
        path = tmp_path / f"{k}.csv"
        path.write_text(text)
        for size in (5, 10**6):
            small_blocks(size)
            with pytest.raises(Exception, match="(?i)malformed"):
                read_text_table(spark, str(path), multiline=True).collect()
    (tmp_path / "gap.csv").write_text("a,b\n\n1,2\n \n")
    assert rows(read_text_table(spark, str(tmp_path / "gap.csv"), multiline=True)) == [("1", "2")]


def test_text_tables_refuse_records_of_another_width(spark, tmp_path):
    for record in ("1", "1,2,3"):
        path = tmp_path / f"{len(record)}.csv"
        path.write_text(f"a,b\n{record}\n")
        with pytest.raises(Exception, match="(?i)malformed"):
            read_text_table(spark, str(path)).collect()


def test_database_reader_options():
    db = Database.postgres("host", "shop", "me", "secret", port=5433)
    table = reader_options(db, table="orders", ranges=Ranges("id", 1, 1000, 8))
    assert table["url"] == "jdbc:postgresql://host:5433/shop" and table["dbtable"] == "orders"
    assert (table["partitionColumn"], table["lowerBound"], table["upperBound"], table["numPartitions"]) == ("id", "1", "1000", "8")
    query = reader_options(db, query="SELECT 1 -- c")
    assert query["dbtable"] == "(\nSELECT 1 -- c\n) AS _src" and "numPartitions" not in query
    with pytest.raises(ValueError):
        reader_options(db)


def test_database_writer_options():
    db = Database("jdbc:x:y", {"user": "me"})
    append = writer_options(db, "t", 1000, None, truncate=False)
    assert append["batchsize"] == "1000" and "truncate" not in append and "numPartitions" not in append
    replace = writer_options(db, "t", 500, 4, truncate=True)
    assert (replace["truncate"], replace["numPartitions"], replace["batchsize"]) == ("true", "4", "500")
    assert AppendDatabase(db, "t").batch_rows == ReplaceDatabase(db, "t").batch_rows == 1000


def test_scratch_paths_are_fresh_and_below_the_shared_folder(spark):
    one, two = new_scratch_path(spark, "a"), new_scratch_path(spark, "a")
    assert one != two and one.startswith(scratch_root(spark))


class FakeSession:
    """A session without a shared folder."""

    def __init__(self, master):
        self.sparkContext = self
        self.conf = {}
        self.master, self.applicationId = master, f"app-{master}"

    def getCheckpointDir(self):
        return None


def test_local_scratch_only_on_a_local_master():
    local = FakeSession("local[2]")
    assert scratch_root(local) == scratch_root(local)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(FakeSession("spark://somewhere:7077"))
