import glob
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sluiceway.sinks.base import Folder, WriteError, aligned, write
from sluiceway.sinks.database import Database, ReplaceDatabase
from sluiceway.sinks.files import (
    AppendFiles,
    AppendTable,
    DryRun,
    ReplaceFiles,
    ReplacePartitions,
    ReplaceTable,
    read_files,
)
from sluiceway.sinks.switch import leftovers, recover


@pytest.fixture
def target(users, tmp_path):
    path = str(tmp_path / "target")
    users.write.parquet(path)
    return path


def broken(name):
    return F.when(F.col(name) > 0, F.raise_error(F.lit("row failed"))).cast("int")


def test_append_by_name_with_missing_columns(spark, users, target):
    more = users.limit(1).select(F.lit("z@x.org").alias("email"), F.lit(9).cast("bigint").alias("id"))
    with pytest.raises(WriteError, match="name"):
        write(more, AppendFiles(target))
    assert write(more, AppendFiles(target, fill_missing=True)) == 1
    out = spark.read.parquet(target)
    assert out.columns == ["id", "name", "email"]
    assert out.count() == 4 and tuple(out.where("id = 9").first()) == (9, None, "z@x.org")


def test_append_needs_a_target_and_known_columns(users, target, tmp_path):
    with pytest.raises(WriteError, match="does not exist"):
        write(users, AppendFiles(str(tmp_path / "none")))
    with pytest.raises(WriteError, match="extra"):
        write(users.withColumn("extra", F.lit(1)), AppendFiles(target))


def test_replace_swaps_and_leaves_nothing_beside(spark, users, target, tmp_path):
    assert write(users.where("id = 2"), ReplaceFiles(target)) == 1
    assert rows(spark.read.parquet(target)) == [(2, "Bob", "bob@x.org")]
    assert [p for p in glob.glob(str(tmp_path / "*")) if p != target] == []


def test_replace_may_read_its_own_target(spark, target):
    out = spark.read.parquet(target).withColumn("name", F.upper("name"))
    assert write(out, ReplaceFiles(target)) == 3
    assert [r["name"] for r in spark.read.parquet(target).orderBy("id").collect()] == ["ALICE", "BOB", "CHARLIE"]


def test_replace_without_rows_keeps_the_old_data(spark, users, target):
    assert write(users.where("id > 99"), ReplaceFiles(target)) == 0
    assert spark.read.parquet(target).count() == 3


def test_failed_replace_keeps_the_old_data(spark, users, target, tmp_path):
    with pytest.raises(Exception, match="row failed"):
        write(users.withColumn("id", broken("id")), ReplaceFiles(target))
    assert rows(spark.read.parquet(target)) == rows(users)
    assert [p for p in glob.glob(str(tmp_path / "*")) if p != target] == []


def test_failed_switch_puts_the_old_data_back(spark, users, target, monkeypatch):
    real = Folder.move_to

    def failing(self, path):
        if ".staging-" in self.path:
            raise WriteError("no rename today")
        return real(self, path)

    monkeypatch.setattr(Folder, "move_to", failing)
    with pytest.raises(WriteError, match="no rename"):
        write(users.where("id = 1"), ReplaceFiles(target))
    assert rows(spark.read.parquet(target)) == rows(users)


def test_replace_creates_unless_told_not_to(spark, users, tmp_path):
    path = str(tmp_path / "new")
    with pytest.raises(WriteError, match="does not exist"):
        write(users, ReplaceFiles(path, create=False))
    assert write(users, ReplaceFiles(path)) == 3
    assert spark.read.parquet(path).count() == 3


def test_staged_write_can_be_discarded(spark, users, target, tmp_path):
    pending = ReplaceFiles(target).stage(users.where("id = 1"))
    pending.discard()
    assert spark.read.parquet(target).count() == 3
    assert [p for p in glob.glob(str(tmp_path / "*")) if p != target] == []


def test_catalog_replace_moves_the_location(spark, users, target):
    spark.sql(f"CREATE TABLE users_moved USING parquet LOCATION '{target}'")
    try:
        assert write(users.where("id < 3"), ReplaceTable("users_moved")) == 2
        assert spark.table("users_moved").count() == 2
        assert spark.read.parquet(target).count() == 3  # readers of the old folder go on
        assert write(users.where("id = 3"), ReplaceTable("users_moved", drop_old=True)) == 1
        assert write(users.select("email", "id"), AppendTable("users_moved", fill_missing=True)) == 3
        assert spark.table("users_moved").count() == 4
        assert write(users.where("id > 9"), ReplaceTable("users_moved")) == 0
        assert spark.table("users_moved").count() == 4
    finally:
        spark.sql("DROP TABLE users_moved")


def _partitioned(spark, table="by_kind", external=None):
    rows_ = [(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", "it's %"), (5, "e", None)]
    where = f"LOCATION '{external}'" if external else ""
    spark.sql(f"CREATE TABLE {table} (id int, name string, kind string) USING parquet PARTITIONED BY (kind) {where}")
    spark.createDataFrame(rows_, "id int, name string, kind string").write.insertInto(table)
    return rows_


@pytest.mark.parametrize("external", [False, True])
def test_catalog_replace_of_partitions(spark, tmp_path, external):
    old = _partitioned(spark, external=str(tmp_path / "t") if external else None)
    new = [(9, "n", "x"), (8, "m", "new"), (7, "l", None)]
    df = spark.createDataFrame([(k, i, n) for i, n, k in new], "kind string, id int, name string")
    try:
        pending = ReplaceTable("by_kind").stage(df)
        assert rows(spark.table("by_kind")) == sorted(old, key=repr)
        assert pending.commit() == 3
        assert rows(spark.table("by_kind")) == sorted(new, key=repr)
        pending.undo()
        assert rows(spark.table("by_kind")) == sorted(old, key=repr)
        assert write(df, ReplaceTable("by_kind", drop_old=True)) == 3
        assert rows(spark.table("by_kind")) == sorted(new, key=repr)
        assert rows(spark.sql("SHOW PARTITIONS by_kind")) == [
            ("kind=__HIVE_DEFAULT_PARTITION__",), ("kind=new",), ("kind=x",)
        ]
        assert write(df.where("id = 9"), ReplaceTable("by_kind")) == 1  # a second time, from the new folders
        assert rows(spark.table("by_kind")) == [(9, "n", "x")]
    finally:
        spark.sql("DROP TABLE by_kind")


def test_a_failed_catalog_switch_leaves_all_old_partitions(spark, monkeypatch):
    from sluiceway.sinks import files

    old = _partitioned(spark)
    df = spark.createDataFrame([(9, "n", "x"), (8, "m", "y"), (7, "l", "z")], "id int, name string, kind string")
    real, calls = files._Partitions._point, []

    def failing(self, part, path):
        calls.append(part)
        if len(calls) == 2:
            raise WriteError("the catalog is away")
        return real(self, part, path)

    monkeypatch.setattr(files._Partitions, "_point", failing)
    try:
        with pytest.raises(WriteError, match="away"):
            write(df, ReplaceTable("by_kind"))
        assert rows(spark.table("by_kind")) == sorted(old, key=repr)
    finally:
        spark.sql("DROP TABLE by_kind")


def test_dry_run_runs_everything(users):
    assert write(users, DryRun()) == 3
    with pytest.raises(Exception, match="row failed"):
        write(users.withColumn("id", broken("id")), DryRun())


def test_values_that_do_not_fit_the_target_fail(spark, users):
    wide = users.select(F.lit(2**40).alias("id"))
    with pytest.raises(Exception, match="OVERFLOW"):
        aligned(wide, users.schema, fill_missing=True).collect()


def test_database_replace_does_not_touch_the_target_when_the_rows_fail(users):
    # fails while the rows are staged, before any connection is made
    sink = ReplaceDatabase(Database("jdbc:none:there"), "t")
    with pytest.raises(Exception, match="row failed"):
        sink.stage(users.withColumn("id", broken("id")))


def test_a_lost_fraction_stops_the_write(spark, tmp_path):
    path = str(tmp_path / "whole")
    spark.range(1).select(F.col("id").cast("int")).write.parquet(path)
    assert write(spark.createDataFrame([(2.0,)], "id double"), AppendFiles(path)) == 1
    with pytest.raises(Exception, match="lose its fraction"):
        write(spark.createDataFrame([(1.5,)], "id double"), AppendFiles(path))
    assert spark.read.parquet(path).count() == 2


# -- folders in partitions, lost drivers, text formats ---------------------------------------------

KINDS = "id int, name string, kind string, day date"


def _by_kind(spark, path, data):
    spark.createDataFrame(data, KINDS).write.partitionBy("kind", "day").parquet(path)


def _kinds(spark, data):
    return spark.createDataFrame([(i, n, k, d) for i, n, k, d in data], KINDS)


def _layout(path):
    return sorted({p.split(f"{path}/")[1].rsplit("/", 1)[0] for p in glob.glob(f"{path}/*/*/*.parquet")})


@pytest.fixture
def days():
    from datetime import date

    return date(2024, 1, 1), date(2024, 1, 2)


@pytest.fixture
def by_kind(spark, tmp_path, days):
    path = str(tmp_path / "kinds")
    data = [(1, "a", "x", days[0]), (2, "b", "x", days[1]), (3, "c", "y", days[0])]
    _by_kind(spark, path, data)
    return path, data


def test_replace_and_append_keep_the_partitions(spark, by_kind, days):
    path, data = by_kind
    new = [(7, "g", "z", days[1]), (8, "h", "x", days[0])]
    assert write(_kinds(spark, new), ReplaceFiles(path)) == 2
    assert _layout(path) == ["kind=x/day=2024-01-01", "kind=z/day=2024-01-02"]
    assert rows(read_files(spark, path)) == sorted(new, key=repr)
    assert write(_kinds(spark, data), AppendFiles(path)) == 3
    assert rows(read_files(spark, path)) == sorted(new + data, key=repr)
    assert "kind=y/day=2024-01-01" in _layout(path)
    with pytest.raises(WriteError, match="partitioned by"):
        write(_kinds(spark, data), ReplaceFiles(path, partition_by=["day"]))
    with pytest.raises(WriteError, match="lack"):
        write(_kinds(spark, data).drop("day"), AppendFiles(path, fill_missing=True))


def test_replace_of_the_partitions_that_the_rows_have(spark, by_kind, days, tmp_path):
    path, data = by_kind
    new = [(7, "g", "z", days[1]), (8, "h", "x", days[0])]
    assert write(_kinds(spark, new), ReplacePartitions(path)) == 2
    assert rows(read_files(spark, path)) == sorted(new + data[1:], key=repr)
    assert [p for p in glob.glob(str(tmp_path / "*")) if p != path] == []
    pending = ReplacePartitions(path).stage(_kinds(spark, data))
    assert pending.commit() == 3
    pending.undo()
    assert rows(read_files(spark, path)) == sorted(new + data[1:], key=repr)
    fresh = str(tmp_path / "fresh")
    assert write(_kinds(spark, data), ReplacePartitions(fresh, partition_by=["kind"])) == 3
    assert rows(read_files(spark, fresh).select("id", "name", "kind", "day")) == sorted(data, key=repr)
    with pytest.raises(WriteError, match="no partitions"):
        write(_kinds(spark, data), ReplacePartitions(str(tmp_path / "flat")))


class Lost(BaseException):
    """The driver is gone: nothing after this runs."""


def _lose_after(monkeypatch, n):
    """The driver is lost right after its n-th rename."""
    real, seen = Folder.move_to, []

    def move(self, path):
        if len(seen) == n:
            raise Lost()
        real(self, path)
        seen.append(path)
        if len(seen) == n:
            raise Lost()

    monkeypatch.setattr(Folder, "move_to", move)


@pytest.mark.parametrize("sink", [ReplaceFiles, ReplacePartitions, AppendFiles])
@pytest.mark.parametrize("n", range(1, 9))
def test_a_lost_driver_leaves_the_old_rows_or_the_new_ones(spark, by_kind, days, tmp_path, monkeypatch, sink, n):
    path, data = by_kind
    new = [(7, "g", "z", days[1]), (8, "h", "x", days[0])]
    after = {ReplaceFiles: new, ReplacePartitions: new + data[1:], AppendFiles: new + data}[sink]
    with monkeypatch.context() as patch:
        _lose_after(patch, n)
        try:
            write(_kinds(spark, new), sink(path))
            lost = False
        except Lost:
            lost = True
    assert lost or n > 4
    held = sink(path).held(spark)  # the next run looks at its target
    assert held is not None and set(held.names) == {"id", "name", "kind", "day"}
    found = rows(spark.read.parquet(path).select("id", "name", "kind", "day"))
    assert found in (sorted(data, key=repr), sorted(after, key=repr))
    if not lost:
        assert found == sorted(after, key=repr)
    assert [p for p in glob.glob(str(tmp_path / "*")) if p != path] == []
    assert recover(spark, path) is None
    with pytest.raises(WriteError, match="not in the target"):
        write(_kinds(spark, new).withColumn("extra", F.lit(1)), sink(path))


@pytest.mark.parametrize("n", range(1, 4))
def test_a_lost_driver_before_a_new_target(spark, users, tmp_path, monkeypatch, n):
    path = str(tmp_path / "first")
    with monkeypatch.context() as patch:
        _lose_after(patch, n)
        with pytest.raises(Lost):
            write(users, ReplaceFiles(path))
    recover(spark, path)
    left = [p for p in glob.glob(str(tmp_path / "*"))]
    assert left in ([], [path])
    assert write(users, ReplaceFiles(path)) == 3


def test_an_undo_that_is_lost_is_carried_on(spark, by_kind, days, tmp_path, monkeypatch):
    path, data = by_kind
    pending = ReplacePartitions(path).stage(_kinds(spark, [(7, "g", "z", days[1]), (8, "h", "x", days[0]), (9, "i", "y", days[0])]))
    pending.commit()
    with monkeypatch.context() as patch:
        _lose_after(patch, 2)
        with pytest.raises(Lost):
            pending.undo()
    assert recover(spark, path) == "taken back"
    assert rows(spark.read.parquet(path).select("id", "name", "kind", "day")) == sorted(data, key=repr)


def test_staged_folders_of_lost_runs_are_told(spark, users, target):
    pending = ReplaceFiles(target).stage(users)
    assert len(leftovers(spark, target, 0)) == 1 and leftovers(spark, target) == []
    pending.discard()
    assert leftovers(spark, target, 0) == []


@pytest.mark.parametrize("file_format", ["csv", "json", "orc"])
def test_text_formats_keep_names_types_and_nulls(spark, tmp_path, file_format):
    from datetime import date
    from decimal import Decimal

    path = str(tmp_path / "t")
    schema = "id int, name string, nothing string, price decimal(8,2), day date"
    first = [(1, 'a "b", c', None, Decimal("1.50"), date(2024, 1, 1)), (2, "", None, None, None), (3, "\\", None, None, None)]
    sink = ReplaceFiles(path, file_format)
    assert write(spark.createDataFrame(first, schema), sink) == 3
    assert read_files(spark, path, file_format).dtypes == spark.createDataFrame([], schema).dtypes
    assert rows(read_files(spark, path, file_format)) == sorted(first, key=repr)
    more = spark.createDataFrame([(4, "d")], "id int, name string")
    with pytest.raises(WriteError, match="lack"):
        write(more, AppendFiles(path, file_format))
    assert write(more, AppendFiles(path, file_format, fill_missing=True)) == 1
    assert read_files(spark, path, file_format).count() == 4
    assert write(spark.createDataFrame(first[:1], schema), sink) == 1  # a second replacement
    assert rows(read_files(spark, path, file_format)) == first[:1]


def test_text_files_of_others_need_their_schema(spark, tmp_path):
    path = tmp_path / "given"
    path.mkdir()
    (path / "part.csv").write_text("1;x\n2;y\n")
    options = {"sep": ";", "header": "false"}
    sink = AppendFiles(str(path), "csv", options=options, schema="id int, name string")
    assert write(spark.createDataFrame([("z", 3)], "name string, id int"), sink) == 1
    assert rows(spark.read.schema("id int, name string").options(**options).csv(str(path))) == [(1, "x"), (2, "y"), (3, "z")]


@pytest.mark.parametrize("file_format", ["parquet", "csv", "json"])
def test_rows_are_told_while_they_are_written(spark, tmp_path, file_format):
    def slowly(batches):
        for batch in batches:
            time.sleep(0.1 if batch["id"].max() < 12_000 else 2)
            yield batch

    slow = spark.range(0, 24_000, 1, 24).mapInPandas(slowly, "id long")
    told = []
    sink = ReplaceFiles(str(tmp_path / "out"), file_format=file_format)
    assert write(slow, sink, told.append) == 24_000
    assert len(told) > 1 and told == sorted(set(told)) and told[-1] == 24_000


def test_a_listener_that_fails_leaves_the_write_alone(spark, target, users):
    def refuse(rows):
        raise ValueError(rows)

    assert write(users, AppendFiles(target), refuse) == 3
    assert spark.read.parquet(target).count() == 6
    # a write that fails ends the telling, and later writes count from 0
    told = []
    with pytest.raises(Exception, match="row failed"):
        write(users.withColumn("id", broken("id").cast("bigint")), AppendFiles(target), told.append)
    assert told == [] and write(users.limit(0), AppendFiles(target), told.append) == 0 and told == []
    assert write(users, AppendFiles(target), told.append) == 3 and told[-1] == 3
