import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sluiceway.operators.columns import column_mapping, derived
from sluiceway.operators.sqlsteps import sql_chain
from sluiceway.operators.contracts import TargetColumn
from sluiceway.plans.flow import Flow
from sluiceway.plans.steps import Source, Sql, Target
from sluiceway.sinks.base import Folder
from sluiceway.sinks.files import AppendFiles, AppendTable, ReplaceFiles
from sluiceway.streaming.incremental import BatchLedger, NewFiles, run_flow, run_new


@pytest.fixture
def folder(spark, tmp_path):
    def add(start, end):
        spark.range(start, end).selectExpr("id", "concat('n', id) AS name").coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / "in"))

    return tmp_path, add


def test_each_run_takes_only_new_files(spark, folder):
    path, add = folder
    source = NewFiles(str(path / "in"), files_per_batch=1)
    steps = [
        lambda df: sql_chain(df, [("even", "SELECT * FROM {prev} WHERE id % 2 = 0")]),
        derived("UPPER(name)", "name"),
        column_mapping([{"source_col": "name", "target_col": "label", "drop": False}]),
    ]
    target, checkpoint = str(path / "out"), str(path / "progress")
    add(0, 4)
    add(4, 6)
    assert run_new(spark, source, steps, checkpoint, target) == 6
    assert rows(spark.read.parquet(target)) == [("N0",), ("N2",), ("N4",)]
    assert run_new(spark, source, steps, checkpoint, target) == 0
    add(6, 9)
    assert run_new(spark, source, steps, checkpoint, target) == 3
    assert [r[0] for r in rows(spark.read.parquet(target))] == ["N0", "N2", "N4", "N6", "N8"]


def test_python_batches_run_on_new_files(spark, folder):
    from sluiceway.operators.codesteps import batches

    path, add = folder
    add(0, 3)

    def double(part):
        return part.assign(id=part["id"] * 2)[["id"]]

    run_new(spark, NewFiles(str(path / "in")), [batches(double, "id bigint")], str(path / "cp"), str(path / "out"))
    assert rows(spark.read.parquet(str(path / "out"))) == [(0,), (2,), (4,)]


def test_steps_over_all_rows_are_refused(spark, folder):
    path, add = folder
    add(0, 3)
    with pytest.raises(AnalysisException, match="append"):
        run_new(
            spark,
            NewFiles(str(path / "in")),
            [lambda df: df.groupBy("name").agg(F.count("*"))],
            str(path / "cp"),
            str(path / "out"),
        )


def test_one_way_to_write(spark, folder):
    path, add = folder
    add(0, 1)
    with pytest.raises(ValueError):
        run_new(spark, NewFiles(str(path / "in")), [], str(path / "cp"))


def test_each_batch_gets_the_rows_and_its_number(spark, folder):
    path, add = folder
    add(0, 3)
    seen = []
    source = NewFiles(str(path / "in"))
    assert run_new(spark, source, [], str(path / "cp"), each_batch=lambda df, n: seen.append((n, df.count()))) == 3
    assert seen == [(0, 3)]


@pytest.fixture
def stream(spark, folder):
    """A folder that files arrive in, two targets, and a flow into both."""
    path, add = folder
    add(0, 4)
    add(4, 6)
    spark.range(0).selectExpr("id", "'' AS name").write.parquet(str(path / "even"))

    class Stream:
        base, add_rows = path, staticmethod(add)
        source = NewFiles(str(path / "in"), files_per_batch=1)
        odd = ReplaceFiles(str(path / "odd"))

        def flow(self, batch, broken=False):
            name = "IF(1 / (id - 5) > 9, 'x', name) AS name" if broken else "name"
            return Flow(
                spark,
                [
                    Source("new", batch),
                    Sql("even", "SELECT * FROM {prev} WHERE id % 2 = 0"),
                    Sql("odd", f"SELECT id, {name} FROM {{all}} WHERE id % 2 = 1",
                        inputs={"all": "new"}),
                ],
                [
                    Target(AppendFiles(str(path / "even")), "even", [TargetColumn("id", "bigint", nullable=False)], "even"),
                    Target(self.odd, "odd", name="odd"),
                ],
            )

        def run(self, broken=False, **options):
            return run_flow(
                spark, self.source, lambda batch: self.flow(batch, broken), str(path / "cp"),
                BatchLedger(str(path / "ledger")), **options,
            )

        def forget(self, batch):
            for name in (f"{batch}", f".{batch}.crc"):
                Folder(spark, f"{path}/cp/commits/{name}").remove()

        def ids(self, name):
            return [r[0] for r in rows(spark.read.parquet(str(path / name)).select("id"))]

    return Stream()


def test_a_flow_runs_on_each_batch(stream):
    report = stream.run(check_data=True)
    assert report.rows_read == 6 and report.rows == {"even": 3, "odd": 3}
    assert stream.ids("even") == [0, 2, 4]
    assert stream.ids("odd") == [5]  # replaced by the last batch
    assert stream.run().rows == {}
    stream.add_rows(6, 9)
    assert stream.run().rows == {"even": 2, "odd": 1}
    assert stream.ids("even") == [0, 2, 4, 6, 8]


def test_a_batch_that_comes_twice_counts_once(stream):
    stream.run()
    stream.forget(1)
    again = stream.run()
    assert again.batches[1].targets == {"even": "skipped", "odd": "skipped"}
    assert stream.ids("even") == [0, 2, 4]


def test_a_failed_target_takes_the_batch_back_from_the_others(stream):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        stream.run(broken=True)
    assert stream.ids("even") == [0, 2]  # the first batch; the second brought nothing
    assert stream.run().rows == {"even": 1, "odd": 1}
    assert stream.ids("even") == [0, 2, 4]


class Lost(BaseException):
    pass


@pytest.mark.parametrize("n", range(1, 8))
def test_a_lost_driver_does_not_count_a_batch_twice(spark, stream, monkeypatch, n):
    from sluiceway.sinks.base import write
    from sluiceway.streaming.incremental import Once

    ledger = BatchLedger(str(stream.base / "ledger"))
    sink = Once(AppendFiles(str(stream.base / "even")), ledger, ledger.entry("s", 0, "even"))
    new = spark.range(100, 103).selectExpr("id", "'x' AS name").coalesce(2)
    real, seen = Folder.move_to, []

    def move(self, path):
        real(self, path)
        seen.append(path)
        if len(seen) == n:
            raise Lost()

    with monkeypatch.context() as patch:
        patch.setattr(Folder, "move_to", move)
        try:
            write(new, sink)
        except Lost:
            pass
    write(new, sink)  # the batch comes again
    assert stream.ids("even") == [100, 101, 102]
    assert ledger.rows(spark, ledger.entry("s", 0, "even")) == 3


def test_tables_take_a_batch_once_and_other_inserts_are_refused(spark, users):
    import tempfile

    from sluiceway.sinks.base import WriteError, write
    from sluiceway.streaming.incremental import Once

    ledger = BatchLedger(tempfile.mkdtemp() + "/ledger")
    users.write.saveAsTable("users_once")
    try:
        sink = Once(AppendTable("users_once"), ledger, ledger.entry("s", 3, "t"))
        assert write(users, sink) == 3 and write(users, sink) == 0
        assert spark.table("users_once").count() == 6
    finally:
        spark.sql("DROP TABLE users_once")

    class Inserting:
        def stage(self, df):
            raise AssertionError

    with pytest.raises(WriteError, match="came before"):
        write(users, Once(Inserting(), ledger, ledger.entry("s", 4, "t")))
