import pytest
from conftest import rows
from pyspark.sql import functions as F

from sluiceway.operators.contracts import TargetColumn
from sluiceway.plans.flow import Flow, FlowError
from sluiceway.plans.steps import Code, Columns, Source, Sql, Target
from sluiceway.sinks.base import Pending
from sluiceway.sinks.files import AppendFiles, AppendTable, DryRun, ReplaceFiles, ReplaceTable


def upper_name(df):
    return df.withColumn("name", F.upper("name"))


def test_sql_code_sql_uses_each_step_before(spark, users):
    flow = Flow(
        spark,
        [
            Source("source", users),
            Sql("two", "SELECT id, name FROM {prev} WHERE id < 3"),
            Code("loud", upper_name),
            Sql("last", "SELECT name || '!' AS name, id FROM {prev}"),
        ],
    )
    assert rows(flow.result()) == [("ALICE!", 1), ("BOB!", 2)]


def test_frames_are_lazy_and_keep_pushdown(spark, users, tmp_path):
    path = str(tmp_path / "users")
    users.write.parquet(path)
    flow = Flow(
        spark,
        [
            Source("source", table=path),
            Sql("all", "SELECT * FROM {prev}"),
            Columns("named", [{"type": "sql_expression", "config": {"expression": "UPPER(name)", "output_column": "up"}}]),
            Sql("some", "SELECT up FROM {prev} WHERE id > 1"),
        ],
    )
    plan = flow.result()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,1)" in plan and "ReadSchema: struct<id:int,name:string>" in plan


def test_source_query_goes_before_a_table(spark, users):
    flow = Flow(spark, [Source("s", table="nowhere", query="SELECT 1 AS one")])
    assert rows(flow.result()) == [(1,)]


def test_named_inputs(spark, users):
    ages = spark.createDataFrame([(1, 30), (2, 25)], "id int, age int")
    steps = [
        Source("people", users),
        Source("ages", ages),
        Sql("join", "SELECT l.name, r.age FROM {left} l JOIN {right} r ON l.id = r.id",
            inputs={"left": "people", "right": "ages"}),
    ]
    assert rows(Flow(spark, steps).result()) == [("Alice", 30), ("Bob", 25)]
    code = Code("both", lambda left, right: left.join(right, "id").select("age"),
                inputs={"left": "people", "right": "ages"})
    assert rows(Flow(spark, [*steps[:2], code]).result()) == [(25,), (30,)]


def test_back_references_and_source_zero(spark, users):
    flow = Flow(
        spark,
        [
            Source("My users", users),
            Sql("Lower", "SELECT id, lower(name) AS name FROM {prev}"),
            Sql("pair", "SELECT s.name AS a, l.name AS b FROM source_0 s JOIN lower_1 l ON s.id = l.id WHERE s.id = 1"),
        ],
    )
    assert rows(flow.result()) == [("Alice", "alice")]


def test_disabled_steps_change_nothing(spark, users):
    flow = Flow(
        spark,
        [Source("s", users), Code("gone", lambda df: df.limit(0), enabled=False),
         Sql("n", "SELECT count(*) AS n FROM {prev}")],
    )
    assert rows(flow.result()) == [(3,)]


@pytest.mark.parametrize(
    "steps, message",
    [
        (lambda u: [], "at least one step"),
        (lambda u: [Source("a", u), Source("a", u)], "must differ"),
        (lambda u: [Sql("x", "SELECT 1")], "has no input"),
        (lambda u: [Source("a", u), Sql("b", "SELECT * FROM {x}", inputs={"x": "c"}), Sql("c", "SELECT * FROM {prev}")], "earlier step"),
        (lambda u: [Source("a", u), Sql("b", "SELECT * FROM {x}", inputs={"x": "b"})], "earlier step"),
        (lambda u: [Source("a", u), Source("lonely", u), Sql("c", "SELECT * FROM {x}", inputs={"x": "a"})], "Orphaned.*lonely"),
    ],
)
def test_refused_shapes(spark, users, steps, message):
    with pytest.raises(FlowError, match=message):
        Flow(spark, steps(users))


def test_unknown_target_step(spark, users):
    with pytest.raises(FlowError, match="unknown step"):
        Flow(spark, [Source("a", users)], [Target(DryRun(), "b")])


def test_preview_shows_each_step(spark, users):
    flow = Flow(
        spark,
        [Source("source", users), Sql("few", "SELECT id FROM {prev} WHERE id > 1"), Code("more", lambda d: d.withColumn("x", F.lit(1)))],
    )
    results = flow.preview(limit=2, order_by="id", contract=[TargetColumn("id", "int4"), TargetColumn("y", "text")])
    assert [(r.node_id, r.status, r.row_count, r.col_count) for r in results] == [
        ("source", "ok", 2, 3), ("few", "ok", 2, 1), ("more", "ok", 2, 2), ("target", "error", 0, 2),
    ]
    assert results[1].schema == [{"name": "id", "type": "int"}]
    assert [tuple(r) for r in results[1].sample_data] == [(2,), (3,)]
    assert results[3].validation["errors"] == [
        {"type": "missing_column", "column": "y", "expected": "text", "actual": None,
         "message": "Column 'y' not found in pipeline output"}
    ]


@pytest.mark.parametrize(
    "bad, text",
    [
        (Sql("bad", "SELECT nope FROM {prev}"), "nope"),
        (Sql("bad", "DELETE FROM {prev}"), "SELECT"),
        (Code("bad", lambda d: 1), "must return a DataFrame"),
        (Code("bad", lambda d: d.missing_thing), "missing_thing"),
        (Code("bad", lambda d: d.select(F.raise_error(F.lit("at run time")))), "at run time"),
    ],
)
def test_preview_stops_at_the_first_failure(spark, users, bad, text):
    results = Flow(spark, [Source("s", users), bad, Sql("after", "SELECT * FROM {prev}")]).preview(
        contract=[TargetColumn("id", "int4")]
    )
    assert [r.status for r in results] == ["ok", "error"]
    assert results[1].validation["valid"] is False
    assert text in results[1].validation["errors"][0]["message"]


def test_preview_of_an_empty_result_still_has_a_schema(spark, users):
    results = Flow(spark, [Source("s", users), Sql("none", "SELECT id FROM {prev} WHERE id > 9")]).preview(
        contract=[TargetColumn("id", "int4")]
    )
    assert results[1].schema == [{"name": "id", "type": "int"}]
    assert results[2].status == "ok"


def test_preview_with_a_sampled_source(spark):
    flow = Flow(spark, [Source("s", spark.range(1000)), Sql("n", "SELECT count(*) AS n FROM {prev}")])
    assert flow.preview()[1].sample_data[0]["n"] == 1000
    assert flow.preview(sample_source=10)[1].sample_data[0]["n"] == 10


def simple_flow(spark, users, sink, text="SELECT id, name FROM {prev}", contract=()):
    return Flow(spark, [Source("s", users), Sql("out", text)], [Target(sink, contract=contract)])


def test_run_writes_and_counts(spark, users, tmp_path):
    path = str(tmp_path / "out")
    report = simple_flow(spark, users, ReplaceFiles(path)).run()
    assert (report.status, report.rows_processed, report.total_rows) == ("completed", 3, 3)
    assert rows(spark.read.parquet(path)) == [(1, "Alice"), (2, "Bob"), (3, "Charlie")]
    report = simple_flow(spark, users, AppendFiles(path)).run()
    assert report.rows == {"target": 3} and spark.read.parquet(path).count() == 6


def test_run_without_rows_completes_and_keeps_the_target(spark, users, tmp_path):
    path = str(tmp_path / "out")
    simple_flow(spark, users, ReplaceFiles(path)).run()
    report = simple_flow(spark, users, ReplaceFiles(path), "SELECT id, name FROM {prev} WHERE id > 9").run(row_limit=5)
    assert (report.status, report.rows_processed, report.total_rows) == ("completed", 0, 0)
    assert spark.read.parquet(path).count() == 3


@pytest.mark.parametrize(
    "options, contract, text, message",
    [
        ({"row_limit": 2}, [], "SELECT id, name FROM {prev}", "exceeds the limit of 2"),
        ({}, [TargetColumn("email", "text")], "SELECT id, name FROM {prev}", "Column 'email' not found"),
        ({}, [], "SELECT nope FROM {prev}", "nope"),
        ({"check_data": True}, [TargetColumn("name", "text", nullable=False)], "SELECT id, nullif(name, 'Bob') AS name FROM {prev}", "name: 1 nulls"),
        ({"check_data": True}, [TargetColumn("id", "int4", is_primary_key=True)], "SELECT 1 AS id, name FROM {prev}", "2 rows break the key"),
        ({"check_data": True, "strict_types": True}, [TargetColumn("id", "text")], "SELECT id, name FROM {prev}", "expected text, got int"),
    ],
)
def test_nothing_is_written_when_a_check_fails(spark, users, tmp_path, options, contract, text, message):
    path = str(tmp_path / "out")
    simple_flow(spark, users, ReplaceFiles(path)).run()
    report = simple_flow(spark, users.where("id > 0"), ReplaceFiles(path), text, contract).run(**options)
    assert report.status == "failed" and message in report.error
    assert rows(spark.read.parquet(path)) == [(1, "Alice"), (2, "Bob"), (3, "Charlie")]


def test_checked_run_passes(spark, users, tmp_path):
    path = str(tmp_path / "out")
    contract = [TargetColumn("id", "int4", nullable=False, is_primary_key=True, foreign_key="known.id")]
    report = simple_flow(spark, users, ReplaceFiles(path), contract=contract).run(
        check_data=True, tables={"known": spark.range(10)}
    )
    assert report.status == "completed" and spark.read.parquet(path).count() == 3


def test_one_failing_target_writes_neither(spark, users, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    report = Flow(
        spark,
        [Source("s", users), Sql("a", "SELECT id FROM {prev}"),
         Sql("b", "SELECT raise_error('late') AS x FROM {all}", inputs={"all": "s"})],
        [Target(ReplaceFiles(good), "a", name="good"), Target(ReplaceFiles(bad), "b", name="bad")],
    ).run()
    assert report.status == "failed" and "late" in report.error
    assert list(tmp_path.iterdir()) == []


@pytest.mark.parametrize("share", ["persist", "table", None])
def test_fan_out(spark, users, tmp_path, share):
    low, high = str(tmp_path / "low"), str(tmp_path / "high")
    report = Flow(
        spark,
        [Source("s", users), Code("up", upper_name), Sql("low", "SELECT * FROM {prev} WHERE id < 2"),
         Sql("high", "SELECT * FROM {up} WHERE id >= 2", inputs={"up": "up"})],
        [Target(ReplaceFiles(low), "low", name="low"), Target(ReplaceFiles(high), "high", name="high")],
    ).run(share=share)
    assert report.rows == {"low": 1, "high": 2} and report.rows_processed == 3
    assert [r["name"] for r in spark.read.parquet(high).orderBy("id").collect()] == ["BOB", "CHARLIE"]


def test_metrics(spark, users):
    flow = Flow(
        spark,
        [Source("s", users), Sql("kept", "SELECT id, name FROM {prev} WHERE id > 1"),
         Sql("twice", "SELECT id FROM {prev} UNION ALL SELECT id FROM {prev}"),
         Sql("unused", "SELECT 1 AS x FROM {prev}", inputs={"prev": "s"})],
        [Target(DryRun(), "twice")],
    )
    report = flow.run(metrics=True)
    assert report.status == "completed" and report.rows_processed == 4
    got = report.metrics(spark)
    assert rows(got.select("step", "status", "row_count", "col_count")) == [
        ("kept", "ok", 2, 2), ("s", "ok", 3, 3), ("twice", "ok", 4, 1),
    ]
    assert got.where("step = 'kept' AND duration_ms >= 0").count() == 1


def test_metrics_of_steps_the_optimizer_removes(spark, users):
    flow = Flow(
        spark,
        [Source("s", users), Sql("none", "SELECT id FROM {prev} WHERE false")],
        [Target(DryRun())],
    )
    report = flow.run(metrics=True)
    assert [(m.step, m.row_count) for m in report.steps] == [("s", 3), ("none", 0)]


def test_runs_without_metrics_keep_filters_at_the_scan(spark, users, tmp_path):
    path = str(tmp_path / "users")
    users.write.parquet(path)
    plan = Flow(spark, [Source("s", table=path), Sql("f", "SELECT * FROM {prev} WHERE id > 1")]).result()
    assert "CollectMetrics" not in plan._jdf.queryExecution().executedPlan().toString()


def test_run_needs_a_target(spark, users):
    with pytest.raises(FlowError, match="needs a target"):
        Flow(spark, [Source("s", users)]).run()


def test_dry_run_checks_but_does_not_write(spark, users, tmp_path):
    path = str(tmp_path / "out")
    flow = simple_flow(spark, users, ReplaceFiles(path), contract=[TargetColumn("id", "int4", is_primary_key=True)])
    report = flow.dry_run(check_data=True)
    assert (report.status, report.rows, report.targets) == ("completed", {"target": 3}, {"target": "skipped"})
    assert list(tmp_path.iterdir()) == []
    assert flow.run().targets == {"target": "written"}
    none = simple_flow(spark, users, ReplaceFiles(path), "SELECT id, name FROM {prev} WHERE id > 9")
    assert none.run().targets == {"target": "unchanged"}


def test_a_failing_insert_leaves_the_switch_undone(spark, users, tmp_path):
    replaced, appended = str(tmp_path / "replaced"), str(tmp_path / "appended")
    users.select("id").write.parquet(replaced)
    users.select("id").write.parquet(appended)
    report = Flow(
        spark,
        [Source("s", users), Sql("a", "SELECT id FROM {prev} WHERE id = 1"),
         Sql("b", "SELECT CASE WHEN id > 0 THEN cast(raise_error('late') AS int) END AS id FROM {all}", inputs={"all": "s"})],
        [Target(ReplaceFiles(replaced), "a", name="x"), Target(AppendFiles(appended), "b", name="y")],
    ).run()
    assert report.status == "failed" and "late" in report.error
    assert spark.read.parquet(replaced).count() == 3
    assert sorted(p.name for p in tmp_path.iterdir()) == ["appended", "replaced"]


def test_target_names_differ(spark, users):
    with pytest.raises(FlowError, match="Target names"):
        Flow(spark, [Source("a", users)], [Target(DryRun()), Target(DryRun())])


class FailingSwitch:
    def stage(self, df):
        def commit():
            raise RuntimeError("no switch")

        return Pending(commit, quick=True)


def test_a_failing_second_switch_puts_the_first_back(spark, users, tmp_path):
    path, made, added = (str(tmp_path / n) for n in ("old", "made", "added"))
    users.where("id = 1").write.parquet(path)
    users.where("id = 1").write.parquet(added)
    users.where("id < 3").write.saveAsTable("switched_users")
    try:
        report = Flow(
            spark,
            [Source("s", users), Sql("all", "SELECT * FROM {prev}")],
            [
                Target(ReplaceFiles(path), name="files"),
                Target(ReplaceFiles(made), name="made"),
                Target(ReplaceTable("switched_users"), name="table"),
                Target(AppendFiles(added), name="added"),
                Target(FailingSwitch(), name="bad"),
            ],
        ).run()
        assert report.status == "failed" and "no switch" in report.error
        assert report.targets == {
            "added": "written", "files": "restored", "made": "restored", "table": "restored", "bad": "unchanged",
        }
        assert report.rows["added"] == 3 and report.rows["files"] == 0
        assert [r.id for r in spark.read.parquet(path).collect()] == [1]
        assert spark.read.parquet(added).count() == 4
        assert spark.table("switched_users").count() == 2
        assert sorted(p.name for p in tmp_path.iterdir()) == ["added", "old"]
    finally:
        spark.sql("DROP TABLE switched_users")


def test_a_failure_after_the_writes_leaves_them(spark, users, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    monkeypatch.setattr(Flow, "_metrics", lambda *a: 1 / 0)
    report = Flow(spark, [Source("s", users)], [Target(ReplaceFiles(path))]).run(metrics=True)
    assert report.status == "completed" and report.steps == []
    assert spark.read.parquet(path).count() == 3


def test_a_target_states_its_own_columns(spark, users, tmp_path):
    path = str(tmp_path / "held")
    users.write.parquet(path)

    def run(rows_, sink, **options):
        return Flow(spark, [Source("rows", rows_)], [Target(sink)]).run(**options)

    lacking = users.select("id", F.col("name").alias("nmae"), "email")
    for sink in (AppendFiles(path), ReplaceFiles(path), DryRun(AppendFiles(path))):
        report = run(lacking, sink)
        assert (report.status, report.error) == (
            "failed", "Column 'name' not found in pipeline output"
        )
    # null filling is asked for, a new folder states nothing
    assert run(users.drop("name"), AppendFiles(path, fill_missing=True)).status == "completed"
    assert run(lacking, ReplaceFiles(str(tmp_path / "new"))).status == "completed"
    # types are those of the table, also in strict checks
    assert run(users, ReplaceFiles(path), check_data=True, strict_types=True).status == "completed"
    wide = users.withColumn("id", F.lit(2**40))
    assert "do not convert" in run(wide, ReplaceFiles(path), check_data=True).error
    assert rows(spark.read.parquet(path)) == rows(users)


def test_prev_beside_named_inputs_counts_as_read(spark, users, people):
    flow = Flow(
        spark,
        [Source("a", users), Source("b", people),
         Sql("both", "SELECT l.id FROM {left} l JOIN {prev} p ON l.id = p.id", inputs={"left": "a"})],
    )
    assert rows(flow.result()) == [(1,), (2,), (3,)]


def test_the_row_limit_holds_for_every_source(spark, users):
    flow = Flow(
        spark,
        [Source("a", users.limit(1)), Source("b", spark.range(9)),
         Sql("u", "SELECT id FROM {l} UNION ALL SELECT id FROM {r}", inputs={"l": "a", "r": "b"})],
        [Target(DryRun())],
    )
    assert flow.run(row_limit=5).status == "failed"
    assert flow.run(row_limit=9).total_rows == 10


def test_the_failing_step_is_named(spark, users):
    report = Flow(
        spark, [Source("s", users), Sql("bad", "SELECT nope FROM {prev}"), Sql("late", "SELECT 1 FROM {prev}")],
        [Target(DryRun())],
    ).run()
    assert [(m.step, m.status) for m in report.steps] == [("s", "ok"), ("bad", "error")]
    assert "nope" in report.steps[1].message


def test_filters_reach_the_files_of_plain_shared_steps(spark, users, tmp_path, monkeypatch):
    from sluiceway.plans import flow as module

    path = str(tmp_path / "users")
    users.write.parquet(path)
    plain = spark.read.parquet(path).select("id", "name")
    assert not module.costly(plain) and module.costly(plain.groupBy("name").count())


# -- failures while the rows flow -----------------------------------------------------------------


def _run(spark, steps):
    return Flow(spark, steps, [Target(DryRun())]).run()


def _states(report):
    return [(m.step, m.status) for m in report.steps]


def test_a_failing_expression_names_its_sql_step(spark, users):
    report = _run(spark, [
        Source("s", users),
        Sql("kept", "SELECT id, 10 / (id + 1) AS share FROM {prev}"),
        Sql("broken", "SELECT id, 10 / (id - 2) AS share FROM {prev}"),
        Sql("never", "SELECT id, share, 10 / (id + 3) AS other FROM {prev}"),
    ])
    assert report.status == "failed"
    assert _states(report) == [("s", "ok"), ("kept", "ok"), ("broken", "error")]
    assert "DIVIDE_BY_ZERO" in report.steps[-1].message


def test_equal_text_in_two_steps_is_told_apart(spark, users):
    # the relations have names of one length, so the divisions stand at the same places
    text = "SELECT id - 1 AS id, 10 / id AS share FROM {prev}"
    report = _run(spark, [Source("aa", users), Sql("bb", text), Sql("cc", text)])
    assert _states(report) == [("aa", "ok"), ("bb", "ok"), ("cc", "error")]


def test_a_failing_code_step_is_named(spark, users):
    def cast(df):
        return df.withColumn("n", F.col("name").cast("int"))

    report = _run(spark, [Source("s", users), Code("fine", upper_name), Code("cast", cast), Code("after", upper_name)])
    assert _states(report) == [("s", "ok"), ("fine", "ok"), ("cast", "error")]

    def text(df):
        return df.selectExpr("id", "1 / (id - 3) AS r")

    assert _states(_run(spark, [Source("s", users), Code("text", text), Code("after", lambda df: df.limit(2_000_000))]))[-1] == (
        "text", "error"
    )


def test_a_failing_python_step_is_named_with_its_exception(spark, users):
    from sluiceway.operators.codesteps import batches, group_fold

    def fine(part):
        return part[["id"]]

    def bad(part):
        raise ValueError("no such thing")

    steps = [Source("s", users), Code("fine", batches(fine, "id int")), Code("bad", batches(bad, "id int"))]
    report = _run(spark, steps)
    assert _states(report) == [("s", "ok"), ("fine", "ok"), ("bad", "error")]
    assert "ValueError: no such thing" in report.steps[-1].message
    folded = Code("fold", group_fold(["id"], bad, bad, "id int"))
    assert _states(_run(spark, [Source("s", users), folded]))[-1] == ("fold", "error")

    def direct(df):
        def each(parts):
            for part in parts:
                raise KeyError("inside")
                yield part

        return df.mapInPandas(each, df.schema)

    report = _run(spark, [Source("s", users), Code("fine", upper_name), Code("direct", direct)])
    assert _states(report)[-1] == ("direct", "error") and "KeyError" in report.error


def test_an_error_without_a_step_is_located_by_running_the_steps(spark, users):
    raised = users.withColumn("id", F.when(F.col("id") > 2, F.raise_error(F.lit("row"))).otherwise(F.col("id")))
    flow = Flow(spark, [Source("s", raised), Sql("n", "SELECT id FROM {prev}")], [Target(DryRun())])
    report = flow.run()
    assert report.status == "failed" and report.steps == []
    assert [(m.step, m.status) for m in flow.locate_failure()] == [("s", "error")]
    fine = Flow(spark, [Source("s", users), Sql("n", "SELECT id FROM {prev}")], [Target(DryRun())])
    assert [m.status for m in fine.locate_failure()] == ["ok", "ok"]


class _Stubborn:
    """A target whose parts fail as told."""

    def __init__(self, *fails):
        self.fails = fails

    def stage(self, df):
        def part(name, result=None):
            def run():
                if name in self.fails:
                    raise OSError(f"{name} refused")
                return result

            return run

        return Pending(part("commit", 1), part("discard"), part("undo"), part("finish"), quick=True)


def test_put_back_goes_on_when_a_part_of_it_fails(spark, users):
    def run(*sinks):
        return Flow(spark, [Source("s", users)], [Target(s, name=str(i)) for i, s in enumerate(sinks)]).run()

    report = run(_Stubborn("undo"), _Stubborn(), _Stubborn("commit", "discard"), _Stubborn())
    assert report.status == "failed" and "commit refused" in report.error
    assert report.targets == {
        "0": "written, could not be put back: undo refused", "1": "restored",
        "2": "unchanged, leftovers stay: discard refused", "3": "unchanged",
    }
    report = run(_Stubborn("finish"), _Stubborn())
    assert report.status == "completed"
    assert report.targets == {"0": "written, leftovers stay: finish refused", "1": "written"}


def test_costly_goes_by_nodes_not_by_names(spark, users):
    from sluiceway.plans.flow import costly

    assert not costly(users.select(F.col("id").alias("JoinDate"), F.lit("Sort").alias("Window")))
    assert costly(users.groupBy("id").count()) and costly(users.mapInPandas(lambda parts: parts, users.schema))


# -- previews of joins -----------------------------------------------------------------------------


def _joined(spark):
    people = spark.range(2000).selectExpr("cast(id AS int) AS id", "concat('p', id) AS name")
    orders = spark.range(6000).selectExpr("id AS no", "id % 2000 AS person", "id % 50 AS item")
    items = spark.range(50).selectExpr("id AS item", "concat('i', id) AS title")
    return [
        Source("people", people),
        Source("orders", orders),
        Source("items", items),
        Sql("named", "SELECT no, person AS who, item AS what FROM {prev}", inputs={"prev": "orders"}),
        Sql(
            "joined",
            "SELECT n.no, p.name, i.title FROM {n} n JOIN {p} p ON n.who = p.id, {i} i WHERE i.item = n.what",
            inputs={"n": "named", "p": "people", "i": "items"},
        ),
    ]


def test_a_sample_by_keys_still_joins(spark):
    flow = Flow(spark, _joined(spark))
    whole = set(rows(flow.result()))
    part = set(rows(flow.key_sample(0.3).result()))
    assert part < whole and 0.03 * len(whole) < len(part) < 0.2 * len(whole)
    shown = flow.preview(limit=5, sample_keys=0.3)
    assert [r.status for r in shown] == ["ok"] * 5 and shown[-1].row_count == 5
    assert {tuple(r) for r in shown[-1].sample_data} <= whole
    assert set(rows(flow.key_sample(1.0).result())) == whole
    # every partner of what stays is there: the sample is the whole, filtered by keys
    people = {r["name"] for r in flow.key_sample(0.3).frames()["people"].collect()}
    titles = {r["title"] for r in flow.key_sample(0.3).frames()["items"].collect()}
    assert part == {r for r in whole if r[1] in people and r[2] in titles}


def test_a_sample_by_keys_of_code_steps_and_of_no_joins(spark, users):
    def join(left, right):
        return left.join(right, left["id"] == right["person"], "left")

    people = spark.range(900).selectExpr("id", "concat('p', id) AS name")
    orders = spark.range(900).selectExpr("id AS no", "id AS person")
    flow = Flow(spark, [Source("l", people), Source("r", orders), Code("join", join, inputs={"left": "l", "right": "r"})])
    part = flow.key_sample(0.2).result().collect()
    assert 90 < len(part) < 270 and all(r["no"] == r["id"] for r in part)
    alone = Flow(spark, [Source("s", users), Sql("n", "SELECT id FROM {prev}")])
    assert rows(alone.key_sample(0.01).result()) == [(1,), (2,), (3,)]


def test_a_run_tells_the_rows_of_each_target(spark, users, tmp_path):
    spark.sql("DROP TABLE IF EXISTS told_rows")
    users.limit(0).write.saveAsTable("told_rows")
    told = []
    flow = Flow(
        spark,
        [Source("s", users), Sql("n", "SELECT * FROM {prev} WHERE id > 1")],
        [Target(ReplaceFiles(str(tmp_path / "a")), name="a"), Target(AppendTable("told_rows"), name="b")],
    )
    assert flow.run(progress=lambda *event: told.append(event)).rows == {"a": 2, "b": 2}
    assert told == sorted(told) and {("a", "staged", 2), ("b", "written", 2)} <= set(told)
    spark.sql("DROP TABLE told_rows")
