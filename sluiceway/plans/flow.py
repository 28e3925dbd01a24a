"""A flow: sources, steps and targets, each step a lazy frame.

The lineage of the frames is the graph. A step can only name earlier steps, so
there is nothing to sort and no cycle can be written.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F

from sluiceway.operators.contracts import (
    Check,
    Status,
    TargetColumn,
    columns_of,
    full_checks,
    schema_findings,
)
from sluiceway.operators.sqlsteps import StepError, relation_name
from sluiceway.plans.blame import Trace, building, culprit
from sluiceway.plans.joinkeys import in_sample, shared_keys
from sluiceway.plans.steps import Code, Given, Source, Step, Target
from sluiceway.session import new_scratch_path
from sluiceway.sinks.base import Folder, Pending, held_columns
from sluiceway.sinks.files import DryRun
from sluiceway.sinks.progress import watched
from sluiceway.sources.tables import guard_row_count

METRIC_COLUMNS = (
    "position int, step string, status string, duration_ms bigint, "
    "row_count bigint, col_count bigint, message string"
)
class FlowError(ValueError):
    """The steps do not form a flow."""


@dataclass
class StepResult:
    """What a preview shows of one step."""

    node_id: str
    status: str
    schema: list[dict] = field(default_factory=list)
    sample_data: list[Row] = field(default_factory=list)
    validation: dict = field(default_factory=lambda: {"valid": True})
    duration_ms: int = 0

    @property
    def row_count(self) -> int:
        return len(self.sample_data)

    @property
    def col_count(self) -> int:
        return len(self.schema)


@dataclass
class StepMetric:
    position: int
    step: str
    status: str
    duration_ms: int | None
    row_count: int | None
    col_count: int
    message: str | None = None


@dataclass
class RunReport:
    """Outcome of a run; ``rows`` counts per target.

    ``targets`` tells of each target whether it was written, was skipped by a
    dry run, stayed unchanged (no rows, or a failed run), or was restored after a failure.
    """

    status: str
    rows_processed: int = 0
    total_rows: int = 0
    error: str | None = None
    rows: dict[str, int] = field(default_factory=dict)
    targets: dict[str, str] = field(default_factory=dict)
    steps: list[StepMetric] = field(default_factory=list)

    def metrics(self, spark: SparkSession) -> DataFrame:
        """The step metrics as rows, to be filtered like any other table."""
        return spark.createDataFrame([Row(**asdict(m)) for m in self.steps], METRIC_COLUMNS)


def _shown_schema(df: DataFrame) -> list[dict]:
    return [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]


def _failure(message: str) -> dict:
    return {"valid": False, "errors": [{"type": "execution_error", "message": message}]}


def _as_error(check: Check) -> dict:
    return {
        "type": check.rule,
        "column": check.column,
        "expected": check.expected,
        "actual": check.actual,
        "message": check.message,
    }


class Flow:
    def __init__(
        self, spark: SparkSession, steps: Sequence[Step], targets: Sequence[Target] = ()
    ):
        self.spark = spark
        self.steps = list(steps)
        self.targets = list(targets)
        self._place = {step.name: i for i, step in enumerate(self.steps)}
        self._traces: dict[int, Trace] = {}
        self._relations = [relation_name(s.name, i) for i, s in enumerate(self.steps)]
        self._inputs = [self._named_inputs(i) for i in range(len(self.steps))]
        self._reads = [self._read_by(i) for i in range(len(self.steps))]
        self._check_shape()

    # -- shape ---------------------------------------------------------------

    def _named_inputs(self, i: int) -> dict[str, int]:
        step = self.steps[i]
        if isinstance(step, Source):
            return {}
        if not step.inputs:
            if i == 0:
                raise FlowError(f"Step '{step.name}' has no input")
            return {"default": i - 1}
        named = {}
        for name, earlier in step.inputs.items():
            if self._place.get(earlier, i) >= i:
                raise FlowError(f"Step '{step.name}' must read an earlier step, not '{earlier}'")
            named[name or "default"] = self._place[earlier]
        return named

    def _read_by(self, i: int) -> set[int]:
        step = self.steps[i]
        named = {j for j in range(i) if step.mentions(self._relations[j])}
        if i > 0 and step.mentions("source_0"):
            named.add(0)
        if i > 0 and step.mentions("{prev}") and "prev" not in self._inputs[i]:
            named.add(self._inputs[i].get("default", i - 1))
        return named | set(self._inputs[i].values())

    def _check_shape(self) -> None:
        if not self.steps:
            raise FlowError("A flow needs at least one step")
        if len(self._place) != len(self.steps):
            raise FlowError("Step names must differ")
        if len({target.name for target in self.targets}) != len(self.targets):
            raise FlowError("Target names must differ")
        for target in self.targets:
            if target.step is not None and target.step not in self._place:
                raise FlowError(f"Target '{target.name}' reads unknown step '{target.step}'")
        read = set().union(*self._reads) | {self._place_of(t) for t in self.targets}
        orphans = [
            step.name
            for i, step in enumerate(self.steps)
            if isinstance(step, Source) and i not in read
        ]
        if len(self.steps) > 1 and orphans:
            raise FlowError(f"Orphaned steps not connected to any other: {orphans}")

    def _place_of(self, target: Target) -> int:
        return len(self.steps) - 1 if target.step is None else self._place[target.step]

    def _lineage(self, places: set[int]) -> list[int]:
        """All steps that the given ones are made from, themselves included."""
        found, open_ = set(), list(places)
        while open_:
            i = open_.pop()
            if i not in found:
                found.add(i)
                open_.extend(self._reads[i])
        return sorted(found)

    # -- frames --------------------------------------------------------------

    def _build(self, i: int, frames: Mapping[int, DataFrame]) -> DataFrame:
        step, named = self.steps[i], self._inputs[i]
        if not step.enabled and named:
            return frames[next(iter(named.values()))]
        relations = {self._relations[j]: frames[j] for j in range(i)}
        if i > 0:
            relations.setdefault("source_0", frames[0])
        bound = {name: self._relations[j] for name, j in named.items()}
        if "prev" not in bound and i > 0:
            bound["prev"] = bound.get("default", self._relations[i - 1])
        given = Given(self.spark, {n: frames[j] for n, j in named.items()}, bound, relations)
        self._traces[i] = Trace(f"[flow step {i}: {step.name}]", i)
        with building(self.spark, self._traces[i]):
            return step.build(given)

    def frames(self) -> dict[str, DataFrame]:
        """Every step's lazy frame by step name. No job runs."""
        built: dict[int, DataFrame] = {}
        for i in range(len(self.steps)):
            built[i] = self._build(i, built)
        return {step.name: built[i] for i, step in enumerate(self.steps)}

    def result(self) -> DataFrame:
        """The last step's lazy frame."""
        return self.frames()[self.steps[-1].name]

    # -- preview -------------------------------------------------------------

    def preview(
        self,
        limit: int = 10,
        contract: Sequence[TargetColumn] = (),
        order_by: str | list[str] | None = None,
        sample_source: int | None = None,
        sample_keys: float | None = None,
    ) -> list[StepResult]:
        """The first rows of each step, up to the first step that fails.

        ``sample_source`` lets every source give only so many rows, for a quick
        look at flows whose steps need all of their input. ``sample_keys`` is for flows that join
        sources: see ``key_sample``. The check against
        the contract comes last.
        """
        if sample_keys is not None:
            return self.key_sample(sample_keys).preview(limit, contract, order_by, sample_source)
        results: list[StepResult] = []
        built: dict[int, DataFrame] = {}
        for i, step in enumerate(self.steps):
            began = time.monotonic()
            try:
                frame = self._build(i, built)
                if sample_source is not None and isinstance(step, Source):
                    frame = frame.limit(sample_source)
                shown = frame if order_by is None else frame.orderBy(order_by)
                rows = shown.limit(limit).collect()
            except Exception as error:  # a step's own function may raise anything
                results.append(
                    StepResult(
                        step.name,
                        "error",
                        validation=_failure(str(error)),
                        duration_ms=_ms(began),
                    )
                )
                return results
            built[i] = frame
            results.append(
                StepResult(
                    step.name, "ok", _shown_schema(frame), rows, duration_ms=_ms(began)
                )
            )
        if contract:
            results.append(self._target_result(built[len(self.steps) - 1], contract))
        return results

    def key_sample(self, share: float) -> Flow:
        """The flow on a part of its sources that still joins.

        Of every key that sources are joined by, the same ``share`` of its values is taken, by hash, in every source
        that has it. What stays of one source thus finds its partners in the others, and each row of an inner join
        over the sample is a row of the whole result. Sources that share no key are taken whole. Groups
        are complete only where they go by such keys.
        """
        built: dict[int, DataFrame] = {}
        for i in range(len(self.steps)):
            built[i] = self._build(i, built)
        sources = {i: built[i] for i, step in enumerate(self.steps) if isinstance(step, Source)}
        taken = dict(sources)
        ends = {len(self.steps) - 1} | {self._place_of(t) for t in self.targets}
        keys = {}
        for end in sorted(ends):
            for key in shared_keys(sources, built[end]):
                keys[tuple(sorted((i, *names) for i, names in key.items()))] = key
        for key in keys.values():
            for i, names in key.items():
                for name in names:
                    taken[i] = taken[i].where(in_sample(name, share))
        steps = [
            replace(step, frame=taken[i], table=None, query=None, columns=None) if i in taken else step
            for i, step in enumerate(self.steps)
        ]
        return Flow(self.spark, steps, self.targets)

    @staticmethod
    def _target_result(df: DataFrame, contract: Sequence[TargetColumn]) -> StepResult:
        failed = [c for c in schema_findings(df, contract) if c.status is Status.FAILED]
        return StepResult(
            "target",
            "error" if failed else "ok",
            [{"name": c.name, "type": c.type} for c in contract],
            validation={"valid": not failed, "errors": [_as_error(c) for c in failed]},
        )

    def preview_frame(
        self, limit: int = 10, order_by: str | list[str] | None = None
    ) -> DataFrame:
        """The first rows of each step as one lazy frame, tagged with the step."""
        parts = []
        for i, (name, frame) in enumerate(self.frames().items()):
            shown = frame if order_by is None else frame.orderBy(order_by)
            parts.append(
                shown.limit(limit).select(
                    F.lit(i).alias("position"), F.lit(name).alias("step"), "*"
                )
            )
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part, allowMissingColumns=True)
        return whole

    # -- run -----------------------------------------------------------------

    def run(
        self,
        row_limit: int | None = None,
        check_data: bool = False,
        strict_types: bool = False,
        tables: Mapping[str, DataFrame] | None = None,
        metrics: bool = False,
        share: str | None = "table",
        progress: Callable[[str, str, int], None] | None = None,
    ) -> RunReport:
        """Check every target, then write every target.

        Nothing is written if a step, the row limit or a check fails. If a write
        fails, targets that were already switched are put back; the report tells the state of
        each: ``written``, ``skipped``, ``unchanged`` or ``restored``, with the reason after it where putting back or
        cleaning up failed. Rows that were
        inserted into a target before another one failed stay and are told as written.
        The report's steps end with the one that failed, also where it did so in a running
        job, if the error leads back to one (see ``plans/blame.py``); ``locate_failure`` finds the others.
        ``row_limit`` holds for every source that leads to a target.
        A target without a declared contract must get the columns that it already has.
        ``check_data`` also counts nulls, lost values, broken keys and orphans.
        ``metrics`` counts the rows of each step during the write; the counters
        stop filters from moving past a step, so they are off by default.
        ``share`` tells how a step that feeds several others is kept while
        several targets are written: ``table`` (written once to the shared scratch
        folder), ``persist``, or None (computed again for each). Steps made of
        scans, filters and expressions alone are computed again in any case, so that
        filters and columns reach the files.
        ``progress`` is called with a target, ``staged`` or ``written``, and the rows that finished tasks
        have written so far, while jobs are running. Files are staged and then moved; inserts are written.
        """
        if not self.targets:
            raise FlowError("A run needs a target")
        began = time.monotonic()
        kept: list[DataFrame] = []
        scratch: list[Folder] = []
        counters: dict[int, Observation] = {}
        pending: list[tuple[Target, Pending]] = []
        built: dict[int, DataFrame] = {}
        rows: dict[str, int] = {}
        told: dict[str, str] = {}
        at: int | None = None
        try:
            wanted = self._lineage({self._place_of(t) for t in self.targets})
            for i in range(len(self.steps)):
                at = i
                frame = self._build(i, built)
                shared = len(self.targets) > 1 and share and self._consumers(i, wanted) > 1
                if i in wanted and shared and costly(frame):
                    frame = self._kept(frame, share, kept, scratch)
                if metrics and i in wanted:
                    counters[i] = Observation(f"step_{i}_{uuid.uuid4().hex}")
                    frame = frame.observe(counters[i], F.count(F.lit(1)).alias("n"))
                built[i] = frame
            at, total = None, None
            if row_limit is not None:
                sources = [i for i in wanted if isinstance(self.steps[i], Source)]
                total = sum(guard_row_count(built[i], row_limit) for i in sources)
            contracts = {
                t.name: self._contract_of(t, built[self._place_of(t)]) for t in self.targets
            }
            self._check_schemas(built, contracts)
            if check_data:
                # computed once; the counts and the write then read the copy
                for i in {self._place_of(t) for t in self.targets if contracts[t.name]}:
                    built[i] = self._kept(built[i], "table", kept, scratch)
                self._check_rows(built, contracts, strict_types, tables or {})
            for target in self.targets:
                with watched(self.spark, _teller(progress, target.name, "staged")):
                    pending.append((target, target.sink.stage(built[self._place_of(target)])))
            # inserts can still fail and go first; the switches follow
            for target, ready in sorted(pending, key=lambda pair: pair[1].quick):
                with watched(self.spark, _teller(progress, target.name, "written")):
                    n = rows[target.name] = ready.commit()
                told[target.name] = (
                    "skipped" if ready.skipped else "written" if n else "unchanged"
                )
        except Exception as error:  # a step's own function may raise anything
            self._put_back(pending, rows, told)
            if at is None:
                at = self._culprit(error)
            return RunReport(
                "failed",
                sum(rows.values()),
                error=str(error),
                rows=rows,
                targets=told,
                steps=self._steps_before(at, built, str(error), _ms(began)),
            )
        else:
            for target, ready in pending:
                try:
                    ready.finish()
                except Exception as error:  # the rows are in; only leftovers stay
                    told[target.name] += f", leftovers stay: {error}"
            written = sum(rows.values())
            try:
                steps = self._metrics(counters, built, _ms(began))
            except Exception:  # all is written; counts that fail do not undo that
                steps = []
            return RunReport(
                "completed",
                written,
                written if total is None or written == 0 else total,
                rows=rows,
                targets=told,
                steps=steps,
            )
        finally:
            for frame in kept:
                frame.unpersist()
            for folder in scratch:
                folder.remove()

    def dry_run(self, **options) -> RunReport:
        """Everything a run does but the write; the targets are told as skipped."""
        skipping = [replace(target, sink=DryRun(target.sink)) for target in self.targets]
        return Flow(self.spark, self.steps, skipping).run(**options)

    def _put_back(
        self, pending: list[tuple[Target, Pending]], rows: dict[str, int], told: dict[str, str]
    ) -> None:
        """After a failed write: drop what is not committed, undo the switches that are.

        A target where that fails is told with the reason, and the others go on.
        """
        for target, ready in pending:
            if target.name not in told:
                told[target.name] = "unchanged"
                try:
                    ready.discard()
                except Exception as error:
                    told[target.name] = f"unchanged, leftovers stay: {error}"
            elif ready.undo is not None and told[target.name] == "written":
                try:
                    ready.undo()
                except Exception as error:
                    told[target.name] = f"written, could not be put back: {error}"
                    continue
                told[target.name] = "restored"
                rows[target.name] = 0
        for target in self.targets:
            told.setdefault(target.name, "unchanged")

    def _steps_before(
        self, at: int | None, built: Mapping[int, DataFrame], message: str, spent: int
    ) -> list[StepMetric]:
        """The step that failed, after those before it. Empty if the error tells of no step."""
        if at is None:
            return []
        before = [
            StepMetric(i, self.steps[i].name, "ok", spent, None, len(frame.columns))
            for i, frame in built.items()
            if i < at
        ]
        return [*before, StepMetric(at, self.steps[at].name, "error", spent, None, 0, message)]

    def _culprit(self, error: Exception) -> int | None:
        functions = {i: s.fn for i, s in enumerate(self.steps) if isinstance(s, Code) and i in self._traces}
        return culprit(error, self._traces, functions)

    def locate_failure(self) -> list[StepMetric]:
        """Run the steps one after another, each from the sources, up to the first that fails.

        For failures whose error tells of no step, such as a raised error or one in the rows of a given frame: it
        costs a pass over the sources for every step before the failing one.
        """
        built: dict[int, DataFrame] = {}
        for i in range(len(self.steps)):
            began = time.monotonic()
            try:
                built[i] = self._build(i, built)
                built[i].write.format("noop").mode("overwrite").save()
            except Exception as error:  # a step's own function may raise anything
                return self._steps_before(i, built, str(error), _ms(began))
        return [
            StepMetric(i, self.steps[i].name, "ok", None, None, len(frame.columns)) for i, frame in built.items()
        ]

    def _consumers(self, i: int, wanted: Sequence[int]) -> int:
        """Steps and targets that read step ``i`` on the way to a target."""
        return sum(i in self._reads[j] for j in wanted) + sum(
            self._place_of(t) == i for t in self.targets
        )

    def _kept(
        self, frame: DataFrame, share: str, kept: list[DataFrame], scratch: list[Folder]
    ) -> DataFrame:
        if share == "persist":
            kept.append(frame.persist())
            return kept[-1]
        if share == "table":
            folder = Folder(self.spark, new_scratch_path(self.spark, "shared"))
            scratch.append(folder)
            frame.write.parquet(folder.path)
            return self.spark.read.schema(frame.schema).parquet(folder.path)
        raise FlowError(f"share must be persist, table or None, got: {share}")

    def _contract_of(self, target: Target, frame: DataFrame) -> Sequence[TargetColumn]:
        """What the target declares, else the columns that it has by now."""
        if target.contract:
            return target.contract
        held = held_columns(target.sink, self.spark)
        columns = [] if held is None else columns_of(held)
        if getattr(target.sink, "fill_missing", False):
            return [c for c in columns if c.name in frame.columns]
        return columns

    def _check_schemas(
        self, built: Mapping[int, DataFrame], contracts: Mapping[str, Sequence[TargetColumn]]
    ) -> None:
        for target in self.targets:
            if contracts[target.name]:
                findings = schema_findings(built[self._place_of(target)], contracts[target.name])
                failed = [c.message for c in findings if c.status is Status.FAILED]
                if failed:
                    raise StepError("; ".join(failed))

    def _check_rows(
        self,
        built: Mapping[int, DataFrame],
        contracts: Mapping[str, Sequence[TargetColumn]],
        strict_types: bool,
        tables: Mapping[str, DataFrame],
    ) -> None:
        for target in self.targets:
            if contracts[target.name]:
                frame = built[self._place_of(target)]
                checks = full_checks(frame, contracts[target.name], tables, strict_types)
                # at most one row per rule and column
                bad = checks.where(F.col("status") == Status.FAILED.value).collect()
                if bad:
                    raise StepError("; ".join(row["message"] for row in bad))

    def _metrics(
        self, counters: Mapping[int, Observation], built: Mapping[int, DataFrame], spent: int
    ) -> list[StepMetric]:
        """One entry per step. Spark runs the steps fused, so all share one duration."""
        entries = []
        for i, counter in counters.items():
            try:
                rows = counter.get["n"]
            except Py4JError:  # optimized away, for instance below an empty join side
                rows = built[i].count()
            entries.append(
                StepMetric(i, self.steps[i].name, "ok", spent, rows, len(built[i].columns))
            )
        return entries


_COSTLY = re.compile(r"Join|Aggregate|Window|Sort|Distinct|Repartition|Python|Pandas|Arrow|FlatMap")


def costly(df: DataFrame) -> bool:
    """True if the frame's plan holds a shuffle or Python, by the names of its nodes."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if _COSTLY.search(node.nodeName()):
            return True
        below = node.children()
        todo.extend(below.apply(k) for k in range(below.length()))
    return False


def _teller(
    progress: Callable[[str, str, int], None] | None, target: str, phase: str
) -> Callable[[int], None] | None:
    return None if progress is None else lambda rows: progress(target, phase, rows)


def _ms(began: float) -> int:
    return round((time.monotonic() - began) * 1000)
