"""The kinds of step a flow is made of."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sluiceway.operators import codesteps
from sluiceway.operators.columns import apply_transformations
from sluiceway.operators.contracts import TargetColumn
from sluiceway.operators.sqlsteps import bind_inputs, run_select
from sluiceway.sinks.base import Sink
from sluiceway.sources.tables import read_query, read_table


@dataclass(frozen=True)
class Given:
    """What a step may read: its inputs by name, and all earlier relations."""

    spark: SparkSession
    inputs: Mapping[str, DataFrame]
    input_relations: Mapping[str, str]
    relations: Mapping[str, DataFrame]

    def only(self) -> DataFrame:
        return next(iter(self.inputs.values()))


@dataclass(frozen=True)
class Step:
    """``inputs`` maps input names to earlier steps; none means the step before."""

    name: str
    inputs: Mapping[str, str] = field(default_factory=dict, kw_only=True)
    enabled: bool = field(default=True, kw_only=True)

    def build(self, given: Given) -> DataFrame:
        raise NotImplementedError

    def mentions(self, relation: str) -> bool:
        """True if the step names ``relation`` itself, outside its inputs."""
        return False


@dataclass(frozen=True)
class Source(Step):
    """Rows from a frame, a table or path, or a query (which goes before a table)."""

    frame: DataFrame | None = None
    table: str | None = None
    query: str | None = None
    columns: Sequence[str] | None = None

    def build(self, given: Given) -> DataFrame:
        if self.query is not None:
            return read_query(given.spark, self.query)
        if self.frame is not None:
            return self.frame if self.columns is None else self.frame.select(*self.columns)
        return read_table(given.spark, self.table, self.columns)


@dataclass(frozen=True)
class Sql(Step):
    """One SELECT over ``{prev}``, over ``{<input>}``, or over earlier relations."""

    text: str = ""

    def build(self, given: Given) -> DataFrame:
        return run_select(
            given.spark, bind_inputs(self.text, given.input_relations), given.relations
        )

    def mentions(self, relation: str) -> bool:
        if relation == "{prev}":
            return relation in self.text
        return re.search(rf"(?<!\w){re.escape(relation)}(?!\w)", self.text, re.I) is not None


@dataclass(frozen=True)
class Columns(Step):
    """A list of column mappings and derived columns."""

    transformations: Sequence[Mapping] = ()

    def build(self, given: Given) -> DataFrame:
        return apply_transformations(given.only(), self.transformations)


@dataclass(frozen=True)
class Code(Step):
    """A function from frame to frame; with named inputs, one keyword per input."""

    fn: Callable[..., DataFrame] | None = None

    def build(self, given: Given) -> DataFrame:
        if self.inputs and set(self.inputs) != {"default"}:
            frames = dict(given.inputs)
            return codesteps.transform(lambda _: self.fn(**frames))(given.only())
        return codesteps.transform(self.fn)(given.only())


@dataclass(frozen=True)
class Target:
    """Where a step's rows go, and what the target declares of its columns."""

    sink: Sink
    step: str | None = None  # the last step unless named
    contract: Sequence[TargetColumn] = ()
    name: str = "target"
