"""Which step of a flow a failing job stems from.

While a step is built, everything it makes carries a mark: Spark keeps it as the origin of
column expressions, SQL text is remembered as it was given to Spark, and Python functions add it to
the exceptions they raise on the executors. The error of a job that fails later, when all
steps run fused, leads back to the step by whichever of these it holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from types import CodeType, FunctionType

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

_FRAGMENT = "flow step"
_ORIGIN = "org.apache.spark.sql.catalyst.trees.PySparkCurrentOrigin"
_FRAME = re.compile(r'File "([^"]+)", line (\d+), in (\S+)')


@dataclass
class Trace:
    """What was made while one step was built."""

    mark: str
    place: int = 0
    statements: list[str] = field(default_factory=list)


_current: ContextVar[Trace | None] = ContextVar("sluiceway_step", default=None)


@contextmanager
def building(spark: SparkSession, trace: Trace) -> Iterator[Trace]:
    """Everything made inside belongs to ``trace``."""
    token = _current.set(trace)
    try:
        origin = getattr(spark._jvm, _ORIGIN)
        origin.set(_FRAGMENT, trace.mark)
    except (AttributeError, TypeError, Py4JError):  # a session without origins: other marks remain
        origin = None
    try:
        yield trace
    finally:
        if origin is not None:
            origin.clear()
        _current.reset(token)


def remembered(statement: str) -> str:
    """SQL text as it goes to Spark; errors tell their place in it.

    Each step's text begins after another number of line breaks, so that equal texts have other places.
    """
    trace = _current.get()
    if trace is None:
        return statement
    trace.statements.append("\n" * trace.place + statement)
    return trace.statements[-1]


def marked(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``fn`` over batches, whose exceptions carry the mark of the step that is being built."""
    trace = _current.get()
    if trace is None:
        return fn
    mark = trace.mark

    def run(parts: Iterator) -> Iterator:
        try:
            yield from fn(parts)
        except Exception as error:
            error.add_note(mark)
            raise

    return run


def _code_of(found: object, seen: set[int], out: list[CodeType]) -> None:
    """Code of a function, of those written inside it, and of those it holds."""
    if id(found) in seen:
        return
    seen.add(id(found))
    if isinstance(found, CodeType):
        out.append(found)
        for constant in found.co_consts:
            _code_of(constant, seen, out)
    elif isinstance(found, FunctionType):
        _code_of(found.__code__, seen, out)
        for cell in found.__closure__ or ():
            try:
                _code_of(cell.cell_contents, seen, out)
            except ValueError:  # an empty cell
                continue


def _texts_of(fn: object) -> Iterator[str]:
    codes: list[CodeType] = []
    _code_of(fn, set(), codes)
    for code in codes:
        yield from (c for c in code.co_consts if isinstance(c, str))


def _in_code(fn: object, frames: list[tuple[str, int, str]]) -> bool:
    codes: list[CodeType] = []
    _code_of(fn, set(), codes)
    for code in codes:
        lines = [line for _, _, line in code.co_lines() if line is not None]
        for path, line, name in frames:
            if path == code.co_filename and name == code.co_name and min(lines) <= line <= max(lines):
                return True
    return False


def _one(places: list[int]) -> int | None:
    """The place, if it is the only one."""
    return places[0] if len(set(places)) == 1 else None


def culprit(error: Exception, traces: Mapping[int, Trace], functions: Mapping[int, object]) -> int | None:
    """The place of the step that ``error`` stems from, None where the error does not tell.

    ``functions`` has the Python functions of code steps.
    """
    message = str(error)
    if isinstance(error, PySparkException):
        for context in error.getQueryContext():
            kind = context.contextType().name
            if kind == "DataFrame" and context.fragment() == _FRAGMENT:
                found = _one([i for i, trace in traces.items() if trace.mark == context.callSite()])
            elif kind == "SQL":
                text, start, stop = context.fragment(), context.startIndex(), context.stopIndex()
                found = _one(
                    [i for i, trace in traces.items() for s in trace.statements if s[start : stop + 1] == text]
                )
                if found is None:  # text given to Spark inside a code step
                    found = _one([i for i, fn in functions.items() if any(text in t for t in _texts_of(fn))])
            else:
                found = None
            if found is not None:
                return found
    noted = _one([i for i, trace in traces.items() if trace.mark in message])
    if noted is not None:
        return noted
    frames = [(path, int(line), name) for path, line, name in _FRAME.findall(message)]
    return _one([i for i, fn in functions.items() if _in_code(fn, frames)])
