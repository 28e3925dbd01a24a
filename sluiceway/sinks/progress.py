"""Rows of a write, told while its job is running."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

EVERY_SECONDS = 0.5


@contextmanager
def watched(spark: SparkSession, tell: Callable[[int], None] | None, every: float = EVERY_SECONDS) -> Iterator[None]:
    """Tells the rows that finished tasks have written so far for the jobs that this thread starts inside.

    ``tell`` is called in another thread, with a count that grows; a task counts once it has ended, and a task that is
    run again counts once. Spark's own counts of its stages are read on the driver, so rows
    are neither counted twice nor sent anywhere. Nothing is told if no count changes. An exception of ``tell``
    ends the telling and leaves the write alone.
    """
    if tell is None:
        yield
        return
    context = spark.sparkContext
    tag = f"rows-{uuid.uuid4().hex}"
    over = threading.Event()

    def run() -> None:
        last, stages = 0, {}
        while True:
            ended = over.wait(every)
            now = _written(context, tag, stages)
            try:
                if now > last:
                    tell(now)
                    last = now
            except Exception:  # whoever listens must not stop the write
                return
            if ended:
                return

    teller = threading.Thread(target=run, name=tag, daemon=True)
    context.addJobTag(tag)
    teller.start()
    try:
        yield
    finally:
        context.removeJobTag(tag)
        over.set()
        teller.join()


def _written(context, tag: str, stages: dict[int, int]) -> int:
    """Rows written by the stages of the jobs with this tag; ``stages`` keeps the largest count of each."""
    core = context._jsc.sc()
    tracker, store = core.statusTracker(), core.statusStore()
    try:
        for job in tracker.getJobIdsForTag(tag):
            info = tracker.getJobInfo(job)
            for stage in info.get().stageIds() if info.isDefined() else []:
                try:
                    rows = store.lastStageAttempt(stage).outputRecords()
                except Py4JError:  # not submitted yet, or forgotten by now
                    continue
                stages[stage] = max(stages.get(stage, 0), rows)
    except Py4JError:  # the session has ended
        pass
    return sum(stages.values())
