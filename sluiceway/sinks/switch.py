"""Switching staged folders into a target so that a lost driver leaves no half state.

Before the first rename an intent record tells what is about to move. A run that finds a record
of an earlier one completes or takes back what that run began: until every part has moved the old
parts come back, after that the new ones stay.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from sluiceway.sinks.base import Folder, WriteError

MOVING, DONE = "moving", "done"


def _beside(path: str, ending: str) -> str:
    return f"{path.rstrip('/')}.{ending}"


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """Names of the ``name=value`` levels below a folder, outermost first."""
    names: list[str] = []
    folder = Folder(spark, path)
    while True:
        below = next((f for f in folder.folders() if "=" in f.name), None)
        if below is None:
            return names
        names.append(below.name.split("=", 1)[0])
        folder = below


def partition_parts(spark: SparkSession, path: str, depth: int) -> list[str]:
    """Relative paths of the partitions ``depth`` levels below a folder."""
    found = [("", Folder(spark, path))]
    for _ in range(depth):
        found = [
            (f"{part}/{below.name}".lstrip("/"), below)
            for part, folder in found
            for below in folder.folders()
            if "=" in below.name
        ]
    return [part for part, _ in found]


@dataclass
class Switch:
    """Parts of a staged folder that take the place of the same parts of a target.

    A part is a relative path, or empty for the whole target. ``had`` are the parts that the target had.
    ``drop`` are parts of the target that go without a new one in their place. ``then`` is a file, with its
    text, that is written once all parts have moved, also if that is found out by a later run.
    """

    spark: SparkSession
    target: str
    staging: str
    old: str
    parts: Sequence[str]
    had: set[str]
    drop: Sequence[str] = ()
    then: tuple[str, str] | None = None

    def _at(self, base: str, part: str) -> Folder:
        return Folder(self.spark, f"{base}/{part}" if part else base)

    def _record(self, state: str) -> None:
        told = {
            "state": state, "staging": self.staging, "old": self.old,
            "parts": list(self.parts), "had": sorted(self.had), "drop": list(self.drop), "then": self.then,
        }
        record = Folder(self.spark, _beside(self.target, "intent"))
        draft = Folder(self.spark, _beside(self.target, f"intent-{uuid.uuid4().hex}"))
        draft.write_text(json.dumps(told))
        record.remove()
        draft.move_to(record.path)

    def run(self) -> None:
        """Move all parts; a failure takes back those that moved."""
        self._record(MOVING)
        try:
            for part in [*self.parts, *self.drop]:
                if part in self.had or part in self.drop:
                    self._move(self._at(self.target, part), self._at(self.old, part))
                if part not in self.drop:
                    self._move(self._at(self.staging, part), self._at(self.target, part))
            self._record(DONE)
            self._tell()
        except Exception:
            self.undo()
            raise

    def _move(self, source: Folder, to: Folder) -> None:
        to.make_parent()
        source.move_to(to.path)

    def _tell(self) -> None:
        if self.then is not None:
            path, text = self.then
            draft = Folder(self.spark, f"{path}.draft")
            draft.write_text(text)
            Folder(self.spark, path).remove()
            draft.move_to(path)

    def undo(self) -> None:
        """Every part as it was before, however far the moves came."""
        self._record(MOVING)  # once begun, an undo is carried on, also by a later run
        if self.then is not None:
            Folder(self.spark, self.then[0]).remove()
        for part in [*self.parts, *self.drop]:
            now, before = self._at(self.target, part), self._at(self.old, part)
            if part in self.had or part in self.drop:
                if before.exists():
                    now.remove()
                    self._move(before, now)
            elif not self._at(self.staging, part).exists():
                now.remove()
        self._clean()

    def finish(self) -> None:
        """Drop the old parts and the record; the new parts stay."""
        self._clean()

    def complete(self) -> None:
        """What a lost run left to do after its last move."""
        self._tell()
        self.finish()

    def _clean(self) -> None:
        Folder(self.spark, self.staging).remove()
        Folder(self.spark, self.old).remove()
        Folder(self.spark, _beside(self.target, "intent")).remove()


def staged(spark: SparkSession, target: str) -> str:
    """A fresh path beside a target."""
    return _beside(target, f"staging-{uuid.uuid4().hex}")


def switch(
    spark: SparkSession,
    target: str,
    staging: str,
    parts: Iterable[str],
    drop: Iterable[str] = (),
    then: tuple[str, str] | None = None,
) -> Switch:
    """The switch of ``parts`` of a staged folder; the target's state is looked at now."""
    parts = list(parts)
    base = target.rstrip("/")
    had = {part for part in parts if Folder(spark, f"{base}/{part}" if part else base).exists()}
    old = staging.replace(".staging-", ".old-")
    return Switch(spark, base, staging, old, parts, had, list(drop), then)


def recover(spark: SparkSession, target: str) -> str | None:
    """Complete or take back the switch that a lost run left behind; what was done, if anything.

    Nothing happens without a record. Call it when no other run is writing to the target: the sinks do so before
    they look at it, because two runs that replace the same target at once exclude each other anyway.
    """
    record = Folder(spark, _beside(target, "intent"))
    if not record.exists():
        # the record itself was being put in place
        drafts = [f for f in record.siblings() if f.name.startswith(f"{record.name}-")]
        if not drafts:
            return None
        try:
            json.loads(drafts[0].read_text())
        except ValueError:
            for draft in drafts:  # cut short, thus before any move
                draft.remove()
            return None
        drafts[0].move_to(record.path)
    try:
        told = json.loads(record.read_text())
    except ValueError as error:
        raise WriteError(f"{record.path} is not a record of a switch") from error
    for draft in record.siblings():
        if draft.name.startswith(f"{record.name}-"):
            draft.remove()
    found = Switch(
        spark, target.rstrip("/"), told["staging"], told["old"], told["parts"], set(told["had"]), told["drop"],
        None if told["then"] is None else tuple(told["then"]),
    )
    if told["state"] == DONE:
        found.complete()
        return "completed"
    found.undo()
    return "taken back"


def leftovers(spark: SparkSession, target: str, older_than_hours: float = 24) -> list[str]:
    """Staged folders of lost runs that never began to switch; they can be removed if no run is writing."""
    base = Folder(spark, target.rstrip("/"))
    return sorted(
        f.path
        for f in base.siblings()
        if f.name.startswith(f"{base.name}.staging-") and f.age_hours() >= older_than_hours
    )
