"""Declarative table flows on Spark: source -> named steps -> checked target."""

from sluiceway.session import build_session, new_scratch_path, scratch_root

__all__ = ["build_session", "new_scratch_path", "scratch_root"]
