"""Incremental runs: only the files that arrived since the last run."""
