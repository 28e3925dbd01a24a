"""Flows of named steps: preview, run, per-step metrics."""
