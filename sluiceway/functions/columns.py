"""Column helpers for code steps: hashing, patterns, JSON, numbers and dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Digest widths of the SHA-2 family by the name Python's hashlib uses.
_SHA2 = {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}


def digest(value: Column, algorithm: str = "sha256") -> Column:
    """Hex digest of the text form; null stays null."""
    text = value.cast("string")
    if algorithm == "md5":
        return F.md5(text)
    if algorithm == "sha1":
        return F.sha1(text)
    if algorithm in _SHA2:
        return F.sha2(text, _SHA2[algorithm])
    raise ValueError(f"Unsupported hash: {algorithm}")


def pattern_group(value: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null where nothing matches."""
    java = pattern.replace("(?P<", "(?<")
    return F.when(value.rlike(java), F.regexp_extract(value, java, group))


def json_text(value: Column, path: str) -> Column:
    """The value at a JSON path as text; null for bad JSON or a missing path."""
    return F.get_json_object(value, path)


def round_half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def trunc_to(value: Column, unit: str) -> Column:
    """Start of the hour, day, month ... as a plain timestamp without a zone."""
    return F.date_trunc(unit, value).cast("timestamp_ntz")
