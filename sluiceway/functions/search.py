"""Search by an ordered subsequence of characters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters that are special inside a Java character class or outside it.
_SPECIAL = set("\\^$.|?*+()[]{}-&~#")


def _escaped(char: str) -> str:
    return "\\" + char if char in _SPECIAL else char


def subsequence_pattern(query: str) -> str:
    """A pattern that skips to the next wanted character and never goes back.

    ``[^a]*+a[^b]*+b`` reads each text once, where ``.*a.*b`` may retry every
    start on a text that does not match.
    """
    wanted = query.lower()
    return "^" + "".join(f"[^{_escaped(c)}]*+{_escaped(c)}" for c in wanted)


def subsequence_match(value: Column, query: str) -> Column:
    """True where the characters of ``query`` occur in ``value`` in this order.

    Case is ignored; an empty query matches every text.
    """
    return F.lower(value.cast("string")).rlike(subsequence_pattern(query))
