"""Secret scans: one automaton passes once over the bytes of each text and tells where rules are triggered.

From the end of a trigger its reversed automaton reads back to the start of the match, and the
automaton of the whole rule reads on from there to its end. No byte of a match is read for another match of
its rule, so long texts cost in proportion to their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.automaton import Automaton
from sluiceway.llm.textbatch import pieces, texts_of

PIECE = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret; all regexes but ``tail`` are over bytes and have what ``automaton`` reads.

    ``trigger`` is a beginning of every match, at its earliest end: triggers that begin later must not end
    earlier. It may be much shorter than the least match, which keeps the joint automaton small. ``pattern`` is the whole match, the longest one counts, as with greedy repeats.
    A match that is not one of ``kept`` too is dropped, but its place is used up. ``tail``
    goes on from the end of a match, over code points.
    """

    kind: str
    pattern: str
    trigger: str
    kept: str | None = None
    tail: str | None = None


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
# fixed values: the three base rules, and forms of well-known credentials
BASE_RULES = (
    Rule("assign", _ASSIGN + "+", _ASSIGN, kept=_ASSIGN + "{8,}"),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]", kept=r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}", r"[0-9a-f]{16}"),
)
# what stands between the pieces of a key's body: white space, escaped line ends, marks of quotations and strings
_GAP = r"""(?:[\s>#*|"'`,;]|\\+[nrt]|<br ?/?>)"""
# after BEGIN a key runs to the next END line, whatever the body looks like. If another marker or the end of
# the text comes first: over header lines and base64 pieces of 20 letters, and a shorter one that
# ends its line; words that follow stay
_BEGIN = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
_BODY = (
    r"(?:(?:[^-]|-(?!----(?:BEGIN|END)\x20))*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_GAP}*+(?:[A-Z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)+|Comment|Version|Subject):[^\r\n\\]*+)*+"
    rf"(?:(?:{_GAP}*+[A-Za-z0-9+/=]{{20,}}+)++|(?=[^\S\n]*[\n\\]))"
    rf"(?:{_GAP}*+[A-Za-z0-9+/=]{{1,19}}+(?=[^\S\n]*(?:[\n\\\"'`.,;…]|\Z)))?|)"
)
_JWT = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
_LOGIN = r"[a-z][a-z0-9+.-]*://[^\x00-\x20:/@]+:[^\x00-\x20:/@]+@"
MORE_RULES = (
    Rule("private_key", _BEGIN, _BEGIN, tail=_BODY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-[A-Za-z0-9-]"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", r"AIza[A-Za-z0-9_-]"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", r"[rs]k_live_[A-Za-z0-9]"),
    Rule("jwt", _JWT, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]"),
    Rule("url_login", _LOGIN, _LOGIN),
)
RULES = BASE_RULES + MORE_RULES


class Scanner:
    """The triggers of all rules in one searching automaton, and two placed automata for each rule."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.kinds = [rule.kind for rule in rules]
        self.triggers = Automaton([rule.trigger for rule in rules])
        self.starts = [Automaton([rule.trigger], searching=False, backward=True) for rule in rules]
        self.wholes = [Automaton([rule.pattern, rule.kept or rule.pattern], searching=False) for rule in rules]
        self.tails = [rule.tail and re.compile(rule.tail) for rule in rules]

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) in code points of the matches of each text, in this order."""
        rows: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        ends: dict[tuple[int, int], list[int]] = {}
        for owner, end, mask in self.triggers.events(texts):
            while mask:
                low = mask & -mask
                ends.setdefault((owner, low.bit_length() - 1), []).append(end)
                mask ^= low
        points: dict[int, _Points] = {}
        for (owner, k), found in ends.items():
            if owner not in points:
                points[owner] = _Points(texts[owner])
            rows[owner] += [(a, k, b) for a, b in self._of_rule(k, np.array(found), points[owner])]
        return [sorted(row) for row in rows]

    def _of_rule(self, k: int, ends: np.ndarray, points: _Points) -> Iterator[tuple[int, int]]:
        """Leftmost, non-overlapping matches; ``ends`` are where the rule's triggers end, ascending."""
        data, at, free = points.data, 0, 0
        while at < len(ends):
            start, _ = self.starts[k].walk(data, int(ends[at]), free)
            end, seen = self.wholes[k].walk(data, start, len(data)) if start >= 0 else (-1, 0)
            if not seen & 1:
                at += 1
                continue
            a, b = points.of(start), points.of(end)
            if self.tails[k]:
                b = self.tails[k].match(points.text, b).end()
                end = points.byte(b)
            if seen & 2:
                yield a, b
            free = end
            at = int(np.searchsorted(ends, free, side="right"))


class _Points:
    """A text as bytes, and as code points once they are asked for."""

    def __init__(self, data: bytes):
        self.data = data
        # where each code point begins; None if every byte is one
        self.begins = None
        if not data.isascii():
            self.begins = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)

    @property
    def text(self) -> str:
        if not hasattr(self, "_text"):
            self._text = self.data.decode("utf-8")
        return self._text

    def of(self, byte: int) -> int:
        return byte if self.begins is None else int(np.searchsorted(self.begins, byte))

    def byte(self, point: int) -> int:
        if self.begins is None:
            return point
        return int(self.begins[point]) if point < len(self.begins) else len(self.data)


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


_SCHEMA = pa.schema(
    [
        ("kinds", pa.list_(pa.string())),
        ("starts", pa.list_(pa.int64())),
        ("stops", pa.list_(pa.int64())),
    ]
)


def _scan(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            rows: list[list[tuple[int, int, int]]] = []
            for first, stop in pieces(texts, PIECE):
                rows += scanner.spans(texts[first:stop])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([[scanner.kinds[k] for _, k, _ in r] for r in rows], pa.list_(pa.string())),
                    pa.array([[a for a, _, _ in r] for r in rows], pa.list_(pa.int64())),
                    pa.array([[b for _, _, b in r] for r in rows], pa.list_(pa.int64())),
                ],
                schema=pa.schema([("doc_id", batch.column(0).type), *_SCHEMA]),
            )

    return run


def find_secrets(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id`` and ``secrets`` for every row.

    ``secrets`` is an array of structs ``kind``, ``start``, ``stop`` (code points, end
    exclusive), ordered by start, then by the order of the rules. Spans of different
    kinds may overlap. Null and empty texts have none; repeated rows are
    scanned one by one; an empty table gives no rows.
    """
    found = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(
        _scan(compiled(rules)),
        "doc_id long, kinds array<string>, starts array<long>, stops array<long>",
    )
    return found.select(
        "doc_id",
        F.arrays_zip(
            F.col("kinds").alias("kind"), F.col("starts").alias("start"), F.col("stops").alias("stop")
        ).alias("secrets"),
    )


def _redact(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scan(scanner)
        for batch in batches:
            found = next(scan(iter([batch])))
            texts = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                kinds, starts, stops = (found.column(c)[k].as_py() for c in (1, 2, 3))
                out, at = [], 0
                for kind, a, b in zip(kinds, starts, stops, strict=True):
                    if a >= at:
                        out += [text[at:a], f"[{kind} removed]"]
                    at = max(at, b)
                texts.append("".join([*out, text[at:]]) if kinds else text)
            columns = [c if i != 1 else pa.array(texts, pa.string()) for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def redact_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All rows and columns, secrets in ``text_col`` replaced by ``[kind removed]``.

    Overlapping spans are replaced together, under the first one's kind. Null texts stay null.
    """
    ordered = [id_col, text_col, *(c for c in docs.columns if c not in (id_col, text_col))]
    frame = docs.select(ordered).withColumn(text_col, F.col(text_col).cast("string"))
    return frame.mapInArrow(_redact(compiled(rules)), frame.schema).select(docs.columns)
