"""Benchmark decontamination: one automaton over all test windows, one pass over each text.

The automaton reads words: every word of the benchmark has a number, written as two letters, so that a state
has few successors and a window of ten words twenty states at most. Words that no item has are one letter pair that
leads back to the start.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.staging import written
from sluiceway.llm.textbatch import texts_of

# states of one automaton, about 55 bytes each while it is built; more windows are scanned in several passes
STATES = 10_000_000

WINDOW = 10

# word bytes: 0-9, a-z (A-Z lower-cased) and all of UTF-8 beyond ASCII; the rest is blank
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FIRST, _SECOND = 0x10000, 0x80000  # letters of the first and second place, so that no match is off by one
_UNKNOWN = "  "


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Windows:
    """The windows of items as an Aho-Corasick automaton over numbered words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        split = [(item_id, words_of(text)) for item_id, text in items]
        number = {w: k for k, w in enumerate(dict.fromkeys(w for _, words in split for w in words))}
        base = max(1, math.isqrt(len(number)) + 1)
        self.letters = {w: chr(_FIRST + k // base) + chr(_SECOND + k % base) for w, k in number.items()}
        self.automaton = ahocorasick.Automaton()
        for item_id, words in split:
            coded = "".join(map(self.letters.__getitem__, words))
            for at in range(max(1, len(words) - window + 1) if words else 0):
                part = coded[2 * at : 2 * (at + window)]
                held = self.automaton.get(part, None)
                if held is None:
                    self.automaton.add_word(part, (len(part) // 2, {item_id}))
                else:
                    held[1].add(item_id)
        self.some = len(self.automaton) > 0
        if self.some:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges (end exclusive) inside window occurrences, and the items hit."""
        if not self.some:
            return [], set()
        get = self.letters.get
        ranges, items = [], set()
        for end, (length, ids) in self.automaton.iter("".join([get(w, _UNKNOWN) for w in words])):
            stop = (end + 1) // 2
            ranges.append((stop - length, stop))
            items |= ids
        return _merge(ranges), items


# the automaton that this Python worker built last, under the name of its benchmark part
_built: dict[str, Windows] = {}


def _windows(name: str, items: list[tuple[str | None, bytes]], window: int) -> Windows:
    if name not in _built:
        _built.clear()
        _built[name] = Windows(items, window)
    return _built[name]


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text", pa.string()),
        ("n_words", pa.int64()),
        ("ranges", pa.list_(pa.int64())),
        ("items", pa.list_(pa.string())),
    ]
)


def _scan(items, window: int, last: bool):
    """Adds the hits of one automaton; the last pass maps word ranges to spans of the original."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(name, items.value, window)
        for batch in batches:
            counts, found, named = [], [], []
            texts = texts_of(batch.column(1))
            earlier = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            for text, (flat, names) in zip(texts, earlier, strict=True):
                words = words_of(text)
                counts.append(len(words))
                ranges, ids = windows.hits(words)
                ranges = _merge(ranges + list(zip(flat[::2], flat[1::2], strict=True)))
                found.append([x for pair in ranges for x in pair])
                named.append(sorted({name for name in ids if name is not None} | set(names)))
            if last:
                found = [_spans(text, flat) for text, flat in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.nulls(len(counts), pa.string()) if last else batch.column(1).cast(pa.string()),
                    pa.array(counts, pa.int64()),
                    pa.array(found, pa.list_(pa.int64())),
                    pa.array(named, pa.list_(pa.string())),
                ],
                schema=_SCHEMA,
            )

    return run


def _spans(text: bytes, ranges: list[int]) -> list[int]:
    """Word ranges and, after each, its code-point span in the original text."""
    if not ranges:
        return []
    places = [m.span() for m in _WORD.finditer(text.decode("utf-8"))]
    out = []
    for a, b in zip(ranges[::2], ranges[1::2], strict=True):
        out += [a, b, places[a][0], places[b - 1][1]]
    return out


def _item_parts(benchmark: DataFrame, window: int, states: int, id_col: str, text_col: str) -> Iterator:
    """The items as broadcast lists, each with windows of at most about ``states`` states; one at least."""
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")
    ).where("text is not null")
    n_words = F.size(F.regexp_extract_all("text", F.lit(_WORD.pattern), F.lit(0)))
    windows = F.greatest(n_words - window + 1, F.least(n_words, F.lit(1)))
    size = items.agg(F.sum((2 * F.least(n_words, F.lit(window)) * windows).cast("long"))).first()[0] or 0
    count = max(1, -(-int(size) // states))
    for shard in range(count):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == shard)
        yield spark.sparkContext.broadcast([(r.item, r.text.encode("utf-8")) for r in part.toLocalIterator()])


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    states: int = STATES,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, with all columns, in which no word is hit (see ``contamination``).

    Every row is judged by its own text as it streams by, whether it has an id or not; nothing is shuffled.
    """
    for sent in _item_parts(benchmark, window, states, item_id_col, item_text_col):
        docs = docs.where(_clean(sent, window)(F.col(text_col).cast("string")))
    return docs


def _clean(items, window: int):
    """True for texts in which no word is hit."""
    name = uuid.uuid4().hex

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = _windows(name, items.value, window)
        for column in texts:
            yield pa.array([not windows.hits(words_of(text))[0] for text in texts_of(column)], pa.bool_())

    return clean


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    states: int = STATES,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``items`` and ``spans`` for every document row.

    Words are runs of letters, digits and characters beyond ASCII, A-Z
    lower-cased. A word is hit when it lies inside an occurrence of ``window``
    consecutive words of an item, or of a whole item of fewer words. ``items``
    are the ids of items with occurring windows, sorted as text; ``spans`` are
    structs ``start``, ``stop`` of code points of the original text.

    Null texts have no words. Repeated rows are judged one by one. An item without an
    id still hits words, but cannot be named. An empty benchmark hits
    nothing. The benchmark's size is measured first: items of up to ``states`` states in all make one automaton, which
    every Python worker builds once; more items make several, each in a pass over all documents, with one table
    written in between.
    """
    parts = list(_item_parts(benchmark, window, states, item_id_col, item_text_col))
    frame = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<long>)").alias("ranges"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    for shard, sent in enumerate(parts):
        last = shard == len(parts) - 1
        frame = frame.mapInArrow(
            _scan(sent, window, last),
            "doc_id long, text string, n_words long, ranges array<long>, items array<string>",
        )
        if not last:
            frame = written(frame, "contamination")
    parts = F.transform(
        F.sequence(F.lit(0), F.expr("size(ranges) div 4 - 1")), lambda k: F.slice("ranges", k * 4 + 1, 4)
    )
    spans = F.when(F.size("ranges") == 0, F.expr("array()")).otherwise(parts)
    return frame.select("doc_id", "n_words", "items", spans.alias("parts")).select(
        "doc_id",
        "n_words",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p[1] - p[0]).alias("n_hit"),
        "items",
        F.transform("parts", lambda p: F.struct(p[2].alias("start"), p[3].alias("stop"))).alias("spans"),
    )
