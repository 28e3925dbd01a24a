"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, report, end of clause).
Small transducers read them side by side, on and back, and each multiplies the weight
of a matched word: an insult near a target counts more, a negated one or one in a
clause of reported speech counts less, a threat counts only with its target. The
composed transducer is one table. A clause scores the sum of its matches, a
document its clauses. Insult words and stems, and the curve from evidence to
a score, are learned from labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.staging import written
from sluiceway.llm.textbatch import shingle_sets, texts_of

# bounds of the labelled sample that is learned from, and of the learned lexicon
TOXIC_ROWS = 4_000
CLEAN_ROWS = 8_000
LEXICON_ROWS = 4_000

# a feature is learned when its G-squared and its log odds reach these
LEAST_G2 = 16.0
LEAST_LOG_ODDS = 1.5
STEM_LENGTHS = range(3, 13)

# weight of a listed insult that the labels say nothing about, and of a threat
LISTED_WEIGHT = 3.0

# fixed values: the words of the grammar
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic "
    "disgusting clown clowns imbecile fool ugly filthy vermin".split()
)
THREATS = frozenset("kill hurt destroy murder beat stab shoot punish attack".split())
TARGETS = frozenset("you your yours they them their he she his her him people everyone".split())
NEGATIONS = frozenset("not no never nobody isn aren wasn weren without nicht kein pas jamais nunca".split())
REPORTS = frozenset("said says claimed claims called calls wrote reported reports quoted alleged".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP = range(7)

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")


@dataclass(frozen=True)
class Transducer:
    """``before[state][symbol]`` is the next state reading on, ``after`` the one reading back.

    ``gain[i][j][symbol]`` multiplies a match that is reached in state i from the left and in
    state j from the right. State 0 is the start of both, and where a stop leads.
    """

    before: tuple[tuple[int, ...], ...]
    after: tuple[tuple[int, ...], ...]
    gain: tuple[tuple[tuple[float, ...], ...], ...]


NOWHERE = ((0,) * 7,)  # a side that is not looked at


def _window(opener: int, reach: int) -> tuple[tuple[int, ...], ...]:
    """Moves with states above 0 for ``reach`` words after ``opener``; a stop closes them."""
    return tuple(
        tuple(reach if s == opener else 0 if s == STOP else max(0, state - 1) for s in range(7))
        for state in range(reach + 1)
    )


def _held(opener: int) -> tuple[tuple[int, ...], ...]:
    """Moves with state 1 from ``opener`` to the next stop."""
    return tuple(tuple(1 if s == opener else 0 if s == STOP else state for s in range(7)) for state in range(2))


def _sided(before, after, gain) -> Transducer:
    """``gain`` of a symbol, whether something stands before it and whether something stands after it."""
    return Transducer(
        before,
        after,
        tuple(
            tuple(tuple(gain(s, i > 0, j > 0) for s in range(7)) for j in range(len(after)))
            for i in range(len(before))
        ),
    )


def _side(a, b):
    n = len(b)
    return tuple(tuple(x[s] * n + y[s] for s in range(7)) for x in a for y in b)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both transducers reading the same symbols, gains multiplied."""
    return Transducer(
        _side(a.before, b.before),
        _side(a.after, b.after),
        tuple(
            tuple(tuple(x[s] * y[s] for s in range(7)) for x in left for y in right)
            for left in a.gain
            for right in b.gain
        ),
    )


def _negated(s: int, before: bool, after: bool) -> float:
    return 0.3 if before and s in (INSULT, THREAT) else 1.0


def _targeted(s: int, before: bool, after: bool) -> float:
    if s == THREAT:
        return 1.0 if before or after else 0.0
    return 1.25 if before and s == INSULT else 1.0


def _reported(s: int, before: bool, after: bool) -> float:
    return 0.5 if (before or after) and s in (INSULT, THREAT) else 1.0


GRAMMAR = compose(
    compose(
        _sided(_window(NEGATION, 2), NOWHERE, _negated),
        _sided(_window(TARGET, 4), _held(TARGET), _targeted),
    ),
    _sided(_window(REPORT, 12), _window(REPORT, 12), _reported),
)


@dataclass
class Model:
    """``words`` and ``stems`` (proper prefixes) to weights, and the curve's coefficients.

    A threat counts with a target before or after it in the clause, and a report discounts from either side.
    """

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-3.0, 2.0, 0.5, -0.1)

    def weight(self, word: str) -> float:
        """Of the word itself, else of its longest known stem, else of the list."""
        if word in self.words:
            return self.words[word]
        for n in range(min(len(word) - 1, STEM_LENGTHS[-1]), STEM_LENGTHS[0] - 1, -1):
            if word[:n] in self.stems:
                return self.stems[word[:n]]
        return LISTED_WEIGHT if word in INSULTS else 0.0


class _Lexicon(dict):
    """Word to (symbol, weight); filled as words are met, emptied when it grows large."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str):
        if len(self) > 100_000:
            self.clear()
        weight = self.model.weight(word)
        if weight:
            found = (INSULT, weight)
        elif word in THREATS:
            found = (THREAT, LISTED_WEIGHT)
        elif word in TARGETS:
            found = (TARGET, 0.0)
        elif word in NEGATIONS:
            found = (NEGATION, 0.0)
        elif word in REPORTS:
            found = (REPORT, 0.0)
        else:
            found = (OTHER, 0.0)
        self[word] = found
        return found


_STOPS = frozenset(".!?;:\n")


def _clause(symbols, matches, stop: int, grammar: Transducer) -> list[float]:
    """Scores of a clause's matches: read back from its stop, each match meets the state kept for it."""
    scores, state, at = [], 0, stop - 1
    for place, before in reversed(matches):
        while at > place:
            state = grammar.after[state][symbols[at][0]]
            at -= 1
        symbol, weight = symbols[place]
        scores.append(weight * grammar.gain[before][state][symbol])
    return scores[::-1]


def evidence(text: str, lexicon: _Lexicon) -> tuple[float, int, int, list[float]]:
    """Evidence, matches and words of a text, and the scores of its clauses with a match."""
    tokens = TOKEN.findall(text.lower())
    symbols = [(STOP, 0.0) if t in _STOPS else lexicon[t] for t in tokens]
    total, hits, clauses = 0.0, 0, []
    if any(weight for _, weight in symbols):
        grammar = GRAMMAR
        state, matches = 0, []
        # a stop at the end closes the last clause
        for at, (symbol, weight) in enumerate([*symbols, (STOP, 0.0)]):
            if weight:
                matches.append((at, state))
            elif symbol == STOP and matches:
                scores = _clause(symbols, matches, at, grammar)
                hits += sum(score > 0 for score in scores)
                if clause := sum(scores):
                    clauses.append(clause)
                matches = []
            state = grammar.before[state][symbol]
        total = math.fsum(clauses)
    return total, hits, len(symbols), clauses


def _inputs(total, hits, words) -> np.ndarray:
    return np.column_stack(
        (
            np.ones(len(total)),
            np.log1p(np.asarray(total, dtype=float)),
            np.log1p(np.asarray(hits, dtype=float)),
            np.log1p(np.asarray(words, dtype=float)) / 4,
        )
    )


def _fit_curve(total, hits, words, toxic) -> tuple[float, ...]:
    """Ridge-penalised logistic regression by Newton steps."""
    x, y = _inputs(total, hits, words), np.asarray(toxic, dtype=float)
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-6, 0.05, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - ridge @ beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def _features(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in STEM_LENGTHS if n < len(word))]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least shingle hash, equal for most near copies."""
    for batch in batches:
        low = [
            int(s[:1].view(np.int64)[0]) if len(s) else 0
            for s in shingle_sets(texts_of(batch.column(1)), 5)
        ]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(low, pa.int64())], names=[*batch.schema.names, "sign"]
        )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many toxic and clean texts each word and stem occurs."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush():
        names = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array([counts[1][n] for n in names], pa.int64()),
                pa.array([counts[0][n] for n in names], pa.int64()),
            ],
            names=["feature", "toxic", "clean"],
        )
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for text, label in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            found = set()
            for word in set(TOKEN.findall(text.decode("utf-8").lower())):
                if word not in _STOPS:
                    found.update(_features(word))
            counts[1 if label else 0].update(found)
            if len(counts[0]) + len(counts[1]) > 150_000:
                yield flush()
    yield flush()


def held_out(id_col: str) -> Column:
    """Rows never learned from: crc32 of the id as text is a multiple of 5."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, toxic`` of a bounded sample of the labelled rows outside the held-out part.

    Up to TOXIC_ROWS toxic and CLEAN_ROWS clean rows, those of the ids of smallest hash; of the rows of
    an id the one with the least text stays, and of near copies one. Contradicting labels of an id count as toxic.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .where(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    chosen = None
    for condition, rows in (("toxic = 1", TOXIC_ROWS), ("toxic <> 1", CLEAN_ROWS)):
        part = known.where(condition).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most TOXIC_ROWS + CLEAN_ROWS pairs of numbers are sent
    sample = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).join(F.broadcast(chosen), "doc_id")
    signed = written(
        sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
            _signed, "doc_id long, text string, toxic int, sign long"
        ),
        "labelled",
    )
    # the tasks fold repeats before the shuffle, so a row that is repeated often travels once a task
    row = F.struct("doc_id", "text", "toxic", "sign")
    one = signed.groupBy("doc_id").agg(F.min(row).alias("row")).select("row.*")
    return one.groupBy("sign").agg(F.min(row).alias("row")).select("row.doc_id", "row.text", "row.toxic")


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Insult words, stems and the score's curve, from the labelled sample.

    Without labels of both kinds the listed words and a fixed curve are the model.
    """
    sample = written(labelled_sample(docs, labels, id_col, text_col), "learned-from")
    sizes = {row.toxic: row["count"] for row in sample.groupBy(F.col("toxic") == 1).count()
             .withColumnRenamed("(toxic = 1)", "toxic").collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return Model()
    counts = (
        sample.select("doc_id", "text", (F.col("toxic") == 1).alias("toxic"))
        .mapInArrow(_counted, "feature string, toxic long, clean long")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
        .where("a >= 3")
    )

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = (F.col("a") + F.col("b")) / F.lit(float(toxic + clean))
    g2 = 2 * (
        part(F.col("a"), share * toxic)
        + part(F.col("b"), share * clean)
        + part(toxic - F.col("a"), (1 - share) * toxic)
        + part(clean - F.col("b"), (1 - share) * clean)
    )
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (clean + 1.0))
    chosen = (
        counts.select("feature", g2.alias("g2"), odds.alias("odds"))
        .where((F.col("g2") >= LEAST_G2) & (F.col("odds") >= LEAST_LOG_ODDS))
        .orderBy(F.desc("g2"), "feature")
        .limit(LEXICON_ROWS)
        .collect()
    )
    model = Model(
        {r.feature[:-1]: r.odds for r in chosen if r.feature.endswith("$")},
        {r.feature: r.odds for r in chosen if not r.feature.endswith("$")},
    )
    # five numbers for each row of the bounded sample
    known = sample.select("doc_id", "text", (F.col("toxic") == 1).cast("int").alias("toxic"))
    found = known.mapInArrow(_told(model), "doc_id long, evidence double, hits long, words long, toxic int")
    _, total, hits, words, label = zip(*sorted(tuple(r) for r in found.collect()), strict=True)
    model.curve = _fit_curve(total, hits, words, label)
    return model


def _told(model: Model):
    """What the curve is fitted to: each text's evidence beside its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _Lexicon(model)
        for batch in batches:
            found = [evidence(t.decode("utf-8"), lexicon) for t in texts_of(batch.column(1))]
            total, hits, words = ([f[k] for f in found] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(total, pa.float64()), pa.array(hits, pa.int64()),
                    pa.array(words, pa.int64()), batch.column(2),
                ],
                names=["doc_id", "evidence", "hits", "words", "toxic"],
            )

    return run


_RAW = "doc_id long, evidence double, hits long, words long, clauses array<double>, score double"


def _curve(model: Model, total: list[float], hits: list[int], words: list[int]) -> np.ndarray:
    line = _inputs(total, hits, words) @ np.array(model.curve) if total else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(line, -700, 700)))


def _scored(model: Model):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("evidence", pa.float64()),
            ("hits", pa.int64()),
            ("words", pa.int64()),
            ("clauses", pa.list_(pa.float64())),
            ("score", pa.float64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _Lexicon(model)
        for batch in batches:
            found = [evidence(t.decode("utf-8"), lexicon) for t in texts_of(batch.column(1))]
            total, hits, words = ([f[k] for f in found] for k in range(3))
            score = _curve(model, total, hits, words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(total, pa.float64()),
                    pa.array(hits, pa.int64()),
                    pa.array(words, pa.int64()),
                    pa.array([f[3] for f in found], pa.list_(pa.float64())),
                    pa.array(score, pa.float64()),
                ],
                schema=schema,
            )

    return run


def score_toxicity(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``evidence``, ``hits``, ``words``, ``clauses`` and ``score`` for every row.

    ``clauses`` are the scores of the clauses with a match, in text order. Null and
    empty texts have no evidence and the curve's lowest score. Repeated rows are
    scored one by one; an empty table gives no rows.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(_scored(model), _RAW)


def without_toxic(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that score below ``least``.

    Every row is judged by its own text as it streams by, whether it has an id or not; nothing is shuffled.
    """

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = _Lexicon(model)
        for column in texts:
            found = [evidence(t.decode("utf-8"), lexicon)[:3] for t in texts_of(column)]
            yield pa.array(_curve(model, *([f[k] for f in found] for k in range(3))), pa.float64())

    return docs.where(score(F.col(text_col).cast("string")) < F.lit(least))
