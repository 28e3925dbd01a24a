"""Hard negatives by coordinate pruning inside length buckets, after LEMP.

Rows are dealt into cells: a group of labels, a class of lengths, and a block of bounded
size. Inside a cell every coordinate has a sorted list of its values in the
unit vectors. An anchor that needs at least (and at most) some inner product needs, by the
lengths in the cell, at least (and at most) some cosine; that bounds the angle to each of the
anchor's largest coordinates, its focus, and so the value there. The ranges of the
focus coordinates are cut out of the sorted lists and intersected, and what is left is
verified on the whole vectors.

A first pass over one cell gives each anchor a threshold, a second pass looks at every other
cell that the lengths allow. Scores are sums of whole numbers and therefore exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.staging import written

SCALE = 256
LABEL_GROUPS = 64  # labels are dealt to so many groups
CLASSES = 8  # classes of lengths for each doubling of the squared length
CELL_ROWS = 2_048  # rows, and anchors, that one task compares at a time
FOCUS = 4  # coordinates whose ranges are intersected
LARGEST = float(1 << 54)  # squared length that keeps a hundred times every score within a long
_NONE, _ALL = -(1 << 62), 1 << 62
_EXACT = float(1 << 53)
_SLACK = 1e-9


def feasible(own: float, least: float, most: float) -> list[tuple[float, float]]:
    """Range of p's value at a coordinate where the unit vector q has ``own``, given
    least <= cos(p, q) <= most, by the triangle inequality of angles."""
    if least > 1 + _SLACK or most < -1 - _SLACK or least > most + _SLACK:
        return (1.0, -1.0)
    at = math.acos(max(-1.0, min(1.0, own)))
    far = math.acos(max(-1.0, min(1.0, least)))
    near = math.acos(max(-1.0, min(1.0, most)))
    smallest = max(0.0, at - far, near - at)
    largest = min(math.pi, at + far, 2 * math.pi - at - near)
    return math.cos(largest) - _SLACK, math.cos(smallest) + _SLACK


class Bucket:
    """The vectors of one cell with a sorted list for every coordinate that is asked for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.real = vectors.astype(np.float64)
        lengths = np.sqrt((self.real * self.real).sum(axis=1))
        self.shortest, self.longest = float(lengths.min()), float(lengths.max())
        self.unit = self.real / np.where(lengths > 0, lengths, 1)[:, None]
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        if coordinate not in self._lists:
            values = self.unit[:, coordinate]
            order = np.argsort(values, kind="stable")
            self._lists[coordinate] = (values[order], order)
        return self._lists[coordinate]

    def _cosines(self, length: float, least: int, most: int) -> tuple[float, float]:
        """Least and most cosine that any vector of the cell needs for a score in the range."""
        long, short = length * self.longest, length * self.shortest
        low = least / long if least > 0 and long else least / short if least < 0 and short else -1.0
        high = most / short if most > 0 and short else most / long if most < 0 and long else 1.0
        return max(-2.0, low - _SLACK), min(2.0, high + _SLACK)

    def candidates(self, q: np.ndarray, length: float, least: int, most: int) -> np.ndarray | None:
        """Rows whose focus coordinates lie in the feasible ranges; None where that is most of them."""
        if length == 0 or self.shortest == 0:
            return None  # no direction, nothing to prune by
        low, high = self._cosines(length, least, most)
        if low > 1 or high < -1:
            return np.zeros(0, dtype=np.int64)
        unit = q / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        ranges, best = [], None
        for f in focus:
            a, b = feasible(float(unit[f]), low, high)
            values, order = self.sorted_list(int(f))
            start, stop = np.searchsorted(values, a, "left"), np.searchsorted(values, b, "right")
            ranges.append((f, a, b))
            if best is None or stop - start < best[1] - best[0]:
                best = (start, max(start, stop), f, order)
        start, stop, chosen, order = best
        if stop - start > len(self.ids) // 2:
            return None
        rows = order[start:stop]
        for f, a, b in ranges:
            if f != chosen:
                value = self.unit[rows, f]
                rows = rows[(value >= a) & (value <= b)]
        return rows


def _stack(column: pa.ChunkedArray, kind) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype=kind).reshape(len(parts), -1)


FOUND = "anchor_id long, anchor_key long, slot int, vec_id long, score long"
_FOUND = pa.schema(
    [("anchor_id", pa.int64()), ("anchor_key", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())]
)


def _searched(k: int, same: bool):
    """Of one cell, the best k of every anchor's ranges, among rows of its label or of the others."""

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if rows.num_rows and asks.num_rows:
            bucket = Bucket(
                rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), _stack(rows.column("vector"), np.int32)
            )
            whole = None
            q_all = _stack(asks.column("query"), np.int32)
            for at, ask in enumerate(asks.drop_columns(["query"]).to_pylist()):
                q = q_all[at].astype(np.float64)
                length = math.sqrt(float(q @ q))
                low, high = ask["low"], ask["high"]
                found = bucket.candidates(q, length, min(low), max(high))
                allowed = bucket.labels == ask["label"] if same else bucket.labels != ask["label"]
                allowed &= bucket.ids != ask["anchor_id"]
                found = np.flatnonzero(allowed) if found is None else found[allowed[found]]
                if not len(found):
                    continue
                if length * bucket.longest < _EXACT:
                    score = (bucket.real[found] @ q).astype(np.int64)
                else:
                    if whole is None:
                        whole = bucket.vectors.astype(np.int64)
                    score = whole[found] @ q_all[at].astype(np.int64)
                order = np.lexsort((bucket.ids[found], -score))
                ids, score = bucket.ids[found][order], score[order]
                for slot, (a, b) in enumerate(zip(low, high, strict=True)):
                    start, stop = np.searchsorted(-score, -b, "left"), np.searchsorted(-score, -a, "right")
                    chosen = slice(start, min(stop, start + k))
                    n = len(ids[chosen])
                    out[0].append(np.full(n, ask["anchor_id"]))
                    out[1].append(np.full(n, ask["anchor_key"]))
                    out[2].append(np.full(n, slot))
                    out[3].append(ids[chosen])
                    out[4].append(score[chosen])
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.Table.from_arrays(
            [pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND
        )

    return run


def _packed(dimension: int):
    """Whole-number vectors as bytes, with their length and its class; those beyond LARGEST are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, dimension)
            square = (x.astype(np.float64) ** 2).sum(axis=1)
            fits = np.flatnonzero(square < LARGEST)
            kind = np.floor(np.log2(np.maximum(square[fits], 0.5)) * CLASSES).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(fits)),
                    batch.column(1).take(pa.array(fits)),
                    pa.array([row.tobytes() for row in x[fits].astype(np.int32)], pa.binary()),
                    pa.array(np.sqrt(square[fits])),
                    pa.array(kind),
                ],
                names=["vec_id", "label", "vector", "length", "class"],
            )

    return run


def _visits(cells: list[tuple], first: bool, same: bool):
    """Cells that an anchor looks at: one of the fullest, or all others in its reach.

    ``cells`` has label group, class, rows, blocks, and least and largest length: one entry for
    each group and class, thus at most LABEL_GROUPS * 54 * CLASSES.
    """
    group, kind, rows, blocks = (np.array([c[k] for c in cells], dtype=np.int64) for k in range(4))
    long = np.array([c[4] for c in cells])
    names = ["anchor_id", "anchor_key", "label", "query", "low", "high"]

    def places(ask: dict) -> Iterator[tuple[int, np.ndarray]]:
        """Entries of ``cells`` with the blocks to look at, a bounded piece at a time."""
        mine = np.flatnonzero(group == ask["grouped"]) if same else np.arange(len(cells))
        if not len(mine):
            return
        other = mine if same else mine[group[mine] != ask["grouped"]]
        other = other if len(other) else mine
        start = int(other[np.argmax(rows[other])])
        block = ask["anchor_key"] % int(blocks[start])
        if first:
            yield start, np.array([block])
            return
        # the largest and smallest score that the lengths of a cell allow
        edge = ask["length"] * long[mine] * (1 + 1e-12)
        for cell in mine[(edge >= min(ask["low"])) & (-edge <= max(ask["high"]))].tolist():
            for at in range(0, int(blocks[cell]), 8_192):
                piece = np.arange(at, min(at + 8_192, int(blocks[cell])))
                yield cell, piece if cell != start else piece[piece != block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took, where, block, n = [], [], [], 0

            def told():
                at, cell, part = (np.concatenate(c).astype(np.int64) for c in (took, where, block))
                chosen = batch.select(names).take(pa.array(at))
                return pa.RecordBatch.from_arrays(
                    [*chosen.columns, *(pa.array(c.astype(np.int32)) for c in (group[cell], kind[cell], part))],
                    names=[*names, "grouped", "class", "block"],
                )

            for at, ask in enumerate(batch.select(["anchor_key", "grouped", "length", "low", "high"]).to_pylist()):
                for cell, piece in places(ask):
                    took.append(np.full(len(piece), at))
                    where.append(np.full(len(piece), cell))
                    block.append(piece)
                    n += len(piece)
                    if n >= 8_192:
                        yield told()
                        took, where, block, n = [], [], [], 0
            if n:
                yield told()

    return run


_CELL = ("grouped", "class", "block")


def _look(indexed: DataFrame, cells: list[tuple], asks: DataFrame, k: int, same: bool, first: bool) -> DataFrame:
    """The best k of each range of the anchors in the cells that they look at."""
    visits = written(
        asks.mapInArrow(
            _visits(cells, first, same),
            "anchor_id long, anchor_key long, label long, query binary, low array<long>, high array<long>, "
            "grouped int, class int, block int",
        ),
        "visits",
    )
    parts = visits.groupBy(*_CELL).count().select(*_CELL, F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("parts"))
    rows = (
        indexed.select("vec_id", "label", "vector", *_CELL).join(parts, list(_CELL))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("vec_id", "label", "vector", *_CELL, "part")
    )
    asked = visits.join(parts, list(_CELL)).withColumn("part", F.pmod("anchor_key", "parts").cast("int")).select(
        "anchor_id", "anchor_key", "label", "query", "low", "high", *_CELL, "part"
    )
    left, right = (side.groupBy(*_CELL, "part") for side in (rows, asked))
    return left.cogroup(right).applyInArrow(_searched(k, same), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor_id", "anchor_key", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _best(indexed: DataFrame, cells: list[tuple], asks: DataFrame, k: int, same: bool, label: str) -> DataFrame:
    """The best k of every range: one cell gives a floor, the others are searched above it."""
    early = written(_ranked(_look(indexed, cells, asks, k, same, True), k), f"{label}-first")
    floors = early.where(F.col("rank") == k).groupBy("anchor_id", "anchor_key").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("floor")  # one for each range
    )
    raised = F.transform("low", lambda a, i: F.greatest(a, F.coalesce(F.try_element_at("floor", i), a)))
    late = _look(
        indexed, cells,
        asks.join(floors, ["anchor_id", "anchor_key"], "left").withColumn("low", raised).drop("floor"),
        k, same, False,
    )
    return _ranked(early.drop("rank").unionByName(late), k)


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    rows: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    id_col: str = "vec_id",
    label_col: str | Column = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """The hardest negatives of every anchor and positive.

    Anchors are rows whose id is divisible by ``every``. Scores are inner products of the vectors with
    each component c as floor(256 * c). An anchor's positives are its first rows of the same label by score, ties
    by smaller id. Negatives are the first rows of other labels whose score lies between ``least`` and
    ``most`` percent of the positive's; ``rank`` counts from 1.

    Rows with a null id, label or vector, an empty vector, a null or non-finite component, or a squared
    length beyond LARGEST take no part, nor do vectors of another dimension than the most frequent one. Rows that repeat id,
    label and vector count once; other rows of an anchor's own id are neither positive nor negative to it. Where an id has
    several rows each is an anchor of its own. An empty table gives no rows.
    """
    spark = rows.sparkSession
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    fine = rows.select(
        F.col(id_col).cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    ).where(
        "vec_id is not null and label is not null and size(v) > 0"
        f" and not exists(v, c -> c is null or isnan(c) or abs(c) > {math.sqrt(LARGEST) / SCALE})"
    )
    common = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], OUT)
    dimension = common["d"]
    packed = written(
        fine.where(F.size("v") == dimension)
        .select("vec_id", "label", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE)))).alias("x"))
        .mapInArrow(_packed(dimension), "vec_id long, label long, vector binary, length double, class int")
        .dropDuplicates(["vec_id", "label", "vector"])
        .withColumn("grouped", F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int")),
        "vectors",
    )
    layout = packed.groupBy("grouped", "class").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()
    if not layout:
        return spark.createDataFrame([], OUT)
    cells = [(r["grouped"], r["class"], r["n"], -(-r["n"] // CELL_ROWS), r["longest"]) for r in layout]
    # one row for each label group and class of lengths
    blocks = F.broadcast(spark.createDataFrame([(c[0], c[1], c[3]) for c in cells], "grouped int, class int, blocks int"))
    key = F.xxhash64("vec_id", "label", "vector")
    indexed = packed.join(blocks, ["grouped", "class"]).withColumn("block", F.pmod(key, "blocks").cast("int"))
    anchors = packed.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("anchor_id"), key.alias("anchor_key"), "label", F.col("vector").alias("query"), "length", "grouped"
    )
    alike = written(
        _best(
            indexed, cells,
            anchors.withColumn("low", F.array(F.lit(_NONE))).withColumn("high", F.array(F.lit(_ALL))),
            positives, True, "alike",
        ),
        "alike",
    )
    # floor(a / 100) and ceil(a / 100) in whole numbers
    down = lambda a: (a - F.pmod(a, F.lit(100))) / F.lit(100)
    low = (-down(-(F.col("score") * least))).cast("long")
    high = down(F.col("score") * most).cast("long")
    ranges = (
        alike.withColumn("low", low).withColumn("high", high)
        .groupBy("anchor_id", "anchor_key")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("r"))  # at most ``positives``
        .where(F.exists("r", lambda r: r["low"] <= r["high"]))
        .select(
            "anchor_id", "anchor_key",
            F.transform("r", lambda r: F.when(r["low"] <= r["high"], r["low"]).otherwise(F.lit(_ALL))).alias("low"),
            F.transform("r", lambda r: F.when(r["low"] <= r["high"], r["high"]).otherwise(F.lit(_NONE))).alias("high"),
        )
    )
    unlike = _best(indexed, cells, anchors.join(ranges, ["anchor_id", "anchor_key"]), negatives, False, "unlike")
    return unlike.select(
        "anchor_id", "anchor_key", (F.col("slot") + 1).alias("place"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"),
    ).join(
        alike.select(
            "anchor_id", "anchor_key", F.col("rank").alias("place"),
            F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        ),
        ["anchor_id", "anchor_key", "place"],
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
