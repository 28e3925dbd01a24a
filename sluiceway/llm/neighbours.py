"""Nearest neighbours by inner product: stable projections, a kd-tree, a chi-square stop.

Vectors get one more component that gives all of them the same length, so that
the largest inner product is the smallest distance. They are projected on a few
Gaussian directions; a kd-tree over the projections puts them into cells. A query
looks at cells in the order of their projected distance, verifies their vectors on the
originals, and stops when a vector nearer than its k-th best would lie in the
cells not looked at with small probability only: the squared projected distance over
the squared distance follows a chi-square law.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.staging import written

DIRECTIONS = 8  # even, so that the chi-square law has a closed form
STOP_AT = 0.96  # chance that a nearer vector would have been looked at
CELL_ROWS = 2_048
MOST_CELLS = 1_024
SAMPLE_ROWS = 32_768  # the kd-tree's splits are fitted on about as many rows
FIRST_CELLS = 4
BLOCK_ROWS = 4_096  # vectors, and queries, that one task holds at a time
SEED = 20_240_229


def chi_square_cdf(x: float, degrees: int) -> float:
    """For even degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, degrees // 2):
        term *= half / k
        total += term
    return 1 - math.exp(-half) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, degrees) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, degrees) < p else (low, middle)
    return high


def directions(dimension: int) -> np.ndarray:
    """Gaussian directions for the vectors and their added component."""
    return np.random.default_rng(SEED).standard_normal((dimension + 1, DIRECTIONS))


class KdTree:
    """Median splits of a sample in heap order; ``cells`` leaves, a power of two."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.depth = max(0, int(math.log2(max(1, cells))))
        self.axis = np.zeros(1 << self.depth, dtype=np.int64)
        self.at = np.zeros(1 << self.depth)
        self._split(sample, 1, 0)

    def _split(self, rows: np.ndarray, node: int, level: int) -> None:
        if level == self.depth:
            return
        if len(rows):
            self.axis[node] = axis = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            self.at[node] = np.median(rows[:, axis])
        right = rows[:, self.axis[node]] > self.at[node]
        self._split(rows[~right], 2 * node, level + 1)
        self._split(rows[right], 2 * node + 1, level + 1)

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), dtype=np.int64)
        rows = np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + (points[rows, self.axis[node]] > self.at[node])
        return node - (1 << self.depth)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes of doubles, with their dimension and squared length."""
    for batch in batches:
        ids, vectors, dims, lengths = [], [], [], []
        column = batch.column(1)
        for at, vec_id in enumerate(batch.column(0).to_pylist()):
            item = column[at]
            if vec_id is None or not item.is_valid or item.values.null_count or not len(item.values):
                continue
            x = item.values.to_numpy(zero_copy_only=False).astype(np.float64)
            length = float(x @ x)
            if np.isfinite(x).all() and x.any():
                ids.append(vec_id)
                vectors.append(x.tobytes())
                dims.append(len(x))
                lengths.append(length)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(vectors, pa.binary()),
                pa.array(dims, pa.int32()),
                pa.array(lengths, pa.float64()),
            ],
            names=["vec_id", "vector", "dim", "length"],
        )


def _stack(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dimension)


def _projected(dimension: int, top: float):
    matrix = directions(dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stack(batch.column(1), dimension)
            rest = np.sqrt(np.maximum(top - batch.column(2).to_numpy(zero_copy_only=False), 0))
            points = x @ matrix[:-1] + rest[:, None] * matrix[-1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.FixedSizeListArray.from_arrays(points.reshape(-1), DIRECTIONS).cast(
                        pa.list_(pa.float64())
                    ),
                ],
                names=["vec_id", "vector", "point"],
            )

    return run


def _points(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIRECTIONS)


def _celled(tree: KdTree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = tree.cell(_points(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32))],
                names=[*batch.schema.names, "cell"],
            )

    return run


def _visits(dimension: int, top: float, cells, low, high, first: bool):
    """Cells each query looks at: the nearest ones first, then all others within its radius."""
    matrix = directions(dimension)[:-1]
    factor = chi_square_quantile(STOP_AT, DIRECTIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _stack(batch.column(1), dimension)
            worst = batch.column(2).to_numpy(zero_copy_only=False)  # NaN: fewer than k so far
            point = q @ matrix
            away = np.zeros((len(q), len(cells)))
            for k in range(DIRECTIONS):
                gap = np.maximum(low[:, k] - point[:, k, None], point[:, k, None] - high[:, k])
                away += np.maximum(gap, 0) ** 2
            nearest = np.argsort(away, axis=1, kind="stable")
            early = np.zeros_like(away, dtype=bool)
            np.put_along_axis(early, nearest[:, :FIRST_CELLS], True, axis=1)
            if first:
                chosen = early
            else:
                reach = np.maximum((q * q).sum(axis=1) + top - 2 * worst, 0) * factor
                chosen = ~early & ~(away > np.where(np.isnan(worst), np.inf, reach)[:, None])
            row, column = np.nonzero(chosen)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    batch.column(1).take(pa.array(row)),
                    batch.column(2).take(pa.array(row)),
                    pa.array(cells[column].astype(np.int32)),
                ],
                names=["query_id", "query", "worst", "cell"],
            )

    return run


def _verified(dimension: int, k: int):
    """Of one block of vectors, each query's best k that are no worse than what it has."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if vectors.num_rows and queries.num_rows:
            ids = vectors.column("vec_id").to_numpy()
            x = _stack(vectors.column("vector").combine_chunks(), dimension)
            names = queries.column("query_id").to_numpy()
            q = _stack(queries.column("query").combine_chunks(), dimension)
            worst = queries.column("worst").to_numpy()
            for at in range(0, len(q), 256):
                scores = q[at : at + 256] @ x.T
                for row, score in enumerate(scores):
                    own, floor = names[at + row], worst[at + row]
                    score[ids == own] = -np.inf
                    if len(score) > k:
                        least = np.partition(score, len(score) - k)[len(score) - k]
                        floor = least if np.isnan(floor) else max(least, floor)
                    near = np.flatnonzero(score >= (-np.inf if np.isnan(floor) else floor) - 1e-9)
                    near = near[ids[near] != own]
                    # a sum whose order does not depend on the block
                    exact = (x[near] * q[at + row]).sum(axis=1)
                    best = np.lexsort((ids[near], -exact))[:k]
                    out[0].append(np.full(len(best), own))
                    out[1].append(ids[near][best])
                    out[2].append(exact[best])
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.Table.from_arrays(
            [pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, schema, strict=True)],
            schema=schema,
        )

    return run


def nearest_neighbours(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k largest inner products found.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with another
    id. Ties go to the smaller id. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without an id, take no part, nor do vectors
    of another dimension than the most frequent one. Of rows that repeat an id and a
    vector one takes part. An empty table gives no rows.

    The tree is fitted on about SAMPLE_ROWS rows and has up to MOST_CELLS cells; every row
    is indexed. Cells of more than BLOCK_ROWS vectors or queries are cut into blocks.
    """
    usable = written(
        vectors.select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(vector_col).cast("array<double>").alias("vector"),
        )
        .mapInArrow(_whole, "vec_id long, vector binary, dim int, length double")
        .dropDuplicates(["vec_id", "vector"]),
        "vectors",
    )
    spark = vectors.sparkSession
    common = (
        usable.groupBy("dim").agg(F.count("*").alias("n"), F.max("length").alias("top"))
        .orderBy(F.desc("n"), "dim").first()
    )
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, top, n = common["dim"], common["top"], common["n"]
    projected = usable.where(F.col("dim") == dimension).select("vec_id", "vector", "length").mapInArrow(
        _projected(dimension, top), "vec_id long, vector binary, point array<double>"
    )
    cells = min(MOST_CELLS, 1 << max(0, math.ceil(math.log2(max(1, n / CELL_ROWS)))))
    share = min(1.0, SAMPLE_ROWS / n)
    sample = (
        projected.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
        .select("point").limit(2 * SAMPLE_ROWS).toArrow().column("point").combine_chunks()
    )
    tree = KdTree(_points(sample), cells)
    indexed = written(
        projected.mapInArrow(
            _celled(tree), "vec_id long, vector binary, point array<double>, cell int"
        ),
        "cells",
    )
    # one row per cell
    edges = indexed.groupBy("cell").agg(
        F.count("*").alias("n"),
        *(F.min(F.col("point")[j]).alias(f"low{j}") for j in range(DIRECTIONS)),
        *(F.max(F.col("point")[j]).alias(f"high{j}") for j in range(DIRECTIONS)),
    ).orderBy("cell").collect()
    numbers = np.array([r["cell"] for r in edges])
    low = np.array([[r[f"low{j}"] for j in range(DIRECTIONS)] for r in edges])
    high = np.array([[r[f"high{j}"] for j in range(DIRECTIONS)] for r in edges])
    blocks = {r["cell"]: -(-r["n"] // BLOCK_ROWS) for r in edges}
    layout = spark.createDataFrame(list(blocks.items()), "cell int, blocks int")

    queries = indexed.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query_id"), F.col("vector").alias("query")
    ).dropDuplicates(["query_id"])

    def looked_at(asked: DataFrame, first: bool) -> DataFrame:
        visits = written(
            asked.select("query_id", "query", "worst").mapInArrow(
                _visits(dimension, top, numbers, low, high, first),
                "query_id long, query binary, worst double, cell int",
            ),
            "visits",
        )
        parts = (
            visits.groupBy("cell").count()
            .select("cell", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("parts"))
            .join(layout, "cell")
        )
        spread = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
        salt = lambda name, size: F.pmod(F.xxhash64(name), F.col(size)).cast("int")
        sides = (
            indexed.select("vec_id", "vector", "cell").join(parts, "cell")
            .withColumn("block", salt("vec_id", "blocks")).withColumn("part", spread("parts"))
            .select("vec_id", "vector", "cell", "block", "part"),
            visits.join(parts, "cell")
            .withColumn("part", salt("query_id", "parts")).withColumn("block", spread("blocks"))
            .select("query_id", "query", "worst", "cell", "block", "part"),
        )
        left, right = (side.groupBy("cell", "block", "part") for side in sides)
        return left.cogroup(right).applyInArrow(
            _verified(dimension, k), "query_id long, vec_id long, score double"
        )

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    early = written(
        ranked(looked_at(queries.withColumn("worst", F.lit(None).cast("double")), True)), "nearest"
    )
    reached = early.where(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))
    late = looked_at(queries.join(reached, "query_id", "left"), False)
    return ranked(early.drop("rank").unionByName(late)).select("query_id", "rank", "vec_id", "score")
