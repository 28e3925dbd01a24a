"""Embedding whitening by spectral divide and conquer.

The covariance of integer vectors is summed exactly by Spark. Its eigenvectors come from
polar decompositions: the polar factor U of the covariance minus a shift tells on which
side of the shift every eigenvalue lies, (U + I) / 2 projects on the upper ones, and
a basis of that subspace and of its complement splits the matrix into two smaller ones.
Polar factors come from the dynamically weighted Halley iteration (QDWH). The
matrices are dimension by dimension, whatever the number of rows; the components are
broadcast to the tasks that whiten the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.staging import written

COMPONENTS = 8
SCALE, OFFSET = 1_024, 100_000
LARGEST = float(1 << 40)  # vectors with a component beyond it do not fit exact sums
_EPS = np.finfo(float).eps
_EXACT = 1 << 53  # whole numbers below it are exact doubles
_FULL = 1 << 62


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: QDWH, by QR while it is ill conditioned."""
    n = len(a)
    norm = np.linalg.norm(a)
    if not norm:
        return np.eye(n)
    x = a / norm
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(1.0, max(low, _EPS / 10))
    for _ in range(40):
        square = low * low
        d = (4 * (1 - square) / (square * square)) ** (1 / 3)
        root = math.sqrt(1 + d)
        wa = root + 0.5 * math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, np.eye(n)]))
            new = (wb / wc) * x + (wa - wb / wc) / math.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            inner = np.linalg.solve(np.eye(n) + wc * (x.T @ x), x.T).T
            new = (wb / wc) * x + (wa - wb / wc) * inner
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        moved = np.linalg.norm(new - x)
        x = new
        if moved < 1e-8 and abs(1 - low) < 1e-8:  # converges cubically: the next change is below rounding
            break
    return x


def _shifts(a: np.ndarray) -> list[float]:
    """Places to split at, between diagonal entries, the middle first."""
    d = np.sort(np.diag(a))
    gaps = sorted(range(len(d) - 1), key=lambda k: abs(k - (len(d) - 2) / 2))
    inside = [d[k] + share * (d[k + 1] - d[k]) for share in (0.5, 0.381966) for k in gaps if d[k + 1] > d[k]]
    spread = np.linalg.norm(a - np.diag(np.full(len(a), d.mean()))) / math.sqrt(len(a))
    return inside[:6] + [d.mean() + share * spread for share in (0.0, 0.3, -0.3, 0.7, -0.7)]


def _divided(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first columns span the eigenvectors above a shift."""
    n, best = len(a), None
    draw = np.random.default_rng(n).standard_normal((n, n))
    for shift in _shifts(a):
        projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < n:
            continue
        basis = draw
        for _ in range(2):
            basis, _ = np.linalg.qr(projector @ basis[:, :rank], mode="complete")
        left = float(np.linalg.norm(basis[:, rank:].T @ a @ basis[:, :rank]))
        if best is None or left < best[0]:
            best = (left, basis, rank)
        if left <= 8 * n * _EPS * scale:
            break
    return None if best is None or best[0] > 1e-9 * scale else best[1:]


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix.

    A block that no shift splits has eigenvalues that are equal up to rounding; any basis serves.
    """
    scale = float(np.linalg.norm(a))
    values, columns = [], []
    todo = [(a, np.eye(len(a)))]
    while todo:
        block, basis = todo.pop()
        n = len(block)
        even = np.linalg.norm(block - np.eye(n) * np.trace(block) / n) <= 4 * _EPS * scale
        split = None if n == 1 or even else _divided(block, scale)
        if split is None:
            values.extend(np.diag(block))
            columns.extend(basis.T)
            continue
        turn, rank = split
        turned = turn.T @ block @ turn
        turned = (turned + turned.T) / 2
        todo.append((turned[:rank, :rank], basis @ turn[:, :rank]))
        todo.append((turned[rank:, rank:], basis @ turn[:, rank:]))
    vectors = np.array(columns).T
    # one Rayleigh quotient takes the rounding of the blocks out of the values
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``x``, whole numbers, of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    spoilt = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > F.lit(LARGEST)))
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(OFFSET))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & ~spoilt).select(
        F.col(id_col).cast("long").alias("vec_id"), x.alias("x")
    )


def _rows_of(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy().reshape(-1, dimension)


def _sums(dimension: int):
    """Sums of each dimension around OFFSET; dimension -1 counts the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total, bound = 0, np.zeros(dimension, dtype=np.int64), 0

        def told():
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, dimension, dtype=np.int32)), pa.array(np.append(rows, total))],
                names=["i", "total"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            y = _rows_of(batch, dimension) - OFFSET
            step = int(np.abs(y).max()) * len(y)
            if bound + step >= _FULL:
                yield told()
                rows, total, bound = 0, np.zeros(dimension, dtype=np.int64), 0
            rows, total, bound = rows + len(y), total + y.sum(axis=0), bound + step
        yield told()

    return run


def _products(dimension: int, middle: np.ndarray):
    """Sums of products of centred dimensions, exact, as text."""
    upper = np.triu_indices(dimension)

    def told(total) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(upper[0].astype(np.int32)),
                pa.array(upper[1].astype(np.int32)),
                pa.array([str(int(t)) for t in total[upper]]),
            ],
            names=["i", "j", "total"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bound = np.zeros((dimension, dimension), dtype=np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _rows_of(batch, dimension) - middle
            square = max(1, int(np.abs(y).max()) ** 2)
            if square * len(y) >= _FULL:  # too large for machine numbers
                big = y.astype(object)
                yield told(big.T.dot(big))
                continue
            if bound + square * len(y) >= _FULL:
                yield told(total)
                total, bound = np.zeros_like(total), 0
            bound += square * len(y)
            # products of doubles are exact while their sums stay below 2**53
            rows = max(1, _EXACT // square)
            for at in range(0, len(y), rows):
                part = y[at : at + rows]
                if square <= _EXACT:
                    part = part.astype(np.float64)
                total += (part.T @ part).astype(np.int64)
        yield told(total)

    return run


def _whitened(dimension: int, n: int, middle: np.ndarray, rest: list[int], shared):
    """Whitened components and the exact squared deviation, as text, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        mean = np.array([r / n for r in rest])
        reach = max(map(abs, rest), default=0)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _rows_of(batch, dimension) - middle
            z = (y - mean) @ matrix
            if (n * int(np.abs(y).max()) + reach) ** 2 * dimension < _FULL:
                away = n * y - np.array(rest, dtype=np.int64)
                deviation = (away * away).sum(axis=1).astype(str).tolist()
            else:
                away = y.astype(object) * n - np.array(rest, dtype=object)
                deviation = [str(d) for d in (away * away).sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(deviation, pa.string()),
                    pa.FixedSizeListArray.from_arrays(pa.array(z.reshape(-1)), z.shape[1]).cast(pa.list_(pa.float64())),
                ],
                names=["vec_id", "deviation", "z"],
            )

    return run


OUT = (
    "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
    "identity_error double"
)


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Each usable row's whitened components, one row for each of the first ``components``.

    Vectors that are null, empty or hold null or non-finite entries take no part, nor do vectors
    with an entry beyond LARGEST in size or of another dimension than the most frequent one
    (the smaller where two are as frequent). A component c counts as floor(1024 * c) + 100000. Repeated rows
    and rows without an id count like any other; further columns are dropped. An empty table gives no rows.

    ``deviation`` is the sum over dimensions of (n * x - sum of x) squared, null beyond 38 digits. ``explained``
    is the component's share of the variance. A component without variance (its value is rounding
    only) has null in ``whitened`` and does not count in ``identity_error``, which is measured on the rows.

    The covariance is summed around the rounded mean, exactly; the driver holds dimension by
    dimension numbers of it.
    """
    spark = vectors.sparkSession
    usable = whole_vectors(vectors, id_col, vector_col)
    common = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], OUT)
    dimension = common["d"]
    rows = usable.where(F.size("x") == dimension)
    whole = lambda df, *keys: df.groupBy(*keys).agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    ).collect()  # one row per dimension, or pair of dimensions
    sums = {r["i"]: int(r["total"]) for r in whole(rows.select("x").mapInArrow(_sums(dimension), "i int, total long"), "i")}
    n = sums[-1]
    middle = np.array([OFFSET + round(sums[i] / n) for i in range(dimension)], dtype=np.int64)
    # what the rounded mean leaves: sum of (x - middle)
    rest = [sums[i] + n * (OFFSET - int(middle[i])) for i in range(dimension)]
    covariance = np.zeros((dimension, dimension))
    pairs = rows.select("x").mapInArrow(_products(dimension, middle), "i int, j int, total string")
    for r in whole(pairs, "i", "j"):
        i, j = r["i"], r["j"]
        covariance[i, j] = covariance[j, i] = (n * int(r["total"]) - rest[i] * rest[j]) / (n * n)

    values, directions = spectrum(covariance)
    count = min(components, dimension)
    trace = float(np.trace(covariance))
    varied = [k for k in range(count) if values[k] > dimension * _EPS * trace]
    matrix = np.zeros((dimension, count))
    for k in varied:
        matrix[:, k] = directions[:, k] / math.sqrt(values[k])
    shared = spark.sparkContext.broadcast(matrix)  # dimension by components
    done = written(
        rows.mapInArrow(_whitened(dimension, n, middle, rest, shared), "vec_id long, deviation string, z array<double>"),
        "whitened",
    )
    error = 0.0
    if varied:
        measured = done.agg(
            *(F.covar_pop(F.col("z")[a], F.col("z")[b]).alias(f"c{a}_{b}") for a in varied for b in varied if a <= b)
        ).first()
        error = max(abs(measured[f"c{a}_{b}"] - (a == b)) for a in varied for b in varied if a <= b)
    shares = F.array(*(F.lit(float(values[k] / trace) if k in varied else 0.0) for k in range(count)))
    has = F.array(*(F.lit(k in varied) for k in range(count)))
    return done.select("vec_id", "deviation", F.posexplode("z").alias("k", "value")).select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.col("deviation").try_cast("decimal(38,0)").alias("deviation"),
        F.when(F.get(has, F.col("k")), F.col("value")).alias("whitened"),
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
