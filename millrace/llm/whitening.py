"""Whitening of integer vectors, with eigenvectors found by slicing the spectrum.

Sums and products are exact. Each task adds up the products of its rows' distances to a common whole
centre, in whole numbers; the totals of all tasks, corrected by the distance of the centre to the mean,
are the covariance as one exact fraction, so neither the order of the rows nor their partitions matter.
What leaves the tasks is one number for each pair of dimensions.

The covariance ``V`` (dimensions squared, so bounded) is reduced once to tridiagonal form. The pivots of
the LDLT factors of that form, shifted by ``s``, have as many negative ones as ``V`` has eigenvalues below
``s``: the inertia count. Bisection by counts isolates each leading eigenvalue, Rayleigh quotient
iteration on ``V`` itself takes it, from within its interval, to full precision at cubic speed, and counts
just above and below certify that the k-th vector belongs to the k-th eigenvalue. Eigenvalues that counts
cannot separate at double precision share an interval, and vectors found there are kept orthogonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import carried
from millrace.workspace import materialise

#: Components of a smaller share of the largest eigenvalue are noise of the doubles and have no scale.
NOISE = 1e-10
#: Entries of this size and more do not fit the arithmetic; as with infinite ones, their vector takes no part.
LARGEST = 2.0**40
#: Rows that a task multiplies at once.
ROWS = 4096
_EPS = np.finfo(float).eps
COLUMNS = (
    ("component", "int"), ("n", "long"), ("deviation", "long"),
    ("whitened", "double"), ("explained", "double"), ("identity_error", "double"),
)


def whole_entries(vector: str | Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """``floor(scale * c) + offset`` of each entry; null for a vector that is null, empty, or has a null or non-finite entry."""
    vector = F.col(vector) if isinstance(vector, str) else vector

    def entry(c: Column) -> Column:
        return F.floor(c.cast("double") * scale).cast("long") + offset

    def good(c: Column) -> Column:
        c = c.cast("double")
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)

    usable = vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, good), F.lit(False))
    return F.when(usable, F.transform(vector, entry))


# The spectrum


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of a symmetric one (reflections)."""
    a = np.array(matrix, float)
    size = len(a)
    for k in range(size - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if not norm or not np.any(x[1:]):
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        q = p - (x @ p) * x
        rest -= 2 * np.outer(x, q) + 2 * np.outer(q, x)
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_below(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """Eigenvalues below ``shift``: negative pivots of the LDLT factors of the shifted form."""
    tiny = _EPS * max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0), np.finfo(float).tiny)
    below, pivot = 0, 1.0
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shift - (off[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < tiny * _EPS:
            pivot = -tiny * _EPS or -np.finfo(float).tiny
        below += pivot < 0
    return below


def _bracket(diagonal: np.ndarray, off: np.ndarray) -> tuple[float, float]:
    """Bounds of all eigenvalues, by discs."""
    radius = np.r_[np.abs(off), 0] + np.r_[0, np.abs(off)]
    low, high = float((diagonal - radius).min()), float((diagonal + radius).max())
    room = _EPS * len(diagonal) * max(abs(low), abs(high)) + np.finfo(float).tiny
    return low - room, high + room


def _orthogonal(x: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for v in to:
            x = x - (v @ x) * v
    return x / np.linalg.norm(x)


def leading_pairs(matrix: np.ndarray, most: int, noise: float = NOISE) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues above ``noise`` times the largest, falling, and unit eigenvectors as columns.

    A vector's largest entry is positive. Raises if a count contradicts the number of an eigenvalue.
    """
    size = len(matrix)
    if not size or not np.any(matrix):
        return np.zeros(0), np.zeros((size, 0))
    diagonal, off = tridiagonal(matrix)
    bottom, top = _bracket(diagonal, off)
    scale = max(abs(bottom), abs(top))
    close = 8 * size * _EPS * scale
    counts = {bottom: 0, top: size}
    values, vectors = [], []
    for k in range(min(most, size)):
        # The k-th largest has fewer than size - k eigenvalues below it, and one more with it.
        want = size - 1 - k
        low = max(s for s, c in counts.items() if c <= want)
        high = min(s for s, c in counts.items() if c > want)
        while high - low > close and (counts[low] < want or counts[high] > want + 1 or high - low > scale / 64):
            middle = (low + high) / 2
            counts[middle] = count_below(diagonal, off, middle)
            low, high = (low, middle) if counts[middle] > want else (middle, high)
        value, vector = _refined(matrix, low, high, vectors, close)
        while not low - close <= value <= high + close:  # it ran to a neighbour: narrow the interval
            middle = (low + high) / 2
            counts[middle] = count_below(diagonal, off, middle)
            low, high = (low, middle) if counts[middle] > want else (middle, high)
            value, vector = _refined(matrix, low, high, vectors, close)
        if value <= noise * (values[0] if values else value) or value <= 0:
            break
        if count_below(diagonal, off, value + close) <= want or count_below(diagonal, off, value - close) > want:
            raise ArithmeticError(f"counts contradict eigenvalue {k + 1}: {value}")
        values.append(value)
        vectors.append(vector * np.sign(vector[np.argmax(np.abs(vector))]))
    return np.array(values), np.column_stack(vectors) if vectors else np.zeros((size, 0))


def _solved(matrix: np.ndarray, shift: float, x: np.ndarray, close: float) -> np.ndarray:
    shifted = matrix - shift * np.eye(len(matrix))
    try:
        return np.linalg.solve(shifted, x)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        return np.linalg.solve(shifted - close * np.eye(len(matrix)), x)


def _refined(matrix: np.ndarray, low: float, high: float, found: list[np.ndarray], close: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from the middle of an interval, orthogonal to the vectors found."""
    middle = (low + high) / 2
    x = _orthogonal(np.random.default_rng(len(found)).standard_normal(len(matrix)), found)
    for _ in range(3):
        x = _orthogonal(_solved(matrix, middle, x, close), found)
    value = float(x @ matrix @ x)
    best = None
    for _ in range(50):
        residual = float(np.linalg.norm(matrix @ x - value * x))
        if best is None or residual < best[0]:
            best = residual, value, x
        if residual <= close / 8 or (best[0] < residual and best[0] <= close):
            break
        x = _orthogonal(_solved(matrix, value, x, close), found)
        value = float(x @ matrix @ x)
    return best[1], best[2]


# The covariance


def _products(size: int, centre: list[int]):
    """Rows ``x`` (arrays of ``size``) to ``i, j, total`` for each pair, and ``i, -1, total`` for sums, centred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.array(centre, np.int64)
        total, sums, rows = np.zeros((size, size), object), np.zeros(size, object), 0
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, size) - middle
            for start in range(0, len(x), ROWS):
                part = x[start : start + ROWS]
                most = float(np.abs(part).max())
                if most * most * len(part) < 2.0**53:  # whole doubles: exact
                    product = part.astype(float)
                    total += (product.T @ product).astype(np.int64).astype(object)
                else:
                    total += part.T.astype(object) @ part.astype(object)
                sums += part.sum(axis=0).astype(object)
                rows += len(part)
        if rows:
            i, j = np.triu_indices(size)
            values = [str(v) for v in total[i, j]] + [str(v) for v in sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[i, np.arange(size)].astype(np.int32)), pa.array(np.r_[j, np.full(size, -1)].astype(np.int32)),
                 pa.array(values, pa.string())],
                ["i", "j", "total"],
            )

    return run


def _covariance(vectors: DataFrame, size: int, rows: int) -> tuple[list[int], np.ndarray]:
    """The sums of ``x`` and the covariance with divisor ``rows``, both exact until the one rounding at the end."""
    centre = list(vectors.first()["x"])  # any vector will do: it only keeps the products small
    totals = (
        vectors.select("x")
        .mapInArrow(_products(size, centre), "i int, j int, total string")
        .groupBy("i", "j")
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        .toArrow()
        .to_pylist()
    )
    sums, products = [0] * size, {}
    for row in totals:
        if row["j"] < 0:
            sums[row["i"]] = int(row["total"])
        else:
            products[row["i"], row["j"]] = int(row["total"])
    matrix = np.zeros((size, size))
    for (i, j), value in products.items():
        matrix[i, j] = matrix[j, i] = float(Fraction(rows * value - sums[i] * sums[j], rows * rows))
    return [s + rows * c for s, c in zip(sums, centre, strict=True)], matrix


def _projected(sums: list[int], rows: int, transform: np.ndarray):
    """``x`` to its exact deviation and its whitened coordinates."""
    means = [divmod(s, rows) for s in sums]
    floors = np.array([m for m, _ in means], np.int64)
    parts = np.array([r / rows for _, r in means])

    def of(x: np.ndarray) -> tuple[list[int], np.ndarray]:
        centred = x - floors
        rests = [r for _, r in means]
        most = int(np.abs(centred).max(initial=0) + 1) * rows
        if most * most * len(sums) < 1 << 62:
            exact = rows * centred - np.array(rests, np.int64)
            deviations = (exact * exact).sum(axis=1).tolist()
        else:
            deviations = [sum((rows * int(c) - r) ** 2 for c, r in zip(row, rests, strict=True)) for row in centred]
        return deviations, (centred - parts) @ transform

    return of


def _whitened(sums: list[int], rows: int, transform: np.ndarray):
    size = len(sums)
    of = _projected(sums, rows, transform)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x = np.asarray(part.column(1).flatten()).reshape(-1, size)
                deviations, white = of(x)
                flat = pa.array(white.reshape(-1))
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * transform.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([str(d) for d in deviations], pa.string()), pa.ListArray.from_arrays(offsets, flat)],
                    ["row", "deviation", "white"],
                )

    return run


def _identity_error(vectors: DataFrame, sums: list[int], rows: int, transform: np.ndarray) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, from the vectors themselves."""
    size, many = len(sums), transform.shape[1]
    of = _projected(sums, rows, transform)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, means = np.zeros((many, many)), np.zeros(many)
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, size)
            for start in range(0, len(x), ROWS):
                white = of(x[start : start + ROWS])[1]
                total += white.T @ white
                means += white.sum(axis=0)
        i, j = np.triu_indices(many)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[i, np.arange(many)].astype(np.int32)), pa.array(np.r_[j, np.full(many, -1)].astype(np.int32)),
             pa.array(np.r_[total[i, j], means])],
            ["i", "j", "total"],
        )

    found = vectors.select("x").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    totals = {(r["i"], r["j"]): r["total"] / rows for r in found.toArrow().to_pylist()}
    errors = [
        abs(totals[i, j] - totals[i, -1] * totals[j, -1] - (i == j)) for i in range(many) for j in range(i, many)
    ]
    return max(errors, default=0.0)


def whitened(
    df: DataFrame, vector: str = "embedding", most: int = 32, scale: int = 64, offset: int = 1_000_000, carry: list[str] | None = None
) -> DataFrame:
    """``row, component, n, deviation, whitened, explained, identity_error`` for each vector and component up to ``most``.

    ``row`` holds the ``carry`` columns (default ``vec_id``). Vectors that are null, empty, or hold a null or
    non-finite entry (or one of 2**40 and more) take no part, nor do those with another number of entries than
    most vectors (of equally many the longer ones stay). Repeated rows count as often as they occur. ``deviation``
    is exact; one that a long cannot hold is an error. Equal eigenvalues are numbered in a fixed order. A component whose eigenvalue
    is no more than rounding has no scale and is not returned, so n equal rows, one row or an empty table
    give an empty result. Vectors of any length are used whole; the driver holds their covariance.
    """
    names = carry or ["vec_id"]
    vectors, _ = materialise(
        df.select(carried(names), whole_entries(vector, scale, offset).alias("x")).filter(F.col("x").isNotNull()), "entries"
    )
    sizes = vectors.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("rows"))
    usual = sizes.orderBy(F.desc("rows"), F.desc("size")).first()
    nothing = df.select(carried(names), *[F.lit(None).cast(kind).alias(name) for name, kind in COLUMNS]).limit(0)
    if usual is None:
        return nothing
    size, rows = usual
    vectors = vectors.filter(F.size("x") == size)
    sums, matrix = _covariance(vectors, size, rows)
    values, units = leading_pairs(matrix, most)
    if not len(values):
        return nothing
    transform = units / np.sqrt(values)
    error = _identity_error(vectors, sums, rows, transform)
    shares = F.array(*[F.lit(float(v)) for v in values / np.trace(matrix)])
    kind = f"row {vectors.schema['row'].dataType.simpleString()}, deviation string, white array<double>"
    found = vectors.select("row", "x").mapInArrow(_whitened(sums, rows, transform), kind)
    deviation = F.col("deviation").cast("decimal(38,0)").cast("long")
    return found.select("row", deviation.alias("deviation"), F.posexplode("white").alias("at", "whitened")).select(
        "row",
        (F.col("at") + 1).alias("component"),
        F.lit(rows).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
