"""Whitening of embeddings by the leading principal components.

1. Sums per dimension are added up as whole numbers, one row per task.
2. Rows less the mean are multiplied per task; the products are added up in a tree of small
   groups.  Only the finished covariance, dimension times dimension numbers, reaches the driver.
3. The driver decomposes it: Householder reflections make it tridiagonal, Sturm counts and
   bisection give the leading eigenvalues, inverse iteration their vectors.  Vectors of
   eigenvalues that lie close together are kept orthogonal to each other in every iteration.
4. The projection, dimension times components, is broadcast, and one pass whitens all rows.

What the driver holds depends on the dimension alone, never on the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.llm.base import map_batches, stage

EPSILON = np.finfo(float).eps
#: Entries beyond this count as this, so that sums stay whole numbers.
LARGEST = 1 << 44
#: Rows of products that one task adds up.
FAN = 64


# --- eigenvectors of a symmetric matrix ---------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit Householder vectors that bring ``matrix`` to that form."""
    a = np.array(matrix, float)
    vectors = []
    for k in range(len(a) - 2):
        column = a[k + 1 :, k].copy()
        norm = np.linalg.norm(column)
        if norm == 0.0:
            vectors.append(np.zeros_like(column))
            continue
        column[0] += norm if column[0] >= 0 else -norm
        column /= np.linalg.norm(column)
        vectors.append(column)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ column
        w = p - (column @ p) * column
        rest -= 2.0 * (np.outer(column, w) + np.outer(w, column))
        a[k + 1 :, k] -= 2.0 * column * (column @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), vectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix lie below each point."""
    least = max(float((off**2).max(initial=0.0)), 1.0) * np.finfo(float).tiny / EPSILON
    counts = np.zeros(len(points), np.int64)
    q = np.ones(len(points))
    for i, d in enumerate(diagonal):
        q = d - points - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        counts += q < 0
    return counts


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` greatest eigenvalues, falling, each bisected to the last bits."""
    around = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    low = np.full(count, float((diagonal - around).min()))
    high = np.full(count, float((diagonal + around).max()))
    margin = 2 * EPSILON * max(abs(low[0]), abs(high[0])) * len(diagonal) + np.finfo(float).tiny
    low, high = low - margin, high + margin
    wanted = len(diagonal) - np.arange(count)  # eigenvalues up to and with the wanted one
    for _ in range(1100):
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high) | (high - low <= EPSILON * np.maximum(np.abs(low), np.abs(high)))):
            break
        above = sturm_counts(diagonal, off, middle) < wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float):
    """Solves ``(T - shift) x = b`` by elimination with row exchanges; pivots of zero are nudged."""
    n = len(diagonal)
    nudge = EPSILON * max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0.0)), np.finfo(float).tiny)
    first, second, third = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    factors, swaps = np.zeros(n), np.zeros(n, bool)
    for i in range(n - 1):
        below, after, beyond = off[i], first[i + 1], second[i + 1]
        if abs(below) > abs(first[i]):
            swaps[i] = True
            factors[i] = first[i] / below
            first[i], old, second[i], third[i] = below, second[i], after, beyond
            first[i + 1], second[i + 1] = old - factors[i] * after, -factors[i] * beyond
        else:
            if first[i] == 0.0:
                first[i] = nudge
            factors[i] = below / first[i]
            first[i + 1] = after - factors[i] * second[i]
    if abs(first[-1]) < nudge:
        first[-1] = nudge

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for i in range(n - 1):
            if swaps[i]:
                x[i], x[i + 1] = x[i + 1], x[i] - factors[i] * x[i + 1]
            else:
                x[i + 1] -= factors[i] * x[i]
        for i in range(n - 1, -1, -1):
            rest = x[i]
            if i + 1 < n:
                rest -= second[i] * x[i + 1]
            if i + 2 < n:
                rest -= third[i] * x[i + 2]
            x[i] = rest / first[i]
            if abs(x[i]) > 1e250:  # only the direction counts
                x /= abs(x[i])
        return x

    return solve


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of a tridiagonal matrix for its falling eigenvalues ``values``.

    Eigenvalues within a thousandth of the matrix's norm of their neighbour form a cluster; each
    of its vectors is made orthogonal to the earlier ones twice per iteration.
    """
    n = len(diagonal)
    norm = float((np.abs(diagonal) + np.append(np.abs(off), 0.0) + np.append(0.0, np.abs(off))).max())
    vectors = np.zeros((n, len(values)))
    draw = np.random.default_rng(1)
    start, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            start = j
        # equal eigenvalues are told apart by a few last bits
        shift = min(value, shift - 10 * EPSILON * max(abs(value), norm * EPSILON)) if j > start else value
        solve, x = _solver(diagonal, off, shift), draw.uniform(-1.0, 1.0, n)
        for _ in range(8):
            x = solve(x / np.linalg.norm(x))
            x /= np.linalg.norm(x)
            for _ in range(2):
                x -= vectors[:, start:j] @ (vectors[:, start:j].T @ x)
            x /= np.linalg.norm(x)
            residual = diagonal * x - value * x
            residual[:-1] += off * x[1:]
            residual[1:] += off * x[:-1]
            if np.linalg.norm(residual) <= 2 * EPSILON * norm:
                break
        vectors[:, j] = x
    return vectors


def leading_components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Only eigenvalues that stand out from rounding are returned, so there may be fewer than ``count``.
    """
    matrix = (matrix + matrix.T) / 2
    scale = float(np.abs(matrix).max(initial=0.0))
    if scale == 0.0 or count < 1:
        return np.empty(0), np.empty((len(matrix), 0))
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, min(count, len(matrix)))
    values = values[values > 8 * len(matrix) * EPSILON * values[0]]
    vectors = inverse_iteration(diagonal, off, values)
    for k in range(len(reflections) - 1, -1, -1):
        u = reflections[k]
        vectors[k + 1 :] -= 2.0 * np.outer(u, u @ vectors[k + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    return np.einsum("ij,ij->j", vectors, matrix @ vectors), vectors


# --- distributed sums -----------------------------------------------------------

def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``embedding`` of the rows whose vector has entries, all of them finite numbers."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select("vec_id", "embedding").filter(F.coalesce((F.size("embedding") > 0) & finite, F.lit(False)))


def whole_numbers(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    """``floor(1024 c) + 100000`` of every entry, a row per vector."""
    entries = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(np.clip(1024.0 * entries, -LARGEST, LARGEST)).astype(np.int64).reshape(-1, dimension) + 100_000


def _sums(rows: DataFrame) -> DataFrame:
    """``dimension, n, sums``: whole sums of the vectors of each length, per batch."""

    def make():
        def work(batch):
            lengths = np.diff(batch.column("embedding").offsets.to_numpy())
            found: dict[str, list] = {"dimension": [], "n": [], "sums": []}
            for dimension in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == dimension))
                x = whole_numbers(own, dimension)
                for name, value in zip(found, (dimension, len(x), x.sum(axis=0))):
                    found[name].append(value)
            return found

        return work

    return map_batches(rows.select("embedding"), make, "dimension int, n long, sums array<long>")


def _covariance(rows: DataFrame, dimension: int, mean: np.ndarray, n: int) -> np.ndarray:
    """Mean product of every two centred dimensions.

    A task gives one row per dimension; groups of at most ``FAN`` such rows are added up until
    one is left, so no task adds up the products of all tasks.
    """

    def products(batches):
        total = np.zeros((dimension, dimension))
        for batch in batches:
            centred = whole_numbers(batch, dimension) - mean
            total += centred.T @ centred
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part] * dimension, pa.int64()), "row": pa.array(range(dimension), pa.int32()), "products": pa.array(list(total), pa.list_(pa.float64()))}
        )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(dimension)
        for products_of_row in table.column("products").to_pylist():
            total += products_of_row
        return pa.table(
            {"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "row": pa.array([table.column("row")[0].as_py()], pa.int32()),
             "products": pa.array([total], pa.list_(pa.float64()))}
        )

    schema = "part long, row int, products array<double>"
    parts = stage(rows.select("embedding").mapInArrow(products, schema), "products")
    tasks = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while tasks > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).groupBy("part", "row").applyInArrow(add, schema)
        tasks = -(-tasks // FAN)
    total = np.zeros((dimension, dimension))
    for row in parts.collect():
        total[row["row"]] += row["products"]
    return total / n


# --- the operator -----------------------------------------------------------------

def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """``vec_id``, ``n``, ``deviation``, ``whitened`` and ``explained`` (arrays by component) per usable row.

    Rows whose vector is null, empty or has null, infinite or undefined entries are left out, as
    are those whose length differs from the commonest (the greater on a tie).  ``vec_id`` may be
    null or repeat; every row counts.  An entry c is the whole number ``floor(1024 c) + 100000``,
    2^44 at most.  ``deviation`` is the exact sum over the dimensions of ``(n x - sum)^2``, null
    where it is no long.  Arrays have one entry per component whose variance stands out from
    rounding, ``components`` at most, by falling variance; they are empty if all rows are equal.
    No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, n long, deviation long, whitened array<double>, explained array<double>"
    sums = stage(_sums(rows), "vector-sums")
    commonest = sums.groupBy("dimension").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dimension")).first()
    if commonest is None:
        return spark.createDataFrame([], schema)
    dimension, n = commonest["dimension"], commonest["n"]
    by_dimension = sums.filter(F.col("dimension") == dimension).select(F.posexplode("sums").alias("at", "sum")).groupBy("at").agg(F.sum("sum").alias("sum"))
    total = np.zeros(dimension, np.int64)
    for row in by_dimension.collect():
        total[row["at"]] = row["sum"]

    rows = rows.filter(F.size("embedding") == dimension)
    covariance = _covariance(rows, dimension, total / n, n)
    variances, axes = leading_components(covariance, components)
    trace = float(np.trace(covariance))
    shared = spark.sparkContext.broadcast((axes / np.sqrt(variances), total))
    explained = pa.array([v / trace for v in variances.tolist()], pa.float64())

    def make():
        projection, total = shared.value

        def work(batch):
            x = whole_numbers(batch, dimension)
            if n * int(np.abs(x).max()) + int(np.abs(total).max()) < 1 << 62:
                off = n * x - total
            else:
                off = n * x.astype(object) - total.astype(object)
            whitened = (off / n).astype(float) @ projection
            if off.dtype != object and dimension * int(np.abs(off).max()) ** 2 < 1 << 63:
                deviation = (off * off).sum(axis=1).tolist()
            else:
                deviation = [int(d) if d < 1 << 63 else None for d in (off.astype(object) ** 2).sum(axis=1)]
            return {
                "vec_id": batch.column("vec_id"),
                "n": [n] * len(x),
                "deviation": deviation,
                "whitened": list(whitened),
                "explained": [explained.to_pylist()] * len(x),
            }

        return work

    return map_batches(rows, make, schema)


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` (arrays) less the identity; 0 without components."""
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    if not pairs:
        return 0.0
    found = whitened.agg(*[F.covar_pop(F.get("whitened", i), F.get("whitened", j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def components_of(vectors: DataFrame, components: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per usable row and component.

    The whitened rows are written to the shared folder once; ``identity_error`` is measured on them.
    """
    rows = stage(whiten(vectors, components), "whitened")
    first = rows.select(F.size("explained").alias("k")).first()
    error = identity_error(rows, first["k"] if first else 0)
    each = rows.select("vec_id", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
