"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Components of vectors become integers, so that counts, sums and deviations are exact. Three passes run over the vectors,
each with one partial result a task: sums; the scatter of what is left after the mean is taken off in integers; and the
scatter of the whitened vectors, from which the departure from the identity is measured. Spark adds the partial results
up by place in the matrix; the driver gets one matrix of the square of the dimension, whatever the number of rows.

Cholesky with the greatest remaining diagonal entry first stops at the rank. Rotations of pairs of columns then make the
columns of the factor orthogonal: their squared norms are the eigenvalues and their directions the components, both of
high relative accuracy, since the scatter itself is never rotated.

Cases: a vector that is null or holds a null or non-finite component takes no part; the dimension is that of the longest
vector, and shorter ones, empty ones included, have 0 for what they lack; a null vec_id stays null; rows that occur again
count and are returned again; components beyond the rank (a constant dimension, one row, equal rows) don't exist, so that
without variance or without rows the result is empty; a deviation beyond the range of a long is null; further columns,
of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.llm.common import finite_vectors, list_matrix

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
SWEEPS, CONVERGED = 60, 1e-15
#: Integers stay within this, so that sums of them do not overflow.
LARGEST = float(1 << 50)


@dataclass(frozen=True)
class Whitening:
    """n, sums of the integers by dimension, eigenvalues of the covariance (falling), components as rows, and its trace."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n; the difference is taken in integers."""
        return _offsets(x, self.n, self.sums).astype(np.float64) / self.n

    def apply(self, x: np.ndarray, most: int) -> np.ndarray:
        k = min(most, len(self.eigenvalues))
        return self.centred(x) @ (self.components[:k] / np.sqrt(self.eigenvalues[:k])[:, None]).T


def _offsets(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, in int64 or, where that is too narrow, in Python's integers."""
    wide = n * (int(np.abs(x).max()) if x.size else 0) + (int(np.abs(sums).max()) if sums.size else 0)
    return x * n - sums if wide < 1 << 62 else x.astype(object) * n - sums.astype(object)


def integers(column: pa.Array, width: int = 0) -> np.ndarray:
    """floor(64 * c) + 1000000 for each component, as rows of at least `width` entries."""
    return np.clip(np.floor(SCALE * list_matrix(column, np.float64, width)), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sums over dimensions of (n * x - sums) ** 2, exact; null beyond a long."""
    y = _offsets(x, n, sums)
    most = int(np.abs(y).max()) if y.size else 0
    if most * most * max(1, y.shape[1]) < 1 << 63:
        return pa.array((y * y).sum(1).astype(np.int64))
    exact = (y.astype(object) ** 2).sum(1)
    return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())


# ---------------------------------------------------------------- passes over the vectors


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each dimension, and the number of vectors as dimension -1."""
    n, total = 0, np.zeros(0, np.int64)
    for batch in batches:
        x = integers(batch.column(0), len(total))
        if x.shape[1] > len(total):  # what earlier vectors lack is 0
            total = np.concatenate([total, np.full(x.shape[1] - len(total), n * SHIFT)])
        n, total = n + len(x), total + x.sum(0)
    yield pa.record_batch({"i": pa.array(np.arange(-1, len(total)), pa.int32()), "n": pa.array(np.full(len(total) + 1, n), pa.int64()), "s": pa.array(np.concatenate([[n], total]).astype(np.int64))})


def _scatter(prepared):
    """The pass that adds up the products of the rows that `prepared` makes of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = prepared(batch.column(0))
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None and total.size:
            d = len(total)
            at = pa.array(np.arange(d + 1) * d, pa.int32())
            yield pa.record_batch({"i": pa.array(np.arange(d), pa.int32()), "v": pa.ListArray.from_arrays(at, pa.array(total.ravel()))})

    return run


def _added(rows: DataFrame, d: int) -> np.ndarray:
    """The sum of the tasks' matrices, added by place; d rows of d numbers come to the driver."""
    each = rows.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    lines = each.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("v")).collect()
    out = np.zeros((d, d))
    for line in lines:
        out[line["i"]] = line["v"]
    return out


# ---------------------------------------------------------------- the factorization


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L of as many columns as the rank, and the order of rows, so that a[order][:, order] = L @ L.T."""
    a = a.astype(np.float64, copy=True)
    d = len(a)
    order, out = np.arange(d), np.zeros((d, d))
    # what is left of a dimension's own variance beyond the rounding of it, so that dimensions may differ in scale
    least = d * np.finfo(np.float64).eps * a.diagonal()
    for k in range(d):
        left = np.where(a.diagonal() > least[order], a.diagonal(), -1.0)[k:]
        p = k + int(np.argmax(left))
        if left[p - k] < 0:
            return out[:, :k], order
        for m in (a, a.T, out):
            m[[k, p]] = m[[p, k]]
        order[[k, p]] = order[[p, k]]
        out[k:, k] = a[k:, k] / np.sqrt(a[k, k])
        a[k + 1 :, k + 1 :] -= np.outer(out[k + 1 :, k], out[k + 1 :, k])
    return out, order


def _rounds(m: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of m columns, as rounds of pairs that share no column, each column meeting each once."""
    ring = list(range(m)) + [-1] * (m % 2)
    out = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(a, b) for a, b in zip(ring[:half], ring[::-1][:half], strict=True) if min(a, b) >= 0]
        out.append((np.array([min(p) for p in pairs]), np.array([max(p) for p in pairs])))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) of factor @ factor.T and their unit vectors, as rows, from rotations of factor's columns."""
    cols = np.ascontiguousarray(factor.T, np.float64)
    rounds = _rounds(len(cols)) if len(cols) > 1 else []
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in rounds:
            x, y = cols[p], cols[q]
            a, b, g = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            angle = np.abs(g) / np.sqrt(a * b)
            worst = max(worst, float(angle.max()))
            turn = angle > CONVERGED
            zeta = (b - a) / np.where(turn, 2 * g, 1.0)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            cols[p], cols[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
        if worst <= len(factor) * CONVERGED:
            break
    values = (cols * cols).sum(1)
    falling = np.argsort(-values, kind="stable")
    return values[falling], cols[falling] / np.sqrt(values[falling])[:, None]


# ---------------------------------------------------------------- the operator


def fit(vectors: DataFrame, column: str = "embedding") -> Whitening | None:
    """The whitening of all vectors of the column; None without any."""
    rows = finite_vectors(vectors, column).select(column)
    sums = rows.mapInArrow(_sums, "i int, n long, s long")
    # a task whose vectors are all shorter lacks the last dimensions, which are 0 in each of its vectors
    by = {r["i"]: (r["n"], r["s"]) for r in sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
    n = by.pop(-1, (0, 0))[1]
    if not n:
        return None
    total = np.array([by[i][1] + (n - by[i][0]) * SHIFT for i in range(len(by))], np.int64)
    plain = Whitening(n, total, np.zeros(0), np.zeros((0, len(total))), 0.0)
    covariance = _added(rows.mapInArrow(_scatter(lambda c: plain.centred(integers(c, len(total)))), "i int, v array<double>"), len(total)) / n
    factor, order = pivoted_cholesky(covariance)
    values, turned = one_sided_jacobi(factor)
    components = np.zeros_like(turned)
    components[:, order] = turned
    return Whitening(n, total, values, components, float(np.trace(covariance)))


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding", most: int = COMPONENTS) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured over all vectors."""
    k, d = min(most, len(model.eigenvalues)), len(model.sums)
    rows = finite_vectors(vectors, column).select(column)
    measured = _added(rows.mapInArrow(_scatter(lambda c: model.apply(integers(c, d), k)), "i int, v array<double>"), k) / model.n
    return float(np.abs(measured - np.eye(k)).max())


def whitened(vectors: DataFrame, model: Whitening, key: str = "vec_id", column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """key, deviation and whitened (an array, the components in order) for each vector that takes part."""
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1), d)
            w = model.apply(x, most)
            at = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            yield pa.record_batch({key: batch.column(0), "deviation": deviations(x, model.n, model.sums), "whitened": pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(w).ravel()))})

    rows = finite_vectors(vectors, column).select(key, column)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, deviation long, whitened array<double>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    model = fit(vectors)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues[:COMPONENTS]])
    rows = whitened(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "w"))
    return rows.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"), share[F.col("i")].alias("explained"), F.lit(identity_error(vectors, model)).alias("identity_error"))
