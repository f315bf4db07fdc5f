"""Embedding whitening by mixed-precision eigenvectors.

Entries become integers, so that equal vectors are equal bytes: the fit list is each distinct vector once. Its sums are exact; its
covariance is summed over the tasks from centred rows. The eigenvectors of that matrix start from a float32 decomposition and are
corrected by the matrix-multiplication iterations of Ogita and Aishima (2018) in float64, which converge quadratically. Where
eigenvalues lie closer together than the iteration can tell apart (their paper of 2019), the cluster's block is solved by itself:
shifted by its mean and scaled up, its differences are large again, float32 tells them apart, and the next rounds correct them.

The driver holds matrices of dimensions x dimensions (at most ``MOST_DIMENSIONS``) and nothing that grows with the vectors.

Defined results: a row whose vector is null or holds null, NaN or infinite entries is dropped, and so is a row whose vector is
not as long as most (of equally frequent lengths, the longest; empty vectors have no dimension to project on); null ids and
repeated rows are rows like any other; a component without variance (its eigenvalue within rounding of 0, as with fewer distinct
vectors than components) has null ``whitened`` and counts nothing in ``identity_error``; a ``deviation`` that no long holds is
null; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import materialize

SCALE, SHIFT = 64, 1_000_000
MOST_DIMENSIONS = 4096
#: The largest entry that is kept apart from larger ones.
FURTHEST = 1 << 61
WIDTHS = (1, 2, 4, 8)


def symmetric_eigen(a: np.ndarray, most_rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and orthonormal eigenvectors (columns) of a symmetric float64 matrix."""
    size = np.abs(a).max(initial=0.0)
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    a = (a + a.T) / (2 * size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    best, least, idle = x, np.inf, 0
    for _ in range(most_rounds):
        r = np.eye(len(a)) - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        value = np.diag(s) / (1 - np.diag(r))
        far = 2 * (np.linalg.norm(s - np.diag(value), 2) + np.linalg.norm(r, 2))
        gap = value[None, :] - value[:, None]
        clear = np.abs(gap) > far
        x = x + x @ np.where(clear, (s + value[None, :] * r) / np.where(clear, gap, 1.0), r / 2)
        for block in clusters(value, far):
            x[:, block] = x[:, block] @ within(a, x[:, block])
        change = np.linalg.norm(x.T @ x - np.eye(len(a))) + off_diagonal(a, x)
        idle = 0 if change < least / 2 else idle + 1
        if change < least:
            best, least = x, change
        if idle == 3:  # down to rounding
            break
    x = best
    value = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-value, kind="stable")
    x = x[:, order] / np.linalg.norm(x[:, order], axis=0)
    return value[order] * size, x


def off_diagonal(a: np.ndarray, x: np.ndarray) -> float:
    s = x.T @ a @ x
    return float(np.linalg.norm(s - np.diag(np.diag(s))))


def clusters(value: np.ndarray, far: float) -> Iterator[np.ndarray]:
    """Columns whose eigenvalues follow one another by no more than ``far``: two or more, but not all at once by rounding alone."""
    order = np.argsort(value)
    for block in np.split(order, np.flatnonzero(np.diff(value[order]) > far) + 1):
        if len(block) > 1:
            yield np.sort(block)


def within(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rotation of a cluster's basis to its own eigenvectors: the block less its mean, scaled up, decomposed as a matrix of its own."""
    block = x.T @ (a @ x)
    block = (block + block.T) / 2
    block = block - np.eye(len(block)) * np.trace(block) / len(block)
    if np.abs(block).max() <= 4 * np.finfo(np.float64).eps * len(a):
        return np.eye(len(block))  # equal to rounding: any basis will do
    # float32 tells the scaled differences apart; one correction in float64 follows with the next round of the whole
    scaled = block / np.abs(block).max()
    w = np.linalg.eigh(scaled.astype(np.float32))[1].astype(np.float64)
    return w + w @ ((np.eye(len(w)) - w.T @ w) / 2)


def encoded(x: np.ndarray) -> bytes:
    """The integers of a vector in as few bytes as its largest needs, behind a byte that says how many: equal vectors, equal bytes."""
    top = int(max(x.max(), ~x.min()))
    width = next(w for w in WIDTHS if top < 1 << (8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def decoded(column: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of integers, less ``SHIFT``."""
    out = np.empty((len(column), dimensions), np.int64)
    for i, v in enumerate(column):
        body = v.as_py()
        out[i] = np.frombuffer(body, f"<i{body[0]}", offset=1)
    return out


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, length, x (``encoded``, less ``SHIFT``) of the rows whose vectors hold finite entries only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, lengths = [], [], []
            flat = batch.column(1)
            start = flat.offsets.to_numpy()
            values = flat.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
            for i, known in enumerate(flat.is_valid()):
                v = values[start[i] : start[i + 1]]
                if known.as_py() and len(v) and np.isfinite(v).all():
                    with np.errstate(over="ignore"):
                        scaled = np.clip(np.floor(SCALE * v), -FURTHEST, FURTHEST)
                    ids.append(i)
                    out.append(encoded(scaled.astype(np.int64)))
                    lengths.append(len(v))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(lengths, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "length", "x"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, length int, x binary")


def summed(fit: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their integers (less ``SHIFT``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dimensions, np.int64), np.zeros(dimensions, np.int64)
        for batch in batches:
            x = decoded(batch.column(0), dimensions)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        at = np.arange(dimensions)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(dimensions, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    rows = fit.select("x").mapInArrow(run, "i long, n long, high long, low long").groupBy("i").agg(*[F.sum(k).alias(k) for k in ("n", "high", "low")]).collect()
    sums = {r["i"]: (r["high"] << 32) + r["low"] for r in rows}
    return (rows[0]["n"] if rows else 0), [sums.get(i, 0) for i in range(dimensions)]


def products(fit: DataFrame, mean: np.ndarray, basis: np.ndarray | None = None) -> np.ndarray:
    """Sum over the vectors of the outer products of their centred (and, with a basis, projected) rows."""
    k = len(mean) if basis is None else basis.shape[1]
    dimensions = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            y = decoded(batch.column(0), dimensions) - mean
            y = y if basis is None else y @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = fit.select("x").mapInArrow(run, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "v")).where("j <= i")
    out = np.zeros((k, k))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow().to_pylist():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def whitened(vectors: DataFrame, most: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each kept vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = materialize(integers(vectors))
    lengths = rows.groupBy("length").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), F.desc("length")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = lengths["length"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions: the driver's matrices are meant for at most {MOST_DIMENSIONS}")
    rows = rows.where(F.col("length") == d)
    fit = materialize(rows.select("x").distinct())
    n, sums = summed(fit, d)
    mean = np.array([s / n for s in sums])
    covariance = products(fit, mean) / n
    value, x = symmetric_eigen(covariance)
    value, x, trace = value[:most], x[:, :most], float(np.trace(covariance))
    real = value > 16 * np.finfo(np.float64).eps * d * max(trace, 0.0)
    basis = np.where(real, x / np.sqrt(np.where(real, value, 1.0)), 0.0)
    error = float(np.abs((products(fit, mean, basis) / n - np.eye(len(value)))[np.ix_(real, real)]).max(initial=0.0))
    k, explained = len(value), value / trace if trace > 0 else np.zeros(len(value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                y, m = decoded(part.column(1), d), part.num_rows
                w = (y - mean) @ basis
                columns = [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array([v for v in deviations(y, n, sums) for _ in range(k)], pa.int64()), pa.array(w.ravel(), mask=np.tile(~real, m)),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)


def deviations(y: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 of every row, exact; None beyond a long. The shift by ``SHIFT`` falls out."""
    top = n * max(int(np.abs(y).max(initial=0)), 1) + max(map(abs, sums))
    if top * top * y.shape[1] < 1 << 63:
        return ((n * y - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in y.tolist()]
    return [v if v < 1 << 63 else None for v in exact]
