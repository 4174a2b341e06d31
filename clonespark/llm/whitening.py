"""Whitening of embedding vectors with a polarisation covariance.

Vectors are turned into whole numbers ``x = floor(64 c) + 1000000`` and the model is fitted
on each distinct one of them once. Variances are the only second moments that are ever
gathered: of every dimension, and of the sum of every two dimensions. By polarisation

    cov(i, j) = (var(i + j) - var(i) - var(j)) / 2

All moments are exact integers. With ``q = floor(S / n)`` and ``r = S - n q`` the centred value
``n x - S`` is ``n (x - q) - r``, so tasks sum the squares of ``x - q``, which is centred to less than
one unit and therefore small, and the rest follows exactly:

    sum (n x - S)^2 = n^2 sum (x - q)^2 - n r^2

and likewise for sums of two dimensions. Only these sums leave a task, one row per pair of
dimensions, in two halves of 60 bits that no amount of rows overflows. The driver divides
them once, correctly rounded, and takes the eigenvectors; what it holds grows with the
square of the dimension and not with the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this are no 64-bit numbers once scaled and shifted.
LIMIT = float(1 << 62)
LIMB = 60
#: Values of one intermediate array in a task.
CELLS = 1 << 19
#: The driver takes eigenvectors of a matrix of this many rows at most.
MOST_DIMENSIONS = 4096
OUT = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"


def _whole(column: str) -> Column:
    """``array<long>`` of a vector, null where it is null or has an entry that is null, not finite or too large."""
    scaled = F.transform(F.col(column).cast("array<double>"), lambda c: c * F.lit(float(SCALE)))
    usable = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LIMIT)))
    return F.when(usable & (F.size(scaled) > 0), F.transform(scaled, lambda c: F.floor(c).cast("long") + F.lit(SHIFT).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _exact(y: np.ndarray) -> np.ndarray:
    """``y`` itself where squares of sums of two entries, added over its rows, fit 64 bits; else Python integers."""
    most = max(abs(int(y.max())), abs(int(y.min()))) if y.size else 0
    return y if 4 * most * most * len(y) < 1 << 62 else y.astype(object)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows, and the exact sum of each dimension."""

    def add(batches):
        n, total = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            if len(x):
                x = x if max(abs(int(x.max())), abs(int(x.min()))) * len(x) < 1 << 62 else x.astype(object)
                n += len(x)
                total = [a + int(b) for a, b in zip(total, x.sum(axis=0), strict=True)]
        if not n:
            return
        rows = [(-1, 0, n), *((i, s >> LIMB, s & ((1 << LIMB) - 1)) for i, s in enumerate(total))]
        yield pa.RecordBatch.from_pydict({"i": pa.array([r[0] for r in rows], pa.int32()), "high": pa.array([r[1] for r in rows], pa.int64()), "low": pa.array([r[2] for r in rows], pa.int64())})

    rows = fit.select("x").mapInArrow(add, "i int, high long, low long").groupBy("i").agg(_added("high"), _added("low")).collect()
    got = {r["i"]: (int(r["high"]) << LIMB) + int(r["low"]) for r in rows}
    return got.get(-1, 0), [got.get(i, 0) for i in range(d)]


def _added(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(38,0)")).alias(column)


def _squares(fit: DataFrame, d: int, centre: list[int]) -> dict[tuple[int, int], int]:
    """Exact ``sum (y_i)^2`` under ``(i, i)`` and ``sum (y_i + y_j)^2`` under ``(i, j)``, ``y = x - centre``."""

    def add(batches):
        origin = np.array(centre, np.int64)
        total, held, rows = np.zeros((d, d), object), np.zeros((d, d), np.int64), 0
        step = max(1, CELLS // d)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            rows += len(x)
            for begin in range(0, len(x), step):
                y = _exact(x[begin : begin + step] - origin)
                part = np.empty((d, d), y.dtype)
                for i in range(d):
                    both = y[:, i : i + 1] + y[:, i:]
                    part[i, i:] = (both * both).sum(axis=0)
                    part[i, :i] = 0
                if part.dtype == object or int(held.max()) + int(part.max()) >= 1 << 62:
                    total, held = total + held, np.zeros((d, d), np.int64)
                if part.dtype == object:
                    total = total + part
                else:
                    held = held + part
        if not rows:
            return
        total = total + held
        i, j = np.triu_indices(d)
        values = [int(v) // 4 if a == b else int(v) for v, a, b in zip(total[i, j], i, j, strict=True)]  # (y_i + y_i)^2 = 4 y_i^2
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
            "high": pa.array([str(v >> LIMB) for v in values], pa.string()), "low": pa.array([v & ((1 << LIMB) - 1) for v in values], pa.int64()),
        })

    rows = fit.select("x").mapInArrow(add, "i int, j int, high string, low long").groupBy("i", "j").agg(_added("high"), _added("low")).collect()
    return {(r["i"], r["j"]): (int(r["high"]) << LIMB) + int(r["low"]) for r in rows}


def polarised(n: int, sums: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix, each entry the correctly rounded quotient of two exact integers."""
    d = len(sums)
    rest = [s % n for s in sums]
    whole = {(i, j): n * n * q - n * (rest[i] if i == j else rest[i] + rest[j]) ** 2 for (i, j), q in squares.items()}
    out = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            cross = 2 * whole[i, i] if i == j else whole[i, j] - whole[i, i] - whole[j, j]
            out[i, j] = out[j, i] = cross / (2 * n**3)
    return out


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``(eigenvalues, unit eigenvectors as columns)``, falling, without those that are zero but for rounding.

    The entry of largest size of a vector is positive.
    """
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = values > len(values) * np.finfo(float).eps * max(float(values[0]), 0.0)
    values, vectors = values[keep][:most], vectors[:, keep][:, :most]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n`` in doubles: the whole part is taken off in integers first."""
    return (x - np.array([s // n for s in sums], np.int64)) - np.array([(s % n) / n for s in sums])


def _identity_error(fit: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> float:
    """Largest absolute entry of the covariance of whitened fit vectors minus the identity."""
    d, k = basis.shape

    def add(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            white = _centred(_matrix(batch.column(0), d), n, sums) @ basis
            first += white.sum(axis=0)
            second += white.T @ white
        i, j = np.indices((k + 1, k)).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(np.vstack([second, first]).ravel())})

    got = {(r["i"], r["j"]): r["v"] for r in fit.select("x").mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([got[k, j] for j in range(k)]) / n
    second = np.array([[got[i, j] for j in range(k)] for i in range(k)]) / n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, most: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Project vectors on the ``most`` strongest components of their covariance, at unit variance.

    Returns one row per usable input row: ``vec_id``, ``n`` (vectors of the fit list), ``deviation``
    (sum over dimensions of ``(n x - S)^2``, exact; null if it is no 64-bit number), ``whitened``
    and ``explained`` (one entry per component, by falling eigenvalue) and ``identity_error`` (how far the
    covariance of the whitened fit list is from the identity).

    Dropped are rows whose vector is null, empty, holds a null, an entry that is not finite or
    one too large for 64 bits when scaled, and rows whose vector has another length than most distinct vectors
    have (of equally frequent lengths the larger counts). Repeated vectors count once in the fit and are all returned, as
    are rows that share an id or have none. Components without variance are left out, so a
    table of one distinct vector gives empty arrays and an ``identity_error`` of 0. An empty
    table gives no rows. Other columns are ignored.
    """
    x = vectors.select(F.col(key).cast("long").alias("vec_id"), _whole(vector).alias("x")).filter("x is not null")
    fit = stored(x.select("x").distinct(), "whitening-fit")
    lead = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lead is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    d = lead["d"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"Vectors of {d} entries: the covariance is assembled on the driver, for {MOST_DIMENSIONS} at most.")
    fit = fit.filter(F.size("x") == d)
    n, sums = _sums(fit, d)
    covariance = polarised(n, sums, _squares(fit, d, [s // n for s in sums]))
    values, axes = components(covariance, most)
    basis = axes / np.sqrt(values)
    trace = float(np.trace(covariance))
    error = _identity_error(fit, n, sums, basis) if len(values) else 0.0
    explained = (values / trace).tolist() if len(values) else []

    def project(batches):
        origin = np.array([s // n for s in sums], np.int64)
        rest = np.array([s % n for s in sums], np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            y = x - origin
            if len(y) and (max(abs(int(y.max())), abs(int(y.min()))) + 1) ** 2 * n * n * d >= 1 << 62:
                z = y.astype(object) * n - rest.astype(object)
                far = [int(v) if v < 1 << 63 else None for v in (z * z).sum(axis=1)]
            else:
                z = y * n - rest
                far = (z * z).sum(axis=1)
            white = _centred(x, n, sums) @ basis
            offsets = np.arange(len(x) + 1, dtype=np.int32) * len(values)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "n": pa.array(np.full(len(x), n)), "deviation": pa.array(far, pa.int64()),
                "whitened": pa.ListArray.from_arrays(offsets, pa.array(white.ravel())),
                "explained": pa.ListArray.from_arrays(offsets, pa.array(np.tile(explained, len(x)), pa.float64())),
                "identity_error": pa.array(np.full(len(x), error)),
            })

    return x.filter(F.size("x") == d).mapInArrow(project, OUT)
