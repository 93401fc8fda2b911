"""Whitening of embeddings on their leading principal components.

Every task runs over its part of the distinct vectors and keeps a mean and a sum of squared deviations by Welford's
rank-one updates; the tasks' states are merged by the parallel formula, in groups on the executors and at last as a
bounded number on the driver, where the covariance is solved by the symmetric QR algorithm.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muralis.llm.vectors import floored, unpack
from muralis.storage import materialise_with

#: States that reach the driver at most, each of dims x dims numbers.
STATES = 32
#: Rows that a task takes apart at once.
ROWS = 4096


class Moments:
    """Number, mean and sum of products of deviations of the rows so far, and the exact sum of integer rows."""

    def __init__(self, dims: int):
        self.n, self.mean, self.products, self.total = 0, np.zeros(dims), np.zeros((dims, dims)), [0] * dims

    def add(self, rows: np.ndarray) -> None:
        """Welford's update, row by row: a rank-one term of the deviations from the old mean and from the new one."""
        n, mean, products = self.n, self.mean, self.products
        for x in rows.astype(np.float64):
            n += 1
            before = x - mean
            mean += before / n
            products += before[:, None] * (x - mean)
        self.n = n
        if rows.dtype == np.int64:
            self.total = [a + int(b) for a, b in zip(self.total, rows.sum(axis=0), strict=True)]

    def merge(self, other: Moments) -> None:
        """The parallel formula: as if all rows had been seen by one."""
        n = self.n + other.n
        if other.n:
            apart = other.mean - self.mean
            self.products += other.products + np.outer(apart, apart) * (self.n * other.n / n)
            self.mean += apart * (other.n / n)
        self.n = n
        self.total = [a + b for a, b in zip(self.total, other.total, strict=True)]

    def covariance(self) -> np.ndarray:
        c = self.products / max(1, self.n)
        return (c + c.T) / 2


def moments(rows: DataFrame, dims: int, of: object | None = None) -> Moments:
    """The moments of all rows of ``rows`` (x packed), or of their images under ``of`` (a broadcast Whitening)."""
    width = dims if of is None else len(of.value.scale)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Moments(width)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = unpack(batch.column(0).slice(at, ROWS).to_pylist(), dims)
                seen.add(x if of is None else of.value.image(x))
        if seen.n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % STATES], pa.int32()), pa.array([pickle.dumps(seen)], pa.binary())], ["slot", "state"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One state at a time, so a slot's many states are never held together."""
        seen, slot = Moments(width), None
        for batch in batches:
            for slot, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):  # noqa: B007
                seen.merge(pickle.loads(state))  # noqa: S301 - made by this job
        if slot is not None:
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([pickle.dumps(seen)], pa.binary())], ["slot", "state"])

    # Each of the STATES partitions merges the states that are dealt to it; at most STATES rows are collected.
    states = rows.select("x").mapInArrow(gather, "slot int, state binary")
    merged = states.repartition(STATES, "slot").mapInArrow(together, "slot int, state binary")
    out = Moments(width)
    for row in sorted(merged.collect(), key=lambda r: r.slot):
        out.merge(pickle.loads(row.state))  # noqa: S301 - made by this job
    return out


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns: Householder reflections to a tridiagonal matrix, then QR steps with
    Wilkinson's shift that chase the bulge down, until every off-diagonal entry is negligible."""
    a = np.array(matrix, np.float64)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v[0] += math.copysign(length, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    d, e = np.diag(a).copy(), np.diag(a, 1).copy()
    eps, hi, steps = np.finfo(float).eps, n - 1, 0
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if small[hi - 1]:
            hi, steps = hi - 1, 0
            continue
        steps += 1
        if steps > 200:
            raise ArithmeticError("the QR steps did not settle")
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0.0:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        root = math.hypot(half, e[hi - 1])
        shift = d[hi] - e[hi - 1] ** 2 / (half + math.copysign(root, half)) if root else d[hi]
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k + 1 < hi:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            left, right = q[:, k].copy(), q[:, k + 1].copy()
            q[:, k], q[:, k + 1] = c * left + s * right, c * right - s * left
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


class Whitening:
    """The leading components of the fitted rows: image(x) has covariance 1 on them."""

    def __init__(self, fitted: Moments, components: int):
        self.n, self.total = fitted.n, fitted.total
        values, vectors = symmetric_qr(fitted.covariance()) if fitted.total else (np.zeros(0), np.zeros((0, 0)))
        least = 64 * np.finfo(float).eps * max(1, len(values)) * max(0.0, values[0]) if len(values) else 0.0
        trace = float(np.trace(fitted.covariance()))
        self.values, self.vectors = values[:components], vectors[:, :components]
        self.spread = self.values > least  # a component without spread whitens nothing
        self.scale = np.where(self.spread, np.sqrt(np.maximum(self.values, 0.0)), np.nan)
        self.explained = [float(v / trace) if trace > 0 else None for v in np.maximum(self.values, 0.0)]
        self.mean = np.array([t / max(1, self.n) for t in self.total])

    def image(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.vectors) / self.scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - total)^2, exact; null where it exceeds a long."""
        top = max((abs(t) for t in self.total), default=0) + self.n * int(np.abs(x).max(initial=0))
        kind = np.int64 if x.shape[1] * top * top < 1 << 62 else object
        found = ((x.astype(kind) * self.n - np.array(self.total, kind)) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in found]


def whiten_embeddings(vectors: DataFrame, *, components: int = 4, scale: float = 256.0) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: ``components`` rows (as many as there are dimensions, if
    fewer) for each usable row of ``vectors`` (vec_id, embedding), whose components c count as floor(scale * c).

    The model is fitted on every distinct vector once. Vectors that are null or hold null or non-finite components give no
    rows; shorter vectors count as padded with zeros. Repeated rows and null ids give rows each. Equal eigenvalues leave
    their components free within their plane; one choice holds for all rows. A component without spread has null in whitened,
    and explained is null where nothing varies; identity_error is over the other components, null if there is none. A deviation
    beyond a long is null. Components beyond 2^52 raise ValueError. An empty table gives no rows.
    """
    spark: SparkSession = vectors.sparkSession
    rows = floored(vectors, scale, "vec_id")
    # A vector that many rows share is dropped before the shuffle but for one row a task.
    distinct, facts = materialise_with(floored(vectors, scale).groupBy("x").max("size").withColumnRenamed("max(size)", "size"), "vectors", dims=F.max("size"))
    dims = int(facts["dims"])
    fitted = moments(distinct, dims)
    model = spark.sparkContext.broadcast(Whitening(fitted, components))  # components x dims numbers
    w = model.value
    kept = np.flatnonzero(w.spread)
    error = float(np.abs(moments(distinct, dims, model).covariance()[np.ix_(kept, kept)] - np.eye(len(kept))).max()) if len(kept) else None

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        k = len(m.values)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = unpack(part.column(1).to_pylist(), dims)
                each = np.repeat(np.arange(len(x)), k)
                image = m.image(x).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array([m.n] * len(each), pa.int64()),
                        pa.array(m.deviations(x), pa.int64()).take(pa.array(each)), pa.array(image, pa.float64(), mask=np.isnan(image)), pa.array(m.explained * len(x), pa.float64()), pa.array([error] * len(each), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = dict(vectors.dtypes)["vec_id"]
    return rows.select("vec_id", "x").mapInArrow(project, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
