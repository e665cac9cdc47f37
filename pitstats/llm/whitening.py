"""Whitening of embeddings by principal components of their exact integer grid.

An entry c becomes the whole number floor(64 c) + 1,000,000. Each distinct vector of such numbers is fitted once:
partitions sum their vectors exactly, then multiply what is left after taking the mean away, and the d x d sums are
merged as a tree. The driver holds d x d numbers: eigenvectors of the covariance in float32 are corrected by
Ogita and Aishima's iteration in extended precision, where eigenvalues that it can't tell apart yet are solved among
themselves, on the projection to their own vectors less their mean, before the next round.

Defined results: a row whose vector is null, is empty or holds a null, an infinite or no number is left out, as is one
with an entry of 2**50 and more, which has no exact place on the grid; where vectors differ in length, those of the most
frequent one stay (of equally frequent ones the longest). Null and repeated ids are rows like others; repeated vectors count once in the fit
and each get their rows. A component without variance (fewer distinct vectors than dimensions) has whitened and
explained 0 and doesn't count in the identity error. `deviation` is exact, and null where it does not fit a long. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitstats.llm.common import merged_pieces, pack, slices, written

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Entries of a d x d sum that one merged piece holds.
PIECE = 1 << 20
#: Share of the largest eigenvalue up to which a component has no variance.
FLAT = 1e-13


class Fit(NamedTuple):
    """The fit list's size and sums, and its components as columns, by falling eigenvalue."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers less the mean: the mean's whole part goes exactly, its rest after that."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])
        return (x - np.array(whole, np.int64)).astype(float) - rest

    def projection(self) -> np.ndarray:
        """d x k: projects centred rows on the components, over the root of each one's variance."""
        flat = self.values <= FLAT * max(self.values.max(initial=0.0), 0.0)
        root = np.sqrt(np.where(flat, 1.0, self.values))
        return np.where(flat, 0.0, self.vectors / root)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)**2 for each row."""
        whole = [s // self.n for s in self.sums]
        y, rest = x - np.array(whole, np.int64), [s - w * self.n for s, w in zip(self.sums, whole)]
        most = (float(np.abs(y).max(initial=0)) + 1) * self.n
        if most * most * max(1, x.shape[1]) < 2**62:
            return ((y * self.n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((int(v) * self.n - r) ** 2 for v, r in zip(row, rest)) for row in y]
        return [v if v < 2**63 else None for v in exact]


def grid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`vec_id`, `x`: the vectors that can be whitened, on the grid."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**50))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False)))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return rows.select("vec_id", F.lit(None).cast("array<long>").alias("x")).limit(0)
    rows = rows.where(F.size("v") == length["d"])
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """A list column of equal lengths as rows."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def sums_of(fit_list: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in slices(batches):
            x = matrix(batch)
            # halves, so that no sum of a batch leaves 64 bits
            high, low = x >> 32, x & 0xFFFFFFFF
            total = total + (high.sum(axis=0).astype(object) * 2**32 + low.sum(axis=0).astype(object))
            n += len(x)
        if n:
            sums = [decimal.Decimal(int(v)) for v in (n, *total)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.decimal128(38, 0))], ["dim", "s"])

    rows = fit_list.mapInArrow(partial, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()
    found = [int(r["s"]) for r in sorted(rows, key=lambda r: r["dim"])]
    return (found[0], found[1:]) if found else (0, [])


def products(fit_list: DataFrame, dims: int, project) -> np.ndarray:
    """Sum of the outer products of `project`ed rows, beside their sum as a last row; rows of it are merged in pieces."""
    size = max(1, PIECE // dims)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims))
        for batch in slices(batches):
            y = project(matrix(batch))
            total[:-1] += y.T @ y
            total[-1] += y.sum(axis=0)
        part = TaskContext.get().partitionId()
        for piece, at in enumerate(range(0, dims + 1, size)):
            data = pack([total[at : at + size].ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([piece], pa.int64()), pa.array([data], pa.binary())], ["part", "piece", "data"])

    parts = fit_list.mapInArrow(partial, "part long, piece long, data binary")
    merged = merged_pieces(parts, max(1, fit_list.rdd.getNumPartitions()), np.add)
    return np.concatenate(merged).reshape(dims + 1, dims)


def refined(a: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of a symmetric matrix, to double precision."""
    scale = float(np.abs(a).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(len(a)), np.eye(len(a))
    high = np.longdouble
    a = (a / scale).astype(high)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(high)
    eye, norm, fine = np.eye(len(a), dtype=high), np.sqrt((a * a).sum()), np.finfo(np.float64).eps
    for _ in range(rounds):
        r, s = eye - x.T @ x, x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = s - np.diag(values)
        error = np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum())
        if error <= fine * norm / 4:
            break
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= 2 * error
        x = x + x @ np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        # eigenvalues that this round couldn't tell apart: solved among themselves
        cuts = np.flatnonzero(values[:-1] - values[1:] > 2 * error) + 1
        for own in np.split(np.arange(len(values)), cuts):
            if len(own) > 1:
                part = x[:, own]
                inner = part.T @ (a @ part) - values[own].mean() * (part.T @ part)
                inner = (inner + inner.T) / 2
                top = np.abs(inner).max()
                if np.abs(inner - np.diag(np.diag(inner))).max() > fine * norm / 64:
                    turn = np.linalg.eigh((inner / top).astype(float))[1].astype(high)[:, ::-1]
                    x[:, own] = part @ turn
        # close values leave what rounding makes of S over their small gap: orthonormal again by one Newton step
        x = 1.5 * x - x @ (x.T @ x) / 2
    values = np.diag(x.T @ a @ x) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return np.maximum(values[order] * scale, 0).astype(float), x.astype(float)


def fit(fit_list: DataFrame, components: int) -> Fit | None:
    """Principal components of a list of distinct vectors `x`; None where it is empty."""
    n, sums = sums_of(fit_list)
    if not n:
        return None
    start = Fit(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    found = products(fit_list, len(sums), start.centred)
    covariance = found[:-1] / n - np.outer(found[-1] / n, found[-1] / n)
    values, vectors = refined(covariance)
    return Fit(n, sums, vectors[:, :components], values[:components], float(np.trace(covariance)))


def identity_error(fit_list: DataFrame, found: Fit) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    w = found.projection()
    used = np.abs(w).max(axis=0, initial=0.0) > 0
    if not used.any():
        return 0.0
    w = w[:, used]
    sums = products(fit_list, w.shape[1], lambda x: found.centred(x) @ w)
    mean = sums[-1] / found.n
    return float(np.abs(sums[:-1] / found.n - np.outer(mean, mean) - np.eye(len(mean))).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each vector and component."""
    rows = grid(vectors, id_col, vector_col)
    fit_list = written(rows.select("x").distinct(), "whitening-fit")
    found = fit(fit_list, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    w, k = found.projection(), len(found.values)
    error = identity_error(fit_list, found)
    explained = np.where(np.abs(w).max(axis=0, initial=0.0) > 0, found.values / (found.trace or 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = matrix(batch)
            m = len(x)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, found.n, np.int64)), pa.array(found.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array((found.centred(x) @ w).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
