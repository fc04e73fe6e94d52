"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become whole numbers ``x = floor(64 c) + 1000000``. Components are the leading unit
eigenvectors of the covariance ``V`` of x over all vectors (divisor n, centred before multiplying),
numbered by falling eigenvalue e; a vector's whitened value is ``x - mean`` projected on the
component, over ``sqrt(e)``.

The covariance is never formed. A pass multiplies it with a block Q of a few more columns than
components: every task adds up ``Xc' (Xc Q)`` of its rows, Spark adds the tasks' sums by entry, and
the driver gets one matrix of ``dimension x columns``. Vectors are staged as blocks of rows, so a
pass reads packed numbers; no row is shuffled.

* Filter. ``T_m`` of ``V``, scaled so that the unwanted spectrum falls on [-1, 1], is applied to Q
  by the three-term recurrence, one pass a step. Everything wanted grows, the rest is damped. The
  upper end of the unwanted interval is the least Ritz value of the block; the lower end comes from
  a Lanczos recurrence that rides along as one more column of every pass. If it is a little too
  high nothing breaks: such directions grow, but less than wanted ones, and Ritz values tell.
* The degree m is as large as the growth ``MOST_GROWTH`` of the leading direction allows, so that
  it does not drown the others in rounding.
* Then QR and Rayleigh-Ritz. Vectors whose residual ``|V q - e q|`` is below ``TOLERANCE`` of the
  largest eigenvalue are locked and kept out of the block, which lets the degree grow.
* Certificate. At last one pass over all components and the rest of the block gives residuals and
  Ritz values anew; the leading ones are taken, and if one has a residual above ``ROUNDING`` of the
  largest eigenvalue, iteration goes on. A block that stops improving above that is widened, at last
  to all dimensions, where Rayleigh-Ritz is exact; below that, sums of many numbers allow no better.

A further pass measures the whitened covariance itself.

Defined cases: rows whose vector is null, empty, holds null or non-finite entries, or entries whose
x is beyond 2**62, are left out; so are vectors whose length is not the most frequent one (of equal
frequencies, the greater); rows that repeat count each; a null id stays null; extra columns are not
carried; directions without variance (eigenvalue at most rounding of the largest) are no
components; an empty table, or one vector alone, gives no components and so no whitened values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from meterbook.session import Staging

COMPONENTS = 32
GUARD = 8
TOLERANCE = 2e-14
ROUNDING = 1e-12
PATIENCE = 2
ATTEMPTS = 5
MOST_GROWTH = 1e9
MOST_DEGREE = 24
SHIFT = 1_000_000
SCALE = 64
_BLOCK_BYTES = 2 << 20
_LANCZOS_STEPS = 40
_LIMIT = float(1 << 62)


def _packed(ids_type: pa.DataType):
    """Rows of valid vectors as blocks ``dim, n, ids, data`` of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.columns
            keep = vectors.is_valid()
            ids, vectors = ids.filter(keep), vectors.filter(keep)
            lengths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten()
            entries = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore"):
                scaled = np.floor(SCALE * entries) + SHIFT
                good = np.abs(scaled) < _LIMIT  # false for NaN, infinity and null
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            wrong = np.concatenate([[0], np.cumsum(~good)])
            valid = (wrong[bounds[1:]] == wrong[bounds[:-1]]) & (lengths > 0)
            for dim in np.unique(lengths[valid]).tolist():
                rows = np.flatnonzero(valid & (lengths == dim))
                size = max(1, _BLOCK_BYTES // (8 * dim))
                for k in range(0, len(rows), size):
                    part = rows[k : k + size]
                    data = scaled[(bounds[part][:, None] + np.arange(dim)).ravel()].astype("<i8")
                    arrays = [
                        pa.array([dim], pa.int32()),
                        pa.array([len(part)], pa.int64()),
                        pa.ListArray.from_arrays([0, len(part)], ids.take(pa.array(part))),
                        pa.array([data.tobytes()], pa.binary()),
                    ]
                    arrays[2] = arrays[2].cast(pa.list_(ids_type))
                    yield pa.RecordBatch.from_arrays(arrays, ["dim", "n", "ids", "data"])

    return run


def blocks(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``dim, n, ids, data``: the valid vectors, packed."""
    kind = vectors.schema[id_column].dataType
    schema = f"dim int, n bigint, ids array<{kind.simpleString()}>, data binary"
    return vectors.select(id_column, vector_column).mapInArrow(_packed(to_arrow_type(kind)), schema)


def _matrices(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[np.ndarray]:
    for batch in batches:
        for data, dim in zip(batch.column(column), batch.column(column + 1)):
            yield np.frombuffer(data.as_py(), "<i8").reshape(-1, dim.as_py())


def _exact_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``j, total`` per dimension: sums of a task's rows."""
    total = None
    for x in _matrices(batches):
        part = (x.astype(object) if len(x) * np.abs(x).max() >= _LIMIT else x).sum(axis=0).astype(object)
        total = part if total is None else total + part
    total = [] if total is None else [int(v) for v in total]
    arrays = [pa.array(range(len(total)), pa.int32()), pa.array(total, pa.decimal128(38, 0))]
    yield pa.RecordBatch.from_arrays(arrays, ["j", "total"])


@dataclass
class Centre:
    """Exact mean: sum over rows of each dimension, and their number."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - mean``; the whole part is taken off exactly, before rounding."""
        return (x - self.whole).astype(np.float64) - np.array([r / self.n for r in self.rest], np.float64)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact ``sum of (n x - sum)**2`` over the dimensions of every row."""
        near = x - self.whole
        most = self.n * (int(np.abs(near).max(initial=0)) + 1)
        if most * most * x.shape[1] < 1 << 62:
            a = near * self.n - self.rest.astype(np.int64)
            return (a * a).sum(axis=1).tolist()
        a = near.astype(object) * self.n - self.rest
        return [int(v) for v in (a * a).sum(axis=1)]


def _entries(matrix: np.ndarray) -> pa.RecordBatch:
    i, j = np.indices(matrix.shape)
    arrays = [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(matrix.ravel())]
    return pa.RecordBatch.from_arrays(arrays, ["i", "j", "v"])


def _summed(rows: DataFrame, per_task, shape: tuple[int, int]) -> np.ndarray:
    """Sum over tasks of one matrix each; the driver gets ``shape`` entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _matrices(batches):
            part = per_task(x)
            total = part if total is None else total + part
        if total is not None:
            yield _entries(total)

    out = np.zeros(shape)
    sums = rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    for r in sums.collect():
        out[r.i, r.j] = r.v
    return out


class _Lanczos:
    """Estimate of the least eigenvalue, from one column of every pass."""

    def __init__(self, dim: int, rng: np.random.Generator):
        self.basis = [self._unit(rng.standard_normal(dim))]
        self.alpha, self.beta, self.done = [], [], dim == 1

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.linalg.norm(v)

    @property
    def column(self) -> np.ndarray:
        return self.basis[-1][:, None]

    def advance(self, product: np.ndarray) -> None:
        if self.done:
            return
        self.alpha.append(float(self.basis[-1] @ product))
        basis = np.column_stack(self.basis)
        for _ in range(2):
            product = product - basis @ (basis.T @ product)
        size = float(np.linalg.norm(product))
        self.beta.append(size)
        if size <= 1e-10 * max(map(abs, self.alpha)) or len(self.alpha) >= min(_LANCZOS_STEPS, len(product)):
            self.done = True
        else:
            self.basis.append(product / size)

    def least(self) -> float:
        if not self.alpha:
            return 0.0
        k = len(self.alpha)
        t = np.diag(self.alpha) + np.diag(self.beta[: k - 1], 1) + np.diag(self.beta[: k - 1], -1)
        values, vectors = np.linalg.eigh(t)
        return max(0.0, values[0] - self.beta[-1] * abs(vectors[-1, 0]))


@dataclass
class Whitening:
    """A fitted transform: components in columns, their eigenvalues, and the total variance."""

    centre: Centre
    components: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components / np.sqrt(self.values)


class _Solver:
    def __init__(self, rows: DataFrame, centre: Centre, wanted: int, guard: int):
        self.rows, self.centre, self.dim = rows, centre, len(centre.sums)
        self.wanted = min(wanted, self.dim)
        self.rng = np.random.default_rng(20)
        self.width = min(self.dim, self.wanted + guard)
        self.lanczos = _Lanczos(self.dim, self.rng)
        self.locked = np.zeros((self.dim, 0))
        self.tolerance = TOLERANCE * max(1.0, math.sqrt(self.dim) / 8)
        self.largest, self.passes, self.attempts = 0.0, 0, 0

    def times(self, q: np.ndarray) -> np.ndarray:
        """One distributed pass: the covariance times ``q``."""
        columns, centre = np.column_stack([q, self.lanczos.column]), self.centre

        def part(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ columns)

        self.passes += 1
        product = _summed(self.rows, part, columns.shape) / centre.n
        self.lanczos.advance(product[:, -1])
        return product[:, :-1]

    def _free(self, y: np.ndarray) -> np.ndarray:
        """``y`` without its part among locked vectors."""
        for _ in range(2):
            y = y - self.locked @ (self.locked.T @ y)
        return y

    def _orthonormal(self, y: np.ndarray) -> np.ndarray:
        y = self._free(y / np.linalg.norm(y, axis=0))
        q, _ = np.linalg.qr(y)
        q, _ = np.linalg.qr(self._free(q))
        return q

    @staticmethod
    def _ritz(q: np.ndarray, z: np.ndarray):
        """Rayleigh-Ritz: vectors, products and values by falling value, with residuals."""
        h = q.T @ z
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, z = q @ turn, z @ turn
        return q, z, values, np.linalg.norm(z - q * values, axis=0)

    def _filtered(self, q: np.ndarray, z: np.ndarray, values: np.ndarray) -> np.ndarray:
        """``T_m`` of the scaled covariance on ``q``, whose product ``z`` is known."""
        # far below the leading value nothing is told apart before that is locked
        high = max(values[-1], values[0] / 10_000)
        low = min(self.lanczos.least(), 0.97 * high)
        centre, half = (high + low) / 2, (high - low) / 2
        top = max((values[0] - centre) / half, 1 + 1e-12)
        degree = int(np.clip(math.acosh(MOST_GROWTH) / math.acosh(top), 2, MOST_DEGREE))
        before, now = q, (z - centre * q) / half
        for _ in range(degree - 1):
            # locked directions lie far outside the interval, so they are taken out at every step
            before, now = now, self._free(2 * (self.times(now) - centre * now) / half - before)
        return now

    def solve(self, trace: float) -> Whitening:
        q = self._orthonormal(self.rng.standard_normal((self.dim, self.width)))
        best, stalled = math.inf, 0
        while True:
            q, z, values, residuals = self._ritz(q, self._free(self.times(q)))
            self.largest = max(self.largest, float(values[0]))
            left = self.wanted - self.locked.shape[1]
            settled = residuals[:left] <= self.tolerance * self.largest
            complete = q.shape[1] + self.locked.shape[1] == self.dim
            ready = left if complete or settled.all() else int(np.argmin(settled))
            if not ready:
                if residuals[0] > best / 2:
                    stalled += 1
                else:
                    best, stalled = residuals[0], 0
                if stalled >= PATIENCE and residuals[0] <= ROUNDING * self.largest:
                    ready = 1  # as near as sums of this many numbers allow
                elif stalled >= PATIENCE:
                    more = min(2 * q.shape[1], self.dim - self.locked.shape[1]) - q.shape[1]
                    q = self._orthonormal(np.column_stack([q, self.rng.standard_normal((self.dim, more))]))
                    best, stalled = math.inf, 0
                    continue
            if ready:
                best, stalled = math.inf, 0
                self.locked = np.column_stack([self.locked, q[:, :ready]])
                q, z, values = q[:, ready:], z[:, ready:], values[ready:]
                if self.locked.shape[1] == self.wanted:
                    model, q = self._certified(trace, q, complete)
                    if model is not None:
                        return model
                    continue
            q = self._orthonormal(self._filtered(q, z, values))

    def _certified(self, trace: float, rest: np.ndarray, complete: bool):
        """The transform, if all vectors at once pass, those of the block's rest included; else a new start."""
        whole = np.linalg.qr(np.column_stack([self.locked, rest]))[0]
        self.locked = np.zeros((self.dim, 0))
        q, _, values, residuals = self._ritz(whole, self.times(whole))
        residual = residuals[: self.wanted].max()
        self.attempts += 1
        if residual > max(8 * self.tolerance, ROUNDING) * self.largest and not complete:
            if self.attempts == ATTEMPTS:
                raise ArithmeticError(f"components are not certified: residual {residual} of {self.largest}")
            return None, q
        above_rounding = values[: self.wanted] > self.dim * np.finfo(float).eps * self.largest
        keep = int(above_rounding.sum())
        q, values = q[:, :keep], values[:keep]
        lead = np.abs(q).argmax(axis=0)
        q = q * np.sign(q[lead, np.arange(keep)])
        relative = float(residual / self.largest) if keep else 0.0
        return Whitening(self.centre, q, values, trace, relative, self.passes), q


def _with_dim(rows: DataFrame) -> DataFrame:
    return rows.select("data", "dim")


def fit(staged: DataFrame, components: int = COMPONENTS, guard: int = GUARD) -> tuple[Whitening | None, DataFrame]:
    """The transform of staged ``blocks``, and those of them it holds for."""
    lengths = staged.groupBy("dim").agg(F.sum("n").alias("rows"))
    most = lengths.orderBy(F.desc("rows"), F.desc("dim")).first()
    if most is None:
        return None, staged
    fitted = staged.where(F.col("dim") == most.dim)
    rows = _with_dim(fitted)
    sums = rows.mapInArrow(_exact_sums, "j int, total decimal(38,0)").groupBy("j").agg(F.sum("total").alias("s"))
    # one row per dimension
    centre = Centre(most.rows, [int(r.s) for r in sorted(sums.collect())])
    squares = _summed(rows, lambda x: np.array([[np.square(centre.centred(x)).sum()]]), (1, 1))
    trace = float(squares[0, 0]) / centre.n
    return _Solver(rows, centre, components, guard).solve(trace), fitted


def identity_error(staged: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, by one pass."""
    k = len(model.values)
    if not k:
        return 0.0

    def part(x: np.ndarray) -> np.ndarray:
        w = model.apply(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    sums = _summed(_with_dim(staged), part, (k + 1, k)) / model.centre.n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def transform(staged: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened``: one row per vector."""
    kind = staged.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in enumerate(_matrices([batch], 1)):
                whitened = model.apply(x)
                n, k = whitened.shape
                arrays = [
                    batch.column(0).slice(row, 1).flatten(),
                    pa.array(model.centre.deviations(x), pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays((np.arange(n + 1) * k).astype(np.int32), whitened.ravel()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "deviation", "whitened"])

    schema = f"vec_id {kind.simpleString()}, deviation decimal(38,0), whitened array<double>"
    return staged.select("ids", "data", "dim").mapInArrow(run, schema)


@dataclass
class Result:
    model: Whitening | None
    vectors: DataFrame
    identity_error: float


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> Result:
    """Fit on all valid vectors and transform them."""
    spark = vectors.sparkSession
    staged = Staging(spark, "whitening").put(blocks(vectors, id_column, vector_column), "blocks")
    model, fitted = fit(staged, components)
    if model is None:
        kind = vectors.schema[id_column].dataType
        fields = [("vec_id", kind), ("deviation", T.DecimalType(38, 0)), ("whitened", T.ArrayType(T.DoubleType()))]
        none = spark.createDataFrame([], T.StructType([T.StructField(*f) for f in fields]))
        return Result(None, none, 0.0)
    return Result(model, transform(fitted, model), identity_error(fitted, model))
