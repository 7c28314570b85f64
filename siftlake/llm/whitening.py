"""Embedding whitening by Jacobi-Davidson: leading principal components of a covariance that is never formed.

Vectors become whole numbers, ``floor(1024 * c) + 100000``, so that sums and deviations are exact. They are written once, in blocks of
some thousand rows each, to the shared folder. From there on the covariance is only a product: each task centres its blocks and multiplies, and
the driver adds the tasks' sums (a matrix of as many columns as vectors were asked for). The driver holds a search space of some dozens of vectors:

1. Rayleigh-Ritz in the search space gives approximate pairs and their residuals. Pairs whose residual has reached double precision are locked, in order.
2. For each other wanted pair, MINRES solves the correction equation, projected against the locked and all wanted vectors. The equations
   advance together, so that a step of all of them is one product over the data.
3. The corrections enlarge the search space, which is cut back to the best vectors when it is full.

No row meets another one: there is no shuffle, whatever vectors repeat. A task holds one block; partial sums beyond SUMS_BYTES are added in groups before
they go to the driver.

Nulls, ties and odd rows: a row whose vector is null, or has a null, NaN or infinite entry, is dropped, as is one whose length isn't the most frequent
one (of equally frequent ones, the longest). Entries beyond 2^51 count as 2^51. Repeated rows and ids count each. Components with no variance (at most 1e-12
of the greatest) are left out, so vectors that are all equal, a single one, or empty ones give no components. An empty table gives no rows. Of equal eigenvalues the
components are any orthonormal ones. ``deviation`` is null where it doesn't fit a long. Own columns stay unless they have the names that are added.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

SCALE, SHIFT, GREATEST = 1024.0, 100_000, 2.0**51
#: Numbers in a block, bytes of blocks in a task (about), rows that are worth a task, and bytes of partial sums that the driver takes from tasks at once.
BLOCK_NUMBERS, TASK_BYTES, TASK_ROWS, SUMS_BYTES = 1 << 20, 64 << 20, 2000, 64 << 20
#: Vectors that the search space holds beyond those wanted before it is cut back; steps of MINRES, and what it leaves of a residual; rounds at most.
SPACE, INNER_STEPS, INNER_LEFT, ROUNDS = 32, 16, 1e-3, 200
#: Residuals over the greatest eigenvalue: double precision, and what rounding may leave if a residual falls no more.
PRECISE, ROUNDED = 2e-15, 1e-12
BLOCKS = "rows long, wide boolean, data binary, high binary, low binary"


def usable(vector: Column) -> Column:
    """Whether a vector has entries only that are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False))


def whole_numbers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``dims`` finite numbers, and these rows as whole numbers."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    right = np.flatnonzero(lengths == dims)
    entries = np.asarray(column.take(pa.array(right)).flatten().cast(pa.float64()).fill_null(math.nan)).reshape(-1, dims)
    finite = np.isfinite(entries).all(axis=1)
    good = np.zeros(len(lengths), bool)
    good[right[finite]] = True
    return good, np.floor(np.clip(entries[finite] * SCALE, -GREATEST, GREATEST)).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Centre:
    """The mean as whole part, and remainder over n, so that centring loses nothing to rounding."""

    n: int
    whole: np.ndarray
    remainder: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        parts = [divmod(s, n) for s in sums]
        return cls(n, np.array([w for w, _ in parts], np.int64), np.array([r for _, r in parts], np.int64))

    def centred(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers - self.whole) - self.remainder / self.n

    def deviations(self, numbers: np.ndarray) -> pa.Array:
        """Sums over a row of (n * x - S)^2; null beyond a long."""
        if not len(numbers):
            return pa.array([], pa.int64())
        apart = numbers - self.whole
        rough = np.square(apart * float(self.n) - self.remainder).sum(axis=1)
        with np.errstate(over="ignore"):
            exact = np.square(apart * np.int64(self.n) - self.remainder).sum(axis=1)
        return pa.array(exact, pa.int64(), mask=rough >= 2.0**63 * (1 - 1e-9))


class Blocks:
    """The written vectors, and sums over all of them: ``add`` turns a centred block into a matrix of fixed shape."""

    def __init__(self, vectors: DataFrame, vector: str):
        column = F.col(vector).cast("array<double>")
        found = vectors.select(column.alias("_v")).where(usable(F.col("_v"))).groupBy(F.size("_v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
        self.n, self.dims = (found["count"], found["dims"]) if found else (0, 0)
        self.centre = None
        if not self.n or not self.dims:
            return
        spread = min(vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(self.n / TASK_ROWS))
        self.tasks = max(spread, math.ceil(4 * self.n * self.dims / TASK_BYTES))
        dims, height = self.dims, max(1, BLOCK_NUMBERS // self.dims)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting, rows = [], 0

            def block() -> pa.RecordBatch:
                x = np.concatenate(waiting) - SHIFT
                wide = bool(np.abs(x).max() >= 1 << 31)
                data = x.astype("<i8" if wide else "<i4").tobytes()
                high, low = (x >> 24).sum(axis=0), (x & 0xFFFFFF).sum(axis=0)
                return pa.RecordBatch.from_pydict({"rows": [len(x)], "wide": [wide], "data": pa.array([data], pa.binary()), "high": pa.array([high.tobytes()], pa.binary()), "low": pa.array([low.tobytes()], pa.binary())})

            for batch in batches:
                numbers = whole_numbers(batch.column(0), dims)[1]
                for at in range(0, len(numbers), height):
                    waiting.append(numbers[at : at + height])
                    rows += len(waiting[-1])
                    if rows >= height:
                        yield block()
                        waiting.clear()
                        rows = 0
            if rows:
                yield block()

        self.df = stored(vectors.select(column.alias("_v")).coalesce(self.tasks).mapInArrow(packed, BLOCKS), "vectors")
        self.centre = Centre.of(self.n, self._sums())

    def _sums(self) -> list[int]:
        def partial(batches):
            high = low = np.zeros(dims, np.int64)
            for batch in batches:
                for h, w in zip(batch.column(0), batch.column(1), strict=True):
                    high, low = high + np.frombuffer(h.as_buffer(), np.int64), low + np.frombuffer(w.as_buffer(), np.int64)
            yield pa.RecordBatch.from_pydict({"high": pa.array([high.tobytes()], pa.binary()), "low": pa.array([low.tobytes()], pa.binary())})

        dims, total = self.dims, [SHIFT * self.n] * self.dims
        for row in self.df.select("high", "low").mapInArrow(partial, "high binary, low binary").toLocalIterator():
            high, low = np.frombuffer(row["high"], np.int64).tolist(), np.frombuffer(row["low"], np.int64).tolist()
            total = [t + (h << 24) + w for t, h, w in zip(total, high, low, strict=True)]
        return total

    def added(self, add: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum of ``add`` over all centred blocks; tasks add in order, and the driver in the order of tasks."""
        centre, dims = self.centre, self.dims

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros(shape)
            for batch in batches:
                for wide, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    x = np.frombuffer(data.as_buffer(), "<i8" if wide else "<i4").reshape(-1, dims)
                    total += add(centre.centred(x.astype(np.int64) + SHIFT))
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "sums": pa.array([total.tobytes()], pa.binary())})

        def together(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("part")
            total = sum((np.frombuffer(x.as_buffer()) for x in rows.column("sums")), np.zeros(math.prod(shape)))
            return pa.table({"part": [rows.column("part")[0].as_py()], "sums": pa.array([total.tobytes()], pa.binary())})

        sums = self.df.select("wide", "data").mapInArrow(partial, "part long, sums binary")
        if self.tasks * math.prod(shape) * 8 > SUMS_BYTES:
            sums = sums.groupBy(F.col("part") % math.ceil(math.sqrt(self.tasks))).applyInArrow(together, "part long, sums binary")
        rows = sorted(sums.collect(), key=lambda r: r["part"])
        return sum((np.frombuffer(r["sums"]).reshape(shape) for r in rows), np.zeros(shape))

    def product(self, columns: np.ndarray) -> np.ndarray:
        """The covariance times ``columns``."""
        return self.added(lambda c: c.T @ (c @ columns), columns.shape) / self.n


def minres(product: Callable[[np.ndarray, np.ndarray], np.ndarray], right: np.ndarray, steps: int, left: float) -> np.ndarray:
    """Minimal residual solutions for several right sides at once; ``product(columns, which)`` applies the operator of each column.

    A column rests when ``left`` of its residual is left, or its Krylov space is exhausted.
    """
    x, v_old, w, w_old = (np.zeros_like(right) for _ in range(4))
    beta, eta = np.zeros(right.shape[1]), np.linalg.norm(right, axis=0)
    goal, live = left * eta, eta > 0
    v = np.divide(right, eta, out=np.zeros_like(right), where=live)
    c = c_old = np.ones(right.shape[1])
    s = s_old = np.zeros(right.shape[1])
    for _ in range(steps):
        if not live.any():
            break
        p = np.zeros_like(right)
        p[:, live] = product(v[:, live], np.flatnonzero(live))
        alpha = (v * p).sum(axis=0)
        p -= alpha * v + beta * v_old
        beta_new = np.where(live, np.linalg.norm(p, axis=0), 0.0)
        delta = c * alpha - c_old * s * beta
        rho_1, rho_2, rho_3 = np.hypot(delta, beta_new), s * alpha + c_old * c * beta, s_old * beta
        live = live & (rho_1 > 0)
        inverse = np.divide(1.0, rho_1, out=np.zeros_like(rho_1), where=live)
        w_new = (v - rho_3 * w_old - rho_2 * w) * inverse
        c_new, s_new = delta * inverse, beta_new * inverse
        x += np.where(live, c_new * eta, 0.0) * w_new
        eta = np.where(live, -s_new * eta, eta)
        live = live & (np.abs(eta) > goal) & (beta_new > 0)
        v_old, v = v, np.divide(p, beta_new, out=np.zeros_like(p), where=live)
        w_old, w, c_old, c, s_old, s, beta = w, w_new, c, c_new, s, s_new, beta_new
    return x


def _orthonormal(columns: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``columns`` add to the given orthonormal ones; what is rounding only is left out."""
    kept = np.empty((len(columns), 0))
    for column in columns.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        column, before = column / size, 1.0
        for _ in range(3):
            for basis in (*against, kept):
                column = column - basis @ (basis.T @ column)
            after = np.linalg.norm(column)
            if after < 1e-10:
                break
            column = column / after
            if after > 0.5 * before:
                kept = np.column_stack([kept, column])
                break
            before = 1.0
    return kept


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dims: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of a symmetric operator of ``dims`` rows, falling, with unit eigenvectors as columns and their residuals.

    ``product`` is called with few columns at a time. A residual is good at PRECISE times the greatest eigenvalue, or if it is at most ROUNDED
    times that and has stopped falling.
    """
    k = min(k, dims)
    space = _orthonormal(np.random.default_rng(seed).standard_normal((dims, min(dims, 2 * k))))
    image, lasting = product(space), [math.inf] * k
    locked, locked_values, locked_left = np.empty((dims, 0)), [], []
    for _ in range(ROUNDS):
        small = space.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        order, wanted = np.argsort(-values, kind="stable"), k - len(locked_values)
        values, turns = values[order], turns[:, order]
        ritz, images = space @ turns[:, :wanted], image @ turns[:, :wanted]
        residuals = images - ritz * values[:wanted]
        residuals -= locked @ (locked.T @ residuals)
        sizes, top = np.linalg.norm(residuals, axis=0), max([*locked_values[:1], values[0], np.finfo(float).tiny])
        good = [r <= PRECISE * top or (r <= ROUNDED * top and r > lasting[j + k - wanted] / 2) or space.shape[1] + locked.shape[1] >= dims for j, r in enumerate(sizes)]
        done = good.index(False) if False in good else len(good)  # locked in order, so that none is passed over
        lasting[k - wanted :] = sizes.tolist()
        if done:
            locked = np.column_stack([locked, ritz[:, :done]])
            locked_values += values[:done].tolist()
            locked_left += sizes[:done].tolist()
            space, image = space @ turns[:, done:], image @ turns[:, done:]
            values, turns = values[done:], np.eye(space.shape[1])
            ritz, residuals = ritz[:, done:], residuals[:, done:]
        if len(locked_values) == k:
            order = np.argsort([-v for v in locked_values], kind="stable")
            return np.array(locked_values)[order], locked[:, order], np.array(locked_left)[order]
        if space.shape[1] > k + SPACE:
            keep = len(ritz.T) + k
            space, image = space @ turns[:, :keep], image @ turns[:, :keep]
        shield = np.column_stack([locked, ritz])

        def projected(columns: np.ndarray, which: np.ndarray) -> np.ndarray:
            out = product(columns) - columns * values[which]
            return out - shield @ (shield.T @ out)

        right = -(residuals - shield @ (shield.T @ residuals))
        fresh = _orthonormal(np.column_stack([minres(projected, right, INNER_STEPS, INNER_LEFT), residuals]), locked, space)[:, : 2 * k]
        if not fresh.shape[1]:  # nothing new: the residuals are rounding
            lasting = [0.0] * k
            fresh = _orthonormal(np.random.default_rng(seed + space.shape[1]).standard_normal((dims, 1)), locked, space)
        if fresh.shape[1]:
            space, image = np.column_stack([space, fresh]), np.column_stack([image, product(fresh)])
    raise ArithmeticError(f"{k - len(locked_values)} components have not converged in {ROUNDS} rounds")


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: eigenvalues (falling), unit components as columns, the centre, the covariance's trace, and the whitened covariance's
    largest difference from the identity."""

    dims: int
    centre: Centre | None
    eigenvalues: np.ndarray
    components: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


def fit(vectors: DataFrame, k: int = 8, vector: str = "embedding") -> Whitening:
    """Fit over all usable vectors."""
    blocks = Blocks(vectors, vector)
    if blocks.centre is None:
        return Whitening(blocks.dims, None, np.empty(0), np.empty((blocks.dims, 0)), np.empty(0), 0.0, 0.0)
    trace = float(blocks.added(lambda c: np.square(c).sum(axis=0), (blocks.dims,)).sum() / blocks.n)
    if not trace:
        return Whitening(blocks.dims, blocks.centre, np.empty(0), np.empty((blocks.dims, 0)), np.empty(0), 0.0, 0.0)
    values, components, residuals = jacobi_davidson(blocks.product, blocks.dims, k)
    there = values > 1e-12 * values[0]
    values, components, residuals = values[there], components[:, there], residuals[there]
    whitener, m = components / np.sqrt(values), len(values)

    def moments(c: np.ndarray) -> np.ndarray:
        w = c @ whitener
        return np.vstack([w.T @ w, w.sum(axis=0)])

    sums = blocks.added(moments, (m + 1, m)) / blocks.n
    error = float(np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(m)).max())
    return Whitening(blocks.dims, blocks.centre, values, components, residuals, trace, error)


ADDED = [T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]


def whiten(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The usable rows of ``vectors`` with n (vectors of the fit), deviation (sum of (n * x - S)^2) and whitened (a number for each component)."""
    own = [c for c in vectors.columns if c not in [f.name for f in ADDED]]
    schema = T.StructType([*vectors.select(*own).schema.fields, *ADDED])
    if model.centre is None:
        return vectors.sparkSession.createDataFrame([], schema)
    centre, dims, m, whitener = model.centre, model.dims, len(model.eigenvalues), model.components / np.sqrt(model.eigenvalues)
    height, place = max(1, BLOCK_NUMBERS // dims), own.index(vector)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, height):
                part = batch.slice(at, height)
                good, numbers = whole_numbers(part.column(place), dims)
                kept = part.filter(pa.array(good))
                white = pa.array((centre.centred(numbers) @ whitener).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(numbers) + 1) * m, pa.int32()), white)
                columns = [*kept.columns, pa.array(np.full(len(numbers), centre.n)), centre.deviations(numbers), lists]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return vectors.select(*own).mapInArrow(rows, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors)
    # The fit's table of vectors has the same rows: only ids and what the result holds come from here.
    rows = whiten(vectors, model).select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*(F.lit(x) for x in model.explained)).cast("array<double>"), F.col("at") + 1)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
