"""Embedding whitening: the leading eigenvectors of the covariance, by a blocked Jacobi-Davidson method.

The covariance V is never formed. All that the method asks of the data is V Q for a few columns Q at once:
one pass over the fit list, in which every task centres its vectors (exactly, in integers), multiplies, and
adds up. The driver holds matrices of a vector's length by some tens of columns, and nothing per vector.

A step: Rayleigh-Ritz in the search space; pairs whose residual has reached double precision are locked,
in order, and the space is kept orthogonal to them; for the others the projected correction equations

    (I - Q Q') (V - theta I) (I - Q Q') t = -r,      Q = locked vectors and the pair's own

are solved by a few steps of MINRES, side by side, so that each costs one pass for all pairs together; the
corrections widen the space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.tables import quoted, stored

# ---- fixed values: how entries become whole numbers ----------------------------------------------
SCALE = 64
OFFSET = 1_000_000
LARGEST = 1 << 40
# ---- end of fixed values -------------------------------------------------------------------------

COMPONENTS = 16
#: Columns of the first search space beyond the wanted ones; columns at which it shrinks again.
SPARE = 8
WIDEST = 6 * COMPONENTS
#: MINRES steps of one correction at most, and the fall of its residual that is enough.
INNER = 4
ENOUGH = 0.1
#: A residual is at double precision below this share of the largest eigenvalue.
PRECISION = 2.0**-44
MOST_STEPS = 500
#: Eigenvalues below this share of the largest one are no component: the vectors do not vary there.
LEAST_SHARE = 1e-13
#: Tasks that add up what all tasks of a pass have found.
ADDERS = 16
SEED = 1


# ---- Jacobi-Davidson -----------------------------------------------------------------------------


def minres(
    times: Callable[[np.ndarray], np.ndarray],
    theta: np.ndarray,
    project: Callable[[np.ndarray], np.ndarray],
    right: np.ndarray,
    steps: int = INNER,
    enough: float = ENOUGH,
) -> np.ndarray:
    """Approximate solutions of P (V - theta_i) P t_i = right_i, column by column, one product a step."""
    safe = lambda x: np.where(x > 0, x, 1.0)
    v = project(right)
    beta = first = np.linalg.norm(v, axis=0)
    v = v / safe(beta)
    before = w = w_before = x = np.zeros_like(v)
    eta = beta.copy()
    c = c_before = np.ones_like(beta)
    s = s_before = np.zeros_like(beta)
    beta = np.zeros_like(beta)
    for _ in range(steps):
        moved = project(times(v) - v * theta)
        alpha = np.sum(v * moved, axis=0)
        after = moved - v * alpha - before * beta
        beta_after = np.linalg.norm(after, axis=0)
        delta = c * alpha - c_before * s * beta
        two, three = s * alpha + c_before * c * beta, s_before * beta
        one = np.hypot(delta, beta_after)
        c_after, s_after = np.where(one > 0, delta / safe(one), 1.0), beta_after / safe(one)
        w_after = np.where(one > 0, (v - w_before * three - w * two) / safe(one), 0.0)
        x = x + w_after * (c_after * eta)
        eta = -s_after * eta
        before, v = v, after / safe(beta_after)
        w_before, w = w, w_after
        c_before, c, s_before, s, beta = c, c_after, s, s_after, beta_after
        if (np.abs(eta) <= enough * first).all():
            break
    return x


def _orthogonal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `new` adds to the bases; columns that add nothing are left out."""
    kept: list[np.ndarray] = []
    for column in new.T:
        size = np.linalg.norm(column)
        if size == 0:
            continue
        column = column / size
        for _ in range(3):
            for basis in bases:
                column = column - basis @ (basis.T @ column)
            for other in kept:
                column = column - other * (other @ column)
            size = np.linalg.norm(column)
            if size < 1e-10:
                break
            column = column / size
        else:
            kept.append(column)
    return np.stack(kept, 1) if kept else new[:, :0]


def leading(times: Callable[[np.ndarray], np.ndarray], size: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues, falling, and their unit eigenvectors as columns, of the symmetric
    positive semidefinite matrix that `times` multiplies by."""
    wanted = min(most, size)
    rng = np.random.default_rng(SEED)
    locked, values = np.zeros((size, 0)), np.zeros(0)
    space = _orthogonal(rng.normal(size=(size, min(size, wanted + SPARE))))
    images = times(space)
    fresh = True  # images were just multiplied, not only turned
    for _ in range(MOST_STEPS):
        inner = space.T @ images
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, images = space @ turn, images @ turn
        residuals = images - space * theta
        residuals -= locked @ (locked.T @ residuals)
        sizes = np.linalg.norm(residuals, axis=0)
        largest = max(float(values[0]) if len(values) else 0.0, float(theta[0]), np.finfo(float).tiny)
        fine = sizes <= PRECISION * largest
        open_ = wanted - locked.shape[1]
        done = int(np.argmin(np.append(fine, False)))
        full = locked.shape[1] + space.shape[1] == size
        if full and fresh and done < open_:
            done = open_  # nothing is outside the space: this is what rounding leaves
        done = min(done, open_)
        locked, values = np.concatenate([locked, space[:, :done]], 1), np.concatenate([values, theta[:done]])
        space, images, theta, residuals, fine = space[:, done:], images[:, done:], theta[done:], residuals[:, done:], fine[done:]
        open_ -= done
        if not open_:
            return _in_order(locked, values)
        fresh = False
        if full:
            images, fresh = times(space), True
            continue
        if space.shape[1] > WIDEST:
            space, images = space[:, : 2 * COMPONENTS], images[:, : 2 * COMPONENTS]
        todo = np.flatnonzero(~fine[:open_])
        own = space[:, todo]

        def project(x: np.ndarray) -> np.ndarray:
            x = x - locked @ (locked.T @ x)
            return x - own * np.sum(own * x, axis=0)

        steps = minres(times, theta[todo], project, -residuals[:, todo])
        new = _orthogonal(steps, locked, space)
        if not new.shape[1]:
            new = _orthogonal(rng.normal(size=(size, len(todo))), locked, space)
        space, images = np.concatenate([space, new], 1), np.concatenate([images, times(new)], 1)
    raise ArithmeticError("the eigenvectors did not reach double precision")


def _in_order(vectors: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])
    return values[order], vectors * signs  # the same sign in every run


# ---- Spark ---------------------------------------------------------------------------------------


def whole_numbers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry; entries beyond 2^40 count as that."""
    largest = F.lit(float(LARGEST))
    entry = lambda c: F.floor(F.greatest(-largest, F.least(largest, c.cast("double") * SCALE))) + F.lit(OFFSET).cast("long")
    return F.transform(vector, entry)


def usable(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """Rows whose vector is neither null nor empty nor has null or non-finite entries, and has the usual
    length, the one of most such rows (of equal ones the greatest); and that length, 0 if there is none."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == F.lit(float("inf")))
    fine = vectors.where(F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False)))
    usual = fine.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = usual["size"] if usual else 0
    return fine.where(F.size(vector) == size), size


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, size)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: as 64-bit numbers if they fit, else as Python's."""
    bound = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if bound < 1 << 61:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


class FitList:
    """The distinct vectors, stored once; passes over them give sums that the driver can hold."""

    def __init__(self, rows: DataFrame, size: int):
        self.rows, self.size = stored(rows.select("x").distinct()), size
        self.spark = rows.sparkSession
        self.n, self.sums = self._totals()
        self.passes = 0

    def _totals(self) -> tuple[int, list[int]]:
        """Exact, by partial sums of each position."""
        size = self.size

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros(size, dtype=object)
            for batch in batches:
                x = _matrix(batch.column(0), size)
                n += len(x)
                total += x.sum(axis=0)  # below 2^63: a batch has some hundred rows
            places = pa.array(np.arange(size + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([places, pa.array([str(v) for v in [*total, n]])], names=["at", "v"])

        made = self.rows.mapInArrow(run, "at int, v string").withColumn("v", F.col("v").cast("decimal(38,0)"))
        got = {r["at"]: int(r["v"]) for r in made.groupBy("at").agg(F.sum("v").alias("v")).collect()}  # size + 1 rows
        return got.get(self.size, 0), [got.get(i, 0) for i in range(self.size)]

    def summed(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all tasks and batches of `of(centred vectors, one a row)`."""
        n, sums, size = self.n, self.sums, self.size

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                x = _matrix(batch.column(0), size)
                total += of(_centred(x, n, sums).astype(float) / n)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    total += np.frombuffer(part).reshape(shape)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        self.passes += 1
        got = self.rows.mapInArrow(run, "part binary").repartition(ADDERS).mapInArrow(add, "part binary").collect()
        return np.sum([np.frombuffer(r["part"]).reshape(shape) for r in got], axis=0)

    def times(self, q: np.ndarray) -> np.ndarray:
        """V Q."""
        sent = self.spark.sparkContext.broadcast(q)  # a vector's length by some tens of columns
        try:
            return self.summed(lambda c: c.T @ (c @ sent.value), q.shape) / self.n
        finally:
            sent.unpersist()

    def trace(self) -> float:
        return float(self.summed(lambda c: np.array([np.sum(c * c)]), (1,))[0]) / self.n


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each vector and each of the first `most` components: (vec_id, component, n, deviation, whitened,
    explained, identity_error), as the module's head and `usable` describe.

    Rows without a usable vector are left out; so are, for all rows, components along which the distinct
    vectors do not vary: all of them if there are fewer than two. Equal vectors count once in the fit and give
    equal rows; a null id stays; `deviation` is null beyond 64 bits; other columns are ignored; an empty table gives
    an empty table. Of equal eigenvalues any orthonormal vectors of their space are components.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_id].dataType.simpleString()
    named = vectors.select(F.col(quoted(vec_id)).alias("vec_id"), F.col(quoted(vector)).alias("embedding"))
    fine, size = usable(named)
    rows = fine.select("vec_id", whole_numbers(F.col("embedding")).alias("x"))
    nothing = spark.createDataFrame([], f"vec_id {kind}, {_OUT}")
    if not size:
        return nothing
    fit = FitList(rows, size)
    trace = fit.trace()
    if not trace > 0:
        return nothing
    values, basis = leading(fit.times, size, most)
    kept = values > LEAST_SHARE * values[0]
    values, scaled = values[kept], basis[:, kept] / np.sqrt(values[kept])
    k = len(values)

    def gram(c: np.ndarray) -> np.ndarray:
        w = c @ scaled
        return w.T @ w

    error = float(np.abs(fit.summed(gram, (k, k)) / fit.n - np.eye(k)).max())
    n, sums = fit.n, fit.sums
    model = spark.sparkContext.broadcast(scaled)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = _centred(_matrix(batch.column(1), size), n, sums)
            total = np.sum(exact.astype(object) ** 2, axis=1) if np.abs(exact).max(initial=0) > 1 << 25 else np.sum(exact * exact, axis=1)
            total = [int(t) if t < 1 << 63 else None for t in total]
            w = (exact.astype(float) / n) @ model.value
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), lists], names=["vec_id", "deviation", "w"])

    made = rows.mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")
    share = F.array(*[F.lit(float(v / trace)) for v in values])
    return made.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, "at").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
