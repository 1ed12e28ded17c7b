"""Whitening of vectors by the principal components of their covariance.

Each distinct vector counts once. Tasks read their part vector by vector and keep a
count, a mean and the sum of products of deviations, which every vector changes by an
update of rank one (Welford). States of parts are merged by the parallel formula, in
rounds, so that neither a task nor the driver reads more than ``FAN`` of them. Entries
are integers, so each state counts from its first vector: the means stay small and
nothing is lost to the offset that all entries share. The eigenvectors come from a
symmetric QR iteration.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

SCALE, OFFSET = 64, 1_000_000
#: Components that are returned.
COMPONENTS = 16
#: States that a task, or at last the driver, merges: one after the other, each of d * d numbers.
FAN = 32
#: Entries beyond are held there, so that sums of two and the offset fit 64 bits.
MOST = 2.0**60
STATES = "d int, n long, origin array<long>, sums array<decimal(38,0)>, mean array<double>, products array<double>"
LOW = (1 << 31) - 1


def scaled(embeddings: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, x (integers), d (how many), for the vectors that take part: neither null nor with null or non-finite entries."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    held = lambda c: F.least(F.greatest(c.cast("double") * scale, F.lit(-MOST)), F.lit(MOST))
    return embeddings.where(F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(held(c)).cast("long") + F.lit(offset)).alias("x"), F.size("embedding").alias("d"))


class Moments:
    """Count, sums, mean and products of deviations of the vectors read so far. Means count from ``origin``, the first vector."""

    def __init__(self, origin: np.ndarray):
        d = len(origin)
        self.n, self.origin, self.sums = 0, origin, [0] * d
        self.mean, self.products = np.zeros(d), np.zeros((d, d))

    def add(self, x: np.ndarray) -> None:
        """Welford's update for one vector."""
        self.n += 1
        away = (x - self.origin) - self.mean
        self.mean += away / self.n
        self.products += away[:, None] * ((x - self.origin) - self.mean)

    def add_all(self, vectors: np.ndarray) -> None:
        for x in vectors:
            self.add(x)
        if vectors.dtype == np.int64:
            # two halves of each number, so that sums of a batch fit 64 bits
            halves = (vectors >> 31).sum(axis=0), (vectors & LOW).sum(axis=0)
            self.sums = [s + (int(a) << 31) + int(b) for s, a, b in zip(self.sums, *halves)]

    def merge(self, other: Moments) -> None:
        """The state of both parts (the parallel formula)."""
        both = self.n + other.n
        away = (other.origin - self.origin) + (other.mean - self.mean)
        self.products += other.products + np.outer(away, away) * (self.n * other.n / both)
        self.mean += away * (other.n / both)
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
        self.n = both

    def row(self) -> tuple:
        return len(self.mean), self.n, self.origin.astype(np.int64), [Decimal(s) for s in self.sums], self.mean, self.products.ravel()

    @staticmethod
    def read(row) -> Moments:
        out = Moments(np.array(row.origin, np.int64))
        out.n, out.sums, out.mean = int(row.n), [int(s) for s in row.sums], np.array(row.mean, np.float64)
        out.products = np.array(row.products, np.float64).reshape(len(out.mean), -1)
        return out


def _frame(states: Iterable[Moments]) -> pd.DataFrame:
    return pd.DataFrame([s.row() for s in states], columns=[c.split()[0] for c in STATES.split(", ")])


def _merged(rows: Iterable, states: dict[int, Moments]) -> dict[int, Moments]:
    for row in rows:
        if row.d in states:
            states[row.d].merge(Moments.read(row))
        else:
            states[row.d] = Moments.read(row)
    return states


def by_length(vectors: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Places and vectors of each number of components."""
    lengths = vectors.map(len).to_numpy()
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, np.stack(vectors.iloc[at].to_numpy()).reshape(len(at), int(d))


def moments(vectors: DataFrame, column: str = "x", fan: int = FAN) -> dict[int, Moments]:
    """The state of all vectors of each number of components. Only ``fan`` states of a kind, at most, reach the driver."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[int, Moments] = {}
        for b in batches:
            for d, _, part in by_length(b[column]):
                if d not in states:
                    states[d] = Moments(part[0] if part.dtype == np.int64 else np.zeros(d, np.int64))
                states[d].add_all(part)
        yield _frame(states.values())

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[int, Moments] = {}
        for b in batches:
            _merged(b.itertuples(index=False), states)
        yield _frame(states.values())

    states = written(vectors.select(column).mapInPandas(read, STATES), "moments")
    while (most := states.groupBy("d").count().agg(F.max("count")).first()[0] or 0) > fan:
        # dealt by row, so that no task gets more than its share of the commonest length
        states = written(states.repartition(math.ceil(most / fan)).mapInPandas(merge, STATES), "moments")
    return _merged(states.toLocalIterator(), {})


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and basis (in rows) of ``a`` in three-diagonal form, by Householder reflections."""
    a, n = a.astype(np.float64).copy(), len(a)
    basis = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        norm = np.sqrt((v**2).sum())
        if not (v[1:] ** 2).sum():
            continue
        v[0] += math.copysign(norm, v[0])
        v /= np.sqrt((v**2).sum())
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        basis[k + 1 :] -= 2 * np.outer(v, v @ basis[k + 1 :])
    return np.diag(a).copy(), np.diag(a, 1).copy(), basis


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows; the largest entry of each is positive.

    Implicit QR steps with Wilkinson's shift on the three-diagonal form: each step chases
    a bulge down the part that hasn't split yet.
    """
    n = len(a)
    largest = float(np.abs(a).max(initial=0))
    if not largest:
        return np.zeros(n), np.eye(n)
    on, off, basis = tridiagonal(a / largest)
    high, tiny = n - 1, np.finfo(np.float64).eps
    while high > 0:
        off[np.abs(off) <= tiny * (np.abs(on[:-1]) + np.abs(on[1:])) * 0.5] = 0
        if not off[high - 1]:
            high -= 1
            continue
        low = high - 1
        while low and off[low - 1]:
            low -= 1
        half = (on[high - 1] - on[high]) / 2
        shift = on[high] - off[high - 1] ** 2 / (half + math.copysign(math.hypot(half, off[high - 1]), half))
        x, z = on[low] - shift, off[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                off[k - 1] = r
            p, q, e = on[k], on[k + 1], off[k]
            on[k], on[k + 1] = c * c * p + 2 * c * s * e + s * s * q, s * s * p - 2 * c * s * e + c * c * q
            off[k] = c * s * (q - p) + (c * c - s * s) * e
            if k < high - 1:
                x, z = off[k], s * off[k + 1]
                off[k + 1] *= c
            first = basis[k].copy()
            basis[k] = c * first + s * basis[k + 1]
            basis[k + 1] = c * basis[k + 1] - s * first
    order = np.argsort(-on, kind="stable")
    vectors = basis[order]
    signs = np.sign(vectors[np.arange(n), np.abs(vectors).argmax(axis=1)])
    return on[order] * largest, vectors * signs[:, None]


@dataclass
class Whitening:
    """What whitens vectors of ``d`` components: exact count and sums, falling eigenvalues, their eigenvectors in rows, and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @staticmethod
    def of(m: Moments, components: int = COMPONENTS) -> Whitening:
        covariance = m.products / m.n
        values, vectors = eigen((covariance + covariance.T) / 2)
        # what rounding leaves of a direction without any variance is none
        values = np.where(values > len(values) * np.finfo(np.float64).eps * max(values.max(initial=0), 0), values, 0.0)
        return Whitening(m.n, m.sums, values[:components], vectors[:components], float(np.trace(covariance)))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: 64-bit integers where they hold it, else Python's."""
        most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * self.n + max((abs(s) for s in self.sums), default=0)
        if most < 2**62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """The sums of squares; None where 64 bits don't hold one."""
        most = max(abs(int(centred.min(initial=0))), abs(int(centred.max(initial=0))))
        if most * most * centred.shape[1] < 2**62:
            return (centred**2).sum(axis=1).tolist()
        sums = [sum(int(c) ** 2 for c in row) for row in centred]
        return [s if s < 2**63 else None for s in sums]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Projections over the roots of the eigenvalues; NaN where there is no variance."""
        shares = (centred / self.n).astype(np.float64) @ self.vectors.T
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, shares / np.sqrt(self.values), np.nan)


def apply(rows: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """vec_id, d, deviation, whitened of each row (vec_id, x). The models, d * ``COMPONENTS`` numbers each, are broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, at, x in by_length(b["x"]):
                model = shared.value[d]
                centred = model.centred(x)
                yield pd.DataFrame({
                    "vec_id": b["vec_id"].iloc[at].astype("Int64").to_numpy(), "d": d,
                    "deviation": pd.array(model.deviations(centred), "Int64"), "whitened": list(model.whitened(centred)),
                })

    return rows.select("vec_id", "x").mapInPandas(run, "vec_id long, d int, deviation long, whitened array<double>")


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A model for each number of components of ``rows`` (x); its error is measured on the whitened vectors that it was fitted on."""
    distinct = written(rows.where("d > 0").select("x").distinct(), "fit")
    models = {d: Whitening.of(m, components) for d, m in moments(distinct).items()}
    whitened = apply(distinct.select(F.lit(0).cast("long").alias("vec_id"), "x"), models)
    # a length may have fewer directions with variance than others: the error is of those that it has
    for d, model in models.items():
        good = int((model.values > 0).sum())
        if good:
            part = whitened.where(F.col("d") == d).select(F.slice("whitened", 1, good).alias("w"))
            found = moments(part, "w")[good]
            model.identity_error = float(np.abs(found.products / found.n - np.eye(good)).max())
    return models


def listed(rows: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """d, component, n, eigenvalue, explained, identity_error: a row per component of each model."""
    found = [
        (d, k + 1, m.n, float(e), float(e / m.trace) if m.trace else 0.0, m.identity_error)
        for d, m in models.items() for k, e in enumerate(m.values)
    ]
    return rows.sparkSession.createDataFrame(found, "d int, component int, n long, eigenvalue double, explained double, identity_error double")


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error; and d and the eigenvalue.

    Vectors that are null or hold a null or non-finite entry take no part; those of each
    number of components are whitened by themselves. Repeated rows and equal vectors
    count once in the fit and each get rows. A vector of no components, and a table
    without vectors, give no rows. A direction without variance (too few distinct
    vectors, or constant entries) has a null ``whitened``; the error is of the others,
    null if there are none. ``deviation`` is null beyond 64 bits. A null id is kept.
    Other columns are not looked at.
    """
    rows = scaled(embeddings)
    models = fit(rows, components)
    values = apply(rows.where("d > 0"), models).select("vec_id", "d", "deviation", F.posexplode("whitened").alias("place", "value"))
    values = values.select("vec_id", "d", "deviation", (F.col("place") + 1).alias("component"), F.nanvl("value", F.lit(None).cast("double")).alias("whitened"))
    # a row per component of each length
    return values.join(F.broadcast(listed(rows, models)), ["d", "component"])
